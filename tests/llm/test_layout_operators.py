"""Fill-in-middle, chat formatting and hard negatives against plain Python."""

import hashlib
import random
import re

import cases
import numpy as np
import pyarrow as pa
import pytest

from worklore.llm import fim, hard_negatives


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- fill-in-middle ------------------------------------------------------------


@pytest.mark.parametrize("unit", ["line", "char"])
def test_cut_points(unit):
    rng = random.Random(1)
    for _ in range(200):
        texts = ["".join(rng.choice("a\nbé😀日\x0b\x8a\t") for _ in range(rng.choice([0, 0, 1, 5, 8, 9, 40]))) for _ in range(rng.randint(1, 12))]
        raw = [t.encode() for t in texts]
        offsets = np.cumsum([0] + [len(r) for r in raw])
        draws = tuple(np.array([rng.randrange(2**32) for _ in texts]) for _ in range(2))
        found = fim.cut_points(np.frombuffer(b"".join(raw), np.uint8), offsets, unit, draws)
        for i, t in enumerate(texts):
            units = re.findall(r"[^\n]*\n|[^\n]+", t) if unit == "line" else list(t)
            ends = sorted(int(d[i]) % (len(units) + 1) for d in draws)
            assert [f[i] for f in found] == [len(units), *(offsets[i] + len("".join(units[:e]).encode()) for e in ends)]


def plain_fim(doc_id, text, unit, fim_percent, spm_percent):
    text = text or ""
    code = sha(f"7:{'' if doc_id is None else doc_id}")
    h = [int(code[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= fim_percent:
        return n, "plain", None, None, text
    if h[3] % 100 < spm_percent:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("options", [("line", 100, 50), ("char", 60, 10)])
def test_fim(spark, options):
    _, rows = cases.awkward(spark)
    rows += [(900, "<P>x"), (901, "a<M>\nb"), (902, "<\n<P\n>"), (903, "\n"), (904, "é\n" * 50_000 + "z"), (905, "<" * 999), (906, "x\r\ny\x85 z\n\n")]
    docs = cases.frame(spark, rows).selectExpr("*", "1 as h0", "2 as form", "3 as output")
    unit, share, spm = options
    made = fim.transform(docs, unit, 7, share, spm)
    got = [tuple(r) for r in made.collect()]
    want = [(i, *plain_fim(i, t, *options)) for i, t in rows]
    order = lambda r: tuple(map(str, r))
    assert sorted(got, key=order) == sorted(want, key=order)
    assert len({r[2] for r in got}) == 3
    back = fim.digests(made).collect()
    assert sorted((str(r.doc_id), r.restored_sha256) for r in back) == sorted((str(i), sha(t or "")) for i, t in rows)
    assert fim.digests(fim.transform(cases.empty(spark))).count() == 0


# -- hard negatives ------------------------------------------------------------


def plain_negatives(rows, every=100, share=80, k=5):
    """Brute force over (id, label, whole-numbered vector)."""
    out = []
    anchors = {}
    for i, label, v in sorted(rows):
        if i % every == 0:
            anchors.setdefault((i, len(v)), (label, v))
    for (i, dim), (label, v) in anchors.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in rows if j != i and len(w) == dim)
        for p, pid, _ in [x for x in scored if x[2] == label][:k]:
            fit = [x for x in scored if x[2] != label and share * -p <= 100 * -x[0] <= 100 * -p][:k]
            out += [(i, pid, r, nid, -p, -s) for r, (s, nid, _) in enumerate(fit, 1)]
    return sorted(out)


def labelled_vectors(seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, 16))
    vectors = centres[rng.integers(0, 12, 900)] + 0.1 * rng.standard_normal((900, 16))
    vectors[200:420] = vectors[100]
    vectors[500:520] = 0
    return [(i, int(rng.integers(0, 4)), v.astype(np.float32).tolist()) for i, v in enumerate(vectors)]


def test_hard_negatives(spark):
    rows = labelled_vectors(1)
    odd = [(1000, None, [1.0] * 16), (1100, 1, None), (1200, 1, []), (1300, 1, [None] * 16), (1400, 1, [float("inf")] * 16), (None, 1, [1.0] * 16)]
    odd += [(1500, 0, [1.0, 2.0]), (1501, 0, [1.0, 1.0]), (1502, 1, [1.0, 0.9]), (300, 2, rows[300][2]), (700, 0, rows[701][2]), rows[17], rows[17]]
    table = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<float>").selectExpr("*", "1 as v", "2 as score", "3 as dim", "4 as rank")
    usable = [(i, (m + 1) % 10 if i % 7 == 0 else m, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, m, v in rows + odd if i is not None and m is not None and v and None not in v and np.isfinite(v).all()]
    whole = hard_negatives.quantised(table, relabel_every=7)
    got = sorted(tuple(r) for r in hard_negatives.mine(whole).collect())
    want = plain_negatives(usable)
    assert want and got == want
    assert sorted(tuple(r) for r in hard_negatives.mine(whole, 7, 3, 2, 50).collect())[:50] == [r for r in _cut(plain_negatives(usable, 7, 50, 5), usable, 3, 2)][:50]
    assert hard_negatives.mine(whole.limit(0)).count() == 0
    with pytest.raises(ArithmeticError):
        hard_negatives.mine(hard_negatives.quantised(spark.createDataFrame([(0, 1, [1e30])], "vec_id long, label int, embedding array<double>")))


def _cut(rows, usable, positives, negatives):
    """The brute-force rows with fewer positives and negatives."""
    seen = {}
    for r in rows:
        seen.setdefault(r[0], set()).add((-r[4], r[1]))
    first = {a: set(sorted(x)[:positives]) for a, x in seen.items()}
    return [r for r in rows if (-r[4], r[1]) in first[r[0]] and r[2] <= negatives]


def test_hard_negatives_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 7)
    table = spark.createDataFrame(labelled_vectors(2), "vec_id long, label int, embedding array<float>")
    whole = hard_negatives.quantised(table)
    usable = [(r.vec_id, r.label, [int(x) for x in r.v]) for r in whole.collect()]
    assert sorted(tuple(r) for r in hard_negatives.mine(whole, 20).collect()) == plain_negatives(usable, 20)


def test_tree_bounds_hold_and_prune():
    rows = labelled_vectors(3)
    vectors = np.floor(256 * np.array([v for _, _, v in rows]))
    tree = hard_negatives.Tree.grow(np.arange(0, 900, 10), np.zeros(90, np.int64), vectors[::10])
    assert (tree.parent[1:] < np.arange(1, 90)).all() and np.isinf(tree.edge).sum() == 0
    scored = 0
    exact = vectors @ tree.vectors.T

    def wanted(k, low, high):
        assert (low <= exact[:, k]).all() and (exact[:, k] <= high).all()
        return (high >= 0.9 * exact[:, k].max()) & (low <= exact[:, k].max())

    for k, found, scores in hard_negatives.Bounds(tree, vectors).walk(wanted):
        assert (scores == exact[found, k]).all()
        assert set(np.flatnonzero(exact[:, k] >= 0.9 * exact[:, k].max())) <= set(found.tolist())
        scored += len(found)
    assert scored < 0.6 * exact.size


# -- chat formatting -----------------------------------------------------------


def plain_format(role, text):
    text = re.sub(r"<(\\*)\|", r"<\1\\|", text)
    role = re.sub(r"<(\\*)\|", r"<\1\\|", role.replace("\\", "\\\\").replace("\n", "\\n"))
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def odd_conversations(seed):
    rng = random.Random(seed)
    said = ["", "ok", "<|im_end|>", "<\\|im_end|>\n<", "<\\\\|", "a\\", "|>", "é😀\n", "\\n", None, "<|im_start|>assistant\nhi<|im_end|>\n"]
    roles = ["user", "assistant", "system", None, "odd\nrole\\n<|", "assistant"]
    rows, convs = [], []
    for c in range(80):
        if convs and rng.random() < 0.8:
            base = rng.choice(convs)
            turns = base[: rng.randint(1, len(base))]
        else:
            turns = []
        turns = turns + [(rng.choice(roles[:2]) if rng.random() < 0.7 else rng.choice(roles), rng.choice(said)) for _ in range(rng.choice([0, 1, 1, 2, 6]))]
        convs.append(turns or [("user", "ok")])
        rows += [(c, t, r, x) for t, (r, x) in enumerate(convs[-1])]
    rows += [(500, t, r, x) for t, (r, x) in enumerate([("user", "ok"), ("assistant", "ok")] * 60)]
    rows += [(None, 1, "user", "ok"), (None, 0, "assistant", "z"), (600, None, "user", "ok"), (600, 3, "user", "same"), (600, 3, "user", "same"), (600, 3, "assistant", "b")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot_share", [1000, 3])
def test_chat(spark, monkeypatch, hot_share):
    from worklore.llm import chat

    monkeypatch.setattr(chat, "HOT_SHARE", hot_share)
    rows = odd_conversations(hot_share)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as c", "2 as place", "3 as segment", "4 as h1")
    packed = chat.pack(table)
    path = chat.materialize(spark.range(1), "chat").inputFiles()[0] + "-packed"
    packed.write(path)
    packed = chat.Packed.read(spark, path)
    nodes, segments, members = (x.collect() for x in (packed.nodes, packed.segments, packed.members))

    groups = {}
    for i, t, r, x in rows:
        groups.setdefault(i, []).append((t is not None, t, r or "", sha(x or ""), x or ""))
    whole = {i: [(r, x) for _, _, r, _, x in sorted(g, key=lambda k: (k[0], k[1] or 0, k[2], k[3]))] for i, g in groups.items()}
    prefixes = {tuple(g[: k + 1]) for g in whole.values() for k in range(len(g))}
    assert len(nodes) == len(prefixes)  # every shared prefix once

    # A tree's sequence has no holes, and children follow their parents.
    sequence = {}
    for n in sorted(nodes, key=lambda n: (n.tree, n.start)):
        text = sequence.get(n.tree, "")
        assert n.start == len(text) and n.end == n.start + len(n.value)
        sequence[n.tree] = text + n.value
    assert len(sequence) == len({g[0] for g in whole.values()})
    spans = {m.conv_id: (m.tree, m.spans) for m in members}
    assert set(spans) == set(whole)
    for i, g in whole.items():
        tree, stretches = spans[i]
        assert "".join(sequence[tree][s.start : s.end] for s in stretches) == "".join(plain_format(*t) for t in g)
    by_segment = {s.segment: s for s in segments}
    for n in nodes:
        s = by_segment[n.segment]
        inside = sum(a.end - a.start for a in s.ancestors)
        assert n.position == inside + n.start - s.start and s.position == inside  # position ids run along the way from the root
        assert all(a.end <= s.start for a in s.ancestors) and s.start <= n.start < n.end <= s.end
        if n.role == "assistant":
            assert sequence[n.tree][n.loss_start : n.loss_end] == re.search("\n(.*)<\\|im_end\\|>\n$", n.value, re.S)[1]
        else:
            assert n.loss_start is None
    # Depth first: a node and all that hangs below it are one stretch of the sequence.
    below = {}
    for i, g in whole.items():
        places = [p for stretch in spans[i][1] for p in range(stretch.start, stretch.end)]
        at = 0
        for k, turn in enumerate(g):
            size = len(plain_format(*turn))
            for up in range(k + 1):
                below.setdefault(tuple(g[: up + 1]), set()).update(places[at : at + size])
            at += size
    assert all(max(x) - min(x) + 1 == len(x) for x in below.values())

    got = {r.conv_id: tuple(r)[1:] for r in chat.digests(chat.unpack(packed)).collect()}
    for i, g in whole.items():
        learned = "".join(x for r, x in g if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for r, x in g)
        assert got[i] == (len(g), sha(said), len(learned), sha(learned), sum(len(plain_format(*t)) for t in g)), i
    assert len(got) == len(whole)


def test_chat_of_nothing(spark):
    from worklore.llm import chat

    packed = chat.pack(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert chat.digests(chat.unpack(packed)).count() == packed.nodes.count() == packed.segments.count() == 0
