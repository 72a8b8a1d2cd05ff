"""Operators on texts against brute force, on small awkward tables."""

import hashlib
import itertools
import re
from collections import Counter

import cases
import numpy as np
import pyarrow as pa
import pytest

from worklore.llm import decontam, jaccard, langid, line_dedup, quality, secrets, sentencepiece_fst, textbytes, toxicity


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def key(value):
    return -1 if value is None else value


def test_words_of_blocks():
    texts = ["Hello  World x", "", None, "é a\tb", "  ", "abc" * 100_000 + " z", "end"]
    for block in textbytes.blocks(pa.array(texts), 40):
        block = textbytes.folded(block)
        found = textbytes.words(block, textbytes.SPACES)
        hashes = textbytes.hash_words(block.data, found.starts, found.ends)
        for r in range(block.rows):
            span = slice(found.bounds[r], found.bounds[r + 1])
            got = [bytes(block.data[s:e]).decode() for s, e in zip(found.starts[span], found.ends[span])]
            assert got == lowered(texts[block.first_row + r]).split()
            assert len(set(hashes[span].tolist())) == len(set(got))


def brute_components(rows):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            up[top(a)] = top(b)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            smallest[top(k)] = min(smallest.get(top(k), 1 << 60), i)
    part = [smallest.get(top(k), -1) if sets[k] else key(i) for k, (i, _) in enumerate(rows)]
    return [(key(i), len(s), p) for (i, _), s, p in zip(rows, sets, part)], len({top(k) for k in range(len(rows)) if sets[k]}) + sum(not s for s in sets)


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join(spark, seed):
    docs, rows = cases.awkward(spark, seed)
    want, groups = brute_components(rows)
    got = [(key(r[0]), r[1], key(r[2])) for r in jaccard.near_duplicates(docs).collect()]
    assert Counter(got) == Counter(want)
    kept = jaccard.one_per_group(docs)
    assert kept.columns == docs.columns and kept.count() == groups
    assert jaccard.one_per_group(cases.empty(spark)).count() == 0


def brute_lines(rows, least):
    """Longest earlier run at every line, over all pairs of places."""
    docs = sorted({(i is None, i or 0, t) for i, t in rows if t is not None}, key=lambda d: d[:2])
    lines = [t.split("\n") for *_, t in docs]
    seen, gone = {}, [set() for _ in docs]
    for d, ls in enumerate(lines):
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                if sum(len(x.split()) for x in ls[a:b]) >= least:
                    seen.setdefault(tuple(ls[a:b]), []).append((d, a))
    for run, places in seen.items():
        for d, a in sorted(places)[1:]:
            gone[d] |= set(range(a, a + len(run)))
    return {doc: ("\n".join(x for k, x in enumerate(ls) if k not in g), len(g)) for doc, ls, g in zip(docs, lines, gone)}


@pytest.mark.parametrize("seed,least", [(1, 50), (2, 20), (3, 3)])
def test_line_dedup(spark, seed, least):
    # One text per id, as ties between texts of one id are broken by their keys.
    docs, rows = cases.awkward(spark, seed)
    rows = [r for r in rows if r[0] is not None]
    docs = docs.where("doc_id is not null")
    want = brute_lines(rows, least)
    got = line_dedup.report(docs, least).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        text, n = want[(False, r.doc_id, texts[r.doc_id])] if texts[r.doc_id] is not None else ("", 0)
        assert (r.n_removed, r.text_sha256) == (n, hashlib.sha256(text.encode()).hexdigest())
    kept = line_dedup.drop_repeats(docs, least)
    assert kept.columns == docs.columns
    assert line_dedup.drop_repeats(cases.empty(spark)).count() == 0


def test_line_dedup_null_ids(spark):
    docs, rows = cases.awkward(spark, 1)
    assert line_dedup.report(docs).count() == len(rows)


def brute_windows(text, items, window=10):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    hit, met = set(), set()
    for item, passage in items:
        p = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(passage))
        n = min(window, len(p))
        for s in {tuple(p[k : k + n]) for k in range(len(p) - n + 1)} if p else ():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) == s:
                    hit |= set(range(k, k + n))
                    met.add(str(item))
    return len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()


def test_decontamination(spark):
    docs, rows = cases.awkward(spark, 4)
    pieces = (rows[0][1] or "").split()
    items = [(1, " ".join(pieces[:14])), (2, "A b"), (3, None), (4, ""), (12, (rows[7][1] or "").upper()), (5, "word " * 12), (2, "A b")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(key(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.contamination(docs, bench).collect()]
    want = []
    for i, t in rows:
        n = brute_windows(t, items)
        want.append((key(i), *n, n[1] > 0))
    assert Counter(got) == Counter(want) and any(w[-1] for w in want)
    kept = decontam.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w[-1] for w in want)
    assert decontam.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.contamination(cases.empty(spark), bench).count() == 0


PLAIN = [
    (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
    (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]


def test_secrets(spark):
    import random

    rng = random.Random(3)
    parts = ["password", "token", "Secret", "api_key", "APIKEY", "=", ":", '"', "'", " ", "abcdefgh", "==", "é日", "\n", "AKIA", "AKIAABCDEFGH1234", "0123456789abcdef" * 2, "zz", "ghp_" + "a1" * 18]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [None, "", "token=" + "a" * 100_000]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    got = secrets.find_secrets(cases.frame(spark, rows)).collect()
    for r in got:
        want = sorted((m.start(), k, m.end()) for k, (rule, keeps) in enumerate(PLAIN) for m in rule.finditer(texts[r.doc_id] or "") if keeps(m))
        named = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(named.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, k, _ in want) for x in range(3)]
        assert ",".join(s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")) == named
    assert len(got) == len(rows) and any("github" in r.spans for r in got)
    assert secrets.find_secrets(cases.empty(spark)).count() == 0


def test_secrets_of_long_lines():
    """Lines of starts that never match, or that match late, are read in one go; spans equal a plain search."""
    import random
    import time

    scanner = secrets.compile_rules(secrets.RULES)
    rng = random.Random(5)
    parts = ["eyJ", "a", "-", ".", " ", "é", "-----BEGIN ", "A", "PRIVATE KEY-----", "RSA ", "password", "  ", "=", "abcdefgh", "token: ", "AKIA", "0f" * 9]
    plain = [(re.compile((r.head + r.body).encode(), re.I if r.any_case else 0), re.compile(r.head.encode(), re.I if r.any_case else 0)) for r in secrets.RULES]
    for size in [rng.randint(0, 80) for _ in range(1500)]:
        line = "".join(rng.choices(parts, k=size)).encode()
        want = []
        for number, (whole, head) in enumerate(plain):
            rule = secrets.RULES[number]
            found = [(m.start(), number, m.end(), len(head.match(m[0])[0]) if rule.of_body else 0) for m in whole.finditer(line)]
            want += [(a, n, b) for a, n, b, h in found if b - a - h >= rule.least]
        assert secrets.line_spans(line, scanner) == want, line
    begun = time.time()
    for text in ("eyJ" * 120_000 + "a.", "-----BEGIN " * 30_000 + "PRIVATE KEY----", ("token=" + "a" * 20 + " é ") * 10_000):
        spans = secrets.scan_batch(pa.array([text, "é " + text]), scanner)
        assert [(a + 2, r, b + 2) for a, r, b in spans.get(0, [])] == spans.get(1, [])
    assert time.time() - begun < 60


def test_sentencepiece(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL_PATH)
    docs, rows = cases.awkward(spark, 6)
    odd = ["  two", "a" + " " * 47 + "b", " " * 15, "tab\there\n", "привет мир\x00", "== === ----", "😀😀日本語"]
    docs = docs.unionByName(cases.frame(spark, [(900 + k, t) for k, t in enumerate(odd)]))
    encoded = sentencepiece_fst.encode(docs).collect()
    want = Counter((key(i), tuple(library.encode(t or ""))) for i, t in [*rows, *((900 + k, t) for k, t in enumerate(odd))])
    assert Counter((key(r.doc_id), tuple(r.ids)) for r in encoded) == want
    decoded = sentencepiece_fst.decode(sentencepiece_fst.encode(docs)).collect()
    assert Counter((key(r[0]), r[1]) for r in decoded) == Counter((key(r[0]), r[1] or "") for r in docs.select("doc_id", "text").collect())
    report = sentencepiece_fst.round_trip(docs)
    assert report.where("not same").count() == 0 and report.count() == len(encoded)
    assert sentencepiece_fst.encode(cases.empty(spark)).count() == 0


def labelled(spark, name, bad):
    import random
    import zlib

    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        words, y = cases.sentence(rng, rng.randint(20, 120)), rng.random() < 0.4
        for k in range(0, len(words), 8):
            if y:
                words[k] = bad(rng, words[k])
        rows.append((i, " ".join(words)))
        labels.append((i, int(y)))
    odd = [(1000, None), (1001, ""), (1002, " ! "), (1003, rows[0][1] + " " + "stone " * 4000), (1, rows[1][1]), (None, "river stone")]
    docs = cases.frame(spark, rows + odd)
    table = spark.createDataFrame([*labels, (5, None), (None, 1)], f"doc_id long, {name} int")
    return docs, table, {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}, dict(labels)


@pytest.mark.parametrize("module,name,bad", [(toxicity, "toxic", lambda r, w: r.choice(cases.BAD.split()) + r.choice(["", "s"])), (quality, "quality", lambda r, w: w.upper() + "!!")])
def test_classifiers(spark, module, name, bad):
    docs, labels, apart, truth = labelled(spark, name, bad)
    model = module.fit(docs, labels)
    got = module.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400} == apart
    right = [r.predicted == truth[r.doc_id] for r in got if r.doc_id in apart]
    assert np.mean(right) > 0.95
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    none = module.fit(docs, labels.limit(0))
    assert len({r.score for r in module.score(docs, none).collect()}) == 1
    assert module.score(cases.empty(spark), model).count() == 0


def test_toxic_documents_go(spark):
    docs, labels, _, truth = labelled(spark, "toxic", lambda r, w: r.choice(cases.BAD.split()))
    kept = toxicity.remove_toxic(docs, toxicity.fit(docs, labels))
    ids = {r[0] for r in kept.select("doc_id").collect()}
    assert kept.columns == docs.columns
    assert sum(truth[i] for i in ids if i in truth) < 8 and sum(not truth[i] for i in ids if i in truth) > 220


def test_toxicity_counts_every_labelled_row(spark):
    docs, labels, apart, truth = labelled(spark, "toxic", lambda r, w: r.choice(cases.BAD.split()))
    model = toxicity.fit(docs, labels, bound=20)
    texts = [(t, truth[i]) for i, t in docs.select("doc_id", "text").collect() if i in truth and i not in apart]
    keys, *_ = toxicity.count_grams(pa.array([t for t, _ in texts]), np.array([y for _, y in texts]))
    assert set(keys[keys >> textbytes.U64(56) == toxicity.ORDER].tolist()) == set((model.levels[-1].keys | textbytes.U64(toxicity.ORDER << 56)).tolist())


def test_toxicity_counts_in_tables(spark):
    docs, labels, _, _ = labelled(spark, "toxic", lambda r, w: r.choice(cases.BAD.split()))
    docs = docs.unionByName(docs.where("doc_id in (7, 1001)"))
    small, wide = toxicity.fit(docs, labels), toxicity.fit(docs, labels, most=100)
    assert isinstance(wide, toxicity.Tables)
    order = lambda rows: sorted(rows, key=lambda r: (key(r.doc_id), r.score))
    want, got = (order(toxicity.score(docs, m).collect()) for m in (small, wide))
    assert [(r.doc_id, r.held_out, r.predicted) for r in got] == [(r.doc_id, r.held_out, r.predicted) for r in want]
    assert np.allclose([r.score for r in got], [r.score for r in want], atol=1e-6)
    kept = toxicity.remove_toxic(docs, wide)
    assert kept.columns == docs.columns and sorted(map(key, (r[0] for r in kept.select("doc_id").collect()))) == sorted(key(r.doc_id) for r in want if not r.predicted)


def test_chain_marginals():
    rng = np.random.default_rng(0)
    for n, starts in [(5, [0, 3]), (7, [0]), (1, [0]), (9, [0, 1, 2, 8])]:
        emit, step, begin = rng.standard_normal((n, 3)), rng.standard_normal((3, 3)), rng.standard_normal(3)
        first = np.zeros(n, bool)
        first[starts] = True
        want = np.zeros((n, 3))
        for a, z in zip(starts, [*starts[1:], n]):
            for seq in itertools.product(range(3), repeat=z - a):
                s = np.exp(begin[seq[0]] + sum(emit[a + i, q] for i, q in enumerate(seq)) + sum(step[x, y] for x, y in zip(seq, seq[1:])))
                for i, q in enumerate(seq):
                    want[a + i, q] += s
        assert np.allclose(langid.marginals(emit, first, step, begin), want / want.sum(1, keepdims=True))


def test_language_id(spark):
    import random

    rng = random.Random(2)
    words = {"en": "the and that with shall under which other", "de": "und das mit nicht über schön werden zwischen", "fr": "les des avec être cette où français après"}
    rows = [(i, " ".join(rng.choice(words[lang].split()) for _ in range(rng.randint(5, 40))), lang) for i in range(300) for lang in [rng.choice(list(words))]]
    rows += [(400, None, "en"), (401, "", "de"), (402, "12 + 34 😀 —", None), (403, "日本語", None), (404, "das " * 9000, None), (0, rows[0][1], rows[0][2]), (None, "les des", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs, langid.fit(docs)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (400, 401, 402)) and by[403].lang_pred != "und" and by[404].lang_pred == "de"
    assert np.mean([by[i].lang_pred == lang for i, _, lang in rows[:300] if by[i].held_out]) > 0.97
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(docs.limit(0))).collect()} == {"und"}
    # A text that switches is labelled word by word.
    model = langid.fit(docs)
    names, scores = model.predict(pa.array(["the and that with shall under which das und nicht"]))
    assert names == ["en"] and scores[0] < 0.95
