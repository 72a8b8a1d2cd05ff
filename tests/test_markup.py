"""Laid-out HTML against texts written by hand."""

import time

import pytest
from pyspark.sql import functions as F

from worklore.functions.markup import page_text

LONG = "word " * 40
CASES = {
    "pre": ("a<pre>\n  x\n    y &lt;b\n</pre>b", "a\n  x\n    y <b\nb"),
    "pre keeps inner tags' text": ("<pre>x <b>y</b><br>  z</pre>", "x y\n  z"),
    "pre never closed": ("<p>a</p><pre>x\n y", "a\n\nx\n y"),
    "list": ("<ul><li>one<li>two<ul><li>in</ul></ul>end", " * one\n * two\n    * in\n\nend"),
    "numbered": ("<ol start=3><li>a</li><li>b</ol>", " 3. a\n 4. b"),
    "wrapped item": (f"<ul><li>{LONG}</ul>", " * " + ("word " * 25).strip() + "\n   " + ("word " * 15).strip()),
    "table": (
        "<table><tr><th>name</th><th>n</th></tr><tr><td>long name here</td><td>1</td></tr><tr><td>x<td>22</table>after",
        "NAME             N\nlong name here   1\nx                22\n\nafter",
    ),
    "spanning cell": ("<table><tr><td colspan=2>wide one here<tr><td>a<td>b</table>", "wide one here\na   b"),
    "long cell": (f"<table><tr><td>{'word ' * 13}</td><td>x</td></tr></table>", ("word " * 12).strip() + "   x\nword"),
    "table in table": ("<table><tr><td><table><tr><td>in</td><td>ner</td></tr></table></td><td>out</td></tr></table>", "in   ner   out"),
    "headings": ("<h1>A</h1><h2>Top</h2><p>t</p><h4>low</h4>x", "# A\n\n\n## Top\n\nt\n\nLOW\n\nx"),
    "breaks": ("x<br>y<br><br>z<br></p>", "x\ny\n\nz"),
    "quote": ("<blockquote>q1<p>q2</blockquote>z", "> q1\n> \n> q2\n\nz"),
    "rule": ("a<hr>b", "a\n\n" + "-" * 40 + "\n\nb"),
    "link, image, script": ("<p>a <a href='u'>link</a> <img src=x>b<script>no()</script><style>p{}</style><!-- c --></p>", "a link b"),
    "entities": ("x&nbsp;y &amp;lt; &eacute; &unknown; &", "x y &lt; é &unknown; &"),
    "wrap": (f"<p>{LONG}</p>", ("word " * 26).strip() + "\n" + ("word " * 14).strip()),
    "long word": ("<p>" + "y" * 200 + " z</p>", "y" * 200 + "\nz"),
    "stray ends": ("</li></ul></td></table></pre></blockquote>x", "x"),
    "no tag": ("a < b", "a < b"),
    "cut tag": ("a <p title='x", "a"),
    "nothing": ("", ""),
    "tags alone": ("<p> </p><ul></ul><table></table>", ""),
}


@pytest.fixture(scope="module")
def laid_out(spark):
    rows = [(name, html) for name, (html, _) in CASES.items()] + [("null", None)]
    df = spark.createDataFrame(rows, "name string, html string")
    return {r.name: r.text for r in df.select("name", page_text(F.col("html")).alias("text")).collect()}


@pytest.mark.parametrize("name", CASES)
def test_case(laid_out, name):
    assert laid_out[name] == CASES[name][1]


def test_null(laid_out):
    assert laid_out["null"] is None


def test_mail_headings(spark):
    df = spark.createDataFrame([("<h1>Top</h1>x",)], "html string")
    assert df.select(page_text(F.col("html"), marks=False)).head()[0] == "TOP\n\nx"


@pytest.mark.parametrize("piece", ["<p>a b</p>", "<a", "<", "<!--", "<script>", "<td>", "<li>x", "&", "<pre>", "<table><tr><td>x</table>"])
def test_time_grows_with_the_page(piece):
    from worklore.functions.markup import _laid_out

    start = time.time()
    _laid_out(piece * 100_000, 130, True)
    assert time.time() - start < 20
