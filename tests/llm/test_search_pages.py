"""Operators 1 and 5."""

import math

import numpy as np
import pytest
from conftest import SF_SMALL
from oracle_harness import compare
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomescope.llm import html_text, topk

VEC = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.StringType()), T.StructField("ids", T.LongType())])


def brute(rows, is_query, k):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if is_query(q):
            s = sorted(((-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in ok if c != q and len(a) == len(b)))[:k]
            out += [(q, n + 1, c, -v) for n, (v, c) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("big", [1.0, 3000.0])
def test_top_k_by_brute_force(spark, big, monkeypatch):
    monkeypatch.setattr(topk, "CORPUS_ROWS", 64)
    monkeypatch.setattr(topk, "QUERY_ROWS", 16)
    r = np.random.default_rng(1)
    rows = [(i, [float(x) * big for x in r.standard_normal(8)], "a", 1) for i in range(300)]
    same = [0.5 * big] * 8
    rows += [(1000 + i, same, "a", 1) for i in range(120)]  # a very common vector
    rows += [(2000, None, "a", 1), (2050, [1.0, None], "a", 1), (2100, [float("nan")] * 8, "a", 1), (2150, [float("inf")] * 8, "a", 1), (2200, [1.0, 2.0], "a", 1), (2250, [], "a", 1), (None, same, "a", 1)]
    df = spark.createDataFrame(rows, VEC)
    got = topk.top_k(df.where(F.col("vec_id") % 50 == 0), df, 5).collect()
    assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in got) == brute(rows, lambda q: q % 50 == 0, 5)


def test_top_k_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0], "a", 1), (1, [-1.0], "a", 1), (2, [2.0], "a", 1)], VEC)
    got = sorted(tuple(r) for r in topk.top_k(df.where("vec_id = 0"), df, 5).collect())
    assert got == [(0, 1, 2, 131072), (0, 2, 1, -65536)]
    assert topk.top_k(df.where("vec_id < 0"), df.where("vec_id < 0"), 5).count() == 0


def test_top_k_of_large_components(spark):
    rows = [(50, [1e5] * 64, "a", 1), (1, [-3e6] * 64, "a", 1), (2, [1.0] * 64, "a", 1), (3, [2e6] * 63 + [1e6], "a", 1), (4, [2e6] * 64, "a", 1)]
    df = spark.createDataFrame(rows, VEC)
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk.top_k(df.where("vec_id = 50"), df, 5).collect())
    assert got == brute(rows, lambda q: q == 50, 5) and len(got) == 4
    for big in (1e17, 1e30):  # no score, no component of 64 bits: an error, not a missing row
        with pytest.raises(Exception, match="62 bits"):
            topk.top_k(df.where("vec_id = 2"), df.union(spark.createDataFrame([(5, [big] * 64, "a", 1)], VEC)), 5).collect()


def test_top_k_sql(spark):
    r = compare(spark, "op5_topk", topk.op5_topk, topk.ORACLE, SF_SMALL)
    assert r["cols_match"] and r["values_match"], r


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{a:b}</style><script>var x="</p><article>no</article>";</script></head>
<body><header class="site-header"><p>Site name and motto</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>hidden</p> -->
<div class="cookie-notice">We use cookies, a long notice that goes on and on for more than the surge threshold of a page, really.</div>
<aside id="sidebar"><p>Related things in the sidebar that are rather long as well, so that length alone would keep them in.</p></aside>
%s<form><label>Name</label><input name="a>b"><textarea>text</textarea></form>
<section class="comments"><div>A reader says something very long that nobody would take for a part of the article, would they now?</div></section>
<footer>&copy; 2024 All rights reserved by somebody whose name is long enough to be over the threshold of the line blocks.</footer></body></html>"""
BODY = "<h1>Title &mdash; one</h1><p>First   paragraph with <b>bold</b> and <a href='x'>a link</a> &lt;tag&gt; &#233;&#x20AC;.</p>%s<p>Second\n paragraph.<br>Same block<p>Third, not closed<ul><li>One<li>Two</ul>"
TEXT = ["Title — one", "First paragraph with bold and a link <tag> é€.", "Second paragraph. Same block", "Third, not closed", "One", "Two"]


def test_article_pages():
    inner = '<div class="ad">Buy this very long advert text now, it is only here for you and for nobody else, ever.</div>'
    assert html_text.main_text(PAGE % f"<article>{BODY % inner}</article>") == "\n\n".join(TEXT)
    assert html_text.main_text(PAGE % f"<main><article>{BODY % ''}</article></main>") == "\n\n".join(TEXT)


def test_page_without_article_uses_line_blocks():
    long = ["This is a long paragraph of the text, number %d, with enough characters to make a surge." % k for k in range(6)]
    menu = "<div><a href=a>Menu one</a></div><div><a href=b>Menu two</a></div>"
    page = f"<html><body>{menu}<div>{'</div><div>'.join(long)}</div>{menu}<div>Tiny</div></body></html>"
    assert html_text.main_text(page) == "\n\n".join(long)


def test_broken_pages():
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>x") == ""
    assert html_text.main_text("<article><p>Cut off &am") == "Cut off &am"
    assert html_text.main_text("<article><p>Cut off <b") == "Cut off"
    assert html_text.main_text("<article><p>a < b and c > d</p></article>") == "a < b and c > d"
    assert html_text.main_text("<article><!-- open <p>x</p>") == ""
    assert html_text.main_text("plain text without any markup at all") == "plain text without any markup at all"


def test_extract_rows(spark):
    rows = [(1, "u", PAGE % f"<article>{BODY % ''}</article>", "t"), (2, None, None, "t"), (None, "v", "", "t"), (1, "u", "<article>" + "<p>x</p>" * 3000, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    want = [(i, u, html_text.main_text(h)) for i, u, h, _ in rows]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.page_id, r.url, r.text) for r in got), key=key) == sorted(want, key=key)
    assert all(r.n_chars == len(r.text) for r in got) and html_text.extract(df.limit(0)).count() == 0
