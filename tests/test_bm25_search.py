"""BM25 search over inverted lists: equal to scoring every document, with few postings opened."""

import math
from collections import Counter

import numpy as np
import pytest
from conftest import SF_SMALL
from oracle_harness import compare

import __spark_entry__ as E
from tomescope.config import DEFAULT
from tomescope.operators import rank
from tomescope.plans import recommend as R
from tomescope.sources import tables


def index_of(spark, texts):
    rows = [(i, t, c, len(w)) for i, w in enumerate(texts) for t, c in Counter(w).items()]
    terms = spark.createDataFrame([r[:3] for r in rows], "Id long, token string, tf long")
    df = terms.groupBy("token").count().withColumnRenamed("count", "df")
    return rank.Bm25Index(rank.documents_of(terms), df, len(texts), sum(map(len, texts)) / len(texts))


def brute(texts, query, k, k1=1.2, b=0.75):
    n, avg = len(texts), sum(map(len, texts)) / len(texts)
    df = Counter(t for w in texts for t in set(w))
    out = []
    for i, w in enumerate(texts):
        tf = Counter(w)
        if not set(query) & set(w):
            continue
        s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(w) / avg)) for t in set(query) if tf[t])
        out.append((-round(s, 6), i))
    return [i for _, i in sorted(out)[:k]]


@pytest.fixture(scope="module")
def corpus():
    """A word in every document, some common ones, and rare ones."""
    r = np.random.default_rng(3)
    words = [f"w{int(x)}" for x in r.zipf(1.3, 30_000) % 4000]
    texts, at = [], 0
    for n in r.integers(5, 30, 1200):
        texts.append(["the", *words[at : at + n]])
        at += n
    return texts


def test_search_equals_scoring_all_documents(spark, corpus, monkeypatch):
    monkeypatch.setattr(rank, "POSTINGS", 16)
    monkeypatch.setattr(rank, "SALT_ROWS", 100)
    idx = index_of(spark, corpus)
    postings = rank.build_postings(idx)
    assert postings.where("token = 'the'").select("salt").distinct().count() == 12  # the stop word is dealt over tasks
    queries = {1: "the w1 w2", 2: "the w977 w5", 3: "the", 4: "nothing here", 5: "w3 w9 w27 w81", 6: "the w1", 7: "w3999 w3998"}
    q = spark.createDataFrame(list(queries.items()), "query_id long, query_text string")
    p = DEFAULT.with_(score_decimals=6)
    got = {}
    for r in rank.bm25_search(q, idx, 5, p, postings=postings).collect():
        got.setdefault(r["query_id"], {})[r["bm25_rank"]] = r["Id"]
    for i, text in queries.items():
        assert [got[i][n] for n in sorted(got.get(i, {}))] == brute(corpus, text.split(), 5), text
    plan = rank.bm25_plan(q, idx, postings, 5, p)
    counts = {r["query_id"]: (r["opened"], r["listed"]) for r in rank.postings_opened(plan, postings).collect()}
    assert all(a <= b for a, b in counts.values())
    assert counts[2][0] <= counts[2][1] - 1200  # rare words beside the stop word: the stop word's list stays closed
    assert plan.wanted.where("query_id = 2 and token = 'the'").isEmpty()
    assert sum(a for a, _ in counts.values()) < 0.5 * sum(b for _, b in counts.values())
    txt = plan.wanted._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in txt and "NestedLoop" not in txt and "[token#" in txt


def test_search_opens_few_postings_of_the_catalogue(spark):
    idx = R.build_index(tables.books(spark, SF_SMALL), DEFAULT)
    prep = R.prepare_queries(tables.queries(spark, SF_SMALL)).where("valid").select("query_id", "query_text")
    postings = rank.build_postings(idx.bm25)
    rows = rank.postings_opened(rank.bm25_plan(prep, idx.bm25, postings, 20), postings).collect()
    assert rows and all(r["opened"] <= r["listed"] for r in rows)


def test_registered_search_is_unchanged(spark):
    r = compare(spark, "bm25_scores", E.queries()["bm25_scores"], E.oracle_sql()["bm25_scores"], SF_SMALL)
    assert r["cols_match"] and r["spark_rows"] == r["oracle_rows"] and r["values_match"], r
