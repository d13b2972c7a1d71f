"""BM25 of given pairs without repeating texts per pair; the reranking queries search once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomescope.config import DEFAULT
from tomescope.operators import encode, rank

DOCS = [(1, "one two three two"), (2, "two four"), (3, "..."), (4, "five five six one"), (5, "seven"), (6, "One, TWO? three!")]
QUERIES = [(10, "two three one"), (11, "five"), (12, "zzz"), (13, "one one two five"), (14, "")]
PAIRS = [(q, d) for q, _ in QUERIES for d, _ in DOCS] + [(10, 1), (99, 1), (10, 99), (None, 1), (10, None)]


@pytest.mark.parametrize("held", [1 << 20, 32])
def test_pairs_are_scored_as_by_the_join_on_the_token(spark, held, monkeypatch):
    """One and several groups of queries; pairs that repeat, miss a side or hold null."""
    monkeypatch.setattr(rank, "QUERY_BYTES", held)
    docs = spark.createDataFrame(DOCS, "Id long, text string")
    terms = encode.packed_terms(docs, "Id", "text").where(F.col("dl") > 0)
    index = rank.Bm25Index(terms, encode.frequencies(terms), len(DOCS), 2.5)
    queries, pairs = spark.createDataFrame(QUERIES, "query_id long, query_text string"), spark.createDataFrame(PAIRS, "query_id long, Id long")
    by_token = rank.pair_sums_by_token(pairs, rank.query_term_weights(queries, index, inner=True), index)
    want = {(r["query_id"], r["Id"]): r["bm25"] for r in by_token.collect()}
    monkeypatch.setattr(rank, "pair_sums_by_token", None)  # the pairs are not multiplied by their query's tokens
    got = rank.bm25_pairs(pairs, queries, index).collect()
    assert sorted(((r["query_id"], r["Id"]) for r in got), key=str) == sorted(PAIRS, key=str)
    assert len(want) > 8 and all(np.isclose(r["bm25"], want.get((r["query_id"], r["Id"]), 0.0), rtol=1e-12) for r in got)


@pytest.mark.parametrize("name", ["minmax_blend", "author_dedup", "mmr_top5"])
def test_reranking_queries_search_once(spark, name, monkeypatch):
    from conftest import SF_SMALL

    from tomescope.plans import catalog

    written = []
    cut = catalog.cut_lineage
    monkeypatch.setattr(catalog, "cut_lineage", lambda df, n="stage": written.append(n) or cut(df, n))
    txt = getattr(catalog, name)(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert written.count("candidates_cut") == 1 and "c_vals" not in txt


def test_pairs_keep_their_columns_without_a_join_of_scores(spark, monkeypatch):
    """The pairs of a document meet it with their columns: no table of scores is joined to them, and no exchange is by query and document."""
    docs = spark.createDataFrame(DOCS, "Id long, text string")
    terms = encode.packed_terms(docs, "Id", "text").where(F.col("dl") > 0)
    index = rank.Bm25Index(terms, encode.frequencies(terms), len(DOCS), 2.5)
    queries, pairs = spark.createDataFrame(QUERIES, "query_id long, query_text string"), spark.createDataFrame(PAIRS, "query_id long, Id long")
    pairs = pairs.selectExpr("query_id", "Id", "if(Id = 2, null, concat('a', Id)) as Authors", "Id / 2.0D as `lambda`")
    monkeypatch.setattr(rank, "pair_sums", None)
    got = rank.bm25_pairs(pairs, queries, index)
    txt = got._jdf.queryExecution().executedPlan().toString()
    assert got.columns == [*pairs.columns, "bm25"] and "hashpartitioning(query_id" not in txt
    assert sorted(map(tuple, got.drop("bm25").collect()), key=str) == sorted(map(tuple, pairs.collect()), key=str)
    nobody = spark.createDataFrame([(10, "zzz"), (11, None)], "query_id long, query_text string")
    assert [r["bm25"] for r in rank.bm25_pairs(pairs, nobody, index).collect()] == [0.0] * len(PAIRS)
