"""Registered queries against their DuckDB SQL on the driver's fixture tables."""

import pytest

import os, sys
sys.path.insert(0, os.path.dirname(__file__))
import __spark_entry__ as E
from oracle_harness import compare
from tomescope.plans.catalog import registry

from conftest import SF_SMALL

KEYS = [
    "scan_books", "csv_zstd_roundtrip", "strip_html", "dedup_books", "expand_queries", "hooks", "search_links",
    "cover_join", "encode_hashed_idf", "knn_exact_top10", "knn_books_top10", "candidates_cut300", "bm25_scores",
    "minmax_blend", "author_dedup", "mmr_top5", "result_cards", "ivf_search", "pq_encode", "pq_search",
    "recall_at_10", "index_report", "kmeans_train", "pq_train", "train_sample", "rejected_queries", "no_match_queries", "stars",
    "result_cards_small", "result_cards_ivfpq", "rejected_results", "encode_model", "model_recommend",
    "iqr_filter", "expand_by_table", "recall_interval",
    "encode_chunks", "knn_chunks_top10", "chunk_retrieval",
]


def test_every_query_has_sql():
    q, s = E.queries(), E.oracle_sql()
    assert set(registry()) <= set(s) <= set(q)


@pytest.mark.parametrize("name", KEYS)
def test_query_matches_oracle(spark, name):
    r = compare(spark, name, E.queries()[name], E.oracle_sql()[name], SF_SMALL)
    assert r["cols_match"] and r["spark_rows"] == r["oracle_rows"] and r["values_match"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "rank" in df.columns


@pytest.mark.parametrize("name", ["rejected_queries", "no_match_queries"])
def test_planted_branches_have_rows(spark, name):
    assert E.queries()[name](spark, SF_SMALL).count() > 0


def test_planted_rows_reach_every_branch(spark):
    q = E.queries()
    assert {r.was_expanded for r in q["expand_queries"](spark, SF_SMALL).collect()} == {True, False}
    titles = [r.title for r in q["escaped_titles"](spark, SF_SMALL).collect()]
    assert any("&quot;" in t and "&lt;" in t for t in titles)
    assert any("&lt;i&gt;" in r.hook for r in q["hooks"](spark, SF_SMALL).collect())
    assert all("(Vol" not in (r.clean_title or "") for r in q["clean_titles"](spark, SF_SMALL).collect())
    covers = [r.cover_url for r in q["cover_join"](spark, SF_SMALL).collect()]
    assert sum("covers.example.org" in c for c in covers) > 20 and len(set(covers)) > 20
