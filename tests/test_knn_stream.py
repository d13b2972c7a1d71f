"""Corpus blocks pass the query blocks a task holds: no join of blocks, at most k rows per query and corpus group."""

import numpy as np
import pytest

from tomescope.operators import ann
from tomescope.operators import knn as K
from tomescope.session import cut_lineage

N = 700


def vectors(spark):
    """Small whole numbers, so that many scores are equal."""
    x = np.random.default_rng(3).integers(-1, 2, size=(N, 4))
    df = cut_lineage(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x.tolist())], "Id long, vec array<float>").repartition(3))
    return df, x


def brute(x, q, k):
    s = x @ x[q]
    return [(int(i), float(s[i])) for i in sorted((i for i in range(N) if i != q), key=lambda i: (-s[i], i))[:k]]


@pytest.mark.parametrize("k", [5, 150, 2000])
def test_equal_scores_and_many_results(spark, monkeypatch, k):
    monkeypatch.setattr(K, "CORPUS_BLOCK", 64)
    df, x = vectors(spark)
    q = df.where("Id % 50 = 0").selectExpr("Id as query_id", "vec as qvec")
    got = {}
    for r in K.knn_join(q, df, k, exclude_self=True).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["Id"], r["score"])
    assert sorted(got) == list(range(0, N, 50))
    for i, ranks in got.items():
        assert [ranks[j] for j in range(1, len(ranks) + 1)] == brute(x, i, k)


def test_candidates_are_at_most_k_per_group_without_a_join(spark, monkeypatch):
    monkeypatch.setattr(K, "CORPUS_BLOCK", 64)
    monkeypatch.setattr(K, "HELD_BYTES", 1)
    monkeypatch.setattr(K, "MAX_QUERY_BLOCK", 1)
    df, _ = vectors(spark)
    q = df.where("Id < 20").selectExpr("Id as query_id", "vec as qvec")
    found = K.knn_candidates(q, df, 120)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 20 * 120  # more query groups than cores: one corpus group


def test_a_repeated_query_id_is_one_query(spark):
    df, x = vectors(spark)
    q = df.where("Id in (0, 50)").selectExpr("Id as query_id", "vec as qvec")
    got = K.knn_join(q.unionByName(q.where("query_id = 50")).coalesce(1), df, 6, exclude_self=True).collect()
    per = [sorted((r["rank"], r["Id"]) for r in got if r["query_id"] == i) for i in (0, 50)]
    assert [i for _, i in per[0]] == [i for i, _ in brute(x, 0, 6)]
    assert [i for _, i in per[1]] == [i for i, _ in brute(x, 50, 3) for _ in range(2)]


def test_small_query_tasks_do_not_multiply_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(K, "CORPUS_BLOCK", 64)
    monkeypatch.setattr(K, "ONE_PASS_BYTES", 0)
    df, x = vectors(spark)
    q = cut_lineage(df.where("Id % 10 = 0").selectExpr("Id as query_id", "vec as qvec").repartition(20))
    r = K.skipped_pairs(q, df, 5).first()
    assert r["query_blocks"] == (N // 10) * r["block_pairs"]  # all queries are one block
    got = {}
    for r in K.knn_join(q, df, 5, exclude_self=True).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["Id"], r["score"])
    assert all([ranks[j] for j in range(1, 6)] == brute(x, i, 5) for i, ranks in got.items()) and len(got) == N // 10


def test_blocks_meet_without_a_broadcast(spark):
    df, _ = vectors(spark)
    q = df.where("Id % 50 = 0").selectExpr("Id as query_id", "vec as qvec")
    txt = K.knn_candidates(q, df, 5)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in txt and "Broadcast" not in txt


def test_a_list_gives_at_most_k_per_query(spark, monkeypatch):
    monkeypatch.setattr(ann, "CORPUS_BLOCK", 8)
    df, _ = vectors(spark)
    lists = cut_lineage(df.selectExpr("Id", "vec", "cast(Id % 3 as int) as cluster"))
    cents = spark.createDataFrame([(i, [float(i == j) for j in range(4)]) for i in range(3)], "cluster int, centroid array<double>")
    q = df.where("Id % 50 = 0").selectExpr("Id as query_id", "vec as qvec")
    assert ann.ivf_candidates(q, lists, cents, 3, 4).count() == N // 50 * 3 * 4
