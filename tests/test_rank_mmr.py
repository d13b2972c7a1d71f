"""Rerank, dedup and MMR invariants on literal rows."""

import numpy as np
from pyspark.sql import functions as F

from tomescope.config import DEFAULT
from tomescope.operators import rank
from tomescope.operators.diversify import mmr, mmr_batch


def one(rel, vecs, picks, lam):
    rel, vecs = np.asarray(rel, dtype=float)[None], np.asarray(vecs, dtype=float)[None]
    at, value = mmr_batch(rel, vecs, np.ones(rel.shape, dtype=bool), np.array([lam]), picks, 6)
    return [int(x) for x in at[0] if x >= 0], [float(v) for v in value[0] if np.isfinite(v)]


def test_mmr_fixture_vectors():
    rel, vecs = [1.0, 0.9, 0.5], [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]]
    assert one(rel, vecs, 2, 1.0)[0] == [0, 1]
    picks, vals = one(rel, vecs, 2, 0.7)
    assert picks == [0, 2]
    assert vals[1] == 0.35


def test_mmr_lambda_one_is_relevance_order():
    rng = np.random.default_rng(1)
    assert one(np.sort(rng.random(30))[::-1], rng.normal(size=(30, 8)), 5, 1.0)[0] == [0, 1, 2, 3, 4]


def test_mmr_zero_vectors_and_small_groups():
    picks, vals = one([0.2], np.zeros((1, 4)), 5, 0.7)
    assert picks == [0] and not np.isnan(vals).any()


def test_mmr_batch_equals_one_query_at_a_time():
    """Padding and batching do not change a query's picks; checked against a direct greedy search."""
    rng = np.random.default_rng(4)
    sizes, lam = [1, 4, 9, 12], np.array([0.3, 0.5, 0.7, 0.9])
    rel, vecs, there = np.zeros((4, 12)), np.zeros((4, 12, 5)), np.zeros((4, 12), dtype=bool)
    for k, n in enumerate(sizes):
        rel[k, :n], vecs[k, :n], there[k, :n] = np.sort(rng.random(n))[::-1], rng.normal(size=(n, 5)), True
    at, _ = mmr_batch(rel, vecs, there, lam, 5, None)
    for k, n in enumerate(sizes):
        cos = lambda a, b, k=k: vecs[k, a] @ vecs[k, b] / np.linalg.norm(vecs[k, a]) / np.linalg.norm(vecs[k, b])
        want = [0]
        while len(want) < min(5, n):
            worth = {i: lam[k] * rel[k, i] - (1 - lam[k]) * max(cos(i, j) for j in want) for i in range(n) if i not in want}
            want.append(max(worth, key=worth.get))
        assert [x for x in at[k] if x >= 0] == want


def test_mmr_grouped(spark):
    rows = [(1, 10, 1.0, [1.0, 0.0]), (1, 11, 0.9, [1.0, 0.0]), (1, 12, 0.5, [0.0, 1.0]), (2, 20, 0.3, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "query_id long, Id long, cross_score double, dvec array<float>")
    out = {(r.query_id, r.mmr_rank): r.Id for r in mmr(df.withColumn("lambda", F.lit(0.7)), params=DEFAULT.with_(k_final=2)).collect()}
    assert out == {(1, 1): 10, (1, 2): 12, (2, 1): 20}


def test_minmax_constant_and_single(spark):
    df = spark.createDataFrame([(1, 1, 0.4, 4.0), (1, 2, 0.9, 4.0), (2, 3, 0.7, 3.5)], "query_id long, Id long, semantic double, Rating double")
    got = {r.Id: r.cross_score for r in df.select("Id", rank.blend("semantic", "Rating").alias("cross_score")).collect()}
    assert got == {1: 0.0, 2: 0.85, 3: 0.0}


def test_best_per_author_null_group(spark):
    df = spark.createDataFrame([(1, 1, None, 0.5), (1, 2, None, 0.7), (1, 3, "a", 0.1)], "query_id long, Id long, Authors string, s double")
    assert sorted(r.Id for r in rank.best_per_author(df, "s").collect()) == [2, 3]


def test_cuts_nest(spark):
    """Every cut of the funnel keeps a subset of the previous one."""
    rows = [(q, i, float((i * 7 + q) % 13), 3.0 + (i % 20) / 10, f"a{i % 6}") for q in range(3) for i in range(80)]
    df = spark.createDataFrame(rows, "query_id long, Id long, semantic double, Rating double, Authors string")
    p = DEFAULT.with_(k_rerank=20, k_dedup=4)
    out = rank.rerank(df, p)
    per_q = out.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("Authors").alias("a")).collect()
    assert all(r.n <= 4 and r.n == r.a for r in per_q)
