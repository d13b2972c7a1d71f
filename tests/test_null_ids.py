"""Searches and items without an id take no part in a search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomescope.operators import ann
from tomescope.operators.knn import knn_join


@pytest.fixture
def tables(spark):
    x = np.random.default_rng(5).normal(size=(60, 8)).astype(np.float32)
    ids = [None if i % 10 == 3 else i for i in range(60)]
    rows = [(i, [float(v) for v in r]) for i, r in zip(ids, x, strict=True)]
    corpus = spark.createDataFrame(rows, "Id long, vec array<float>").repartition(3)
    return corpus, corpus.select(F.col("Id").alias("query_id"), F.col("vec").alias("qvec")), x, [i for i in ids if i is not None]


def best(x, ids, k):
    score = x.astype(np.float64) @ x.astype(np.float64).T
    return {q: sorted(ids, key=lambda j: (-score[q, j], j))[:k] for q in ids}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["Id"])
    return out


@pytest.mark.parametrize("k", [4, 120])
def test_exact_search_leaves_null_ids_out(tables, k):
    corpus, queries, x, ids = tables
    assert found(knn_join(queries, corpus, k)) == best(x, ids, k)


def test_list_search_leaves_null_ids_out(spark, tables):
    corpus, queries, x, ids = tables
    lists = corpus.withColumn("cluster", F.lit(0))
    cents = spark.createDataFrame([(0, [1.0] * 8)], "cluster int, centroid array<double>")
    assert found(ann.ivf_search(queries, lists, cents, 1, 4)) == best(x, ids, 4)
