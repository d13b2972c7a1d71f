"""Term counts, vectors and cells made in one scan of the texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomescope.config import DEFAULT
from tomescope.operators import encode

TEXTS = [(1, "One two, TWO three."), (2, "..."), (3, None), (4, "two five"), (4, "five five six"), (None, "null one"), (None, "null two"), (7, "")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(TEXTS, "Id long, text string").repartition(3)


def test_counts_are_those_of_the_exploded_tokens(docs):
    packed = encode.packed_terms(docs, "Id", "text")
    got = sorted(((r["_id"], r["token"], r["tf"]) for r in encode.counts_of(packed, "Id").collect() if r["token"]), key=str)
    assert got == sorted(((r["_id"], r["token"], r["tf"]) for r in encode.term_counts(docs, "Id", "text").collect()), key=str)
    lengths = {r["Id"]: r["dl"] for r in packed.collect()}
    assert lengths == {1: 4, 2: 0, 3: 0, 4: 5, None: 4, 7: 0}


@pytest.mark.parametrize("weighted", [True, False])
def test_scan_and_join_give_the_same_cells(spark, docs, weighted, monkeypatch):
    stats = encode.fit_token_stats(docs, "Id", "text") if weighted else None
    as_set = lambda df: sorted(((r["Id"], r["bucket"], round(r["value"], 9)) for r in df.collect()), key=str)
    scanned = as_set(encode.encode_sparse(docs, "Id", "text", 16, stats))
    monkeypatch.setattr(encode, "DEFAULT", DEFAULT.with_(max_broadcast_bytes=0))
    assert scanned == as_set(encode.encode_sparse(docs, "Id", "text", 16, stats)) and len(scanned) > 8


def test_vectors_of_a_scan_are_those_of_the_join(docs):
    stats = encode.fit_token_stats(docs, "Id", "text")
    packed = encode.packed_terms(docs, "Id", "text")
    scan = {r["Id"]: r["vec"] for r in encode.packed_vectors(packed, "Id", 16, stats).collect()}
    join = {r["Id"]: r["vec"] for r in encode.packed_vectors(packed, "Id", 16, stats, params=DEFAULT.with_(max_broadcast_bytes=0)).collect()}
    assert scan.keys() == join.keys() == {1, 2, 3, 4, None, 7}
    for i, v in scan.items():
        assert np.allclose(v, join[i], atol=1e-7)
    assert not any(scan[3])


def test_cells_need_no_exchange_of_tokens(spark):
    """Texts with distinct ids: nothing of them is shuffled, with or without weights."""
    docs = spark.range(40).select(F.col("id").alias("Id"), F.concat_ws(" ", F.lit("word"), F.col("id")).alias("text"))
    for stats in (None, encode.fit_token_stats(docs, "Id", "text")):
        plan = encode.encode_sparse(docs, "Id", "text", 16, stats)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
