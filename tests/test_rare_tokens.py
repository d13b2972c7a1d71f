"""Token tables of vocabularies beyond the broadcast budget."""

import numpy as np
from pyspark.sql import functions as F

from tomescope.config import DEFAULT
from tomescope.operators import encode


def test_tokens_of_one_text_need_no_table(spark, monkeypatch):
    """A vocabulary above the budget whose tokens of several texts fit: still one scan, with the vectors of the whole table."""
    rows = [(i, f"all word{i} " + "pair " * (i % 2) + f"É{i}x " * (i % 3)) for i in range(40)] + [(50, None), (51, "..")]
    docs = spark.createDataFrame(rows, "Id long, text string").repartition(3)
    stats, chunked = encode.fit_token_stats(docs, "Id", "text"), encode.chunk_stats(docs, "text", 2)
    packed = encode.packed_terms(docs, "Id", "text")
    few = DEFAULT.with_(max_broadcast_bytes=10 * encode.TABLE_ROW_BYTES)
    made = {
        "packed": lambda p: encode.packed_vectors(packed, "Id", 16, stats, params=p),
        "whole": lambda p: encode.text_vectors(docs, "Id", "text", 16, chunked, 2, p),
        "chunks": lambda p: encode.chunk_vectors(docs, "Id", "text", 16, chunked, 2, p),
    }
    key = lambda r: (r["Id"], r.asDict().get("chunk"))
    whole = {n: {key(r): r["vec"] for r in f(DEFAULT).collect()} for n, f in made.items()}
    monkeypatch.setattr(encode, "dense_from_counts", None)  # the join on the token
    for n, f in made.items():
        got = {key(r): r["vec"] for r in f(few).collect()}
        assert got.keys() == whole[n].keys() and all(np.allclose(got[k], v, atol=1e-7) for k, v in whole[n].items())
