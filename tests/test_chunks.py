"""Several vectors a text: chunk texts, chunk vectors and the search that counts a book by its best chunk."""

import numpy as np
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as E
from tomescope.config import DEFAULT
from tomescope.operators import encode, knn
from tomescope.operators.rank import holders
from tomescope.plans import recommend as R
from tomescope.plans.catalog import CHUNKS
from tomescope.sources import tables

from conftest import SF_ORACLE, SF_SMALL


def test_chunk_texts_keep_the_whole_text(spark):
    texts = {1: "  «One two, three. four\nfive;", 2: "", 3: None, 4: "--- ...", 5: "a " * 6, 6: "ab" * 50_000, 7: "... " * 50_000 + "x", 8: "é1 漢字 ß́x y"}
    got = {}
    for r in encode.chunk_texts(spark.createDataFrame(list(texts.items()), "Id long, text string"), "Id", "text", 3).collect():
        got.setdefault(r["Id"], {})[r["chunk"]] = r["text"]
    parts = {i: [c[k] for k in range(len(c))] for i, c in got.items()}
    assert parts[1] == ["  «One two, three. ", "four\nfive;"] and parts[5] == ["a a a "] * 2
    assert parts[2] == parts[3] == parts[4] == [""]
    assert all("".join(parts[i]) == texts[i] for i in (1, 5, 6, 7, 8))


def test_chunks_of_no_token_are_refused(spark):
    with pytest.raises(ValueError):
        encode.chunk_texts(spark.createDataFrame([(1, "a")], "Id long, text string"), "Id", "text", 0)


def test_statistics_are_those_of_whole_texts(spark):
    docs = spark.createDataFrame([(1, "a b c a b d"), (2, "a a a a"), (3, None)], "Id long, text string")
    got = encode.chunk_stats(docs, "text", 2)
    assert got.n_docs == 3 and {r.token: r.df for r in got.df.collect()} == {"a": 2, "b": 1, "c": 1, "d": 1}


def test_vectors_of_one_scan_equal_those_of_the_token_join(spark):
    """Texts of no, few and many chunks, spread over Arrow batches of three rows; also beyond the broadcast budget."""
    texts = [None, "", "one two", "a b c d e f g h i", "x " * 41, "--", "ΑΣ.Β ΑΣ. b ΣΑΣ"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "Id long, text string").repartition(2)
    stats = encode.chunk_stats(docs, "text", 4)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for make, key, shuffled in (
            (encode.chunk_vectors, ["Id", "chunk"], encode.dense_chunks(encode.chunk_counts(docs, "Id", "text", 4), "Id", 16, stats)),
            (encode.text_vectors, ["Id"], encode.encode_dense(docs.where(~F.coalesce(F.col("text"), F.lit("")).contains("Σ")), "Id", "text", 16, stats)),
        ):
            want = {tuple(r[k] for k in key): r.vec for r in shuffled.collect()}
            for params in (DEFAULT, DEFAULT.with_(max_broadcast_bytes=0)):
                got = make(docs, "Id", "text", 16, stats, 4, params)
                assert ("PythonMapInArrow" in got._jdf.queryExecution().toString() or "MapInArrow" in got._jdf.queryExecution().toString()) == (params is DEFAULT)
                rows = {tuple(r[k] for k in key): r.vec for r in got.collect()}
                assert len(rows) == got.count() and rows.keys() >= want.keys() and len({k[0] for k in rows}) == len(texts)
                assert all(np.allclose(rows[k], v, atol=1e-6) for k, v in want.items())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert encode.chunk_vectors(docs.where("false"), "Id", "text", 16, encode.chunk_stats(docs.where("false"), "text")).count() == 0


def test_foreign_statistics_are_refused(spark):
    docs = spark.createDataFrame([(1, "a b c")], "Id long, text string")
    with pytest.raises(Exception, match="without statistics"):
        encode.chunk_vectors(docs, "Id", "text", 16, encode.chunk_stats(docs.where("false"), "text")).collect()


@pytest.mark.parametrize("one_pass", [True, False])
def test_best_chunk_counts_before_the_cut(spark, one_pass, monkeypatch):
    """Against brute force: ids with up to 400 vectors, ties over blocks, and many chunks of one id above all others."""
    monkeypatch.setattr(knn, "CORPUS_BLOCK", 64)
    monkeypatch.setattr(knn, "ONE_PASS_BYTES", 2**40 if one_pass else 0)
    rng = np.random.default_rng(5)
    ids = np.concatenate([np.full(400, 7), rng.integers(0, 120, 800)])
    vecs = rng.integers(-3, 4, (len(ids), 6)).astype(float)
    vecs[:300] += 4
    asked = rng.integers(-3, 4, (9, 6)).astype(float)
    corpus = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vecs)], "Id long, vec array<float>").repartition(5)
    queries = spark.createDataFrame([(q, v.tolist()) for q, v in enumerate(asked)], "query_id long, qvec array<float>")
    got = {(r.query_id, r["rank"]): (r.Id, r.score) for r in knn.knn_join(queries, corpus, 10, repeated=True).collect()}
    want = {}
    for q, v in enumerate(asked):
        best = {}
        for i, s in zip(ids.tolist(), (vecs @ v).tolist()):
            best[i] = max(s, best.get(i, -np.inf))
        for rank, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:10], 1):
            want[q, rank] = (i, s)
    assert got == want


def test_holders_need_every_token_in_a_row(spark):
    asked = spark.createDataFrame([(1, "One two three, four five six"), (2, "two"), (3, None), (4, "art two three four five")], "query_id long, text string")
    docs = spark.createDataFrame([(1, "x one TWO three four five six y"), (2, "one two three four five seven"), (3, "smart two three four five"), (4, None)], "Id long, text string")
    assert [tuple(r) for r in holders(asked, docs, "query_id", "Id").collect()] == [(1, 1)]


def test_chunk_index_serves_recommend_and_models(spark):
    books = tables.books(spark, SF_SMALL)
    idx = R.build_index(books, CHUNKS)
    assert idx.stitched.count() > books.count() == idx.stitched.select("Id").distinct().count() == idx.described.count()
    out = R.recommend(tables.queries(spark, SF_SMALL).limit(30), idx, tables.covers(spark, SF_SMALL), CHUNKS)
    assert 0 < out.picks.count() == out.picks.select("query_id", "Id").distinct().count()
    model = encode.encode_chunks(R.stitched_texts(books), "Id", "text", encode.model_encoder(encode.LetterModel))
    assert model.select("Id", "chunk").exceptAll(idx.stitched.select("Id", "chunk")).count() == 0 and model.where(F.size("vec") != 8).count() == 0
    with pytest.raises(ValueError):
        R.build_index(books, CHUNKS.with_(search="ivfpq"))


def test_chunks_find_more_passages_than_whole_texts(spark):
    rows = E.queries()["chunk_retrieval"](spark, SF_ORACLE).collect()
    found = {c: [sum((r[c] or 99) <= k for r in rows) for k in (1, 10)] for c in ("whole_rank", "chunk_rank")}
    print(len(rows), found)
    assert len(rows) > 10 and found["chunk_rank"][0] >= found["whole_rank"][0] and found["chunk_rank"][1] == len(rows)
