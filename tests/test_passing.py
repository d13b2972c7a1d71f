"""Search, filter and cut in one operator: equal to cutting the filtered rows of the k nearest, whatever the guesses."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomescope.config import DEFAULT
from tomescope.operators import filters
from tomescope.operators import passing as P
from tomescope.operators.knn import round_half_away
from tomescope.plans import recommend as R

from conftest import SF_SMALL

N, K, KEEP = 900, 200, 20
ERAS = ["Any era", "Pre-1900", "20th century", "Contemporary", None]


@pytest.fixture(scope="module")
def tables(spark):
    """Vectors of which many are equal, and filters that pass from none to all of the items."""
    r = np.random.default_rng(11)
    x = r.normal(size=(N, 6)).astype(np.float32)
    x[::9] = x[0]
    x[5] = 0
    q = r.normal(size=(40, 6)).astype(np.float32)
    books = [(i, None if i % 13 == 0 else int(1850 + r.integers(170)), None if i % 17 == 0 else int(r.integers(900)), None if i % 19 == 0 else float(r.integers(20, 50)) / 10) for i in range(N)]
    asked = [(i, ERAS[i % 5], None if i % 7 == 0 else int(r.integers(1, 30) ** 2), None if i % 11 == 0 else i % 3 == 0) for i in range(len(q))]
    vec = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(None, [1.0] * 6)], "Id long, vec array<float>").repartition(3)
    qvec = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(q)] + [(None, [1.0] * 6)], "query_id long, qvec array<float>")
    meta = spark.createDataFrame(books, "Id long, PublishYear int, Pages int, Rating double")
    settings = spark.createDataFrame(asked, "query_id long, era string, max_pages int, acclaimed boolean")
    scores = round_half_away(q.astype(np.float64) @ x.astype(np.float64).T)
    nearest = [(n, i, float(scores[n, i])) for n in range(len(q)) for i in sorted(range(N), key=lambda i, n=n: (-scores[n, i], i))]
    return vec, qvec, meta, settings, nearest


def wanted(spark, tables, k):
    _, _, meta, settings, nearest = tables
    hits = spark.createDataFrame([h for j, h in enumerate(nearest) if j % N < k], "query_id long, Id long, retrieval_score double")
    from tomescope.operators import rank

    found = rank.top_per_query(filters.filter_candidates(hits, settings, meta), "retrieval_score", KEEP, "cut_rank")
    return sorted((r.query_id, r.cut_rank, r.Id, r.retrieval_score) for r in found.collect())


@pytest.mark.parametrize("k,rounds", [(K, (3.5, 8.0, None)), (K, (-1.0, None)), (K, (None,)), (K, (0.5, -4.0, 2.0, None)), (2 * N, (3.5, None))])
def test_equals_filtering_the_nearest(spark, tables, monkeypatch, k, rounds):
    monkeypatch.setattr(P, "DEVIATIONS", rounds)
    monkeypatch.setattr(P, "BLOCK", 16)
    monkeypatch.setattr(P, "AT_ONCE", 64)
    monkeypatch.setattr(P, "SHARE", 2)
    vec, qvec, meta, settings, _ = tables
    corpus = vec.join(filters.item_values(meta), "Id", "left")
    queries = qvec.join(settings.select("query_id", *filters.query_bounds(DEFAULT)), "query_id", "left")
    got = P.passing_topk(queries, corpus, k, KEEP, DEFAULT, 6).collect()
    assert sorted((r["query_id"], r["rank"], r["Id"], r["score"]) for r in got) == wanted(spark, tables, k)


def test_bounds_are_the_predicate(spark):
    odd = [None, float("nan"), 3.0, 4.0, 2.9]
    rows = [(e, p, a, y, n, r) for e in [*ERAS, "x"] for p in (None, 300) for a in (None, True, False) for y in (None, 1899, 1900, 2000, 2001) for n in (None, 300, 800, 801) for r in odd]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "Id long, era string, max_pages int, acclaimed boolean, PublishYear int, Pages int, Rating double")
    inside = (F.col("year") >= F.col("year_from")) & (F.col("year") <= F.col("year_to")) & (F.col("pages") <= F.col("most_pages")) & (F.col("rating") >= F.col("least_rating"))
    both = df.select("Id", *filters.query_bounds(DEFAULT)).join(filters.item_values(df), "Id")
    was = df.select("Id", filters.metadata_predicate(DEFAULT).alias("was"))
    assert both.select("Id", inside.alias("now")).join(was, "Id").where("was != now").isEmpty()


def test_a_task_sends_few_of_the_nearest(spark, tables, monkeypatch):
    """The k nearest are not rows: what is sent is a share of them, and the corpus is sent once, not once for each group of queries."""
    monkeypatch.setattr(P, "SHARE", 2)
    vec, qvec, meta, settings, _ = tables
    corpus = P.named(vec, "Id").join(filters.item_values(meta.withColumns({"PublishYear": F.lit(1950), "Pages": F.lit(1), "Rating": F.lit(5.0)})), "Id")
    queries = P.named(qvec, "query_id").select("query_id", "qvec", *[F.lit(float(v)).alias(c) for c, v in zip(P.TESTS, (0, 3000, 800, 3), strict=True)])
    blocks = P._guessed(P._query_blocks(queries), corpus, N, 400, KEEP, 3.5)
    keys = P.spread(spark, 2)
    sent = P._held(P._met(blocks.withColumn("_part", P._each(keys)), P._corpus_blocks(corpus, keys)), 2, lambda items, r: items.sent(P.Queries(r), 400, 6), P.SENT_SCHEMA)
    rows = sent.collect()
    per = np.concatenate([sum(P.unpacked(r["_per"], "<i8") for r in rows if r["_block"] == b) for b in {r["_block"] for r in rows}])
    assert len(per) == 40 and max(per) < 200


def test_hits_of_a_search_are_no_rows(spark, monkeypatch):
    """The cut of the funnel does not go through a table of the retrieved hits; ids that repeat take the way by the joins, with the same rows."""
    from tomescope.sources import tables as T

    p = DEFAULT.with_(score_decimals=6, k_retrieve=90, k_filtered=12)
    idx, prep = R.build_index(T.books(spark, SF_SMALL), p), R.prepare_queries(T.queries(spark, SF_SMALL))
    joined = R.filtered_candidates(prep, R.retrieve(prep, idx, p), idx, p)
    columns = ["query_id", "cut_rank", "Id", "retrieval_score", "Authors", "Rating", "lambda"]
    want = sorted(map(tuple, joined.select(columns).collect()), key=str)
    monkeypatch.setattr(R, "retrieve", None)
    assert sorted(map(tuple, R.detailed(R.cut_candidates(prep, idx, p), prep, idx, p).select(columns).collect()), key=str) == want and len(want) > 100


def test_repeated_ids_count_twice_as_before(spark):
    from tomescope.sources import tables as T

    p = DEFAULT.with_(score_decimals=6, k_retrieve=90, k_filtered=12)
    books = T.books(spark, SF_SMALL)
    idx, prep = R.build_index(books.unionByName(books.where("Id < 9")), p), R.prepare_queries(T.queries(spark, SF_SMALL))
    want = R.filtered_candidates(prep, R.retrieve(prep, idx, p), idx, p)
    rows = lambda df: sorted(map(tuple, df.select("query_id", "cut_rank", "Id", "retrieval_score").collect()))
    assert rows(R.cut_candidates(prep, idx, p)) == rows(want)


@pytest.mark.parametrize("k", [1, 10, 150, 2 * N])
def test_nearest_equals_brute_force(tables, k):
    vec, qvec, _, _, by_score = tables
    got = sorted((r["query_id"], r["rank"], r["Id"], r["score"]) for r in P.nearest(qvec, vec, k, DEFAULT, 6).collect())
    assert got == [(n, j % N + 1, i, s) for j, (n, i, s) in enumerate(by_score) if j % N < k]


def test_each_part_has_a_partition_of_its_own(spark):
    for parts in (1, 5, 12):
        keys = spark.createDataFrame([(k,) for k in P.spread(spark, parts)], "_part int")
        assert keys.repartition(parts, "_part").select(F.spark_partition_id().alias("p")).distinct().count() == parts
