"""Physical plan checks: top-k plans as WindowGroupLimit, no Cartesian product,
filters and column pruning reach the Parquet scan."""

from pyspark.sql import functions as F

from tomescope.config import DEFAULT
from tomescope.operators import filters, rank
from tomescope.sources import tables
from tomescope.session import new_table_path

from conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_topk_uses_window_group_limit(spark):
    from tomescope.session import apply_session_conf

    apply_session_conf(spark)
    df = spark.range(100000).select((F.col("id") % 7).alias("query_id"), F.col("id").alias("Id"), ((F.col("id") * 7919) % 1000).cast("double").alias("s"))
    p = plan(rank.top_per_query(df, "s", 5000, "r"))
    assert "WindowGroupLimit" in p


def test_stored_books_scan_prunes_and_pushes(spark):
    path = new_table_path(spark, "books_plan")
    tables.books(spark, SF_SMALL).write.parquet(path)
    b = spark.read.parquet(path)
    q = filters.pushable_prefilter(b, DEFAULT).select("Id", "Pages")
    txt = q._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(Pages), IsNotNull(Rating), GreaterThanOrEqual(Rating,3.0)]" in txt
    assert "ReadSchema: struct<Id:bigint,Pages:int,Rating:double>" in txt


def test_scan_books_pushes_its_filters(spark):
    from tomescope.plans.catalog import scan_books

    txt = plan(scan_books(spark, SF_SMALL))
    assert "LessThanOrEqual(Pages,800)" in txt and "GreaterThanOrEqual(Rating,3.0)" in txt


def test_dedup_does_not_sort_texts(spark):
    from tomescope.operators.clean import dedup_books

    path = new_table_path(spark, "books_dedup")
    tables.books(spark, SF_SMALL).write.parquet(path)
    txt = plan(dedup_books(spark.read.parquet(path)).select("Id", "Name"))
    assert "Description" not in txt


def test_written_tables_are_removed(spark):
    import os

    from tomescope.session import cut_lineage, written_tables

    with written_tables(spark):
        df = cut_lineage(spark.range(5))
        where = df.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(where)
    assert not os.path.exists(where)


def test_searches_have_no_product_of_tables(spark):
    """The exact search itself, before anything is written away: blocks meet by an equi join."""
    from tomescope.operators import knn
    from tomescope.plans import ann_queries as AQ

    v = AQ._vectors(spark, SF_SMALL)
    for threshold in ("-1", "10MB"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            txt = plan(knn.knn_join(AQ._queries(v), v.select("Id", "vec"), 10))
            assert "CartesianProduct" not in txt and "NestedLoop" not in txt and "Join [_g#" in txt
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_recommend_plan_has_no_cartesian(spark):
    from tomescope.plans import recommend as R

    idx = R.build_index(tables.books(spark, SF_SMALL), DEFAULT)
    res = R.recommend(tables.queries(spark, SF_SMALL), idx, tables.covers(spark, SF_SMALL), DEFAULT.with_(k_retrieve=100, k_filtered=50, k_rerank=20, k_dedup=10))
    p = plan(res.cards)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    rows = res.cards.collect()
    by_q = {}
    for r in rows:
        by_q.setdefault(r.query_id, []).append(r)
    assert all(len(v) <= 5 and len({x.author for x in v}) == len(v) for v in by_q.values())
    assert all(sorted(x.rank for x in v) == list(range(1, len(v) + 1)) for v in by_q.values())
