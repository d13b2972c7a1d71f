"""The streaming entry answers the same as the batch plan for the same queries."""

from tomescope.config import DEFAULT
from tomescope.plans import recommend as R
from tomescope.session import new_table_path
from tomescope.sources import tables
from tomescope.streaming import serve_queries

from conftest import SF_SMALL


def test_stream_equals_batch(spark):
    p = DEFAULT.with_(k_retrieve=100, k_filtered=50, k_rerank=20, k_dedup=10)
    idx = R.build_index(tables.books(spark, SF_SMALL), p)
    covers = tables.covers(spark, SF_SMALL)
    q = tables.queries(spark, SF_SMALL, p)
    src = new_table_path(spark, "query_inbox")
    q.repartition(3).write.parquet(src)
    out = new_table_path(spark, "served")
    serve_queries(spark, src, idx, covers, out, params=p, max_files_per_trigger=1).awaitTermination(600)
    streamed = spark.read.parquet(out).drop("batch_id")
    batch = R.recommend(q, idx, covers, p).cards
    assert spark.read.parquet(out + "_rejected").count() > 0
    cols = ["query_id", "rank", "Id", "mmr_score"]
    assert sorted(map(tuple, streamed.select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))
