"""Online recommend as a stream: new query files -> five cards per query.

Searches arrive as files in a folder
(Parquet rows of the ``queries`` schema) and each micro-batch runs the same
``recommend`` plan against a built index. ``foreachBatch`` writes every batch to its
own ``batch_id=`` folder in overwrite mode, so a replayed batch after a failure rewrites
the same output (idempotent); progress lives in the checkpoint location.
No state is kept between batches: every search is independent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tomescope.config import DEFAULT, Params
from tomescope.session import new_table_path, written_tables

QUERY_SCHEMA = "query_id long, query_text string, era string, max_pages int, acclaimed boolean, lambda double"


def serve_queries(
    spark: SparkSession,
    source_dir: str,
    index,
    covers: DataFrame,
    out_dir: str,
    checkpoint_location: str | None = None,
    params: Params = DEFAULT,
    available_now: bool = True,
    max_files_per_trigger: int = 16,
) -> StreamingQuery:
    from tomescope.plans.recommend import recommend

    stream = spark.readStream.schema(QUERY_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir)

    def handle(batch: DataFrame, batch_id: int) -> None:
        with written_tables(batch.sparkSession):
            res = recommend(batch, index, covers, params)
            for name, part in (("", res.cards), ("_no_match", res.no_match), ("_rejected", res.rejected)):
                part.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out_dir}{name}/batch_id={batch_id}")

    w = stream.writeStream.foreachBatch(handle).option(
        "checkpointLocation", checkpoint_location or new_table_path(spark, "serve_checkpoint")
    )
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()
