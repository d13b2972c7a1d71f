"""Written tables: vectors, index parts, CSV and Parquet (A3-A10).

Everything is an ordinary Parquet table under a folder the caller names (by default a
fresh folder under ``spark.checkpoint.dir``). Vectors carry their ``Id``; row order is
never a key (the reference's positional id map becomes a column).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomescope.session import new_table_path

BOOKS_SCHEMA = T.StructType(
    [
        T.StructField("Id", T.LongType(), False),
        T.StructField("Name", T.StringType(), True),
        T.StructField("Authors", T.StringType(), True),
        T.StructField("Pages", T.IntegerType(), True),
        T.StructField("PublishYear", T.IntegerType(), True),
        T.StructField("Rating", T.DoubleType(), True),
        T.StructField("Description", T.StringType(), True),
    ]
)


def write_parquet(df: DataFrame, path: str, compression: str = "zstd", partition_by: list[str] | None = None) -> str:
    w = df.write.mode("overwrite").option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", "true").option("escape", '"').option("quote", '"').option(
        "emptyValue", '""'
    ).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType = BOOKS_SCHEMA) -> DataFrame:
    """Raw CSV source (A9): explicit schema, quoted multi-line fields. Fields over several lines keep Spark from
    splitting a file, so a raw file is one task: deliver large sources as many files."""
    return (
        spark.read.schema(schema)
        .option("header", "true")
        .option("multiLine", "true")
        .option("escape", '"')
        .option("quote", '"')
        .option("mode", "FAILFAST")
        .csv(path)
    )


def write_vectors(vectors: DataFrame, space: str, base: str | None = None, id_col: str = "Id", vec_col: str = "vec") -> str:
    """Store all vectors exactly (A4, A5): ``embeddings(Id, space, vec)``, partitioned by space."""
    spark = vectors.sparkSession
    base = base or new_table_path(spark, "embeddings")
    out = vectors.select(F.col(id_col).alias("Id"), F.lit(space).alias("space"), F.col(vec_col).cast("array<float>").alias("vec"))
    out.write.mode("append").option("compression", "zstd").partitionBy("space").parquet(base)
    return base


def read_vectors(spark: SparkSession, base: str, space: str) -> DataFrame:
    """Load stored vectors (A3, A6, A7): partition pruning on ``space``."""
    return spark.read.parquet(base).where(F.col("space") == space).select("Id", "vec")
