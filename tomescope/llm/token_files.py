"""Operator 7: token-ID output as Parquet list columns.

Documents are dealt by ranges of ``doc_id`` and sorted, so file order and row order are
ascending ``doc_id``. Each row holds ``ids`` as a list column. ``ids`` is dictionary
encoded (a vocabulary fits one dictionary page), the ascending columns ``doc_id``,
``start_in_part`` are delta encoded, row groups and pages have set sizes, and the page
index (on by default in the writer) lets a reader fetch a document range or the metadata
columns alone.

Cases: null or empty text gives just the end id; a null ``doc_id`` sorts first; repeated
rows are kept as they are, in any order among themselves; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomescope.llm.common import crc32_u32, id_text, table
from tomescope.llm.tokenize import encoder
from tomescope.session import new_table_path

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
WRITE_OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#start_in_part": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}
SCHEMA = "part int, doc_id long, start_in_part long, n_tokens long, ids array<int>"


def _encode_sorted(name: str, end_id: int):
    def run(batches):
        part, seen = TaskContext.get().partitionId(), 0
        enc = encoder(name)
        for b in batches:
            ids = enc.encode(b.column("text"))
            end = np.array([end_id], dtype=np.int32)
            ids = [np.concatenate((x, end)) for x in ids]
            sizes = np.array([len(x) for x in ids], dtype=np.int64)
            ends = np.cumsum(sizes)
            flat = np.concatenate(ids) if ids else end[:0]
            offsets = np.concatenate(([0], ends)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(ids), part, dtype=np.int32)),
                    b.column("doc_id"),
                    pa.array(seen + ends - sizes),
                    pa.array(sizes),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ],
                names=["part", "doc_id", "start_in_part", "n_tokens", "ids"],
            )
            seen += int(sizes.sum())

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, options: dict | None = None) -> str:
    """Encode every text, append ``end_id`` and write the files under ``path``. Returns ``path``."""
    rows = id_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows.mapInArrow(_encode_sorted(tokenizer, end_id), SCHEMA).write.options(**(options or WRITE_OPTIONS)).parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows with ``low <= doc_id <= high`` and the named columns; both are pushed to the files,
    where row-group statistics and the page index skip what is not asked for."""
    df = spark.read.parquet(path)
    if low is not None:
        df = df.where(F.col("doc_id") >= low)
    if high is not None:
        df = df.where(F.col("doc_id") <= high)
    return df.select(*columns) if columns else df


def _digest(batches):
    for b in batches:
        col = b.column("ids")
        flat, at = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
        crc = [crc32_u32(flat[at[i] : at[i + 1]]) for i in range(len(col))]
        sizes = np.diff(at).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [b.column("part"), b.column("doc_id"), b.column("start_in_part"), pa.array(sizes), pa.array(crc, pa.int64())],
            names=["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32"],
        )


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` = tokens of all earlier files (a sum per file, one row a file) + tokens before it in its file."""
    df = read_tokens(spark, path)
    totals = df.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rows = df.select("part", "doc_id", "start_in_part", "ids").mapInArrow(
        _digest, "part int, doc_id long, start_in_part long, n_tokens long, ids_crc32 long"
    )
    return rows.join(before, "part").select(
        "doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32"
    )


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_tokens(table(spark, sf_dir, "documents"), new_table_path(spark, "tokens"))
    return read_back(spark, path)
