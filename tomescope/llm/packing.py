"""Operator 8: packing by power-of-two decomposition.

Each document (its ids and one end id) is cut into pieces whose lengths are powers of two:
as many of ``max_len`` as fit, then the binary digits of the rest, longest first. A piece is
a sequence of its own, equal lengths share a bucket, no sequence holds two documents and
none needs padding. A training step draws its batch from one bucket.

One pass over the documents, no shuffle. ``sequence_id`` is unique: the bucket, the scan task
and the piece's number within both, packed into one long; it depends on how the scan is split,
not on the content. Cases: null or empty text is one piece holding the end id; null
``doc_id`` stays null; repeated rows are packed as often as they come; an empty table gives
no pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tomescope.llm.common import crc32_u32, id_text, table
from tomescope.llm.tokenize import encoder

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
MAX_LEN = 1024
ROWS_OUT = 2048
SCHEMA = "doc_id long, start long, length long, doc_tokens long, bucket int, sequence_id long, offset long, ids array<int>"


def piece_lengths(n: int, max_len: int = MAX_LEN) -> list[int]:
    """Lengths of the pieces of ``n`` tokens: ``max_len`` repeated, then the binary digits of the rest."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def _pack(name: str, end_id: int, max_len: int):
    def run(batches):
        task = TaskContext.get().partitionId()
        made = [0] * max_len.bit_length()
        enc = encoder(name)
        names = ["doc_id", "start", "length", "doc_tokens", "bucket", "sequence_id", "offset", "ids"]
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            flat: list[np.ndarray] = []

            def batch(cols=cols, flat=flat):
                offsets = np.concatenate(([0], np.cumsum(cols[2]))).astype(np.int32)
                arrays = [pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.int64())]
                arrays.append(pa.array(np.zeros(len(cols[0]), dtype=np.int64)))
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat))))
                return pa.RecordBatch.from_arrays(arrays, names=names)

            for doc, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text")), strict=True):
                ids = np.append(ids, np.int32(end_id))
                at = 0
                for n in piece_lengths(len(ids), max_len):
                    k = n.bit_length() - 1
                    for c, v in zip(cols, (doc, at, n, len(ids), k, k << 58 | task << 34 | made[k]), strict=True):
                        c.append(v)
                    flat.append(ids[at : at + n])
                    made[k] += 1
                    at += n
                if len(cols[0]) >= ROWS_OUT:
                    yield batch()
                    for c in cols:
                        c.clear()
                    flat.clear()
            if cols[0]:
                yield batch()

    return run


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, max_len: int = MAX_LEN) -> DataFrame:
    """One row per piece, with its ids. ``max_len`` must be a power of two below 2**32."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    return id_text(docs).mapInArrow(_pack(tokenizer, end_id, max_len), SCHEMA)


def _crc(batches):
    keep = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
    for b in batches:
        col = b.column("ids")
        flat, at = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
        crc = [crc32_u32(flat[at[i] : at[i + 1]]) for i in range(len(col))]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(crc, pa.int64())], names=[*keep, "ids_crc32"])


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum of their ids instead of the ids."""
    return pieces.mapInArrow(
        _crc, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long"
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))
