"""Sums of arrays per key in two levels, for models whose size is a parameter (centroids, codebooks).

Every task adds up its own rows and emits one row per key it saw, the whole array packed in it. The adders
are tasks by key range: each adds the arrays of its keys, so a step shuffles tasks x keys rows whatever the
length of the arrays, and no array is opened into a row per number. The driver receives one row per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomescope.session import ship_package

PACKED = "key long, n long, s binary"


def packed_rows(n: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    """The keys with a count, their counts, and their rows of ``s`` as bytes."""
    at = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array([s[i].tobytes() for i in at], pa.binary())], names=["key", "n", "s"])


def task_sums(keys: int, width: int, add: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], None], kind: str = "<f8"):
    """An Arrow function: ``add(batch, n, s)`` adds a batch to counts (keys) and sums (keys x width); a task emits them once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(keys, dtype=np.int64), np.zeros((keys, width), dtype=kind)
        for b in batches:
            if b.num_rows:
                add(b, n, s)
        yield packed_rows(n, s)

    return run


def added_by_key(parts: DataFrame, keys: int, width: int, kind: str = "<f8", adders: int = 0) -> DataFrame:
    """``key, n, s`` with one row per key from the tasks' rows; adder ``i`` holds the keys of one range at a time."""
    adders = adders or max(1, min(keys, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    span = -(-keys // adders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for k, n, raw in zip(b.column("key").to_pylist(), b.column("n").to_pylist(), b.column("s").to_pylist(), strict=True):
                mine = held.setdefault(k, [0, np.zeros(width, dtype=kind)])
                mine[0] += n
                mine[1] += np.frombuffer(raw, kind)
        for k in sorted(held):
            yield pa.RecordBatch.from_pydict({"key": [k], "n": [held[k][0]], "s": [held[k][1].tobytes()]})

    return parts.repartition(adders, F.floor(F.col("key") / span)).mapInArrow(run, PACKED)


def sums_by_key(df: DataFrame, keys: int, width: int, add, kind: str = "<f8") -> tuple[np.ndarray, np.ndarray]:
    """Counts (keys) and sums (keys x width) over all rows of ``df``."""
    ship_package(df.sparkSession)
    total = added_by_key(df.mapInArrow(task_sums(keys, width, add, kind), PACKED), keys, width, kind)
    n, s = np.zeros(keys, dtype=np.int64), np.zeros((keys, width), dtype=kind)
    for r in total.collect():
        n[r["key"]], s[r["key"]] = r["n"], np.frombuffer(r["s"], kind)
    return n, s
