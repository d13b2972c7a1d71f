"""Connected components of an edge table, and grouping of sorted Arrow batches (helpers)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomescope.session import cut_lineage

SALTS = 16


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``id, component`` for every id with an edge; ``component`` is the smallest id it reaches.

    Alternating large-star and small-star steps on ``(a, b)`` long columns until only stars are left (about
    log n rounds). Minima are aggregated before the shuffle and joined back on a salted
    key, so an id with very many edges is spread over tasks. Every round is a written table."""
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = cut_lineage(e.distinct(), name)
    while not _stars(e):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _to_minimum(both).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        small = _to_minimum(large)
        moved = small.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut_lineage(moved.union(small.select("a", F.col("m").alias("b"))).distinct(), name)
    roots = e.select(F.col("b").alias("id")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots.select("id", F.col("id").alias("component")))


def _stars(e: DataFrame) -> bool:
    """If every id has one edge to a smaller one, or only edges from larger ones."""
    ends = e.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
    seen = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def _to_minimum(e: DataFrame) -> DataFrame:
    """Each edge with ``m``, the smallest ``b`` of its ``a``."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return e.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(least, ["a", "salt"]).select("a", "b", "m")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys of batches sorted by them; a run may go over several batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [np.asarray(b.column(k)) for k in keys]
        change = np.zeros(b.num_rows - 1, dtype=bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        first = tuple(c[0] for c in cols)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and not (lo == 0 and first == last):
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def roots_of(links: np.ndarray) -> np.ndarray:
    """Smallest member of each one's component, from a symmetric boolean matrix of links."""
    label = np.arange(len(links))
    while True:
        new = np.where(links, label[None, :], len(links)).min(axis=1)
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new
