"""Operator 5: exact top-k search by distributed histogram selection.

Vectors are quantised to integers and written as blocks (one row = up to some thousand
vectors). Query blocks meet corpus blocks, a block product gives all scores of the two, and
only histogram counts leave the task. Three rounds narrow, per query, the interval that holds
the k-th best score: bins of 4096, then of 64 inside the found bin, then single values. A
block needs to report no bin below its own k-th best, so a round moves about k counts per
query and block. With the exact k-th value known, a last pass keeps the scores above it and,
of those equal to it, each block's smallest ids; one window breaks ties by the smaller id.

Nothing grows on the driver, queries included: both sides are tables of blocks, read from the
shared folder by every round.

Cases: a vector that is null, holds a null or non-finite component, or whose ``id`` is null takes
no part. Components are 64-bit; a component or a score beyond 62 bits stops the job with an error, no row is left
out for its size. Vectors of different length never meet. Rows that repeat an
id are candidates of their own for other ids; a query never meets rows of its own id. Fewer than k
candidates: all of them. Empty tables give no rows. The input's other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomescope.llm.common import table
from tomescope.session import cut_lineage, ship_package

K = 5
SCALE = 256
WIDTHS = (4096, 64, 1)
QUERY_ROWS, CORPUS_ROWS = 512, 4096
BLOCK_SCHEMA = "block string, dim int, ids binary, vals binary"


LIMIT = 2.0**62


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """``(id, q)`` with ``q = scale * x`` as doubles, without the rows that take no part."""
    ship_package(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite).select("id", F.transform("v", lambda x: x * scale).alias("q"))


def _blocks(most: int):
    """Rows of one scan task to blocks of at most ``most`` vectors of one length."""

    def run(batches):
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(dim):
            nonlocal made
            parts = held.pop(dim)
            made += 1
            ids, vals = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{task}-{made}"]), pa.array([dim], pa.int32()), pa.array([ids.tobytes()]), pa.array([vals.astype("<i8").tobytes()])],
                names=["block", "dim", "ids", "vals"],
            )

        for b in batches:
            col = b.column("q")
            ids, flat, at = b.column("id").to_numpy(), col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
            flat = np.floor(flat)
            if flat.size and np.abs(flat).max() >= LIMIT:
                raise ValueError("a component beyond 62 bits after scaling")
            flat = flat.astype(np.int64)
            sizes = np.diff(at)
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                vals = flat[(at[rows][:, None] + np.arange(dim))] if dim else np.zeros((len(rows), 0), dtype=np.int64)
                for lo in range(0, len(rows), most):
                    held.setdefault(dim, []).append((ids[rows[lo : lo + most]].astype("<i8"), vals[lo : lo + most].reshape(-1)))
                    if sum(len(p[0]) for p in held[dim]) >= most:
                        yield out(dim)
        for dim in list(held):
            yield out(dim)

    return run


def _scores(q_ids, q_vals, c_ids, c_vals, dim):
    """Integer scores of two blocks; a query's own id is marked in the second array."""
    a = np.frombuffer(q_vals, "<i8").reshape(len(q_ids), dim)
    b = np.frombuffer(c_vals, "<i8").reshape(len(c_ids), dim)
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(dim, 1)
    rough = a.astype(np.float64) @ b.astype(np.float64).T
    if top < 2**52:
        s = rough.astype(np.int64)
    elif rough.size and np.abs(rough).max() >= LIMIT:
        raise ValueError("a score beyond 62 bits")
    else:
        s = a @ b.T  # exact: sums that leave 64 bits on the way come back
    return s, q_ids[:, None] == c_ids[None, :]


def _floor_of(s, own, k):
    """Per query, the block's own k-th best score (its least, if it has fewer than k)."""
    masked = np.where(own, np.iinfo(np.int64).min, s)
    if s.shape[1] > k:
        masked = np.partition(masked, s.shape[1] - k, axis=1)[:, s.shape[1] - k :]
    lows = masked.min(axis=1)
    return np.where(lows == np.iinfo(np.int64).min, np.where(own, np.iinfo(np.int64).max, s).min(axis=1), lows)


def _histogram(k: int, width: int):
    """Counts (block, row, bin) of the scores in the open interval of each query, bins of ``width``."""

    def run(batches):
        names = ["block", "row", "bin", "n"]
        for b in batches:
            for r in b.to_pylist():
                if r["dim"] != r["c_dim"]:
                    continue
                q_ids, c_ids = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["c_ids"], "<i8")
                s, own = _scores(q_ids, r["vals"], c_ids, r["c_vals"], r["dim"])
                keep = ~own & (s // width >= (_floor_of(s, own, k) // width)[:, None])
                if r["low"] is not None:
                    low, high = np.frombuffer(r["low"], "<i8"), np.frombuffer(r["high"], "<i8")
                    keep &= (s >= low[:, None]) & (s < high[:, None])
                row, col = np.nonzero(keep)
                if not len(row):
                    continue
                bins = s[row, col] // width
                order = np.lexsort((bins, row))
                row, bins = row[order], bins[order]
                first = np.flatnonzero(np.concatenate(([True], (np.diff(row) != 0) | (np.diff(bins) != 0))))
                n = np.diff(np.concatenate((first, [len(row)])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["block"]] * len(first)), pa.array(row[first].astype(np.int32)), pa.array(bins[first]), pa.array(n.astype(np.int64))],
                    names=names,
                )

    return run


def _winners(batches):
    """Scores above the k-th value, and of those equal to it the block's smallest ids."""
    for b in batches:
        for r in b.to_pylist():
            if r["dim"] != r["c_dim"]:
                continue
            q_ids, c_ids = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["c_ids"], "<i8")
            s, own = _scores(q_ids, r["vals"], c_ids, r["c_vals"], r["dim"])
            kth, ties = np.frombuffer(r["low"], "<i8"), np.frombuffer(r["need"], "<i8")
            row, col = np.nonzero(~own & (s >= kth[:, None]))
            order = np.lexsort((c_ids[col], s[row, col] != kth[row], row))  # ties first, by id
            row, col = row[order], col[order]
            score, tie = s[row, col], s[row, col] == kth[row]
            starts = np.searchsorted(row, np.arange(len(q_ids)))
            keep = ~tie | (np.arange(len(row)) - starts[row] < ties[row])
            if keep.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[row[keep]]), pa.array(c_ids[col[keep]]), pa.array(score[keep])],
                    names=["query_id", "vec_id", "score"],
                )


def _narrow(counts: DataFrame, state: DataFrame | None, k: int, width: int) -> DataFrame:
    """Per query the bin that holds the k-th best score, and how many lie above it."""
    by = Window.partitionBy("block", "row").orderBy(F.desc("bin"))
    sums = counts.groupBy("block", "row", "bin").agg(F.sum("n").alias("n"))
    if state is not None:
        sums = sums.join(state.select("block", "row", "above"), ["block", "row"])
    else:
        sums = sums.withColumn("above", F.lit(0).cast("long"))
    cum = sums.withColumn("upto", F.col("above") + F.sum("n").over(by)).withColumn("last", F.lead("bin").over(by).isNull())
    hit = cum.where(((F.col("upto") >= k) | F.col("last")) & (F.col("upto") - F.col("n") < k))
    return hit.select(
        "block", "row", (F.col("bin") * width).alias("low"), ((F.col("bin") + 1) * width).alias("high"),
        (F.col("upto") - F.col("n")).alias("above"),
    )


def _attach(q: DataFrame, state: DataFrame, k: int) -> DataFrame:
    """Query blocks with their queries' intervals as binary columns (one entry per vector of the block)."""
    cols = state.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("row", "low", "high", "above"))).alias("s"))

    def run(batches):
        for b in batches:
            out = {n: [] for n in ("block", "dim", "ids", "vals", "low", "high", "need")}
            for r in b.to_pylist():
                n = len(r["ids"]) // 8
                low, high = np.full(n, np.iinfo(np.int64).max, dtype="<i8"), np.full(n, np.iinfo(np.int64).min, dtype="<i8")
                need = np.zeros(n, dtype="<i8")
                for x in r["s"]:
                    low[x["row"]], high[x["row"]], need[x["row"]] = x["low"], x["high"], k - x["above"]
                for name in ("block", "dim", "ids", "vals"):
                    out[name].append(r[name])
                for name, v in (("low", low), ("high", high), ("need", need)):
                    out[name].append(v.tobytes())
            kinds = [pa.string(), pa.int32()] + [pa.binary()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return q.join(cols, "block").mapInArrow(run, BLOCK_SCHEMA + ", low binary, high binary, need binary")


def top_k(queries: DataFrame, corpus: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows of ``corpus`` for every row of ``queries``."""
    q = cut_lineage(quantised(queries, id_col, vec_col, scale).mapInArrow(_blocks(QUERY_ROWS), BLOCK_SCHEMA), "topk-queries")
    c = cut_lineage(quantised(corpus, id_col, vec_col, scale).mapInArrow(_blocks(CORPUS_ROWS), BLOCK_SCHEMA), "topk-corpus")
    c = c.select(F.col("dim").alias("c_dim"), F.col("ids").alias("c_ids"), F.col("vals").alias("c_vals"))
    state, now = None, q.withColumns({n: F.lit(None).cast("binary") for n in ("low", "high", "need")})
    for width in WIDTHS:
        counts = now.crossJoin(c).mapInArrow(_histogram(k, width), "block string, row int, bin long, n long")
        state = cut_lineage(_narrow(counts, state, k, width), f"topk-bins-{width}")
        now = cut_lineage(_attach(q, state, k), "topk-limits")  # few files again, so few pairs of partitions meet
    found = now.crossJoin(c).mapInArrow(_winners, "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0 AND len(q.e) = len(c.e)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""
