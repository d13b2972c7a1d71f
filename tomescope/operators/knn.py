"""Nearest-neighbour joins.

Plan shape, for a query table Q and a corpus C of vectors:

1. Q is packed into blocks, the blocks into groups of a bounded number of vectors whatever the number of tasks that made them, and written to the
   shared folder. Nothing of Q or C goes through the driver.
2. C is packed once into blocks, each with a few balls that hold its vectors: centre, radius around it and largest norm. A task gathers some
   blocks' worth of rows and puts like vectors together first, so radii are small where the data has clusters.
3. Blocks meet by fragment and replicate: every query block has a query group g and goes to all corpus groups h, every corpus
   block has an h and goes to all g. They meet by a sort-merge join on (g, h), never by a broadcast; with more than ``FEW`` results per query by one sorted
   exchange. A task holds the queries of (g, h), lets the corpus blocks pass, one matrix product for each two, and keeps
   the k best of each query; the k-th best so far is the query's limit. It emits at most k per query.
4. Bounds pass: a fixed share of the corpus rows, by a hash of the id, is packed and scored first; the k-th best score of a query there
   is a lower limit of its k-th best score overall. The limits travel as one more column of the query blocks.
5. Main pass: q . x is at most q . centre + |q| radius and at most |q| times the largest norm of its ball, so the queries of a pair of blocks whose
   limit is above that for every ball are left out without loss, and the pair is skipped when none is left. What is scored emits only scores at or
   above the limit. With more than ``FEW`` results per query the limits of the passing blocks do alone, without a bounds pass.
6. Final cut: a window on the query id, ranked by (score desc, id asc), partial and final WindowGroupLimit. With one corpus group
   and no repeated query id the tasks rank themselves.

Ids are any 64-bit numbers and scores any finite doubles. ``decimals`` rounds scores before they are ranked (the SQL
comparison uses 6); by default they are not rounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomescope.config import DEFAULT, Params
from tomescope.session import cut_lineage, ship_package

SCORE_DECIMALS = 6
BOUND_SHARE = 8  # one corpus block in so many is scored in the bounds pass
ONE_PASS_BYTES = 32 * 1024 * 1024
CORPUS_BLOCK = 2048
MAX_QUERY_BLOCK = 512
GATHERED_BLOCKS = 16  # blocks of rows a task puts in order at a time
BALLS = 4  # balls of a corpus block
GROUP_BLOCKS = 8  # query blocks of one group
HELD_BYTES = 192 * 1024 * 1024  # results of the queries that a task holds
OUT_ROWS = 1 << 18  # results sent on at a time
FEW = 100  # results per query up to which limits are found in a pass of their own
QUERY_BLOCK = "qblock string, q_ids binary, q_vals binary"


def round_half_away(x, decimals: int | None = SCORE_DECIMALS):
    """SQL ``round``: scale, round half away from zero, unscale (NumPy's round is half-even). None: as it is."""
    if decimals is None:
        return np.asarray(x, dtype=np.float64)
    m = 10.0**decimals
    v = np.asarray(x, dtype=np.float64) * m
    return np.sign(v) * np.floor(np.abs(v) + 0.5) / m


def vectors_of(col: pa.Array) -> np.ndarray:
    """Arrow list column to a float64 matrix; all lists must have one length."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(col) and flat.size % len(col):
        raise ValueError("vectors of different length")
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def named(rows: DataFrame, id_col: str) -> DataFrame:
    """Rows with an id. A vector without one takes no part in a search: no result could name it, and no join finds it again."""
    return rows.where(F.col(id_col).isNotNull())


def pack_queries(queries: DataFrame, q_id: str, q_vec: str, rows: int, extra: Callable[[np.ndarray], dict[str, bytes]] | None = None, extra_schema: str = "") -> DataFrame:
    """Query blocks of at most ``rows`` vectors; ``extra`` adds binary columns made from a block's matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        for b in batches:
            ids, vals = b.column(q_id).to_numpy().astype("<i8"), vectors_of(b.column(q_vec))
            for lo in range(0, len(ids), rows):
                part = vals[lo : lo + rows]
                cols = {"qblock": f"{task}-{n}", "q_ids": ids[lo : lo + rows].tobytes(), "q_vals": part.astype("<f8").tobytes()}
                yield pa.RecordBatch.from_pydict({k: [v] for k, v in (cols | (extra(part) if extra else {})).items()})
                n += 1

    return named(queries, q_id).select(q_id, q_vec).mapInArrow(run, QUERY_BLOCK + extra_schema)


def grouped_queries(q_blocks: DataFrame, rows: int, spread: bool = False) -> DataFrame:
    """Written query blocks as blocks of some ``rows`` vectors: the scan of many small tasks makes no more of them, and the corpus is sent
    to no more groups, than that of one task. With ``spread`` there are as many as cores if queries suffice, so that one corpus group does."""
    vectors = (q_blocks.select(F.sum(F.length("q_ids"))).first()[0] or 0) // 8
    parts = max(1, -(-vectors // rows))
    if spread:
        parts = max(parts, min(max(4, q_blocks.sparkSession.sparkContext.defaultParallelism), -(-vectors // MAX_QUERY_BLOCK)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, vals = [], []
        for b in batches:
            ids += b.column("q_ids").to_pylist()
            vals += b.column("q_vals").to_pylist()
        if ids:
            yield pa.RecordBatch.from_pydict({"qblock": [str(TaskContext.get().partitionId())], "q_ids": [b"".join(ids)], "q_vals": [b"".join(vals)]})

    return cut_lineage(q_blocks.repartition(parts).mapInArrow(run, QUERY_BLOCK), "query_groups")


def _in_order(x: np.ndarray, block: int) -> np.ndarray:
    """An order of the rows whose runs of ``block`` rows are close together: halved along the line between two far rows, again and again."""
    if len(x) <= block:
        return np.arange(len(x))
    a = x[((x - x.mean(axis=0)) ** 2).sum(axis=1).argmax()]
    b = x[((x - a) ** 2).sum(axis=1).argmax()]
    order = np.argsort(x @ (b - a), kind="stable")
    half = -(-len(x) // block) // 2 * block
    left, right = order[:half], order[half:]
    return np.concatenate([left[_in_order(x[left], block)], right[_in_order(x[right], block)]])


def _balls(x: np.ndarray) -> np.ndarray:
    """The ball of each row: that of the nearest of up to ``BALLS`` rows, each the farthest from those before it, so that a ball does not span a gap."""
    ball, gap = np.zeros(len(x), dtype=np.int64), ((x - x[((x - x.mean(axis=0)) ** 2).sum(axis=1).argmax()]) ** 2).sum(axis=1)
    for b in range(1, BALLS):
        far = ((x - x[gap.argmax()]) ** 2).sum(axis=1)
        ball[far < gap] = b
        gap = np.minimum(gap, far)
    return ball


def pack_corpus(corpus: DataFrame, c_id: str, c_vec: str) -> DataFrame:
    """Corpus blocks: ``cblock, c_ids, c_vals``, and the up to ``BALLS`` balls that hold them: ``c_centre, c_radius, c_norm``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, held = TaskContext.get().partitionId(), 0, []

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal made
            ids, vals = np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])
            order = _in_order(vals, CORPUS_BLOCK)
            for lo in range(0, len(order), CORPUS_BLOCK):
                at = order[lo : lo + CORPUS_BLOCK]
                x = vals[at].astype("<f4").astype(np.float64)
                ball = _balls(x)
                runs = [x[ball == b] for b in np.unique(ball)]
                centres = [r.mean(axis=0) for r in runs]
                radii = [np.sqrt(((r - c) ** 2).sum(axis=1).max()) for r, c in zip(runs, centres, strict=True)]
                cols = {
                    "cblock": f"{task}-{made}", "c_ids": ids[at].tobytes(), "c_vals": x.astype("<f4").tobytes(), "c_centre": np.array(centres, dtype="<f8").tobytes(),
                    "c_radius": np.array(radii, dtype="<f8").tobytes(), "c_norm": np.array([np.sqrt((r * r).sum(axis=1).max()) for r in runs], dtype="<f8").tobytes(),
                }
                yield pa.RecordBatch.from_pydict({k: [v] for k, v in cols.items()})
                made += 1

        for b in batches:
            if not b.num_rows:
                continue
            held.append((b.column(c_id).to_numpy().astype("<i8"), vectors_of(b.column(c_vec))))
            if sum(len(i) for i, _ in held) >= GATHERED_BLOCKS * CORPUS_BLOCK:
                yield from out()
                held = []
        if held:
            yield from out()

    schema = "cblock string, c_ids binary, c_vals binary, c_centre binary, c_radius binary, c_norm binary"
    return named(corpus, c_id).select(c_id, F.col(c_vec).cast("array<float>").alias(c_vec)).mapInArrow(run, schema)


def within_reach(q: np.ndarray, r: dict, low: np.ndarray, decimals: int | None) -> np.ndarray:
    """Rows of ``q`` that may have a score at or above their limit in the corpus block of ``r``. The slack covers rounding."""
    norms, radius, norm = np.sqrt((q * q).sum(axis=1))[:, None], np.frombuffer(r["c_radius"], "<f8"), np.frombuffer(r["c_norm"], "<f8")
    most = np.minimum(q @ np.frombuffer(r["c_centre"], "<f8").reshape(len(radius), -1).T + norms * radius, norms * norm)
    slack = 1e-9 * norms * norm + (0.0 if decimals is None else 10.0**-decimals)
    return np.flatnonzero((most + slack >= low[:, None]).any(axis=1))


def placed(q_blocks: DataFrame, c_blocks: DataFrame, q_groups: int, k: int) -> tuple[DataFrame, DataFrame, int]:
    """Query and corpus blocks by (query group ``_g``, corpus group ``_h``), and the number of corpus groups. Query blocks and results go as
    often as there are corpus groups, so there are only enough to keep the cores busy, and with many results a query no more than that."""
    spark = q_blocks.sparkSession
    parts, cores = int(spark.conf.get("spark.sql.shuffle.partitions")), max(4, spark.sparkContext.defaultParallelism)
    c_groups = max(1, min(parts, 3 * cores if k <= FEW else cores) // q_groups)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    group = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    q = q_blocks.withColumn("_g", F.pmod(F.substring_index("qblock", "-", 1).cast("int"), F.lit(q_groups))).withColumn("_h", every(c_groups))
    c = c_blocks.withColumn("_h", group("cblock", c_groups)).withColumn("_g", every(q_groups))
    return q, c, c_groups


def meet(q_blocks: DataFrame, c_blocks: DataFrame, q_groups: int, k: int) -> DataFrame:
    """Every pair of blocks once, by a sort-merge join on (query group, corpus group): the corpus blocks of a group one after the other."""
    q, c, _ = placed(q_blocks, c_blocks, q_groups, k)
    return c.join(q.hint("merge"), ["_g", "_h"])


def streamed(q_blocks: DataFrame, c_blocks: DataFrame, q_groups: int, k: int) -> tuple[DataFrame, int]:
    """Query and corpus blocks as one table of rows by (query group, corpus group), a group's query blocks first; the number of corpus groups."""
    q, c, c_groups = placed(q_blocks, c_blocks, q_groups, k)
    both = q.withColumn("_kind", F.lit(0)).unionByName(c.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    parts = int(q_blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(min(4 * parts, q_groups * c_groups), "_g", "_h").sortWithinPartitions("_g", "_h", "_kind"), c_groups


def best_of_block(scores: np.ndarray, q_ids: np.ndarray, c_ids: np.ndarray, allowed: np.ndarray, k: int):
    """Rows ``(query id, item id, score)`` of the allowed pairs, at most ``k`` per query by (score desc, id asc)."""
    row, col = np.nonzero(allowed)
    if len(row):
        per = np.bincount(row, minlength=len(q_ids))
        if per.max() > k:
            order = np.lexsort((c_ids[col], -scores[row, col], row))
            row, col = row[order], col[order]
            first = np.cumsum(per) - per
            keep = np.arange(len(row)) - first[row] < k
            row, col = row[keep], col[keep]
    return q_ids[row], c_ids[col], scores[row, col]


def best_of_items(scores: np.ndarray, c_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score matrix and ids with one column per id: the best of the columns that share it."""
    order = np.argsort(c_ids, kind="stable")
    ids, first = np.unique(c_ids[order], return_index=True)
    return np.maximum.reduceat(scores[:, order], first, axis=1), ids


def scan_pairs(
    q_blocks: DataFrame, c_blocks: DataFrame, k: int, q_id: str, c_id: str,
    score: Callable[[dict, int | None], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], exclude_self: bool, decimals: int | None,
    repeated: bool = False, single: bool = False,
) -> DataFrame:
    """Candidates ``(q_id, c_id, score)`` of all pairs of blocks; ``score(row, decimals)`` yields (query rows, item
    rows, score matrix) of a pair of blocks. A ``q_low`` column holds the queries' lower limits. With ``repeated`` an id
    may have several vectors and counts by its best one: within a block here, over all blocks by ``best_per_id``.

    A task holds the query blocks of a group and lets the corpus blocks pass, so it emits at most ``k`` per query, whatever the corpus. With ``single``
    (no query id repeats) and one corpus group that is the result, with its ``rank``."""

    q_groups = q_blocks.count()
    few = k <= FEW
    rows, c_groups = (meet(q_blocks, c_blocks, q_groups, k), 0) if few else streamed(q_blocks, c_blocks, q_groups, k)
    q_names, c_names = q_blocks.columns, c_blocks.columns
    whole = c_groups == 1 and not repeated and single

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, seen = None, [], set()

        def ended() -> Iterator[pa.RecordBatch]:
            for h in held:
                yield from h.batches(q_id, c_id, whole)

        for b in batches:
            for i in range(b.num_rows):
                of = lambda names, b=b, i=i: {n: b.column(n)[i].as_py() for n in names}
                key = of(["_g", "_h"])
                if key != group:
                    yield from ended()
                    group, held, seen = key, [], set()
                if few:
                    name = b.column("qblock")[i].as_py()
                    if name not in seen:
                        seen.add(name)
                        held.extend(Held.parts_of(of(q_names), k, exclude_self))
                elif b.column("_kind")[i].as_py() == 0:
                    held.extend(Held.parts_of(of(q_names), k, exclude_self))
                    continue
                block = of(c_names)
                c_ids = np.frombuffer(block["c_ids"], "<i8")
                for h in held:
                    if few and h.name != name:
                        continue
                    for at, cols, s in score(h.row | block, decimals):
                        if not repeated:
                            h.add(at, c_ids[cols], s, decimals)
                        elif len(cols):
                            s, items = best_of_items(s, c_ids[cols])
                            s = round_half_away(s, decimals)
                            q, c, v = best_of_block(s, h.ids[at], items, h.allowed(at, items, s), k)
                            if len(q):
                                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(c), pa.array(v)], names=[q_id, c_id, "score"])
        yield from ended()

    return rows.mapInArrow(run, f"`{q_id}` long, `{c_id}` long, score double" + (", rank int" if whole else ""))


class Held:
    """A query block in a task, with the best ``k`` items of each of its queries among the corpus blocks that have passed."""

    @classmethod
    def parts_of(cls, row: dict, k: int, exclude_self: bool) -> list[Held]:
        """A query block in parts of at most ``MAX_QUERY_BLOCK`` vectors, so that a score matrix stays small."""
        n = len(row["q_ids"]) // 8
        cut = lambda v, lo, hi: v[len(v) // n * lo : len(v) // n * hi] if isinstance(v, bytes) else v
        return [cls({c: cut(v, lo, min(lo + MAX_QUERY_BLOCK, n)) for c, v in row.items()}, k, exclude_self) for lo in range(0, n, MAX_QUERY_BLOCK)]

    def __init__(self, row: dict, k: int, exclude_self: bool):
        self.row, self.k, self.exclude_self = row, k, exclude_self
        self.name = row.get("qblock")
        self.ids = np.frombuffer(row["q_ids"], "<i8")
        n = len(self.ids)
        self.low, self.low_id = np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max)
        if row.get("q_low") is not None:
            self.low, self.low_id = np.frombuffer(row["q_low"], "<f8").copy(), np.frombuffer(row["q_low_id"], "<i8").copy()
        self.best, self.items = np.full((n, 0), -np.inf), np.zeros((n, 0), dtype=np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.width = 0

    def allowed(self, at: np.ndarray, items: np.ndarray, s: np.ndarray) -> np.ndarray:
        low = self.low[at][:, None]
        ok = (s > low) | ((s == low) & (items[None, :] <= self.low_id[at][:, None]))
        if self.exclude_self:
            ok &= self.ids[at][:, None] != items[None, :]
        return ok

    def add(self, at: np.ndarray, items: np.ndarray, s: np.ndarray, decimals: int | None = None) -> None:
        """Scores as they are; only those that may reach the limit are rounded."""
        low, low_id = self.low[at], self.low_id[at]
        near = s >= (low - 1e-12 * np.abs(low) - (0.0 if decimals is None else 10.0**-decimals))[:, None]
        found = np.count_nonzero(near)
        if not found:
            return
        if len(at) == len(self.ids) and found * 2 > near.size:  # most items count: as they are
            s = round_half_away(s, decimals)
            ok = self.allowed(at, items, s)
            part, ids = np.where(ok, s, -np.inf), np.broadcast_to(items, s.shape)
        else:  # few do: to the left of a narrow matrix
            r, c = np.nonzero(near)
            v = round_half_away(s[r, c], decimals)
            ok = (v > low[r]) | ((v == low[r]) & (items[c] <= low_id[r]))
            if self.exclude_self:
                ok &= self.ids[at][r] != items[c]
            r, c, v = r[ok], c[ok], v[ok]
            if not len(r):
                return
            per = np.bincount(r, minlength=len(at))
            place = np.arange(len(r)) - (np.cumsum(per) - per)[r]
            part, ids = np.full((len(self.ids), per.max()), -np.inf), np.zeros((len(self.ids), per.max()), dtype=np.int64)
            part[at[r], place], ids[at[r], place] = v, items[c]
        self.parts.append((part, ids))
        self.width += part.shape[1]
        if self.width >= CORPUS_BLOCK:
            self.cut()

    def cut(self) -> None:
        """The ``k`` best by (score desc, id asc) of what is held; the k-th is the query's limit from now on."""
        s = np.concatenate([self.best, *(p for p, _ in self.parts)], axis=1)
        items = np.concatenate([self.items, *(i for _, i in self.parts)], axis=1)
        self.parts, self.width = [], 0
        if s.shape[1] > self.k:
            last = -np.partition(-s, self.k - 1, axis=1)[:, self.k - 1]
            keep = s >= last[:, None]
            for r in np.flatnonzero(keep.sum(axis=1) > self.k):
                ties = np.flatnonzero(s[r] == last[r])
                spare = int(keep[r].sum()) - self.k
                keep[r, ties[np.argpartition(items[r, ties], len(ties) - spare)[len(ties) - spare :]]] = False
            s, items = s[keep].reshape(len(s), self.k), items[keep].reshape(len(s), self.k)
        self.best, self.items = s, items
        if s.shape[1] == self.k:
            last = s.min(axis=1)
            full = np.isfinite(last)
            self.low[full] = last[full]
            self.low_id[full] = np.where(s == last[:, None], items, np.iinfo(np.int64).min).max(axis=1)[full]
            if "q_low" in self.row:
                self.row = self.row | {"q_low": self.low.tobytes(), "q_low_id": self.low_id.tobytes()}

    def batches(self, q_id: str, c_id: str, ranked: bool) -> Iterator[pa.RecordBatch]:
        self.cut()
        step = max(1, OUT_ROWS // self.k)
        for lo in range(0, len(self.ids), step):
            s, items = self.best[lo : lo + step], self.items[lo : lo + step]
            row, col = np.nonzero(s > -np.inf)
            if not len(row):
                continue
            order = np.lexsort((items[row, col], -s[row, col], row))
            row, col = row[order], col[order]
            cols, names = [pa.array(self.ids[lo + row]), pa.array(items[row, col]), pa.array(s[row, col])], [q_id, c_id, "score"]
            if ranked:
                per = np.bincount(row, minlength=len(s))
                cols, names = [*cols, pa.array((np.arange(len(row)) - (np.cumsum(per) - per)[row] + 1).astype(np.int32))], [*names, "rank"]
            yield pa.RecordBatch.from_arrays(cols, names=names)


def with_bounds(q_blocks: DataFrame, sampled: DataFrame, k: int, q_id: str, c_id: str) -> DataFrame:
    """Adds ``q_low`` and ``q_low_id``, per query score and id of the k-th best among ``sampled`` (-inf with
    fewer than k). What ranks behind it cannot be among the k best."""
    ranked = final_topk(sampled, k, q_id, c_id, "_r").where(F.col("_r") == k).select(F.col(q_id).alias("qid"), F.col("score").alias("low"), F.col(c_id).alias("low_id"))
    names = q_blocks.columns

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, raw in zip(b.column("qblock").to_pylist(), b.column("q_ids").to_pylist(), strict=True):
                q = np.frombuffer(raw, "<i8")
                yield pa.RecordBatch.from_pydict({"qblock": [block] * len(q), "pos": np.arange(len(q), dtype=np.int32), "qid": q})

    places = q_blocks.select("qblock", "q_ids").mapInArrow(ids_of, "qblock string, pos int, qid long")
    lows = places.join(ranked, "qid").groupBy("qblock").agg(F.collect_list(F.struct("pos", "low", "low_id")).alias("lows"))

    def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, ids = [], []
            for raw, found in zip(b.column("q_ids").to_pylist(), b.column("lows").to_pylist(), strict=True):
                low, low_id = np.full(len(raw) // 8, -np.inf), np.full(len(raw) // 8, np.iinfo(np.int64).max)
                for x in found or []:
                    low[x["pos"]], low_id[x["pos"]] = x["low"], x["low_id"]
                out.append(low.astype("<f8").tobytes())
                ids.append(low_id.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.binary()), pa.array(ids, pa.binary())], names=[*names, "q_low", "q_low_id"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in q_blocks.schema.fields) + ", q_low binary, q_low_id binary"
    return q_blocks.join(lows, "qblock", "left").mapInArrow(attach, schema)


def final_topk(partial: DataFrame, k: int, q_id: str, c_id: str, rank_col: str = "rank") -> DataFrame:
    """Top-k per query of the candidates: partial and final WindowGroupLimit on the query id."""
    w = Window.partitionBy(q_id).orderBy(F.col("score").desc(), F.col(c_id).asc())
    return partial.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def best_per_id(partial: DataFrame, q_id: str, c_id: str) -> DataFrame:
    """One row per query and item, its best score. Partitioned by query alone, as the final cut needs it: one exchange for both."""
    return partial.repartition(q_id).groupBy(q_id, c_id).agg(F.max("score").alias("score"))


def planned_bytes(df: DataFrame) -> int:
    """Size of ``df`` by the optimizer's statistics; no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def limits(q_blocks: DataFrame, share: DataFrame, k: int, q_id: str, c_id: str, score, exclude_self: bool, decimals: int | None, repeated: bool = False) -> DataFrame:
    """Query blocks with the limits that ``share``, blocks of some of the corpus, gives; written. With ``repeated`` the share
    has all or none of the vectors of an id."""
    sampled = scan_pairs(q_blocks, share, k, q_id, c_id, score, exclude_self, decimals, repeated)
    sampled = best_per_id(sampled, q_id, c_id) if repeated else sampled
    return cut_lineage(with_bounds(q_blocks, sampled, k, q_id, c_id), "query_limits")


def thinned(rows: DataFrame, id_col: str) -> DataFrame:
    """One row in ``BOUND_SHARE`` by a hash of the id: a sample of every region."""
    return rows.where(F.pmod(F.xxhash64(id_col), F.lit(BOUND_SHARE)) == 0)


def query_block_rows(dim: int, params: Params) -> int:
    """Queries per block: its vectors fit the broadcast budget, and no more than ``MAX_QUERY_BLOCK``."""
    return max(1, min(MAX_QUERY_BLOCK, params.max_broadcast_bytes // max(dim * 8 + 8, 1)))


def dense_scores(r: dict, decimals: int | None = None):
    """Inner products of the queries of a pair of blocks that their limits leave."""
    n, m = len(r["q_ids"]) // 8, len(r["c_ids"]) // 8
    q, c = np.frombuffer(r["q_vals"], "<f8").reshape(n, -1), np.frombuffer(r["c_vals"], "<f4").reshape(m, -1)
    if q.shape[1] != c.shape[1]:
        raise ValueError("queries and corpus have vectors of different length")
    rows = np.arange(n)
    if r.get("q_low") is not None:
        rows = within_reach(q, r, np.frombuffer(r["q_low"], "<f8"), decimals)
    if len(rows):
        yield rows, np.arange(m), q[rows] @ c.astype(np.float64).T


def query_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for raw in b.column("q_ids").to_pylist():
            yield pa.RecordBatch.from_pydict({"qid": np.frombuffer(raw, "<i8")})


def query_groups(queries: DataFrame, q_id: str, q_vec: str, k: int, params: Params) -> DataFrame:
    """Query blocks of as many vectors as a task holds with their results."""
    rows = query_block_rows(params.dim, params)
    q_blocks = cut_lineage(pack_queries(queries, q_id, q_vec, rows), "query_blocks")
    return grouped_queries(q_blocks, min(rows, MAX_QUERY_BLOCK) * max(1, min(GROUP_BLOCKS, HELD_BYTES // (16 * k * MAX_QUERY_BLOCK))), k > FEW)


def knn_candidates(queries, corpus, k, q_id="query_id", q_vec="qvec", c_id="Id", c_vec="vec", exclude_self=False, params=DEFAULT, decimals=None, repeated=False) -> DataFrame:
    """What reaches the final cut of ``knn_join``: a superset of the top-k of every query."""
    ship_package(corpus.sparkSession)
    q_blocks = query_groups(queries, q_id, q_vec, k, params)
    ids = q_blocks.select("q_ids").mapInArrow(query_ids, "qid long")
    single = ids.count() == ids.distinct().count()
    blocks = pack_corpus(corpus, c_id, c_vec)
    if k > FEW or planned_bytes(blocks) < ONE_PASS_BYTES:
        return scan_pairs(q_blocks, blocks, k, q_id, c_id, dense_scores, exclude_self, decimals, repeated, single)
    limited = limits(q_blocks, pack_corpus(thinned(corpus, c_id), c_id, c_vec), k, q_id, c_id, dense_scores, exclude_self, decimals, repeated)
    return scan_pairs(limited, blocks, k, q_id, c_id, dense_scores, exclude_self, decimals, repeated, single)


def skipped_pairs(queries, corpus, k, q_id="query_id", q_vec="qvec", c_id="Id", c_vec="vec", exclude_self=False, params=DEFAULT, decimals=None) -> DataFrame:
    """One row on the main pass of ``knn_join``: ``block_pairs`` and ``blocks_skipped``, ``query_blocks`` (pairs of a query and a corpus block) and ``queries_skipped``."""
    ship_package(corpus.sparkSession)
    q_blocks = query_groups(queries, q_id, q_vec, k, params)
    c_blocks = cut_lineage(pack_corpus(corpus, c_id, c_vec), "corpus_blocks")
    limited = limits(q_blocks, pack_corpus(thinned(corpus, c_id), c_id, c_vec), k, q_id, c_id, dense_scores, exclude_self, decimals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                n = len(r["q_ids"]) // 8
                left = len(within_reach(np.frombuffer(r["q_vals"], "<f8").reshape(n, -1), r, np.frombuffer(r["q_low"], "<f8"), decimals))
                out.append((int(left == 0), n, n - left))
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["b", "n", "s"])

    seen = meet(limited, c_blocks, q_blocks.count(), k).mapInArrow(run, "b long, n long, s long")
    return seen.agg(F.count(F.lit(1)).alias("block_pairs"), F.sum("b").alias("blocks_skipped"), F.sum("n").alias("query_blocks"), F.sum("s").alias("queries_skipped"))


def knn_join(
    queries: DataFrame, corpus: DataFrame, k: int, q_id: str = "query_id", q_vec: str = "qvec", c_id: str = "Id", c_vec: str = "vec",
    exclude_self: bool = False, params: Params = DEFAULT, decimals: int | None = None, repeated: bool = False,
) -> DataFrame:
    """Exact top-k by inner product: (q_id, c_id, score, rank). With ``repeated`` an id of the corpus may have several
    vectors (chunks of a text); its best one counts, and the k are k different ids."""
    found = knn_candidates(queries, corpus, k, q_id, q_vec, c_id, c_vec, exclude_self, params, decimals, repeated)
    if "rank" in found.columns:
        return found
    return final_topk(best_per_id(found, q_id, c_id) if repeated else found, k, q_id, c_id)
