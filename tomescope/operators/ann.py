"""Compressed index: IVF lists + product quantisation.

Tables (all ordinary Parquet):
  ivf_centroids(cluster INT, centroid ARRAY<DOUBLE>)      nlist rows
  pq_codebooks(m INT, code INT, sub ARRAY<DOUBLE>)        m * 2^bits rows
  ivfpq_codes(Id LONG, codes BINARY, cluster INT)         one row per vector, ranged and sorted by cluster

Training runs over all vectors: Lloyd steps whose assignment is an Arrow pass with the current model broadcast
(its size is a parameter and is checked) and whose means are sums per task, added up per key (``sums``): a step
shuffles tasks x keys rows. Centroids and codebooks are bounded by the index
parameters, never by the corpus, and are the only things that reach the driver. Encoding is one pass: list, residual and
codes together, a sub-space at a time, so a batch needs rows x 2^bits floats.

Search is a join of inverted lists. A query leaves one row per list it probes, packed with the other queries of its
batch that probe the same list; vectors are packed into blocks of one list each; the two meet by an equi join on
(cluster, salt), a sort-merge join that lets a group of queries meet the blocks of its list one after the other: the task keeps the k best of each
query, so a list gives at most k per query, however many blocks it has. Only probed pairs of query and list are shuffled or scored. A list of more than ``LIST_ROWS`` vectors is dealt
over several salts, and its queries go to each of them, so a hot list is spread over tasks. ``refine`` fetches the
stored vectors of the best code hits by a join on the id and ranks them by exact score.

Values are compared as they are; ``decimals`` rounds them first, which only the registered queries ask for (their SQL does so).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomescope.config import DEFAULT, Params
from tomescope.operators.knn import CORPUS_BLOCK, MAX_QUERY_BLOCK, ONE_PASS_BYTES, Held, final_topk, named, planned_bytes, round_half_away, thinned, vectors_of
from tomescope.operators.sums import sums_by_key
from tomescope.session import cut_lineage, new_table_path, ship_package

LIST_ROWS = 16 * CORPUS_BLOCK  # vectors of one list that one join key holds
HELD_ROWS = 64 * CORPUS_BLOCK  # vectors a task holds while it packs them by list
PROBE_BYTES = 8 * 1024 * 1024  # packed queries sent on at a time


@dataclass
class IvfPq:
    centroids: DataFrame  # (cluster, centroid)
    codebooks: DataFrame  # (m, code, sub)
    codes: DataFrame  # (Id, codes, cluster), ranged by cluster
    m: int
    ksub: int
    dim: int
    path: str = ""
    sizes: np.ndarray | None = None  # vectors per list


# --- small tables to NumPy (bounded by index parameters) ---------------------------


def _checked(rows: int, dim: int, params: Params) -> None:
    if rows * max(dim, 1) * 8 > params.max_broadcast_bytes * 8:
        raise ValueError(f"a model of {rows} x {dim} numbers is above the broadcast budget")


def centroid_matrix(centroids: DataFrame, params: Params = DEFAULT) -> np.ndarray:
    facts = centroids.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("centroid")).alias("dim")).first()
    _checked(facts["n"], facts["dim"] or 0, params)
    rows = centroids.select("cluster", "centroid").orderBy("cluster").collect()
    if [r["cluster"] for r in rows] != list(range(len(rows))):
        raise ValueError("clusters must be numbered 0..nlist-1")
    return np.array([r["centroid"] for r in rows], dtype=np.float64) if rows else np.zeros((0, 0))


def codebook_tensor(codebooks: DataFrame, params: Params = DEFAULT) -> np.ndarray:
    """(m, ksub, dsub) array from the codebook table."""
    facts = codebooks.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("sub")).alias("dim")).first()
    _checked(facts["n"], facts["dim"] or 0, params)
    rows = codebooks.select("m", "code", "sub").orderBy("m", "code").collect()
    m, ksub = rows[-1]["m"] + 1, rows[-1]["code"] + 1
    return np.array([r["sub"] for r in rows], dtype=np.float64).reshape(m, ksub, -1)


def _broadcast(df: DataFrame, value):
    ship_package(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(value)


# --- I7: repeatable exact-size sample ----------------------------------------------


def sample_key(id_col: str, seed: int) -> F.Column:
    return F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))


def train_sample(df: DataFrame, id_col: str, n_max: int, seed: int) -> DataFrame:
    """min(n_max, n) rows with the smallest md5(id | seed). The cut is found by counting keys by their first three
    digits (4,096 counts), then by the next three within the digits found, until few rows share them; those few
    are cut exactly. One or two scans of the ids find it, at any size."""
    keyed = df.withColumn("_k", sample_key(id_col, seed))
    prefix, below = "", 0
    while True:
        digits = F.substring("_k", 1, len(prefix) + 3)
        counts = keyed.where(F.col("_k").startswith(prefix)).groupBy(digits.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        for r in sorted(counts):
            if below + r["n"] > n_max:
                prefix, n = r["p"], r["n"]
                break
            below += r["n"]
        else:
            return df
        if n <= 10_000 or len(prefix) >= 30:
            break
    rest = keyed.where(F.col("_k").startswith(prefix)).orderBy("_k").limit(n_max - below)
    return keyed.where(F.col("_k") < prefix).unionByName(rest).drop("_k")


# --- F8: coarse centroids ------------------------------------------------------------


def centroids_by_label(vectors: DataFrame, label_col: str, vec_col: str) -> DataFrame:
    """Fixed-centroid mode: the mean vector of each label (labels become clusters 0..)."""
    ex = vectors.select(F.col(label_col).alias("cluster"), F.posexplode(F.col(vec_col).cast("array<double>")).alias("p", "x"))
    per = ex.groupBy("cluster", "p").agg(F.avg("x").alias("x"))
    return per.groupBy("cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda z: z["x"]).alias("centroid")
    ).select(F.col("cluster").cast("int").alias("cluster"), "centroid")


def _start_rows(vectors: DataFrame, k: int, seed: int, id_col: str, vec_col: str) -> np.ndarray:
    rows = vectors.select(sample_key(id_col, seed).alias("_k"), F.col(vec_col).cast("array<double>").alias("v")).orderBy("_k").limit(k).collect()
    return np.array([r["v"] for r in rows], dtype=np.float64)


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1.0, n)


def nearest_list(x: np.ndarray, c: np.ndarray, decimals: int | None = None) -> np.ndarray:
    """Centroid of largest inner product (ties: smallest cluster)."""
    return np.argmax(round_half_away(x @ c.T, decimals), axis=1)


def train_kmeans(
    vectors: DataFrame, vec_col: str, k: int, iters: int, seed: int, id_col: str = "Id", decimals: int | None = None, seeding: str = "hash"
) -> DataFrame:
    """Spherical k-means over all vectors: (cluster, centroid), unit centroids.

    ``seeding="hash"`` starts at the rows of smallest md5(id | seed) and leaves an empty list where it is. ``"parallel"`` starts at
    oversampled seeds (``parallel_seeds``) and moves empty lists to halves of the largest ones."""
    start = parallel_seeds(vectors, vec_col, k, seed, id_col) if seeding == "parallel" else unit_rows(_start_rows(vectors, k, seed, id_col, vec_col))
    return _as_centroids(vectors, lloyd(vectors.select(vec_col), vec_col, start, iters, decimals, seed if seeding == "parallel" else None))


SEED_ROUNDS, OVERSAMPLE = 4, 2


def _gap(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest of the unit rows ``c`` and the squared distance to it, of unit rows ``x``."""
    s = x @ c.T
    at = s.argmax(axis=1)
    return at, np.maximum(0.0, 2.0 - 2.0 * s[np.arange(len(x)), at])


def seed_chance(id_col: str, seed: int, step: int) -> F.Column:
    """A number in [0, 1) for a row and round, from 52 bits of md5(id | seed | round)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed)), F.lit(str(step)))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def parallel_seeds(vectors: DataFrame, vec_col: str, k: int, seed: int, id_col: str = "Id", rounds: int = SEED_ROUNDS, oversample: int = OVERSAMPLE) -> np.ndarray:
    """``k`` unit centroids by k-means|| oversampling.

    From the row of smallest md5, each round adds up all squared distances to the seeds so far, then takes every row with chance
    ``oversample * k`` x its share of that sum: expected ``oversample * k`` rows, so the driver holds some ``rounds * oversample * k`` seeds, whatever the
    corpus (checked before they are fetched). Seeds are weighted by the rows nearest to them and reduced to ``k`` by weighted k-means++."""
    seeds = unit_rows(_start_rows(vectors, 1, seed, id_col, vec_col))
    if not len(seeds):
        return seeds
    expected = oversample * k
    for step in range(rounds):
        model = _broadcast(vectors, seeds)

        def cost(b, n, s, model=model):
            n += 1
            s[0, 0] += _gap(unit_rows(vectors_of(b.column(vec_col))), model.value)[1].sum()

        total = float(sums_by_key(vectors.select(vec_col), 1, 1, cost)[1][0, 0])
        if total <= 1e-12:
            break  # every row equals a seed

        def take(batches: Iterator[pa.RecordBatch], model=model, total=total) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    gap = _gap(unit_rows(vectors_of(b.column("v"))), model.value)[1]
                    yield b.filter(pa.array(b.column("chance").to_numpy() < gap * (expected / total)))

        rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), seed_chance(id_col, seed, step).alias("chance"))
        taken = cut_lineage(rows.mapInArrow(take, "id long, v array<double>, chance double").select("id", "v"), "kmeans_seeds")
        _checked(taken.count(), seeds.shape[1], DEFAULT)
        found = sorted((r["id"], r["v"]) for r in taken.collect())
        model.unpersist()
        if found:
            seeds = np.concatenate([seeds, unit_rows(np.array([v for _, v in found], dtype=np.float64))])
    seeds = np.unique(seeds, axis=0)
    if len(seeds) <= k:
        return np.concatenate([seeds, unit_rows(_start_rows(vectors, k, seed, id_col, vec_col))])[:k]
    model = _broadcast(vectors, seeds)

    def weigh(b, n, s):
        n += np.bincount(_gap(unit_rows(vectors_of(b.column(vec_col))), model.value)[0], minlength=len(n))

    weight, _ = sums_by_key(vectors.select(vec_col), len(seeds), 1, weigh)
    return _plus_plus(seeds, weight.astype(np.float64), k, np.random.Generator(np.random.PCG64(seed)))


def _plus_plus(seeds: np.ndarray, weight: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray:
    """Weighted k-means++ over the seeds."""
    chosen = [int(weight.argmax())]
    gap = _gap(seeds, seeds[chosen])[1]
    while len(chosen) < k:
        share = np.cumsum(weight * gap)
        at = int(np.searchsorted(share, draw.random() * share[-1], side="right")) if share[-1] > 0 else int(np.setdiff1d(np.arange(len(seeds)), chosen)[0])
        chosen.append(min(at, len(seeds) - 1))
        gap = np.minimum(gap, _gap(seeds, seeds[chosen[-1:]])[1])
    return seeds[chosen]


def split_into_empty(c: np.ndarray, n: np.ndarray, seed: int) -> np.ndarray:
    """Each empty list moves beside the centroid of the largest list, which moves the other way; the next step parts their vectors."""
    c, n = c.copy(), n.astype(np.float64)
    for e in np.flatnonzero(n == 0).tolist():
        big = int(n.argmax())
        if n[big] < 2:
            break
        step = np.random.Generator(np.random.PCG64([seed, e])).normal(size=c.shape[1])
        step *= 0.05 / np.linalg.norm(step)
        c[e], c[big] = unit_rows((c[big] + step)[None])[0], unit_rows((c[big] - step)[None])[0]
        n[e] = n[big] = n[big] / 2
    return c


def lloyd(data: DataFrame, vec_col: str, c: np.ndarray, iters: int, decimals: int | None = None, split_seed: int | None = None) -> np.ndarray:
    """``iters`` spherical Lloyd steps from the centroids ``c``; with ``split_seed``, all but the last also fill empty lists."""
    for step in range(iters):
        model = _broadcast(data, c)

        def add(b, n, s, model=model):
            x = vectors_of(b.column(vec_col))
            a = nearest_list(x, model.value, decimals)
            n += np.bincount(a, minlength=len(n))
            for d in range(x.shape[1]):
                s[:, d] += np.bincount(a, weights=x[:, d], minlength=len(n))

        n, s = sums_by_key(data, len(c), c.shape[1], add)
        c = np.where((n > 0)[:, None], unit_rows(s / np.maximum(n, 1)[:, None]), c)
        if split_seed is not None and step + 1 < iters and (n == 0).any():
            c = split_into_empty(c, n, split_seed + step)
        model.unpersist()
    return c


def _as_centroids(vectors: DataFrame, c: np.ndarray) -> DataFrame:
    return vectors.sparkSession.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(c)], "cluster int, centroid array<double>")


# --- E4: assignment and probing ------------------------------------------------------


def assign(
    vectors: DataFrame, centroids: DataFrame, id_col: str = "Id", vec_col: str = "vec", carry: bool = False, decimals: int | None = None
) -> DataFrame:
    """(Id, cluster): the centroid of largest inner product (ties: smallest cluster); ``carry`` keeps the vector."""
    model = _broadcast(vectors, centroid_matrix(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = nearest_list(vectors_of(b.column(vec_col)), model.value, decimals).astype(np.int32) if b.num_rows else np.zeros(0, np.int32)
            cols = [b.column(id_col), pa.array(a)] + ([b.column(vec_col)] if carry else [])
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "cluster"] + ([vec_col] if carry else []))

    kind = f", `{vec_col}` {vectors.schema[vec_col].dataType.simpleString()}" if carry else ""
    return vectors.select(F.col(id_col).cast("long").alias(id_col), vec_col).mapInArrow(run, f"`{id_col}` long, cluster int" + kind)


def probe_matrix(q: np.ndarray, c: np.ndarray, nprobe: int, decimals: int | None = None) -> np.ndarray:
    """Boolean (nq, nlist): the nprobe centroids of largest inner product per query (ties: smaller cluster)."""
    s = round_half_away(q @ c.T, decimals)
    order = np.lexsort((np.broadcast_to(np.arange(c.shape[0]), s.shape), -s), axis=1)[:, :nprobe]
    p = np.zeros(s.shape, dtype=bool)
    np.put_along_axis(p, order, True, axis=1)
    return p


# --- the join of inverted lists -------------------------------------------------------

PROBE_SCHEMA = "cluster int, salt int, probe string, q_ids binary, q_vals binary, q_coarse binary, q_low binary, q_low_id binary"
LIST_SCHEMA = "cluster int, salt int, c_ids binary, c_vals binary"


def list_sizes(lists: DataFrame, nlist: int) -> np.ndarray:
    """Vectors per list (``nlist`` numbers)."""
    out = np.zeros(nlist, dtype=np.int64)
    for r in lists.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect():
        out[r["cluster"]] = r["n"]
    return out


def salts_of(sizes: np.ndarray) -> np.ndarray:
    """Join keys per list: one for every ``LIST_ROWS`` vectors."""
    return np.maximum(1, -(-sizes // LIST_ROWS))


def probe_rows(queries: DataFrame, q_id: str, q_vec: str, c: np.ndarray, nprobe: int, salts: np.ndarray, rows: int, decimals: int | None) -> DataFrame:
    """One row per list and group of up to ``rows`` queries of a batch that probe it, repeated for every salt of the list.
    ``low`` and ``low_id`` columns of the queries, if any, travel along."""
    model, limited = _broadcast(queries, (c, salts)), "low" in queries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        cc, split = model.value
        names = [x.split()[0] for x in PROBE_SCHEMA.split(", ")]
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int32(), pa.string()] + [pa.binary()] * 5
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

        for whole in batches:
            for at in range(0, whole.num_rows, MAX_QUERY_BLOCK):
                b = whole.slice(at, MAX_QUERY_BLOCK)
                ids, x = b.column(q_id).to_numpy().astype("<i8"), vectors_of(b.column(q_vec))
                coarse = x @ cc.T
                probed = probe_matrix(x, cc, nprobe, decimals)
                low, low_id = np.full(len(ids), -np.inf), np.full(len(ids), np.iinfo(np.int64).max)
                if limited:
                    low = b.column("low").fill_null(-np.inf).to_numpy(zero_copy_only=False)
                    low_id = b.column("low_id").fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
                for cl in np.flatnonzero(probed.any(axis=0)).tolist():
                    mine = np.flatnonzero(probed[:, cl])
                    for lo in range(0, len(mine), rows):
                        r = mine[lo : lo + rows]
                        packed = (ids[r].tobytes(), x[r].astype("<f8").tobytes(), coarse[r, cl].astype("<f8").tobytes(), low[r].astype("<f8").tobytes(), low_id[r].astype("<i8").tobytes())
                        made += 1
                        for salt in range(int(split[cl])):
                            held.append((cl, salt, f"{task}-{made}", *packed))
                            size += sum(map(len, packed))
                            if size >= PROBE_BYTES:
                                yield out()
                                held, size = [], 0
        if held:
            yield out()

    return queries.select(q_id, q_vec, *(["low", "low_id"] if limited else [])).mapInArrow(run, PROBE_SCHEMA)


def list_rows(lists: DataFrame, c_id: str, payload: str, to_matrix, salts: np.ndarray) -> DataFrame:
    """Blocks of up to ``CORPUS_BLOCK`` vectors of one list: ``cluster, salt, c_ids, c_vals``."""
    model = _broadcast(lists, salts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, held, size, made = TaskContext.get().partitionId(), {}, 0, {}

        def out(cl: int, ids: np.ndarray, vals: np.ndarray) -> pa.RecordBatch:
            made[cl] = made.get(cl, task) + 1
            cols = {"cluster": pa.array([cl], pa.int32()), "salt": pa.array([made[cl] % int(model.value[cl])], pa.int32()), "c_ids": [ids.tobytes()], "c_vals": [vals.tobytes()]}
            return pa.RecordBatch.from_pydict(cols)

        for b in batches:
            ids, cl, vals = b.column(c_id).to_numpy().astype("<i8"), b.column("cluster").to_numpy(), to_matrix(b.column(payload))
            order = np.argsort(cl, kind="stable")
            for g in np.split(order, np.flatnonzero(np.diff(cl[order])) + 1):
                if not len(g):
                    continue
                key = int(cl[g[0]])
                old = held.pop(key, None)
                i, v = (ids[g], vals[g]) if old is None else (np.concatenate([old[0], ids[g]]), np.concatenate([old[1], vals[g]]))
                whole = len(i) - len(i) % CORPUS_BLOCK
                for lo in range(0, whole, CORPUS_BLOCK):
                    yield out(key, i[lo : lo + CORPUS_BLOCK], v[lo : lo + CORPUS_BLOCK])
                if whole < len(i):
                    held[key] = (i[whole:], v[whole:])
            size = sum(len(i) for i, _ in held.values())
            if size >= HELD_ROWS:
                for key in list(held):
                    yield out(key, *held.pop(key))
        for key in list(held):
            yield out(key, *held.pop(key))

    return lists.select(c_id, "cluster", payload).mapInArrow(run, LIST_SCHEMA)


def join_lists(probes: DataFrame, blocks: DataFrame, k: int, q_id: str, c_id: str, score, exclude_self: bool, decimals: int | None) -> DataFrame:
    """Candidates ``(q_id, c_id, score)``: probed lists meet their blocks on (cluster, salt); ``score(row, n, m)`` gives the
    matrix of a group of n queries and a block of m vectors. A list's salt emits at most ``k`` per query."""
    q_names, c_names = [c for c in probes.columns if c.startswith("q_")], [c for c in blocks.columns if c.startswith("c_")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, None
        for b in batches:
            for i in range(b.num_rows):
                of = lambda names, b=b, i=i: {n: b.column(n)[i].as_py() for n in names}
                key = of(["cluster", "salt", "probe"])
                if key != group:
                    if held is not None:
                        yield from held.batches(q_id, c_id, False)
                    group, held = key, Held(of(q_names), k, exclude_self)
                r = held.row | of(c_names) | key
                items = np.frombuffer(r["c_ids"], "<i8")
                held.add(np.arange(len(held.ids)), items, score(r, len(held.ids), len(items)), decimals)
        if held is not None:
            yield from held.batches(q_id, c_id, False)

    return probes.join(blocks.hint("merge"), ["cluster", "salt"]).mapInArrow(run, f"`{q_id}` long, `{c_id}` long, score double")


def probed_lists(queries: DataFrame, q_vec: str, c: np.ndarray, nprobe: int, decimals: int | None) -> list[int]:
    """Lists that any query probes (at most ``nlist`` numbers a task)."""
    if nprobe >= len(c):
        return list(range(len(c)))
    model = _broadcast(queries, c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = np.zeros(len(model.value), dtype=bool)
        for b in batches:
            for at in range(0, b.num_rows, MAX_QUERY_BLOCK):
                hit |= probe_matrix(vectors_of(b.column(q_vec).slice(at, MAX_QUERY_BLOCK)), model.value, nprobe, decimals).any(axis=0)
        yield pa.RecordBatch.from_pydict({"cluster": np.flatnonzero(hit).astype(np.int32)})

    return sorted(r["cluster"] for r in queries.select(q_vec).mapInArrow(run, "cluster int").distinct().collect())


def search_lists(
    queries: DataFrame, lists: DataFrame, c: np.ndarray, nprobe: int, k: int, q_id: str, q_vec: str, c_id: str, payload: str, to_matrix, score,
    rows: int, sizes: np.ndarray | None, exclude_self: bool, decimals: int | None,
) -> DataFrame:
    """Candidates of the top ``k`` per query in the probed lists. Above ``ONE_PASS_BYTES`` a share of the vectors is scored
    first; a query's k-th best score there is its lower limit in the pass over all blocks."""
    queries, lists = named(queries, q_id), named(lists, c_id)
    salts = salts_of(list_sizes(lists, len(c)) if sizes is None else sizes)
    probed = probed_lists(queries, q_vec, c, nprobe, decimals)
    scan = lists.where(F.col("cluster").isin(probed)) if len(probed) < len(c) else lists
    blocks = list_rows(scan, c_id, payload, to_matrix, salts)
    mine = queries.select(q_id, q_vec)
    if planned_bytes(scan) >= ONE_PASS_BYTES:
        share = list_rows(thinned(scan, c_id), c_id, payload, to_matrix, salts)
        sampled = join_lists(probe_rows(mine, q_id, q_vec, c, nprobe, salts, rows, decimals), share, k, q_id, c_id, score, exclude_self, decimals)
        lows = final_topk(sampled, k, q_id, c_id, "_r").where(F.col("_r") == k).select(q_id, F.col("score").alias("low"), F.col(c_id).alias("low_id"))
        mine = cut_lineage(mine.join(lows, q_id, "left"), "query_limits")
    return join_lists(probe_rows(mine, q_id, q_vec, c, nprobe, salts, rows, decimals), blocks, k, q_id, c_id, score, exclude_self, decimals)


def ivf_candidates(
    queries: DataFrame, lists: DataFrame, centroids: DataFrame, nprobe: int, k: int, q_id: str = "query_id", q_vec: str = "qvec",
    c_id: str = "Id", c_vec: str = "vec", exclude_self: bool = False, decimals: int | None = None, sizes: np.ndarray | None = None,
) -> DataFrame:
    """What reaches the final cut of ``ivf_search``."""

    def score(r: dict, n: int, m: int) -> np.ndarray:
        return np.frombuffer(r["q_vals"], "<f8").reshape(n, -1) @ np.frombuffer(r["c_vals"], "<f4").reshape(m, -1).astype(np.float64).T

    floats = lists.withColumn(c_vec, F.col(c_vec).cast("array<float>"))
    to_matrix = lambda col: vectors_of(col).astype("<f4")
    return search_lists(
        queries, floats, centroid_matrix(centroids), nprobe, k, q_id, q_vec, c_id, c_vec, to_matrix, score, MAX_QUERY_BLOCK, sizes, exclude_self, decimals
    )


def ivf_search(
    queries: DataFrame, lists: DataFrame, centroids: DataFrame, nprobe: int, k: int, q_id: str = "query_id", q_vec: str = "qvec",
    c_id: str = "Id", c_vec: str = "vec", exclude_self: bool = False, params: Params = DEFAULT, decimals: int | None = None,
) -> DataFrame:
    """Exact scores inside the probed lists only. ``lists`` = (Id, cluster, vec)."""
    return final_topk(ivf_candidates(queries, lists, centroids, nprobe, k, q_id, q_vec, c_id, c_vec, exclude_self, decimals), k, q_id, c_id)


# --- K3 / F9: product quantisation -------------------------------------------------------


def sub_size(dim: int, m: int) -> int:
    if m < 1 or dim % m:
        raise ValueError(f"{dim} dimensions do not split into {m} sub-spaces of one size")
    return dim // m


def nearest_codes(res: np.ndarray, cb: np.ndarray, decimals: int | None = None) -> np.ndarray:
    """Nearest code per sub-space (ties: smallest code), a sub-space at a time. res (n, dim); cb (m, ksub, dsub)."""
    m, _, d = cb.shape
    out = np.empty((len(res), m), dtype=np.int64)
    for j in range(m):
        x, c = res[:, j * d : (j + 1) * d], cb[j]
        dist = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
        out[:, j] = np.argmin(round_half_away(dist, decimals), axis=1)
    return out


def train_pq(
    vectors: DataFrame, centroids: DataFrame, m: int, ksub: int, iters: int, seed: int, id_col: str = "Id", vec_col: str = "vec", decimals: int | None = None
) -> DataFrame:
    """Codebooks (m, code, sub): Lloyd steps in every sub-space over the residuals of all vectors. They start at
    the residuals of the rows with the smallest md5(id | seed); a code left empty keeps its place."""
    c = centroid_matrix(centroids)
    d = sub_size(c.shape[1], m)
    first = _start_rows(vectors, ksub, seed, id_col, vec_col)
    first = first - c[nearest_list(first, c, decimals)]
    if len(first) < ksub:  # fewer vectors than codes: the last code again
        first = np.vstack([first, np.repeat(first[-1:], ksub - len(first), axis=0)])
    cb = first.reshape(ksub, m, d).transpose(1, 0, 2).copy()
    data = vectors.select(vec_col)
    for _ in range(iters):
        model = _broadcast(vectors, (c, cb))

        def add(b, n, s, model=model):
            cc, books = model.value
            x = vectors_of(b.column(vec_col))
            res = x - cc[nearest_list(x, cc, decimals)]
            codes = nearest_codes(res, books, decimals)
            for j in range(m):
                at = slice(j * ksub, (j + 1) * ksub)
                n[at] += np.bincount(codes[:, j], minlength=ksub)
                for t in range(d):
                    s[at, t] += np.bincount(codes[:, j], weights=res[:, j * d + t], minlength=ksub)

        n, s = sums_by_key(data, m * ksub, d, add)
        cb = np.where((n > 0)[:, None], s / np.maximum(n, 1)[:, None], cb.reshape(m * ksub, d)).reshape(m, ksub, d)
        model.unpersist()
    rows = [(j, k, [float(x) for x in cb[j, k]]) for j in range(m) for k in range(ksub)]
    return vectors.sparkSession.createDataFrame(rows, "m int, code int, sub array<double>")


def pq_encode(vectors: DataFrame, centroids: DataFrame, codebooks: DataFrame, id_col: str = "Id", vec_col: str = "vec", decimals: int | None = None) -> DataFrame:
    """(Id, codes BINARY, cluster) in one pass: list, residual and codes. One byte a code up to 256 codes, else two."""
    c, cb = centroid_matrix(centroids), codebook_tensor(codebooks)
    sub_size(c.shape[1], cb.shape[0])
    model = _broadcast(vectors, (c, cb))
    kind = code_type(cb.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cc, books = model.value
        for b in batches:
            x = vectors_of(b.column(vec_col))
            a = nearest_list(x, cc, decimals) if len(x) else np.zeros(0, np.int64)
            codes = nearest_codes(x - cc[a], books, decimals).astype(kind) if len(x) else np.zeros((0, 1), kind)
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(a.astype(np.int32))], names=[id_col, "codes", "cluster"])

    return vectors.select(F.col(id_col).cast("long").alias(id_col), vec_col).mapInArrow(run, f"`{id_col}` long, codes binary, cluster int")


def code_type(ksub: int) -> str:
    return "<u1" if ksub <= 256 else "<u2"


def compress_index(
    vectors: DataFrame, nlist: int, m: int, bits: int, iters: int, seed: int, id_col: str = "Id", vec_col: str = "vec",
    centroids: DataFrame | None = None, decimals: int | None = None, seeding: str = "hash",
) -> IvfPq:
    """Train on all vectors, encode and store: codes ranged by ``cluster``, centroids and codebooks beside them."""
    spark = vectors.sparkSession
    cents = cut_lineage(centroids if centroids is not None else train_kmeans(vectors, vec_col, nlist, iters, seed, id_col, decimals, seeding), "ivf_centroids")
    books = cut_lineage(train_pq(vectors, cents, m, 1 << bits, iters, seed, id_col, vec_col, decimals), "pq_codebooks")
    coded = cut_lineage(pq_encode(vectors, cents, books, id_col, vec_col, decimals), "ivfpq_unsorted")
    path = write_codes(coded, new_table_path(spark, "ivfpq_codes"))
    dim = len(cents.first()["centroid"])
    return IvfPq(cents, books, read_codes(spark, path), m, 1 << bits, dim, path, list_sizes(coded, cents.count()))


def write_codes(coded: DataFrame, path: str) -> str:
    """Codes as files of neighbouring lists, sorted by list and id within, in small row groups. The range takes a hash of the id after the list, so
    a large list fills several files. At most ``spark.sql.shuffle.partitions`` files, whatever the number of lists and tasks."""
    parts = max(1, int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = coded.repartitionByRange(parts, F.col("cluster"), F.xxhash64("Id")).sortWithinPartitions("cluster", "Id")
    dealt.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", str(4 * 1024 * 1024)).parquet(path)
    return path


def read_codes(spark, path: str, clusters: list[int] | None = None) -> DataFrame:
    """Stored codes; of named lists only the files and row groups whose statistics allow them are read."""
    df = spark.read.schema("Id long, codes binary, cluster int").parquet(path)
    return df if clusters is None else df.where(F.col("cluster").isin(clusters))


# --- K4: IVF-PQ search -----------------------------------------------------------------


def pq_candidates(
    queries: DataFrame, index: IvfPq, nprobe: int, k: int, q_id: str = "query_id", q_vec: str = "qvec", c_id: str = "Id",
    exclude_self: bool = False, decimals: int | None = None,
) -> DataFrame:
    """What reaches the final cut of ``pq_search``: score = q . centroid(list) + sum_m q_m . codebook[m, code_m]. A block's codes are turned into the
    vectors they stand for once for a group of queries, so that a pair costs one inner product and no look-up per sub-space."""
    c, cb = centroid_matrix(index.centroids), codebook_tensor(index.codebooks)
    m, ksub, d = cb.shape
    kind, model = code_type(ksub), _broadcast(queries, cb)
    to_matrix = lambda col: np.frombuffer(b"".join(col.to_pylist()), dtype=kind).reshape(len(col), m) if len(col) else np.zeros((0, m), kind)

    def score(r: dict, n: int, size: int) -> np.ndarray:
        codes, q = np.frombuffer(r["c_vals"], kind).reshape(size, m), np.frombuffer(r["q_vals"], "<f8").reshape(n, -1)
        x = model.value[np.arange(m)[None, :], codes].reshape(size, m * d)
        return np.frombuffer(r["q_coarse"], "<f8")[:, None] + q @ x.T

    return search_lists(queries, index.codes, c, nprobe, k, q_id, q_vec, c_id, "codes", to_matrix, score, MAX_QUERY_BLOCK, index.sizes, exclude_self, decimals)


def pq_search(
    queries: DataFrame, index: IvfPq, nprobe: int, k: int, q_id: str = "query_id", q_vec: str = "qvec", c_id: str = "Id",
    exclude_self: bool = False, params: Params = DEFAULT, decimals: int | None = None, vectors: DataFrame | None = None, refine: int = 1,
) -> DataFrame:
    """Top ``k`` by code score. With ``vectors`` (Id, vec), the best ``refine`` x ``k`` by code score are fetched and ranked by exact score."""
    most = k * refine if vectors is not None else k
    hits = final_topk(pq_candidates(queries, index, nprobe, most, q_id, q_vec, c_id, exclude_self, decimals), most, q_id, c_id)
    return hits if vectors is None else refine_hits(hits, queries, vectors, k, q_id, q_vec, c_id, decimals=decimals)


def refine_hits(
    hits: DataFrame, queries: DataFrame, vectors: DataFrame, k: int, q_id: str = "query_id", q_vec: str = "qvec", c_id: str = "Id", c_vec: str = "vec", decimals: int | None = None
) -> DataFrame:
    """The hits' stored vectors, fetched by a join on the id, scored exactly: the best ``k`` per query."""
    floats = vectors.select(c_id, F.col(c_vec).cast("array<float>").alias("_c"))
    pairs = hits.select(q_id, c_id).join(floats, c_id).join(queries.select(q_id, F.col(q_vec).alias("_q")), q_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = (vectors_of(b.column("_q")) * vectors_of(b.column("_c"))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(q_id), b.column(c_id), pa.array(round_half_away(s, decimals))], names=[q_id, c_id, "score"])

    return final_topk(pairs.select(q_id, c_id, "_q", "_c").mapInArrow(run, f"`{q_id}` long, `{c_id}` long, score double"), k, q_id, c_id)


# --- F10 / J1 / A12: evaluation ------------------------------------------------------------


def _recall_per_query(exact: DataFrame, approx: DataFrame, k: int, q_id: str, c_id: str) -> DataFrame:
    e = exact.select(q_id, c_id)
    hit = e.join(approx.select(q_id, c_id), [q_id, c_id], "left_semi").groupBy(q_id).agg(F.count(F.lit(1)).alias("h"))
    return e.select(q_id).distinct().join(hit, q_id, "left").select(q_id, (F.coalesce("h", F.lit(0)) / F.lit(k)).alias("r"))


def recall_at_k(exact: DataFrame, approx: DataFrame, k: int, q_id: str = "query_id", c_id: str = "Id") -> DataFrame:
    """Mean overlap of the two top-k id sets per query, / k (semi join, then avg)."""
    per = _recall_per_query(exact, approx, k, q_id, c_id)
    return per.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.round(F.avg("r"), 6).alias("recall_at_k"),
        (F.avg("r") >= 0.8).alias("passed"),
    )


def index_report(index: IvfPq, id_bytes: int = 8) -> DataFrame:
    """From the stored tables in one aggregate: vectors, exact-store bytes (n * dim * 4) against the bytes of
    codes, ids, centroids and codebooks (float32), and the reduction in percent."""
    fixed = index.centroids.agg(F.sum(F.size("centroid")).alias("a")).crossJoin(index.codebooks.agg(F.sum(F.size("sub")).alias("b")))
    codes = index.codes.agg(F.count(F.lit(1)).alias("n_vectors"), F.sum(F.length("codes")).alias("code_bytes"))
    flat = F.col("n_vectors") * F.lit(index.dim * 4)
    both = codes.crossJoin(fixed).withColumn("ivfpq_bytes", (F.coalesce("code_bytes", F.lit(0)) + F.col("n_vectors") * id_bytes + (F.col("a") + F.col("b")) * 4).cast("long"))
    return both.select(
        "n_vectors", F.lit(index.dim).alias("dim"), flat.cast("long").alias("flat_bytes"), "ivfpq_bytes",
        F.round((F.lit(1.0) - F.col("ivfpq_bytes") / flat) * 100, 1).alias("reduction_pct"),
    )


def recall_interval(exact: DataFrame, approx: DataFrame, k: int, q_id: str = "query_id", c_id: str = "Id") -> DataFrame:
    """Recall at ``k`` over a stated query set, with the half width of its 95 % confidence interval (normal approximation)."""
    per = _recall_per_query(exact, approx, k, q_id, c_id)
    half = F.lit(1.96) * F.sqrt(F.var_samp("r") / F.count(F.lit(1)))
    return per.agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("r"), 6).alias("recall"), F.round(half, 6).alias("half_width"))


def list_spread(lists: DataFrame, nlist: int) -> DataFrame:
    """How evenly vectors lie in their lists: (lists, empty, largest, imbalance); imbalance = lists x sum of squared shares (1: even)."""
    per = lists.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    square = F.sum(F.col("n").cast("double") * F.col("n")) / (F.sum("n").cast("double") * F.sum("n"))
    return per.agg(
        F.lit(nlist).alias("lists"), (F.lit(nlist) - F.count(F.lit(1))).cast("int").alias("empty"), F.max("n").alias("largest"), F.round(square * nlist, 6).alias("imbalance")
    )
