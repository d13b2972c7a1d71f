"""Operator 12: centroid clustering over subvector dictionaries.

Vectors are turned into integers and cut into blocks of ``BLOCK_DIMS`` dimensions. A chunk of up to
``CHUNK_ROWS`` rows is stored once, without loss, as one row: per block a dictionary of its distinct
subvectors, and per row and block a code. Every round reads the chunks, works out the squared distance of
each dictionary entry to its block of every centroid once, and a row's distance is the sum of its
codes' partial distances: exact integers. Dictionaries belong to a chunk, so none grows with the corpus and
only the centroids (``k`` x dimensions numbers, a parameter) are sent around. New centroids come from the
counts of the dictionary entries per cluster, added up per task and then per cluster; sums travel as two
32-bit halves, so they are exact for any number of rows.

Cases: a vector takes part if it has exactly ``dim`` components, none null or non-finite; others give no
row. Components so large that a squared distance could leave 64 bits (beyond ``2**62 / (4 * dim)``, square root, after scaling)
stop the job with an error. Rows that repeat a ``vec_id`` are vectors of their own; as starting centroids equal hashes
go by the vector. A null ``vec_id`` is clustered, and starts a centroid only when all others are used up. Fewer vectors than ``k`` give as many
centroids as vectors; equal centroids: the smaller number takes all. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomescope.llm.common import table
from tomescope.operators.joins import bounded_broadcast
from tomescope.operators.sums import sums_by_key
from tomescope.session import cut_lineage

DIM, SCALE, K, ROUNDS, SEED = 64, 64, 16, 3, 1
BLOCK_DIMS = 2
CHUNK_ROWS = 32768
SUMS_AT_A_TIME = 1 << 19  # row and centroid pairs whose distances are held at once
LOW = np.int64(0xFFFFFFFF)
CHUNK_SCHEMA = "n int, ids binary, no_id binary, sizes binary, entries binary, codes binary"


def kept_vectors(vectors: DataFrame, dim: int, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, v``: the rows that take part, as doubles."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("v").isNotNull() & (F.size("v") == dim) & finite)


def largest_component(dim: int) -> int:
    """Components up to this keep every squared distance of two vectors below 2**63."""
    return int((2**62 / (4 * dim)) ** 0.5)


def as_integers(col: pa.Array, dim: int, scale: int) -> np.ndarray:
    x = np.floor(scale * col.flatten().to_numpy(zero_copy_only=False))
    if x.size and np.abs(x).max() > largest_component(dim):
        raise ValueError(f"a component above {largest_component(dim)} after scaling: squared distances could leave 64 bits")
    return x.astype(np.int64).reshape(-1, dim)


def block_spans(dim: int, block_dims: int) -> list[tuple[int, int]]:
    return [(at, min(at + block_dims, dim)) for at in range(0, dim, block_dims)]


def dictionary(sub: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a block of integers, and the code of every row."""
    low = sub.min(axis=0)
    widths = [int(w) + 1 for w in sub.max(axis=0) - low]
    if float(np.prod(np.array(widths, dtype=np.float64))) >= 2.0**62:
        entries, codes = np.unique(sub, axis=0, return_inverse=True)
        return entries, codes.reshape(-1)
    key = np.zeros(len(sub), dtype=np.int64)
    for c, w in enumerate(widths):
        key = key * w + (sub[:, c] - low[c])
    found, codes = np.unique(key, return_inverse=True)
    entries = np.empty((len(found), sub.shape[1]), dtype=np.int64)
    for c in range(sub.shape[1] - 1, -1, -1):
        found, entries[:, c] = np.divmod(found, widths[c])
    return entries + low, codes.reshape(-1)


def encode_chunk(ids: np.ndarray, no_id: np.ndarray, x: np.ndarray, block_dims: int) -> pa.RecordBatch:
    sizes, entries, codes = [], [], []
    for lo, hi in block_spans(x.shape[1], block_dims):
        e, c = dictionary(x[:, lo:hi])
        sizes.append(len(e))
        entries.append(e.astype("<i8").tobytes())
        codes.append(c.astype("<u2" if len(e) <= 1 << 16 else "<u4").tobytes())
    out = {"n": np.array([len(x)], dtype=np.int32)}
    for name, v in (
        ("ids", ids.astype("<i8").tobytes()), ("no_id", no_id.astype("<u1").tobytes()), ("sizes", np.array(sizes, dtype="<i4").tobytes()),
        ("entries", b"".join(entries)), ("codes", b"".join(codes)),
    ):
        out[name] = pa.array([v], pa.binary())
    return pa.RecordBatch.from_pydict(out)


def decode_chunk(r: dict, dim: int, block_dims: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per block its entries and the rows' codes."""
    out, at, code_at = [], 0, 0
    for (lo, hi), size in zip(block_spans(dim, block_dims), np.frombuffer(r["sizes"], "<i4").tolist(), strict=True):
        n = size * (hi - lo)
        kind = "<u2" if size <= 1 << 16 else "<u4"
        entries = np.frombuffer(r["entries"], "<i8", n, at).reshape(size, hi - lo)
        out.append((entries, np.frombuffer(r["codes"], kind, r["n"], code_at)))
        at, code_at = at + 8 * n, code_at + int(kind[2]) * r["n"]
    return out


def chunks(kept: DataFrame, dim: int, scale: int, block_dims: int, rows: int) -> DataFrame:
    """Chunks of up to ``rows`` vectors of one scan task."""

    def run(batches):
        held, size = [], 0

        def out(parts):
            ids = pa.concat_arrays([i for i, _ in parts])
            return encode_chunk(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), np.concatenate([x for _, x in parts]), block_dims)

        for b in batches:
            if not b.num_rows:
                continue
            held.append((b.column("vec_id"), as_integers(b.column("v"), dim, scale)))
            size += b.num_rows
            if size >= rows:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)

    return kept.mapInArrow(run, CHUNK_SCHEMA)


def nearest(blocks: list[tuple[np.ndarray, np.ndarray]], centroids: np.ndarray, block_dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: smaller number) and squared distance of every row of a chunk."""
    partials = []
    for (lo, hi), (entries, _) in zip(block_spans(centroids.shape[1], block_dims), blocks, strict=True):
        partial = np.zeros((len(entries), len(centroids)), dtype=np.int64)
        for c in range(lo, hi):
            gap = entries[:, c - lo, None] - centroids[None, :, c]
            partial += gap * gap
        partials.append(partial)
    n = len(blocks[0][1])
    best, distance = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    step = max(1, SUMS_AT_A_TIME // max(1, len(centroids)))
    for at in range(0, n, step):
        total = np.zeros((min(step, n - at), len(centroids)), dtype=np.int64)
        for (_, codes), partial in zip(blocks, partials, strict=True):
            total += partial[codes[at : at + step]]
        best[at : at + step] = total.argmin(axis=1)
        distance[at : at + step] = total[np.arange(len(total)), best[at : at + step]]
    return best, distance


def block_sums(blocks, best: np.ndarray, k: int, dim: int, block_dims: int) -> np.ndarray:
    """Sums of the vectors per cluster, from the counts of every dictionary entry in each cluster."""
    out = np.zeros((k, dim), dtype=np.int64)
    for (lo, hi), (entries, codes) in zip(block_spans(dim, block_dims), blocks, strict=True):
        counts = np.bincount(best * len(entries) + codes, minlength=k * len(entries)).reshape(k, len(entries))
        out[:, lo:hi] = counts @ entries
    return out


def start_centroids(kept: DataFrame, k: int, scale: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of ``seed:vec_id``, in its order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.withColumn("_h", key).orderBy(F.col("_h").asc_nulls_last(), "v").limit(k).collect()
    dim = len(rows[0]["v"]) if rows else 0
    return as_integers(pa.array([r["v"] for r in rows], pa.list_(pa.float64())), dim, scale) if rows else np.zeros((0, 0), dtype=np.int64)


def one_round(stored: DataFrame, centroids: np.ndarray, block_dims: int) -> np.ndarray:
    """Every non-empty centroid replaced by its vectors' componentwise floor of the mean."""
    k, dim = centroids.shape
    model = stored.sparkSession.sparkContext.broadcast(centroids)

    def add(b, n, s):
        for r in b.to_pylist():
            blocks = decode_chunk(r, dim, block_dims)
            best, _ = nearest(blocks, model.value, block_dims)
            sums = block_sums(blocks, best, k, dim, block_dims)
            n += np.bincount(best, minlength=k)
            s[:, :dim] += sums >> 32
            s[:, dim:] += sums & LOW

    n, s = sums_by_key(stored, k, 2 * dim, add, "<i8")
    model.unpersist()
    out = centroids.copy()
    for i in np.flatnonzero(n).tolist():
        out[i] = [(int(high) * 2**32 + int(low)) // int(n[i]) for high, low in zip(s[i, :dim], s[i, dim:], strict=True)]
    return out


def assigned(stored: DataFrame, centroids: np.ndarray, block_dims: int) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""
    dim = centroids.shape[1] if len(centroids) else 0
    model = stored.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                best, distance = nearest(decode_chunk(r, dim, block_dims), model.value, block_dims)
                ids = pa.array(np.frombuffer(r["ids"], "<i8"), mask=np.frombuffer(r["no_id"], "<u1").astype(bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(best.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return stored.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(
    vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED, block_dims: int = BLOCK_DIMS,
    chunk_rows: int = CHUNK_ROWS, id_col: str = "vec_id", vec_col: str = "embedding", name: str = "clusters",
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` of every vector after ``rounds`` rounds, and the final centroids."""
    kept = kept_vectors(vectors, dim, id_col, vec_col)
    centroids = start_centroids(kept, k, scale, seed)
    stored = cut_lineage(chunks(kept, dim, scale, block_dims, chunk_rows), f"{name}-chunks")
    for _ in range(rounds if len(centroids) else 0):
        centroids = one_round(stored, centroids, block_dims)
    return cut_lineage(assigned(stored, centroids, block_dims), f"{name}-assigned"), centroids


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds ``cluster_inertia``, ``inertia`` (exact sums, an error beyond 64 bits) and the centroid's sha256."""
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = sum(sums.values())
    rows = [(i, s, total, hashlib.sha256(",".join(map(str, centroids[i].tolist())).encode()).hexdigest()) for i, s in sorted(sums.items())]
    facts = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(bounded_broadcast(facts, len(rows), 128), "cluster")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_inertia(*cluster(table(spark, sf_dir, "embeddings")))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = K, rounds: int = ROUNDS) -> str:
    def near(name: str, cents: str) -> str:
        return f"""{name} AS MATERIALIZED (SELECT vec_id, cluster, distance FROM (
  SELECT vec_id, cluster, d AS distance, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) AS r FROM (
    SELECT v.vec_id, c.cluster, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS d FROM flat v JOIN {cents} c USING (p) GROUP BY v.vec_id, c.cluster)) WHERE r = 1)"""

    parts = [f"""v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), flat AS MATERIALIZED (SELECT vec_id, unnest(range(len(e))) AS p, unnest(e) AS x FROM v),
start AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS cluster FROM v),
c0 AS MATERIALIZED (SELECT cluster, p, x FROM flat JOIN start USING (vec_id) WHERE cluster < {k})"""]
    for i in range(1, rounds + 1):
        parts.append(near(f"a{i}", f"c{i - 1}"))
        parts.append(f"""m{i} AS (SELECT cluster, p, sum(x) AS s, count(*) AS n FROM flat JOIN a{i} USING (vec_id) GROUP BY cluster, p),
c{i} AS MATERIALIZED (SELECT o.cluster, o.p, CASE WHEN n IS NULL THEN o.x ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS x FROM c{i - 1} o LEFT JOIN m{i} USING (cluster, p))""")
    parts.append(near("last", f"c{rounds}"))
    parts.append(f"hashes AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)")
    return "WITH " + ",\n".join(parts) + """
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM last JOIN hashes USING (cluster)"""


ORACLE = _oracle()
