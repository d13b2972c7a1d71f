"""Operator 4: MinHash near-duplicates with odd sketches.

1. One pass over the texts: distinct shingle set, MinHash samples, their bands as keys, and the odd
   sketch: each sample (position, value) flips one bit of a parity bitmap. The XOR of two sketches
   holds the parity of the samples in which two documents differ, so its population count estimates
   a high similarity sharply.
2. Documents with one shingle set are one class; its smallest doc_id stands for it.
3. Representatives that share a band key meet in chunks of at most ``CHUNK``; in a chunk all sketches
   are compared, and those with an estimate of at least the threshold less ``MARGIN`` are tied to the smallest
   of their tie. No pair leaves a task, only (member, smallest). The ties' components are the
   candidate groups, and one set of every member is sent to its group.
4. In a group, links are confirmed on full sets. A group above ``CHUNK`` members is dealt into chunks;
   then delegates of every chunk's components are linked with each other, and whoever is still outside
   the largest component is compared with all members, in blocks. So every pair of the group that
   could join two components is confirmed or rejected on full sets.
5. Components of the confirmed links give the result.

A linked pair goes unseen only if none of its ``BANDS`` keys agree (4e-6 at 0.8, 1e-8 at 0.85) or its
sketch is off by more than ``MARGIN`` (about five standard deviations).

Cases: null or empty text has an empty set, component_id = doc_id and links with nothing; a text of
fewer words than a shingle is one shingle. A null doc_id gets a null component and is kept. Rows that
repeat a doc_id are documents of their own that share a name: what links one of them joins the name's
component (give rows numbers of their own where that is not wanted). Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomescope.config import DEFAULT
from tomescope.llm.common import id_text, shuffle_parts, table
from tomescope.llm.components import components, groups, roots_of
from tomescope.llm.words import M2, M3, ngrams, strong_hashes
from tomescope.operators.joins import bounded_broadcast
from tomescope.session import cut_lineage

BANDS, ROWS = 32, 5
SKETCH_BITS = 512
MARGIN = 0.15
CHUNK = 768
DELEGATES = 24
_SEEDS = np.random.default_rng(20240229).integers(1, 2**63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit shingles; fewer words than ``size`` make one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.unique(ngrams(strong_hashes(words), min(size, len(words)))) if words else np.zeros(0, dtype=np.uint64)


def minhashes(s: np.ndarray) -> np.ndarray:
    best = np.full(len(_SEEDS), np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(s), 1024):
            np.minimum(best, (_SEEDS[:, None] * s[None, lo : lo + 1024]).min(axis=1), out=best)
    return best


def odd_sketch(m: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmap of the samples, as bytes."""
    with np.errstate(over="ignore"):
        h = (m ^ (m >> np.uint64(33))) * M2 + np.arange(len(m), dtype=np.uint64) * M3
        at = ((h ^ (h >> np.uint64(29))) * M2) >> np.uint64(40)
    return np.packbits(np.bincount((at % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1)


def estimate(sketches: np.ndarray, others: np.ndarray, samples: int = BANDS * ROWS) -> np.ndarray:
    """Similarity estimates of all rows of one bitmap matrix (uint64 words) with all of another."""
    bits = sketches.shape[1] * 64
    flips = np.zeros((len(sketches), len(others)), dtype=np.int64)
    for w in range(sketches.shape[1]):
        flips += np.bitwise_count(sketches[:, w][:, None] ^ others[:, w][None, :])
    return 1 + bits / (4 * samples) * np.log(np.maximum(1 - 2 * flips / bits, 1e-9))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n, fp1, fp2, bands, sketch`` per row (step 1). fp1, fp2 identify the set."""

    def run(batches):
        for b in batches:
            n, fp1, fp2, bands, sk = [], [], [], [], []
            for text in b.column("text").to_pylist():
                s = shingles(text, size)
                n.append(len(s))
                with np.errstate(over="ignore"):
                    fp1.append(int(s.sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
                    fp2.append(int(((s ^ (s >> np.uint64(31))) * M2).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
                    if len(s):
                        m = minhashes(s)
                        k = m.reshape(BANDS, ROWS)
                        h = np.arange(BANDS, dtype=np.uint64) * M3
                        for c in range(ROWS):
                            h = (h ^ (h >> np.uint64(30))) * M2 + k[:, c]
                        bands.append(h.view(np.int64))
                        sk.append(odd_sketch(m).tobytes())
                    else:
                        bands.append(np.zeros(0, dtype=np.int64))
                        sk.append(b"")
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(fp1, pa.int64()), pa.array(fp2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sk, pa.binary())],
                names=["doc_id", "n", "fp1", "fp2", "bands", "sketch"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, fp1 long, fp2 long, bands array<long>, sketch binary")


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(shuffle_parts(df.sparkSession), *keys).sortWithinPartitions(*keys)


def _tie(least: float):
    """Ties of one chunk: (member, smallest member it is tied to by sketches)."""

    def run(batches):
        a, b = [], []
        for g in groups(batches, ["key", "chunk"]):
            ids = np.asarray(g.column("id"))
            if len(ids) > 1:
                sk = np.frombuffer(b"".join(g.column("sketch").to_pylist()), dtype="<u8").reshape(len(ids), -1)
                order = np.argsort(ids)
                ids, sk = ids[order], sk[order]
                if len(ids) == 2:
                    root = np.array([0, 0 if estimate(sk[:1], sk[1:])[0, 0] >= least else 1])
                else:
                    root = roots_of(estimate(sk, sk) >= least)
                tied = root != np.arange(len(ids))
                a.append(ids[tied])
                b.append(ids[root[tied]])
            if len(a) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def candidate_groups(reps: DataFrame, percent: int, name: str) -> DataFrame:
    """``id, component`` of the representatives tied to another one (step 3)."""
    keys = reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    shared = cut_lineage(shared, f"{name}-keys")
    members = keys.join(shared, "key").select(
        "id", "key", F.pmod(F.xxhash64("id", "key"), F.ceil(F.col("n") / F.lit(CHUNK * 0.9))).cast("int").alias("chunk")
    )
    members = members.join(reps.select(F.col("doc_id").alias("id"), "sketch"), "id")
    ties = _dealt(members, "key", "chunk").select("key", "chunk", "id", "sketch").mapInArrow(_tie(percent / 100 - MARGIN), "a long, b long")
    return components(ties, f"{name}-ties")


def linked(sets: list[np.ndarray], others: list[np.ndarray], percent: int) -> np.ndarray:
    """Matrix of confirmed links: 100 * |both| >= percent * |either| on full sets."""
    every = sets if others is sets else sets + others
    values, where = np.unique(np.concatenate(every), return_inverse=True)
    rows = np.repeat(np.arange(len(every)), [len(s) for s in every])
    often = np.bincount(where, minlength=len(values)) > 1
    keep = often[where]
    col = (np.cumsum(often) - 1)[where[keep]]
    n, rows = len(sets), rows[keep]
    both = np.zeros((n, len(others)), dtype=np.float32)
    for lo in range(0, int(often.sum()), 4096):  # columns in strips, so memory stays bounded
        part = (col >= lo) & (col < lo + 4096)
        m = np.zeros((len(every), 4096), dtype=np.float32)
        m[rows[part], col[part] - lo] = 1
        both += m[:n] @ (m[:n] if others is sets else m[n:]).T
    size, size2 = (np.array([len(s) for s in x]) for x in (sets, others))
    both = both.astype(np.int64)
    return 100 * both >= percent * (size[:, None] + size2[None, :] - both)


def _sets(g: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype="<u8") for x in g.column("set").to_pylist()]


def _confirm(percent: int, keys: list[str]):
    """Confirmed links of one group: (member, smallest member of its component)."""

    def run(batches):
        a, b = [], []
        for g in groups(batches, keys):
            if g.num_rows < 2:
                continue
            ids = np.asarray(g.column("id"))
            order = np.argsort(ids)
            sets = _sets(g)
            root = roots_of(linked(s := [sets[i] for i in order], s, percent))
            ids = ids[order]
            tied = root != np.arange(len(ids))
            a.append(ids[tied])
            b.append(ids[root[tied]])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def _confirm_blocks(percent: int):
    """Links of the outsiders in a block with its other rows: (one, other), one per outsider and component."""

    def run(batches):
        for g in groups(batches, ["grp", "block"]):
            ids, comp, out = (np.asarray(g.column(c)) for c in ("id", "comp", "outsider"))
            sets = _sets(g)
            x, y = np.flatnonzero(out), np.arange(len(ids))
            if not len(x):
                continue
            hit = linked([sets[i] for i in x], sets, percent) & (comp[x][:, None] != comp[None, y])
            row, col = np.nonzero(hit)
            if len(row):
                _, first = np.unique(np.stack([x[row], comp[col]]), axis=1, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids[x[row[first]]]), pa.array(ids[col[first]])], names=["a", "b"])

    return run


def confirmed_links(sets: DataFrame, percent: int, name: str, chunk: int = CHUNK) -> DataFrame:
    """Edges ``a, b`` that join exactly what the links of each group join (step 4).

    ``sets``: a written table ``id, grp, n (members of the group), set``."""
    deal = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / F.lit(chunk * 0.9))).cast("int")
    chunks = sets.withColumn("chunk", F.when(F.col("n") > chunk, deal).otherwise(F.lit(0)))
    cols = ["grp", "chunk", "id", "set"]
    edges = cut_lineage(_dealt(chunks.select(*cols), "grp", "chunk").mapInArrow(_confirm(percent, ["grp", "chunk"]), "a long, b long"), f"{name}-links")
    large = sets.where(F.col("n") > chunk)
    if large.isEmpty():
        return edges
    # delegates of each chunk's components, dealt once more where they are many
    state = _with_component(large, edges, name)
    order = F.row_number().over(_by("grp", "comp").orderBy(F.xxhash64("id")))
    sent = state.withColumn("k", order).where(F.col("k") <= DELEGATES).drop("k")
    count = sent.groupBy("grp").agg(F.count("*").alias("m"))
    sent = sent.join(count, "grp").withColumn("chunk", F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.ceil(F.col("m") / F.lit(chunk * 0.9))).cast("int"))
    more = _dealt(sent.select(*cols), "grp", "chunk").mapInArrow(_confirm(percent, ["grp", "chunk"]), "a long, b long")
    edges = cut_lineage(edges.union(more), f"{name}-links")
    # outsiders of the largest component meet all members, in blocks of half a chunk each
    state = cut_lineage(_with_component(large, edges, name), f"{name}-state")
    sizes = state.groupBy("grp", "comp").agg(F.count("*").alias("size"))
    main = sizes.groupBy("grp").agg(F.max(F.struct("size", (-F.col("comp")).alias("c"))).alias("x")).select("grp", (-F.col("x.c")).alias("main"))
    outside = sizes.join(main, "grp").where(F.col("comp") != F.col("main")).groupBy("grp").agg(F.sum("size").alias("outside"))
    half = max(1, chunk // 2)
    rows = state.join(main, "grp").join(outside, "grp").withColumns(
        {"n_out": F.ceil(F.col("outside") / half).cast("int"), "n_all": F.ceil(F.col("n") / half).cast("int"), "outsider": F.col("comp") != F.col("main")}
    )
    mine = F.pmod(F.xxhash64(F.col("id"), F.lit(2)), F.col("n_all")).cast("int")
    out = F.pmod(F.xxhash64(F.col("id"), F.lit(3)), F.col("n_out")).cast("int")
    keep = ["grp", "block", "id", "comp", "outsider", "set"]
    every = rows.withColumn("block", F.explode(F.transform(F.sequence(F.lit(0), F.col("n_out") - 1), lambda x: x * F.col("n_all") + mine)))
    every = every.withColumn("outsider", F.lit(False)).select(*keep)
    outs = rows.where("outsider").withColumn("block", F.explode(F.transform(F.sequence(F.lit(0), F.col("n_all") - 1), lambda x: out * F.col("n_all") + x)))
    blocks = _dealt(every.union(outs.select(*keep)), "grp", "block")
    return edges.union(blocks.mapInArrow(_confirm_blocks(percent), "a long, b long"))


def _by(*cols: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


def _with_component(large: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Rows of the large groups with the component that the edges so far give them."""
    ids = large.select("id")
    own = edges.join(ids.select(F.col("id").alias("a")), "a", "left_semi")
    comp = components(own, f"{name}-part")
    return large.join(comp, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85, name: str = "near") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    rows = id_text(docs)
    sig = cut_lineage(signatures(rows, size), f"{name}-signatures")
    some = sig.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = some.groupBy("n", "fp1", "fp2").agg(F.min("doc_id").alias("rep"))
    classes = cut_lineage(classes, f"{name}-classes")
    reps = some.join(classes.select("n", "fp1", "fp2", F.col("rep").alias("doc_id")), ["doc_id", "n", "fp1", "fp2"], "left_semi")
    reps = cut_lineage(reps.dropDuplicates(["doc_id", "n", "fp1", "fp2"]).select("doc_id", "bands", "sketch"), f"{name}-reps")
    grp = cut_lineage(candidate_groups(reps, percent, name), f"{name}-groups")
    sizes = grp.groupBy("component").agg(F.count("*").alias("n"))
    wanted = cut_lineage(grp.join(sizes, "component").select(F.col("id").alias("doc_id"), F.col("component").alias("grp"), "n"), f"{name}-wanted")

    def to_sets(batches):
        for b in batches:
            sets = [shingles(t, size).astype("<u8").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grp"), b.column("n"), pa.array(sets, pa.binary())], names=["id", "grp", "n", "set"])

    texts = rows.join(bounded_broadcast(wanted, wanted.count(), 40, DEFAULT), "doc_id")
    sets = cut_lineage(texts.select("doc_id", "grp", "n", "text").mapInArrow(to_sets, "id long, grp long, n long, set binary"), f"{name}-sets")
    final = cut_lineage(components(confirmed_links(sets, percent, name), f"{name}-final"), f"{name}-final")
    of_class = classes.join(final.withColumnRenamed("id", "rep"), "rep", "left").select("n", "fp1", "fp2", F.coalesce("component", "rep").alias("comp"))
    out = sig.select("doc_id", "n", "fp1", "fp2").join(of_class, ["n", "fp1", "fp2"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("comp")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def op4_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
