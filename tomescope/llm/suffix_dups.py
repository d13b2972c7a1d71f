"""Operator 10: repeated 400-byte strings by merging shard Burrows-Wheeler transforms.

Anchors. A window of ``LENGTH`` bytes is filed under its anchor, the rightmost of its ``GRAM``-byte strings with the least
hash. Equal windows have equal anchors at equal places, so only windows with an anchor seen twice can repeat.
The windows of one anchor are neighbours; their bytes make a segment of less than ``2 * LENGTH`` bytes.

1. One pass lists anchors (hash, segment hash, place). Anchors seen once go (counts are aggregated in the task first).
2. Segments equal as a whole are counted the same way; all windows of a segment seen twice repeat.
3. Segments that share the anchor but differ go, one of each kind, to their anchor's bucket. Strings of symbols are
   read from them, a symbol being ``STEP`` bytes, so a window is ``LENGTH / STEP`` symbols. Each shard of
   the bucket (documents are dealt to ``SHARDS`` shards) has its Burrows-Wheeler transform: the symbols that
   precede its suffixes, in suffix order. The transforms are merged by interleave refinement: the
   interleave sorted by h symbols, read together with the preceding symbols, is dealt stably to the symbols'
   buckets and is then sorted by h + 1. No suffix is compared or sorted anew. Where neighbours
   part, their common prefix ends; runs with a common prefix of a whole window are the repeated intervals.
4. An anchor with more than ``HOT`` kinds of segments is dealt to several such buckets. Their distinct windows are
   dealt once more by hash, to as many places as the anchor has buckets, packed into one row per bucket and place;
   windows met in two buckets repeat as well. A place gathers about as much as a bucket, however common the anchor.
5. Per document, the windows found are joined and their bytes cut out.

Symbols, anchors and segments are compared by 64-bit hashes; repeated intervals of one bucket are
checked byte by byte. A symbol order other than that of the bytes serves as well, as only equality is asked for.

Cases: null or empty text has no bytes, nothing to remove, and the hash of nothing. Texts shorter than ``LENGTH`` lose
nothing. Rows that repeat a doc_id (or whole rows) are separate documents and do match each other; null
doc_id stays null. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomescope.llm.common import id_text, shuffle_parts, table
from tomescope.llm.components import groups
from tomescope.llm.words import M1, M2, M3
from tomescope.session import cut_lineage

LENGTH, GRAM, STEP = 400, 32, 50
SHARDS = 4
HOT = 512
BATCH_BYTES = 1 << 19
CHUNK = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, dtype=np.uint64)
    p = int(M1)
    with np.errstate(over="ignore"):
        return tuple(np.concatenate((one, np.cumprod(np.full(n, v, dtype=np.uint64)))) for v in (p, pow(p, -1, 1 << 64)))


_POWERS = _powers(4096)


class Hashes:
    """Hashes of substrings of one byte buffer, each from two prefix sums."""

    def __init__(self, data: np.ndarray):
        global _POWERS
        if len(data) >= len(_POWERS[0]):
            _POWERS = _powers(len(data))
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[0][: len(data)], out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[hi] - self.sums[lo]) * _POWERS[1][lo]
            h = (h ^ (h >> np.uint64(31))) * M2
            return h ^ (h >> np.uint64(29))

    def all(self, size: int) -> np.ndarray:
        """Of all substrings of ``size`` bytes."""
        n = len(self.sums) - size
        with np.errstate(over="ignore"):
            h = (self.sums[size:] - self.sums[:n]) * _POWERS[1][:n]
            h = (h ^ (h >> np.uint64(31))) * M2
            return h ^ (h >> np.uint64(29))


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Least of every ``size`` neighbours."""
    have, n = 1, len(x) - size + 1
    while 2 * have <= size:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[size - have : size - have + n]) if have < size else x[:n]


def anchors(data: np.ndarray, doc: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors of one buffer that holds several documents (``doc``: starts of the documents and the end).

    Returns, per anchor: its hash, the hash of its segment, first and last window start (in the buffer)."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, dtype=np.uint64),) * 2 + (np.zeros(0, dtype=np.int64),) * 2
    hashes = Hashes(data)
    g = hashes.all(gram)
    pos = np.arange(len(g), dtype=np.uint64)
    low = np.uint64(0xFFFFFFFF)
    best = _sliding_min((g & ~low) | (low - pos), length - gram + 1)
    at = (low - (best & low)).astype(np.int64)
    whole = np.ones(n, dtype=bool)  # windows inside one document
    for start in doc[1:-1].tolist():
        whole[max(0, start - length + 1) : start] = False
    edge = np.ones(n + 1, dtype=bool)
    edge[1:n] = (at[1:] != at[:-1]) | (whole[1:] != whole[:-1])
    cut = np.flatnonzero(edge)
    first, last = cut[:-1], cut[1:] - 1
    keep = whole[first]
    first, last = first[keep], last[keep]
    p = at[first]
    with np.errstate(over="ignore"):
        seg = hashes.of(first, last + length) + (p - first).astype(np.uint64) * M3 + (last - first).astype(np.uint64) * M1
    return g[p], seg, first, last


def _anchor_rows(batches):
    """Arrow batches (rk, text) to anchor rows, a buffer of about ``CHUNK`` bytes at a time."""
    for b in batches:
        keys = np.asarray(b.column("rk"))
        held: list[bytes] = []
        owner: list[tuple[int, int]] = []  # row, offset in its document

        def flush():
            if not held:
                return None
            starts = np.concatenate(([0], np.cumsum([len(x) for x in held])))
            h, seg, first, last = anchors(np.frombuffer(b"".join(held), dtype=np.uint8), starts)
            piece = np.searchsorted(starts, first, side="right") - 1
            row, base = (np.array([o[k] for o in owner])[piece] for k in (0, 1))
            move = base - starts[piece]
            held.clear()
            owner.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(keys[row]), pa.array(first + move), pa.array(last + move)],
                names=["h", "sg", "rk", "lo", "hi"],
            )

        size = 0
        for row, text in enumerate(b.column("text").to_pylist()):
            raw = text.encode("utf-8", "surrogatepass")
            for lo in range(0, max(1, len(raw) - LENGTH + 1), CHUNK):  # windows that start in [lo, lo + CHUNK)
                part = raw[lo : lo + CHUNK + LENGTH - 1]
                if len(part) >= LENGTH:
                    held.append(part)
                    owner.append((row, lo))
                    size += len(part)
                if size >= CHUNK:
                    yield flush()
                    size = 0
        if held:
            yield flush()


def _stable_order(rank: np.ndarray) -> np.ndarray:
    """Stable counting order of ranks below 2**32 (two passes of 16 bits)."""
    order = np.argsort((rank & 0xFFFF).astype(np.uint16), kind="stable")
    if len(rank) and rank.max() > 0xFFFF:
        order = order[np.argsort((rank >> 16).astype(np.uint16)[order], kind="stable")]
    return order


def shard_transform(symbols: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """A shard's transform, level by level: for suffixes of h symbols in order, the symbol before each.

    ``symbols``: windows x levels, the last symbol of a window first. Returns the levels and the final order of the windows."""
    order = np.arange(len(symbols))
    levels = []
    for h in range(symbols.shape[1]):
        before = symbols[order, h]
        levels.append(before)
        order = order[_stable_order(before)]
    return levels, order


def merge_transforms(shards: list[tuple[list[np.ndarray], np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards in merged suffix order, and the run of equal suffixes each row lies in."""
    sizes = np.array([len(s[1]) for s in shards])
    base = np.cumsum(sizes) - sizes
    z = np.repeat(np.arange(len(shards), dtype=np.uint16), sizes)
    run = np.zeros(len(z), dtype=np.int64)
    for h in range(len(shards[0][0])):
        stream = np.concatenate([s[0][h] for s in shards])
        read = np.empty(len(z), dtype=np.int64)  # the k-th row of a shard in the interleave reads its k-th symbol
        read[np.argsort(z, kind="stable")] = np.arange(len(z))
        before = stream[read]
        order = _stable_order(before)
        z, run, before = z[order], run[order], before[order]
        new = np.ones(len(z), dtype=bool)
        new[1:] = (before[1:] != before[:-1]) | (run[1:] != run[:-1])
        run = np.cumsum(new) - 1
    place = np.empty(len(z), dtype=np.int64)
    place[np.argsort(z, kind="stable")] = np.concatenate([b + s[1] for b, s in zip(base, shards, strict=True)])
    return place, run


def repeated_windows(segments: list[bytes], shard: np.ndarray, length: int = LENGTH, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the segments: segment number, start in it, run of equal windows, and if the run has two or more."""
    size = np.array([len(s) for s in segments])
    start = np.cumsum(size) - size
    data = np.frombuffer(b"".join(segments), dtype=np.uint8)
    count = size - length + 1
    seg = np.repeat(np.arange(len(segments)), count)
    off = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    at = start[seg] + off
    _, rank = np.unique(Hashes(data).all(step), return_inverse=True)
    rank = rank.astype(np.uint32)
    levels = length // step
    by_shard = [np.flatnonzero(shard[seg] == s) for s in np.unique(shard)]
    made = [shard_transform(np.stack([rank[at[w] + length - step * (h + 1)] for h in range(levels)], axis=1)) for w in by_shard]
    place, run = merge_transforms(made)
    window = np.concatenate(by_shard)[place]
    out = np.empty(len(window), dtype=np.int64)
    out[window] = run
    n = np.bincount(run)
    first = window[np.concatenate(([True], run[1:] != run[:-1]))]
    again = n[out] > 1
    # check: every window of a repeated run equals the run's first, byte by byte
    rows = np.flatnonzero(again)
    for lo in range(0, len(rows), 4096):
        w = rows[lo : lo + 4096]
        a, b = at[w], at[first[out[w]]]
        if not (data[a[:, None] + np.arange(length)] == data[b[:, None] + np.arange(length)]).all():
            raise ValueError("two strings of bytes share a 64-bit hash")
    return seg, off, out, again


def _buckets(batches):
    """Segments sorted by bucket to marks (kind 0: rk, first and last window) and, of hot anchors, packed
    rows (kind 1): the hashes of a bucket's distinct windows that belong to one place, with the key and
    start of the row that holds a window if it was met once."""
    names = ["kind", "h", "place", "rk", "lo", "hi", "packed"]
    packing = np.dtype([("w", "<i8"), ("rk", "<i8"), ("lo", "<i8"), ("once", "<i1")])

    def work(tables):
        t = pa.concat_tables(tables)
        segments = t.column("seg").to_pylist()
        rk, lo, h, parts, alone = (np.asarray(t.column(c)) for c in ("rk", "lo", "h", "parts", "alone"))
        seg, off, run, again = repeated_windows(segments, (rk.view(np.uint64) % np.uint64(SHARDS)).astype(np.int64))
        mark = again & alone[seg]
        cut = np.ones(len(seg) + 1, dtype=bool)
        cut[1:-1] = (seg[1:] != seg[:-1]) | (mark[1:] != mark[:-1])
        at = np.flatnonzero(cut)
        a, b = at[:-1], at[1:] - 1
        keep = mark[a]
        a, b = a[keep], b[keep]
        if len(a):
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(a), np.int32)), none, none, pa.array(rk[seg[a]]), pa.array(lo[seg[a]] + off[a]), pa.array(lo[seg[a]] + off[b]), pa.nulls(len(a), pa.binary())],
                names=names,
            )
        if (parts > 1).any():
            rows = np.flatnonzero(parts[seg] > 1)
            rows = rows[np.unique(run[rows], return_index=True)[1]]
            data = np.frombuffer(b"".join(segments), dtype=np.uint8)
            size = np.array([len(s) for s in segments])
            place = (np.cumsum(size) - size)[seg[rows]] + off[rows]
            w = Hashes(data).of(place, place + LENGTH)
            out = np.empty(len(rows), dtype=packing)
            out["w"], out["rk"], out["lo"] = w.view(np.int64), rk[seg[rows]], lo[seg[rows]] + off[rows]
            out["once"] = ~again[rows] & alone[seg[rows]]
            to = (w % parts[seg[rows]].astype(np.uint64)).astype(np.int64)
            order = np.lexsort((to, h[seg[rows]]))
            out, to, key = out[order], to[order], h[seg[rows]][order]
            cut = np.concatenate(([0], np.flatnonzero((to[1:] != to[:-1]) | (key[1:] != key[:-1])) + 1, [len(out)]))
            first, none = cut[:-1], pa.nulls(len(cut) - 1, pa.int64())
            packed = pa.array([out[x:y].tobytes() for x, y in zip(first.tolist(), cut[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(first), np.int32)), pa.array(key[first]), pa.array(to[first]), none, none, none, packed], names=names)

    held, size = [], 0
    for g in groups(batches, ["h", "part"]):
        held.append(g)
        size += sum(len(x) for x in g.column("seg").to_pylist())
        if size >= BATCH_BYTES:
            yield from work(held)
            held, size = [], 0
    if held:
        yield from work(held)


def _across(batches):
    """Packed windows sorted by (anchor, place) to marks: windows met in two buckets, where they were met once in one."""
    packing = np.dtype([("w", "<i8"), ("rk", "<i8"), ("lo", "<i8"), ("once", "<i1")])
    for g in groups(batches, ["h", "place"]):
        all_of = np.frombuffer(b"".join(g.column("packed").to_pylist()), dtype=packing)
        _, back, n = np.unique(all_of["w"], return_inverse=True, return_counts=True)
        hit = all_of[(n[back] > 1) & (all_of["once"] == 1)]
        if len(hit):
            lo = pa.array(hit["lo"])
            yield pa.RecordBatch.from_arrays([pa.array(hit["rk"]), lo, lo], names=["rk", "lo", "hi"])


def _cut_segments(batches):
    """(text, list of wanted segments) to one row per segment with its bytes."""
    names = ["h", "part", "parts", "alone", "rk", "lo", "seg"]
    for b in batches:
        cols: list[list] = [[] for _ in names]
        for text, rk, want in zip(b.column("text").to_pylist(), b.column("rk").to_pylist(), b.column("want").to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            for w in want:
                for c, v in zip(cols, (w["h"], w["part"], w["parts"], w["alone"], rk, w["lo"], raw[w["lo"] : w["hi"] + LENGTH]), strict=True):
                    c.append(v)
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


def repeated_marks(rows: DataFrame, name: str = "suffix", hot: int = HOT) -> DataFrame:
    """``rk, lo, hi``: first and last start of neighbouring repeated windows, per row key."""
    spark = rows.sparkSession
    every = cut_lineage(rows.select("rk", "text").mapInArrow(_anchor_rows, "h long, sg long, rk long, lo long, hi long"), f"{name}-anchors")
    # written, so that the joins below are plain shuffled joins, whose hot keys Spark can split
    twice = cut_lineage(every.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("h"), f"{name}-twice")
    every = cut_lineage(every.join(twice, "h", "left_semi"), f"{name}-shared")
    kinds = every.groupBy("h", "sg").agg(F.count("*").alias("c"), F.first("rk").alias("rk"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    kinds = cut_lineage(kinds, f"{name}-kinds")
    marks = every.join(kinds.where(F.col("c") > 1).select("h", "sg"), ["h", "sg"], "left_semi").select("rk", "lo", "hi")
    differ = cut_lineage(kinds.groupBy("h").agg(F.count("*").alias("kinds")).where(F.col("kinds") > 1), f"{name}-differ")
    parts = F.when(F.col("kinds") > hot, F.ceil(F.col("kinds") / F.lit(hot * 0.9))).otherwise(F.lit(1)).cast("int")
    want = kinds.join(differ, "h").select(
        "rk", "h", "lo", "hi", (F.col("c") == 1).alias("alone"), parts.alias("parts"), F.pmod(F.xxhash64("sg"), parts).cast("int").alias("part"),
    )
    want = cut_lineage(want, f"{name}-want")
    lists = want.groupBy("rk").agg(F.collect_list(F.struct("h", "part", "parts", "alone", "lo", "hi")).alias("want"))
    one = rows.select("rk", "text").join(lists.hint("merge"), "rk")  # the lists grow with the input: one plan at all sizes
    schema = "h long, part int, parts int, alone boolean, rk long, lo long, seg binary"
    segments = one.mapInArrow(_cut_segments, schema).repartition(shuffle_parts(spark), "h", "part").sortWithinPartitions("h", "part")
    found = cut_lineage(segments.mapInArrow(_buckets, "kind int, h long, place long, rk long, lo long, hi long, packed binary"), f"{name}-found")
    marks = marks.union(found.where(F.col("kind") == 0).select("rk", "lo", "hi"))
    across = found.where(F.col("kind") == 1).select("h", "place", "packed").repartition(shuffle_parts(spark), "h", "place")
    return marks.union(across.sortWithinPartitions("h", "place").mapInArrow(_across, "rk long, lo long, hi long"))


def _join_spans(spans: np.ndarray, length: int) -> np.ndarray:
    """Byte spans [start, end) covered by windows with first and last starts ``spans``, overlaps and touching ones joined."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    end = np.maximum.accumulate(spans[:, 1] + length)
    new = np.concatenate(([True], spans[1:, 0] > end[:-1]))
    return np.stack([spans[new, 0], end[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(spans) - 1]))]], axis=1)


def remove_repeats(docs: DataFrame, name: str = "suffix", hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept, spans`` per row: the bytes left and the spans cut out."""
    rows = id_text(docs).withColumn("rk", F.xxhash64("doc_id", "text"))
    marks = cut_lineage(repeated_marks(rows, name, hot), f"{name}-marks")
    lists = marks.groupBy("rk").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))

    def run(batches):
        for b in batches:
            n_bytes, kept, spans = [], [], []
            for text, found in zip(b.column("text").to_pylist(), b.column("marks"), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                n_bytes.append(len(raw))
                v = found.values
                if v is None or not len(v):
                    kept.append(raw)
                    spans.append([])
                    continue
                cut = _join_spans(np.stack([np.asarray(v.field("lo")), np.asarray(v.field("hi"))], axis=1), LENGTH).tolist()
                ends = [0, *(e for _, e in cut)]
                kept.append(b"".join(raw[a:z] for a, z in zip(ends, [*(s for s, _ in cut), len(raw)], strict=True)))
                spans.append([{"start": s, "end": e} for s, e in cut])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            removed = [x - len(k) for x, k in zip(n_bytes, kept, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"],
            )

    joined = rows.join(lists.hint("merge"), "rk", "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
