"""Operator 3: substring deduplication by sliding sentence spans.

A text is cut into sentences: after a mark of punctuation before white space, at line ends, and where a
capital letter follows a word in small letters (a passage pasted into a sentence starts so). A sentence of more
than ``LONG`` words is cut further, behind words whose hash is a multiple of ``EVERY``: the same words are
cut alike wherever they stand, so a passage within a long sentence is found as well. From every
sentence the shortest run of at least ``SPAN`` consecutive sentences that reaches ``MIN_WORDS`` words is hashed,
white space apart: among short sentences (lists, verse, tables) runs are longer, none is skipped. Runs of ten words
already repeat by chance between documents that share no passage; at twenty, repeated passages of 50 words are found as before. Of a
run that comes more than once, the first is the one in the smallest doc_id, and there the one
furthest to the front; sentences covered by any other are removed. What is left keeps its characters.

Plan: texts are cut and hashed once; per row the lengths of its sentences, the reach of its runs and their hashes are
written (about 10 bytes a run). Counts and smallest doc_id are aggregated before and after the
shuffle, so a passage in a third of all rows is one row a task. Runs seen in two documents or more are
joined back (skewed keys are split by the adaptive join) and each row gets the list of its
runs that are not first. Rows' lists meet the written lengths, which gives the characters to cut; only these go to the
texts. Repeats inside a document need no shuffle.

Cases: null or empty text has no sentences and becomes or stays the empty text; a document may lose all
its text and stays as an empty one. Null doc_id comes after all others; runs shared only by rows
with null doc_id are left alone. Rows that repeat a doc_id are one document here: their runs are not
repeats of each other. Empty tables give no rows. Hashes have 64 bits.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomescope.llm.common import id_text, table
from tomescope.llm.words import mixed
from tomescope.session import cut_lineage

SPAN = 3
MIN_WORDS = 20
LONG, EVERY = 12, 6
_CUT = re.compile(r"(?<=[.!?;:,])\s+|\s*\n\s*|(?<=[a-zß-öø-ÿ])\s+(?=[A-ZÀ-ÖØ-Þ])")

_WORD = re.compile(r"(\S+)\s*")


def sentences(text: str) -> list[str]:
    """Sentences with the white space after them; joined they are the text."""
    if not text:
        return []
    ends = [m.end() for m in _CUT.finditer(text) if 0 < m.start() and m.end() < len(text)]
    out = []
    for a, b in zip([0, *ends], [*ends, len(text)], strict=True):
        part = text[a:b]
        if b - a > 3 * LONG and len(part.split()) > LONG:
            out += _shorter(part)
        else:
            out.append(part)
    return out


def _shorter(part: str) -> list[str]:
    cuts = [m.end() for m in _WORD.finditer(part) if zlib.crc32(m[1].encode("utf-8", "surrogatepass")) % EVERY == 0 and m.end() < len(part)]
    return [part[a:b] for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True)]


def run_hashes(parts: list[str], span: int = SPAN, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash (as signed 64 bits) of the run from every sentence that has one."""
    if len(parts) < span:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    words = [p.split() for p in parts]
    h = np.fromiter((xxhash.xxh3_64_intdigest(" ".join(w)) for w in words), dtype=np.uint64, count=len(parts))
    total = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    ends = np.maximum(np.searchsorted(total, total[:-1] + min_words), np.arange(span, len(parts) + span))
    at = np.flatnonzero(ends <= len(parts))
    ends = ends[at]
    out = np.zeros(len(at), dtype=np.uint64)
    for n in np.unique(ends - at):
        pick = np.flatnonzero(ends - at == n)
        out[pick] = mixed(*(h[at[pick] + k] for k in range(n)))
    return at, ends, out.view(np.int64)


def _cut_texts(span: int, min_words: int):
    def run(batches):
        for b in batches:
            sizes, reach, hashes = [], [], []
            for text in b.column("text").to_pylist():
                parts = sentences(text)
                at, ends, h = run_hashes(parts, span, min_words)
                sizes.append(np.fromiter(map(len, parts), dtype=np.int32, count=len(parts)))
                reach.append((ends - at).astype(np.int32))
                hashes.append(h)
            lists = [pa.array(c, pa.list_(t)) for c, t in ((sizes, pa.int32()), (reach, pa.int32()), (hashes, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("span_id"), b.column("doc_id"), *lists], names=["span_id", "doc_id", "sizes", "reach", "hashes"])

    return run


def covered(n: int, at: np.ndarray, ends: np.ndarray, hashes: np.ndarray, later: set[int]) -> np.ndarray:
    """Which of ``n`` sentences lie in a run that is not the first of its kind."""
    if not len(at):
        return np.zeros(n, dtype=bool)
    again = np.ones(len(at), dtype=bool)
    again[np.unique(hashes, return_index=True)[1]] = False
    if later:
        again |= np.isin(hashes, np.fromiter(later, dtype=np.int64, count=len(later)))
    edges = np.bincount(at[again], minlength=n + 1) - np.bincount(ends[again], minlength=n + 1)
    return np.cumsum(edges[:n]) > 0


def _spans_to_cut(batches):
    """Written cuts with ``later`` to the number of sentences, that of removed ones, and the removed runs of characters."""
    names = ["span_id", "doc_id", "n", "cut", "lo", "hi"]
    for b in batches:
        n, cut, los, his = [], [], [], []
        for sizes, reach, hashes, later in zip(*(b.column(c) for c in ("sizes", "reach", "hashes", "later")), strict=True):
            ends = np.cumsum(np.asarray(sizes.values), dtype=np.int64)
            at = np.arange(len(reach.values))  # runs start at the first sentences, one each
            gone = covered(len(ends), at, at + np.asarray(reach.values), np.asarray(hashes.values), set(later.as_py() or ()))
            edge = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
            place = np.concatenate(([0], ends))
            n.append(len(ends))
            cut.append(int(gone.sum()))
            los.append(place[np.flatnonzero(edge == 1)])
            his.append(place[np.flatnonzero(edge == -1)])
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        lists = [pa.array(c, t) for c, t in zip((n, cut, los, his), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("span_id"), b.column("doc_id"), *lists], names=names)


def _without(text: str, lo: list[int], hi: list[int]) -> str:
    return "".join(text[a:z] for a, z in zip([0, *hi], [*lo, len(text)], strict=True))


def cut_spans(rows: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """``span_id, doc_id, n, cut, lo, hi`` per row: sentences, removed ones, and the characters [lo, hi) to cut out."""
    cuts = rows.select("span_id", "doc_id", "text").mapInArrow(
        _cut_texts(span, min_words), "span_id long, doc_id long, sizes array<int>, reach array<int>, hashes array<long>"
    )
    cuts = cut_lineage(cuts, "span-cuts")
    runs = cuts.select("span_id", "doc_id", F.explode(F.array_distinct("hashes")).alias("h"))
    seen = runs.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    seen = cut_lineage(seen.where((F.col("n") > 1) & F.col("first").isNotNull()).select("h", "first"), "span-repeats")
    hits = runs.join(seen, "h").where(F.col("doc_id").isNull() | (F.col("doc_id") != F.col("first")))
    later = hits.groupBy("span_id").agg(F.collect_set("h").alias("later"))
    # the lists grow with the input: merge joins at all sizes
    found = cuts.join(later.hint("merge"), "span_id", "left").select("span_id", "doc_id", "sizes", "reach", "hashes", "later")
    spans = found.mapInArrow(_spans_to_cut, "span_id long, doc_id long, n long, cut long, lo array<long>, hi array<long>")
    return spans.dropDuplicates(["span_id", "doc_id"])  # identical rows have one list


def span_dedup(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with its own columns; ``text`` without the removed sentences, and in front of them
    ``span_sentences`` and ``span_removed``, the sentences of the text and those removed."""
    key = F.xxhash64("doc_id", "text").alias("span_id")
    spans = cut_spans(id_text(docs).select(key, "doc_id", "text"), span, min_words)
    spans = spans.select("span_id", F.struct("doc_id", "n", "cut", "lo", "hi").alias("later"))
    kept = docs.drop("span_id", "later", "span_sentences", "span_removed")
    names = kept.columns
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = kept.withColumn("text", text).withColumn("span_id", F.xxhash64(F.col("doc_id").cast("long"), "text"))
    same = (kept["span_id"] == spans["span_id"]) & kept["doc_id"].cast("long").eqNullSafe(spans["later"]["doc_id"])
    rows = kept.join(spans.hint("merge"), same, "left").select(*(kept[c] for c in names), "later")
    counts = [T.StructField(c, T.LongType()) for c in ("span_sentences", "span_removed")]
    schema = T.StructType([*counts, *rows.drop("later").schema.fields])

    def run(batches):
        for b in batches:
            n, cut, lo, hi = (pc.struct_field(b.column("later"), [k]) for k in (1, 2, 3, 4))
            col = b.column("text")
            if pc.any(pc.greater(cut, 0)).as_py():
                text = [_without(t, a, z) if a else t for t, a, z in zip(col.to_pylist(), lo.to_pylist(), hi.to_pylist(), strict=True)]
                col = pa.array(text, pa.string())
            cols = [col if c == "text" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([n, cut, *cols], names=["span_sentences", "span_removed", *names])

    return rows.mapInArrow(run, schema)


def op3_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = span_dedup(id_text(table(spark, sf_dir, "documents")))
    return out.select("doc_id", F.col("span_sentences").alias("n_sentences"), F.col("span_removed").alias("n_removed"), "text")
