"""Operator 13: document fingerprints by order MinHash.

Every k-mer of code points is numbered by its occurrence in the text, so repeats count. For each of
``SKETCHES`` orders the ``PICKS`` smallest numbered k-mers are selected, put back in the order they have in the text,
and the tuple is hashed. Two fingerprints are alike by the share of equal tuples: a tuple is shared only if both texts
hold the k-mers in the same order, so moved and edited text lowers it as edit distance does (a set MinHash does not see moves).

``with_edited`` also fingerprints each document's edited text, which needs the next document in descending id order.
One range sort of the texts puts neighbours side by side; a task streams its rows and keeps one document back. Only
the last row of a partition lacks its neighbour: it leaves with the first row of each partition in the written table, and
these few rows (two per partition) are joined by partition number. K-mers that lie wholly in the part
that an edit keeps are ranked once for both texts.

Cases: a null text is empty. A text shorter than a k-mer is one k-mer, an empty one has none: its tuples are all alike and
its likeness to another empty text is 1. Rows that repeat a doc_id are documents of their own, ordered
by a hash of the text; a null doc_id comes last. A single document is its own next. Empty tables give no rows. Very long texts are ranked in
slices of bounded size. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomescope.llm.common import id_text, shuffle_parts, table
from tomescope.session import cut_lineage

LETTERS, PICKS, SKETCHES = 6, 2, 64
SLICE = 4096  # k-mers ranked at a time
PLACE_BITS = 31  # a text has fewer k-mers than that many bits count (an Arrow string has at most 2 GB)
FREE = np.iinfo(np.int64).max
MIX_A, MIX_B, MIX_C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: an odd multiplier and a mask per order, from a rule
_ORDERS = np.random.Generator(np.random.PCG64(13)).integers(0, 1 << 32, (2, 1024), dtype=np.uint64).astype(np.uint32)
MULTIPLIERS, MASKS = _ORDERS[0] | np.uint32(1), _ORDERS[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * MIX_B
    return (h ^ (h >> np.uint64(32))) * MIX_C


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def numbered_kmers(cp: np.ndarray, letters: int = LETTERS) -> np.ndarray:
    """A 64-bit number for each k-mer with its occurrence number, in text order."""
    n = len(cp) - letters + 1 if len(cp) >= letters else int(len(cp) > 0)
    width = min(letters, len(cp))
    h = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        h = h * MIX_A + cp[j : j + n] + np.uint64(1)
    h = _mix(h)
    return _mix(h + _occurrences(h) * MIX_A)


def _occurrences(h: np.ndarray) -> np.ndarray:
    """How often each (mixed) number came before."""
    n, out = len(h), np.zeros(len(h), dtype=np.uint64)
    if n <= 1 << 16:  # sorted by the upper 48 bits, then by place, as one number
        key = np.sort((h >> np.uint64(16) << np.uint64(16)) | np.arange(n, dtype=np.uint64))
        by, group = (key & np.uint64(0xFFFF)).astype(np.int64), key >> np.uint64(16)
    else:
        by = np.argsort(h, kind="stable")
        group = h[by]
    place = np.arange(n)
    first = np.maximum.accumulate(np.where(np.concatenate(([True], group[1:] != group[:-1])), place, 0)) if n else place
    out[by] = place - first
    return out


def smallest(kmers: np.ndarray, lo: int, hi: int, sketches: int = SKETCHES, picks: int = PICKS) -> np.ndarray:
    """Per order, the ``picks`` least of k-mers ``lo`` to ``hi``: rank and place as one number, ``FREE`` where there are fewer."""
    best, row = np.full((sketches, picks), FREE), np.arange(sketches)
    for at in range(lo, hi, SLICE):
        part = (kmers[at : min(hi, at + SLICE)] >> np.uint64(32)).astype(np.uint32)
        order = part[None, :] ^ MASKS[:sketches, None]
        order *= MULTIPLIERS[:sketches, None]
        found = np.full((sketches, picks), FREE)
        for p in range(min(picks, len(part))):
            least = order.argmin(axis=1)
            found[:, p] = order[row, least].astype(np.int64) << PLACE_BITS | (least + at)
            order[row, least] = np.uint32(0xFFFFFFFF)
        best = found if at == lo else merged(best, found)
    return best


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of two selections."""
    return np.sort(np.concatenate([a, b], axis=1), axis=1)[:, : a.shape[1]]


def tuples(kmers: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """One 32-bit number per order: the chosen k-mers hashed in the order of the text."""
    out = np.full(len(chosen), len(MASKS), dtype=np.uint64)
    if len(kmers):
        places = np.sort(np.where(chosen == FREE, FREE, chosen & ((1 << PLACE_BITS) - 1)), axis=1)
        for p in range(min(places.shape[1], len(kmers))):  # a text of fewer k-mers leaves the last picks free in all orders
            out = _mix(out * MIX_A + kmers[places[:, p]])
    return (out >> np.uint64(32)).astype("<u4")


def sketch(text: str, letters: int = LETTERS, picks: int = PICKS, sketches: int = SKETCHES) -> np.ndarray:
    """The fingerprint of a text: ``sketches`` 32-bit numbers."""
    kmers = numbered_kmers(points(text), letters)
    return tuples(kmers, smallest(kmers, 0, len(kmers), sketches, picks))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprint(docs: DataFrame, letters: int = LETTERS, picks: int = PICKS, sketches: int = SKETCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, fingerprint`` (packed 32-bit numbers) of every row, without a shuffle."""

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            packed = [sketch(t, letters, picks, sketches).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "n_chars", "fingerprint"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, fingerprint binary")


class _Text:
    """A text with its k-mers, the selections of the part an edit keeps and of the rest, and the fingerprint."""

    def __init__(self, doc_id, text: str, settings):
        self.doc_id, self.text, (self.letters, self.picks, self.sketches) = doc_id, text, settings
        kmers = numbered_kmers(points(text), self.letters)
        self.kept = len(text) - len(text) // 2
        self.cut = max(0, self.kept - self.letters + 1) if len(text) >= self.letters else 0  # k-mers wholly in the kept part
        self.head = smallest(kmers, 0, self.cut, self.sketches, self.picks)
        self.print = tuples(kmers, merged(self.head, smallest(kmers, self.cut, len(kmers), self.sketches, self.picks)))

    def edited(self, following: str) -> tuple[str, np.ndarray]:
        text = self.text[: self.kept] + following[: len(self.text) // 2]
        kmers = numbered_kmers(points(text), self.letters)
        cut = self.cut if len(text) >= self.letters else 0
        head = self.head if cut == self.cut else smallest(kmers, 0, cut, self.sketches, self.picks)
        return text, tuples(kmers, merged(head, smallest(kmers, cut, len(kmers), self.sketches, self.picks)))


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
NAMES = [c.split()[0] for c in RESULT.split(", ")]
ENDS = ", part int, is_first boolean, is_last boolean, text string"


def _result(doc: _Text, following: str, following_print: np.ndarray) -> tuple:
    text, edited = doc.edited(following)
    sha = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
    return doc.doc_id, len(doc.text), sha, doc.print.tobytes(), edited.tobytes(), likeness(doc.print, edited), likeness(doc.print, following_print)


def _as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


RESULT_ARROW = pa.schema(list(zip(NAMES, [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()], strict=True)))
ENDS_ARROW = pa.schema([*RESULT_ARROW, ("part", pa.int32()), ("is_first", pa.bool_()), ("is_last", pa.bool_()), ("text", pa.string())])


def with_edited(
    docs: DataFrame, letters: int = LETTERS, picks: int = PICKS, sketches: int = SKETCHES, id_col: str = "doc_id", text_col: str = "text", name: str = "fingerprints"
) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row (fingerprints packed)."""
    settings = (letters, picks, sketches)
    # the row number only parts rows of equal id and text, whose order does not change any result
    rows = id_text(docs, id_col, text_col).withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.col("doc_id").desc_nulls_last(), F.col("h").asc(), F.col("row").asc()]
    ordered = rows.repartitionByRange(shuffle_parts(docs.sparkSession), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        part, doc = TaskContext.get().partitionId(), None
        for b in batches:
            out = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                new = _Text(doc_id, text, settings)
                if doc is None:
                    out.append((doc_id, None, None, new.print.tobytes(), None, None, None, part, True, False, text))
                else:
                    out.append((*_result(doc, text, new.print), part, False, False, None))
                doc = new
            if out:
                yield _as_batch(out, ENDS_ARROW)
        if doc is not None:
            yield _as_batch([(doc.doc_id, None, None, None, None, None, None, part, False, True, doc.text)], ENDS_ARROW)

    written = cut_lineage(ordered.mapInArrow(run, RESULT + ENDS), name)
    done = written.where(~F.col("is_first") & ~F.col("is_last")).select(*NAMES)
    parts = sorted(r["part"] for r in written.where("is_first").select("part").collect())  # numbers of the partitions that hold rows
    follows = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next_part int")
    firsts = written.where("is_first").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    open_ends = written.where("is_last").select("part", "doc_id", "text").join(follows, "part").join(firsts, "next_part")

    def close(batches):
        for b in batches:
            out = [_result(_Text(r["doc_id"], r["text"], settings), r["next_text"], np.frombuffer(r["next_print"], "<u4")) for r in b.to_pylist()]
            if out:
                yield _as_batch(out, RESULT_ARROW)

    return done.union(open_ends.select("doc_id", "text", "next_text", "next_print").mapInArrow(close, RESULT))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_edited(table(spark, sf_dir, "documents"))
    prints = {c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")}
    return out.withColumns(prints)
