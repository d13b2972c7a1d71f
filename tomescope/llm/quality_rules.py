"""Operator 2: quality rules by hashed n-gram log-likelihood ratio.

Word 1- and 2-grams are hashed into ``2**BITS`` buckets. Two multinomials are counted over all rows:
the trusted target (documents labelled quality 1) and the raw corpus (every document). A bucket's ratio
is log((target + s) / (expected + s)), expected being the target's count if it were like the corpus; the
smoothing s draws rare buckets, of which the counts say little, towards 0.
A document's score is the mean of log(target / raw) over its n-grams, so length cancels; it is
kept where the score is at least ``THRESHOLD`` and no base rule fails. The threshold is a constant,
so the same document and the same counts always give the same verdict.
On tables of a few hundred documents most ratios are drawn to 0 and the verdict is weak: of the unlabelled documents
it rejects 0 of 113 (sf0.001), 34 of 601 (sf0.01) and 389 of 6,020 (sf0.1) that no base rule fails.

Plan: documents are joined with the target's ids once to count (the ids are broadcast while their counted
rows fit the broadcast budget, else both sides are shuffled; bucket sums are added up in each task
before they are shuffled: at most ``2**BITS`` rows a task), and scanned again to score. What
goes through the driver is the table of bucket ratios, ``2**BITS`` floats whatever the input.

Cases: a null or empty text has no words, fails the base rule and is not kept. Without labelled
documents the target equals the corpus, every ratio is 0 and the base rules decide. Labels that are
null are no target; a ``doc_id`` of the target counts each of its rows. Repeated rows and null
``doc_id`` are scored like any other. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomescope.config import DEFAULT
from tomescope.llm.common import id_text, table
from tomescope.llm.words import M1, M2, M3, buckets, ngrams, split_words, stable_hashes
from tomescope.operators.joins import bounded_broadcast
from tomescope.session import cut_lineage

BITS = 16
SMOOTHING = 30.0
THRESHOLD = -0.08
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def base_stats(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    word_chars = len(text) - sum(map(text.count, _SPACE))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_SPACE)] if "\n" in text else []
    return word_chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which comes twice or more."""
    if len(words) < 4:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        w = h[:-2] * M1 + (h[1:-1] ^ (h[:-2] >> np.uint64(31))) * M2 + (h[2:] ^ (h[1:-1] >> np.uint64(27))) * M3
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    seen = np.zeros(len(w) + 2, dtype=bool)
    twice = np.concatenate((order[1:][same], order[:-1][same]))
    for k in range(3):
        seen[twice + k] = True
    return int(seen.sum())


def hashed_ngrams(words: list[bytes], bits: int = BITS) -> np.ndarray:
    """Buckets of all word 1- and 2-grams, repeats included."""
    h = stable_hashes(words)
    return np.concatenate((buckets(ngrams(h, 1), bits), buckets(ngrams(h, 2), bits)))


def count_ngrams(docs: DataFrame, labels: DataFrame, bits: int = BITS) -> DataFrame:
    """``bucket, raw, target``: n-gram counts over all documents and over those labelled quality 1."""
    trusted = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    trusted = cut_lineage(trusted.withColumn("trusted", F.lit(True)), "trusted")
    rows = id_text(docs).join(bounded_broadcast(trusted, trusted.count(), 32, DEFAULT), "doc_id", "left")

    def run(batches):
        counts = np.zeros((2, 1 << bits), dtype=np.int64)
        for b in batches:
            for text, is_target in zip(b.column("text").to_pylist(), b.column("trusted").to_pylist(), strict=True):
                found = np.bincount(hashed_ngrams(split_words(text), bits), minlength=1 << bits)
                counts[0] += found
                if is_target:
                    counts[1] += found
        at = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0][at]), pa.array(counts[1][at])], names=["bucket", "raw", "target"])

    parts = rows.select("text", "trusted").mapInArrow(run, "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, bits: int = BITS, smoothing: float = SMOOTHING) -> np.ndarray:
    """log(target / raw) of each bucket; all zero without target counts. ``2**bits`` rows at most are fetched."""
    got = counts.toArrow()
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    at = got.column("bucket").to_numpy()
    raw[at], target[at] = got.column("raw").to_numpy(), got.column("target").to_numpy()
    if not target.sum():
        return np.zeros(1 << bits, dtype=np.float32)
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + smoothing) / (expected + smoothing)).astype(np.float32)


def verdict(text: str, ratio: np.ndarray, threshold: float, bits: int) -> tuple:
    """n_words, the four base counts, base_failed, llr, kept of one text."""
    words = split_words(text)
    n, stats = len(words), base_stats(text, words)
    failed = n < MIN_WORDS or 100 * stats[3] > MAX_REPEAT_PERCENT * n
    llr = float(ratio[hashed_ngrams(words, bits)].mean(dtype=np.float64)) if n else 0.0
    return n, *stats, failed, llr, not failed and llr >= threshold


def score(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, llr, kept."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # 2**bits floats
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]

    def run(batches):
        for b in batches:
            rows = [verdict(t, shared.value, threshold, bits) for t in b.column("text").to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=names)

    return id_text(docs).mapInArrow(
        run,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, llr double, kept boolean",
    )


def keep_good(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD, bits: int = BITS, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep; one pass, no join."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([verdict(t or "", shared.value, threshold, bits)[-1] for t in b.column(text_col).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return score(docs, log_ratios(count_ngrams(docs, labels)), threshold)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
