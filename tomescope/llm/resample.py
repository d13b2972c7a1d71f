"""Operator 11: importance resampling towards a target distribution, features hashed by prefix CRCs.

A text becomes its words joined by one space. That string is scanned once, word by word, and the
running CRC-32 before and after every word is stored. The CRC of any run of words then follows from
two of these numbers: ``crc(run) = crc(up to its end) ^ shift(crc(up to its start), bytes of the run)``,
where ``shift`` is the product with ``x ** (8 * bytes)`` in GF(2) modulo the CRC polynomial, done by the
binary digits of the length. So runs of 1, 2, ... n words cost no further look at the text.

Plan: one pass over the texts writes, per document, the feature buckets as packed bytes (the scan of
the text is not done again). Bucket counts are added up per task, then per bucket: at most ``buckets`` rows
(a parameter) reach the driver, whatever the corpus. A pass over the packed buckets sums the gains. Scores are exact
integers; ranks come from a range sort on (score, doc_id, row number) and the row counts of its
partitions, so no task sees all rows and equal scores are spread.

Cases: a null or empty text, or one without a word, has no features, weight 0 and a score, but no rank
while ``least_words`` is positive. A null ``doc_id`` has features that count for the corpus, a null score and no rank. Rows
that repeat a doc_id are documents of their own: their noise is the same, equal scores rank by doc_id,
then by fewer features. An empty target gives every bucket the gain of an unseen one. Empty tables give no rows. Columns
other than the id and the text are not read.
"""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomescope.llm.common import id_text, shuffle_parts, table
from tomescope.operators.joins import bounded_broadcast
from tomescope.session import cut_lineage

MOST_WORDS, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
SCAN_WORDS = 1 << 18  # words scanned at a time
POLYNOMIAL = 0xEDB88320
#: ASCII: letters in lower case and digits stay, all else separates. Bytes of other characters stay.
SEPARATED = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def _times_x(rows: np.ndarray) -> np.ndarray:
    """Each polynomial times x, modulo the CRC's (reflected: the lowest power is the highest bit)."""
    return (rows >> np.uint32(1)) ^ np.where(rows & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given as four tables of 256."""
    out = tables[0][crc & np.uint32(255)]
    for k in (1, 2, 3):
        out ^= tables[k][(crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _as_tables(images: np.ndarray) -> np.ndarray:
    """Four tables of 256 from the images of the 32 single bits."""
    byte = np.arange(256, dtype=np.uint32)
    out = np.zeros((4, 256), dtype=np.uint32)
    for bit in range(32):
        out[bit // 8] ^= np.where(byte >> np.uint32(bit % 8) & np.uint32(1), images[bit], np.uint32(0))
    return out


def _shifts(digits: int) -> list[np.ndarray]:
    """The map ``crc -> crc * x ** (8 * 2 ** d)`` for every binary digit ``d`` of a length in bytes."""
    images = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        images = _times_x(images)
    out = [_as_tables(images)]
    while len(out) < digits:
        images = _apply(out[-1], images)  # the map after itself: twice the length
        out.append(_as_tables(images))
    return out


SHIFTS = _shifts(32)


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """``crc`` moved over ``n_bytes`` bytes."""
    out = crc.copy()
    for d in range(int(n_bytes.max(initial=0)).bit_length()):
        at = np.flatnonzero(n_bytes >> d & 1)
        out[at] = _apply(SHIFTS[d], out[at])
    return out


def prefix_crcs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One scan of ``b" ".join(words)``: CRC before and after every word, and the words' end positions."""
    crc = zlib.crc32
    after = np.fromiter(accumulate(words[1:], lambda c, w: crc(w, crc(b" ", c)), initial=crc(words[0]) if words else 0), np.uint32, max(1, len(words)))[: len(words)]
    before = np.zeros_like(after)
    before[1:] = _after_space(after[:-1])
    return before, after, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1


def _byte_steps() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = _times_x(t)
    return t


BYTE_STEPS = _byte_steps()


def _after_space(crc: np.ndarray) -> np.ndarray:
    """Each CRC taken one space further."""
    raw = ~crc
    return ~(BYTE_STEPS[(raw ^ np.uint32(0x20)) & np.uint32(255)] ^ (raw >> np.uint32(8)))


def run_crcs(words: list[bytes], n: int) -> np.ndarray:
    """CRC-32 of every run of ``n`` words joined by one space, from prefixes alone."""
    before, after, ends = prefix_crcs(words)
    return _runs(before, after, ends, n)


def _runs(before, after, ends, n: int) -> np.ndarray:
    if len(ends) < n:
        return np.zeros(0, dtype=np.uint32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    start = before[: len(ends) - n + 1]
    return after[n - 1 :] ^ shifted(start, ends[n - 1 :] - starts[: len(start)])


def _words_of(raw: bytes, most_words: int):
    """The words of a text, some at a time; every part but the first begins with the last ``most_words - 1`` words of the one before."""
    clean, at, tail = raw.translate(SEPARATED), 0, []
    step = SCAN_WORDS * 8
    while at < len(clean):
        end = len(clean) if at + step >= len(clean) else clean.find(b" ", at + step)
        end = len(clean) if end < 0 else end
        words = clean[at:end].split()
        yield tail + words, len(tail)
        tail = (tail + words)[-(most_words - 1) :] if most_words > 1 else []
        at = end


def text_buckets(text: str, most_words: int = MOST_WORDS, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words, and the buckets of all runs of 1 to ``most_words`` words."""
    n_words, out = 0, []
    for words, seen in _words_of(text.encode("utf-8", "surrogatepass"), most_words):
        n_words += len(words) - seen
        scan = prefix_crcs(words)
        # a run counts in the part that its last word is new in
        out += [_runs(*scan, n)[max(0, seen - n + 1) :] % np.uint32(buckets) for n in range(1, most_words + 1)]
    return n_words, np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def with_buckets(docs: DataFrame, most_words: int, buckets: int) -> DataFrame:
    """``doc_id, n_words, packed``: the feature buckets of each row as packed unsigned integers."""
    kind = _kind(buckets)

    def run(batches):
        for b in batches:
            n_words, packed = [], []
            for text in b.column("text").to_pylist():
                n, found = text_buckets(text, most_words, buckets)
                n_words.append(n)
                packed.append(found.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "n_words", "packed"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, packed binary")


def bucket_counts(featured: DataFrame, buckets: int) -> np.ndarray:
    """Features per bucket over all rows: a sum per task, a sum per bucket, ``buckets`` numbers on the driver."""
    kind = _kind(buckets)

    def run(batches):
        n = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for packed in b.column("packed").to_pylist():
                n += np.bincount(np.frombuffer(packed, kind), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in featured.select("packed").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket ``floor(1000 * ln(target share / corpus share))``, one count added to every bucket, in doubles."""
    size = float(len(corpus))
    total, wanted = float(corpus.sum()) + size, float(target.sum()) + size
    return np.floor(1000.0 * np.log(((target + 1.0) * total) / ((corpus + 1.0) * wanted))).astype(np.int64)


def weights(featured: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the gains of a row's features added up."""
    kind, gain_of = _kind(len(gain)), featured.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        for b in batches:
            packed = [np.frombuffer(p, kind) for p in b.column("packed").to_pylist()]
            sizes, sums = [len(p) for p in packed], [int(gain_of.value[p].sum()) for p in packed]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_words"), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"]
            )

    return featured.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noisy_score(seed: int) -> F.Column:
    """``weight`` plus Gumbel noise in thousandths, from the first 32 bits of sha256 of ``seed:doc_id``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list, most: int, name: str) -> DataFrame:
    """The first ``most`` rows of a global order with ``rank`` from 1: a range sort, numbered by the row counts of its partitions."""
    spark = rows.sparkSession
    ordered = rows.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order)
    ordered = cut_lineage(ordered.withColumn("_at", F.monotonically_increasing_id()), name)
    part, place = F.shiftrightunsigned("_at", 33).cast("int"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["p"], r["n"]) for r in ordered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    first = list(accumulate((n for _, n in sizes), initial=0))
    starts = spark.createDataFrame([(p, f) for (p, _), f in zip(sizes, first, strict=False) if f < most], "_part int, _first long")
    out = ordered.withColumn("_part", part).join(bounded_broadcast(starts, len(sizes), 16), "_part").withColumn("rank", F.col("_first") + place + 1)
    return out.where(F.col("rank") <= most).drop("_at", "_part", "_first")


def resample(
    docs: DataFrame, target: DataFrame, most_words: int = MOST_WORDS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
    percent: int = PERCENT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", name: str = "resample",
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row of ``docs``; ``rank`` is null where a row is not drawn."""
    featured = cut_lineage(with_buckets(id_text(docs, id_col, text_col), most_words, buckets), f"{name}-buckets")
    wanted = with_buckets(id_text(target.withColumn("doc_id", F.lit(0)), "doc_id", target_col), most_words, buckets)
    gain = gains(bucket_counts(featured, buckets), bucket_counts(wanted, buckets))
    scored = weights(featured, gain).withColumn("score", noisy_score(seed)).withColumn("_row", F.monotonically_increasing_id())
    scored = cut_lineage(scored, f"{name}-scores")
    able = scored.where((F.col("n_words") >= least_words) & F.col("doc_id").isNotNull())
    most = percent * able.count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc(), F.col("n_features").asc(), F.col("_row").asc()]
    drawn = ranked(able.select("score", "doc_id", "n_features", "_row"), order, most, f"{name}-ranks").select("_row", "rank")
    return scored.join(drawn, "_row", "left").select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 of each distinct word, byte by byte with a table built from the polynomial.
ORACLE = r"""
WITH RECURSIVE step(b, c, k) AS (
  SELECT CAST(range AS UBIGINT), CAST(range AS UBIGINT), 0 FROM range(256)
  UNION ALL
  SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS UBIGINT)) ELSE c // 2 END, k + 1 FROM step WHERE k < 8
), crc_table AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM step WHERE k = 8),
words AS MATERIALIZED (
  SELECT 0 AS side, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT 1, NULL, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), bytes AS (
  SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM words)
), crcs AS MATERIALIZED (
  SELECT w, xor(list_reduce(
    list_prepend(CAST(4294967295 AS UBIGINT), list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS INTEGER), 2) AS UBIGINT))),
    lambda c, x: xor(c // 256, t[CAST(xor(c % 256, x) AS INTEGER) + 1])), CAST(4294967295 AS UBIGINT)) % 10000 AS bucket
  FROM bytes CROSS JOIN crc_table
), feats AS MATERIALIZED (SELECT side, doc_id, bucket FROM words JOIN crcs USING (w)),
total AS (SELECT CAST(count(*) FILTER (side = 0) AS DOUBLE) AS s, CAST(count(*) FILTER (side = 1) AS DOUBLE) AS t FROM feats),
gain AS (
  SELECT bucket, floor(1000.0 * ln((count(*) FILTER (side = 1) + 1.0::DOUBLE) * (s + 10000) / ((count(*) FILTER (side = 0) + 1.0::DOUBLE) * (t + 10000)))) AS g
  FROM feats CROSS JOIN total GROUP BY bucket, s, t
), weight AS (
  SELECT doc_id, count(*) AS n_features, CAST(sum(g) AS BIGINT) AS weight FROM feats JOIN gain USING (bucket) WHERE side = 0 GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000.0::DOUBLE * ln(-ln((CAST(('0x' || substr(sha256('2024:' || d.doc_id), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM documents d LEFT JOIN weight USING (doc_id)
), ranks AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CASE WHEN r <= 10 * n // 100 THEN CAST(r AS BIGINT) END AS rank
FROM scored LEFT JOIN ranks USING (doc_id)
"""
