"""Operator 9: quality classifier, Naive Bayes features in a linear support vector machine.

A document is the set of its hashed n-grams: word 1- and 2-grams, and 1- to 3-grams of word
shapes (letters, digits and signs as classes, runs as one, and a mark on a word that repeats the word
before). Each indicator is scaled by the class log-count ratio of its n-gram, the vector is brought to
unit length, and a hinge-loss linear model is fitted by dual coordinate descent. A logistic
curve fitted on rows the machine has not seen turns margins into scores from 0 to 1.

Fitting uses a bounded sample: per class the ``FIT_ROWS`` training labels with the smallest hashed
``doc_id`` (parameter; 2 x ``FIT_ROWS`` rows at most reach the driver as n-gram numbers, each as
long as its text's set of n-grams). Scoring is one pass over all documents without shuffle.
Rows whose crc32(doc_id) mod 4 is 2 are never fitted on; labels, lang, source and doc_id are no
inputs of a score.

Cases: a null or empty text has no n-grams and gets the score of the machine's offset. With no
training rows, or rows of one class, every score is that class's share (0.5 with none). Null
labels are ignored, contradicting labels of one doc_id too. Null ``doc_id``: held_out is false, the
text is scored. Repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomescope.llm.common import id_text, table
from tomescope.llm.words import buckets, ngrams, split_words, stable_hashes

WORD_BITS, SHAPE_BITS = 17, 14
N_FEATURES = (1 << WORD_BITS) + (1 << SHAPE_BITS)
FIT_ROWS = 3000
HOLD_FOLDS, HELD = 4, 2
CUT = 0.7
_SHAPES = bytes(
    97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256)
)


def features(text: str) -> np.ndarray:
    """Sorted numbers of the n-grams a text holds."""
    words = split_words(text)
    if not words:
        return np.zeros(0, dtype=np.int32)
    h = stable_hashes(words)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_SHAPES), dtype=np.uint8)
    shapes = stable_hashes(raw[np.concatenate(([True], raw[1:] != raw[:-1]))].tobytes().split())
    again = np.concatenate(([False], h[1:] == h[:-1]))
    shapes = shapes + (again.astype(np.uint64) << np.uint64(33))
    parts = [buckets(ngrams(h, n), WORD_BITS) for n in (1, 2)]
    parts += [(1 << WORD_BITS) + buckets(ngrams(shapes, n), SHAPE_BITS) for n in (1, 2, 3)]
    return np.unique(np.concatenate(parts)).astype(np.int32)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % HOLD_FOLDS == HELD, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[np.ndarray], np.ndarray]:
    """N-gram sets and labels of the bounded sample, in the order of the hashed doc_id."""
    one = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = one.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("y"), F.max("quality").alias("z"))
    one = one.where(F.col("y") == F.col("z")).select("doc_id", "y", F.xxhash64("doc_id").alias("h"))
    picked = None
    for y in (0, 1):
        part = one.where(F.col("y") == y).orderBy("h", "doc_id").limit(fit_rows)
        picked = part if picked is None else picked.union(part)

    def run(batches):
        for b in batches:
            sets = [features(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), b.column("h"), pa.array(sets, pa.binary())], names=["doc_id", "y", "h", "f"])

    rows = id_text(docs).join(F.broadcast(picked), "doc_id")  # 2 * fit_rows ids at most
    rows = rows.groupBy("doc_id", "y", "h").agg(F.max("text").alias("text"))  # an id that repeats counts once, with a text if it has one
    got = rows.mapInArrow(run, "doc_id long, y int, h long, f binary").toArrow()
    order = np.lexsort((got.column("doc_id").to_numpy(), got.column("h").to_numpy()))
    sets, y = got.column("f").to_pylist(), got.column("y").to_numpy()
    return [np.frombuffer(sets[i], dtype=np.int32) for i in order], y[order]


def count_ratios(sets: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Class log-count ratio of every n-gram (documents that hold it, smoothed)."""
    per = [alpha + np.bincount(np.concatenate([s for s, v in zip(sets, y, strict=True) if v == c] or [np.zeros(0, int)]), minlength=N_FEATURES) for c in (0, 1)]
    return np.log((per[1] / per[1].sum()) / (per[0] / per[0].sum()))


def dual_descent(sets: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: float = 1.0, passes: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Hinge-loss linear machine by dual coordinate descent (the bias is a last, constant feature)."""
    w, bias = np.zeros(len(r)), 0.0
    vals = [r[s] / max(1e-12, float(np.sqrt((r[s] ** 2).sum()))) for s in sets]
    sign = np.where(y == 1, 1.0, -1.0)
    alpha = np.zeros(len(sets))
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(sets)):
            s, v = sets[i], vals[i]
            g = sign[i] * (float(w[s] @ v) + bias) - 1.0
            new = min(max(alpha[i] - g / (float(v @ v) + 1.0), 0.0), cost)
            if step := (new - alpha[i]) * sign[i]:
                w[s] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def logistic_curve(margin: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset of the score's logistic curve (Newton steps, targets drawn in as Platt does)."""
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, c = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + c, -30, 30)))
        d, h = p - t, np.maximum(p * (1 - p), 1e-9)
        ga, gc = float(d @ margin), float(d.sum())
        haa, hac, hcc = float(h @ margin**2) + 1e-6, float(h @ margin), float(h.sum()) + 1e-6
        det = haa * hcc - hac * hac
        da, dc = (hcc * ga - hac * gc) / det, (haa * gc - hac * ga) / det
        size = max(1.0, abs(da), abs(dc))
        a, c = max(a - da / size, 1e-3), c - dc / size
        if abs(da) + abs(dc) < 1e-6:
            break
    return a, c


def fit(sets: list[np.ndarray], y: np.ndarray) -> dict:
    """The model: per n-gram weight and squared scale, offset, slope."""
    if len(set(y.tolist())) < 2:
        share = float(np.mean(y)) if len(y) else 0.5
        p = min(max(share, 1e-6), 1 - 1e-6)
        return {"w": np.zeros(N_FEATURES, np.float32), "r2": np.ones(N_FEATURES, np.float32), "bias": 0.0, "a": 1.0, "c": float(np.log(p / (1 - p)))}
    part = np.arange(len(sets)) % 4 == 3  # every fourth row by hashed doc_id sets the curve
    fit_sets, rest = [s for s, p in zip(sets, part, strict=True) if not p], [s for s, p in zip(sets, part, strict=True) if p]
    r = count_ratios(fit_sets, y[~part])
    w, bias = dual_descent(fit_sets, y[~part], r)
    model = {"w": (w * r).astype(np.float32), "r2": (r * r).astype(np.float32), "bias": bias}
    a, c = logistic_curve(np.array([margin(s, model) for s in rest]), y[part])
    return model | {"a": a, "c": c}


def margin(s: np.ndarray, model: dict) -> float:
    if not len(s):
        return model["bias"]
    return float(model["w"][s].sum(dtype=np.float64)) / max(1e-12, float(np.sqrt(model["r2"][s].sum(dtype=np.float64)))) + model["bias"]


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    return fit(*training_sample(docs, labels, fit_rows))


def score(docs: DataFrame, model: dict, cut: float = CUT) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 floats an n-gram number, fixed in size

    def run(batches):
        m = shared.value
        for b in batches:
            z = np.array([m["a"] * margin(features(t), m) + m["c"] for t in b.column("text").to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array((p >= cut).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = id_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: dict, cut: float = CUT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``cut``; one pass, no join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            z = np.array([m["a"] * margin(features(t or ""), m) + m["c"] for t in b.column(text_col).to_pylist()])
            yield b.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))) >= cut))

    return docs.mapInArrow(run, docs.schema)


def op9_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
