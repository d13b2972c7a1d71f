"""Operators 2 and 9."""

import collections
import re
import zlib

import numpy as np
from conftest import SF_ORACLE
from llm_cases import documents, prose, split_words
from pyspark.sql import functions as F

from tomescope.llm import classifier, quality_rules
from tomescope.llm.words import split_words as fast_words


def base(t):
    w = split_words(t)
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if split_words(line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit)


def labels(spark, docs):
    return docs.where("doc_id is not null").select("doc_id", F.when(F.col("text").contains("&&&"), 0).when(F.col("doc_id") == 7, None).otherwise(1).alias("quality")).withColumn("toxic", F.lit(0))


def test_quality_rules_by_brute_force(spark):
    docs = documents(spark)
    lab = labels(spark, docs)
    trusted = {r.doc_id for r in lab.collect() if r.quality == 1}
    size = 1 << quality_rules.BITS
    raw, target = np.zeros(size), np.zeros(size)
    for r in docs.collect():
        c = np.bincount(quality_rules.hashed_ngrams(fast_words(r.text or "")), minlength=size)
        raw += c
        target += c * (r.doc_id in trusted)
    ratio = np.log((target + quality_rules.SMOOTHING) / (raw * target.sum() / raw.sum() + quality_rules.SMOOTHING))
    want = []
    for r in docs.collect():
        b = base(r.text)
        g = quality_rules.hashed_ngrams(fast_words(r.text or ""))
        llr = float(ratio[g].mean()) if len(g) else 0.0
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        want.append((r.doc_id, *b, failed, round(llr, 4), not failed and llr >= quality_rules.THRESHOLD))
    rows = quality_rules.quality_rules(docs, lab).collect()
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, round(r.llr, 4), r.kept) for r in rows]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_rules_without_labels_or_rows(spark):
    docs = documents(spark)
    none = labels(spark, docs).where("false")
    rows = {r.doc_id: r for r in quality_rules.quality_rules(docs, none).collect()}
    assert rows[17].kept and not rows[7].kept and rows[4].llr == 0
    assert quality_rules.quality_rules(docs.where("false"), none).count() == 0


def test_classifier_held_out_accuracy(spark):
    docs, lab = (spark.read.parquet(f"{SF_ORACLE}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in classifier.score(docs, classifier.train(docs, lab)).collect()}
    held = [(rows[r.doc_id].predicted, r.quality) for r in lab.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(rows) == docs.count() and np.mean([a == b for a, b in held]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in rows.items())
    flipped = lab.withColumn("quality", F.when(classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in classifier.score(docs, classifier.train(docs, flipped)).collect()}
    assert again == {i: r.score for i, r in rows.items()}  # held-out labels are not looked at


def test_classifier_cases(spark):
    rows = [(i, prose(80, i) if i % 2 else "of%%% the&&& " * (20 + i), "en", "s", 1) for i in range(60)]
    docs = documents(spark, rows + [(None, prose(70, 99), "en", "s", 1), (1000, None, "en", "s", 1), (1001, "", "en", "s", 1), (3, prose(80, 3), "en", "s", 1)])
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(5, 0, 0), (7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = classifier.score(docs, classifier.train(docs, lab)).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 64 and by[5].predicted == 1 and by[6].predicted == 0 and by[None].held_out is False
    assert by[1000].score == by[1001].score and len({r.score for r in out if r.doc_id == 3}) == 1
    empty = classifier.train(docs.where("false"), lab.where("false"))
    assert {r.score for r in classifier.score(docs, empty).collect()} == {0.5} and classifier.score(docs.where("false"), empty).count() == 0


def test_dual_descent_reaches_the_optimum():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 40, 12)) for _ in range(120)]
    y = np.array([int(5 in s or 7 in s) for s in sets])
    w, b = classifier.dual_descent(sets, y, np.ones(40), passes=400)
    sign = np.where(y == 1, 1, -1)
    x = np.zeros((120, 41))
    for i, s in enumerate(sets):
        x[i, s], x[i, 40] = 1 / np.sqrt(len(s)), 1
    full = np.append(w, b)
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - sign * (x @ v)).sum()
    assert all(loss(full) <= loss(full + d) + 1e-3 for d in r.normal(0, 0.05, (300, 41)))
