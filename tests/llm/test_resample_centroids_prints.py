"""Operators 11, 12 and 13 against brute force."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from conftest import SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import CLASHES, documents, prose
from pyspark.sql import functions as F

from tomescope.llm import centroids, fingerprints, resample

# --- 11 ------------------------------------------------------------------------------


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def features(t, most):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
    return len(w), [" ".join(w[i : i + n]).encode() for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def resample_brute(rows, target, most, buckets, least, percent, seed):
    """Per row (doc_id, n_features, weight, score, rank), from CRCs of the features themselves."""
    found = [features(t, most) for _, t in rows]
    count = lambda sets: np.bincount([zlib.crc32(x) % buckets for f in sets for x in f], minlength=buckets)
    s, t = count([f for _, f in found]), count([features(x, most)[1] for x in target])
    gain = [math.floor(1000 * math.log((float(b) + 1) * (float(s.sum()) + buckets) / ((float(a) + 1) * (float(t.sum()) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for (i, _), (n, f) in zip(rows, found, strict=True):
        weight = sum(gain[zlib.crc32(x) % buckets] for x in f)
        if i is None:
            out.append([i, len(f), weight, None, None, n])
            continue
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least and r[0] is not None), key=lambda r: (-r[3], r[0], r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def resampled(df):
    return [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()]


ORDER = lambda r: tuple(str(x) for x in r)


@pytest.mark.parametrize(("most", "buckets", "percent", "words"), [(1, 10_000, 10, 1 << 18), (3, 70_000, 60, 1 << 18), (2, 97, 50, 16)])
def test_resample_by_brute_force(spark, most, buckets, percent, words, monkeypatch):
    monkeypatch.setattr(resample, "SCAN_WORDS", words)
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    target = [prose(50, 1), None, "", "The AND of; 日本 é"]
    wanted = spark.createDataFrame([(x, 1) for x in target], "text string, doc_id int").withColumn("bucket", F.lit("x"))
    got = resampled(resample.resample(docs, wanted, most, buckets, 20, percent, 7))
    assert sorted(got, key=ORDER) == sorted(resample_brute(rows, target, most, buckets, 20, percent, 7), key=ORDER)


def test_resample_of_nothing(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    none = docs.where("false").select("text")
    assert resampled(resample.resample(docs.where("false"), docs)) == []
    got = resampled(resample.resample(docs, none, least_words=0, percent=100))
    assert sorted(got, key=ORDER) == sorted(resample_brute(rows, [], 1, 10_000, 0, 100, 2024), key=ORDER)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=300).map(lambda b: b.replace(b" ", b"_")), max_size=30), st.integers(1, 4))
def test_run_crcs_equal_crcs_of_the_runs(words, n):
    assert resample.run_crcs(words, n).tolist() == [zlib.crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]


def test_shift_over_long_gaps():
    gaps = np.array([0, 1, 7, 255, 4096, 1_000_003])
    crc = np.full(len(gaps), 0xDEADBEEF, dtype=np.uint32)
    tail = [bytes(int(g)) for g in gaps]
    head = b"some text before"
    got = resample.shifted(np.full(len(gaps), zlib.crc32(head), dtype=np.uint32), gaps)
    assert got.tolist() == [zlib.crc32(head + t) ^ zlib.crc32(t) for t in tail] and (resample.shifted(crc[:1], gaps[:1]) == crc[:1]).all()


def test_ranks_over_partitions(spark):
    """Equal scores go by doc_id, whatever the partitions."""
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("score"))
    got = resample.ranked(rows, [F.col("score").desc(), F.col("doc_id").asc()], 3000, "test-ranks").collect()
    want = sorted(range(5000), key=lambda i: (-(i % 3), i))[:3000]
    assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"])] == want and sorted(r["rank"] for r in got) == list(range(1, 3001))


# --- 12 ------------------------------------------------------------------------------


def clusters_brute(rows, k, rounds, dim, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [v for _, v in start[:k]]

    def near(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in cents]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[0], []).append(v)
        cents = [[sum(col) // len(groups[j]) for col in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(cents)]
    found = [(i, *near(v)) for i, v in kept]
    per = {j: sum(d for _, c, d in found if c == j) for j in {c for _, c, _ in found}}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return [(i, c, d, per[c], sum(per.values()), sha[c]) for i, c, d in found]


def vector_rows(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in CLASHES})


def clustered(vectors, **kw):
    out = centroids.with_inertia(*centroids.cluster(vectors, **kw))
    return [(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out.collect()]


@pytest.mark.parametrize(("dim", "block", "chunk", "k"), [(5, 2, 32768, 4), (5, 1, 7, 16), (5, 3, 50, 1), (5, 8, 64, 500)])
def test_clusters_by_brute_force(spark, dim, block, chunk, k, monkeypatch):
    monkeypatch.setattr(centroids, "SUMS_AT_A_TIME", 100)
    r = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(r.normal(size=(120, dim)).round(1))]
    rows += [(7, rows[7][1]), (900, [0.25] * dim)] + [(1000 + i, [0.25] * dim) for i in range(80)]  # a third of the rows are one vector
    rows += [(2000, None), (2001, [1.0] * (dim - 1)), (2002, [float("nan")] * dim), (2003, [float("inf")] * dim), (2004, [None] * dim), (2005, [-1e6] * dim), (None, [0.5] * dim), (-3, [])]
    got = clustered(vector_rows(spark, rows), dim=dim, k=k, scale=10, block_dims=block, chunk_rows=chunk)
    assert sorted(got, key=ORDER) == sorted(clusters_brute(rows, k, 3, dim, 10, 1), key=ORDER)


def test_clusters_of_odd_tables(spark):
    assert clustered(vector_rows(spark, [])) == [] and clustered(vector_rows(spark, [(1, None)])) == []
    wide = [(i, [float((i * 7919) % 100_003) * 2.0**20 * (-1) ** i] * 3) for i in range(40)]  # dictionaries beyond 64-bit keys
    with pytest.raises(Exception, match="64 bits"):
        clustered(vector_rows(spark, [(1, [1e300] * 3)]), dim=3)
    fits = [(i, [x / 2.0**16 for x in v]) for i, v in wide]
    got = clustered(vector_rows(spark, fits), dim=3, k=3, scale=64)
    assert sorted(got, key=ORDER) == sorted(clusters_brute(fits, 3, 3, 3, 64, 1), key=ORDER)


def test_dictionaries_lose_nothing():
    r = np.random.default_rng(9)
    for x in (r.integers(-9, 9, (300, 7)), r.integers(-(2**40), 2**40, (50, 7)), np.zeros((5, 7), dtype=np.int64)):
        b = centroids.encode_chunk(np.arange(len(x)), np.zeros(len(x), bool), x, 2)
        blocks = centroids.decode_chunk(b.to_pylist()[0], 7, 2)
        assert (np.concatenate([e[c] for e, c in blocks], axis=1) == x).all()
        assert all(len(np.unique(e, axis=0)) == len(e) for e, _ in blocks)


# --- 13 ------------------------------------------------------------------------------

M = 2**64 - 1


def mix_brute(h):
    h = (h ^ (h >> 29)) * int(fingerprints.MIX_B) & M
    return (h ^ (h >> 32)) * int(fingerprints.MIX_C) & M


def sketch_brute(text, letters=6, picks=2, sketches=64):
    """Straight from the definition: all numbered k-mers sorted in every order."""
    grams = [text[i : i + letters] for i in range(len(text) - letters + 1)] if len(text) >= letters else [text] * (len(text) > 0)
    seen, numbers = {}, []
    for g in grams:
        h = 0
        for c in g:
            h = (h * int(fingerprints.MIX_A) + ord(c) + 1) & M
        seen[g] = seen.get(g, -1) + 1
        numbers.append(mix_brute((mix_brute(h) + seen[g] * int(fingerprints.MIX_A)) & M))
    out = []
    for j in range(sketches):
        mult, mask = int(fingerprints.MULTIPLIERS[j]), int(fingerprints.MASKS[j])
        order = sorted(range(len(numbers)), key=lambda i: (((numbers[i] >> 32) ^ mask) * mult & 0xFFFFFFFF, i))
        h = len(fingerprints.MASKS)
        for i in sorted(order[:picks]):
            h = mix_brute((h * int(fingerprints.MIX_A) + numbers[i]) & M)
        out.append(h >> 32)
    return out


@pytest.mark.parametrize(("letters", "picks", "size"), [(6, 2, 4096), (3, 4, 50)])
def test_sketches_by_brute_force(letters, picks, size, monkeypatch):
    monkeypatch.setattr(fingerprints, "SLICE", size)
    for t in ("", "a", "abcde", "abcdef", "aaaaaaaaaaaaaaa", prose(150, 3), "日本é😀" * 40, "ab" * 300):
        assert fingerprints.sketch(t, letters, picks, 16).tolist() == sketch_brute(t, letters, picks, 16)


def test_occurrences_of_short_and_long_rows():
    r = np.random.default_rng(1)
    for n in (0, 1, 500, (1 << 16) + 40):
        h = r.integers(0, max(1, n // 3), n).astype(np.uint64) << np.uint64(20)
        seen, want = {}, []
        for x in h.tolist():
            seen[x] = seen.get(x, -1) + 1
            want.append(seen[x])
        assert fingerprints._occurrences(h).tolist() == want


def test_likeness_follows_edits_and_order():
    t = prose(400, 5)
    base = fingerprints.sketch(t)
    words = t.split()
    alike = []
    for edits in (1, 10, 40, 200):
        w = list(words)
        for k in range(edits):
            w[(k * 397) % len(w)] = f"new{k}"
        alike.append(fingerprints.likeness(base, fingerprints.sketch(" ".join(w))))
    assert alike == sorted(alike, reverse=True) and alike[0] > 0.85 and alike[-1] < 0.3
    moved = " ".join(words[::-1])
    swapped = fingerprints.sketch(" ".join(words[200:] + words[:200]))
    assert 0.3 < fingerprints.likeness(base, swapped) < 0.7  # the same k-mers but for the seam; half of all pairs keep their order
    assert fingerprints.likeness(base, fingerprints.sketch(moved)) < 0.3
    assert fingerprints.likeness(base, fingerprints.sketch(prose(400, 6, 5000))) < 0.05


def edited_brute(rows):
    """Rows in the operator's order: (doc_id, n_chars, sha256, both fingerprints, likenesses)."""
    out = []
    for k, (i, t) in enumerate(rows):
        n, follow = len(t), rows[(k + 1) % len(rows)][1]
        e = t[: n - n // 2] + follow[: n // 2]
        a, b, c = (fingerprints.sketch(x) for x in (t, e, follow))
        out.append((i, n, hashlib.sha256(e.encode()).hexdigest(), a.tobytes(), b.tobytes(), float(np.mean(a == b)), float(np.mean(a == c))))
    return out


def edited(df):
    return [(r.doc_id, r.n_chars, r.edited_sha256, bytes(r.fingerprint), bytes(r.edited_fingerprint), r.near_edited, r.near_next) for r in df.collect()]


def test_edited_texts_by_brute_force(spark):
    docs = documents(spark)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = [(r.doc_id, r.text) for r in keyed.orderBy(F.col("doc_id").desc_nulls_last(), "h").collect()]
    want = sorted(edited_brute(rows), key=ORDER)
    assert sorted(edited(fingerprints.with_edited(docs)), key=ORDER) == want
    assert sorted(edited(fingerprints.with_edited(docs.coalesce(1))), key=ORDER) == want
    plain = {(r.doc_id, bytes(r.fingerprint)) for r in fingerprints.fingerprint(docs).collect()}
    assert plain == {(r[0], r[3]) for r in want}


def test_edited_texts_of_few_rows(spark):
    assert edited(fingerprints.with_edited(documents(spark, []))) == []
    one = [(3, prose(40, 8))]
    got = edited(fingerprints.with_edited(documents(spark, [(i, t, "", "", 0) for i, t in one])))
    assert got == edited_brute(one) and got[0][6] == 1.0
    same = [(1, "x y z")] * 9  # a repeated row
    got = edited(fingerprints.with_edited(documents(spark, [(i, t, "", "", 0) for i, t in same])))
    assert got == edited_brute(same)


def test_fingerprint_query(spark):
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fingerprints.op13_fingerprints(spark, SF_SMALL).collect()]
    rows = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()), reverse=True)
    assert sorted(got) == sorted((i, n, s, a.hex(), b.hex(), x, y) for i, n, s, a, b, x, y in edited_brute(rows))
    texts = dict(rows)
    prints = {}
    for r in got:
        assert prints.setdefault(texts[r[0]], r[3]) == r[3]  # equal texts, equal fingerprints
    assert np.mean([r[5] > r[6] for r in got]) > 0.8
