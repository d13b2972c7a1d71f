"""Operators 3, 4, 10 and their parts against brute force."""

import collections
import hashlib

import numpy as np
import pytest
from conftest import SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import documents, prose, split_words
from test_span_runs import brute as span_brute

from tomescope.llm import components, near_dups, span_dups, suffix_dups


def test_components_by_brute_force(spark):
    r = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(500 + k, 501 + k) for k in range(40)] + [(900, 1000 + k) for k in range(50)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_spans(spark):
    docs = documents(spark)
    out = span_dups.span_dedup(docs)
    assert out.columns == ["span_sentences", "span_removed", *[c for c in docs.columns if c not in ("span_id", "later")]]
    got = [(r.doc_id, r.span_removed, r.text) for r in out.collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(span_brute([(r.doc_id, r.text) for r in docs.collect()]), key=key)
    by = {i: t for i, _, t in got}
    passage = prose(90, 2)
    assert passage in by[11] and sum(w in by[12] for w in passage.split(". ")[1:-1]) <= 1  # caught but for its ragged ends
    assert span_dups.span_dedup(docs.where("false")).count() == 0


def test_span_query(spark):
    got = [(r.doc_id, r.n_removed, r.text) for r in span_dups.op3_span_dedup(spark, SF_SMALL).collect()]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert sorted(got) == sorted(span_brute(rows))


def near_brute(rows, size, percent):
    sets = []
    for _, t in rows:
        w = split_words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        n = min(size, len(w))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset())
    groups = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None and sets[k]:
            groups[sets[k]].append(k)
    names = list(groups)
    root = list(range(len(names)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(names)):
        for b in range(a):
            if 100 * len(names[a] & names[b]) >= percent * len(names[a] | names[b]):
                root[find(a)] = find(b)
    least = collections.defaultdict(lambda: 2**62)
    for a, s in enumerate(names):
        least[find(a)] = min(least[find(a)], *(rows[k][0] for k in groups[s]))
    out = []
    for k, (i, _) in enumerate(rows):
        c = i if i is None or not sets[k] else least[find(names.index(sets[k]))]
        out.append((i, len(sets[k]), c, i is None or i == c))
    return out


def chain(n):
    """Near copies, each some words from the last: links make one chain."""
    w = prose(220, 50).split()
    rows = []
    for k in range(n):
        w = list(w)
        w[(k * 7) % 220] = f"edit{k}"
        rows.append((5000 + k, " ".join(w), "en", "s", 1))
    return rows


@pytest.mark.parametrize(("size", "percent", "chunk"), [(3, 85, 768), (5, 80, 6)])
def test_near_duplicates_by_brute_force(spark, size, percent, chunk, monkeypatch):
    monkeypatch.setattr(near_dups, "CHUNK", chunk)
    monkeypatch.setattr(near_dups, "DELEGATES", 2)
    monkeypatch.setattr(near_dups.confirmed_links, "__defaults__", (chunk,))
    docs = documents(spark).union(documents(spark, chain(40)))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dups.near_duplicates(docs, size, percent).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(near_brute(rows, size, percent), key=key)


def test_near_duplicates_of_nothing(spark):
    assert near_dups.near_duplicates(documents(spark, [])).count() == 0
    got = near_dups.near_duplicates(documents(spark, [(1, None, "", "", 0), (2, "", "", "", 0)])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_odd_sketches_estimate():
    r = np.random.default_rng(5)
    errors = []
    for j in (0.8, 0.85, 0.95):
        for _ in range(40):
            n = 600
            both = int(2 * n * j / (1 + j))
            pool = r.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
            a, b = pool[:n], pool[n - both :]
            sk = [np.frombuffer(near_dups.odd_sketch(near_dups.minhashes(x)).tobytes(), "<u8")[None] for x in (a, b)]
            errors.append(near_dups.estimate(*sk)[0, 0] - both / len(pool))
    assert np.abs(errors).max() < near_dups.MARGIN and abs(np.mean(errors)) < 0.02


def removed_brute(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (i, _), r in zip(rows, raws, strict=True):
        gone = np.zeros(len(r) + 1, dtype=bool)
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        left = bytes(x for x, g in zip(r, gone[:-1], strict=True) if not g)
        out.append((i, len(r), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [512, 2])
def test_suffix_dedup_by_brute_force(spark, hot):
    docs = documents(spark)
    out = suffix_dups.remove_repeats(docs, hot=hot).collect()
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(removed_brute([(r.doc_id, r.text) for r in docs.collect()], 400), key=key)
    for r in out:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans
    assert suffix_dups.remove_repeats(docs.where("false")).count() == 0


def test_suffix_dedup_over_chunks(spark, monkeypatch):
    """Documents longer than a chunk are cut into overlapping pieces."""
    monkeypatch.setattr(suffix_dups, "CHUNK", 1000)
    a = prose(900, 60)
    got = list(suffix_dups._anchor_rows([__import__("pyarrow").RecordBatch.from_pydict({"rk": [5, 6], "text": [a, a[:500] + "x"]})]))
    lo = np.sort(np.concatenate([np.stack([b.column("lo").to_numpy()[k], b.column("hi").to_numpy()[k]])[None] for b in got for k in np.flatnonzero(b.column("rk").to_numpy() == 5)]), axis=0)
    n = len(a.encode()) - 400 + 1
    assert sorted(x for p, q in lo for x in range(p, q + 1)) == list(range(n))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=12, max_size=40), min_size=1, max_size=7), st.integers(1, 4))
def test_merged_transforms_sort_and_find_repeats(texts, shards):
    """Interleave refinement gives the runs that sorting all windows gives."""
    segments = [t.encode() for t in texts]
    seg, off, run, again = suffix_dups.repeated_windows(segments, np.arange(len(segments)) % shards, length=12, step=3)
    windows = [segments[s][o : o + 12] for s, o in zip(seg, off, strict=True)]
    count = collections.Counter(windows)
    assert [count[w] > 1 for w in windows] == again.tolist()
    assert len(set(zip(windows, run.tolist(), strict=True))) == len(count) == len(set(run.tolist()))


def test_merge_equals_one_transform_of_all():
    r = np.random.default_rng(1)
    symbols = r.integers(0, 3, (500, 8)).astype(np.uint32)
    cut = [0, 120, 121, 300, 500]
    place, run = suffix_dups.merge_transforms([suffix_dups.shard_transform(symbols[a:b]) for a, b in zip(cut, cut[1:], strict=False)])
    rows = [tuple(symbols[p][::-1]) for p in place]
    assert rows == sorted(rows) and all((rows[k] == rows[k - 1]) == (run[k] == run[k - 1]) for k in range(1, 500))


def test_every_window_is_filed_once():
    data = np.frombuffer((prose(400, 70) + "a" * 900 + prose(100, 71)).encode(), dtype=np.uint8)
    cut = np.array([0, 700, 760, 1500, len(data)])
    _, _, lo, hi = suffix_dups.anchors(data, cut)
    want = [i for a, b in zip(cut, cut[1:], strict=False) for i in range(a, b - 400 + 1)]
    assert sorted(x for p, q in zip(lo, hi, strict=True) for x in range(p, q + 1)) == want and (hi - lo).max() < 400
