"""kNN / IVF / PQ against brute force on small fixtures, plus invariants."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tomescope.config import DEFAULT
from tomescope.operators import ann
from tomescope.operators import knn as K
from tomescope.operators.knn import knn_join, round_half_away
from tomescope.plans import ann_queries as AQ
from tomescope.session import cut_lineage

from conftest import SF_SMALL


def brute_topk(Q, qids, X, xids, k, exclude_self=False):
    S = round_half_away(Q @ X.T)
    out = {}
    for i, q in enumerate(qids):
        cand = [(-S[i, j], xids[j]) for j in range(len(xids)) if not (exclude_self and xids[j] == q)]
        out[q] = [x for _, x in sorted(cand)[:k]]
    return out


def fixture(spark, n=120, d=16, seed=3):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, d)).astype(np.float32)
    X /= np.linalg.norm(X, axis=1, keepdims=True)
    X[5] = 0.0  # a zero vector
    X[7] = X[8]  # an exact tie
    pdf = pd.DataFrame({"Id": np.arange(n, dtype=np.int64), "vec": list(X), "label": (np.arange(n) % 6).astype(np.int32)})
    return spark.createDataFrame(pdf, "Id long, vec array<float>, label int"), X.astype(np.float64)


def as_lists(df, q="query_id", c="Id"):
    pdf = df.toPandas().sort_values([q, "rank"])
    return {k: g[c].tolist() for k, g in pdf.groupby(q)}


def test_knn_matches_brute_force(spark):
    df, X = fixture(spark)
    q = df.select(F.col("Id").alias("query_id"), F.col("vec").alias("qvec"))
    got = as_lists(knn_join(q, df.select("Id", "vec"), 7, exclude_self=True, decimals=6))
    want = brute_topk(X, list(range(len(X))), X, list(range(len(X))), 7, exclude_self=True)
    assert got == want


def test_knn_blocks_equal_single_block(spark):
    df, _ = fixture(spark)
    q = df.select(F.col("Id").alias("query_id"), F.col("vec").alias("qvec"))
    one = as_lists(knn_join(q, df.select("Id", "vec"), 5, decimals=6))
    old = K.ONE_PASS_BYTES
    try:
        K.ONE_PASS_BYTES = 0
        many = as_lists(knn_join(q, df.select("Id", "vec"), 5, params=DEFAULT.with_(max_broadcast_bytes=30000), decimals=6))
    finally:
        K.ONE_PASS_BYTES = old
    assert one == many


def test_knn_takes_any_id_and_any_score(spark):
    big = 2**62
    rows = [(-5, [-20.0]), (2**38, [5.0]), (big, [1.0]), (7, [1000.0]), (-big, [1000.0])]
    df = spark.createDataFrame(rows, "Id long, vec array<float>")
    q = spark.createDataFrame([(2**50, [1.0]), (-1, [-1.0])], "query_id long, qvec array<float>")
    got = {(r.query_id, r["rank"]): (r.Id, r.score) for r in knn_join(q, df, 3).collect()}
    assert got == {
        (2**50, 1): (-big, 1000.0), (2**50, 2): (7, 1000.0), (2**50, 3): (2**38, 5.0),
        (-1, 1): (-5, 20.0), (-1, 2): (big, -1.0), (-1, 3): (2**38, -5.0),
    }


def test_bounds_keep_candidates_few(spark):
    """What reaches the final cut is near k per query, not k per block; equal scores do not break that."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(40 * 64)] + [(10**6 + i, [0.0] * 4) for i in range(64)]
    df = spark.createDataFrame(rows, "Id long, vec array<float>").repartition(8)
    q = df.where("Id % 100 = 0").select(F.col("Id").alias("query_id"), F.col("vec").alias("qvec"))
    old, size = K.CORPUS_BLOCK, K.ONE_PASS_BYTES
    try:
        K.CORPUS_BLOCK, K.ONE_PASS_BYTES = 64, 0
        found = K.knn_candidates(q, cut_lineage(df), 5)
        per = [r["count"] for r in found.groupBy("query_id").count().collect()]
    finally:
        K.CORPUS_BLOCK, K.ONE_PASS_BYTES = old, size
    assert max(per) < 30 * 5 and np.mean(per) < 60  # 48 blocks of 64 vectors


def test_ivf_all_lists_equals_exact(spark):
    df, _ = fixture(spark)
    cents = ann.centroids_by_label(df, "label", "vec")
    lists = ann.assign(df, cents, carry=True)
    q = df.select(F.col("Id").alias("query_id"), F.col("vec").alias("qvec"))
    exact = as_lists(knn_join(q, df.select("Id", "vec"), 6, exclude_self=True))
    full = as_lists(ann.ivf_search(q, lists, cents, nprobe=6, k=6, exclude_self=True))
    assert exact == full


def test_recall_grows_with_nprobe(spark):
    df, _ = fixture(spark, n=200)
    cents = ann.centroids_by_label(df, "label", "vec")
    lists = ann.assign(df, cents, carry=True)
    q = df.select(F.col("Id").alias("query_id"), F.col("vec").alias("qvec"))
    exact = knn_join(q, df.select("Id", "vec"), 10, exclude_self=True)
    rec = [
        ann.recall_at_k(exact, ann.ivf_search(q, lists, cents, p, 10, exclude_self=True), 10).first()["recall_at_k"]
        for p in (1, 3, 6)
    ]
    assert rec[0] <= rec[1] <= rec[2] == 1.0


def test_pq_search_scores_match_reconstruction(spark):
    """IVF-PQ score equals q . (centroid + decoded residual), computed by brute force."""
    v = AQ._vectors(spark, SF_SMALL)
    idx = AQ.trained_index(v)
    pdf = v.toPandas()
    X = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
    ids = pdf["Id"].to_numpy()
    C, cb = ann.centroid_matrix(idx.centroids), ann.codebook_tensor(idx.codebooks)
    codes = idx.codes.toPandas().set_index("Id")
    recon = np.stack([C[codes.loc[i, "cluster"]] + np.concatenate([cb[m, c] for m, c in enumerate(codes.loc[i, "codes"])]) for i in ids])
    got = ann.pq_search(AQ._queries(v), idx, nprobe=C.shape[0], k=5, exclude_self=True).toPandas()
    S = X @ recon.T
    pos = {i: n for n, i in enumerate(ids)}
    assert len(got) == 5 * len(ids)
    for r in got.itertuples():
        assert abs(S[pos[r.query_id], pos[r.Id]] - r.score) <= 2e-6


def test_index_is_stored_by_list_and_pruned(spark):
    """Files are bounded by partitions, hold neighbouring lists, and the scan pushes the list filter to their statistics."""
    import glob

    import pyarrow.parquet as pq

    idx = AQ.trained_index(AQ._vectors(spark, SF_SMALL))
    files = glob.glob(f"{idx.path.removeprefix('file:')}/part-*.parquet")
    assert 0 < len(files) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    spans = []
    for f in files:
        meta = pq.ParquetFile(f).metadata
        at = next(k for k in range(meta.num_columns) if meta.row_group(0).column(k).path_in_schema == "cluster")
        stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
        spans.append((min(x.min for x in stats), max(x.max for x in stats)))
    spans.sort()
    assert all(b[0] >= a[1] for a, b in zip(spans, spans[1:], strict=False)) and len(spans) > 1  # a list at a border may be in two
    some = ann.read_codes(spark, idx.path, [1, 3])
    assert "PushedFilters: [In(cluster, [1,3])]" in some._jdf.queryExecution().executedPlan().toString()
    assert {r.cluster for r in some.collect()} <= {1, 3} and idx.codes.schema["codes"].dataType.simpleString() == "binary"
    assert idx.sizes.sum() == idx.codes.count()


def test_more_training_lowers_the_error(spark):
    df, X = fixture(spark, n=200)
    cents = ann.train_kmeans(df, "vec", 4, 3, 1)
    C = ann.centroid_matrix(cents)
    res = X - C[ann.nearest_list(X, C)]
    errors = []
    for steps in (0, 4):
        cb = ann.codebook_tensor(ann.train_pq(df, cents, 4, 16, steps, 1))
        codes = ann.nearest_codes(res, cb)
        errors.append(((res - np.concatenate([cb[m][codes[:, m]] for m in range(4)], axis=1)) ** 2).sum())
    assert errors[1] < errors[0]
    with pytest.raises(ValueError):
        ann.train_pq(df, cents, 5, 16, 1, 1)


def test_train_sample_exact_size(spark):
    df, _ = fixture(spark, n=150)
    s1 = ann.train_sample(df, "Id", 40, 7)
    s2 = ann.train_sample(df, "Id", 40, 7)
    assert s1.count() == 40 and sorted(r.Id for r in s1.collect()) == sorted(r.Id for r in s2.collect())
    assert ann.train_sample(df, "Id", 1000, 7).count() == 150


def test_encoding_at_full_settings_needs_little_memory():
    """96 sub-spaces of 256 codes on 384 dimensions: one batch of 10,000 vectors, a sub-space at a time."""
    import tracemalloc

    rng = np.random.default_rng(0)
    x, cb = rng.normal(size=(10_000, 384)), rng.normal(size=(96, 256, 4))
    tracemalloc.start()
    codes = ann.nearest_codes(x, cb)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert codes.shape == (10_000, 96) and peak < 300 * 2**20
    k = rng.integers(0, 10_000, 20)
    want = ((x[k].reshape(20, 96, 1, 4) - cb[None]) ** 2).sum(axis=3).argmin(axis=2)
    assert (codes[k] == want).all()


def test_codes_of_small_vectors_are_the_nearest(spark):
    """Nothing is rounded before the choice: vectors of norm 0.001 get the nearest codes too."""
    df, X = fixture(spark, n=150)
    tiny = df.select("Id", F.transform("vec", lambda x: x * 0.001).alias("vec"))
    idx = ann.compress_index(tiny, 4, 4, 5, 3, 1)
    C, cb = ann.centroid_matrix(idx.centroids), ann.codebook_tensor(idx.codebooks)
    x = np.stack([np.array(r["vec"], dtype=np.float64) for r in tiny.orderBy("Id").collect()])
    stored = {r["Id"]: r for r in idx.codes.collect()}
    for i, v in enumerate(x):
        best = int(np.argmax(C @ v))
        assert stored[i]["cluster"] == best
        res = (v - C[best]).reshape(4, 1, -1)
        d = ((res - cb) ** 2).sum(axis=2)
        got = np.frombuffer(stored[i]["codes"], np.uint8)
        assert np.allclose(d[np.arange(4), got], d.min(axis=1), rtol=1e-9, atol=0)


def test_searches_are_joins_of_lists(spark):
    """No product and no nested loop in the plans of the searches themselves; only probed lists are shuffled."""
    v = AQ._vectors(spark, SF_SMALL)
    cents = cut_lineage(ann.centroids_by_label(v, "label", "vec"), "cents")
    lists = cut_lineage(ann.assign(v, cents, carry=True), "lists")
    found = [ann.ivf_candidates(AQ._queries(v), lists, cents, 3, 10), ann.pq_candidates(AQ._queries(v), AQ.trained_index(v), 4, 10)]
    for threshold in ("-1", "10MB"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            for df in found:
                txt = df.select("*")._jdf.queryExecution().executedPlan().toString()
                assert "CartesianProduct" not in txt and "NestedLoop" not in txt and "[cluster#" in txt
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    c = ann.centroid_matrix(cents)
    salts = np.ones(len(c), dtype=np.int64)
    for nprobe in (1, 3):
        rows = ann.probe_rows(AQ._queries(v), "query_id", "qvec", c, nprobe, salts, 512, None).collect()
        assert sum(len(r["q_ids"]) // 8 for r in rows) == nprobe * v.count()  # a vector per probed pair


def test_hot_list_is_dealt_over_salts(spark, monkeypatch):
    """Most vectors in one list: same hits, its blocks on many join keys, the bounds pass included."""
    monkeypatch.setattr(ann, "LIST_ROWS", 20)
    monkeypatch.setattr(ann, "CORPUS_BLOCK", 8)
    df, X = fixture(spark, n=300)
    hot = df.select("Id", "vec", F.when(F.col("Id") % 10 < 8, F.lit(0)).otherwise(F.col("label")).alias("cluster"))
    cents = ann.centroids_by_label(df, "label", "vec")
    lists = cut_lineage(hot, "hot")
    q = df.where("Id % 7 = 0").select(F.col("Id").alias("query_id"), F.col("vec").alias("qvec"))
    salts = ann.salts_of(ann.list_sizes(lists, 6))
    assert salts[0] >= 12 and salts[1:].max() <= 2
    blocks = ann.list_rows(lists, "Id", "vec", lambda c: K.vectors_of(c).astype("<f4"), salts)
    assert blocks.where("cluster = 0").select("salt").distinct().count() > 6
    exact = as_lists(knn_join(q, df.select("Id", "vec"), 9, exclude_self=True))
    for limit in (K.ONE_PASS_BYTES, 0):
        monkeypatch.setattr(ann, "ONE_PASS_BYTES", limit)
        assert as_lists(ann.ivf_search(q, lists, cents, 6, 9, exclude_self=True)) == exact


def test_refine_ranks_by_stored_vectors(spark):
    df, X = fixture(spark, n=200)
    idx = ann.compress_index(df, 4, 4, 3, 2, 1)
    q = df.select(F.col("Id").alias("query_id"), F.col("vec").alias("qvec"))
    exact = knn_join(q, df.select("Id", "vec"), 5, exclude_self=True)
    rec = [ann.recall_at_k(exact, ann.pq_search(q, idx, 4, 5, exclude_self=True, vectors=v, refine=r), 5).first()["recall_at_k"] for v, r in ((None, 1), (df, 4), (df, 40))]
    assert rec[0] < rec[1] < rec[2] == 1.0
    got = as_lists(ann.pq_search(q, idx, 4, 5, exclude_self=True, vectors=df, refine=40))
    assert got == as_lists(exact)


def test_model_sums_shuffle_one_row_per_task_and_key(spark):
    from tomescope.operators import sums

    x = np.arange(600.0).reshape(100, 6)
    df = spark.createDataFrame([(i % 7, [float(v) for v in r]) for i, r in enumerate(x)], "k long, v array<double>").repartition(5)

    def add(b, n, s):
        k = b.column("k").to_numpy()
        n += np.bincount(k, minlength=7)
        np.add.at(s, k, K.vectors_of(b.column("v")))

    assert df.mapInArrow(sums.task_sums(7, 6, add), sums.PACKED).count() <= 5 * 7  # not x 6 dimensions
    n, s = sums.sums_by_key(df, 7, 6, add)
    assert n.tolist() == [sum(1 for i in range(100) if i % 7 == k) for k in range(7)]
    assert np.allclose(s, [x[k::7].sum(axis=0) for k in range(7)])


def test_blocks_out_of_reach_are_skipped_without_loss(spark, monkeypatch):
    """Clustered vectors: most pairs of a query and a block are never scored, and the result is that of brute force."""
    monkeypatch.setattr(K, "CORPUS_BLOCK", 32)
    monkeypatch.setattr(K, "ONE_PASS_BYTES", 0)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(24, 12)) * 4
    X = (centres[np.arange(2400) % 24] + rng.normal(size=(2400, 12)) * 0.3).astype(np.float32)
    X[17] = X[41]  # equal scores across blocks
    df = spark.createDataFrame(pd.DataFrame({"Id": np.arange(2400, dtype=np.int64), "vec": list(X)}), "Id long, vec array<float>").repartition(4)
    df = cut_lineage(df)
    q = df.where("Id % 40 = 1").select(F.col("Id").alias("query_id"), F.col("vec").alias("qvec"))
    for decimals in (None, 6):
        got = knn_join(q, df, 6, exclude_self=True, decimals=decimals)
        S = round_half_away(X.astype(np.float64) @ X.astype(np.float64).T, decimals)
        for r_q, ids in as_lists(got).items():
            assert ids == [j for _, j in sorted((-S[r_q, j], j) for j in range(2400) if j != r_q)[:6]]
    r = K.skipped_pairs(q, df, 6, exclude_self=True).first()
    assert r["block_pairs"] >= 75 and r["query_blocks"] == 60 * r["block_pairs"] / (r["block_pairs"] // 75)
    assert r["queries_skipped"] > 0.5 * r["query_blocks"], r
    flat = spark.createDataFrame([(i, [0.0] * 12) for i in range(100)], "Id long, vec array<float>")  # nothing to skip: all scores are equal
    assert K.skipped_pairs(q, flat, 6).first()["queries_skipped"] == 0


def _chances(ids, seed, step):
    import hashlib

    return np.array([int(hashlib.md5(f"{i}|{seed}|{step}".encode()).hexdigest()[:13], 16) / 2**52 for i in ids])


def test_parallel_seeding_by_brute_force(spark):
    """Every round takes exactly the rows whose chance lies below their share of the squared distances."""
    df, X = fixture(spark, n=400)
    X = ann.unit_rows(X)
    k, seed, rounds = 6, 5, 3
    first = df.withColumn("k", ann.sample_key("Id", seed)).orderBy("k").first()["Id"]
    seeds = X[[first]]
    for step in range(rounds):
        gap = np.maximum(0, 2 - 2 * (X @ seeds.T).max(axis=1))
        take = _chances(range(len(X)), seed, step) < gap * 2 * k / gap.sum()
        seeds = np.concatenate([seeds, X[take]])
    seeds = np.unique(seeds, axis=0)
    weight = np.bincount((X @ seeds.T).argmax(axis=1), minlength=len(seeds)).astype(float)
    want = ann._plus_plus(seeds, weight, k, np.random.Generator(np.random.PCG64(seed)))
    got = ann.parallel_seeds(df, "vec", k, seed, rounds=rounds)
    assert got.shape == (k, X.shape[1]) and np.allclose(got, want)
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(9)], "Id long, vec array<float>")
    assert ann.parallel_seeds(same, "vec", 3, 1).shape == (3, 2)  # one distinct row: repeated


def test_empty_lists_are_filled_and_lists_are_even(spark):
    """Most vectors close together: starting rows by hash leave lists empty or uneven, oversampled seeds and splits do not."""
    rng = np.random.default_rng(8)
    far = rng.normal(size=(20, 8)) * 5
    X = np.concatenate([far[0] + rng.normal(size=(500, 8)) * 0.01, np.repeat(far[:1], 80, axis=0), far[rng.integers(1, 20, 300)] + rng.normal(size=(300, 8)) * 0.2]).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"Id": np.arange(len(X), dtype=np.int64), "vec": list(X)}), "Id long, vec array<float>")
    spread = {}
    for seeding in ("hash", "parallel"):
        cents = ann.train_kmeans(df, "vec", 20, 6, 3, seeding=seeding)
        spread[seeding] = ann.list_spread(ann.assign(df, cents), 20).first()
        c = ann.centroid_matrix(cents)
        spread[seeding, "cost"] = float((2 - 2 * (ann.unit_rows(X.astype(float)) @ c.T).max(axis=1)).sum())
    assert spread["parallel"]["empty"] <= spread["hash"]["empty"] and spread["parallel", "cost"] < spread["hash", "cost"]
    c, n = np.eye(4), np.array([10, 0, 3, 0])
    out = ann.split_into_empty(c, n, 1)
    assert np.allclose(np.linalg.norm(out, axis=1), 1) and all(out[e] @ c[0] > 0.99 for e in (1, 3)) and (out[2] == c[2]).all()
