"""The index of 8-bit codes against brute force, and its recall."""

import numpy as np

import __spark_entry__ as E
from conftest import SF_ORACLE
from tomescope.plans import ann_queries as A


def test_full_recall(spark):
    r = E.queries()["recall_at_10_full"](spark, SF_ORACLE).first()
    assert r["recall_at_10"] >= 0.9


def test_full_search_by_brute_force(spark, monkeypatch):
    v = A._vectors(spark, SF_ORACLE)
    idx = A.full_index(v)
    monkeypatch.setattr(A, "full_index", lambda _: idx)
    got = {}
    for r in A.pq_search_full(spark, SF_ORACLE).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["Id"], r["score"])
    cents = {r["cluster"]: np.array(r["centroid"]) for r in idx.centroids.collect()}
    books = {(r["m"], r["code"]): np.array(r["sub"]) for r in idx.codebooks.collect()}
    rows = idx.codes.collect()
    stored = {r["Id"]: (r["cluster"], cents[r["cluster"]] + np.concatenate([books[m, c] for m, c in enumerate(bytes(r["codes"]))])) for r in rows}
    assert len(stored) == v.count() == len(got)
    for q in v.collect():
        x = np.array(q["vec"], dtype=float)
        probed = set(sorted(cents, key=lambda c: (-round(float(cents[c] @ x), 6), c))[: A.FULL_NPROBE])
        scores = sorted((-float(s @ x), i) for i, (c, s) in stored.items() if c in probed and i != q["Id"])[: A.TOP_K]
        mine = [got[q["Id"]][k] for k in range(1, A.TOP_K + 1)]
        assert np.allclose([s for _, s in mine], [-s for s, _ in scores], atol=2e-6)
        assert all(abs(float(stored[i][1] @ x) - s) < 2e-6 for i, s in mine)


def test_recall_of_the_compressed_funnel(spark):
    """A quarter of the lists and four dimensions a code, refined: what ``result_cards_ivfpq`` retrieves."""
    from pyspark.sql import functions as F

    from tomescope.operators import ann
    from tomescope.plans import catalog as C
    from tomescope.plans import recommend as R
    from tomescope.session import cut_lineage

    idx, prep = C._index(spark, SF_ORACLE, C.IVFPQ), C._prepared(spark, SF_ORACLE, C.IVFPQ)
    exact = cut_lineage(R.retrieve(prep, idx, C.IVFPQ.with_(search="exact")), "exact")
    found = cut_lineage(R.retrieve(prep, idx, C.IVFPQ), "found")
    for k, least in ((10, 0.9), (200, 0.85)):
        cut = F.col("retrieval_rank") <= k
        assert ann.recall_at_k(exact.where(cut), found.where(cut), k).first()["recall_at_k"] >= least


def test_registered_recall(spark):
    assert E.queries()["recall_at_10"](spark, SF_ORACLE).first()["recall_at_10"] >= 0.9
