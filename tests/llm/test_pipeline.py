"""The pipeline, stage by stage, on the small tables."""

import corpus_pipeline as P
import numpy as np
from conftest import SF_ORACLE
from llm_cases import documents, prose
from test_dups import near_brute
from test_quality import base
from test_span_runs import brute as span_brute

import __spark_entry__ as E
from tomescope.session import cut_lineage


def test_registered():
    q = E.queries()
    assert q["pipeline"] is P.run and [sum(k.startswith(f"op{n}_") for k in q) for n in range(1, 14)] == [1] * 13
    assert "pipeline" not in E.oracle_sql() and {"op5_topk", "op11_resample", "op12_centroids"} <= set(E.oracle_sql())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_ORACLE}/labels.parquet").collect()}
    kept = [docs]
    for name, stage in P.STAGES[:-1]:
        kept.append(cut_lineage(stage(spark, kept[-1], SF_ORACLE), f"test-{name}"))
        assert kept[-1].columns == docs.columns
    rows = [{r.doc_id: r.text for r in d.collect()} for d in kept]
    right = [(i in rows[1]) == (q == 1) for i, q in quality.items()]
    assert np.mean(right) > 0.97
    failed = {i for i, t in rows[1].items() if (b := base(t))[0] < 50 or 100 * b[4] > 50 * b[0]}
    gone = set(rows[1]) - set(rows[2])
    assert failed <= gone and len(gone - failed) <= 0.01 * len(rows[1])
    near = near_brute(sorted(rows[2].items()), 5, 80)
    assert set(rows[3]) == {i for i, _, _, keep in near if keep}
    assert rows[4] == {i: t for i, _, t in span_brute(sorted(rows[3].items()))}
    assert all(r.n_chars == len(r.text) for r in kept[4].collect())
    pieces = P.STAGES[-1][1](spark, kept[4], SF_ORACLE).collect()
    assert {p.doc_id for p in pieces} == set(rows[4]) and all(len(p.ids) == p.length for p in pieces)


def test_near_keeps_unlike_texts_of_one_id(spark):
    a, b, c = prose(120, 31), prose(120, 32), prose(120, 33)
    near_a = a.replace(a.split()[60], "changed", 1)
    rows = [(0, a), (1, near_a), (1, b), (2, b), (2, b), (3, c), (3, c), (3, c), (None, a), (None, a), (4, None), (4, None), (5, ""), (6, c + " end")]
    docs = documents(spark, [(i, t, "en", "s", None) for i, t in rows], clash=False)
    out = P.near(spark, docs, SF_ORACLE)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    # of the rows without words (4, 4, 5) none is a copy; without a doc_id all stay
    assert got == sorted([(0, a), (1, b), (3, c), (None, a), (None, a), (4, None), (4, None), (5, "")], key=str)


def test_identical_rows_leave_one(spark):
    text = "\n".join(prose(90, k) for k in (41, 42))
    docs = documents(spark, [(7, text, "en", "s", None)] * 5 + [(8, prose(200, 43), "en", "s", None)], clash=False)
    kept = cut_lineage(P.near(spark, docs, SF_ORACLE), "test-near")
    left = {r.doc_id: r.text for r in P.spans(spark, kept, SF_ORACLE).collect()}
    assert kept.count() == 2 and left == {7: text, 8: prose(200, 43)}


def test_stages_take_odd_rows(spark):
    docs = documents(spark, clash=False)
    rows = {(r.doc_id, r.text) for r in docs.collect()}
    for name, stage in P.STAGES:
        got = stage(spark, docs, SF_ORACLE)
        if name in ("classify", "rules", "near"):
            assert {(r.doc_id, r.text) for r in got.collect()} <= rows
        elif name == "spans":
            assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(r.doc_id) for r in docs.collect())
        else:
            assert {r.doc_id for r in got.collect()} == {i for i, _ in rows}
        assert stage(spark, docs.where("false"), SF_ORACLE).count() == 0
