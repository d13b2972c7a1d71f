"""Operator 3 among sentences of a few words: runs grow until they have words enough."""

from conftest import SF_SMALL
from llm_cases import documents, prose

from tomescope.llm import span_dups


def runs(p, span, least):
    """The run of every sentence that has one, by trying all ends."""
    for i in range(len(p)):
        for j in range(i + span, len(p) + 1):
            if sum(len(x.split()) for x in p[i:j]) >= least:
                yield i, j, tuple(" ".join(x.split()) for x in p[i:j])
                break


def brute(rows, span=3, least=20):
    first, found = {}, [list(runs(span_dups.sentences(t or ""), span, least)) for _, t in rows]
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0)):
        for *_, run in found[k]:
            first.setdefault(run, rows[k][0])
    out = []
    for (doc, t), mine in zip(rows, found, strict=True):
        p, seen = span_dups.sentences(t or ""), set()
        gone = [False] * len(p)
        for i, j, run in mine:
            if run in seen or first[run] is not None and first[run] != doc:
                gone[i:j] = [True] * (j - i)
            seen.add(run)
        out.append((doc, sum(gone), "".join(x for x, g in zip(p, gone, strict=True) if not g)))
    return out


def test_short_sentences(spark):
    words = prose(60, 70).replace(".", "").lower().split()
    listing = ", ".join(words)  # a word a sentence: three of them never have words enough
    verse = "\n".join(" ".join(words[k : k + 3]) for k in range(0, 60, 3))
    rows = [
        (1, prose(70, 71) + "\n" + listing + ".\n" + prose(70, 72)), (2, prose(70, 73) + "\n" + listing + ".\n" + prose(70, 74)),
        (3, verse), (4, verse), (5, "Some words before it\n" + verse), (6, verse + "\n" + prose(40, 75) + "\n" + verse), (None, listing), (None, None), (7, "a, b, c"), (8, "a, b, c"),
    ]
    docs = documents(spark, [(i, t, "en", "src", None) for i, t in rows])
    got = [(r.doc_id, r.span_removed, r.text) for r in span_dups.span_dedup(docs).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    by = {i: t for i, _, t in got}
    assert by[1] == rows[0][1] and sum(w in by[2].split() for w in listing.split()) < 10
    assert by[3] == verse and by[4] == "" and by[5].startswith("Some words before it\n") and len(by[5].split()) < 14
    assert by[7] == by[8] == "a, b, c"  # fewer than twenty words in all


def test_cases_and_query(spark):
    docs = documents(spark)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    got = [(r.doc_id, r.span_removed, r.text) for r in span_dups.span_dedup(docs).collect()]
    # rows that repeat a doc_id are one document: document 17 comes twice
    assert sorted(got, key=key) == sorted(brute([(r.doc_id, r.text) for r in docs.collect()]), key=key)
    got = [(r.doc_id, r.n_removed, r.text) for r in span_dups.op3_span_dedup(spark, SF_SMALL).collect()]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert sorted(got) == sorted(brute(rows))


def test_windows_kept(spark):
    """Counted on the raw text: no repeated window of 50 words of short sentences stays whole."""
    words = prose(400, 80).replace(".", "").lower().split()
    text = "\n".join(" ".join(words[k : k + 2]) for k in range(0, 400, 2))
    rows = [(1, text), (2, prose(50, 81) + "\n" + text + "\n" + prose(50, 82))]
    left = {r.doc_id: r.text.split() for r in span_dups.span_dedup(documents(spark, [(i, t, "en", "src", None) for i, t in rows])).collect()}
    windows = {tuple(words[k : k + 50]) for k in range(351)}
    assert left[1] == words
    assert not any(tuple(left[2][k : k + 50]) in windows for k in range(len(left[2]) - 49))


def test_chance_repeats_stay(spark):
    """Fifteen words in common, as two documents may share by chance, are left; a passage of fifty goes."""
    few, passage = " ".join(prose(60, 90).split()[:15]), " ".join(prose(80, 91).split()[:55])
    own = [prose(60, k) for k in range(92, 98)]
    rows = [(1, f"{own[0]}\n{few}.\n{own[1]}"), (2, f"{own[2]}\n{few}.\n{own[3]}"), (3, f"{own[4]}\n{passage}.\n{own[0]}"), (4, f"{own[5]}\n{passage}.\n")]
    left = {r.doc_id: (r.span_removed, r.text) for r in span_dups.span_dedup(documents(spark, [(i, t, "en", "src", None) for i, t in rows])).collect()}
    assert left[1] == (0, rows[0][1]) and left[2] == (0, rows[1][1])
    assert left[4][0] > 0 and len(left[4][1].split()) < len(own[5].split()) + 15
    assert own[4] in left[3][1] and passage in left[3][1] and own[0] not in left[3][1]
