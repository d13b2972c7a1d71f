"""Operators 6, 7, 8 against the libraries' own encoders."""

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from llm_cases import documents, prose

from tomescope.llm import packing, sentence_pieces, token_files, tokenize
from tomescope.session import new_table_path

ODD = [
    "", " ", "a  b", "a\n\nb  c\n", " lead", "trail ", "x \n y", "it's don't 'll,", "\tab\n", "1,000.5 3.14%", "***", "a*** b", "a\nb\nc.",
    "ǅ… “q” —dash", "foo'! bar's.", " \x85z", "é×ß÷a", "日本語 ☃ x", "😀😀", "a" * 5000, "\x00a\x00 b", "▁x ▁", "http://a.b/c?d=e&f=g", "the" * 700, " " * 40 + "b",
]


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenize.tokenizer_path(token_files.TOKENIZER))


def texts():
    return [*ODD, *(prose(n, n) for n in (1, 30, 3000)), *(prose(50, k).replace(".", k % 3 * "!") for k in range(30))]


def test_batch_encoder_equals_the_library(library):
    enc = tokenize.BatchEncoder(tokenize.tokenizer_path(token_files.TOKENIZER), cache_pieces=300)  # small: emptied often
    for _ in range(2):
        for t, ids in zip(texts(), enc.encode(texts()), strict=True):
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, t[:40]
    assert [x.tolist() for x in enc.encode([None, "a"])][0] == []


def test_small_chunks_do_not_change_ids(library, monkeypatch):
    monkeypatch.setattr(tokenize, "CHUNK_BYTES", 64)
    enc = tokenize.BatchEncoder(tokenize.tokenizer_path(token_files.TOKENIZER))
    t = prose(4000, 5)
    assert enc.encode([t, "b"])[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_other_kinds_of_tokenizers():
    from tokenizers import Tokenizer

    path = tokenize.tokenizer_path("word_bpe_49k.json")
    enc, lib = tokenize.BatchEncoder(path), Tokenizer.from_file(path)
    assert [x.tolist() for x in enc.encode(ODD)] == [lib.encode(t, add_special_tokens=False).ids for t in ODD]


def test_token_files(spark, library):
    docs = documents(spark)
    path = token_files.write_tokens(docs, new_table_path(spark, "t7"))
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_back(spark, path).collect()]
    at, want = 0, []
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    stored = [(r.doc_id, list(r.ids)) for r in token_files.read_tokens(spark, path).orderBy("part", "start_in_part").collect()]
    assert [(i is not None, i or 0) for i, _ in stored] == [r[:2] for r in rows]
    for i, ids in stored:
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    texts_of = sorted(((r[1] if r[0] else None), library.encode(r[2], add_special_tokens=False).ids + [2]) for r in rows if r[0])
    assert sorted((i, ids) for i, ids in stored if i is not None) == texts_of
    some = token_files.read_tokens(spark, path, 5, 12, ["doc_id", "n_tokens"])
    plan = some._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,5)" in plan and "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert sorted(r.doc_id for r in some.collect()) == list(range(5, 13))


def test_token_file_layout(spark, tmp_path):
    path = token_files.write_tokens(documents(spark), str(tmp_path / "t"))
    files = sorted((tmp_path / "t").glob("*.parquet"))
    meta = [pq.ParquetFile(f).metadata for f in files]
    cols = {c.path_in_schema.split(".")[0]: c for m in meta if m.num_rows for c in (m.row_group(0).column(k) for k in range(m.num_columns))}
    assert "DELTA_BINARY_PACKED" in cols["doc_id"].encodings and any("DICTIONARY" in e for e in cols["ids"].encodings)
    assert cols["doc_id"].has_column_index and cols["doc_id"].has_offset_index and path


def test_empty_tables(spark):
    none = documents(spark, [])
    assert token_files.read_back(spark, token_files.write_tokens(none, new_table_path(spark, "none"))).count() == 0
    assert packing.digest(packing.pack(none)).count() == 0
    assert sentence_pieces.round_trip(sentence_pieces.encode(none)).count() == 0


def test_piece_lengths():
    for n in [*range(1, 40), 1023, 1024, 1025, 5000]:
        p = packing.piece_lengths(n, 1024)
        assert sum(p) == n and all(x & (x - 1) == 0 and x <= 1024 for x in p) and p == sorted(p, reverse=True)
    with pytest.raises(ValueError):
        packing.pack(None, max_len=1000)


def test_packing(spark, library):
    docs = documents(spark)
    pieces = packing.pack(docs, max_len=64).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces) and {p.offset for p in pieces} == {0}
    found = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id is not None, p.doc_id or 0, p.start)):
        found.setdefault(p.doc_id, []).append(p)
        assert len(p.ids) == p.length == 1 << p.bucket <= 64
    for r in docs.collect():
        if r.doc_id not in (None, 17):
            ids = library.encode(r.text or "", add_special_tokens=False).ids + [0]
            assert [x for p in found[r.doc_id] for x in p.ids] == ids and found[r.doc_id][0].doc_tokens == len(ids)
    assert sum(p.length for p in found[17]) == 2 * found[17][0].doc_tokens
    d = packing.digest(packing.pack(docs, max_len=64)).collect()
    key = lambda p: (p.doc_id or -1, p.start, p.sequence_id)
    assert sorted((*key(p), p.ids_crc32) for p in d) == sorted((*key(p), crc(p.ids)) for p in pieces)


def test_sentence_pieces_equal_the_library():
    enc = sentence_pieces.PieceEncoder(tokenize.tokenizer_path(sentence_pieces.MODEL), cache_pieces=400)
    for _ in range(2):
        got = enc.encode(texts())
        assert [g.tolist() for g in got] == enc.model.encode(texts(), num_threads=1)
    assert enc.decode(got) == [t.replace("▁", " ") for t in texts()]
    assert enc.decode([np.array([1, 2]), np.array([0])]) == ["", "⁇ "]


def test_suffix_ranges_by_brute_force():
    r = np.random.default_rng(3)
    codes = r.integers(0, 4, 3000).astype(np.uint16)
    index = sentence_pieces.SuffixIndex(codes)
    pieces, size = np.zeros((400, 16), dtype=np.uint16), r.integers(1, 17, 400)
    for k, n in enumerate(size):
        at = int(r.integers(0, len(codes) - 16))
        w = codes[at : at + n].copy() if k % 2 else r.integers(1, 4, n)
        w[w == 0] = 1
        pieces[k, :n] = w
    lo, hi = index.ranges(pieces, size)
    for p, n, a, b in zip(pieces, size, lo, hi, strict=True):
        want = [i for i in range(len(codes) - n + 1) if (codes[i : i + n] == p[:n]).all()]
        assert sorted(index.order[a:b].tolist()) == want


def test_sentence_piece_query(spark):
    rows = sentence_pieces.round_trip(sentence_pieces.encode(documents(spark))).collect()
    enc = sentence_pieces.piece_encoder(sentence_pieces.MODEL)
    want = [(r.doc_id, enc.model.encode(r.text or "")) for r in documents(spark).collect()]
    assert all(r.same for r in rows)
    key = lambda x: (x[0] or -1, *x[1:])
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows), key=key) == sorted(((i, len(x), crc(x)) for i, x in want), key=key)


def test_longer_pieces_than_the_suffix_order_compares(monkeypatch):
    monkeypatch.setattr(sentence_pieces, "DEPTH", 12)
    with pytest.raises(ValueError, match="16 characters"):
        sentence_pieces.PieceEncoder(tokenize.tokenizer_path(sentence_pieces.MODEL))
