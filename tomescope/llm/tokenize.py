"""Byte-level BPE encoding of whole texts with the ``tokenizers`` library, a batch at a time.

A byte-level BPE tokenizer first cuts a text into pre-tokens and never merges across a cut. A pre-token
always starts at a blank before a non-blank, at and after a single line end, and at a sign after a letter
or digit, so a text may be cut there without changing its ids. ``BatchEncoder`` cuts the UTF-8
buffer of a batch at these places in NumPy, hashes the pieces, and asks the library only for
pieces it has not met in this worker (bounded cache, 64-bit keys). Texts with other white space than
single blanks and line ends go to the library as they are, as does everything when the tokenizer is of another kind.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
CACHE_PIECES = 500_000
JOIN = 4096

_P = 0x9E3779B97F4A7C15
_ENCODERS: dict[str, BatchEncoder] = {}
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[ord(c) for c in "!\"#$%&()*+,-./:;=>?@[\\]^_{|}~"]] = True
_ODD = np.zeros(256, dtype=bool)  # white space that is neither blank nor line end, and NUL
_ODD[[0, 9, 11, 12, 13, 28, 29, 30, 31]] = True
_WIDE = {}  # white space beyond ASCII, by the first two bytes
for _c in (chr(c).encode() for c in range(0x80, 0x3001) if chr(c).isspace()):
    _WIDE.setdefault(_c[:2], []).append(_c)


def _byte_chars() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 as it is, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(256 + others.index(b)) for b in others}


_BYTE_CHARS = _byte_chars()


def tokenizer_path(name_or_path: str) -> str:
    """A path as it is; a bare file name is looked up among the installed public vocabularies."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def encoder(name_or_path: str) -> BatchEncoder:
    """The worker's encoder for this vocabulary (loaded once per Python worker)."""
    if name_or_path not in _ENCODERS:
        _ENCODERS[name_or_path] = BatchEncoder(tokenizer_path(name_or_path))
    return _ENCODERS[name_or_path]


def _find_all(data: bytes, what: bytes) -> list[int]:
    out, at = [], data.find(what)
    while at >= 0:
        out.append(at)
        at = data.find(what, at + 1)
    return out


class BatchEncoder:
    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        byte_level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.newline = self._plain(["\n"])[0]
        self.by_pieces = bool(byte_level and not spec.get("normalizer") and not spec.get("truncation") and len(self.newline) == 1)
        self.cache_pieces = cache_pieces
        self.power = np.ones(1, dtype=np.uint64)
        self.inverse = np.ones(1, dtype=np.uint64)
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)  # sorted
        self.rows = np.zeros(0, dtype=np.int64)
        self.flat, self.used = np.zeros(1 << 16, dtype=np.int32), 0
        self.start, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.int32) for e in found]

    def _hash(self, data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """One key per piece: a polynomial of its bytes modulo 2**64, mixed with its length."""
        base, n = int(lo[0]), int(hi[-1] - lo[0])
        if n + 1 > len(self.power):
            m = max(n + 1, CHUNK_BYTES)
            with np.errstate(over="ignore"):
                one = np.ones(1, dtype=np.uint64)
                self.power = np.concatenate((one, np.cumprod(np.full(m, _P, dtype=np.uint64))))
                self.inverse = np.concatenate((one, np.cumprod(np.full(m, pow(_P, -1, 1 << 64), dtype=np.uint64))))
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((data[base : base + n].astype(np.uint64) + np.uint64(1)) * self.power[:n], out=sums[1:])
            h = (sums[hi - base] - sums[lo - base]) * self.inverse[lo - base]
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F) + (hi - lo).astype(np.uint64) * np.uint64(0x165667B19E3779F9)
            return h ^ (h >> np.uint64(29))

    def _ids_of(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of pieces. A blank and Latin letters are one pre-token: straight to the library's
        model. Others are joined by line ends, which are pre-tokens of their own and mark the cuts."""
        each: list = [None] * len(pieces)
        rest, tokenize, level = [], self.tok.model.tokenize, _BYTE_CHARS
        for k, p in enumerate(pieces):
            word = p.decode("utf-8", "surrogatepass")
            blank = p[0] == 32
            letters = word[1:] if blank else word
            if not letters.isalpha():
                rest.append((k, word))
            elif letters.isascii():
                each[k] = [x.id for x in tokenize(level[32] + letters if blank else letters)]
            elif max(letters) < "\u0250":
                each[k] = [x.id for x in tokenize(p.decode("latin-1").translate(level))]
            else:
                rest.append((k, word))
        for i in range(0, len(rest), JOIN):
            part = rest[i : i + JOIN]
            got = self._plain(["\n".join([w for _, w in part])])[0]
            cuts = np.flatnonzero(got == self.newline[0])
            found = np.split(got, cuts)
            if len(found) == len(part):
                found[1:] = [x[1:] for x in found[1:]]
            else:  # one of them holds a line end
                found = self._plain([w for _, w in part])
            for (k, _), x in zip(part, found, strict=True):
                each[k] = x.tolist()
        sizes = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
        return np.fromiter((x for e in each for x in e), dtype=np.int32, count=int(sizes.sum())), sizes

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        if len(self.keys) + len(keys) > self.cache_pieces:
            self._clear()
        new, size = self._ids_of(pieces)
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used : self.used + len(new)] = new
        n = len(self.size)
        self.start = np.concatenate((self.start, self.used + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.used += len(new)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.rows = np.insert(self.keys, at, keys), np.insert(self.rows, at, np.arange(n, n + len(keys)))

    def _chunk(self, data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after the other, and each piece's number of ids."""
        uniq, first, back = np.unique(self._hash(data, lo, hi), return_index=True, return_inverse=True)
        for _ in range(2):  # twice if the cache has to be emptied
            at = np.searchsorted(self.keys, uniq)
            known = np.zeros(len(uniq), dtype=bool)
            if len(self.keys):
                inside = at < len(self.keys)
                known[inside] = self.keys[at[inside]] == uniq[inside]
            if known.all():
                break
            new = first[~known]
            self._learn(uniq[~known], [data[a:b].tobytes() for a, b in zip(lo[new].tolist(), hi[new].tolist(), strict=True)])
        at = np.searchsorted(self.keys, uniq)
        rows = self.rows[at][back]
        sizes = self.size[rows]
        ends = np.cumsum(sizes)
        pos = np.arange(int(ends[-1]), dtype=np.int64) + np.repeat(self.start[rows] - (ends - sizes), sizes)
        return self.flat[pos], sizes

    def encode(self, texts: pa.Array | list) -> list[np.ndarray]:
        """One int32 id array per text (null: empty), equal to the library's own ``encode``."""
        col = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string()).fill_null("")
        n = len(col)
        if not n:
            return []
        off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + n + 1]
        lo, hi = int(off[0]), int(off[-1])
        if not self.by_pieces or hi == lo:
            return self._plain([x or "" for x in col.to_pylist()])
        raw = col.buffers()[2].slice(lo, hi - lo)
        data, off = np.frombuffer(raw, dtype=np.uint8), off - lo
        white = (data == 32) | (data == 10)
        odd = _ODD[data]
        odd[1:] |= white[1:] & white[:-1]
        at = np.flatnonzero(odd).tolist()
        raw = raw.to_pybytes()
        at += _find_all(raw, b"<|")
        for head, chars in _WIDE.items():
            if head in raw:
                for what in chars:
                    at += _find_all(raw, what)
        plain = np.zeros(n, dtype=bool)
        if at:
            plain[np.searchsorted(off, np.array(at), side="right") - 1] = True
        cut = white
        cut[1:] |= data[:-1] == 10
        letter = _ALNUM[data]
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        cut[1:] |= _SIGN[data[1:]] & letter[:-1]
        cut[off[:-1][np.diff(off) > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        out = self._encode_pieces(data, off, starts, ends, plain)
        if plain.any():
            rows = np.flatnonzero(plain)
            for k, ids in zip(rows.tolist(), self._plain([col[int(k)].as_py() for k in rows]), strict=True):
                out[k] = ids
        return out

    def _encode_pieces(self, data: np.ndarray, off: np.ndarray, starts: np.ndarray, ends: np.ndarray, left_out: np.ndarray | None = None) -> list[np.ndarray]:
        """Ids per document (``off``: its bounds) from the bounds of the pieces; none for those left out."""
        n = len(off) - 1
        doc = np.searchsorted(off, starts, side="right") - 1
        if left_out is not None and left_out.any():
            keep = ~left_out[doc]
            starts, ends, doc = starts[keep], ends[keep], doc[keep]
        flat, sizes, i = [], [], 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK_BYTES, side="right")))
            ids, size = self._chunk(data, starts[i:j], ends[i:j])
            flat.append(ids)
            sizes.append(size)
            i = j
        if not flat:
            return [np.zeros(0, dtype=np.int32)] * n
        per_doc = np.bincount(doc, weights=np.concatenate(sizes), minlength=n).astype(np.int64)
        return np.split(np.concatenate(flat), np.cumsum(per_doc)[:-1])
