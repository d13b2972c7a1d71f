"""Operator 6: SentencePiece encoding and decoding by suffix-array matching.

For byte-pair models (scores rank the merges, byte fallback, no text rewriting). A batch's new words are put one after
the other with separators, and

1. the concatenated text is indexed: all suffixes are sorted by their first 16 characters (rank doubling
   from 4 characters), as no piece is longer;
2. every piece of the vocabulary is searched in the index by binary search, which gives the range of its occurrences;
3. the occurrences are edges from a piece's first to behind its last character, sorted by end in the word;
4. edges are relaxed in that order, all words at once: an edge holds if its piece and the piece that ends where it
   begins stay apart under the model's merges. Every prefix of a word has exactly one last piece, so one edge
   survives at each place, and going back from the end gives the model's own encoding.

Two neighbouring pieces stay apart if no merge across their border comes before the merges that make the two; that is
followed back along the merges of both, and remembered per pair. Runs of blanks, which merge last and
among themselves, are added at the front of a word by rule. Characters outside the vocabulary
become bytes. Words come from the UTF-8 buffer and are encoded once per worker (bounded cache).

Cases: null or empty text has no ids and decodes to the empty text. U+2581 is a blank to the model, so it comes back
as one. Control ids decode to nothing, the unknown id to the model's mark, invalid bytes to U+FFFD.
Null doc_id stays null, repeated rows are encoded each, empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tomescope.llm.common import crc32_u32, id_text, table
from tomescope.llm.tokenize import BatchEncoder, tokenizer_path

MODEL = "piece_bpe_32k.model"
DEPTH = 16
LEARN_CHARS = 1 << 19
BLANK = "▁"
_NEVER = np.int64(1 << 40)
_ENCODERS: dict[str, PieceEncoder] = {}


def piece_encoder(name_or_path: str) -> PieceEncoder:
    """The worker's encoder for this model (loaded once per Python worker)."""
    if name_or_path not in _ENCODERS:
        _ENCODERS[name_or_path] = PieceEncoder(tokenizer_path(name_or_path))
    return _ENCODERS[name_or_path]


class SuffixIndex:
    """Suffixes of a code array, sorted by their first 16 codes (0 separates and pads)."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        c = np.concatenate((codes, np.zeros(DEPTH, codes.dtype))).astype(np.uint64)
        k4 = c[:-3] << np.uint64(48) | c[1:-2] << np.uint64(32) | c[2:-1] << np.uint64(16) | c[3:]
        self.four, r4 = np.unique(k4, return_inverse=True)
        r4 = r4.astype(np.uint64)
        k8 = r4[:-4] << np.uint64(32) | r4[4:]
        self.eight, r8 = np.unique(k8, return_inverse=True)
        r8 = r8.astype(np.uint64)
        k16 = (r8[:-8] << np.uint64(32) | r8[8:])[:n]
        self.order = np.argsort(k16, kind="stable")
        self.k4, self.k8, self.k16 = k4[:n][self.order], k8[:n][self.order], k16[self.order]

    def _four_range(self, part: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of ranks among the 4-code strings that begin with the first ``size`` codes of ``part``."""
        room = (np.uint64(1) << (np.uint64(16) * (np.uint64(4) - size.astype(np.uint64)) % np.uint64(64))) - np.uint64(1)
        room = np.where(size == 0, np.uint64(0xFFFFFFFFFFFFFFFF), room)
        return np.searchsorted(self.four, part), np.searchsorted(self.four, part | room, side="right")

    def ranges(self, pieces: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pieces (rows of up to 16 codes, 0 padded): first and behind last place in ``order``."""
        p = pieces.astype(np.uint64)
        quad = [p[:, i] << np.uint64(48) | p[:, i + 1] << np.uint64(32) | p[:, i + 2] << np.uint64(16) | p[:, i + 3] for i in range(0, DEPTH, 4)]
        part = [np.clip(size - i, 0, 4) for i in range(0, DEPTH, 4)]
        four = [self._four_range(q, s) for q, s in zip(quad, part, strict=True)]
        shift = np.uint64(32)

        def eight_range(i):  # ranks among the 8-code strings that begin with codes 4 i ..
            a, b = four[i][0].astype(np.uint64), four[i][1].astype(np.uint64)
            whole = part[i] == 4
            lo = np.where(whole, a << shift | four[i + 1][0].astype(np.uint64), a << shift)
            hi = np.where(whole, a << shift | four[i + 1][1].astype(np.uint64), b << shift)
            hi = np.where(whole & (b == a), lo, hi)
            return lo, hi

        lo8, hi8 = eight_range(0)
        lo, hi = np.searchsorted(self.k8, lo8), np.searchsorted(self.k8, hi8)
        long = np.flatnonzero(size > 8)
        if len(long):
            head = np.searchsorted(self.eight, lo8)
            at = np.minimum(head, len(self.eight) - 1)
            there = (self.eight[at] == lo8) & (hi8 > lo8)
            lo2, hi2 = eight_range(2)
            a, b = np.searchsorted(self.eight, lo2).astype(np.uint64), np.searchsorted(self.eight, hi2).astype(np.uint64)
            first = head.astype(np.uint64) << shift
            lo16, hi16 = np.searchsorted(self.k16, first | a), np.searchsorted(self.k16, first | b)
            lo[long], hi[long] = lo16[long], np.where(there, hi16, lo16)[long]
        return lo, np.maximum(lo, hi)


class PieceEncoder(BatchEncoder):
    def __init__(self, path: str, cache_pieces: int = 600_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cache_pieces = cache_pieces
        self.power = np.ones(1, dtype=np.uint64)
        self.inverse = np.ones(1, dtype=np.uint64)
        self._load()
        self._clear()

    # -- the vocabulary -------------------------------------------------------------------------------------------

    def _load(self) -> None:
        m, n = self.model, self.model.get_piece_size()
        text = [m.id_to_piece(i) for i in range(n)]
        usual = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        if (longest := max((len(text[i]) for i in usual if text[i].strip(BLANK)), default=0)) > DEPTH:
            raise ValueError(f"a piece of {longest} characters; the suffix order compares {DEPTH}")
        self.byte_id = {int(text[i][3:5], 16): i for i in range(n) if m.is_byte(i)}
        self.unknown = m.unk_id()
        if len(self.byte_id) != 256:
            raise ValueError("a model without byte fallback")
        self.id_of = {text[i]: i for i in usual}
        self.blank = self.id_of[BLANK]
        self.runs = {len(t) for t in self.id_of if len(t) > 1 and not t.strip(BLANK)}
        if any(BLANK in t.lstrip(BLANK) or t.startswith(BLANK * 2) and t.strip(BLANK) for t in self.id_of):
            raise ValueError("pieces that go over a blank are not supported")
        chars = sorted({t for t in self.id_of if len(t) == 1})
        self.code = {c: k + 1 for k, c in enumerate(chars)}
        table_size = max(map(ord, chars)) + 1
        self.code_of = np.zeros(table_size, dtype=np.uint16)
        self.code_of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1, dtype=np.uint16)
        merged = sorted((i for i in usual if len(text[i]) > 1 and text[i].strip(BLANK)), key=lambda i: (-m.get_score(i), i))
        self.rank = np.full(n, -1, dtype=np.int64)
        self.rank[merged] = np.arange(len(merged))
        pairs = {}
        for i in merged:
            t = text[i]
            for k in range(1, len(t)):
                a, b = self.id_of.get(t[:k]), self.id_of.get(t[k:])
                if a is not None and b is not None:
                    pairs[(a, b)] = i
        self.left, self.right = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        reached = []
        for i in merged:
            parts = [self.id_of[c] for c in text[i]] if all(c in self.id_of for c in text[i]) else []
            while len(parts) > 2:
                best = min(((int(self.rank[pairs[p]]), k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in pairs), default=None)
                if best is None or best[0] >= self.rank[i]:
                    break
                k = best[1]
                parts[k : k + 2] = [pairs[(parts[k], parts[k + 1])]]
            if len(parts) == 2 and pairs.get((parts[0], parts[1])) == i:
                self.left[i], self.right[i] = parts
                reached.append(i)
        key = sorted((a * n + b, int(self.rank[i])) for (a, b), i in pairs.items())
        self.pair_key = np.array([k for k, _ in key], dtype=np.int64)
        self.pair_rank = np.array([r for _, r in key], dtype=np.int64)
        self.n = n
        self.piece_len = np.array([len(t) for t in text], dtype=np.int64)
        used = [self.id_of[c] for c in chars] + reached
        self.searched = np.array(used, dtype=np.int64)
        self.piece_codes = np.zeros((len(used), DEPTH), dtype=np.uint16)
        for k, i in enumerate(used):
            self.piece_codes[k, : len(text[i])] = [self.code[c] for c in text[i]]
        # signs that no piece holds behind a letter or digit: a word may be cut before them
        inner = {b for t in self.id_of for a, b in zip(t, t[1:], strict=False) if a.isalnum()}
        self.sign = np.zeros(256, dtype=bool)
        self.sign[[ord(c) for c in "!\"#$%&()*+,-./:;=>?@[\\]^_{|}~<'" if c not in inner]] = True
        self.ask_key, self.ask_value = np.full(1 << 20, -1, dtype=np.int64), np.zeros(1 << 20, dtype=bool)
        raw = [b"" if m.is_control(i) else bytes([int(text[i][3:5], 16)]) if m.is_byte(i) else text[i].replace(BLANK, " ").encode() for i in range(n)]
        raw[self.unknown] = " ⁇ ".encode()
        self.out_len = np.array([len(r) for r in raw], dtype=np.int64)
        self.out_start = np.cumsum(self.out_len) - self.out_len
        self.out = np.frombuffer(b"".join(raw), dtype=np.uint8)

    # -- which pieces stay apart ----------------------------------------------------------------------------------

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """If no merge across the border of a and b comes before those that make a and b."""
        key = a * self.n + b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        out = self.ask_value[slot]
        miss = np.flatnonzero(self.ask_key[slot] != key)
        if len(miss):
            uniq, back = np.unique(key[miss], return_inverse=True)
            found = self._follow(uniq // self.n, uniq % self.n)
            out[miss] = found[back]
            self.ask_value[slot[miss]], self.ask_key[slot[miss]] = out[miss], key[miss]
            # two new pairs may share a slot: its value must be that of the key that stayed
            at = slot[miss]
            lost = self.ask_key[at] != key[miss]
            self.ask_key[at[lost]] = -1
        return out

    def _follow(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Back in time: the last of x to the left and the first of y to the right of the border, as long
        as one of them is made of two. ``until_x``, ``until_y``: the merges that take them away."""
        ok = np.ones(len(x), dtype=bool)
        x, y = x.copy(), y.copy()
        until_x, until_y = np.full(len(x), _NEVER), np.full(len(x), _NEVER)
        live = np.arange(len(x))
        while len(live):
            a, b = x[live], y[live]
            key = a * self.n + b
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            across = np.where(self.pair_key[at] == key, self.pair_rank[at], _NEVER)
            bad = (across < until_x[live]) & (across <= until_y[live]) & (across < _NEVER)
            ok[live[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go_x = ~bad & (ra > rb)
            go_y = ~bad & (rb >= ra) & (rb >= 0)
            i, j = live[go_x], live[go_y]
            until_x[i], x[i] = ra[go_x], self.right[a[go_x]]
            until_y[j], y[j] = rb[go_y], self.left[b[go_y]]
            live = live[go_x | go_y]
        return ok

    # -- words ----------------------------------------------------------------------------------------------------

    def _run(self, k: int) -> list[int]:
        """Ids of ``k`` blanks: equal merges, the leftmost possible one first."""
        out: list[int] = []
        for _ in range(k):
            out.append(1)
            while len(out) > 1 and out[-2] + out[-1] in self.runs:
                out[-2:] = [out[-2] + out[-1]]
        return [self.id_of[BLANK * n] for n in out]

    def _ids_of(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        each: list[list[int]] = [[]] * len(pieces)
        held, chars = [], 0
        for k, p in enumerate(pieces):
            word = p.decode("utf-8", "surrogatepass").replace(" ", BLANK)
            held.append((k, word))
            chars += len(word) + 1
            if chars >= LEARN_CHARS:
                self._match(held, each)
                held, chars = [], 0
        if held:
            self._match(held, each)
        sizes = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
        return np.fromiter((x for e in each for x in e), dtype=np.int32, count=int(sizes.sum())), sizes

    def _match(self, held: list[tuple[int, str]], each: list[list[int]]) -> None:
        blanks = [len(w) - len(w.lstrip(BLANK)) for _, w in held]
        words = [w[max(0, b - 1) :] for (_, w), b in zip(held, blanks, strict=True)]
        found = self._split(words)
        for (k, _), b, word, ids in zip(held, blanks, words, found, strict=True):
            if b > 1:
                alone = ids[0] == self.blank
                ids = self._run(b if alone else b - 1) + (ids[1:] if alone else ids)
            each[k] = ids

    def _split(self, words: list[str]) -> list[list[int]]:
        size = np.array([len(w) for w in words], dtype=np.int64)
        start = np.cumsum(size + 1) - size - 1
        chars = np.frombuffer("\0".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        codes = self.code_of[np.minimum(chars, len(self.code_of) - 1)]
        codes = np.where(chars < len(self.code_of), codes, 0).astype(np.uint16)
        inside = np.ones(len(chars), dtype=bool)
        inside[(start + size)[:-1]] = False
        index = SuffixIndex(codes)
        lo, hi = index.ranges(self.piece_codes, self.piece_len[self.searched])
        count = hi - lo
        ends = np.cumsum(count)
        at = index.order[np.arange(int(ends[-1])) + np.repeat(lo - (ends - count), count)]
        piece = np.repeat(self.searched, count)
        strange = np.flatnonzero(inside & (codes == 0))
        at = np.concatenate((at, strange))
        piece = np.concatenate((piece, np.full(len(strange), self.unknown, dtype=np.int64)))
        length = np.where(piece == self.unknown, 1, self.piece_len[piece])
        to = at + length
        owner = np.repeat(start, size + 1)[: len(chars)]
        depth = to - owner[at]
        order = np.argsort(depth.astype(np.uint16) if depth.max(initial=0) < 65536 else depth, kind="stable")
        at, piece, to, depth = at[order], piece[order], to[order], depth[order]
        last = np.full(len(chars) + 1, -1, dtype=np.int64)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(depth)) + 1, [len(depth)])).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            p, t = at[a:b], piece[a:b]
            before = last[p]
            ok = (before < 0) | (before == self.unknown) | (t == self.unknown)
            ask = np.flatnonzero(~ok)
            if len(ask):
                ok[ask] = self._apart(before[ask], t[ask])
            last[to[a:b][ok]] = t[ok]
        # back from the end of every word
        here, steps = start + size, []
        live = np.flatnonzero(size > 0)
        while len(live):
            t = last[here[live]]
            steps.append((live, t))
            here[live] -= np.where(t == self.unknown, 1, self.piece_len[t])
            live = live[here[live] > start[live]]
        n = np.zeros(len(words), dtype=np.int64)
        for rows, _ in steps:
            n[rows] += 1
        stop = np.cumsum(n)
        flat = np.zeros(int(stop[-1]) if len(stop) else 0, dtype=np.int64)
        for k, (rows, t) in enumerate(steps):
            flat[stop[rows] - 1 - k] = t
        flat = flat.tolist()
        out = [flat[b - c : b] for b, c in zip(stop.tolist(), n.tolist(), strict=True)]
        if len(strange):
            for w in np.unique(np.searchsorted(start, strange, side="right") - 1).tolist():
                out[w] = self._with_bytes(words[w], out[w])
        return out

    def _with_bytes(self, word: str, ids: list[int]) -> list[int]:
        out, at = [], 0
        for i in ids:
            if i == self.unknown:
                out += [self.byte_id[x] for x in word[at].encode("utf-8", "surrogatepass")]
                at += 1
            else:
                out.append(i)
                at += int(self.piece_len[i])
        return out

    # -- texts ----------------------------------------------------------------------------------------------------

    def encode(self, texts: pa.Array | list) -> list[np.ndarray]:
        """One int32 id array per text (null: empty), equal to the model's own ``encode``."""
        col = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string()).fill_null("")
        col = pc.replace_substring(col, BLANK, " ")
        empty = pc.equal(col, "")
        col = pc.if_else(empty, col, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), col, pa.scalar(" ", pa.large_string())))
        n = len(col)
        if not n:
            return []
        off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + n + 1]
        if off[-1] == off[0]:
            return [np.zeros(0, dtype=np.int32)] * n
        data = np.frombuffer(col.buffers()[2].slice(int(off[0]), int(off[-1] - off[0])), dtype=np.uint8)
        off = off - off[0]
        cut = data == 10
        cut[1:] |= data[:-1] == 10
        cut[1:] |= (data[1:] == 32) & (data[:-1] != 32)
        letter = (data >= 48) & (data <= 57) | (data >= 65) & (data <= 90) | (data >= 97) & (data <= 122)
        cut[1:] |= self.sign[data[1:]] & letter[:-1]
        cut[off[:-1][np.diff(off) > 0]] = True
        starts = np.flatnonzero(cut)
        return self._encode_pieces(data, off, starts, np.append(starts[1:], len(data)))

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts of id arrays."""
        out = []
        for x in ids:
            x = np.asarray(x, dtype=np.int64)
            size = self.out_len[x]
            ends = np.cumsum(size)
            at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.out_start[x] - (ends - size), size)
            raw = self.out[at].tobytes()
            out.append((raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace"))
        return out


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, ids, text`` for every document."""

    def run(batches):
        enc = piece_encoder(model)
        for b in batches:
            ids = enc.encode(b.column("text"))
            flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())), b.column("text")], names=["doc_id", "ids", "text"]
            )

    return id_text(docs).mapInArrow(run, "doc_id long, ids array<int>, text string")


def round_trip(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """Decodes the ids: ``doc_id, n_tokens, ids_crc32, n_chars`` of the decoded text, ``same`` as the text."""

    def run(batches):
        enc = piece_encoder(model)
        for b in batches:
            col = b.column("ids")
            flat, at = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
            ids = [flat[at[i] : at[i + 1]] for i in range(len(col))]
            back = enc.decode(ids)
            same = [x == y for x, y in zip(back, b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array([crc32_u32(x) for x in ids], pa.int64()), pa.array([len(x) for x in back], pa.int64()), pa.array(same, pa.bool_())],
                names=["doc_id", "n_tokens", "ids_crc32", "n_chars", "same"],
            )

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, n_chars long, same boolean")


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(encode(table(spark, sf_dir, "documents")))
