"""Text encoders (K1): texts -> unit vectors.

The default encoder is deterministic and Spark-native: tokens are hashed into ``dim``
buckets and weighted by ``idf = ln(1 + N / df)`` over the corpus it was fitted on.
A model can replace it: :func:`model_encoder` makes an encoder that ``build_index`` and ``recommend`` take.

Plan shape (corpus side): a text's tokens are counted in its row (``packed_terms``); with the token statistics as a bounded
broadcast table, one scan of those rows gives the vectors. Statistics beyond the budget are joined on ``token`` (AQE
splits hot tokens), then aggregated to (Id, bucket) and to the dense vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomescope.config import DEFAULT, Params
from tomescope.functions.vectors import ZERO_NORM_GUARD
from tomescope.operators.joins import bounded_broadcast

TOKEN_PATTERN = r"([\p{L}\p{N}]+)"
CHUNK_TOKENS = 64
SCAN_ROWS = 2048  # texts whose vectors a task makes at a time


def tokens(text: Column | str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(TOKEN_PATTERN), 1)


def token_bucket(tok: Column, dim: int) -> Column:
    """First 32 bits of md5(token), modulo dim."""
    return F.pmod(F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")


def term_counts(docs: DataFrame, id_col: str, text_col: str, keep_empty: bool = False) -> DataFrame:
    """(id, token, tf) with the partial aggregation done before the shuffle.
    ``keep_empty`` keeps one (id, null, 1) row for a text without tokens."""
    ex = F.explode_outer if keep_empty else F.explode
    return (
        docs.select(F.col(id_col).alias("_id"), ex(tokens(text_col)).alias("token"))
        .groupBy("_id", "token")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def packed_terms(docs: DataFrame, id_col: str, text_col: str, params: Params = DEFAULT) -> DataFrame:
    """(id, dl, terms ARRAY<STRUCT<token, tf>>): one row per id, texts without a token with none. Rows of one text are counted in
    their Arrow batch, without an exchange; only ids that repeat are brought together, by (id, token)."""
    from tomescope.session import ship_package

    ship_package(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    again = texts.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(F.col("_id").alias("_again"))
    repeats = again.count()
    same = F.col("_id").eqNullSafe(F.col("_again"))
    keys = bounded_broadcast(again, repeats, 64, params)
    alone = texts.join(keys, same, "left_anti") if repeats else texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lens = b.column("_t").value_lengths().to_numpy().astype(np.int64)
            coded = b.column("_t").flatten().dictionary_encode()
            width = max(len(coded.dictionary), 1)
            cells, tf = np.unique(np.repeat(np.arange(len(lens)) * width, lens) + coded.indices.to_numpy(), return_counts=True)
            ends = np.searchsorted(cells, np.arange(len(lens) + 1) * width).astype(np.int32)
            terms = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(cells % width)), pa.array(tf.astype(np.int64))], names=["token", "tf"])
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(lens), pa.ListArray.from_arrays(pa.array(ends), terms)], names=["_id", "dl", "terms"])

    kind = texts.schema["_id"].dataType.simpleString()
    packed = alone.select("_id", tokens("_text").alias("_t")).mapInArrow(run, f"_id {kind}, dl long, terms array<struct<token:string,tf:bigint>>")
    if repeats:
        there = F.col("token").isNotNull()
        counts = term_counts(texts.join(keys, same, "left_semi"), "_id", "_text", keep_empty=True)
        merged = counts.groupBy("_id").agg(F.coalesce(F.sum(F.when(there, F.col("tf"))), F.lit(0)).alias("dl"), F.collect_list(F.when(there, F.struct("token", "tf"))).alias("terms"))
        packed = packed.unionByName(merged)
    return packed.withColumnRenamed("_id", id_col)


def counts_of(packed: DataFrame, id_col: str) -> DataFrame:
    """Term counts (_id, token, tf) of ``packed_terms``, as ``term_counts`` makes them with ``keep_empty``."""
    return packed.select(F.col(id_col).alias("_id"), F.inline_outer("terms"))


def frequencies(packed: DataFrame) -> DataFrame:
    """(token, df) of ``packed_terms``: an exchange of one row a task and token."""
    return packed.select(F.explode("terms.token").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def _bucket_sums(packed: DataFrame, id_col: str, dim: int, table, schema: str, out: Callable) -> DataFrame:
    """One scan of packed terms: ``out(ids, sums, there)`` makes batches of the sums (rows x dim) and of the buckets that have a token.
    ``table`` is a token table; None: tokens count as often as they occur."""
    from tomescope.session import ship_package

    ship_package(packed.sparkSession)
    shared = packed.sparkSession.sparkContext.broadcast(table)
    key = (lambda t: token_bucket(t["token"], dim).cast("long")) if table is None else (lambda t: F.xxhash64(t["token"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, SCAN_ROWS):
                b = whole.slice(lo, SCAN_ROWS)
                col = b.column("_h")
                at, weights = col.flatten().to_numpy(), b.column("_f").flatten().to_numpy().astype(np.float64)
                if shared.value is not None:
                    at, idf = shared.value.places(at, b.column("_s") if "_s" in b.schema.names else None, dim)
                    weights = weights * idf
                cell = np.repeat(np.arange(b.num_rows) * dim, col.value_lengths().to_numpy()) + at
                sums, there = np.bincount(cell, weights=weights, minlength=b.num_rows * dim), np.bincount(cell, minlength=b.num_rows * dim) > 0
                yield out(b.column("_id"), sums.reshape(-1, dim), there.reshape(-1, dim))

    words = [F.col("terms.token").alias("_s")] if table is not None and table.once is not None else []
    hashed = packed.select(F.col(id_col).alias("_id"), F.transform("terms", key).alias("_h"), F.col("terms.tf").alias("_f"), *words)
    return hashed.mapInArrow(run, schema)


def packed_vectors(packed: DataFrame, id_col: str, dim: int, stats: TokenStats, out_col: str = "vec", params: Params = DEFAULT) -> DataFrame:
    """(id, vec) unit vectors of ``packed_terms``: one scan while the token table fits the broadcast budget, beyond it a join on the token."""
    table = token_table(stats, dim, params)
    if table is None:
        return dense_from_counts(counts_of(packed, id_col), id_col, dim, stats, out_col)

    def out(ids: pa.Array, sums: np.ndarray, there: np.ndarray) -> pa.RecordBatch:
        norm = np.sqrt((sums * sums).sum(axis=1))
        unit = (sums / np.where(norm == 0, ZERO_NORM_GUARD, norm)[:, None]).astype(np.float32)
        ends = np.arange(len(unit) + 1, dtype=np.int32) * dim
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(unit.ravel()))], names=[id_col, out_col])

    return _bucket_sums(packed, id_col, dim, table, f"`{id_col}` {packed.schema[id_col].dataType.simpleString()}, `{out_col}` array<float>", out)


def _parts(text: Column, size: int) -> Column:
    if size < 1:
        raise ValueError("a chunk has at least one token")
    pattern = r"((?:\A[^\p{L}\p{N}]*)?(?:[\p{L}\p{N}]+[^\p{L}\p{N}]*){1,%d})" % size
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 1)


def chunk_texts(docs: DataFrame, id_col: str, text_col: str, size: int = CHUNK_TOKENS) -> DataFrame:
    """(id, chunk, text): every text cut after each ``size`` tokens, numbered from 0. The chunks of a text with tokens joined again give
    the whole text; a text without a token, or null, is one empty chunk. One scan of the text, no shuffle."""
    cut = docs.select(F.col(id_col), F.posexplode_outer(_parts(F.col(text_col), size)).alias("chunk", "_part"))
    return cut.select(id_col, F.coalesce("chunk", F.lit(0)).alias("chunk"), F.coalesce("_part", F.lit("")).alias("text"))


def chunk_counts(docs: DataFrame, id_col: str, text_col: str, size: int = CHUNK_TOKENS) -> DataFrame:
    """Term counts of chunks, made with ``keep_empty``; ``_id`` is a struct of the id and ``chunk``."""
    keyed = chunk_texts(docs, id_col, text_col, size).select(F.struct(id_col, "chunk").alias("_key"), "text")
    return term_counts(keyed, "_key", "text", keep_empty=True)


def chunk_stats(docs: DataFrame, text_col: str, size: int = CHUNK_TOKENS) -> TokenStats:
    """Document statistics of texts whose chunks are encoded; a row is a text. A text's tokens are made distinct in its row, so
    the exchange holds one row a task and token."""
    parts = F.transform(_parts(F.col(text_col), size), tokens)
    df = docs.select(F.explode(F.array_distinct(F.flatten(parts))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return TokenStats(df, docs.count())


def dense_chunks(counts: DataFrame, id_col: str, dim: int, stats: TokenStats | None = None, out_col: str = "vec") -> DataFrame:
    """(id, chunk, vec): a unit vector per chunk from ``chunk_counts``."""
    return unkeyed(dense_from_counts(counts, "_key", dim, stats, out_col), id_col, out_col)


def unkeyed(vectors: DataFrame, id_col: str, out_col: str) -> DataFrame:
    return vectors.select(F.col("_key")[id_col].alias(id_col), F.col("_key")["chunk"].alias("chunk"), out_col)


def encode_chunks(docs: DataFrame, id_col: str, text_col: str, encoder: Callable, size: int = CHUNK_TOKENS, out_col: str = "vec") -> DataFrame:
    """(id, chunk, vec) by any encoder ``(docs, id column, text column, vector column)``, such as that of ``model_encoder``."""
    keyed = chunk_texts(docs, id_col, text_col, size).select(F.struct(id_col, "chunk").alias("_key"), "text")
    return unkeyed(encoder(keyed, "_key", "text", out_col), id_col, out_col)


TABLE_ROW_BYTES = 12


@dataclass
class TokenTable:
    """Token hashes in order, with their buckets and the place of their IDF weight in ``levels`` (a weight per document frequency).
    With ``once``, the weight of a token that only one text has, such tokens are not in the table; their bucket is made from the token itself."""

    hashes: np.ndarray
    buckets: np.ndarray
    level: np.ndarray
    levels: np.ndarray
    once: float | None

    def places(self, at: np.ndarray, words: pa.Array | None, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and weights of the token hashes ``at``; ``words`` are lists of the tokens themselves, in the same order."""
        place = np.minimum(np.searchsorted(self.hashes, at), max(len(self.hashes) - 1, 0))
        known = self.hashes[place] == at if len(self.hashes) else np.zeros(len(at), dtype=bool)
        if known.all():
            return self.buckets[place].astype(np.int64), self.levels[self.level[place]]
        if self.once is None:
            raise ValueError("a token without statistics: they must be of the same texts and chunk size")
        buckets, weights = np.empty(len(at), dtype=np.int64), np.full(len(at), self.once)
        buckets[known], weights[known] = self.buckets[place[known]], self.levels[self.level[place[known]]]
        rare = words.flatten().take(pa.array(np.flatnonzero(~known))).cast(pa.binary()).to_pylist()
        buckets[~known] = [int.from_bytes(hashlib.md5(t).digest()[:4], "big") % dim for t in rare]
        return buckets, weights


def token_table(stats: TokenStats, dim: int, params: Params) -> TokenTable | None:
    """The token table while it fits the broadcast budget and no two tokens share a hash; else None. A vocabulary beyond the budget is
    mostly tokens of one text each: then the table holds the others."""
    often = F.coalesce(F.col("df"), F.lit(1)) > 1
    n = stats.df.agg(F.count(F.lit(1)).alias("all"), F.count(F.when(often, 1)).alias("often")).first()
    h, kept = F.xxhash64("token").alias("h"), stats.df
    whole = n["all"] * TABLE_ROW_BYTES <= params.max_broadcast_bytes
    if not whole:
        if n["often"] * TABLE_ROW_BYTES > params.max_broadcast_bytes or not stats.df.groupBy(h).count().where("count > 1").isEmpty():
            return None
        kept = stats.df.where(often)
    got = kept.select(h, token_bucket(F.col("token"), dim).alias("b"), stats.idf(F.col("df")).alias("w")).toArrow()
    hashes, b, w = (got.column(c).to_numpy() for c in ("h", "b", "w"))
    order = np.argsort(hashes)
    hashes = hashes[order]
    if (hashes[1:] == hashes[:-1]).any():
        return None
    levels, level = np.unique(w[order], return_inverse=True)
    once = None if whole else float(stats.df.sparkSession.range(1).select(stats.idf(F.lit(1))).first()[0])
    small = lambda x, n: x.astype(np.min_scalar_type(max(n - 1, 0)))
    return TokenTable(hashes, small(b[order], dim), small(level, len(levels)), levels, once)


def chunk_vectors(docs: DataFrame, id_col: str, text_col: str, dim: int, stats: TokenStats, size: int = CHUNK_TOKENS, params: Params = DEFAULT) -> DataFrame:
    """(id, chunk, vec) with ``chunk_stats`` of the same texts: one scan and no shuffle while the token table fits the broadcast budget, beyond it
    a join on the token."""
    if (table := token_table(stats, dim, params)) is not None:
        return _scan_vectors(chunk_texts(docs, id_col, text_col, size), id_col, dim, table, whole=False)
    return dense_chunks(chunk_counts(docs, id_col, text_col, size), id_col, dim, stats)


def text_vectors(docs: DataFrame, id_col: str, text_col: str, dim: int, stats: TokenStats, size: int = CHUNK_TOKENS, params: Params = DEFAULT) -> DataFrame:
    """(id, vec), one vector a text, as ``chunk_vectors`` makes them: the chunks of a text follow each other in its task and are summed there."""
    if (table := token_table(stats, dim, params)) is not None:
        return _scan_vectors(chunk_texts(docs, id_col, text_col, size), id_col, dim, table, whole=True)
    return encode_dense(docs, id_col, text_col, dim, stats)


def _scan_vectors(chunks: DataFrame, id_col: str, dim: int, table, whole: bool) -> DataFrame:
    from tomescope.session import ship_package

    ship_package(chunks.sparkSession)
    shared = chunks.sparkSession.sparkContext.broadcast(table)
    names = [id_col, "vec"] if whole else [id_col, "chunk", "vec"]

    def batch(cols: list[pa.Array], sums: np.ndarray) -> pa.RecordBatch:
        norm = np.sqrt((sums * sums).sum(axis=1))
        unit = (sums / np.where(norm == 0, ZERO_NORM_GUARD, norm)[:, None]).astype(np.float32)
        ends = np.arange(len(unit) + 1, dtype=np.int32) * dim
        return pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(ends), pa.array(unit.ravel()))], names=names)

    def sums_of(b: pa.RecordBatch) -> np.ndarray:
        col = b.column("_h")
        at, weights = shared.value.places(col.flatten().to_numpy(), b.column("_s") if "_s" in b.schema.names else None, dim)
        cell = np.repeat(np.arange(b.num_rows) * dim, col.value_lengths().to_numpy())
        return np.bincount(cell + at, weights=weights, minlength=b.num_rows * dim).reshape(-1, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, open_sum = None, None  # the text whose chunks may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            ids, sums = b.column(id_col), sums_of(b)
            if not whole:
                yield batch([ids, b.column("chunk")], sums)
                continue
            first = np.flatnonzero(b.column("chunk").to_numpy() == 0)
            lead = first[0] if len(first) else b.num_rows
            if lead:
                open_sum = open_sum + sums[:lead].sum(axis=0)
            if len(first):
                if open_sum is not None:
                    yield batch([open_id], open_sum[None, :])
                texts = np.add.reduceat(sums, first, axis=0)
                if len(first) > 1:
                    yield batch([ids.take(pa.array(first[:-1]))], texts[:-1])
                open_id, open_sum = ids.slice(int(first[-1]), 1), texts[-1]
        if open_sum is not None:
            yield batch([open_id], open_sum[None, :])

    words = ["_s"] if table.once is not None else []
    hashed = chunks.select(id_col, "chunk", tokens("text").alias("_s")).select(id_col, "chunk", F.transform("_s", lambda t: F.xxhash64(t)).alias("_h"), *words)
    kind = chunks.schema[id_col].dataType.simpleString()
    return hashed.mapInArrow(run, f"`{id_col}` {kind}, {'' if whole else 'chunk int, '}vec array<float>")


@dataclass
class TokenStats:
    """Corpus statistics the IDF weights come from: ``df`` per token and ``n_docs``."""

    df: DataFrame  # (token, df)
    n_docs: int

    def idf(self, df_col: Column) -> Column:
        return F.log(F.lit(1.0) + F.lit(float(self.n_docs)) / F.coalesce(df_col, F.lit(1)).cast("double"))


def fit_token_stats(docs: DataFrame, id_col: str, text_col: str) -> TokenStats:
    return TokenStats(df=frequencies(packed_terms(docs, id_col, text_col)), n_docs=docs.select(id_col).count())


def encode_sparse(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    dim: int,
    stats: TokenStats | None = None,
    normalize: bool = True,
) -> DataFrame:
    """(id, bucket, value): hashed term counts, times IDF when ``stats`` is given,
    L2-normalised per id (a zero vector stays zero). One scan while the token table fits the broadcast budget."""
    packed = packed_terms(docs, id_col, text_col)
    table = None if stats is None else token_table(stats, dim, DEFAULT)
    if stats is None or table is not None:

        def out(ids: pa.Array, sums: np.ndarray, there: np.ndarray) -> pa.RecordBatch:
            if normalize:
                norm = np.sqrt((sums * sums).sum(axis=1))
                sums = sums / np.where(norm == 0, ZERO_NORM_GUARD, norm)[:, None]
            row, bucket = np.nonzero(there)
            return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(bucket.astype(np.int32)), pa.array(sums[row, bucket])], names=[id_col, "bucket", "value"])

        return _bucket_sums(packed, id_col, dim, table, f"`{id_col}` {packed.schema[id_col].dataType.simpleString()}, bucket int, value double", out)
    cells = _cells_from_counts(counts_of(packed.where(F.col("dl") > 0), id_col), dim, stats)
    if normalize:
        norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(_by_id()))
        cells = cells.withColumn("value", F.col("value") / F.when(norm == 0, F.lit(ZERO_NORM_GUARD)).otherwise(norm))
    return cells.withColumnRenamed("_id", id_col)


def _cells_from_counts(tc: DataFrame, dim: int, stats: TokenStats | None) -> DataFrame:
    if stats is not None:
        tc = tc.join(stats.df, "token", "left").withColumn("w", F.col("tf") * stats.idf(F.col("df")))
    else:
        tc = tc.withColumn("w", F.col("tf").cast("double"))
    return tc.groupBy("_id", token_bucket(F.col("token"), dim).alias("bucket")).agg(F.sum("w").alias("value"))


def _by_id():
    from pyspark.sql import Window

    return Window.partitionBy("_id")


def _densify_udf(dim: int):
    """Arrow UDF: (bucket array, value array, norm) -> dense float vector of ``dim``.
    One vectorised NumPy scatter per batch; no per-element SQL lambdas."""

    @F.pandas_udf("array<float>")
    def densify(buckets: pd.Series, values: pd.Series, norms: pd.Series) -> pd.Series:
        n = len(buckets)
        out = np.zeros((n, dim), dtype=np.float64)
        lens = np.fromiter((len(b) for b in buckets), dtype=np.int64, count=n)
        if lens.sum():
            rows = np.repeat(np.arange(n), lens)
            cols = np.concatenate([np.asarray(b, dtype=np.int64) for b in buckets if len(b)])
            vals = np.concatenate([np.asarray(v, dtype=np.float64) for v in values if len(v)])
            out[rows, cols] = vals
        nrm = norms.to_numpy(dtype=np.float64)
        nrm = np.where(nrm == 0, ZERO_NORM_GUARD, nrm)
        return pd.Series(list((out / nrm[:, None]).astype(np.float32)))

    return densify


def encode_dense(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    dim: int,
    stats: TokenStats | None = None,
    out_col: str = "vec",
) -> DataFrame:
    """(id, vec ARRAY<FLOAT>) unit vectors; texts without a token get the zero vector."""
    return dense_from_counts(term_counts(docs, id_col, text_col, keep_empty=True), id_col, dim, stats, out_col)


def dense_from_counts(tc: DataFrame, id_col: str, dim: int, stats: TokenStats | None = None, out_col: str = "vec") -> DataFrame:
    """Dense unit vectors from term counts (_id, token, tf) made with ``keep_empty``:
    a text without any token keeps one null-token row and comes out as the zero vector."""
    from tomescope.session import ship_package

    ship_package(tc.sparkSession)
    cells = _cells_from_counts(tc, dim, stats)
    present = F.col("bucket").isNotNull()
    packed = cells.groupBy("_id").agg(
        F.collect_list(F.when(present, F.struct(F.col("bucket"), F.col("value")))).alias("_e"),
        F.sqrt(F.sum(F.when(present, F.col("value") * F.col("value")).otherwise(0.0))).alias("_n"),
    )
    b = F.transform("_e", lambda e: e["bucket"])
    v = F.transform("_e", lambda e: e["value"])
    return packed.select(F.col("_id").alias(id_col), _densify_udf(dim)(b, v, F.col("_n")).alias(out_col))


_MODELS: dict = {}  # one entry per factory and Python worker


def worker_model(factory: Callable):
    """The factory's model, built once per Python worker (``factory`` must be importable by name)."""
    key = (factory.__module__, factory.__qualname__)
    if key not in _MODELS:
        _MODELS[key] = factory()
    return _MODELS[key]


def model_encoder(factory: Callable, batch_size: int = 256) -> Callable[[DataFrame, str, str, str], DataFrame]:
    """An encoder ``(docs, id_col, text_col, out_col) -> (id, vector)`` from ``factory()``, an object with
    ``encode(list[str], normalize_embeddings=True) -> ndarray``. Texts come in Arrow batches; null is ''."""

    def encode(docs: DataFrame, id_col: str, text_col: str, out_col: str = "vec") -> DataFrame:
        from tomescope.session import ship_package

        ship_package(docs.sparkSession)

        @F.pandas_udf("array<float>")
        def enc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = worker_model(factory)
            for s in batches:
                texts = s.fillna("").tolist()
                parts = [model.encode(texts[i : i + batch_size], normalize_embeddings=True) for i in range(0, len(texts), batch_size)]
                yield pd.Series([np.asarray(v, dtype="float32") for p in parts for v in p])

        return docs.select(id_col, enc(F.col(text_col)).alias(out_col))

    return encode


def model_pair_scorer(factory: Callable, batch_size: int = 256) -> Callable[[DataFrame], DataFrame]:
    """A pair scorer from ``factory()``, an object with ``predict(list[[query, text]]) -> scores``. It takes pairs with
    ``query_text`` and ``Description`` and adds ``semantic``."""

    def scorer(pairs: DataFrame) -> DataFrame:
        from tomescope.session import ship_package

        ship_package(pairs.sparkSession)

        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = worker_model(factory)
            for q, d in batches:
                both = [list(x) for x in zip(q.fillna(""), d.fillna(""), strict=True)]
                parts = [model.predict(both[i : i + batch_size]) for i in range(0, len(both), batch_size)]
                yield pd.Series([float(v) for p in parts for v in p], dtype="float64")

        return pairs.withColumn("semantic", score(F.col("query_text"), F.col("Description")))

    return scorer


class LetterModel:
    """A deterministic stand-in for a neural model: letter counts as vectors, shared length as pair score."""

    LETTERS = "aeinorst"

    def encode(self, texts, normalize_embeddings=True):
        x = np.array([[t.count(c) for c in self.LETTERS] for t in texts], dtype=np.float64).reshape(len(texts), len(self.LETTERS))
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(n == 0, ZERO_NORM_GUARD, n) if normalize_embeddings else x

    def predict(self, pairs):
        return [min(len(q), len(d)) / max(len(q), len(d), 1) for q, d in pairs]
