"""Rerank stage: BM25 pair scorer (K2, E5), min-max scaling (F1, F2, H4), the score blend
(C15), per-query cuts (H3, I2-I4) and best-row-per-author (F5, H2).

All per-query work is a window partitioned by ``query_id``. The cuts after reranking are
chained on ``query_id`` then (``query_id``, ``Authors``), which a hash partitioning on
``query_id`` satisfies, so the chain plans with one exchange. Groups are bounded by the
cut sizes (<= k_filtered rows per query), so no window partition can grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomescope.config import DEFAULT, Params
from tomescope.operators.encode import term_counts, tokens
from tomescope.operators.joins import bounded_broadcast
from tomescope.operators.knn import OUT_ROWS, final_topk
from tomescope.operators.passing import packed, unpacked
from tomescope.session import cut_lineage, ship_package

RUN_TOKENS = 5  # a passage is looked up by its first run of so many tokens


def holders(passages: DataFrame, docs: DataFrame, q_id: str, c_id: str, params: Params = DEFAULT) -> DataFrame:
    """(q_id, c_id): the documents that hold all tokens of a passage in a row. An equi join on the hash of the passage's first ``RUN_TOKENS`` tokens finds
    the candidates, the token sequences decide. Passages with fewer tokens or null have no holders."""
    joined = lambda toks: F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" "))
    hashes = lambda text: F.transform(tokens(text), lambda t: F.xxhash64(t)).alias("_h")
    run = lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(RUN_TOKENS)])
    asked = passages.select(q_id, hashes("text"), joined(tokens("text")).alias("_passage"))
    asked = cut_lineage(asked.where(F.size("_h") >= RUN_TOKENS).select(q_id, run(F.lit(0)).alias("_run"), "_passage"), "passages")
    starts = F.when(F.size("_h") >= RUN_TOKENS, F.sequence(F.lit(0), F.size("_h") - RUN_TOKENS))
    runs = docs.select(c_id, hashes("text")).select(c_id, F.explode(F.transform(starts, run)).alias("_run"))
    keys = bounded_broadcast(asked.select(q_id, "_run"), asked.count(), 32, params)
    pairs = runs.join(keys, "_run").select(q_id, c_id).distinct().join(asked.select(q_id, "_passage"), q_id)
    return pairs.join(docs.select(c_id, joined(tokens("text")).alias("_words")), c_id).where(F.contains("_words", "_passage")).select(q_id, c_id)


# --- BM25 -------------------------------------------------------------------


@dataclass
class Bm25Index:
    """Corpus side of BM25: one row per document with its terms, and per-token document frequencies."""

    docs: DataFrame  # (Id, dl, terms ARRAY<STRUCT<token, tf>>)
    df: DataFrame  # (token, df)
    n_docs: int
    avgdl: float


def documents_of(terms: DataFrame) -> DataFrame:
    """(Id, token, tf) -> one row per document; a document's terms are bounded by its own text."""
    return terms.groupBy("Id").agg(F.sum("tf").alias("dl"), F.collect_list(F.struct("token", "tf")).alias("terms"))


def bm25_idf(df_col: Column, n_docs: int) -> Column:
    """ln(1 + (N - df + 0.5) / (df + 0.5)), never negative."""
    d = F.coalesce(df_col, F.lit(0)).cast("double")
    return F.log(F.lit(1.0) + (F.lit(float(n_docs)) - d + 0.5) / (d + 0.5))


def query_term_weights(queries: DataFrame, index: Bm25Index, text_col: str = "query_text", inner: bool = False) -> DataFrame:
    """(query_id, token, idf) over the distinct tokens of each query."""
    qt = term_counts(queries, "query_id", text_col).select(F.col("_id").alias("query_id"), "token")
    qt = qt.join(index.df, "token", "inner" if inner else "left")
    return qt.select("query_id", "token", bm25_idf(F.col("df"), index.n_docs).alias("idf"))


def bm25_term(idf: Column, tf: Column, dl: Column, index: Bm25Index, params: Params = DEFAULT) -> Column:
    k1, b = params.bm25_k1, params.bm25_b
    avgdl = index.avgdl if index.avgdl > 0 else 1.0
    t = tf.cast("double")
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * dl.cast("double") / F.lit(avgdl))
    return idf * t * F.lit(k1 + 1) / (t + norm)


def rounded(c: Column, params: Params) -> Column:
    """Scores as they are, or rounded where ``params.score_decimals`` says so."""
    return c if params.score_decimals is None else F.round(c, params.score_decimals)


QUERY_BYTES = 64 * 1024 * 1024  # packed query tokens (hash and idf) that a task holds
QUERIES_AT_ONCE = 4096  # queries that meet a document's terms at a time


def bm25_pairs(
    pairs: DataFrame, queries: DataFrame, index: Bm25Index, params: Params = DEFAULT, text_col: str = "query_text"
) -> DataFrame:
    """Score every (query_id, Id) pair of ``pairs`` against its query text: adds ``bm25``.

    Neither the terms of a document nor the tokens of a query are repeated per pair. While the packed tokens of all queries fit ``QUERY_BYTES`` each task has them
    (``scored_pairs``): the pairs of a document meet it, with their columns, and need no join afterwards. Beyond that a document goes, with the ids of the queries
    it is a candidate of, to the tasks that hold those queries' tokens (``pair_sums``). Queries are dealt into groups of ``QUERY_BYTES``; a group goes to as many
    tasks as keep the cores busy, a document to one task of each group that asks for it. Tokens are compared by hash; where two share one,
    ``pair_sums_by_token`` does it."""
    qw = query_term_weights(queries, index, text_col, inner=True)
    keys = pairs.select("query_id", "Id")
    one_each = index.df.groupBy(F.xxhash64("token")).count().where("count > 1").isEmpty()
    if one_each:
        asked = asked_tokens(qw)
        if (known := query_tokens(asked)) is not None:
            return scored_pairs(pairs, known, index, params)
        sums = pair_sums(keys, asked, index, params)
    else:
        sums = pair_sums_by_token(keys, qw, index, params)
    return pairs.join(sums, ["query_id", "Id"], "left").withColumn("bm25", F.coalesce(F.col("bm25"), F.lit(0.0)))


def pair_sums_by_token(keys: DataFrame, weights: DataFrame, index: Bm25Index, params: Params = DEFAULT) -> DataFrame:
    """(query_id, Id, bm25) of the pairs that share a token: pairs x query tokens meet the postings on (Id, token)."""
    opened = index.docs.join(keys.select("Id").distinct(), "Id", "left_semi")
    postings = opened.select("Id", "dl", F.inline("terms"))
    x = keys.join(weights, "query_id").join(postings, ["Id", "token"])
    contrib = x.select("query_id", "Id", bm25_term(F.col("idf"), F.col("tf"), F.col("dl"), index, params).alias("c"))
    return contrib.groupBy("query_id", "Id").agg(F.sum("c").alias("bm25"))


def asked_tokens(weights: DataFrame) -> DataFrame:
    """(query_id, t ARRAY<STRUCT<h, w>>): token hashes and idf of each query; written."""
    token = F.struct(F.xxhash64("token").alias("h"), F.col("idf").alias("w"))
    return cut_lineage(weights.where(F.col("query_id").isNotNull()).groupBy("query_id").agg(F.collect_list(token).alias("t")), "query_tokens")


@dataclass
class QueryTokens:
    """The tokens of all queries as places in the ordered token hashes, packed by blocks of queries."""

    hashes: np.ndarray
    idf: np.ndarray
    blocks: list[tuple[bytes, bytes, bytes]]  # ids, numbers of tokens, places

    def opened(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query ids in order, with the start and number of their tokens, and the places of all tokens."""
        ids, sizes, places = (np.concatenate([unpacked(b[i], kind) for b in self.blocks] or [np.zeros(0, kind)]) for i, kind in enumerate(("<i8", "<i4", "<i4")))
        start, order = np.cumsum(sizes, dtype=np.int64) - sizes, np.argsort(ids, kind="stable")
        return ids[order], start[order], sizes[order], places


def query_tokens(asked: DataFrame) -> QueryTokens | None:
    """``asked_tokens`` for every task, while they fit ``QUERY_BYTES``: 4 bytes a token of a query, 16 a token of the vocabulary."""
    spark = asked.sparkSession
    ship_package(spark)
    words = asked.select(F.inline("t")).groupBy("h").agg(F.first("w").alias("w"))
    if (asked.agg(F.sum(F.size("t"))).first()[0] or 0) * 4 + words.count() * 16 > QUERY_BYTES:
        return None
    got = words.orderBy("h").toArrow()
    hashes = got.column("h").to_numpy()
    shared = spark.sparkContext.broadcast(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sizes, places = b.column("h").value_lengths().to_numpy(), np.searchsorted(shared.value, b.column("h").flatten().to_numpy())
                cols = b.column("query_id").to_numpy().astype("<i8"), sizes.astype("<i4"), places.astype("<i4")
                yield pa.RecordBatch.from_pydict({c: [packed(x)] for c, x in zip("abc", cols, strict=True)})

    rows = asked.select(F.col("query_id").cast("long"), F.col("t.h").alias("h")).mapInArrow(run, "a binary, b binary, c binary").collect()
    return QueryTokens(hashes, got.column("w").to_numpy(), [(bytes(r["a"]), bytes(r["b"]), bytes(r["c"])) for r in rows])


def scored_pairs(pairs: DataFrame, known: QueryTokens, index: Bm25Index, params: Params = DEFAULT) -> DataFrame:
    """``pairs`` with ``bm25``. A document comes once, with its terms that queries know and its pairs; a pair that is there twice counts twice, as in
    ``pair_sums_by_token``."""
    spark = pairs.sparkSession
    shared = spark.sparkContext.broadcast(known)
    k1, b, avgdl = params.bm25_k1, params.bm25_b, index.avgdl if index.avgdl > 0 else 1.0

    def known_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = shared.value.hashes
        for batch in batches:
            at, tf = batch.column("h").flatten().to_numpy(), batch.column("tf").flatten().to_numpy()
            place = np.minimum(np.searchsorted(hashes, at), max(len(hashes) - 1, 0))
            there = hashes[place] == at if len(hashes) else np.zeros(len(at), dtype=bool)
            doc = np.repeat(np.arange(batch.num_rows), batch.column("h").value_lengths().to_numpy())[there]
            order = np.lexsort((place[there], doc))
            place, tf = place[there][order].astype(np.int32), tf[there][order].astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=batch.num_rows))])
            terms = [packed(np.concatenate([np.diff(place[lo:hi], prepend=np.int32(0)), tf[lo:hi]])) for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("Id"), batch.column("dl"), pa.array(terms, pa.binary())], names=["Id", "_dl", "_terms"])

    terms = index.docs.select("Id", "dl", F.transform("terms", lambda t: F.xxhash64(t["token"])).alias("h"), F.col("terms.tf").alias("tf"))
    docs = terms.where(F.col("Id").isNotNull()).mapInArrow(known_terms, f"Id {index.docs.schema['Id'].dataType.simpleString()}, _dl long, _terms binary")
    both = F.col("query_id").isNotNull() & F.col("Id").isNotNull()
    names = pairs.columns
    others = [c for c in names if c != "Id"]
    rows = pairs.where(both).groupBy("Id").agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in others])).alias("_pairs")).join(docs, "Id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, start, sizes, places = shared.value.opened()
        idf, impact = shared.value.idf, np.zeros(len(shared.value.hashes))
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = batch.column("_pairs").offsets.to_numpy()
            here = batch.column("_pairs").values.slice(int(ends[0]), int(ends[-1] - ends[0]))
            ends = ends - ends[0]
            asking, score = here.field("query_id").to_numpy(), np.zeros(len(here))
            dl = batch.column("_dl").to_numpy(zero_copy_only=False)
            for i, terms in enumerate(batch.column("_terms").to_pylist()):
                if terms is None:
                    continue
                deltas, tf = np.split(unpacked(terms, "<i4"), 2)
                if not len(tf):
                    continue
                term, tf = np.cumsum(deltas), tf.astype(np.float64)
                impact[term] = idf[term] * (tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * dl[i] / avgdl)))
                query, back, times = np.unique(asking[ends[i] : ends[i + 1]], return_inverse=True, return_counts=True)
                got = np.zeros(len(query))
                for lo in range(0, len(query), QUERIES_AT_ONCE):
                    some = query[lo : lo + QUERIES_AT_ONCE]
                    place = np.minimum(np.searchsorted(ids, some), len(ids) - 1)
                    n = np.where(ids[place] == some, sizes[place], 0)
                    at = np.repeat(start[place] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    got[lo : lo + QUERIES_AT_ONCE] = np.bincount(np.repeat(np.arange(len(some)), n), weights=impact[places[at]], minlength=len(some))
                score[ends[i] : ends[i + 1]] = (got * times)[back]
                impact[term] = 0.0
            whose = batch.column("Id").take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(ends))))
            cols = {"Id": whose, "bm25": pa.array(score)} | {c: here.field(c) for c in others}
            yield pa.RecordBatch.from_arrays([cols[c] for c in [*names, "bm25"]], names=[*names, "bm25"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields) + ", bm25 double"
    return rows.mapInArrow(run, schema).unionByName(pairs.where(~both).withColumn("bm25", F.lit(0.0)))


def pair_sums(keys: DataFrame, asked: DataFrame, index: Bm25Index, params: Params = DEFAULT) -> DataFrame:
    """As ``pair_sums_by_token``, with the queries of a group held in a task while its documents pass; ``asked`` of ``asked_tokens``."""
    spark = keys.sparkSession
    ship_package(spark)
    groups = max(1, -(-(asked.agg(F.sum(F.size("t"))).first()[0] or 0) * 16 // QUERY_BYTES))
    parts = max(1, 3 * max(4, spark.sparkContext.defaultParallelism) // groups)
    group = F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("_g")
    part = F.pmod(F.xxhash64("Id"), F.lit(parts)).cast("int").alias("_h")
    none = F.lit(0).cast("double")
    held = asked.select(
        group, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_h"), F.lit(0).alias("_kind"), F.col("query_id").cast("long").alias("_id"), F.col("t.h").alias("_hash"),
        F.col("t.w").alias("_value"), none.alias("_dl"), F.array().cast("array<long>").alias("_asked"),
    )
    wanted = keys.where(F.col("query_id").isNotNull()).groupBy("Id", group).agg(F.collect_list(F.col("query_id").cast("long")).alias("_asked"))
    passing = index.docs.join(wanted, "Id").select(
        "_g", part, F.lit(1).alias("_kind"), F.col("Id").cast("long").alias("_id"), F.transform("terms", lambda t: F.xxhash64(t["token"])).alias("_hash"),
        F.transform("terms", lambda t: t["tf"].cast("double")).alias("_value"), F.col("dl").cast("double").alias("_dl"), "_asked",
    )
    rows = held.unionByName(passing).repartition(groups * parts, "_g", "_h").sortWithinPartitions("_g", "_h", "_kind")
    k1, b, avgdl = params.bm25_k1, params.bm25_b, index.avgdl if index.avgdl > 0 else 1.0

    def sent(out: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "Id", "bm25"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, got, ids = None, [], None
        for batch in batches:
            lists = {c: (batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy(zero_copy_only=False)) for c in ("_hash", "_value", "_asked")}
            of = lambda c, i, lists=lists: lists[c][1][lists[c][0][i] : lists[c][0][i + 1]]
            g, h, kind, row_id, dl = (batch.column(c).to_numpy() for c in ("_g", "_h", "_kind", "_id", "_dl"))
            out, made = [], 0
            for i in range(batch.num_rows):
                if (g[i], h[i]) != here:
                    here, got, ids = (g[i], h[i]), [], None
                if kind[i] == 0:
                    got.append((row_id[i], of("_hash", i).copy(), of("_value", i).copy()))
                    continue
                if not got:
                    continue
                if ids is None:
                    got.sort(key=lambda x: x[0])
                    ids, sizes = np.array([x[0] for x in got]), np.array([len(x[1]) for x in got])
                    start, hashes, idf = np.cumsum(sizes) - sizes, np.concatenate([x[1] for x in got]), np.concatenate([x[2] for x in got])
                    got = got[:1]
                order = np.argsort(of("_hash", i))
                mine, tf = of("_hash", i)[order], of("_value", i)[order]
                if not len(mine):
                    continue
                part = tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * dl[i] / avgdl))
                asking, often = np.unique(of("_asked", i), return_counts=True)
                for lo in range(0, len(asking), QUERIES_AT_ONCE):
                    query, times = asking[lo : lo + QUERIES_AT_ONCE], often[lo : lo + QUERIES_AT_ONCE]
                    place = np.minimum(np.searchsorted(ids, query), len(ids) - 1)
                    there = ids[place] == query
                    query, times, place = query[there], times[there], place[there]
                    n = sizes[place]
                    at = np.repeat(start[place] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    found = np.minimum(np.searchsorted(mine, hashes[at]), len(mine) - 1)
                    same = mine[found] == hashes[at]
                    owner, impact = np.repeat(np.arange(len(query)), n)[same], idf[at[same]] * part[found[same]]
                    some = np.bincount(owner, minlength=len(query)) > 0
                    score = np.bincount(owner, weights=impact, minlength=len(query)) * times
                    out.append((query[some], np.full(some.sum(), row_id[i]), score[some]))
                    made += len(query)
                    if made >= OUT_ROWS:
                        yield sent(out)
                        out, made = [], 0
            if out:
                yield sent(out)

    return rows.mapInArrow(run, "query_id long, Id long, bm25 double")


# --- BM25 search: inverted lists with block maxima ------------------------------------

POSTINGS = 256  # postings of one block
FIRST_GUESSES = 4  # documents scored in full for the limit, times k
SALT_ROWS = 1 << 16  # postings of a token that one window partition orders


def build_postings(index: Bm25Index, params: Params = DEFAULT) -> DataFrame:
    """Inverted lists as a written table: (token, salt, block, ids, impacts, top).

    An impact is a posting's BM25 term without the idf. A token's postings are dealt over a salt for every ``SALT_ROWS`` of them (a
    stop word goes to many tasks), ordered by impact within the salt, and cut into blocks whose largest impact is ``top``."""
    spread = index.df.select("token", F.ceil(F.col("df") / F.lit(SALT_ROWS)).cast("int").alias("salts"))
    terms = index.docs.select("Id", "dl", F.inline("terms")).join(spread, "token")
    salted = terms.select(
        "token", "Id", F.pmod(F.xxhash64("Id"), F.col("salts")).cast("int").alias("salt"), bm25_term(F.lit(1.0), F.col("tf"), F.col("dl"), index, params).alias("impact")
    )
    order = Window.partitionBy("token", "salt").orderBy(F.desc("impact"), "Id")
    blocked = salted.withColumn("block", F.floor((F.row_number().over(order) - 1) / F.lit(POSTINGS)).cast("int"))
    packed = blocked.groupBy("token", "salt", "block").agg(F.collect_list(F.struct("Id", "impact")).alias("p"), F.max("impact").alias("top"))
    return cut_lineage(packed.select("token", "salt", "block", F.col("p.Id").alias("ids"), F.col("p.impact").alias("impacts"), "top"), "bm25_postings")


def _opened(weights: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, token, Id, part, most): the postings of blocks joined to query tokens. ``weights`` has a row per token, salt and query."""
    both = weights.join(postings, ["token", "salt"])
    return both.select("query_id", "token", F.col("idf"), "most", F.inline(F.arrays_zip(F.col("ids").alias("Id"), F.col("impacts").alias("impact")))).select(
        "query_id", "token", "Id", (F.col("idf") * F.col("impact")).alias("part"), "most"
    )


@dataclass
class Bm25Plan:
    """A search over inverted lists, before its postings are opened."""

    weights: DataFrame  # written: (query_id, token, idf, most, salts, others, least, essential)
    wanted: DataFrame  # (query_id, token, salt, block, ids, impacts, idf, most): blocks that may hold a result


def bm25_plan(queries: DataFrame, index: Bm25Index, postings: DataFrame, k: int, params: Params = DEFAULT, text_col: str = "query_text") -> Bm25Plan:
    """Which blocks of which lists a search has to open.

    1. ``most`` is what a token can add to a score at most (idf x largest impact).
    2. The first blocks of one salt of each list give partial scores; the best few documents by them are scored in full, and the k-th best of
       these is ``least``, a lower limit of the query's k-th best score.
    3. Tokens in order of ``most``: as long as their sum stays below ``least`` they are not essential, a document with only such tokens
       is no result. Stop words are mostly among them, and their lists stay closed.
    4. Of an essential list a block is opened if its ``top``, with all other tokens at their most, reaches ``least``."""
    tops = postings.groupBy("token").agg(F.max("top").alias("top"), (F.max("salt") + 1).alias("salts"))
    raw = query_term_weights(queries, index, text_col, inner=True).join(tops, "token")
    raw = cut_lineage(raw.select("query_id", "token", "idf", (F.col("idf") * F.col("top")).alias("most"), "salts"), "bm25_weights")
    few = postings.where((F.col("salt") == 0) & (F.col("block") <= k // POSTINGS))
    seen = _opened(raw.withColumn("salt", F.lit(0)), few).groupBy("query_id", "Id").agg(F.sum("part").alias("score"))
    best = cut_lineage(final_topk(seen, FIRST_GUESSES * k, "query_id", "Id", "_r").select("query_id", "Id"), "bm25_first")
    whole = bm25_pairs(best, queries, index, params, text_col).withColumnRenamed("bm25", "score")
    kth = final_topk(whole, k, "query_id", "Id", "_r").where(F.col("_r") == k).select("query_id", F.col("score").alias("least"))
    # what rounding of the scores, or the order of their sums, may change
    slack = 1e-9 if params.score_decimals is None else 10.0**-params.score_decimals
    by = Window.partitionBy("query_id").orderBy("most", "token").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w = raw.join(kth, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-1.0)) - F.lit(slack))
    w = w.withColumn("others", F.sum("most").over(Window.partitionBy("query_id")) - F.col("most")).withColumn("essential", F.sum("most").over(by) >= F.col("least"))
    weights = cut_lineage(w, "bm25_plan")
    mine = weights.where("essential").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    joined = mine.join(postings, ["token", "salt"]).where(F.col("idf") * F.col("top") + F.col("others") >= F.col("least"))
    return Bm25Plan(weights, joined.select("query_id", "token", "salt", "block", "ids", "impacts", "idf", "most"))


def bm25_search(
    queries: DataFrame, index: Bm25Index, k: int, params: Params = DEFAULT, text_col: str = "query_text", postings: DataFrame | None = None
) -> DataFrame:
    """Top-k documents per query by BM25 over the whole corpus: (query_id, Id, bm25, bm25_rank).

    Blocks chosen by ``bm25_plan`` are opened; a document found in them whose parts, with the tokens not seen at their most, stay below the query's
    limit is dropped; the others are scored exactly from their own terms. Documents without a token of the query are no results."""
    plan = bm25_plan(queries, index, build_postings(index, params) if postings is None else postings, k, params, text_col)
    opened = plan.wanted.select("query_id", "idf", "most", F.inline(F.arrays_zip(F.col("ids").alias("Id"), F.col("impacts").alias("impact"))))
    found = opened.groupBy("query_id", "Id").agg(F.sum(F.col("idf") * F.col("impact")).alias("part"), F.sum("most").alias("seen"))
    limit = plan.weights.groupBy("query_id").agg(F.sum("most").alias("all_most"), F.max("least").alias("least"))
    able = found.join(limit, "query_id").where(F.col("part") + F.col("all_most") - F.col("seen") >= F.col("least")).select("query_id", "Id")
    scored = bm25_pairs(cut_lineage(able, "bm25_candidates"), queries, index, params, text_col)
    ranked = scored.select("query_id", "Id", rounded(F.col("bm25"), params).alias("score"))
    return final_topk(ranked, k, "query_id", "Id", "bm25_rank").withColumnRenamed("score", "bm25")


def postings_opened(plan: Bm25Plan, postings: DataFrame) -> DataFrame:
    """Per query the postings that a plan opens and those that its tokens have: (query_id, opened, listed)."""
    size = postings.groupBy("token").agg(F.sum(F.size("ids")).alias("n"))
    listed = plan.weights.join(size, "token").groupBy("query_id").agg(F.sum("n").alias("listed"))
    opened = plan.wanted.groupBy("query_id").agg(F.sum(F.size("ids")).alias("opened"))
    return listed.join(opened, "query_id", "left").select("query_id", F.coalesce("opened", F.lit(0)).alias("opened"), "listed")


# --- scaling, blend, cuts ---------------------------------------------------


def minmax(col: str, part: str = "query_id") -> Column:
    """(x - min) / (max - min) within the query's candidate set; constant -> 0."""
    w = Window.partitionBy(part)
    mn, mx = F.min(col).over(w), F.max(col).over(w)
    return F.coalesce((F.col(col) - mn) / F.nullif(mx - mn, F.lit(0.0)), F.lit(0.0))


def blend(semantic: str, rating: str, params: Params = DEFAULT) -> Column:
    return rounded(minmax(semantic) * F.lit(params.w_semantic) + minmax(rating) * F.lit(params.w_rating), params)


def top_per_query(df: DataFrame, score: str, k: int, rank_col: str, part: str = "query_id", id_col: str = "Id") -> DataFrame:
    """Best ``k`` rows per query by (score desc, Id asc); adds ``rank_col`` from 1."""
    w = Window.partitionBy(part).orderBy(F.col(score).desc(), F.col(id_col).asc())
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def best_per_author(df: DataFrame, score: str, part: str = "query_id", author: str = "Authors", id_col: str = "Id") -> DataFrame:
    """Keep the best-scored row per (query, author); null authors form one group."""
    w = Window.partitionBy(part, author).orderBy(F.col(score).desc(), F.col(id_col).asc())
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def rerank(cands: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """cands(query_id, Id, semantic, Rating, Authors, ...) -> cross_score, cut to
    k_rerank, best per author, cut to k_dedup (head(50) comes before dedup, Q10)."""
    scored = cands.withColumn("cross_score", blend("semantic", "Rating", params))
    top = top_per_query(scored, "cross_score", params.k_rerank, "rerank_rank")
    dedup = best_per_author(top, "cross_score")
    return top_per_query(dedup.drop("rerank_rank"), "cross_score", params.k_dedup, "dedup_rank")
