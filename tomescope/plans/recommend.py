"""The two jobs: ``build_index`` (offline) and ``recommend`` (a whole table of searches).

recommend: queries -> strip / validate / expand -> encode -> exact or IVF-PQ top-k (``Params.search``) ->
join catalogue + per-query filters -> cut 300 -> pair scores (BM25 or a model) -> min-max blend -> cut 50 ->
best per author -> cut 30 -> MMR 5 -> cards. The driver sees the number of searches, corpus scalars and, with
IVF-PQ, centroids and codebooks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomescope.config import DEFAULT, Params
from tomescope.functions import text as T
from tomescope.operators import ann, filters, rank
from tomescope.operators.diversify import mmr
from tomescope.operators.encode import TokenStats, chunk_stats, chunk_vectors, encode_chunks, encode_dense, frequencies, packed_terms, packed_vectors
from tomescope.operators.joins import bounded_broadcast
from tomescope.operators.knn import knn_join
from tomescope.operators.passing import once, passing_topk
from tomescope.operators.present import attach_covers, cards
from tomescope.session import apply_session_conf, cut_lineage, freed

Encoder = Callable[[DataFrame, str, str, str], DataFrame]  # (docs, id column, text column, vector column)
PairScorer = Callable[[DataFrame], DataFrame]  # pairs with query_text and Description -> with semantic


@dataclass
class Index:
    books: DataFrame  # written: Id, Name, Authors, Pages, PublishYear, Rating, Description
    stitched: DataFrame  # Id, vec : retrieval space (title + author + rating words + summary); with chunk_tokens a row per chunk
    described: DataFrame  # Id, vec : diversity space (description only)
    stitched_stats: TokenStats | None  # IDF statistics the queries are encoded with (None: a model encodes)
    bm25: rank.Bm25Index  # pair scorer statistics over descriptions
    compressed: ann.IvfPq | None = None  # the stitched vectors as IVF-PQ codes


def stitched_texts(books: DataFrame) -> DataFrame:
    return books.select("Id", T.stitch_text().alias("text"))


def description_texts(books: DataFrame) -> DataFrame:
    return books.select("Id", F.coalesce(F.col("Description"), F.lit("")).alias("text"))


def build_index(books: DataFrame, params: Params = DEFAULT, encoder: Encoder | None = None) -> Index:
    """Encode the catalogue in both spaces, fit the BM25 statistics and, for ``search="ivfpq"``, train and store the
    compressed index. Every part is a written table in the shared folder.

    The default encoder tokenises each text column once into written rows of term counts, one a text; document frequencies, BM25
    documents and both vector tables come from those. ``encoder`` replaces the vectors (see ``encode.model_encoder``).
    With ``chunk_tokens`` the retrieval vectors are one per chunk; they are searched exactly."""
    if params.chunk_tokens and params.search == "ivfpq":
        raise ValueError("chunk vectors are searched exactly; the compressed index holds one vector per book")
    books = cut_lineage(books, "books")
    n_docs = books.count()
    terms_d = cut_lineage(packed_terms(books, "Id", "Description", params), "terms_description")
    docs = terms_d.where(F.col("dl") > 0)
    df_d = cut_lineage(frequencies(docs), "bm25_df")
    total = docs.agg(F.sum("dl").alias("t")).first()["t"] or 0
    bm = rank.Bm25Index(docs, df_d, n_docs, float(total) / n_docs if n_docs else 0.0)
    if encoder is None:
        texts = stitched_texts(books)
        if params.chunk_tokens:
            stats = chunk_stats(texts, "text", params.chunk_tokens)
            stats = replace(stats, df=cut_lineage(stats.df, "df_stitched"))
            svec = cut_lineage(chunk_vectors(texts, "Id", "text", params.dim, stats, params.chunk_tokens, params), "vec_stitched")
        else:
            terms_s = cut_lineage(packed_terms(texts, "Id", "text", params), "terms_stitched")
            stats = TokenStats(cut_lineage(frequencies(terms_s), "df_stitched"), n_docs)
            svec = cut_lineage(packed_vectors(terms_s, "Id", params.dim, stats, params=params), "vec_stitched")
            freed(books.sparkSession, terms_s)
        dvec = cut_lineage(packed_vectors(terms_d, "Id", params.dim, TokenStats(df_d, n_docs), params=params), "vec_description")
    else:
        stats = None
        texts = stitched_texts(books)
        made = encode_chunks(texts, "Id", "text", encoder, params.chunk_tokens) if params.chunk_tokens else encoder(texts, "Id", "text", "vec")
        svec = cut_lineage(made, "vec_stitched")
        dvec = cut_lineage(encoder(description_texts(books), "Id", "text", "vec"), "vec_description")
    index = Index(books, svec, dvec, stats, bm)
    return compress(index, params) if params.search == "ivfpq" else index


def compress(index: Index, params: Params = DEFAULT) -> Index:
    """The index with its stitched vectors also as a trained and stored IVF-PQ index."""
    coded = ann.compress_index(
        index.stitched, params.nlist, params.pq_m, params.pq_bits, params.kmeans_iter, params.seed, decimals=params.score_decimals, seeding=params.seeding
    )
    return replace(index, compressed=coded)


def prepare_queries(queries: DataFrame) -> DataFrame:
    """Adds ``stripped``, ``valid``, ``n_words``, ``expanded``, ``was_expanded``."""
    s = T.py_strip(F.col("query_text"))
    q = queries.withColumn("stripped", s)
    return (
        q.withColumn("valid", T.is_valid_query(F.col("stripped")))
        .withColumn("n_words", T.word_count(F.col("stripped")))
        .withColumn("expanded", T.expand_query(F.col("stripped")))
        .withColumn("was_expanded", F.col("expanded") != F.col("stripped"))
    )


def encode_queries(prepared: DataFrame, index: Index, params: Params = DEFAULT, encoder: Encoder | None = None) -> DataFrame:
    """(query_id, qvec) for the valid queries, encoded on the expanded text like the catalogue."""
    src = prepared.where("valid").select("query_id", F.col("expanded").alias("text"))
    if (encoder is None) != (index.stitched_stats is not None):
        raise ValueError("queries and catalogue need the same encoder")
    if encoder is not None:
        return encoder(src, "query_id", "text", "qvec")
    return encode_dense(src, "query_id", "text", params.dim, index.stitched_stats, out_col="qvec")


def retrieve(prepared: DataFrame, index: Index, params: Params = DEFAULT, encoder: Encoder | None = None) -> DataFrame:
    """(query_id, Id, retrieval_score, retrieval_rank): the top k_retrieve, exact or from the compressed index."""
    qvec = cut_lineage(encode_queries(prepared, index, params, encoder), "query_vectors")
    if params.search == "ivfpq":
        if index.compressed is None:
            raise ValueError("the index was built without its compressed form")
        fetched = index.stitched if params.refine > 1 else None
        hits = ann.pq_search(qvec, index.compressed, params.nprobe, params.k_retrieve, decimals=params.score_decimals, vectors=fetched, refine=params.refine)
    else:
        hits = knn_join(qvec, index.stitched, params.k_retrieve, "query_id", "qvec", "Id", "vec", params=params, decimals=params.score_decimals, repeated="chunk" in index.stitched.columns)
    return hits.withColumnRenamed("score", "retrieval_score").withColumnRenamed("rank", "retrieval_rank")


def query_count(prepared: DataFrame) -> int:
    return prepared.where("valid").count()


def cut_candidates(
    prepared: DataFrame, index: Index, params: Params = DEFAULT, encoder: Encoder | None = None, n_queries: int = -1
) -> DataFrame:
    """The filtered candidates of every search, cut to ``k_filtered``: (query_id, Id, retrieval_score, cut_rank); ``detailed`` adds the rest. In the exact search
    of one vector a book the filters are tested where the scores are made, so that the ``k_retrieve`` hits of a search are no rows, and the result
    is a written table; with ids that repeat, chunks or the compressed index the hits are joined, and the details are there already."""
    fused = params.search != "ivfpq" and "chunk" not in index.stitched.columns and once(index.books.select("Id")) and once(index.stitched.select("Id"))
    if not fused or not once(prepared.where("valid").select("query_id")):
        return filtered_candidates(prepared, retrieve(prepared, index, params, encoder), index, params, n_queries)
    settings = prepared.where("valid").select("query_id", "era", "max_pages", "acclaimed", "lambda")
    bounds = settings.select("query_id", *filters.query_bounds(params))
    qvec = encode_queries(prepared, index, params, encoder).join(bounds, "query_id")
    values = bounded_broadcast(filters.item_values(index.books), index.bm25.n_docs, 64, params)
    missing = {"year": F.lit(float("-inf")), "pages": F.lit(float("inf")), "rating": F.lit(float("-inf"))}
    corpus = index.stitched.join(values, "Id", "left").select("Id", "vec", *[F.coalesce(c, x).alias(c) for c, x in missing.items()])
    hits = passing_topk(cut_lineage(qvec, "query_vectors"), corpus, params.k_retrieve, params.k_filtered, params, params.score_decimals)
    return hits.withColumnsRenamed({"score": "retrieval_score", "rank": "cut_rank"})


def detailed(cut: DataFrame, prepared: DataFrame, index: Index, params: Params = DEFAULT, n_queries: int = -1) -> DataFrame:
    """``cut_candidates`` with Authors, Rating and the other columns of the filters. The join on the book is also the exchange that ``rank.bm25_pairs`` needs."""
    if "Authors" in cut.columns:
        return cut
    settings = prepared.where("valid").select("query_id", "era", "max_pages", "acclaimed", "lambda")
    books = bounded_broadcast(index.books.select("Id", "Authors", "Pages", "PublishYear", "Rating"), index.bm25.n_docs, 256, params)
    return cut.join(bounded_broadcast(settings, n_queries, 64, params), "query_id").join(books, "Id")


def filtered_candidates(
    prepared: DataFrame, hits: DataFrame, index: Index, params: Params = DEFAULT, n_queries: int = -1
) -> DataFrame:
    settings = prepared.where("valid").select("query_id", "era", "max_pages", "acclaimed", "lambda")
    settings = bounded_broadcast(settings, n_queries, 64, params)
    f = filters.filter_candidates(hits, settings, index.books, params, index.bm25.n_docs)
    return rank.top_per_query(f, "retrieval_score", params.k_filtered, "cut_rank")


def rerank_candidates(
    prepared: DataFrame, cut: DataFrame, index: Index, params: Params = DEFAULT, pair_scorer: PairScorer | None = None
) -> DataFrame:
    """Score of the raw query text against the description (Q1): BM25, or ``pair_scorer``; then blend, cuts, dedup."""
    qtext = prepared.where("valid").select("query_id", "query_text")
    pairs = cut.select("query_id", "Id", "Authors", "retrieval_score", "Rating", "lambda")
    if pair_scorer is None:
        scored = rank.bm25_pairs(pairs, qtext, index.bm25, params).withColumn("semantic", rank.rounded(F.col("bm25"), params))
    else:
        scored = pair_scorer(pairs.join(qtext, "query_id").join(index.books.select("Id", "Description"), "Id")).drop("Description", "query_text")
    return rank.rerank(scored, params)


def diversify(reranked: DataFrame, index: Index, params: Params = DEFAULT) -> DataFrame:
    withvec = reranked.join(index.described.withColumnRenamed("vec", "dvec"), "Id", "left")
    return mmr(withvec, "cross_score", "dvec", params)


@dataclass
class Results:
    cards: DataFrame
    picks: DataFrame
    no_match: DataFrame
    rejected: DataFrame


def recommend(
    queries: DataFrame, index: Index, covers: DataFrame, params: Params = DEFAULT,
    encoder: Encoder | None = None, pair_scorer: PairScorer | None = None,
) -> Results:
    """Every search of ``queries`` through the funnel. ``session.written_tables`` around the call and the use of
    its results removes the tables it leaves."""
    apply_session_conf(queries.sparkSession)
    prepared = prepare_queries(queries)
    n_q = query_count(prepared)
    # <= k_filtered and <= k_dedup rows per query: written once, read by every later branch
    cut = cut_candidates(prepared, index, params, encoder, n_q)
    cut = cut if "Authors" not in cut.columns else cut_lineage(cut, "candidates_cut")
    reranked = cut_lineage(rerank_candidates(prepared, detailed(cut, prepared, index, params, n_q), index, params, pair_scorer), "candidates_reranked")
    freed(queries.sparkSession)
    picks = diversify(reranked, index, params)
    detail = reranked.select("query_id", "Id", "cross_score")
    # <= k_final picks per query: broadcast them into the catalogue scan, never shuffle the catalogue
    small = bounded_broadcast(picks.join(detail, ["query_id", "Id"]), n_q * params.k_final, 64, params)
    final = index.books.join(small, "Id")
    out = cards(attach_covers(final, covers))
    settings = prepared.where("valid").select("query_id", "query_text", "era", "max_pages", "acclaimed")
    return Results(
        cards=out,
        picks=picks,
        no_match=filters.no_match(settings, cut),
        rejected=prepared.where(~F.col("valid")).select("query_id", "query_text"),
    )
