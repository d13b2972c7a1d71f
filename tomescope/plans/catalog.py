"""Registered queries: one per operator of the inventory, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the given tables (or what Spark derives from them) in full. Column
names equal those of the matching SQL in :mod:`tomescope.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomescope.config import DEFAULT, Params
from tomescope.functions import text as T
from tomescope.operators import clean, encode, filters, rank
from tomescope.operators.joins import bounded_broadcast
from tomescope.operators.knn import SCORE_DECIMALS, knn_join
from tomescope.operators.passing import nearest
from tomescope.operators.present import attach_covers
from tomescope.plans import recommend as R
from tomescope.session import apply_session_conf, cut_lineage, freed
from tomescope.sources import store, tables

P = DEFAULT.with_(score_decimals=SCORE_DECIMALS)  # the SQL comparison rounds scores before it ranks them
SMALL = P.with_(k_retrieve=200, k_filtered=100)  # cuts that cut at every table size
CHUNKS = P.with_(chunk_tokens=encode.CHUNK_TOKENS)
IVFPQ = SMALL.with_(search="ivfpq", nlist=16, pq_m=64, pq_bits=6, kmeans_iter=2, nprobe=4, refine=2, seeding="hash")


def _books(spark: SparkSession, sf: str) -> DataFrame:
    return tables.books(spark, sf)


def _index(spark: SparkSession, sf: str, params: Params = P, encoder: R.Encoder | None = None) -> R.Index:
    apply_session_conf(spark)
    return R.build_index(_books(spark, sf), params, encoder)


def _prepared(spark: SparkSession, sf: str, params: Params = P) -> DataFrame:
    return R.prepare_queries(tables.queries(spark, sf, params))


def _stages(spark: SparkSession, sf: str, params: Params = P) -> dict:
    idx = _index(spark, sf, params)
    prep = _prepared(spark, sf, params)
    n_q = R.query_count(prep)
    return {"index": idx, "prepared": prep, "n_queries": n_q, "cut": R.cut_candidates(prep, idx, params, n_queries=n_q)}


def _cut_stages(spark: SparkSession, sf: str, params: Params = P) -> dict:
    """``_stages`` with its cut written: a pair scorer reads it several times, and each time would search again."""
    s = _stages(spark, sf, params)
    cut = cut_lineage(s["cut"], "candidates_cut")
    if "Authors" not in cut.columns:
        freed(spark, s["cut"])
    return s | {"cut": R.detailed(cut, s["prepared"], s["index"], params, s["n_queries"])}


# --- A: scans, sources, sinks -------------------------------------------------


def scan_books(spark, sf):
    """Pruned scan of the stored catalogue with the default form's literal filters."""
    b = cut_lineage(_books(spark, sf), "books")
    return b.where((F.col("Pages") <= P.max_pages_default) & (F.col("Rating") >= P.floor_default)).select(
        "Id", "Name", "Authors", "Pages", "PublishYear", "Rating", "Description"
    )


def index_roundtrip(spark, sf):
    """Write the vectors as a table, read them back by space."""
    emb = tables.read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("Id"), F.col("embedding").alias("vec"))
    base = store.write_vectors(emb, "given")
    back = store.read_vectors(spark, base, "given")
    return back.select(
        "Id",
        F.size("vec").alias("n_dims"),
        F.round(F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 6).alias("vsum"),
    )


def csv_zstd_roundtrip(spark, sf):
    """Catalogue -> CSV -> typed CSV read -> Parquet (zstd) -> read."""
    from tomescope.session import new_table_path

    b = _books(spark, sf)
    csv_path = store.write_csv(b, new_table_path(spark, "books_csv"))
    back = store.read_csv(spark, csv_path)
    pq = store.write_parquet(back, new_table_path(spark, "books_zstd"), "zstd")
    return spark.read.parquet(pq)


# --- B: cleaning ----------------------------------------------------------------


def strip_html(spark, sf):
    return clean.strip_html(tables.read_table(spark, sf, "pages").select("page_id", "html"))


def outlier_filter(spark, sf):
    return clean.outlier_filter(_books(spark, sf))


def iqr_filter(spark, sf):
    """B2 with bounds from the data: page counts within 1.5 interquartile ranges of the quartiles of their source."""
    books = _books(spark, sf).withColumn("shelf", F.substring_index("Authors", "-", 1))
    return clean.iqr_filter(books, "Pages", ["shelf"]).select("Id", "shelf", "Pages", "low", "high")


def dedup_books(spark, sf):
    return clean.dedup_books(_books(spark, sf)).select("Id", "Name", "Authors", "Rating")


# --- C: scalar functions ----------------------------------------------------------


def rating_text(spark, sf):
    return _books(spark, sf).select("Id", "Rating", T.rating_text("Rating").alias("rating_text"))


def stitch_text(spark, sf):
    return _books(spark, sf).select("Id", T.stitch_text().alias("stitched_text"))


def expand_queries(spark, sf):
    return _prepared(spark, sf).select("query_id", "stripped", "n_words", "expanded", "was_expanded")


def expand_by_table(spark, sf):
    """C9 with the terms in a table: (ord, keyword, terms), here the first words of the documents."""
    word = lambda n: F.lower(F.regexp_extract("text", r"^\W*([A-Za-z]+)\W+([A-Za-z]+)", n))
    rows = tables.read_table(spark, sf, "documents").select("doc_id", word(1).alias("keyword"), word(2).alias("terms"))
    first = rows.where(F.length("keyword") >= 4).groupBy("keyword").agg(F.min(F.struct("doc_id", "terms")).alias("f"))
    terms = first.select(F.col("f.doc_id").alias("ord"), "keyword", F.col("f.terms").alias("terms"))
    prepared = _prepared(spark, sf).select("query_id", "stripped")
    return T.expand_by_table(prepared, terms, "stripped").select("query_id", "terms_found", "expanded")


def valid_queries(spark, sf):
    return _prepared(spark, sf).where("valid").select("query_id", "stripped")


def rejected_queries(spark, sf):
    return _prepared(spark, sf).where(~F.col("valid")).select("query_id", "query_text")


def hooks(spark, sf):
    return _books(spark, sf).select("Id", T.hook("Description").alias("hook"))


def escaped_titles(spark, sf):
    b = _books(spark, sf)
    return b.select(
        "Id",
        T.escape_name(F.coalesce("Name", F.lit(T.UNKNOWN))).alias("title"),
        T.escape_name(F.coalesce("Authors", F.lit(T.UNKNOWN))).alias("author"),
    )


def stars(spark, sf):
    return _books(spark, sf).select("Id", T.display_rating("Rating").alias("rating"), T.stars("Rating").alias("stars"))


def search_links(spark, sf):
    b = _books(spark, sf)
    return b.select(
        "Id", T.search_link(F.coalesce("Name", F.lit(T.UNKNOWN)), F.coalesce("Authors", F.lit(T.UNKNOWN))).alias("search_link")
    )


def part_links(spark, sf):
    """C23 on the part catalogue (short two-word names)."""
    p = tables.read_table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    return p.select("p_partkey", T.search_link("p_name", "p_brand").alias("search_link"))


def clean_titles(spark, sf):
    return _books(spark, sf).select("Id", T.clean_title("Name").alias("clean_title"))


def cover_join(spark, sf):
    b = _books(spark, sf).select("Id", "Name", "Authors")
    return attach_covers(b, tables.covers(spark, sf)).select("Id", "cover_url")


# --- K1: encoder ------------------------------------------------------------------


def encode_hashed(spark, sf):
    st = R.stitched_texts(_books(spark, sf))
    cells = encode.encode_sparse(st, "Id", "text", P.dim, None)
    return cells.select("Id", "bucket", F.round("value", 6).alias("value"))


def encode_hashed_idf(spark, sf):
    st = R.stitched_texts(_books(spark, sf))
    stats = encode.fit_token_stats(st, "Id", "text")
    cells = encode.encode_sparse(st, "Id", "text", P.dim, stats)
    return cells.select("Id", "bucket", F.round("value", 6).alias("value"))


# --- E3: exact kNN ------------------------------------------------------------------


def knn_exact_top10(spark, sf):
    """Every stored vector queries all others: top 10 by inner product (self excluded)."""
    apply_session_conf(spark)
    emb = tables.read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    q = emb.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    c = emb.select(F.col("vec_id").alias("Id"), F.col("embedding").alias("vec"))
    return knn_join(q, c, 10, exclude_self=True, decimals=SCORE_DECIMALS)


def knn_books_top10(spark, sf):
    """Expanded queries, IDF-hashed, against the stitched catalogue vectors: top 10."""
    idx = _index(spark, sf)
    prep = _prepared(spark, sf)
    qvec = cut_lineage(R.encode_queries(prep, idx, P), "query_vectors")
    return nearest(qvec, idx.stitched, 10, P, SCORE_DECIMALS)


def encode_chunks(spark, sf):
    """K1, several vectors a text: cells of the chunk vectors of the catalogue."""
    texts = R.stitched_texts(_books(spark, sf))
    stats = encode.chunk_stats(texts, "text")
    stats.df = cut_lineage(stats.df, "df_chunks")
    vecs = encode.chunk_vectors(texts, "Id", "text", P.dim, stats)
    cells = vecs.select("Id", "chunk", F.posexplode("vec").alias("bucket", "value")).where(F.col("value") != 0)
    return cells.select("Id", "chunk", "bucket", F.round(F.col("value").cast("double"), 6).alias("value"))


def knn_chunks_top10(spark, sf):
    """Expanded queries against the chunks of the stitched texts: the ten books with the best chunks."""
    idx = _index(spark, sf, CHUNKS)
    hits = R.retrieve(_prepared(spark, sf), idx, CHUNKS.with_(k_retrieve=10))
    return hits.select("query_id", "Id", F.col("retrieval_score").alias("score"), F.col("retrieval_rank").alias("rank"))


def chunk_retrieval(spark, sf):
    """Benchmark passages as searches over documents: for each that stands word for word in some (``holders``), the best rank
    among the first ten that one of those gets, by whole-text vectors and by chunk vectors (null: none)."""
    apply_session_conf(spark)
    docs = tables.read_table(spark, sf, "documents").select(F.col("doc_id").alias("Id"), "text")
    asked = tables.read_table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    held = cut_lineage(rank.holders(asked, docs, "query_id", "Id"), "holders")
    stats = encode.chunk_stats(docs, "text")
    stats.df = cut_lineage(stats.df, "df_chunks")
    qvec = cut_lineage(encode.encode_dense(asked, "query_id", "text", P.dim, stats, out_col="qvec"), "query_vectors")
    spaces = {"whole_rank": encode.text_vectors(docs, "Id", "text", P.dim, stats), "chunk_rank": encode.chunk_vectors(docs, "Id", "text", P.dim, stats)}
    out = held.groupBy("query_id").agg(F.count(F.lit(1)).alias("holders"))
    for name, vecs in spaces.items():
        hits = knn_join(qvec, cut_lineage(vecs, name), 10, decimals=SCORE_DECIMALS, repeated=name == "chunk_rank")
        best = hits.join(held, ["query_id", "Id"]).groupBy("query_id").agg(F.min("rank").alias(name))
        out = out.join(best, "query_id", "left")
    return out


# --- D / E2 / I: candidates -----------------------------------------------------------


def candidates_filtered(spark, sf):
    idx = _index(spark, sf)
    prep = _prepared(spark, sf)
    hits = R.retrieve(prep, idx, P)
    settings = prep.where("valid").select("query_id", "era", "max_pages", "acclaimed", "lambda")
    settings = bounded_broadcast(settings, R.query_count(prep), 64, P)
    found = filters.filter_candidates(hits, settings, idx.books, P, idx.bm25.n_docs)
    return found.select("query_id", "Id", "retrieval_score", "retrieval_rank")


def candidates_cut300(spark, sf):
    s = _stages(spark, sf)
    return s["cut"].select("query_id", "Id", "retrieval_score", "cut_rank")


def no_match_queries(spark, sf):
    s = _stages(spark, sf)
    settings = s["prepared"].where("valid").select("query_id")
    return filters.no_match(settings, s["cut"]).select("query_id")


# --- K2 / F / H: rerank ----------------------------------------------------------------


def bm25_scores(spark, sf):
    """Top 20 descriptions per query by BM25 over the whole catalogue."""
    idx = _index(spark, sf)
    q = _prepared(spark, sf).where("valid").select("query_id", "query_text")
    return rank.bm25_search(q, idx.bm25, 20, P)


def _reranked(spark, sf):
    s = _cut_stages(spark, sf)
    return R.rerank_candidates(s["prepared"], s["cut"], s["index"], P)


def minmax_blend(spark, sf):
    s = _cut_stages(spark, sf)
    qtext = s["prepared"].where("valid").select("query_id", "query_text")
    pairs = s["cut"].select("query_id", "Id", "Rating")
    scored = rank.bm25_pairs(pairs, qtext, s["index"].bm25, P).withColumn("semantic", rank.rounded(F.col("bm25"), P))
    return scored.select("query_id", "Id", "semantic", rank.blend("semantic", "Rating", P).alias("cross_score"))


def author_dedup(spark, sf):
    return _reranked(spark, sf).select("query_id", "Id", "Authors", "cross_score", "dedup_rank")


def mmr_top5(spark, sf):
    s = _cut_stages(spark, sf)
    return R.diversify(R.rerank_candidates(s["prepared"], s["cut"], s["index"], P), s["index"], P)


def result_cards(spark, sf):
    """The flagship: a whole table of searches -> five cards each."""
    idx = _index(spark, sf)
    return R.recommend(tables.queries(spark, sf), idx, tables.covers(spark, sf), P).cards


def candidates_cut100(spark, sf):
    """The first two cuts at sizes that cut at every table size."""
    return _stages(spark, sf, SMALL)["cut"].select("query_id", "Id", "retrieval_score", "cut_rank")


def _cards(spark, sf, params):
    return R.recommend(tables.queries(spark, sf), _index(spark, sf, params), tables.covers(spark, sf), params).cards


def result_cards_small(spark, sf):
    """The funnel with cuts 200 / 100 / 50 / 30 / 5."""
    return _cards(spark, sf, SMALL)


def result_cards_ivfpq(spark, sf):
    """The same funnel, retrieving from the trained and stored IVF-PQ index."""
    return _cards(spark, sf, IVFPQ)


def rejected_results(spark, sf):
    """What recommend hands back as rejected."""
    return R.recommend(tables.queries(spark, sf), _index(spark, sf, SMALL), tables.covers(spark, sf), SMALL).rejected


# --- K1, K2: models ------------------------------------------------------------------


def encode_model(spark, sf):
    """K1: a model behind the encoder interface (letter counts stand in for a neural model)."""
    enc = encode.model_encoder(encode.LetterModel)
    out = enc(R.stitched_texts(_books(spark, sf)), "Id", "text", "vec")
    return out.select("Id", F.posexplode("vec").alias("p", "x")).select("Id", "p", F.round(F.col("x").cast("double"), 6).alias("x"))


def model_recommend(spark, sf):
    """K1, K2: build_index and recommend with a model encoder and a model pair scorer; the scores of the rerank."""
    enc, scorer = encode.model_encoder(encode.LetterModel), encode.model_pair_scorer(encode.LetterModel)
    idx, prep = _index(spark, sf, SMALL, enc), _prepared(spark, sf, SMALL)
    hits = R.retrieve(prep, idx, SMALL, enc)
    cut = R.filtered_candidates(prep, hits, idx, SMALL)
    qtext = prep.where("valid").select("query_id", "query_text")
    pairs = cut.join(qtext, "query_id").join(idx.books.select("Id", "Description"), "Id")
    return scorer(pairs).select("query_id", "Id", "retrieval_score", F.round("semantic", 6).alias("semantic"))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tomescope.plans import ann_queries

    reg = {
        "scan_books": scan_books,
        "index_roundtrip": index_roundtrip,
        "csv_zstd_roundtrip": csv_zstd_roundtrip,
        "strip_html": strip_html,
        "outlier_filter": outlier_filter,
        "iqr_filter": iqr_filter,
        "expand_by_table": expand_by_table,
        "dedup_books": dedup_books,
        "rating_text": rating_text,
        "stitch_text": stitch_text,
        "expand_queries": expand_queries,
        "valid_queries": valid_queries,
        "rejected_queries": rejected_queries,
        "encode_hashed": encode_hashed,
        "encode_hashed_idf": encode_hashed_idf,
        "knn_exact_top10": knn_exact_top10,
        "knn_books_top10": knn_books_top10,
        "encode_chunks": encode_chunks,
        "knn_chunks_top10": knn_chunks_top10,
        "chunk_retrieval": chunk_retrieval,
        "candidates_filtered": candidates_filtered,
        "candidates_cut300": candidates_cut300,
        "no_match_queries": no_match_queries,
        "bm25_scores": bm25_scores,
        "minmax_blend": minmax_blend,
        "author_dedup": author_dedup,
        "mmr_top5": mmr_top5,
        "hooks": hooks,
        "escaped_titles": escaped_titles,
        "stars": stars,
        "search_links": search_links,
        "part_links": part_links,
        "clean_titles": clean_titles,
        "cover_join": cover_join,
        "result_cards": result_cards,
        "candidates_cut100": candidates_cut100,
        "result_cards_small": result_cards_small,
        "result_cards_ivfpq": result_cards_ivfpq,
        "rejected_results": rejected_results,
        "encode_model": encode_model,
        "model_recommend": model_recommend,
    }
    reg.update(ann_queries.registry())
    return reg
