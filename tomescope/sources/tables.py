"""Readers for the given tables and the derived views the engine works on.

* ``books``   - the catalogue (Id, Name, Authors, Pages, PublishYear, Rating, Description),
                derived from ``documents`` by a fixed rule (FIXTURES.md section 2).
* ``queries`` - one row per search: benchmark passages plus user turns of conversations,
                each with its filter settings (era, page cap, acclaimed flag, MMR lambda).
* ``covers``  - (clean_title, author, cover_url) look-up table, derived from ``pages`` and the catalogue.

Every reader prunes to the columns it uses, so Parquet scans carry a narrow ReadSchema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomescope.config import DEFAULT, Params
from tomescope.functions.text import QUERY_EXPANSIONS, clean_title

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# The era choices of the search form, in form order.
ERAS = ["Any era", "Pre-1900", "20th century", "Contemporary"]

# Offset that keeps conversation query ids apart from benchmark item ids.
CONV_QUERY_BASE = 1_000_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def books_from_documents(documents: DataFrame) -> DataFrame:
    """The catalogue view over ``documents``. Nulls, parentheses, quotes and angle brackets are planted by the id
    (FIXTURES.md section 2), so that every branch of the text functions has rows."""
    d = F.col("doc_id")
    title = F.split_part(F.col("text"), F.lit("."), F.lit(1))
    author = F.concat(F.col("source"), F.lit("-"), (d % 7).cast("string"))
    return documents.select(
        d.alias("Id"),
        F.when(d % 97 == 0, None)
        .when(d % 11 == 3, F.concat(title, F.lit(" (Vol. "), (d % 5).cast("string"), F.lit(")")))
        .when(d % 13 == 5, F.concat(F.lit('"'), title, F.lit('" <no. '), d.cast("string"), F.lit(">")))
        .otherwise(title)
        .alias("Name"),
        F.when(d % 53 == 0, None).when(d % 17 == 2, F.concat(F.lit('"'), author, F.lit('" <ed>'))).otherwise(author).alias("Authors"),
        (F.lit(20) + F.floor(F.col("n_chars").cast("double") / 10)).cast("int").alias("Pages"),
        (F.lit(1850) + (d * 37) % 175).cast("int").alias("PublishYear"),
        # NaN never reaches the filters: SQL engines order NaN above every number (Q23).
        F.nanvl(
            F.when(d % 41 == 0, None).otherwise((F.lit(25) + (d * 7919) % 26).cast("double") / 10),
            F.lit(None).cast("double"),
        ).alias("Rating"),
        F.when(d % 89 == 0, None)
        .when(d % 19 == 4, F.concat(F.lit("<i>Note</i> A <b>first</b> line. "), F.col("text")))
        .otherwise(F.col("text"))
        .alias("Description"),
    )


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")
    return books_from_documents(docs)


def with_query_settings(q: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Spread the search-form settings over the query rows by a fixed rule of the id, so that every era, a range
    of page caps, both rating floors and several MMR weights are exercised. By the same kind of rule some texts become
    short keyword searches, padded or too short, and some searches get a page cap no book is under."""
    qid = F.col("query_id")
    eras = F.array(*[F.lit(e) for e in ERAS])
    words = F.element_at(F.array(*[F.lit(k) for k, _ in QUERY_EXPANSIONS]), (F.pmod(qid, F.lit(10)) + 1).cast("int"))
    text = (
        F.when(F.pmod(qid, F.lit(29)) == 3, F.lit(" ab "))
        .when(F.pmod(qid, F.lit(7)) == 1, F.concat(F.lit("A "), F.upper(words), F.lit(" tale")))
        .when(F.pmod(qid, F.lit(7)) == 2, F.concat(F.lit("\t  "), F.col("query_text"), F.lit("  \n")))
        .otherwise(F.col("query_text"))
    )
    return q.select(
        "query_id",
        text.alias("query_text"),
        F.element_at(eras, (F.pmod(qid, F.lit(4)) + 1).cast("int")).alias("era"),
        F.when(F.pmod(qid, F.lit(31)) == 0, F.lit(1)).otherwise(F.lit(100) + F.lit(50) * F.pmod(qid * 7, F.lit(39))).cast("int").alias("max_pages"),
        (F.pmod(qid, F.lit(3)) == 0).alias("acclaimed"),
        ((F.lit(511301) + F.lit(93107) * F.pmod(qid, F.lit(6))).cast("double") / 1000000).alias("lambda"),
    )


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query_text): benchmark passages and every user turn of the conversations."""
    bench = read_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text")
    )
    conv = (
        read_table(spark, sf_dir, "conversations")
        .where(F.col("role") == "user")
        .select(
            (F.lit(CONV_QUERY_BASE) + F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
            F.col("text").alias("query_text"),
        )
    )
    return bench.unionByName(conv)


def queries(spark: SparkSession, sf_dir: str, params: Params = DEFAULT) -> DataFrame:
    return with_query_settings(query_texts(spark, sf_dir), params)


def covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cover look-up table (cover_id, clean_title, author, cover_url). A third of the catalogue has a cover of its
    own, found by title and author; page titles give covers that fit any author (author null), the
    page url standing in for the picture address."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    title = F.regexp_extract(F.col("html"), r"<title>(.*?)</title>", 1)
    by_title = pages.select(
        F.col("page_id").alias("cover_id"), F.lower(clean_title(title)).alias("clean_title"), F.lit(None).cast("string").alias("author"), F.col("url").alias("cover_url")
    )
    own = books(spark, sf_dir).where((F.col("Id") % 3 == 0) & F.col("Name").isNotNull() & F.col("Authors").isNotNull())
    by_both = own.select(
        F.col("Id").alias("cover_id"), F.lower(clean_title("Name")).alias("clean_title"), F.col("Authors").alias("author"),
        F.concat(F.lit("https://covers.example.org/"), F.col("Id").cast("string"), F.lit(".jpg")).alias("cover_url"),
    )
    return by_title.unionByName(by_both).where(F.col("clean_title") != "")
