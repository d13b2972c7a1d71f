"""Literal edge rows (FIXTURES.md section 4) for the scalar expressions."""

import math

import pytest
from pyspark.sql import functions as F

from tomescope.functions import text as T
from tomescope.operators import filters
from tomescope.config import DEFAULT


def one(spark, value, expr, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("o")).first()["o"]


@pytest.mark.parametrize(
    "raw, stripped, valid",
    [
        ("abc", "abc", False),
        ("  abc \n", "abc", False),
        ("abcd", "abcd", True),
        (" abcd　", "abcd", True),
        ("\x1cabcd\x1f", "abcd", True),
        ("\tfunny  mystery\n", "funny  mystery", True),
    ],
)
def test_strip_and_validate(spark, raw, stripped, valid):
    assert one(spark, raw, T.py_strip("s")) == stripped
    assert one(spark, raw, T.is_valid_query(T.py_strip("s"))) is valid


def test_strip_matches_python_whitespace(spark):
    ws = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
    raw = ws + "x y" + ws
    assert one(spark, raw, T.py_strip("s")) == raw.strip()
    assert one(spark, raw, T.word_count(T.py_strip("s"))) == len(raw.split())


@pytest.mark.parametrize(
    "q, expect",
    [
        ("abcd", "abcd"),
        ("sad romance", "sad romance — love story emotional heartbreak relationship emotional grief loss melancholy"),
        ("necromancer tale", "necromancer tale — love story emotional heartbreak relationship"),
        ("a sad story about two brothers", "a sad story about two brothers"),
        ("Sci-Fi", "Sci-Fi — futuristic technology space exploration"),
        ("funny  mystery", "funny  mystery — detective investigation crime clues humour comedy lighthearted witty"),
    ],
)
def test_expansion(spark, q, expect):
    assert one(spark, q, T.expand_query("s")) == expect


@pytest.mark.parametrize(
    "rating, words",
    [(4.2, T.RATING_WORDS_HIGH), (4.19, T.RATING_WORDS_GOOD), (3.8, T.RATING_WORDS_GOOD), (3.79, ""), (None, ""), (float("nan"), "")],
)
def test_rating_buckets(spark, rating, words):
    # NaN is normalised to null on load (SQL engines order NaN above every number)
    expr = T.rating_text(F.nanvl(F.col("r"), F.lit(None).cast("double")))
    assert one(spark, rating, expr, "r double") == words


@pytest.mark.parametrize(
    "era, year, keep",
    [
        ("Pre-1900", 1899, True), ("Pre-1900", 1900, False),
        ("20th century", 1900, True), ("20th century", 2000, True), ("20th century", 2001, False),
        ("Contemporary", 2000, False), ("Contemporary", 2001, True),
        ("Any era", None, True), ("Pre-1900", None, False), ("Contemporary", None, False),
    ],
)
def test_era(spark, era, year, keep):
    df = spark.createDataFrame([(era, year)], "era string, y int")
    got = df.select(F.coalesce(filters.era_predicate(F.col("era"), F.col("y")), F.lit(False)).alias("o")).first()["o"]
    assert got is keep


@pytest.mark.parametrize(
    "rating, acclaimed, keep",
    [(2.99, False, False), (3.0, False, True), (3.99, False, True), (3.99, True, False), (4.0, True, True), (None, False, False)],
)
def test_rating_floor(spark, rating, acclaimed, keep):
    df = spark.createDataFrame([(rating, acclaimed, 100, 1950, "Any era", 800)], "Rating double, acclaimed boolean, Pages int, PublishYear int, era string, max_pages int")
    assert df.where(filters.metadata_predicate(DEFAULT)).count() == (1 if keep else 0)


@pytest.mark.parametrize("pages, keep", [(800, True), (801, False), (None, False)])
def test_page_cap(spark, pages, keep):
    df = spark.createDataFrame([(4.0, False, pages, 1950, "Any era", 800)], "Rating double, acclaimed boolean, Pages int, PublishYear int, era string, max_pages int")
    assert df.where(filters.metadata_predicate(DEFAULT)).count() == (1 if keep else 0)


@pytest.mark.parametrize("s, parts", [("A. B! C? D.", ["A.", "B!", "C?", "D."]), ("A. ", ["A.", ""]), ("", [""])])
def test_sentence_split(spark, s, parts):
    assert one(spark, s, T.split_sentences("s")) == parts


def test_hook_rules(spark):
    assert one(spark, "A. B! C? D.", T.hook("s")) == "A. B! C?"
    s480, s481 = "x" * 480, "x" * 481
    assert one(spark, s480, T.hook("s")) == s480
    assert one(spark, s481, T.hook("s")) == s480 + "..."
    assert one(spark, "x" * 479 + "<<", T.hook("s")) == "x" * 479 + "&lt;..."
    assert one(spark, None, T.hook("s")) == ""


def test_rounding_stars_link_title(spark):
    assert one(spark, 4.25, T.display_rating("r"), "r double") == 4.3
    assert one(spark, 4.25, T.stars("r"), "r double") == "★★★★☆"
    assert one(spark, "AC/DC ~ *x* & é+b (Part 1)", T.percent_encode("s")) == "AC/DC%20~%20%2Ax%2A%20%26%20%C3%A9%2Bb%20%28Part%201%29"
    assert one(spark, "Dune (Dune #1) (x)", T.clean_title("s")) == "Dune"
    assert one(spark, 'a"b<c>', T.escape_name("s")) == "a&quot;b&lt;c>"


def test_zero_vector_stays_zero(spark):
    from tomescope.functions.vectors import l2_normalize, dot

    df = spark.createDataFrame([([0.0, 0.0, 0.0],)], "v array<double>")
    r = df.select(l2_normalize("v").alias("n"), dot("v", "v").alias("d")).first()
    assert r["n"] == [0.0, 0.0, 0.0] and r["d"] == 0.0 and not any(math.isnan(x) for x in r["n"])


def test_expansion_table_equals_the_dictionary(spark):
    """The fixed keywords as a table give what the expressions give; keywords inside one another are all found, in order of ord."""
    from pyspark.sql import functions as F

    from tomescope.functions import text as T

    rows = [(1, "sad romance"), (2, "necromancer tale"), (3, "Sci-Fi"), (4, "none"), (5, None), (6, ""), (7, "FUNNY mystery funny")]
    q = spark.createDataFrame(rows, "id long, t string")
    table = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(T.QUERY_EXPANSIONS)], "ord long, keyword string, terms string")
    got = T.expand_by_table(q, table, "t", T.EXPANSION_MAX_WORDS).withColumn("want", T.expand_query("t")).collect()
    assert all(r["expanded"] == r["want"] for r in got) and sum(r["expanded"] != r["t"] for r in got if r["t"]) == 4
    odd = spark.createDataFrame([(9, "ance", "late"), (2, "romance", "love"), (2, "man", "male"), (5, "", "x"), (6, None, "x"), (7, "sad", None), (1, "romance", "first")], table.schema)
    by = {r["id"]: r["terms_found"] for r in T.expand_by_table(q, odd, "t").collect()}
    assert by[1] == by[2] == "first male love late" and by[4] == by[6] == by[5] == ""
    none = T.expand_by_table(q, table.where("false"), "t").where(F.col("expanded") != F.col("t"))
    assert none.count() == 0


def test_quartile_bounds_per_group(spark):
    from tomescope.operators.clean import iqr_filter

    rows = [(i, "a", i) for i in range(100)] + [(200, "a", 10_000), (201, None, 5), (202, None, 6), (203, "b", None), (204, "c", 7)]
    got = {r["Id"] for r in iqr_filter(spark.createDataFrame(rows, "Id long, g string, Pages int"), "Pages", ["g"]).collect()}
    assert got == {*range(100), 201, 202, 204}


def test_pages_are_decoded_once(spark):
    from tomescope.operators.clean import strip_html

    txt = strip_html(spark.createDataFrame([(1, "<p>a &amp; b")], "page_id long, html string"))._jdf.queryExecution().executedPlan().toString()
    assert txt.count("ArrowEvalPython [") == 1 and txt.count("decode(") == 1
