"""Scalar text expressions (JVM-side, inside whole-stage codegen).

Each function takes and returns a ``Column``; none of them calls Python per row.
Where Spark's built-in differs from the Python semantics the engine must keep
(``trim``, ``url_encode``, ``\\s``), the expression says how it is made equal.
"""

from __future__ import annotations

import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# ---------------------------------------------------------------------------

# Keyword -> expansion terms for short queries, in dictionary order (order matters:
# terms are appended in this order, not in query order).
QUERY_EXPANSIONS = [
    ("romance", "love story emotional heartbreak relationship"),
    ("thriller", "suspense tension dangerous mystery"),
    ("fantasy", "magic world-building adventure epic"),
    ("sci-fi", "futuristic technology space exploration"),
    ("horror", "frightening dark psychological fear"),
    ("mystery", "detective investigation crime clues"),
    ("historical", "period setting based on real events past era"),
    ("adventure", "journey quest action exploration"),
    ("sad", "emotional grief loss melancholy"),
    ("funny", "humour comedy lighthearted witty"),
]
EXPANSION_SEPARATOR = " — "
EXPANSION_MAX_WORDS = 6  # queries with this many words or more are left alone

RATING_WORDS_HIGH = "A highly rated, critically acclaimed book. "
RATING_WORDS_GOOD = "A well-received popular book. "
RATING_HIGH = 4.2
RATING_GOOD = 3.8

HOOK_SENTENCES = 3
HOOK_MAX_CHARS = 480
HOOK_ELLIPSIS = "..."
MIN_QUERY_CHARS = 3  # a query is accepted when its stripped length is above this
UNKNOWN = "Unknown"
STAR_FULL = "★"
STAR_EMPTY = "☆"
FALLBACK_COVER = "https://placehold.co/200x300/F5F1E8/AAAAAA/png?text=No+Cover"
SEARCH_URL = "https://www.amazon.com/s?k="

# Python's str.strip()/str.split() whitespace set, as one regex character class
# (Java's \s misses most of it; (?U)\s misses U+001C..U+001F).
PY_WS = "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- query handling (C5-C10) ------------------------------------------------


def py_strip(c: Column | str) -> Column:
    """``str.strip()``: remove leading and trailing whitespace of any kind."""
    return F.regexp_replace(F.regexp_replace(_c(c), f"^{PY_WS}+", ""), f"{PY_WS}+$", "")


def word_count(stripped: Column | str) -> Column:
    """``len(s.split())`` on an already stripped string."""
    return F.size(F.filter(F.split(_c(stripped), f"{PY_WS}+"), lambda w: w != ""))


def is_valid_query(stripped: Column | str) -> Column:
    return F.coalesce(F.length(_c(stripped)) > MIN_QUERY_CHARS, F.lit(False))


def expansion_terms(stripped: Column | str, table=QUERY_EXPANSIONS) -> Column:
    """Terms of every keyword found as a case-insensitive substring, in table order;
    '' when none is found. ``concat_ws`` skips the nulls of keywords not found."""
    low = F.lower(_c(stripped))
    return F.concat_ws(" ", *[F.when(low.contains(F.lit(kw)), F.lit(terms)) for kw, terms in table])


def expand_query(stripped: Column | str, table=QUERY_EXPANSIONS) -> Column:
    s = _c(stripped)
    terms = expansion_terms(s, table)
    return F.when(
        (word_count(s) < EXPANSION_MAX_WORDS) & (terms != ""),
        F.concat(s, F.lit(EXPANSION_SEPARATOR), terms),
    ).otherwise(s)


EXPANSION_ROWS = 1_000_000  # keywords an expansion table may have


def expand_by_table(queries: DataFrame, terms: DataFrame, text_col: str, max_words: int | None = None) -> DataFrame:
    """``expand_query`` with its keywords in a table (ord, keyword, terms): adds ``terms_found`` and ``expanded``.

    The table becomes one automaton of all keywords, shipped once (its rows are counted and checked first); a text is read once, whatever their
    number. Terms follow ``ord``, then the keyword. Keywords are lower case; empty or null ones never match. ``max_words``: only texts of fewer words."""
    import ahocorasick

    rows = terms.where(F.col("keyword").isNotNull() & (F.col("keyword") != "")).select("ord", "keyword", "terms")
    if (n := rows.count()) > EXPANSION_ROWS:
        raise ValueError(f"{n} expansion keywords, more than {EXPANSION_ROWS}")
    words = ahocorasick.Automaton()
    found_terms = []
    for r in sorted(rows.collect(), key=lambda r: (r["ord"], r["keyword"])):
        words.add_word(r["keyword"], [*words.get(r["keyword"], []), len(found_terms)])
        found_terms.append(r["terms"])
    if n:
        words.make_automaton()
    model = queries.sparkSession.sparkContext.broadcast((words, found_terms))

    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        automaton, all_terms = model.value

        def one(text: str | None) -> str:
            hits = sorted({i for _, at in automaton.iter(text) for i in at}) if text and len(automaton) else []
            return " ".join(all_terms[i] for i in hits if all_terms[i] is not None)

        return texts.map(one)

    s = F.col(text_col)
    short = F.lit(True) if max_words is None else word_count(s) < max_words
    out = queries.withColumn("terms_found", find(F.lower(s)))
    return out.withColumn("expanded", F.when(short & (F.col("terms_found") != ""), F.concat(s, F.lit(EXPANSION_SEPARATOR), "terms_found")).otherwise(s))


# --- catalogue text (C2-C4) -------------------------------------------------


def rating_text(rating: Column | str) -> Column:
    r = _c(rating)
    return F.when(r >= RATING_HIGH, F.lit(RATING_WORDS_HIGH)).when(r >= RATING_GOOD, F.lit(RATING_WORDS_GOOD)).otherwise(F.lit(""))


def stitch_text(name="Name", authors="Authors", rating="Rating", description="Description") -> Column:
    return F.concat(
        F.lit("Title: "),
        F.coalesce(_c(name), F.lit(UNKNOWN)),
        F.lit(". Author: "),
        F.coalesce(_c(authors), F.lit(UNKNOWN)),
        F.lit(". "),
        rating_text(rating),
        F.lit("Summary: "),
        F.coalesce(_c(description), F.lit("")),
    )


# --- result cards (C16-C24) -------------------------------------------------


def escape_name(c: Column | str) -> Column:
    """Title/author escaping of the cards: only '"' and '<' are replaced."""
    return F.replace(F.replace(_c(c), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))


def split_sentences(c: Column | str) -> Column:
    """``re.split(r'(?<=[.!?]) +', s)``."""
    return F.split(_c(c), r"(?<=[.!?]) +", -1)


def hook(description: Column | str) -> Column:
    """First three sentences joined by a space, cut to 480 characters plus '...',
    then '<' and '>' escaped (escaping comes after the cut). Null -> ''."""
    h = F.array_join(F.slice(split_sentences(F.coalesce(_c(description), F.lit(""))), 1, HOOK_SENTENCES), " ")
    cut = F.when(F.length(h) > HOOK_MAX_CHARS, F.concat(F.substring(h, 1, HOOK_MAX_CHARS), F.lit(HOOK_ELLIPSIS))).otherwise(h)
    return F.replace(F.replace(cut, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def display_rating(rating: Column | str) -> Column:
    return F.round(_c(rating), 1)


def stars(rating: Column | str) -> Column:
    full = F.floor(display_rating(rating)).cast("int")
    return F.concat(F.repeat(F.lit(STAR_FULL), full), F.repeat(F.lit(STAR_EMPTY), F.lit(5) - full))


def percent_encode(c: Column | str) -> Column:
    """``urllib.parse.quote(s)`` (safe='/'): Java's form encoder turned into RFC 3986."""
    e = F.url_encode(_c(c))
    e = F.replace(e, F.lit("+"), F.lit("%20"))
    e = F.replace(e, F.lit("%2F"), F.lit("/"))
    e = F.replace(e, F.lit("%7E"), F.lit("~"))
    return F.replace(e, F.lit("*"), F.lit("%2A"))


def search_link(title: Column | str, author: Column | str) -> Column:
    """Shopping search link on the raw (unescaped) title and author (Q19 fixed)."""
    return F.concat(F.lit(SEARCH_URL), percent_encode(F.concat_ws(" ", _c(title), _c(author))))


def clean_title(c: Column | str) -> Column:
    """Drop parenthesised parts (shortest match), then strip."""
    return py_strip(F.regexp_replace(_c(c), r"\(.*?\)", ""))


# --- HTML (B1) --------------------------------------------------------------

def strip_tags(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), "<[^>]+>", " ")


ENTITY = r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"


def decode_entity(ref: str) -> str:
    """One complete reference, named or numeric, as HTML 5 names them; an unknown one stays."""
    if ref[1] == "#":
        n = int(ref[3:-1], 16) if ref[2] in "xX" else int(ref[2:-1])
        return chr(n) if 0 < n < 0x110000 and not 0xD800 <= n < 0xE000 else "\ufffd"
    return html5.get(ref[1:], ref)


def decode_entities(c: Column | str) -> Column:
    """Every named and numeric reference, once (``&amp;lt;`` becomes ``&lt;``). Arrow batches: the table of names is
    far too long for an expression."""

    @F.pandas_udf("string")
    def decode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or "&" not in t else re.sub(ENTITY, lambda m: decode_entity(m[0]), t))

    return decode(_c(c))


def collapse_ws(c: Column | str) -> Column:
    return py_strip(F.regexp_replace(_c(c), f"{PY_WS}+", " "))
