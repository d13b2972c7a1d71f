"""Cleaning job (B1-B3, H1): raw records -> clean catalogue.

Dedup keeps the best row per key with an aggregate (``min`` of a narrow sort struct), not a window: the
aggregate combines in the task, so a key holding a third of all rows leaves each task as one row instead of
one task sorting the whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomescope.functions import text as T

# Default outlier bounds for the page count (our choice; the reference names none).
PAGES_MIN = 1
PAGES_MAX = 2000


def strip_html(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Tags -> one space; entities decoded and whitespace collapsed as separate columns."""
    decoded = pages.select("page_id", T.strip_tags(F.col(html_col)).alias("stripped")).withColumn("decoded", T.decode_entities("stripped"))
    return decoded.withColumn("clean_text", T.collapse_ws("decoded"))  # the decoded column again: one Python pass


def outlier_filter(books: DataFrame, col: str = "Pages", lo: float = PAGES_MIN, hi: float = PAGES_MAX) -> DataFrame:
    return books.where(F.col(col).between(lo, hi))


QUARTILE_ACCURACY = 10_000  # relative rank error of the quartile sketches is 1 in so many


def iqr_filter(books: DataFrame, col: str, groups: list[str], reach: float = 1.5, accuracy: int = QUARTILE_ACCURACY) -> DataFrame:
    """Rows whose ``col`` lies within ``reach`` interquartile ranges of the quartiles of their group; adds the bounds ``low`` and ``high``.

    Quartiles are mergeable sketches: a task reduces its rows of a group to one sketch, so a group that holds a third of all rows is a sketch a task.
    The bounds, one row per group, are joined back; null group values are a group of their own. Rows without a value go."""
    quartiles = F.percentile_approx(F.col(col).cast("double"), [0.25, 0.75], accuracy)
    rows = books.where(F.col(col).isNotNull())
    per = rows.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)]).agg(quartiles.alias("_q"))
    q1, q3 = F.col("_q")[0], F.col("_q")[1]
    bounds = per.withColumn("low", q1 - (q3 - q1) * reach).withColumn("high", q3 + (q3 - q1) * reach).drop("_q")
    same = F.lit(True)
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return rows.join(bounds, same).where(F.col(col).between(F.col("low"), F.col("high"))).drop(*[f"_g{i}" for i in range(len(groups))])


def dedup_key(name: str = "Name") -> Column:
    return F.lower(T.py_strip(F.col(name)))


def dedup_best(df: DataFrame, keys: list[Column], order: list[tuple[Column, bool]], id_col: str) -> DataFrame:
    """One row per key: the first by ``order`` ((numeric expr, descending) pairs; nulls last), then by ``id_col``.

    Only the key, the order columns and the id are aggregated and shuffled; the rows themselves are picked by
    a semi join on the id."""
    fields = []
    for i, (e, desc) in enumerate(order):
        fields.append(e.isNull().alias(f"_n{i}"))
        fields.append((-e if desc else e).alias(f"_v{i}"))
    keyed = df.select(*[k.alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*fields, F.col(id_col).alias("_id")).alias("_s"))
    best = keyed.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.min("_s").alias("_s"))
    return df.join(best.select(F.col("_s._id").alias(id_col)), id_col, "left_semi")


def dedup_books(books: DataFrame) -> DataFrame:
    """Default dedup: key (lower(strip(Name)), Authors); best Rating first, then Id."""
    return dedup_best(books, [dedup_key("Name"), F.col("Authors")], [(F.col("Rating"), True)], "Id")
