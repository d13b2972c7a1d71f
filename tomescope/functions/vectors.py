"""Vector expressions over ``ARRAY<FLOAT>`` / ``ARRAY<DOUBLE>`` columns.

These are higher-order SQL functions: fine for per-row work on a few rows (MMR inputs,
norms, reports). Scoring many pairs goes through the block-matmul operators in
``tomescope.operators.knn`` instead, because higher-order functions fall outside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_NORM_GUARD = 1e-9  # a zero vector is divided by this and stays zero


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v: Column | str) -> Column:
    return _c(v).cast("array<double>")


def as_float(v: Column | str) -> Column:
    return _c(v).cast("array<float>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def sq_norm(v: Column | str) -> Column:
    return F.aggregate(F.transform(as_double(v), lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(v: Column | str) -> Column:
    n = F.sqrt(sq_norm(v))
    n = F.when(n == 0, F.lit(ZERO_NORM_GUARD)).otherwise(n)
    return F.transform(as_double(v), lambda x: x / n)


def dense_from_entries(entries: Column | str, dim: int) -> Column:
    """array<struct<bucket:int, w:double>> -> dense array<double> of length ``dim``."""
    m = F.map_from_entries(_c(entries))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at(m, i), F.lit(0.0)))
