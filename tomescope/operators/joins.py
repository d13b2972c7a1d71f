"""Size-checked broadcast for the small side of a join.

The bound comes from the plan, not from the data: e.g. picks <= |queries| * k_final rows.
Above the budget the join is left to Catalyst/AQE (shuffle join, skew handling).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomescope.config import DEFAULT, Params


def bounded_broadcast(df: DataFrame, max_rows: int, row_bytes: int, params: Params = DEFAULT) -> DataFrame:
    """``broadcast(df)`` when ``max_rows * row_bytes`` fits ``params.max_broadcast_bytes``."""
    if max_rows >= 0 and max_rows * row_bytes <= params.max_broadcast_bytes:
        return F.broadcast(df)
    return df
