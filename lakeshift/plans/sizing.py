"""Size checks in front of broadcast joins.

A side is broadcast only when a bounded count proves it small; otherwise the join is left
to the planner (sort-merge / AQE re-plan at runtime).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_count_at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads at most ``max_rows + 1``."""
    return df.limit(max_rows + 1).count() <= max_rows


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """``broadcast(df)`` if it has at most ``max_rows`` rows, else ``df`` unchanged."""
    return F.broadcast(df) if row_count_at_most(df, max_rows) else df
