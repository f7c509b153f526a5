"""Join sides whose size is checked before they are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def is_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """Counts rows and bytes, reading at most ``max_rows`` + 1 rows."""
    width = F.length(F.to_json(F.struct(*df.columns)))
    seen = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return seen["n"] <= max_rows and seen["b"] <= max_bytes


def small_side(df: DataFrame, small: bool) -> DataFrame:
    """A broadcast hint where the side is known to be small; otherwise the plan is left to Spark,
    which then shuffles both sides and splits skewed partitions at run time."""
    return F.broadcast(df) if small else df
