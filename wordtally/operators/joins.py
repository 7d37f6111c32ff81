"""Joins against derived lookup tables with a checked broadcast.

A lookup table (dictionary, lemma table, per-fold statistics) is broadcast
only after its row count is known to be under ``wordtally.broadcast.maxRows``
(default 2,000,000); above that the join is left to a shuffle join, where AQE
splits skewed partitions (hot words).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_ROWS = 2_000_000


def broadcast_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("wordtally.broadcast.maxRows", str(DEFAULT_MAX_ROWS)))


def checked_broadcast(table: DataFrame, rows: int | None = None) -> DataFrame:
    """``broadcast(table)`` when its row count is under the limit, else ``table``."""
    n = table.count() if rows is None else rows
    return F.broadcast(table) if n <= broadcast_limit(table) else table
