"""Dense 0-based positions in a total order without a single-task window.

``row_number() OVER (ORDER BY ...)`` with no PARTITION BY moves every row to
one task. Here the rows are range-partitioned and sorted by Spark, tagged with
``monotonically_increasing_id`` (partition id in the high bits, row number in
the partition in the low bits), frozen as a written table, and shifted by
per-partition offsets. The offset table has one row per (partition, group), so
its size is bounded by the partition count, not by the data, and it is
broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordtally.operators.joins import checked_broadcast
from wordtally.session import reliable_checkpoint


def ordered(df: DataFrame, order: list[Column], groups: list[str]) -> DataFrame:
    """``df`` range-partitioned and sorted by ``groups`` and ``order``, frozen, with ``_pid`` (partition) and ``_mono`` (place, ascending over all)."""
    tagged = df.orderBy(*[F.col(g) for g in groups], *order).withColumn("_mono", F.monotonically_increasing_id())
    return reliable_checkpoint(tagged).withColumn("_pid", F.shiftright("_mono", 33))


def join_groups(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Join a table of group facts, null keys matching null keys."""
    right = stats.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    match = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return df.join(checked_broadcast(right), match).drop(*[f"_k_{k}" for k in keys])


def dense_index(
    df: DataFrame,
    order: list[Column],
    group: str | list[str] | None = None,
    idx_col: str = "idx",
    count_col: str | None = None,
) -> DataFrame:
    """Add ``idx_col`` = position of the row in ``order`` (within ``group``).

    ``order`` must be a total order (end it with a unique key). With
    ``count_col`` the size of the row's group is added as well. A group may
    be as large as the data: it spans as many sorted partitions as it needs.
    """
    groups = [group] if isinstance(group, str) else list(group or [])
    tagged = ordered(df, order, groups)
    gcols = ["_pid"] + groups
    stats = tagged.groupBy(*gcols).agg(F.min("_mono").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w_before = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1
    )
    stats = stats.withColumn("_offset", F.coalesce(F.sum("_n").over(w_before), F.lit(0)))
    if count_col:
        w_all = Window.partitionBy(*groups)
        stats = stats.withColumn(count_col, F.sum("_n").over(w_all))
    stats = reliable_checkpoint(stats)
    out = join_groups(tagged, stats, gcols).withColumn(
        idx_col, (F.col("_offset") + F.col("_mono") - F.col("_first")).cast("long")
    )
    return out.drop("_mono", "_pid", "_first", "_n", "_offset")
