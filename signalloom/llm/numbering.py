"""Positions of rows in an order, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from signalloom.session import settle

#: Rows of a range partition on large tables.
RANGE_ROWS = 1_000_000


def numbered(rows: DataFrame, order: Sequence[str], n_rows: int) -> DataFrame:
    """``rows`` of ``_group`` with ``_at``, the 0-based position in the group, and ``_n``, the group's size.

    Rows are dealt to ranges of ``(_group, *order)`` and counted there; a range then needs only what
    the ranges before it hold of its first group.
    """
    spark = rows.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // RANGE_ROWS))
    by = ["_group", *order]
    ranged = rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id())
    ranged = settle(ranged.withColumn("_range", F.shiftright("_row", 33)), "numbered")
    counts = ranged.groupBy("_group", "_range").agg(F.count(F.lit(1)).alias("_m"), F.min("_row").alias("_first"))
    in_group = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_m").over(in_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_group", "_range", (before - F.col("_first")).alias("_shift"), F.sum("_m").over(in_group).alias("_n"))
    return ranged.join(offsets, ["_group", "_range"]).withColumn("_at", F.col("_row") + F.col("_shift")).drop("_row", "_range", "_shift")
