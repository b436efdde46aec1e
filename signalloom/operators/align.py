"""Key joins that replace alignment by row position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from signalloom.operators.ordered import matched

WINDOW_KEY = ["subject_id", "edf_id", "window_index"]


def orphans(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Row counts of a full outer join: matched, left only, right only."""
    a = left.select(*key).withColumn("_l", F.lit(1))
    b = right.select(*key).withColumn("_r", F.lit(1))
    both = a.join(b, list(key), "full_outer")
    return both.agg(
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("matched"),
        F.count_if(F.col("_r").isNull()).alias("left_only"),
        F.count_if(F.col("_l").isNull()).alias("right_only"),
    )


def aligned(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """One-to-one join on the key; callers check :func:`orphans` beforehand."""
    return left.join(right, list(key))


def recording_positions(windows: DataFrame, order: str = "name") -> DataFrame:
    """Per recording: its ordinal in the subject, its length and the position of
    its first window in the subject.

    ``order`` is ``name`` (sorted) or ``first_seen`` (by ``start_order``). The
    windows run over one row per recording.
    """
    seen = F.min("start_order") if order == "first_seen" else F.min("edf_id")
    recordings = windows.groupBy("subject_id", "edf_id").agg(F.count(F.lit(1)).alias("n_windows"), seen.alias("_seen"))
    w = Window.partitionBy("subject_id").orderBy("_seen", "edf_id")
    before = F.sum("n_windows").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return recordings.select(
        "subject_id",
        "edf_id",
        "n_windows",
        (F.row_number().over(w) - 1).cast("long").alias("file_id"),
        F.coalesce(before, F.lit(0)).alias("first_position"),
    )


def array_positions(windows: DataFrame, recordings: DataFrame) -> DataFrame:
    """Each window's position in its subject's combined array.

    A window index outside its recording gives a NULL position.
    """
    inside = (F.col("window_index") >= 0) & (F.col("window_index") < F.col("n_windows"))
    return matched(windows, recordings, ["subject_id", "edf_id"]).select(
        *WINDOW_KEY, "file_id", F.when(inside, F.col("first_position") + F.col("window_index")).alias("position")
    )


def global_file_ids(recordings: DataFrame) -> DataFrame:
    """Shift per-subject file ids so that they are unique over all subjects."""
    per_subject = recordings.groupBy("subject_id").agg((F.max("file_id") + 1).alias("_width"))
    w = Window.partitionBy(F.lit(0)).orderBy("subject_id").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_subject.select("subject_id", F.coalesce(F.sum("_width").over(w), F.lit(0)).alias("_shift"))
    return recordings.join(shifts, "subject_id").withColumn("global_file_id", F.col("file_id") + F.col("_shift")).drop(
        "_shift"
    )


def column_differences(a: DataFrame, b: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows per column that differ, plus rows missing on either side.

    Every column in ``columns`` is compared NULL-safely after a full outer join.
    """
    left = a.select(*key, F.struct(*columns).alias("_a"))
    right = b.select(*key, F.struct(*columns).alias("_b"))
    both = left.join(right, list(key), "full_outer")
    paired = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    counts = [F.count_if(paired & ~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))).alias(c) for c in columns]
    one = both.agg(
        *counts,
        F.count_if(F.col("_b").isNull()).alias("missing_right"),
        F.count_if(F.col("_a").isNull()).alias("missing_left"),
    )
    return one.unpivot([], [*columns, "missing_right", "missing_left"], "item", "differences")


def with_single_default(
    rows: DataFrame, candidates: DataFrame, group: str, candidate_group: str, value: str, candidate_value: str
) -> DataFrame:
    """Fill a missing ``value`` from the group's only candidate; stay NULL otherwise."""
    only = (
        candidates.where(F.col(candidate_group).isNotNull())
        .groupBy(F.col(candidate_group).alias(group))
        .agg(F.count(F.lit(1)).alias("_n"), F.min(candidate_value).alias("_only"))
        .where("_n = 1")
        .drop("_n")
    )
    return matched(rows, only, [group], "left").withColumn(value, F.coalesce(value, "_only")).drop("_only")


def lookup_ignoring_case(rows: DataFrame, table: DataFrame, group: str, name: str, how: str = "inner") -> DataFrame:
    """Join on ``(group, lower(name))``; ``table`` brings its own ``name`` as ``record_name``."""
    named = table.where(F.col(name).isNotNull())
    keyed = named.select(F.col(group), F.col(name).alias("record_name"), F.lower(name).alias("_lower"))
    if how == "left_anti":
        keyed = keyed.drop("record_name")
    return matched(rows.withColumn("_lower", F.lower(name)), keyed, [group, "_lower"], how).drop("_lower")
