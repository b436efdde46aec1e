"""Counts and summaries of window tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _ratio_pct(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, 100.0 * F.col(part) / F.col(whole)).otherwise(0.0)


def by_recording(windows: DataFrame, *extra: str) -> DataFrame:
    """Window and positive counts per recording; the base of the wider summaries."""
    return windows.groupBy(*extra, "subject_id", "edf_id").agg(
        F.count(F.lit(1)).alias("windows"), F.sum(F.col("label").cast("long")).alias("positives")
    )


def window_summary(windows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Windows, positives, negatives, positive share, subjects and recordings per group.

    Rows are reduced to recordings first, so distinct counts need no extra pass
    and a hot group is already combined on the map side.
    """
    recordings = by_recording(windows, *[g for g in groups if g not in ("subject_id", "edf_id")])
    summed = recordings.groupBy(*groups).agg(
        F.count_distinct("subject_id").alias("subjects"),
        F.count(F.lit(1)).alias("recordings"),
        F.sum("windows").alias("windows"),
        F.sum("positives").alias("positives"),
    )
    return summed.withColumn("negatives", F.col("windows") - F.col("positives")).withColumn(
        "positive_pct", _ratio_pct("positives", "windows")
    )


def recordings_with_positives(windows: DataFrame) -> DataFrame:
    """The recordings that hold a positive window, one row each."""
    return by_recording(windows).where("positives > 0")


def recording_kind(windows: DataFrame) -> DataFrame:
    """``max(label)`` per recording and the file type derived from it."""
    return windows.groupBy("subject_id", "edf_id").agg(F.max("label").alias("has_positive")).withColumn(
        "filetype", F.when(F.col("has_positive") == 1, "seizure file").otherwise("clean file")
    )


def totals(windows: DataFrame, split: str = "split") -> DataFrame:
    """Per subject, per split and grand totals. The rollup runs over subject totals."""
    subjects = windows.groupBy(split, "subject_id").agg(
        F.count(F.lit(1)).alias("windows"), F.sum(F.col("label").cast("long")).alias("positives")
    )
    rolled = subjects.rollup(split, "subject_id").agg(
        F.sum("windows").alias("windows"), F.sum("positives").alias("positives")
    )
    return (
        rolled.withColumn(split, F.coalesce(split, F.lit("all")))
        .withColumn("subject_id", F.coalesce("subject_id", F.lit("all")))
        .withColumn("positive_pct", _ratio_pct("positives", "windows"))
    )


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).count().withColumnRenamed("count", "n").orderBy(*columns)


def domain_check(df: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    """Each distinct value of a column, how often it occurs and whether it is allowed."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "allowed", F.col("value").isin(*allowed).cast("int")
    )


def class_balance(df: DataFrame, label: str = "label", groups: Sequence[str] = ()) -> DataFrame:
    """Counts of both classes side by side and negatives per positive."""
    counted = df.groupBy(*groups).agg(
        F.count_if(F.col(label) == 0).alias("negatives"), F.count_if(F.col(label) == 1).alias("positives")
    )
    return counted.withColumn(
        "imbalance", F.when(F.col("positives") > 0, F.col("negatives") / F.col("positives"))
    )


def run_summary(runs: DataFrame, metric: str = "metric") -> DataFrame:
    """Mean and population std over runs, per model and per model and subject.

    With a single run the std is NULL and the text form is the plain mean.
    """
    runs_per = runs.groupingSets([["model"], ["model", "subject_id"]], "model", "subject_id").agg(
        F.grouping("subject_id").alias("_whole"),
        F.count(metric).alias("runs"),
        F.avg(metric).alias("mean"),
        F.stddev_pop(metric).alias("_std"),
    )
    several = F.col("runs") > 1
    return runs_per.select(
        "model",
        F.when(F.col("_whole") == 1, "all").otherwise(F.col("subject_id").cast("string")).alias("subject_id"),
        "runs",
        "mean",
        F.when(several, F.col("_std")).alias("std"),
        F.when(several, F.format_string("%.4f +/- %.4f", "mean", "_std"))
        .otherwise(F.format_string("%.4f", "mean"))
        .alias("text"),
    )


def side_by_side(df: DataFrame, row: str, column: str, values: Sequence[str], metric: str) -> DataFrame:
    """Pivot a metric: one line per ``row``, one column per given ``column`` value."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.avg(metric))


def metrics_as_rows(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Unpivot metric columns to ``(keys, metric, value)`` rows."""
    doubles = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    return doubles.unpivot(list(keys), list(metrics), "metric", "value")
