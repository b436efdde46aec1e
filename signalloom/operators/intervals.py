"""Joins of time intervals on equal keys plus overlap.

Time is cut into bins, and an interval covers its bins with the fewest dyadic nodes (bins,
pairs of bins, fours and so on): two nodes a level at most, whether it lasts a second or a
thousand years. A point looks up the nodes above its bin. That is an equi-join on
``(keys, node)``, so Spark hashes it, and a recording that holds a third of the rows is
spread over its bins instead of meeting in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from signalloom.operators.ordered import islands, matched

BIN_SEC = 3600.0
#: Bins beyond this number count as the last one, so that infinite bounds have a bin too.
LAST_BIN = 1 << 44
LEVELS = 46


def overlap_seconds(a_start, a_end, b_start, b_end) -> Column:
    """Length of the overlap, 0 if apart, NULL if any bound is NULL."""
    bounds = [F.col(c) if isinstance(c, str) else c for c in (a_start, a_end, b_start, b_end)]
    known = bounds[0].isNotNull()
    for bound in bounds[1:]:
        known = known & bound.isNotNull()
    a0, a1, b0, b1 = bounds
    # greatest/least skip NULLs, so an unmatched side must be ruled out first.
    return F.when(known, F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0)))


def time_bin(seconds: Column, bin_sec: float = BIN_SEC) -> Column:
    return F.floor(seconds / F.lit(float(bin_sec))).cast("long")


def bounded_bin(seconds: Column, bin_sec: float = BIN_SEC) -> Column:
    return F.greatest(F.lit(-LAST_BIN), F.least(F.lit(LAST_BIN), time_bin(seconds, bin_sec)))


def _halved(number: Column, level: Column) -> Column:
    return F.call_function("shiftright", number, level)


def dyadic_cover(first: Column, last: Column) -> Column:
    """The bins ``first`` to ``last`` as an array of nodes ``(level, place)``; empty if there is none.

    A node of level k holds the 2^k bins from ``place * 2^k`` on. On each level only the outermost
    nodes can be missing from a node of the level above: an odd first one and an even last one.
    """

    def nodes(level: Column) -> Column:
        low, high = -_halved(-first, level), _halved(last + 1, level) - 1
        node = lambda place: F.struct(level.alias("level"), place.alias("place"))
        return F.array(
            F.when((low <= high) & (F.pmod(low, F.lit(2)) == 1), node(low)), F.when((low <= high) & (F.pmod(high, F.lit(2)) == 0), node(high))
        )

    # no node is longer than the interval
    top = F.least(F.lit(LEVELS), F.floor(F.log2(F.greatest(last - first + 1, F.lit(1)).cast("double"))).cast("int") + 1)
    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), top), nodes)), lambda n: n.isNotNull())


def intervals_at(points: DataFrame, intervals: DataFrame, keys: Sequence[str], bin: str, first: Column, last: Column) -> DataFrame:
    """Each row of ``points`` with each row of ``intervals`` whose bins ``first`` to ``last`` include its ``bin``.

    A point is looked up on the levels that occur among the intervals, which are few.
    """
    nodes = intervals.withColumn("_node", F.explode(dyadic_cover(first, last)))
    levels = nodes.agg(F.collect_set("_node.level")).scalar()
    up = F.transform("_levels", lambda k: F.struct(k.alias("level"), _halved(F.col(bin), k).alias("place")))
    looked_up = points.withColumn("_levels", levels).withColumn("_node", F.explode(up)).drop("_levels")
    return matched(looked_up, nodes, [*keys, "_node"]).drop("_node")


def merge_intervals(
    df: DataFrame, keys: Sequence[str], start: str = "start_sec", end: str = "end_sec", bin_sec: float = BIN_SEC
) -> DataFrame:
    """Merge overlapping or touching intervals of a key."""
    return islands(
        df.select(*keys, start, end),
        keys,
        F.col(start),
        F.col(end),
        time_bin(F.col(start), bin_sec),
        {start: (F.min, start), end: (F.max, end)},
    )


def label_windows(
    windows: DataFrame,
    annotations: DataFrame,
    keys: Sequence[str],
    max_window_sec: float,
    out: str = "label",
    bin_sec: float = BIN_SEC,
) -> DataFrame:
    """1 iff an annotation of the same key overlaps the window; touching does not count.

    A window is looked up by the bin of its start alone: an annotation is entered
    into every bin that has windows and in which an overlapping window of at most ``max_window_sec``
    can start. So the wide window rows are neither copied nor re-aggregated; the
    join only adds a flag (an existence join). A longer window is an error.
    """
    bins = windows.select(*keys, bounded_bin(F.col("start_sec"), bin_sec).alias("_a_bin")).distinct()
    marks = annotations.select(*keys, F.col("start_sec").alias("_a_start"), F.col("end_sec").alias("_a_end"))
    from_bin = bounded_bin(F.col("_a_start") - max_window_sec, bin_sec)
    spread = intervals_at(bins, marks, keys, "_a_bin", from_bin, bounded_bin(F.col("_a_end"), bin_sec))
    spread = spread.withColumnsRenamed({k: f"_a_{k}" for k in keys})
    # Names of the outer side must not occur inside the subquery.
    outer = {f"_w_{k}": F.col(k) for k in [*keys, "start_sec", "end_sec"]}
    too_long = F.col("end_sec") - F.col("start_sec") > F.lit(max_window_sec + 1e-9)
    refused = F.raise_error(F.lit(f"a window is longer than max_window_sec = {max_window_sec}"))
    home = F.when(too_long, refused).otherwise(bounded_bin(F.col("start_sec"), bin_sec))
    binned = windows.withColumns({**outer, "_w_bin": home})
    hit = (
        (F.col("_a_bin") == F.col("_w_bin").outer())
        & (F.col("_a_start") < F.col("_w_end_sec").outer())
        & (F.col("_a_end") > F.col("_w_start_sec").outer())
    )
    for k in keys:
        hit = hit & F.col(f"_a_{k}").eqNullSafe(F.col(f"_w_{k}").outer())
    return binned.withColumn(out, spread.where(hit).exists().cast("int")).drop(*outer, "_w_bin")


def overlapping_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    bin_sec: float = BIN_SEC,
) -> DataFrame:
    """Every overlapping pair once. Bounds are ``start_sec``/``end_sec`` on the
    left and ``true_start``/``true_end`` on the right.

    An overlap begins where one of the two begins. So the starts on the left meet the
    intervals on the right that began no later, and the starts on the right those on the left
    that began earlier; no pair is found twice, and no interval is copied into every bin.
    """
    at = lambda seconds: bounded_bin(F.col(seconds), bin_sec)
    earlier = intervals_at(left.withColumn("_bin", at("start_sec")), right, keys, "_bin", at("true_start"), at("true_end"))
    later = intervals_at(right.withColumn("_bin", at("true_start")), left, keys, "_bin", at("start_sec"), at("end_sec"))
    pairs = earlier.where("true_start <= start_sec").unionByName(later.where("true_start > start_sec"))
    return (
        pairs.where("start_sec < true_end AND true_start < end_sec")
        .drop("_bin")
        .withColumn("overlap_sec", overlap_seconds("start_sec", "end_sec", "true_start", "true_end"))
    )
