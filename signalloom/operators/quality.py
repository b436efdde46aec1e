"""Data-quality constraints and signal statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from signalloom.functions import arrays
from signalloom.operators.ordered import numbered, previous_value
from signalloom.session import settle

# Limits of the channel and scale rules.
FLAT_STD = 1e-4
EXTREME_ABS = 1000.0
LARGE_ABS = 100.0
NEAR_CONSTANT_VAR = 1e-6
PLATEAU = 10
NORMALIZED_STD = (0.5, 2.0)
RAW_STD = 0.01


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def column_presence(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Per required column: whether the table lacks it, and its rows without a value."""
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(int(c not in df.columns)).alias("missing"),
            (F.count_if(F.col(c).isNull()) if c in df.columns else F.count(F.lit(1))).alias("empty"),
        ).alias(f"c{i}")
        for i, c in enumerate(required)
    ]
    return df.agg(*rows).select(F.inline(F.array(*[f"c{i}" for i in range(len(required))])))


def totals_verdict(counted: DataFrame, expected: DataFrame, keys: Sequence[str], items: Sequence[str]) -> DataFrame:
    """Expected and found totals per key and item; ``ok`` is 0 where they differ or one is missing."""
    left = expected.select(*keys, F.struct(*items).alias("_e"))
    right = counted.select(*keys, F.struct(*items).alias("_f"))
    both = left.join(right, list(keys), "full_outer")
    pairs = [F.struct(F.lit(i).alias("item"), F.col(f"_e.{i}").alias("expected"), F.col(f"_f.{i}").alias("found")) for i in items]
    rows = both.select(*keys, F.inline(F.array(*pairs)))
    same = F.col("expected").eqNullSafe(F.col("found")) & F.col("expected").isNotNull()
    return rows.withColumn("ok", same.cast("int"))


def is_finite(value: Column) -> Column:
    v = value.cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def close_to(a: Column, b: Column | float) -> Column:
    b = F.lit(float(b)) if isinstance(b, (int, float)) else b
    return F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Count the rows that break each rule, in one pass. A NULL verdict is a violation."""
    broken = [F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()]
    one = df.agg(*broken)
    return one.unpivot([], list(rules), "constraint", "violations")


def require(checks: DataFrame) -> None:
    """Raise if any constraint is broken (the table has one row per constraint)."""
    broken = checks.where("violations > 0").collect()
    if broken:
        raise ValueError("; ".join(f"{r['constraint']}: {r['violations']}" for r in broken))


def audited(rows: DataFrame, rules: Mapping[str, Column], key: Sequence[str], name: str) -> DataFrame:
    """``rows``, written to the shared scratch folder and counted on the way; refused if they break a rule.

    Besides ``rules`` there must be rows at all, and no key twice. The counts are observed by the job that writes, so that
    whatever ``rows`` come from is evaluated once; rows that a join on the key has dealt out are not dealt out again.
    """
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
    seen = Observation(name)
    checks = [F.count_if(~F.coalesce(ok, F.lit(False))).alias(rule) for rule, ok in rules.items()]
    checks += [F.count(F.lit(1)).alias("_rows"), F.count_if(F.col("_nth") > 1).alias("unique_key")]
    kept = settle(rows.withColumn("_nth", nth).observe(seen, *checks), name).drop("_nth")
    found = dict(seen.get)
    found["not_empty"] = int(found.pop("_rows") == 0)
    broken = {rule: n for rule, n in found.items() if n}
    if broken:
        raise ValueError("; ".join(f"{rule}: {n}" for rule, n in broken.items()))
    return kept


def prediction_rules() -> dict[str, Column]:
    binary = [0, 1]
    return {
        "finite_start": is_finite(F.col("start_sec")),
        "finite_end": is_finite(F.col("end_sec")),
        "finite_score": is_finite(F.col("y_prob")),
        "end_after_start": F.col("end_sec") > F.col("start_sec"),
        "binary_truth": F.col("y_true").isin(binary),
        "binary_prediction": F.col("y_pred").isin(binary),
    }


def metadata_rules(rate: float = 128.0, channels: int = 23, samples: int = 512) -> dict[str, Column]:
    return {
        "has_dataset": F.col("dataset_id").isNotNull(),
        "has_recording": F.col("edf_id").isNotNull(),
        "end_after_start": F.col("end_sec") > F.col("start_sec"),
        "sampling_rate": close_to(F.col("sampling_rate"), rate),
        "n_channels": F.col("n_channels") == channels,
        "n_samples": F.col("n_samples") == samples,
        "binary_label": F.col("label").isin([0, 1]),
    }


def extra_rows(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with the number of surplus rows."""
    return df.groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("extra")).where("extra > 0")


def surplus(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Total of surplus rows over all keys (0 when the key is unique)."""
    return extra_rows(df, key).agg(
        F.coalesce(F.sum("extra"), F.lit(0)).alias("violations"), F.count(F.lit(1)).alias("keys")
    )


def many_partners(df: DataFrame, one: Sequence[str], other: Sequence[str]) -> DataFrame:
    """Values of ``one`` that occur with more than one ``other``."""
    pairs = df.select(*one, *other).distinct()
    return pairs.groupBy(*one).agg(F.count(F.lit(1)).alias("partners")).where("partners > 1")


def bijection_check(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """How many values on either side break a one-to-one pairing."""
    pairs = df.select(*left, *right).distinct()

    def count_side(side):
        return pairs.groupBy(*side).agg(F.count(F.lit(1)).alias("_n")).agg(F.count_if(F.col("_n") > 1)).scalar()

    return pairs.agg(F.count(F.lit(1)).alias("pairs")).select(
        "pairs", count_side(left).alias("left_violations"), count_side(right).alias("right_violations")
    )


def number_health(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL, NaN and infinite counts per numeric column."""
    one = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count_if(F.col(c).isNull()).alias("nulls"),
                F.count_if(F.isnan(F.col(c).cast("double"))).alias("nans"),
                F.count_if(F.abs(F.col(c).cast("double")) == float("inf")).alias("infs"),
            ).alias(f"c{i}")
            for i, c in enumerate(columns)
        ]
    )
    return one.select(F.inline(F.array(*[f"c{i}" for i in range(len(columns))])))


def array_health(df: DataFrame, column: str, size: int) -> DataFrame:
    """Rows whose array has the wrong length or holds a value that is not finite."""
    return violations(
        df,
        {"size": F.size(column) == size, "finite": F.forall(column, lambda v: is_finite(v))},
    )


def block_breaks(
    df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], chunk: Column
) -> DataFrame:
    """Blocks of equal ``value`` in row order against distinct values, per key.

    ``contiguous`` is 1 iff every value forms one block.
    """
    lagged = previous_value(df, keys, value, order, chunk, "_before", first="_first")
    fresh = F.col("_first") | ~F.col("_before").eqNullSafe(F.col(value))
    return (
        lagged.groupBy(*keys, value)
        .agg(F.count_if(fresh).alias("_blocks"))
        .groupBy(*keys)
        .agg(F.sum("_blocks").alias("blocks"), F.count(F.lit(1)).alias("values"))
        .withColumn("contiguous", (F.col("blocks") == F.col("values")).cast("int"))
    )


def index_gaps(df: DataFrame, keys: Sequence[str], index: str, chunk_size: int = 65_536) -> DataFrame:
    """Per key: rows whose ``index`` differs from their position (0, 1, 2, ...)."""
    placed = numbered(df, keys, [index], F.floor(F.col(index) / chunk_size), "_position")
    return placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("_position").eqNullSafe(F.col(index))).alias("misplaced")
    )


def moments(samples: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Count, extrema, mean, std and defect counts over the samples of a group.

    Sums cover finite values, but the divisor is the number of all values. One
    partial aggregation; nothing but a few sums per group is shuffled.
    """
    v = F.col(value).cast("double")
    ok = is_finite(v)
    summed = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(ok, v)).alias("min"),
        F.max(F.when(ok, v)).alias("max"),
        F.sum(F.when(ok, v).otherwise(0.0)).alias("_s"),
        F.sum(F.when(ok, v * v).otherwise(0.0)).alias("_q"),
        F.count_if(F.isnan(v)).alias("nans"),
        F.count_if(F.abs(v) == float("inf")).alias("infs"),
        F.count_if((F.abs(v) > LARGE_ABS) & ~F.isnan(v)).alias("large"),
        F.max(F.when(ok, F.abs(v))).alias("max_abs"),
    )
    return _with_spread(summed)


def array_moments(
    windows: DataFrame, keys: Sequence[str], signal: str = "signal", by_channel: bool = True
) -> DataFrame:
    """The figures of :func:`moments` from channel-major windows, per key and channel.

    Each window is reduced to one row per channel inside its batch.
    """
    parts = windows.select(*keys, F.inline(arrays.channel_parts(signal, LARGE_ABS)))
    groups = [*keys, "channel"] if by_channel else list(keys)
    summed = parts.groupBy(*groups).agg(
        F.sum("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("s").alias("_s"), F.sum("q").alias("_q"),
        *[F.sum(c).alias(c) for c in ("nans", "infs", "large")], F.max("max_abs").alias("max_abs"),
    )
    return _with_spread(summed)


def _with_spread(summed: DataFrame) -> DataFrame:
    mean = F.col("_s") / F.col("n")
    var = F.greatest(F.lit(0.0), F.col("_q") / F.col("n") - mean * mean)
    return summed.withColumn("mean", mean).withColumn("std", F.sqrt(var)).drop("_s", "_q")


def with_channel_flags(stats: DataFrame) -> DataFrame:
    return stats.withColumn("flat", (F.col("std") < FLAT_STD).cast("int")).withColumn(
        "extreme", (F.col("max_abs") > EXTREME_ABS).cast("int")
    )


def feature_variance(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Population variance per feature dimension, with a near-constant flag."""
    return (
        df.select(*keys, F.posexplode(column).alias("dim", "v"))
        .groupBy(*keys, "dim")
        .agg(F.var_pop("v").alias("variance"))
        .withColumn("near_constant", (F.col("variance") < NEAR_CONSTANT_VAR).cast("int"))
    )


def scale_class(stats: DataFrame) -> DataFrame:
    low, high = NORMALIZED_STD
    std = F.col("std")
    return stats.withColumn(
        "scale",
        F.when((std >= low) & (std <= high), "NORMALIZED").when(std < RAW_STD, "RAW").otherwise("UNKNOWN"),
    )


def window_quality(windows: DataFrame, keys: Sequence[str], signal: str = "signal", channel: int = 1) -> DataFrame:
    """Per window: defects, overall and one channel's statistics, flat and clipped flags.

    A window without samples, or without the channel, has NULL statistics.
    """
    kernel = arrays.quality_kernel(channel, FLAT_STD, PLATEAU).asNondeterministic()  # evaluated once
    rows = windows.select(*keys, kernel(F.col(signal).cast("array<array<double>>")).alias("_q"))
    return rows.select(*keys, "_q.*")
