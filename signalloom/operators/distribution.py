"""Distributions of a value: exact percentiles, moments, exceedance counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from signalloom.operators.ordered import matched, score_ladder

# The percentiles and cutoffs reported for scores.
PERCENTILES = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
CUTOFFS = (0.01, 0.05, 0.10, 0.20, 0.30, 0.40, 0.50)


def exact_percentiles(df: DataFrame, groups: Sequence[str], value: str, points: Mapping[str, float]) -> DataFrame:
    """Exact linear-interpolated percentiles (NumPy's default rule) per group.

    The built-in ``percentile`` keeps every distinct value of a group in one
    task; this ranks distinct values with the two-level running count instead.
    """
    steps = score_ladder(df.where(F.col(value).isNotNull()), groups, value)
    below = F.col("n_all") - F.col("n_ge")
    covers = steps.withColumn("_lo", below).withColumn("_hi", below + F.col("n"))

    def at(rank):
        return F.max(F.when((rank >= F.col("_lo")) & (rank < F.col("_hi")), F.col(value)))

    picks = []
    for name, q in points.items():
        spot = F.lit(float(q)) * (F.col("n_all") - 1)
        picks += [
            at(F.floor(spot)).alias(f"_lo_{name}"),
            at(F.ceil(spot)).alias(f"_up_{name}"),
            F.max(spot - F.floor(spot)).alias(f"_part_{name}"),
        ]
    found = covers.groupBy(*groups).agg(*picks)
    return found.select(
        *groups,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_up_{n}") - F.col(f"_lo_{n}")) * F.col(f"_part_{n}")).alias(n)
            for n in points
        ],
    )


def describe(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Count, min, max, mean, population std and the reported percentiles."""
    basic = df.groupBy(*groups).agg(
        F.count(value).alias("n"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
    )
    points = exact_percentiles(df, groups, value, PERCENTILES)
    if not groups:
        return basic.withColumn("_p", points.select(F.struct(*PERCENTILES)).scalar()).select("*", "_p.*").drop("_p")
    return matched(basic, points, list(groups), "left")


def exceedances(
    df: DataFrame, value: str = "y_prob", label: str = "y_true", cutoffs: Sequence[float] = CUTOFFS
) -> DataFrame:
    """Rows and positives strictly above each cutoff, and the share of all positives."""
    positive = F.col(label) == 1
    pairs = []
    for c in cutoffs:
        over = F.col(value) > c
        pairs.append(
            F.struct(
                F.lit(float(c)).alias("cutoff"),
                F.count_if(over).alias("n_above"),
                F.count_if(over & positive).alias("positives_above"),
            )
        )
    one = df.agg(F.array(*pairs).alias("_rows"), F.count_if(positive).alias("_all"))
    return one.select(F.explode("_rows").alias("r"), "_all").select(
        "r.*", F.when(F.col("_all") > 0, 100.0 * F.col("r.positives_above") / F.col("_all")).alias("positives_pct")
    )
