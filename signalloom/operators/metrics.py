"""Window-level evaluation of scores against binary labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from signalloom.operators.ordered import score_ladder, with_steps_reached

# Numerators over 10,000 of the threshold grids.
HUNDREDTHS = range(100, 10_000, 100)
THOUSANDTHS = range(9_910, 10_001, 10)
TEN_THOUSANDTHS = range(9_991, 10_001)
GRIDS = {
    "hundredths": [HUNDREDTHS],
    "fine": [HUNDREDTHS, THOUSANDTHS],
    "finest": [HUNDREDTHS, THOUSANDTHS, TEN_THOUSANDTHS],
}


def threshold_grid(name: str = "finest") -> list[float]:
    """Sorted distinct thresholds; 1.0 belongs to the two finer grids."""
    return [n / 10_000 for n in sorted(set().union(*GRIDS[name]))]


def linear_grid(low: float = 0.01, high: float = 0.5, points: int = 50) -> list[float]:
    step = (high - low) / (points - 1)
    return [low + step * i for i in range(points - 1)] + [high]


def with_rates(df: DataFrame) -> DataFrame:
    """Add precision, recall and F1 to tp/fp/fn columns; 0 where undefined."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))

    def ratio(num: Column, den: Column) -> Column:
        return F.when(den > 0, num / den).otherwise(0.0)

    return (
        df.withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))
    )


def confusion(df: DataFrame, groups: Sequence[str] = (), truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    t, p = F.col(truth) == 1, F.col(pred) == 1
    counted = df.groupBy(*groups).agg(
        F.count_if(~t & ~p).alias("tn"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
        F.count_if(t & p).alias("tp"),
    )
    return with_rates(counted)


def threshold_sweep(
    df: DataFrame,
    grid: Sequence[float],
    groups: Sequence[str] = (),
    truth: str = "y_true",
    score: str = "y_prob",
) -> DataFrame:
    """Confusion counts and rates at each threshold (``score >= threshold``).

    One scan: each score is counted at the highest threshold it reaches, and the
    few counts are summed from the top. No score-threshold pair is ever formed.
    """
    top = len(grid)
    steps = F.array(*[F.lit(float(t)) for t in grid])
    placed = with_steps_reached(df.select(*groups, truth, score), F.col(score).cast("double"), steps, top, "_step")
    at = placed.groupBy(*groups, "_step").agg(
        F.coalesce(F.sum(F.col(truth).cast("long")), F.lit(0)).alias("_p"), F.count(F.lit(1)).alias("_n")
    )
    # One row per group: a vector of counts per step, at most len(grid) + 1 long.
    held = at.groupBy(*groups).agg(
        F.map_from_entries(F.collect_list(F.struct("_step", F.struct("_p", "_n")))).alias("_at"),
        F.coalesce(F.sum("_p"), F.lit(0)).alias("_all_p"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("_all_n"),
    )
    rows = held.select(*groups, "_at", "_all_p", "_all_n", F.posexplode(steps))
    per_step = rows.select(
        *groups,
        F.col("col").alias("threshold"),
        F.coalesce(F.col("_at")[F.col("pos") + 1]["_p"], F.lit(0)).alias("_p"),
        F.coalesce(F.col("_at")[F.col("pos") + 1]["_n"], F.lit(0)).alias("_n"),
        "_all_p",
        "_all_n",
    )
    keyed = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(top))
    w = keyed.orderBy(F.col("threshold").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = per_step.withColumn("tp", F.sum("_p").over(w)).withColumn("_sel", F.sum("_n").over(w))
    counted = summed.select(
        *groups,
        "threshold",
        "tp",
        (F.col("_sel") - F.col("tp")).alias("fp"),
        (F.col("_all_p") - F.col("tp")).alias("fn"),
        (F.col("_all_n") - F.col("_all_p") - (F.col("_sel") - F.col("tp"))).alias("tn"),
    )
    return with_rates(counted)


def best_threshold(sweep: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """The row of highest F1, the lowest threshold among equals."""
    rest = [c for c in sweep.columns if c not in groups]
    best = sweep.groupBy(*groups).agg(
        F.max_by(F.struct(*rest), F.struct("f1", -F.col("threshold"))).alias("_best")
    )
    return best.select(*groups, "_best.*")


def apply_frozen_threshold(df: DataFrame, chosen: DataFrame, score: str = "y_prob", out: str = "y_pred") -> DataFrame:
    """Apply a threshold chosen elsewhere (a one-row table) as a scalar."""
    return df.withColumn("_th", chosen.select("threshold").scalar()).withColumn(
        out, (F.col(score) >= F.col("_th")).cast("int")
    ).drop("_th")


def curve_points(
    df: DataFrame, groups: Sequence[str] = (), truth: str = "y_true", score: str = "y_prob"
) -> DataFrame:
    """ROC and precision-recall values at each distinct score."""
    tp, sel = F.col("positives_ge"), F.col("n_ge")
    pos, neg = F.col("positives_all"), F.col("n_all") - F.col("positives_all")
    return score_ladder(df, groups, score, truth).select(
        *groups,
        score,
        F.when(pos > 0, tp / pos).alias("tpr"),
        F.when(neg > 0, (sel - tp) / neg).alias("fpr"),
        (tp / sel).alias("precision"),
    )


def ranking_metrics(
    df: DataFrame, groups: Sequence[str] = (), truth: str = "y_true", score: str = "y_prob"
) -> DataFrame:
    """ROC-AUC (ties count half), average precision, Brier score and prevalence.

    AUC and AP are NULL for a group with one class only. Everything comes from
    the counts per distinct score, so no task sees all rows of a group.
    """
    pos, tp, sel = F.col("positives"), F.col("positives_ge"), F.col("n_ge")
    neg = F.col("n") - pos
    p = F.col(score).cast("double")
    summed = score_ladder(df, groups, score, truth).groupBy(*groups).agg(
        F.max("n_all").alias("n"),
        F.max("positives_all").alias("positives"),
        F.sum(neg * (tp - pos / 2)).alias("_area"),
        F.sum(pos * tp / sel).alias("_ap"),
        F.sum(pos * (p - 1) * (p - 1) + neg * p * p).alias("_sq"),
    )
    P, N = F.col("positives"), F.col("n") - F.col("positives")
    both = (P > 0) & (N > 0)
    return summed.select(
        *groups,
        "n",
        "positives",
        F.when(both, F.col("_area") / (P * N)).alias("roc_auc"),
        F.when(both, F.col("_ap") / P).alias("pr_auc"),
        (F.col("_sq") / F.col("n")).alias("brier"),
        (P / F.col("n")).alias("prevalence"),
    )


def inner_edges(bins: int) -> list[float]:
    """Edges between uniform bins of the unit interval."""
    return [i * (1.0 / bins) for i in range(1, bins)]


def calibration(df: DataFrame, bins: int = 10, truth: str = "y_true", score: str = "y_prob") -> DataFrame:
    """Mean score and positive share per uniform bin; empty bins are absent.

    A score equal to an edge belongs to the bin below it, which is decided by
    comparison with the edges themselves.
    """
    slot = F.lit(0).cast("long")
    for edge in inner_edges(bins):
        slot = slot + (F.col(score) > F.lit(edge)).cast("long")
    return df.groupBy(slot.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(truth).alias("positive_share")
    )


def classification_report(df: DataFrame, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Precision, recall, F1 and support for class 0 and class 1."""
    one = confusion(df, (), truth, pred)
    classes = F.array(
        F.struct(F.lit(0).alias("label"), F.col("tn").alias("tp"), F.col("fn").alias("fp"), F.col("fp").alias("fn")),
        F.struct(F.lit(1).alias("label"), F.col("tp").alias("tp"), F.col("fp").alias("fp"), F.col("fn").alias("fn")),
    )
    return with_rates(one.select(F.inline(classes))).select(
        "label", "precision", "recall", "f1", (F.col("tp") + F.col("fn")).alias("support")
    )


def select_best_run(runs: DataFrame, metric: str = "pr_auc", order: str = "run", groups: Sequence[str] = ()) -> DataFrame:
    """The run with the highest metric; the first one in ``order`` among equals."""
    rest = [c for c in runs.columns if c not in groups]
    best = runs.where(F.col(metric).isNotNull()).groupBy(*groups).agg(
        F.min_by(F.struct(*rest), F.struct(-F.col(metric), F.col(order))).alias("_best")
    )
    return best.select(*groups, "_best.*")
