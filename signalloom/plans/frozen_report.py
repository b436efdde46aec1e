"""Choose a threshold on validation scores, then judge the test scores once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from signalloom.operators import metrics as m
from signalloom.operators.ordered import matched


@dataclass(frozen=True)
class FrozenReport:
    sweep: DataFrame
    chosen: DataFrame
    overall: DataFrame
    by_subject: DataFrame


def _judged(scores: DataFrame, groups: Sequence[str]) -> DataFrame:
    ranked = m.ranking_metrics(scores, groups)
    counted = m.confusion(scores, groups)
    if groups:
        return matched(ranked, counted, list(groups))
    fields = ("tn", "fp", "fn", "tp", "precision", "recall", "f1")
    one = counted.select(F.struct(*fields).alias("c")).scalar()
    return ranked.withColumn("_c", one).select("*", *[F.col(f"_c.{f}").alias(f) for f in fields]).drop("_c")


def frozen_report(validation: DataFrame, test: DataFrame, grid: str = "finest") -> FrozenReport:
    """The threshold with the best validation F1 is applied to the test scores unchanged."""
    sweep = m.threshold_sweep(validation, m.threshold_grid(grid))
    chosen = m.best_threshold(sweep)
    judged = m.apply_frozen_threshold(test, chosen)
    return FrozenReport(sweep, chosen, _judged(judged, []), _judged(judged, ["subject_id"]))
