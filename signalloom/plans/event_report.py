"""Alarm evaluation from scored windows and raw annotations to a report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from signalloom.operators.events import Swept, match_events, sweep_events, swept_metrics
from signalloom.session import settle


@dataclass(frozen=True)
class EventReport:
    swept: Swept
    matches: DataFrame

    @property
    def events(self) -> DataFrame:
        return self.swept.events

    @property
    def truth(self) -> DataFrame:
        return self.swept.truth.drop("eval_start", "eval_end")

    @property
    def metrics(self) -> DataFrame:
        """One row of event-level figures."""
        return swept_metrics(self.swept, self.matches)

    @property
    def by_subject(self) -> DataFrame:
        def count_of(kind: str):
            return F.count_if(F.col("classification") == kind)

        return self.matches.groupBy("subject_id").agg(
            F.count(F.lit(1)).alias("events"),
            count_of("detected").alias("detected"),
            count_of("duplicate_ictal").alias("duplicates"),
            count_of("false_alarm").alias("false_alarms"),
            F.avg("latency_sec").alias("mean_latency_sec"),
        )


def event_report(predictions: DataFrame, annotations: DataFrame, max_gap_sec: float = 4.0) -> EventReport:
    """Events, merged truth and matches of one prediction table.

    The predictions are read twice (positives, spans) and the annotations once. What is found, which is far smaller, is
    written to the shared scratch folder, and every result reads it from there.
    """
    swept = sweep_events(predictions, annotations, max_gap_sec)
    return EventReport(swept, settle(match_events(swept.events, swept.truth), "matches"))
