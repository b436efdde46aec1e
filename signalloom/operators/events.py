"""Alarm events: from positive windows to events, matches and event metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from signalloom.operators.intervals import BIN_SEC, merge_intervals, overlapping_pairs, time_bin
from signalloom.operators.ordered import global_index, island_of_rows, islands, linked_islands, local_islands, matched, numbered, ranked
from signalloom.session import settle

KEYS = ["subject_id", "edf_id"]

# One normal window step, and the slack on the gap test.
MIN_GAP_SEC = 2.0
GAP_SLACK_SEC = 1e-6


def _check_gap(max_gap_sec: float) -> None:
    if max_gap_sec < MIN_GAP_SEC:
        raise ValueError("max_gap_sec must be at least the 2-second window step")


def alarm_sessions(predictions: DataFrame, max_gap_sec: float = 4.0, chunk_sec: float = BIN_SEC) -> DataFrame:
    """Join the positive windows of a recording into events (no ids yet).

    A window opens a new event iff it starts more than ``max_gap_sec`` after the
    start of the previous positive window. The detection time is the end of the
    event's first window.
    """
    _check_gap(max_gap_sec)
    positives = predictions.where(F.col("y_pred") == 1).select(*KEYS, "window_index", "start_sec", "end_sec")
    start = F.col("start_sec")
    return islands(
        positives,
        KEYS,
        start,
        start + F.lit(max_gap_sec + GAP_SLACK_SEC),
        time_bin(start, chunk_sec),
        {
            "_first": (F.min, F.struct("start_sec", "window_index", "end_sec")),
            "start_sec": (F.min, "start_sec"),
            "end_sec": (F.max, "end_sec"),
            "n_positive_windows": (F.sum, F.lit(1)),
        },
    ).select(*KEYS, "start_sec", "end_sec", F.col("_first.end_sec").alias("detection_sec"), "n_positive_windows")


def session_of_windows(
    predictions: DataFrame, max_gap_sec: float = 4.0, chunk_sec: float = BIN_SEC
) -> DataFrame:
    """Each positive window with the start of the event it belongs to."""
    _check_gap(max_gap_sec)
    start = F.col("start_sec")
    positives = predictions.where(F.col("y_pred") == 1).select(*KEYS, "window_index", "start_sec", "end_sec")
    return island_of_rows(
        positives, KEYS, start, start + F.lit(max_gap_sec + GAP_SLACK_SEC), time_bin(start, chunk_sec), "session_start"
    )


def with_event_ids(events: DataFrame, chunk_sec: float = BIN_SEC, out: str = "event_id") -> DataFrame:
    """Number all events from 0 in (subject, recording, start) order."""
    return global_index(events, KEYS, ["start_sec"], time_bin(F.col("start_sec"), chunk_sec), out)


def predicted_events(predictions: DataFrame, max_gap_sec: float = 4.0, chunk_sec: float = BIN_SEC) -> DataFrame:
    return with_event_ids(alarm_sessions(predictions, max_gap_sec, chunk_sec), chunk_sec)


@dataclass(frozen=True)
class Swept:
    """Events and merged truth of the scored recordings, and the span that each recording was scored over."""

    events: DataFrame
    truth: DataFrame
    spans: DataFrame


def sweep_events(
    predictions: DataFrame, annotations: DataFrame, max_gap_sec: float = 4.0, chunk_sec: float = BIN_SEC
) -> Swept:
    """Events with ids and merged annotations from one stream of positives and annotations.

    Both are intervals that reach on, a positive to the latest start that continues its event, an
    annotation to its end. So one sweep over ``(recording, chunk)`` forms the islands of both kinds inside a chunk, one pass
    over the chunks' summaries links those that go on, and one sort numbers them all: events over the whole
    table, truth inside its recording. Each step is written and read from there.
    """
    _check_gap(max_gap_sec)
    kind = [*KEYS, "is_truth"]
    start = F.col("start_sec")
    positives = predictions.where(F.col("y_pred") == 1).select(
        *KEYS, F.lit(False).alias("is_truth"), "start_sec", "end_sec", F.col("window_index").cast("long").alias("window_index"),
        (start + F.lit(max_gap_sec + GAP_SLACK_SEC)).alias("reach_sec"),
    )
    marked = annotations.select(
        *KEYS, F.lit(True).alias("is_truth"), "start_sec", "end_sec", F.lit(None).cast("long").alias("window_index"), F.col("end_sec").alias("reach_sec")
    )
    folds = {
        "_first": (F.min, F.struct("start_sec", "window_index", "end_sec")),
        "start_sec": (F.min, "start_sec"),
        "end_sec": (F.max, "end_sec"),
        "n_positive_windows": (F.sum, F.lit(1)),
    }
    stream = positives.unionByName(marked)
    local = settle(local_islands(stream, kind, start, F.col("reach_sec"), time_bin(start, chunk_sec), folds), "event-chunks")
    spans = settle(evaluated_spans(predictions), "event-spans")
    scored = matched(linked_islands(local, kind, folds), spans, KEYS)
    placed = scored.withColumn("detection_sec", F.col("_first.end_sec")).drop("_first")
    numbers = settle(ranked(placed, ["is_truth", *KEYS], ["start_sec"], "true_event_id", "event_id"), "events")
    events = numbers.where("NOT is_truth").select(*KEYS, "start_sec", "end_sec", "detection_sec", "n_positive_windows", "event_id")
    truth = numbers.where("is_truth").select(*KEYS, "start_sec", "end_sec", "true_event_id", "eval_start", "eval_end")
    return Swept(events, truth, spans)


def recordings_of(df: DataFrame) -> DataFrame:
    """Distinct (subject, recording) pairs."""
    return df.select(*KEYS).distinct()


def true_events(annotations: DataFrame, predictions: DataFrame | None = None, chunk_sec: float = BIN_SEC) -> DataFrame:
    """Merged annotations with an id that restarts in each recording.

    With ``predictions``, only recordings that were scored are kept.
    """
    if predictions is not None:
        annotations = matched(annotations, recordings_of(predictions), KEYS, "left_semi")
    merged = merge_intervals(annotations, KEYS, bin_sec=chunk_sec)
    return numbered(merged, KEYS, ["start_sec"], time_bin(F.col("start_sec"), chunk_sec), "true_event_id")


def best_overlaps(events: DataFrame, truth: DataFrame, bin_sec: float = BIN_SEC) -> DataFrame:
    """For each event that overlaps a true interval: the one with the largest
    overlap, then the earliest start, then the smallest id."""
    right = truth.select(
        *KEYS, "true_event_id", F.col("start_sec").alias("true_start"), F.col("end_sec").alias("true_end")
    )
    left = events.select(*KEYS, "event_id", "start_sec", "end_sec")
    rank = F.struct(-F.col("overlap_sec"), "true_start", "true_event_id", "true_end")
    return (
        overlapping_pairs(left, right, KEYS, bin_sec)
        .groupBy(*KEYS, "event_id")
        .agg(F.min(rank).alias("_best"))
        .select(
            *KEYS,
            "event_id",
            F.col("_best.true_event_id").alias("true_event_id"),
            F.col("_best.true_start").alias("true_onset_sec"),
            F.col("_best.true_end").alias("true_end_sec"),
            (-F.col("_best.col1")).alias("overlap_sec"),
        )
    )


def match_events(events: DataFrame, truth: DataFrame, bin_sec: float = BIN_SEC) -> DataFrame:
    """Classify each event as ``detected``, ``duplicate_ictal`` or ``false_alarm``.

    The first event (lowest id) that chose a true interval detects it; later
    ones are duplicates. Latency may be negative.
    """
    chosen = settle(best_overlaps(events, truth, bin_sec), "event-matches")
    # the hits are looked up by their event, which is unique, not by the true interval, which any number of events may meet
    firsts = chosen.groupBy(*KEYS, "true_event_id").agg(F.min("event_id").alias("event_id")).select("event_id", F.lit(True).alias("_hit"))
    hit = F.col("_hit").isNotNull()
    return (
        events.select(*KEYS, "event_id", "detection_sec")
        .join(chosen.drop(*KEYS), "event_id", "left")
        .join(firsts, "event_id", "left")
        .select(
            *KEYS,
            F.col("event_id").alias("pred_event_id"),
            "true_event_id",
            F.when(F.col("true_event_id").isNull(), "false_alarm")
            .when(hit, "detected")
            .otherwise("duplicate_ictal")
            .alias("classification"),
            "detection_sec",
            "true_onset_sec",
            "true_end_sec",
            F.when(hit, F.col("detection_sec") - F.col("true_onset_sec")).alias("latency_sec"),
            F.coalesce("overlap_sec", F.lit(0.0)).alias("overlap_sec"),
        )
    )


def evaluated_spans(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy(*KEYS).agg(F.min("start_sec").alias("eval_start"), F.max("end_sec").alias("eval_end"))


def clip_to_span(truth: DataFrame, spans: DataFrame) -> DataFrame:
    """True intervals cut to the evaluated span of their recording; empty ones dropped."""
    return (
        matched(truth.select(*KEYS, "start_sec", "end_sec"), spans, KEYS)
        .select(
            *KEYS,
            F.greatest("start_sec", "eval_start").alias("start_sec"),
            F.least("end_sec", "eval_end").alias("end_sec"),
        )
        .where(F.col("start_sec") < F.col("end_sec"))
    )


def negative_hours(
    predictions: DataFrame, truth: DataFrame, chunk_sec: float = BIN_SEC, merged: bool = False
) -> DataFrame:
    """Evaluated hours outside true intervals, per recording.

    A recording without any true interval counts in full. ``merged`` says that
    the intervals of a recording do not overlap, as those of :func:`true_events`.
    """
    spans = evaluated_spans(predictions)
    clipped = clip_to_span(truth, spans)
    positive = (
        (clipped if merged else merge_intervals(clipped, KEYS, bin_sec=chunk_sec))
        .groupBy(*KEYS)
        .agg(F.sum(F.col("end_sec") - F.col("start_sec")).alias("_positive"))
    )
    whole = F.greatest(F.col("eval_end") - F.col("eval_start"), F.lit(0.0))
    outside = F.greatest(whole - F.coalesce("_positive", F.lit(0.0)), F.lit(0.0)) / 3600.0
    return matched(spans, positive, KEYS, "left").select(*KEYS, outside.alias("negative_hours"))


def hours_of_swept(swept: Swept) -> DataFrame:
    """Per scored recording: ``negative_hours`` and ``true_events``; the truth carries its recording's span."""
    inside = F.greatest(F.lit(0.0), F.least("end_sec", "eval_end") - F.greatest("start_sec", "eval_start"))
    positive = swept.truth.groupBy(*KEYS).agg(F.sum(inside).alias("_positive"), F.count(F.lit(1)).alias("_n"))
    whole = F.greatest(F.col("eval_end") - F.col("eval_start"), F.lit(0.0))
    outside = F.greatest(whole - F.coalesce("_positive", F.lit(0.0)), F.lit(0.0)) / 3600.0
    found = matched(swept.spans, positive, KEYS, "left")
    return found.select(*KEYS, outside.alias("negative_hours"), F.coalesce("_n", F.lit(0)).alias("true_events"))


def event_metrics(
    predictions: DataFrame, truth: DataFrame, matches: DataFrame, merged: bool = False
) -> DataFrame:
    """One row of event-level figures; NULL where a figure is undefined.

    ``merged`` says that the true intervals of a recording do not overlap.
    """
    hours = negative_hours(predictions, truth, merged=merged).agg(F.sum("negative_hours")).scalar()
    return _figures(matches, F.struct(truth.agg(F.count(F.lit(1))).scalar().alias("n"), hours.alias("h")))


def swept_metrics(swept: Swept, matches: DataFrame) -> DataFrame:
    """:func:`event_metrics` of a sweep."""
    totals = hours_of_swept(swept).agg(F.struct(F.sum("true_events").alias("n"), F.sum("negative_hours").alias("h"))).scalar()
    return _figures(matches, totals)


def _figures(matches: DataFrame, totals: Column) -> DataFrame:
    """``totals`` holds the number ``n`` of true events and the hours ``h``. The median is exact; it counts the distinct latencies of detected events, one at
    most for each true event.
    """

    def count_of(kind: str):
        return F.count_if(F.col("classification") == kind)

    counted = matches.agg(
        F.count(F.lit(1)).alias("predicted_events"),
        count_of("detected").alias("detected_true_events"),
        count_of("duplicate_ictal").alias("duplicate_ictal_events"),
        count_of("false_alarm").alias("false_alarm_events"),
        F.avg("latency_sec").alias("mean_detection_latency_sec"),
        F.percentile("latency_sec", F.lit(0.5)).alias("median_detection_latency_sec"),
    )
    figures = (
        counted.withColumn("_totals", totals)
        .withColumn("total_true_events", F.coalesce("_totals.n", F.lit(0)))
        .withColumn("evaluated_negative_hours", F.coalesce("_totals.h", F.lit(0.0)))
    )
    return figures.select(
        "total_true_events",
        "detected_true_events",
        F.when(F.col("total_true_events") > 0, F.col("detected_true_events") / F.col("total_true_events"))
        .otherwise(0.0)
        .alias("event_sensitivity"),
        "predicted_events",
        "duplicate_ictal_events",
        "false_alarm_events",
        "evaluated_negative_hours",
        F.when(
            F.col("evaluated_negative_hours") > 0, F.col("false_alarm_events") / F.col("evaluated_negative_hours")
        ).alias("false_alarms_per_hour"),
        "mean_detection_latency_sec",
        "median_detection_latency_sec",
    )
