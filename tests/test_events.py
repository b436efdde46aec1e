"""Event matching and metrics on known rows."""

import pytest
from pyspark.sql import functions as F

from signalloom.operators.events import event_metrics, match_events, negative_hours
from signalloom.plans.event_report import event_report

EVENT = "subject_id string, edf_id string, event_id long, start_sec double, end_sec double, detection_sec double"
TRUE = "subject_id string, edf_id string, true_event_id long, start_sec double, end_sec double"
PRED = "subject_id string, edf_id string, window_index long, start_sec double, end_sec double, y_pred int"

# Published example: recording, start, end, detection, class, latency, overlap.
EXAMPLE = [
    ("chb01_15", 1732, 1748, 1736, "detected", 4, 16),
    ("chb01_15", 1754, 1772, 1758, "duplicate_ictal", None, 18),
    ("chb01_15", 1794, 1798, 1798, "false_alarm", None, 0),
    ("chb01_18", 1720, 1812, 1724, "detected", 4, 90),
    ("chb01_42", 1922, 1928, 1926, "false_alarm", None, 0),
    ("chb02_26", 1362, 1368, 1366, "false_alarm", None, 0),
    ("chb03_28", 1658, 1662, 1662, "false_alarm", None, 0),
    ("chb03_34", 1980, 1990, 1984, "detected", 2, 8),
    ("chb03_34", 2000, 2010, 2004, "duplicate_ictal", None, 10),
    ("chb03_34", 2016, 2034, 2020, "duplicate_ictal", None, 13),
    ("chb04_06", 3064, 3070, 3068, "false_alarm", None, 0),
    ("chb05_22", 2358, 2466, 2362, "detected", 14, 107),
]
INTERVALS = [("chb01_15", 1732, 1772), ("chb01_18", 1720, 1810), ("chb03_34", 1982, 2029), ("chb05_22", 2348, 2465)]


@pytest.fixture(scope="module")
def example(spark):
    events = spark.createDataFrame(
        [(r[0][:5], r[0], i, float(r[1]), float(r[2]), float(r[3])) for i, r in enumerate(EXAMPLE)], EVENT
    )
    truth = spark.createDataFrame([(r[0][:5], r[0], 0, float(r[1]), float(r[2])) for r in INTERVALS], TRUE)
    return events, truth


@pytest.mark.parametrize("bin_sec", [10.0, 3600.0])
def test_example_matches(example, bin_sec):
    got = match_events(*example, bin_sec).orderBy("pred_event_id").collect()
    assert [(r["edf_id"], r["classification"], r["latency_sec"], r["overlap_sec"]) for r in got] == [
        (r[0], r[4], r[5], r[6]) for r in EXAMPLE
    ]


def test_example_metrics(spark, example):
    events, truth = example
    hour = spark.createDataFrame([("chb01", "chb01_15", 0, 0.0, 3600.0, 0)], PRED)
    m = event_metrics(hour, truth, match_events(events, truth)).first()
    assert (m["total_true_events"], m["detected_true_events"], m["predicted_events"]) == (4, 4, 12)
    assert (m["duplicate_ictal_events"], m["false_alarm_events"], m["event_sensitivity"]) == (3, 5, 1.0)
    assert (m["mean_detection_latency_sec"], m["median_detection_latency_sec"]) == (6.0, 4.0)
    assert m["evaluated_negative_hours"] == pytest.approx((3600 - 40) / 3600)
    assert m["false_alarms_per_hour"] == pytest.approx(5 * 3600 / 3560)


def test_ties_prefer_the_earlier_interval_and_latency_may_be_negative(spark):
    events = spark.createDataFrame([("s", "r", 0, 10.0, 30.0, 12.0)], EVENT)
    truth = spark.createDataFrame([("s", "r", 0, 15.0, 20.0), ("s", "r", 1, 25.0, 35.0)], TRUE)
    row = match_events(events, truth).first()
    assert (row["true_event_id"], row["overlap_sec"], row["latency_sec"]) == (0, 5.0, -3.0)


def test_no_true_events_at_all(spark):
    pred = spark.createDataFrame([("s", "r", i, 2.0 * i, 2.0 * i + 4, int(i < 2)) for i in range(10)], PRED)
    none = spark.createDataFrame([], "subject_id string, edf_id string, start_sec double, end_sec double")
    m = event_report(pred, none).metrics.first()
    assert (m["total_true_events"], m["event_sensitivity"], m["false_alarm_events"]) == (0, 0.0, 1)
    assert m["mean_detection_latency_sec"] is None and m["median_detection_latency_sec"] is None
    assert m["evaluated_negative_hours"] == pytest.approx(22 / 3600)


def test_no_alarms_at_all(spark):
    pred = spark.createDataFrame([("s", "r", 0, 0.0, 4.0, 0)], PRED)
    marks = spark.createDataFrame([("s", "r", 1.0, 9.0)], "subject_id string, edf_id string, start_sec double, end_sec double")
    report = event_report(pred, marks)
    m = report.metrics.first()
    assert (m["predicted_events"], m["detected_true_events"], m["total_true_events"]) == (0, 0, 1)
    assert m["evaluated_negative_hours"] == pytest.approx(1 / 3600)
    assert report.by_subject.count() == 0


def test_hours_of_overlapping_truth_and_unscored_recordings(spark):
    pred = spark.createDataFrame([("s", "r", 0, 0.0, 100.0, 0)], PRED)
    truth = spark.createDataFrame([("s", "r", 0, 10.0, 30.0), ("s", "r", 1, 20.0, 40.0), ("s", "x", 0, 0.0, 9.0)], TRUE)
    hours = negative_hours(pred, truth).select(F.round(F.col("negative_hours") * 3600, 6)).collect()
    assert [r[0] for r in hours] == [70.0]
    marks = truth.select("subject_id", "edf_id", "start_sec", "end_sec")
    assert event_report(pred, marks).truth.count() == 1
