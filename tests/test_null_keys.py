"""One rule for NULL keys: NULL equals NULL, and no operator loses a row over it."""

import pytest
from pyspark.sql import functions as F

from signalloom.operators import distribution as dist, events as ev, metrics as m, quality as q, splits
from signalloom.operators.intervals import label_windows, merge_intervals, overlapping_pairs
from signalloom.operators.ordered import global_index, numbered, previous_value

REC = "subject_id string, edf_id string"


def test_numbering_keeps_rows_without_a_key(spark):
    df = spark.createDataFrame([("a", 0), ("a", 9), (None, 1), (None, 8), (None, 15)], "k string, t long")
    chunk = F.floor(F.col("t") / 4)
    assert sorted((r.k or "", r.t, r.n) for r in numbered(df, ["k"], ["t"], chunk, "n").collect()) == [
        ("", 1, 0), ("", 8, 1), ("", 15, 2), ("a", 0, 0), ("a", 9, 1)]
    got = global_index(df.withColumn("s", F.lit("x")), ["k", "s"], ["t"], chunk, "n").orderBy("n").collect()
    assert [(r.k, r.t) for r in got] == [(None, 1), (None, 8), (None, 15), ("a", 0), ("a", 9)]
    assert [r.n for r in got] == list(range(5))
    before = previous_value(df.withColumn("x", F.col("t")), ["k"], "x", ["t"], chunk, "p")
    assert {(r.t, r.p) for r in before.where("k IS NULL").collect()} == {(1, None), (8, 1), (15, 8)}


def test_intervals_and_sessions_of_a_null_recording(spark):
    rows = [("s", None, 0.0, 5.0), ("s", None, 4.0, 9.0), ("s", "r", 1.0, 2.0)]
    spans = spark.createDataFrame(rows, f"{REC}, start_sec double, end_sec double")
    want = [("s", None, 0.0, 9.0), ("s", "r", 1.0, 2.0)]
    for bin_sec in (2.0, 100.0):
        merged = merge_intervals(spans, ev.KEYS, bin_sec=bin_sec).collect()
        assert sorted(map(tuple, merged), key=str) == sorted(want, key=str)
    right = spans.select("subject_id", "edf_id", F.col("start_sec").alias("true_start"), F.col("end_sec").alias("true_end"))
    assert overlapping_pairs(spans, right, ev.KEYS).where("edf_id IS NULL").count() == 4
    labelled = label_windows(spans, spans, ev.KEYS, 10.0).collect()
    assert [r.label for r in labelled] == [1, 1, 1]
    pred = spark.createDataFrame([("s", None, i, 2.0 * i, 2.0 * i + 4, 1, 1) for i in range(3)],
                                 f"{REC}, window_index long, start_sec double, end_sec double, y_pred int, y_true int")
    assert ev.session_of_windows(pred).count() == 3
    matches = ev.match_events(ev.predicted_events(pred), ev.true_events(spans, pred)).collect()
    assert [(r.edf_id, r.classification) for r in matches] == [(None, "detected")]
    assert ev.negative_hours(pred, ev.true_events(spans)).first().negative_hours == 0.0


def test_metrics_of_a_null_group(spark):
    rows = [(s, i % 2, (i % 7) / 7) for s in ("a", None) for i in range(20)]
    df = spark.createDataFrame(rows, "subject_id string, y_true int, y_prob double")
    ranked = {r.subject_id: r for r in m.ranking_metrics(df, ["subject_id"]).collect()}
    assert set(ranked) == {"a", None} and ranked["a"][1:] == ranked[None][1:]
    described = {r.subject_id: r for r in dist.describe(df, ["subject_id"], "y_prob").collect()}
    assert set(described) == {"a", None} and described["a"][1:] == described[None][1:]
    assert m.threshold_sweep(df, [0.5], ["subject_id"]).count() == 2
    assert m.curve_points(df, ["subject_id"]).where("subject_id IS NULL").count() == 7


def test_an_empty_sweep_counts_nothing(spark):
    df = spark.createDataFrame([], "y_true int, y_prob double")
    for r in m.threshold_sweep(df, [0.1, 0.9]).collect():
        assert (r.tp, r.fp, r.fn, r.tn) == (0, 0, 0, 0)


def test_blocks_of_null_values(spark):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(["x", None, "x", None])], "k string, t long, v string")
    one = q.block_breaks(df, ["k"], "v", ["t"], F.floor(F.col("t") / 3)).first()
    assert (one.blocks, one["values"], one.contiguous) == (4, 2, 0)
    two = q.block_breaks(df.withColumn("v", F.lit(None).cast("string")), ["k"], "v", ["t"], F.floor(F.col("t") / 3)).first()
    assert (two.blocks, two["values"], two.contiguous) == (1, 1, 1)


def test_resampling_needs_both_classes(spark):
    df = spark.createDataFrame([(i, 0) for i in range(20)], "id long, label int")
    with pytest.raises(Exception, match="only one class"):
        splits.balanced_resample(df, ["id"]).collect()
    both = df.unionByName(spark.createDataFrame([(99, 1)], df.schema))
    assert splits.balanced_resample(both, ["id"]).count() == 21


def test_windows_beyond_the_bound_are_refused(spark):
    w = spark.createDataFrame([("s", "r", 3000.0, 9000.0)], f"{REC}, start_sec double, end_sec double")
    a = spark.createDataFrame([("s", "r", 8000.0, 8100.0)], w.schema)
    with pytest.raises(Exception, match="max_window_sec"):
        label_windows(w, a, ev.KEYS, 4.0).collect()
    assert label_windows(w, a, ev.KEYS, 6000.0).first().label == 1


def test_sessions_refuse_a_gap_below_the_step(spark):
    with pytest.raises(ValueError):
        ev.session_of_windows(spark.range(0), 1.0)
