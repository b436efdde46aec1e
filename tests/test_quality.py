import math

import pytest
from pyspark.sql import functions as F

from signalloom.operators import align as al, quality as q
from signalloom.operators.sequences import boundary_violations, sequences

INF, NAN = float("inf"), float("nan")


def window(*channels):
    return [list(map(float, c)) for c in channels]


def test_window_quality_flags(spark):
    wave = [math.sin(i) for i in range(32)]
    rows = [
        ("plain", window(wave, wave)),
        ("flat", window(wave, [2.0] * 8)),
        ("nine", window(wave, wave[:8] + [0.5] * 9 + wave[8:])),
        ("ten", window(wave, wave[:8] + [0.5] * 10 + wave[8:])),
        ("nan", window(wave, [NAN] + wave)),
        ("inf", window([INF] + wave, wave)),
    ]
    df = spark.createDataFrame(rows, "k string, signal array<array<double>>")
    got = {r["k"]: r for r in q.window_quality(df, ["k"]).collect()}
    flags = {k: (r["has_nan"], r["has_inf"], r["is_flat"], r["is_clipped"]) for k, r in got.items()}
    assert flags["plain"] == (0, 0, 0, 0) and flags["flat"] == (0, 0, 1, 0)
    assert flags["nine"] == (0, 0, 0, 0) and flags["ten"] == (0, 0, 0, 1)
    assert flags["nan"][0] == 1 and flags["inf"][1] == 1
    assert got["plain"]["channel_max"] == max(wave)


def test_moments_divide_by_all_values(spark):
    rows = [("s", 0, v) for v in (1.0, 3.0, NAN, INF, -200.0)] + [("s", 1, 5.0)] * 4
    df = spark.createDataFrame(rows, "subject_id string, channel int, v double")
    got = {r["channel"]: r for r in q.with_channel_flags(q.moments(df, ["subject_id", "channel"])).collect()}
    r = got[0]
    assert (r["n"], r["nans"], r["infs"], r["large"]) == (5, 1, 1, 2)
    assert (r["min"], r["max"], r["mean"]) == (-200.0, 3.0, pytest.approx(-196 / 5))
    assert r["std"] == pytest.approx(math.sqrt((1 + 9 + 40000) / 5 - (196 / 5) ** 2))
    assert (got[1]["flat"], got[1]["extreme"], r["extreme"]) == (1, 0, 0)


def test_array_moments_equal_those_of_samples(spark):
    rows = [("a", window([1, 2, NAN], [INF, -200, 5, 5])), ("a", window([4], [])), ("b", window([NAN], [-INF])), ("b", []), ("b", None)]
    df = spark.createDataFrame(rows, "k string, signal array<array<double>>")
    flat = df.select("k", F.posexplode("signal").alias("channel", "_s")).select("k", "channel", F.explode("_s").alias("v"))
    for by_channel, keys in ((True, ["k", "channel"]), (False, ["k"])):
        want = {tuple(r[c] for c in keys): r.asDict() for r in q.moments(flat, keys).collect()}
        got = {tuple(r[c] for c in keys): r.asDict() for r in q.array_moments(df, ["k"], by_channel=by_channel).collect()}
        assert set(got) == set(want)
        for key, row in want.items():
            assert {k: x if x is None or isinstance(x, str) else pytest.approx(x) for k, x in row.items()} == got[key]


def test_quality_of_windows_without_samples(spark):
    df = spark.createDataFrame([("none", None), ("empty", []), ("one", window([3.0] * 12))], "k string, signal array<array<double>>")
    got = {r["k"]: r for r in q.window_quality(df, ["k"]).collect()}
    assert all(got[k]["mean"] is None and got[k]["is_flat"] == 0 for k in ("none", "empty"))
    assert (got["one"]["mean"], got["one"]["std"], got["one"]["channel_std"]) == (3.0, 0.0, None)
    assert (got["one"]["is_flat"], got["one"]["is_clipped"]) == (1, 1)


def test_scale_classes(spark):
    df = spark.createDataFrame([(0.5,), (2.0,), (0.009,), (0.1,), (3.0,)], "std double")
    assert [r["scale"] for r in q.scale_class(df).collect()] == ["NORMALIZED", "NORMALIZED", "RAW", "UNKNOWN", "UNKNOWN"]


def test_near_constant_dimensions(spark):
    df = spark.createDataFrame([([1.0, float(i)],) for i in range(4)], "f array<double>")
    got = {r["dim"]: r["near_constant"] for r in q.feature_variance(df, "f").collect()}
    assert got == {0: 1, 1: 0}


def test_rules_count_every_kind_of_violation(spark):
    rows = [
        ("s", "r", 0, 0.0, 4.0, 0, 1, 0.5),
        ("s", "r", 1, 4.0, 4.0, 2, 1, 0.5),
        ("s", "r", 2, NAN, 6.0, 0, 3, INF),
        ("s", "r", 3, 1.0, 6.0, None, 0, None),
    ]
    df = spark.createDataFrame(
        rows,
        "subject_id string, edf_id string, window_index long, start_sec double, end_sec double, y_true int, y_pred int, y_prob double",
    )
    got = {r["constraint"]: r["violations"] for r in q.violations(df, q.prediction_rules()).collect()}
    # NaN sorts above every number in Spark, so an end of 6 is not after a NaN start.
    assert got == {
        "finite_start": 1, "finite_end": 0, "finite_score": 2, "end_after_start": 2, "binary_truth": 2, "binary_prediction": 1,
    }
    with pytest.raises(ValueError, match="binary_truth: 2"):
        q.require(q.violations(df, q.prediction_rules()))
    with pytest.raises(ValueError, match="label"):
        q.require_columns(df, ["label"])


def test_metadata_rules(spark):
    fields = "dataset_id string, edf_id string, start_sec double, end_sec double, sampling_rate double, n_channels int, n_samples int, label int"
    df = spark.createDataFrame(
        [("d", "r", 0.0, 4.0, 128.0001, 23, 512, 0), (None, "r", 0.0, 4.0, 128.1, 22, 511, 2)], fields
    )
    got = {r["constraint"]: r["violations"] for r in q.violations(df, q.metadata_rules()).collect()}
    assert got["sampling_rate"] == 1 and got["has_dataset"] == 1 and got["n_channels"] == 1 and got["end_after_start"] == 0


def test_keys_and_partners(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 1), ("b", 1), ("b", 2)], "k string, n int")
    assert tuple(q.surplus(df, ["k", "n"]).first()) == (2, 1)
    assert [tuple(r) for r in q.many_partners(df, ["k"], ["n"]).collect()] == [("b", 2)]
    assert tuple(q.bijection_check(df, ["k"], ["n"]).first()) == (3, 1, 1)
    assert tuple(q.surplus(df.distinct(), ["k", "n"]).first()) == (0, 0)


def test_blocks_and_gaps(spark):
    rows = [("s", x, i) for i, x in enumerate("aabbac")] + [("t", x, i) for i, x in enumerate("aab")]
    df = spark.createDataFrame(rows, "s string, x string, i long")
    got = {r["s"]: r["contiguous"] for r in q.block_breaks(df, ["s"], "x", ["i"], F.floor(F.col("i") / 2)).collect()}
    assert got == {"s": 0, "t": 1}
    index = spark.createDataFrame([("a", i) for i in (0, 1, 2)] + [("b", i) for i in (0, 2, 3)], "k string, i long")
    gaps = {r["k"]: r["misplaced"] for r in q.index_gaps(index, ["k"], "i", 2).collect()}
    assert gaps == {"a": 0, "b": 2}


def test_array_health(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],), ([NAN, 1.0],), (None,)], "x array<double>")
    got = {r["constraint"]: r["violations"] for r in q.array_health(df, "x", 2).collect()}
    assert got == {"size": 2, "finite": 2}


WINDOWS = "subject_id string, edf_id string, window_index long, label int"


@pytest.mark.parametrize("chunk", [3, 4096])
def test_sequences_stay_inside_runs(spark, chunk):
    rows = [("s", "a", i, i % 2) for i in range(7)] + [("s", "b", i, 1) for i in (0, 1, 3, 4, 5)] + [("s", "c", 0, 0)]
    made = sequences(spark.createDataFrame(rows, WINDOWS), 3, ["label"], chunk_size=chunk)
    got = {(r["edf_id"], r["start_index"], r["target_index"], r["target"]) for r in made.collect()}
    assert got == {("a", i, i + 2, i % 2) for i in range(5)} | {("b", 3, 5, 1)}
    assert {r["violations"] for r in boundary_violations(made, 3).collect()} == {0}
    for r in made.collect():
        assert [s["window_index"] for s in r["steps"]] == list(range(r["start_index"], r["target_index"] + 1))


def test_sequence_lengths(spark):
    df = spark.createDataFrame([("s", "a", i, 0) for i in range(4)], WINDOWS)
    assert sequences(df, 1, ["label"]).count() == 4
    assert sequences(df, 5, ["label"]).count() == 0
    with pytest.raises(ValueError):
        sequences(df, 0, ["label"])


def test_positions_and_global_ids(spark):
    rows = [("s1", "b", i, 0) for i in range(3)] + [("s1", "a", i, 5) for i in range(2)] + [("s2", "z", 0, 0)]
    df = spark.createDataFrame(rows, "subject_id string, edf_id string, window_index long, start_order long")
    named = al.recording_positions(df)
    seen = al.recording_positions(df, "first_seen")
    assert {(r["edf_id"], r["file_id"], r["first_position"]) for r in named.collect()} == {("a", 0, 0), ("b", 1, 2), ("z", 0, 0)}
    assert {(r["edf_id"], r["file_id"]) for r in seen.collect()} == {("b", 0), ("a", 1), ("z", 0)}
    places = {(r["edf_id"], r["window_index"]): r["position"] for r in al.array_positions(df, named).collect()}
    assert places["b", 2] == 4 and sorted(places.values()) == [0, 0, 1, 2, 3, 4]
    assert {(r["edf_id"], r["global_file_id"]) for r in al.global_file_ids(named).collect()} == {("a", 0), ("b", 1), ("z", 2)}


def test_column_differences_are_null_safe(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 1)], "k int, p string, q int")
    b = spark.createDataFrame([(1, "x", None), (2, None, 2), (4, "z", 1)], "k int, p string, q int")
    got = {r["item"]: r["differences"] for r in al.column_differences(a, b, ["k"], ["p", "q"]).collect()}
    assert got == {"p": 1, "q": 1, "missing_right": 1, "missing_left": 1}
    assert tuple(al.orphans(a, b, ["k"]).first()) == (2, 1, 1)
