import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from signalloom.operators.events import alarm_sessions
from signalloom.operators.sequences import sequences
from signalloom.streaming import run, twins

BASE = dt.datetime(2024, 1, 1)
SCHEMA = "subject_id string, edf_id string, window_index long, start_sec double, end_sec double, y_pred int, v double, ts timestamp"


def rows(seed=0, n=120):
    rng = random.Random(seed)
    out = []
    for rec in ("a", "b"):
        for i in range(n):
            if rec == "b" and i in (20, 21, 60):
                continue
            start = 2.0 * i
            out.append(("s", rec, i, start, start + 4.0, int(rng.random() < 0.3), rng.random(), BASE + dt.timedelta(seconds=start)))
    return out


def stream_of(spark, path, batches):
    df = None
    for batch in batches:
        df = spark.createDataFrame(batch, SCHEMA).coalesce(1)
        df.write.mode("append").parquet(path)
    run.write_flush(df, path, y_pred=1)
    return run.files_as_stream(spark, path, df, maxFilesPerTrigger=1)


def shuffled_batches(seed=1, count=4):
    data = rows()
    random.Random(seed).shuffle(data)
    return [data[i::count] for i in range(count)]


def real(df):
    return df.where(F.col("subject_id") != run.FLUSH)


def test_windows_equal_batch_when_nothing_is_too_late(spark, tmp_path):
    stream = stream_of(spark, str(tmp_path / "in"), shuffled_batches())
    got = {tuple(r) for r in real(run.drained(twins.sliding_features(stream, delay="1 hour"), "w")).drop("mean", "power").collect()}
    batch = spark.createDataFrame(rows(), SCHEMA)
    assert got == {tuple(r) for r in twins.sliding_features(batch).drop("mean", "power").collect()}
    full = twins.sliding_features(batch, expected=2)
    assert full.count() < twins.sliding_features(batch).count() and {r["n"] for r in full.collect()} == {2}


def test_sessions_equal_the_chunked_operator(spark, tmp_path):
    stream = stream_of(spark, str(tmp_path / "in"), shuffled_batches(2))
    cols = ["edf_id", "start_sec", "end_sec", "detection_sec", "n_positive_windows"]
    epoch = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp()

    def plain(df):
        return {tuple(r[c] - (epoch if c.endswith("_sec") and r[c] > 1e9 else 0) if c != "edf_id" else r[c] for c in cols) for r in df.collect()}

    streamed = plain(real(run.drained(twins.alarm_sessions(stream, delay="1 hour"), "s")))
    batch = spark.createDataFrame(rows(), SCHEMA)
    assert streamed == plain(alarm_sessions(batch, 4.0, 30.0)) == plain(twins.alarm_sessions(batch))


def test_a_gap_apart_is_one_session(spark):
    at = [0.0, 4.0, 8.000001]
    data = [("s", "a", i, t, t + 4, 1, 0.0, BASE + dt.timedelta(seconds=t)) for i, t in enumerate(at)]
    got = twins.alarm_sessions(spark.createDataFrame(data, SCHEMA)).orderBy("start_sec").collect()
    assert [r["n_positive_windows"] for r in got] == [2, 1]


def test_hourly_rate(spark, tmp_path):
    stream = stream_of(spark, str(tmp_path / "in"), shuffled_batches(3))
    got = {tuple(r) for r in real(run.drained(twins.alarm_rate(stream, length="1 minute", delay="1 hour"), "r")).collect()}
    assert got == {tuple(r) for r in twins.alarm_rate(spark.createDataFrame(rows(), SCHEMA), length="1 minute").collect()}


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    data = rows()
    late = [r for r in data if r[1] == "a" and r[2] < 5]
    rest = [r for r in data if r not in late]
    stream = stream_of(spark, str(tmp_path / "in"), [rest, rest[-1:], late])
    got = real(run.drained(twins.alarm_rate(stream, length="10 seconds", delay="5 seconds"), "late"))
    # Two batches (the second repeats a row) move the watermark on before the late rows arrive.
    assert got.agg(F.sum("n")).first()[0] == len(rest) + 1
    first = got.where(F.col("start_sec") == F.lit(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())).first()
    assert first["n"] == 5  # recording b only


@pytest.mark.parametrize("size", [8, 4096])
def test_stateful_sequences_equal_batch(spark, tmp_path, size):
    batches = shuffled_batches(4)
    stream = stream_of(spark, str(tmp_path / "in"), batches).where("window_index IS NOT NULL")
    made = run.drained(twins.causal_sequences(stream, 5, "v", size=size), "seq")
    got = {(r["edf_id"], r["start_index"], r["target_index"], tuple(r["values"])) for r in made.collect()}
    batch = sequences(spark.createDataFrame(rows(), SCHEMA), 5, ["v"], label="y_pred")
    want = {(r["edf_id"], r["start_index"], r["target_index"], tuple(s["v"] for s in r["steps"])) for r in batch.collect()}
    assert got == want and made.count() == len(want)


def test_state_forgets_what_is_past_the_slack(spark, tmp_path):
    data = [r for r in rows() if r[1] == "a"]
    early, rest = data[:1], data[1:]
    stream = stream_of(spark, str(tmp_path / "in"), [rest, early]).where("window_index IS NOT NULL")
    made = run.drained(twins.causal_sequences(stream, 5, "v", slack=10), "slack")
    assert made.agg(F.min("start_index")).first()[0] == 1
    late = made.where("late").collect()
    assert [(r["edf_id"], r["target_index"], r["values"]) for r in late] == [("a", 0, None)]


def test_state_is_cleared_by_event_time(spark, tmp_path):
    """The closing row moves the watermark past every chunk; nothing stays."""
    data = sorted(rows(), key=lambda r: r[-1])
    stream = stream_of(spark, str(tmp_path / "in"), [data[:120], data[120:]]).where("window_index IS NOT NULL OR subject_id = '~flush'")
    stream = stream.withColumn("window_index", F.coalesce("window_index", F.lit(0)))
    progress = []
    made = real(run.drained(twins.causal_sequences(stream, 5, "v", delay="5 seconds", hold_sec=60), "cleared", progress))
    batch = sequences(spark.createDataFrame(rows(), SCHEMA), 5, ["v"], label="y_pred")
    assert made.where("NOT late").count() == batch.count()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert max(held) > 5 and held[-1] <= 4  # the closing row's own chunk


def test_slices_come_from_all_partitions_and_rows_without_a_time_are_refused(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    slices = list(run.time_slices(df, slices=3))
    ends = [(*s.agg(F.min("ts"), F.max("ts"), F.count(F.lit(1))).first(), s.select(F.input_file_name()).distinct().count()) for s in slices]
    assert sum(e[2] for e in ends) == df.count() and all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
    assert all(e[3] == 4 for e in ends)
    with pytest.raises(ValueError, match="1 rows have no time"):
        list(run.time_slices(df.union(df.limit(1).withColumn("ts", F.lit(None).cast("timestamp")))))


def test_late_rows_are_returned(spark):
    """Every row comes out, in its window or late; what was on time equals the plain operator on those rows."""
    df = spark.createDataFrame(rows(n=300), SCHEMA)
    early = df.where("window_index < 20 AND window_index % 4 = 1")
    rest = df.where("NOT (window_index < 20 AND window_index % 4 = 1)")
    progress = []
    made = run.replayed(
        rest, lambda s: twins.alarm_rate_with_late(s, length_sec=60, delay="10 seconds"), "late", late=early, progress=progress
    )
    made = real(made).cache()
    late, on_time = made.where("late"), made.where("NOT late").drop("late")
    assert late.agg(F.sum("n")).first()[0] == early.count() and late.agg(F.sum("alarms")).first()[0] == early.agg(F.sum("y_pred")).first()[0]
    want = twins.alarm_rate(rest, length="1 minute")
    assert sorted(map(tuple, on_time.collect())) == sorted(map(tuple, want.collect()))
    assert len({p["id"] for p in progress}) == 1  # one query, started again for each slice


def test_settings_come_back_after_an_error(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    with pytest.raises(RuntimeError):
        with run.settings(spark, [(key, "3")]):
            assert spark.conf.get(key) == "3"
            raise RuntimeError
    assert spark.conf.get(key) == before
