"""Streaming operators (T1-T5) and their batch twins on the given tables."""

from pyspark.sql import functions as F

from signalloom.catalog import views as v
from signalloom.catalog.core import query
from signalloom.session import settle
from signalloom.streaming import run, twins

FEATURE = "subject_id edf_id start_sec:6 end_sec:6 n:l mean:6 min:6 max:6 power:4"
FEATURE_SQL = """SELECT subject_id, edf_id, 1704067200 + w * 7200.0 AS start_sec, 1704067200 + w * 7200.0 + 14400 AS end_sec,
  count(*) AS n, avg(v) AS mean, min(v) AS min, max(v) AS max, sum(v * v) AS power
FROM (SELECT *, unnest([CAST(floor(t_sec / 7200.0) AS BIGINT) - 1, CAST(floor(t_sec / 7200.0) AS BIGINT)]) AS w FROM v_signal)
GROUP BY subject_id, edf_id, w"""


def alarms(spark, d):
    return v.events(spark, d).withColumn("y_pred", (F.col("v") >= 60).cast("int"))


DELAY = "2 days"  # far below the thirty days of the events


def real(table):
    return table.where(F.col("subject_id") != run.FLUSH)


@query("t1_sliding_windows_batch", FEATURE, FEATURE_SQL)
def t1(spark, d):
    return twins.sliding_features(v.events(spark, d), length="4 hours", step="2 hours")


@query("t1_t4_sliding_windows_stream", FEATURE, FEATURE_SQL)
def t1_stream(spark, d):
    made = lambda stream: twins.sliding_features(stream, length="4 hours", step="2 hours", delay=DELAY)
    return real(run.replayed(v.events(spark, d), made, "t1"))


RATE = "subject_id start_sec:6 end_sec:6 n:l alarms:l"
RATE_SQL = """SELECT subject_id, 1704067200 + h * 3600.0 AS start_sec, 1704067200 + h * 3600.0 + 3600 AS end_sec, count(*) AS n,
  sum(CAST(v >= 60 AS INTEGER)) AS alarms FROM (SELECT *, floor(t_sec / 3600) AS h FROM v_signal) GROUP BY subject_id, h"""


@query("t2_alarm_rate_batch", RATE, RATE_SQL)
def t2(spark, d):
    return twins.alarm_rate(alarms(spark, d))


@query("t2_alarm_rate_stream", RATE, RATE_SQL)
def t2_stream(spark, d):
    return real(run.replayed(alarms(spark, d), lambda stream: twins.alarm_rate(stream, delay=DELAY), "t2"))


SESSION = "subject_id edf_id start_sec:6 end_sec:6 detection_sec:6 n_positive_windows:l"
SESSION_SQL = """SELECT subject_id, edf_id, 1704067200 + min(t_sec) AS start_sec, 1704067200 + max(t_sec) + 4 AS end_sec,
  1704067200 + min(t_sec) + 4 AS detection_sec, count(*) AS n_positive_windows
FROM (SELECT *, sum(fresh) OVER (PARTITION BY edf_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM (SELECT *,
  CASE WHEN ts - lag(ts) OVER (PARTITION BY edf_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh
  FROM v_signal WHERE v >= 60)) GROUP BY subject_id, edf_id, sid"""


@query("t3_alarm_sessions_batch", SESSION, SESSION_SQL)
def t3(spark, d):
    return twins.alarm_sessions(alarms(spark, d), gap="6 hours")


@query("t3_alarm_sessions_stream", SESSION, SESSION_SQL)
def t3_stream(spark, d):
    made = lambda stream: twins.alarm_sessions(stream, gap="6 hours", delay=DELAY)
    return real(run.replayed(alarms(spark, d), made, "t3", y_pred=1))


@query(
    "t5_causal_sequences_stream",
    "subject_id edf_id start_index:l target_index:l total:6",
    """SELECT subject_id, edf_id, i - 4 AS start_index, i AS target_index, sum(v) OVER (PARTITION BY edf_id ORDER BY i ROWS 4 PRECEDING)
    AS total FROM v_signal QUALIFY i >= 4""",
)
def t5(spark, d):
    windows = v.signal(spark, d).select("subject_id", "edf_id", F.col("i").alias("window_index"), "v", "ts", "event_id")
    with run.settings(spark, twins.STATE_STORE):
        made = run.replayed(
            windows, lambda stream: twins.causal_sequences(stream.where("window_index IS NOT NULL"), 5, "v", delay=DELAY, hold_sec=40 * 86_400), "t5"
        )
    made = made.where("NOT late")
    return made.withColumn("total", F.aggregate("values", F.lit(0.0), lambda a, x: a + x))


@query(
    "t4_late_rows_stream",
    RATE + " n_late:l",
    """SELECT subject_id, 1704067200 + h * 3600.0 AS start_sec, 1704067200 + h * 3600.0 + 3600 AS end_sec, count(*) FILTER (NOT late) AS n,
      count(*) FILTER (v >= 60 AND NOT late) AS alarms, count(*) FILTER (late) AS n_late
    FROM (SELECT *, floor(t_sec / 3600) AS h, i % 10 = 0 AND t_sec < 864000 AS late FROM v_signal) GROUP BY subject_id, h""",
)
def t4_stream(spark, d):
    """Some rows of the first ten days come after the thirtieth; they are counted by themselves."""
    rows = settle(v.signal(spark, d).withColumn("y_pred", (F.col("v") >= 60).cast("int")), "t4-all")
    held_back = (F.col("i") % 10 == 0) & (F.col("t_sec") < 864_000)
    with run.settings(spark, twins.STATE_STORE):
        made = run.replayed(
            rows.where(~held_back), lambda stream: twins.alarm_rate_with_late(stream, delay=DELAY), "t4", late=rows.where(held_back)
        )
    counted = lambda column, late: F.sum(F.when(F.col("late") == late, F.col(column)).otherwise(0))
    return real(made).groupBy("subject_id", "start_sec", "end_sec").agg(
        counted("n", False).alias("n"), counted("alarms", False).alias("alarms"), counted("n", True).alias("n_late")
    )
