"""Summaries (A1-A7, A14-A16, P11, P13, U1) on the given tables."""

from pyspark.sql import functions as F

from signalloom.catalog import views as v
from signalloom.catalog.core import query
from signalloom.operators import metrics as m, summarize as s

SUMMARY = "subjects:l recordings:l windows:l positives:l negatives:l positive_pct:6"


def summary_sql(groups: str, source: str = "v_win") -> str:
    return f"""SELECT {groups}, count(DISTINCT subject_id) AS subjects, count(DISTINCT edf_id) AS recordings, count(*) AS windows,
      sum(label) AS positives, count(*) - sum(label) AS negatives, 100.0 * sum(label) / count(*) AS positive_pct
    FROM {source} GROUP BY {groups}"""


def split_windows(spark, d):
    return v.windows(spark, d).withColumn("split", v.split_of())


SPLIT_WIN = "(SELECT w.*, s.split FROM v_win w JOIN v_split s ON w.subject_id = s.subject_id)"


@query("a1_subject_summary", "subject_id " + SUMMARY.replace("subjects:l ", ""), summary_sql("subject_id"))
def a1(spark, d):
    return s.window_summary(v.windows(spark, d), ["subject_id"])


@query(
    "a2_recording_summary",
    "subject_id edf_id windows:l positives:l",
    "SELECT subject_id, edf_id, count(*) AS windows, sum(label) AS positives FROM v_win GROUP BY 1, 2",
)
def a2(spark, d):
    return s.by_recording(v.windows(spark, d))


@query(
    "a2_recordings_with_positives",
    "subject_id edf_id windows:l positives:l",
    "SELECT subject_id, edf_id, count(*) AS windows, sum(label) AS positives FROM v_win GROUP BY 1, 2 HAVING sum(label) > 0",
)
def a2_positive(spark, d):
    return s.recordings_with_positives(v.windows(spark, d))


@query("a3_split_summary", "split " + SUMMARY, summary_sql("split", SPLIT_WIN))
def a3(spark, d):
    return s.window_summary(split_windows(spark, d), ["split"])


@query(
    "a4_dataset_totals",
    "split subject_id windows:l positives:l positive_pct:6",
    f"""SELECT coalesce(split, 'all') AS split, coalesce(subject_id, 'all') AS subject_id, count(*) AS windows,
      sum(label) AS positives, 100.0 * sum(label) / count(*) AS positive_pct
    FROM {SPLIT_WIN} GROUP BY ROLLUP (split, subject_id)""",
)
def a4(spark, d):
    return s.totals(split_windows(spark, d))


@query("a5_value_counts", "event_type n:l", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def a5(spark, d):
    return s.value_counts(v.table(spark, d, "events"), "event_type")


@query(
    "a6_label_domain",
    "value:l n:l allowed:l",
    "SELECT label AS value, count(*) AS n, CAST(label IN (0, 1) AS INTEGER) AS allowed FROM embeddings GROUP BY label",
)
def a6(spark, d):
    return s.domain_check(v.table(spark, d, "embeddings"), "label", [0, 1])


@query(
    "a7_class_balance",
    "subject_id negatives:l positives:l imbalance:6",
    """SELECT subject_id, count(*) FILTER (label = 0) AS negatives, count(*) FILTER (label = 1) AS positives,
      count(*) FILTER (label = 0) / nullif(count(*) FILTER (label = 1), 0) AS imbalance FROM v_win GROUP BY 1""",
)
def a7(spark, d):
    return s.class_balance(v.windows(spark, d), groups=["subject_id"])


@query(
    "a14_run_summary",
    "model subject_id runs:l mean:6 std:6",
    """SELECT model, CASE WHEN grouping(subject_id) = 1 THEN 'all' ELSE CAST(subject_id AS VARCHAR) END AS subject_id,
      count(*) AS runs, avg(metric) AS mean, CASE WHEN count(*) > 1 THEN stddev_pop(metric) END AS std
    FROM v_runs GROUP BY GROUPING SETS ((model), (model, subject_id))""",
)
def a14(spark, d):
    return s.run_summary(v.runs(spark, d))


@query(
    "a15_metric_pivot",
    "model O:6 F:6",
    """SELECT model, avg(metric) FILTER (seed = 'O') AS O, avg(metric) FILTER (seed = 'F') AS F FROM v_runs GROUP BY model""",
)
def a15(spark, d):
    return s.side_by_side(v.runs(spark, d), "model", "seed", ["O", "F"], "metric")


SUBJECTS = [f"s{i:02d}" for i in range(v.SUBJECTS)]


@query(
    "a15_metrics_by_subject",
    "metric " + " ".join(f"{name}:6" for name in SUBJECTS),
    f"""SELECT metric, {', '.join(f"max(value) FILTER (subject_id = '{name}') AS {name}" for name in SUBJECTS)} FROM (
      SELECT subject_id, 'windows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM v_scored GROUP BY 1
      UNION ALL SELECT subject_id, 'positives', CAST(sum(y_true) AS DOUBLE) FROM v_scored GROUP BY 1
      UNION ALL SELECT subject_id, 'precision',
        coalesce(count(*) FILTER (y_true = 1 AND y_pred = 1) / nullif(count(*) FILTER (y_pred = 1), 0), 0) FROM v_scored GROUP BY 1)
    GROUP BY metric""",
)
def a15_subject(spark, d):
    scores = v.scored(spark, d)
    counted = m.confusion(scores, ["subject_id"]).select(
        "subject_id",
        (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("windows"),
        (F.col("tp") + F.col("fn")).alias("positives"),
        "precision",
    )
    rows = s.metrics_as_rows(counted, ["subject_id"], ["windows", "positives", "precision"])
    return s.side_by_side(rows, "metric", "subject_id", SUBJECTS, "value")


KIND_SQL = """SELECT subject_id, edf_id, max(label) AS has_positive,
  CASE WHEN max(label) = 1 THEN 'seizure file' ELSE 'clean file' END AS filetype FROM v_win GROUP BY 1, 2"""


@query("a16_recording_has_positive", "subject_id edf_id has_positive:l", KIND_SQL)
def a16(spark, d):
    return s.recording_kind(v.windows(spark, d))


@query("p13_filetype", "subject_id edf_id filetype", KIND_SQL)
def p13(spark, d):
    return s.recording_kind(v.windows(spark, d))


@query(
    "p11_predicate_filters",
    "subject_id edf_id window_index:l",
    """SELECT w.subject_id, w.edf_id, w.window_index FROM v_win w JOIN v_split s ON w.subject_id = s.subject_id
    WHERE w.label = 1 AND s.split IN ('validation', 'test')""",
)
def p11(spark, d):
    return split_windows(spark, d).where((F.col("label") == 1) & F.col("split").isin("validation", "test"))


@query(
    "u1_union_metadata",
    "split windows:l positives:l",
    f"""SELECT split, count(*) AS windows, sum(label) AS positives FROM {SPLIT_WIN} GROUP BY split""",
)
def u1(spark, d):
    rows = split_windows(spark, d)
    parts = [rows.where(F.col("split") == name) for name in ("train", "validation", "test")]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return union.groupBy("split").agg(F.count(F.lit(1)).alias("windows"), F.sum("label").alias("positives"))
