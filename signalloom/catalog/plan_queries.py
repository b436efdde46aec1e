"""Whole flows (signal to windows, scores to report) on the given tables."""

from pyspark.sql import functions as F

from signalloom.catalog import views as v
from signalloom.catalog.core import VIEWS, query
from signalloom.catalog.metric_queries import RANKING, RATES, confusion_sql, ranking_sql, split_scores
from signalloom.catalog.signal_queries import ANTIALIAS, BANDPASS, NOTCH, fir_sql
from signalloom.catalog.source_queries import RULES, channels
from signalloom.operators import signals as sg
from signalloom.plans.frozen_report import frozen_report
from signalloom.plans.recording_windows import Recipe, TRACE, recording_windows, usable_recordings

# Two channels per recording: the value, and its square root turned round.
VIEWS["v_raw"] = """
SELECT subject_id, edf_id, 0 AS ch, i, v FROM v_signal UNION ALL SELECT subject_id, edf_id, 1, i, -sqrt(v) FROM v_signal"""
VIEWS["v_halved"] = fir_sql(ANTIALIAS, "a.i % 2 = 0", "a.i // 2", "v_raw", "ch")
VIEWS["v_notched"] = fir_sql(NOTCH, source="v_halved", extra="ch")
VIEWS["v_passed"] = fir_sql(BANDPASS, source="v_notched", extra="ch")
VIEWS["v_normal"] = """
SELECT subject_id, edf_id, ch, i, (v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-8) AS v
FROM v_passed WINDOW w AS (PARTITION BY edf_id, ch)"""

RECIPE = Recipe(window_sec=0.0625, chunk_size=2048)  # 8 samples of 128 Hz, step 4


def raw_chunks(spark, d):
    both = F.inline(
        F.array(
            F.struct(F.lit(0).alias("channel_pos"), F.col("v").alias("x")),
            F.struct(F.lit(1).alias("channel_pos"), (-F.sqrt("v")).alias("x")),
        )
    )
    rows = v.signal(spark, d).select("subject_id", "edf_id", "i", both)
    return sg.to_chunks(rows, TRACE, "i", "x", RECIPE.chunk_size)


@query(
    "flow_recording_windows",
    "subject_id edf_id window_index:l start_sec:6 end_sec:6 label:l n_channels:l n_samples:l ch:l k:l v:5",
    """WITH spread AS (SELECT *, unnest([i // 4 - 1, i // 4]) AS w FROM v_normal),
      whole AS (SELECT *, count(*) OVER (PARTITION BY edf_id, ch, w) AS n FROM spread WHERE w >= 0),
      marks AS (SELECT edf_id, start_sec / 1000 AS s, end_sec / 1000 AS e FROM v_true)
    SELECT subject_id, edf_id, w AS window_index, w / 32.0 AS start_sec, w / 32.0 + 0.0625 AS end_sec,
      CAST(EXISTS (SELECT 1 FROM marks m WHERE m.edf_id = whole.edf_id AND m.s < w / 32.0 + 0.0625 AND m.e > w / 32.0) AS INTEGER)
        AS label, 2 AS n_channels, 8 AS n_samples, ch, i - 4 * w AS k, v FROM whole WHERE n = 8""",
)
def windows_flow(spark, d):
    """Annotation times are scaled to the short recordings."""
    truth = v.truth(spark, d).select(
        "subject_id", "edf_id", (F.col("start_sec") / 1000).alias("start_sec"), (F.col("end_sec") / 1000).alias("end_sec")
    )
    made = recording_windows(raw_chunks(spark, d), truth, "events", RECIPE, channels=2)
    rows = made.select("*", F.posexplode("signal").alias("ch", "x"))
    return rows.select("*", F.posexplode("x").alias("k", "v"))


@query(
    "flow_usable_recordings",
    "subject_id edf_id channels:l",
    "SELECT subject_id, edf_id, n AS channels FROM v_layout WHERE canon = (SELECT string_agg(CASE WHEN trim(name) IN "
    "('T8-P8-0', 'T8-P8-1') THEN 'T8-P8' ELSE trim(name) END, ',' ORDER BY pos) FROM v_target)",
)
def usable_flow(spark, d):
    good, _ = usable_recordings(channels(spark, d), RULES)
    return good.withColumn("channels", F.size("names"))


def report(spark, d):
    scores = split_scores(spark, d)
    return frozen_report(scores.where("split = 'validation'"), scores.where("split = 'test'"))


@query(
    "flow_frozen_report",
    f"{RANKING} {RATES}",
    f"SELECT * FROM ({ranking_sql('v_frozen')}), ({confusion_sql('v_frozen')})",
)
def frozen_flow(spark, d):
    return report(spark, d).overall


@query(
    "flow_frozen_report_by_subject",
    f"subject_id {RANKING} {RATES}",
    f"""SELECT * FROM ({ranking_sql('v_frozen', 'subject_id')}) JOIN ({confusion_sql('v_frozen', 'subject_id')})
    USING (subject_id)""",
)
def frozen_subject_flow(spark, d):
    return report(spark, d).by_subject
