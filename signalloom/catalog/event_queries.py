"""Event operators (W1-W5, J3, J4, J11, R13-R15) on the given tables."""

from signalloom.catalog import views as v
from signalloom.catalog.core import VIEWS, query
from signalloom.operators import events as ev
from signalloom.operators.intervals import label_windows, merge_intervals
from signalloom.plans.event_report import event_report
from signalloom.session import settle

VIEWS["v_session"] = """
SELECT subject_id, edf_id, min(start_sec) AS start_sec, max(end_sec) AS end_sec,
  min_by(end_sec, window_index) AS detection_sec, count(*) AS n_positive_windows
FROM (SELECT *, sum(fresh) OVER (PARTITION BY subject_id, edf_id ORDER BY start_sec ROWS UNBOUNDED PRECEDING) AS sid
      FROM (SELECT *, CASE WHEN start_sec - lag(start_sec) OVER (PARTITION BY subject_id, edf_id ORDER BY start_sec)
                                <= 4.000001 THEN 0 ELSE 1 END AS fresh
            FROM v_pred WHERE y_pred = 1))
GROUP BY subject_id, edf_id, sid"""

VIEWS["v_event"] = """
SELECT *, row_number() OVER (ORDER BY subject_id, edf_id, start_sec) - 1 AS event_id FROM v_session"""

VIEWS["v_best"] = """
SELECT * FROM (
  SELECT e.subject_id, e.edf_id, e.event_id, e.detection_sec, t.true_event_id, t.start_sec AS true_onset_sec,
    t.end_sec AS true_end_sec, least(e.end_sec, t.end_sec) - greatest(e.start_sec, t.start_sec) AS overlap_sec,
    row_number() OVER (PARTITION BY e.event_id ORDER BY
      least(e.end_sec, t.end_sec) - greatest(e.start_sec, t.start_sec) DESC, t.start_sec, t.true_event_id) AS rk
  FROM v_event e JOIN v_true t ON e.subject_id = t.subject_id AND e.edf_id = t.edf_id
    AND e.start_sec < t.end_sec AND t.start_sec < e.end_sec)
WHERE rk = 1"""

VIEWS["v_match"] = """
SELECT e.subject_id, e.edf_id, e.event_id AS pred_event_id, b.true_event_id,
  CASE WHEN b.event_id IS NULL THEN 'false_alarm' WHEN b.nth = 1 THEN 'detected' ELSE 'duplicate_ictal' END AS classification,
  e.detection_sec, b.true_onset_sec, b.true_end_sec,
  CASE WHEN b.nth = 1 THEN e.detection_sec - b.true_onset_sec END AS latency_sec, coalesce(b.overlap_sec, 0) AS overlap_sec
FROM v_event e LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY subject_id, edf_id, true_event_id ORDER BY event_id) AS nth
  FROM v_best) b ON e.event_id = b.event_id"""

VIEWS["v_span"] = """
SELECT subject_id, edf_id, min(start_sec) AS eval_start, max(end_sec) AS eval_end FROM v_pred GROUP BY 1, 2"""

VIEWS["v_clip"] = """
SELECT * FROM (SELECT t.subject_id, t.edf_id, greatest(t.start_sec, s.eval_start) AS start_sec, least(t.end_sec, s.eval_end) AS end_sec
  FROM v_true t JOIN v_span s ON t.subject_id = s.subject_id AND t.edf_id = s.edf_id) WHERE start_sec < end_sec"""

VIEWS["v_hours"] = """
SELECT s.subject_id, s.edf_id, greatest(s.eval_end - s.eval_start - coalesce(c.pos, 0), 0) / 3600.0 AS negative_hours
FROM v_span s LEFT JOIN (SELECT subject_id, edf_id, sum(end_sec - start_sec) AS pos FROM v_clip GROUP BY 1, 2) c
  ON s.subject_id = c.subject_id AND s.edf_id = c.edf_id"""

EVENT = "subject_id edf_id start_sec:6 end_sec:6 detection_sec:6 n_positive_windows:l"
MATCH = (
    "subject_id edf_id pred_event_id:l true_event_id:l classification detection_sec:6 true_onset_sec:6 "
    "true_end_sec:6 latency_sec:6 overlap_sec:6"
)


def report(spark, d):
    """The report of a prediction table as it would lie on disk: the windows are numbered and written once."""
    slim = v.predictions(spark, d).select(*ev.KEYS, "window_index", "start_sec", "end_sec", "y_true", "y_pred")
    pred = settle(slim, "predictions")
    return event_report(pred, v.marks_of(pred))


@query(
    "w1_sessionize_positives",
    "subject_id edf_id window_index:l session_start:6",
    """SELECT subject_id, edf_id, window_index, min(start_sec) OVER (PARTITION BY subject_id, edf_id, sid) AS session_start
    FROM (SELECT *, sum(fresh) OVER (PARTITION BY subject_id, edf_id ORDER BY start_sec ROWS UNBOUNDED PRECEDING) AS sid
      FROM (SELECT *, CASE WHEN start_sec - lag(start_sec) OVER (PARTITION BY subject_id, edf_id ORDER BY start_sec)
                                <= 4.000001 THEN 0 ELSE 1 END AS fresh FROM v_pred WHERE y_pred = 1))""",
)
def w1(spark, d):
    return ev.session_of_windows(v.predictions(spark, d))


@query("w2_event_aggregate", EVENT, "SELECT * FROM v_session")
def w2(spark, d):
    return ev.alarm_sessions(v.predictions(spark, d))


@query("w3_global_event_id", EVENT + " event_id:l", "SELECT * FROM v_event")
def w3(spark, d):
    return ev.predicted_events(v.predictions(spark, d))


@query("w4_first_hit_classification", MATCH, "SELECT * FROM v_match")
def w4(spark, d):
    return report(spark, d).matches


@query(
    "j4_event_match_join",
    "subject_id edf_id event_id:l true_event_id:l true_onset_sec:6 true_end_sec:6 overlap_sec:6",
    "SELECT * FROM v_best",
)
def j4(spark, d):
    found = report(spark, d)
    return ev.best_overlaps(found.events, found.truth)


@query(
    "w5_merge_intervals",
    "subject_id edf_id start_sec:6 end_sec:6",
    "SELECT subject_id, edf_id, start_sec, end_sec FROM v_true",
)
def w5(spark, d):
    return merge_intervals(v.marks(spark, d), ev.KEYS)


@query("j11_clip_join", "subject_id edf_id start_sec:6 end_sec:6", "SELECT * FROM v_clip")
def j11(spark, d):
    pred = v.predictions(spark, d)
    return ev.clip_to_span(ev.true_events(v.marks_of(pred)), ev.evaluated_spans(pred))


@query("r14_negative_hours", "subject_id edf_id negative_hours:6", "SELECT * FROM v_hours")
def r14(spark, d):
    pred = v.predictions(spark, d)
    return ev.negative_hours(pred, ev.true_events(v.marks_of(pred)))


@query(
    "r15_detection_latency",
    "subject_id edf_id pred_event_id:l latency_sec:6",
    "SELECT * FROM v_match WHERE classification = 'detected'",
)
def r15(spark, d):
    return report(spark, d).matches.where("classification = 'detected'")


@query(
    "r13_event_metrics",
    "total_true_events:l detected_true_events:l event_sensitivity:6 predicted_events:l duplicate_ictal_events:l "
    "false_alarm_events:l evaluated_negative_hours:4 false_alarms_per_hour:4 mean_detection_latency_sec:4 "
    "median_detection_latency_sec:6",
    """SELECT *, detected_true_events / total_true_events AS event_sensitivity,
      false_alarm_events / evaluated_negative_hours AS false_alarms_per_hour
    FROM (SELECT count(*) AS predicted_events, count(*) FILTER (classification = 'detected') AS detected_true_events,
        count(*) FILTER (classification = 'duplicate_ictal') AS duplicate_ictal_events,
        count(*) FILTER (classification = 'false_alarm') AS false_alarm_events,
        avg(latency_sec) AS mean_detection_latency_sec, median(latency_sec) AS median_detection_latency_sec FROM v_match),
      (SELECT count(*) AS total_true_events FROM v_true),
      (SELECT sum(negative_hours) AS evaluated_negative_hours FROM v_hours)""",
)
def r13(spark, d):
    return report(spark, d).metrics


@query(
    "entry_subject_alarms",
    "subject_id events:l detected:l duplicates:l false_alarms:l mean_latency_sec:4",
    """SELECT subject_id, count(*) AS events, count(*) FILTER (classification = 'detected') AS detected,
      count(*) FILTER (classification = 'duplicate_ictal') AS duplicates,
      count(*) FILTER (classification = 'false_alarm') AS false_alarms, avg(latency_sec) AS mean_latency_sec
    FROM v_match GROUP BY subject_id""",
)
def subject_alarms(spark, d):
    return report(spark, d).by_subject


LABEL_SQL = """SELECT w.subject_id, w.edf_id, w.window_index, CAST(EXISTS (SELECT 1 FROM v_true t
  WHERE t.subject_id = w.subject_id AND t.edf_id = w.edf_id AND t.start_sec < w.end_sec AND t.end_sec > w.start_sec)
  AS INTEGER) AS label FROM v_pred w"""


@query("g6_label_windows", "subject_id edf_id window_index:l label:l", LABEL_SQL)
def g6(spark, d):
    slim = v.predictions(spark, d).select("subject_id", "edf_id", "window_index", "start_sec", "end_sec")
    return label_windows(slim, v.marks(spark, d), ev.KEYS, max_window_sec=4.0)


@query("j3_interval_semi_join", "subject_id edf_id window_index:l", f"SELECT * FROM ({LABEL_SQL}) WHERE label = 1")
def j3(spark, d):
    slim = v.predictions(spark, d).select("subject_id", "edf_id", "window_index", "start_sec", "end_sec")
    return label_windows(slim, v.marks(spark, d), ev.KEYS, max_window_sec=4.0).where("label = 1")


@query("u4_distinct_recordings", "subject_id edf_id", "SELECT DISTINCT subject_id, edf_id FROM v_pred")
def u4(spark, d):
    return ev.recordings_of(v.scored(spark, d))
