"""The given tables seen as recordings, windows, scores and annotations.

Each view exists twice: as a DataFrame function and as the SQL text of the same
name in ``VIEWS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from signalloom.catalog.core import VIEWS
from signalloom.operators.events import true_events
from signalloom.operators.ordered import numbered

EPOCH_US = 1_704_067_200_000_000  # 2024-01-01, the start of every recording
SUBJECTS = 15
WINDOW_STEP, WINDOW_LEN = 7200.0, 14400.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a wall-clock time, whatever the session's time zone."""
    start = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'").cast("timestamp")
    return F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(start) + EPOCH_US


def subject_of(user: str) -> Column:
    return F.concat(F.lit("s"), F.lpad((F.col(user) % SUBJECTS).cast("string"), 2, "0"))


VIEWS["v_signal"] = """
SELECT 's' || lpad(CAST(user_id % 15 AS VARCHAR), 2, '0') AS subject_id, 'r' || user_id AS edf_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
  (epoch_us(ts) - 1704067200000000) / 1e6 AS t_sec, value AS v, event_type, ts
FROM events"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        subject_of("user_id").alias("subject_id"),
        F.concat(F.lit("r"), F.col("user_id")).alias("edf_id"),
        ((micros("ts") - EPOCH_US) / 1e6).alias("t_sec"),
        F.col("value").alias("v"),
        "event_type",
        "event_id",
        F.timestamp_micros(micros("ts")).alias("ts"),
    )


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample per event; a sample's position counts within its recording."""
    part = F.floor(F.col("t_sec") / 600)
    return numbered(events(spark, sf_dir), ["subject_id", "edf_id"], ["t_sec", "event_id"], part, "i")


VIEWS["v_pred"] = """
SELECT 'events' AS dataset_id, subject_id, edf_id, i AS window_index, 2.0 * i AS start_sec, 2.0 * i + 4.0 AS end_sec,
  CAST(event_type = 'error' AS INTEGER) AS y_true, CAST(v >= 60 AS INTEGER) AS y_pred, v / 1000 AS y_prob
FROM v_signal"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal(spark, sf_dir).select(
        F.lit("events").alias("dataset_id"),
        "subject_id",
        "edf_id",
        F.col("i").alias("window_index"),
        (2.0 * F.col("i")).alias("start_sec"),
        (2.0 * F.col("i") + 4.0).alias("end_sec"),
        (F.col("event_type") == "error").cast("int").alias("y_true"),
        (F.col("v") >= 60).cast("int").alias("y_pred"),
        (F.col("v") / 1000).alias("y_prob"),
    )


VIEWS["v_scored"] = """
SELECT 's' || lpad(CAST(user_id % 15 AS VARCHAR), 2, '0') AS subject_id, 'r' || user_id AS edf_id,
  CAST(event_type = 'error' AS INTEGER) AS y_true, CAST(value >= 60 AS INTEGER) AS y_pred, value / 1000 AS y_prob
FROM events"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and labels without positions (no shuffle needed to build it)."""
    return events(spark, sf_dir).select(
        "subject_id",
        "edf_id",
        (F.col("event_type") == "error").cast("int").alias("y_true"),
        (F.col("v") >= 60).cast("int").alias("y_pred"),
        (F.col("v") / 1000).alias("y_prob"),
    )


VIEWS["v_marks"] = """
SELECT subject_id, edf_id, start_sec, start_sec + 6.0 AS end_sec FROM v_pred WHERE y_true = 1"""


def marks_of(pred: DataFrame) -> DataFrame:
    """Raw annotations: six seconds from each window that is truly positive."""
    return pred.where("y_true = 1").select(
        "subject_id", "edf_id", "start_sec", (F.col("start_sec") + 6.0).alias("end_sec")
    )


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks_of(predictions(spark, sf_dir))


VIEWS["v_true"] = """
SELECT subject_id, edf_id, row_number() OVER (PARTITION BY subject_id, edf_id ORDER BY min(start_sec)) - 1 AS true_event_id,
  min(start_sec) AS start_sec, max(end_sec) AS end_sec
FROM (SELECT *, sum(CASE WHEN reach IS NULL OR start_sec > reach THEN 1 ELSE 0 END)
        OVER (PARTITION BY subject_id, edf_id ORDER BY start_sec ROWS UNBOUNDED PRECEDING) AS isle
      FROM (SELECT *, max(end_sec) OVER (PARTITION BY subject_id, edf_id ORDER BY start_sec
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v_marks))
GROUP BY subject_id, edf_id, isle"""


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return true_events(marks(spark, sf_dir))


VIEWS["v_win"] = """
SELECT 'events' AS dataset_id, subject_id, edf_id, w AS window_index, w * 7200.0 AS start_sec, w * 7200.0 + 14400.0 AS end_sec,
  max(CAST(event_type = 'error' AS INTEGER)) AS label, count(*) AS n, sum(v) AS v_sum, min(v) AS v_min, max(v) AS v_max
FROM (SELECT *, unnest([CAST(floor(t_sec / 7200.0) AS BIGINT) - 1, CAST(floor(t_sec / 7200.0) AS BIGINT)]) AS w FROM v_signal)
WHERE w >= 0
GROUP BY subject_id, edf_id, w"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-hour windows every two hours; only windows that hold an event exist."""
    newest = F.floor(F.col("t_sec") / WINDOW_STEP).cast("long")
    hits = events(spark, sf_dir).withColumn("window_index", F.explode(F.array(newest - 1, newest)))
    return (
        hits.where("window_index >= 0")
        .groupBy("subject_id", "edf_id", "window_index")
        .agg(
            F.max((F.col("event_type") == "error").cast("int")).alias("label"),
            F.count(F.lit(1)).alias("n"),
            F.sum("v").alias("v_sum"),
            F.min("v").alias("v_min"),
            F.max("v").alias("v_max"),
        )
        .select(
            F.lit("events").alias("dataset_id"),
            "subject_id",
            "edf_id",
            "window_index",
            (F.col("window_index") * WINDOW_STEP).alias("start_sec"),
            (F.col("window_index") * WINDOW_STEP + WINDOW_LEN).alias("end_sec"),
            "label",
            "n",
            "v_sum",
            "v_min",
            "v_max",
        )
    )


VIEWS["v_arr"] = """
SELECT vec_id AS window_id, 's' || lpad(CAST(vec_id % 15 AS VARCHAR), 2, '0') AS subject_id, label,
  CAST(embedding AS DOUBLE[]) AS x FROM embeddings"""


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 64-sample window per vector."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("window_id"),
        subject_of("vec_id").alias("subject_id"),
        "label",
        F.col("embedding").cast("array<double>").alias("x"),
    )


VIEWS["v_sample"] = """
SELECT window_id, subject_id, label, s.pos // 16 AS ch, s.pos % 16 AS k, s.v AS v
FROM (SELECT window_id, subject_id, label, unnest([{'pos': p, 'v': x[p + 1]} FOR p IN range(64)]) AS s FROM v_arr)"""


def channel_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows as four channels of 16 samples."""
    return arrays(spark, sf_dir).withColumn(
        "signal", F.expr("transform(sequence(0, 3), c -> slice(x, c * 16 + 1, 16))")
    )


VIEWS["v_split"] = """
SELECT subject_id, CASE WHEN CAST(substr(subject_id, 2) AS INTEGER) < 10 THEN 'train'
  WHEN CAST(substr(subject_id, 2) AS INTEGER) < 12 THEN 'validation' ELSE 'test' END AS split
FROM (SELECT DISTINCT 's' || lpad(CAST(user_id % 15 AS VARCHAR), 2, '0') AS subject_id FROM events)"""


def split_of(subject: str = "subject_id") -> Column:
    number = F.substring(subject, 2, 9).cast("int")
    return F.when(number < 10, "train").when(number < 12, "validation").otherwise("test")


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    subjects = events(spark, sf_dir).select("subject_id").distinct()
    return subjects.withColumn("split", split_of())


VIEWS["v_cls"] = """
SELECT l.doc_id, d.source AS subject_id, l.quality AS y_true, 1 - l.toxic AS y_pred,
  CAST(d.n_chars AS DOUBLE) / (SELECT max(n_chars) FROM documents) AS y_prob
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels with text length as the score, grouped by source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    longest = docs.agg(F.max("n_chars").cast("double")).scalar()
    return (
        table(spark, sf_dir, "labels")
        .join(docs, "doc_id")
        .withColumn("_longest", longest)
        .select(
            "doc_id",
            F.col("source").alias("subject_id"),
            F.col("quality").alias("y_true"),
            (1 - F.col("toxic")).alias("y_pred"),
            (F.col("n_chars") / F.col("_longest")).alias("y_prob"),
        )
    )


VIEWS["v_runs"] = """
SELECT l_returnflag AS model, l_linestatus AS seed, l_suppkey % 3 AS subject_id, avg(l_discount) AS metric
FROM lineitem GROUP BY 1, 2, 3"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric per model, seed and subject."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_returnflag").alias("model"),
            F.col("l_linestatus").alias("seed"),
            (F.col("l_suppkey") % 3).alias("subject_id"),
        )
        .agg(F.avg("l_discount").alias("metric"))
    )
