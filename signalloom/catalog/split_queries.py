"""Splits, sampling and set operations (K2, K4-K8, W10, J8, U2, U3, U6) on the given tables."""

from pyspark.sql import functions as F

from signalloom.catalog import views as v
from signalloom.catalog.core import VIEWS, query
from signalloom.operators import splits as sl
from signalloom.operators.ordered import first_per_group
from signalloom.operators.summarize import recording_kind

KEY = ["subject_id", "edf_id", "window_index"]
DIGEST = "md5('42|' || subject_id || '|' || edf_id || '|' || window_index)"


@query(
    "k4_stratified_sample",
    "subject_id label:l edf_id window_index:l",
    f"SELECT * FROM v_win QUALIFY row_number() OVER (PARTITION BY subject_id, label ORDER BY {DIGEST}) <= 5",
)
def k4(spark, d):
    return sl.fixed_sample(v.windows(spark, d), ["subject_id", "label"], KEY, 5)


@query(
    "k5_class_weights",
    "subject_id edf_id window_index:l label:l weight:9",
    "SELECT subject_id, edf_id, window_index, label, 1.0 / count(*) OVER (PARTITION BY label) AS weight FROM v_win",
)
def k5(spark, d):
    return sl.class_weights(v.windows(spark, d))


@query(
    "k5_balanced_resample",
    "draw_subject_id draw_edf_id draw_window_index:l label:l subject_id edf_id window_index:l",
    f"""WITH h AS (SELECT *, {DIGEST} AS h FROM v_win),
      placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, subject_id, edf_id, window_index) - 1 AS place FROM h),
      n AS (SELECT label, count(*) AS n FROM v_win GROUP BY 1),
      draws AS (SELECT subject_id, edf_id, window_index, CAST(substr(h, 1, 1) >= '8' AS INTEGER) AS label,
        CAST('0x' || substr(h, 2, 12) AS BIGINT) AS pick FROM h)
    SELECT d.subject_id AS draw_subject_id, d.edf_id AS draw_edf_id, d.window_index AS draw_window_index, d.label, p.subject_id,
      p.edf_id, p.window_index FROM draws d JOIN n ON d.label = n.label JOIN placed p ON p.label = d.label AND p.place = d.pick % n.n""",
)
def k5_draw(spark, d):
    return sl.balanced_resample(v.windows(spark, d).select(*KEY, "label"), KEY)


@query(
    "k6_file_level_split",
    "subject_id edf_id has_positive:l split",
    """SELECT subject_id, edf_id, has_positive, CASE WHEN place < n * 70 // 100 THEN 'train' WHEN place < n * 85 // 100
      THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY has_positive ORDER BY
      md5('42|' || subject_id || '|' || edf_id)) - 1 AS place, count(*) OVER (PARTITION BY has_positive) AS n FROM
      (SELECT subject_id, edf_id, max(CAST(quiet AS INTEGER)) AS has_positive FROM (SELECT *, count(*) OVER (PARTITION BY edf_id)
        % 2 = 0 AS quiet FROM v_pred) GROUP BY 1, 2))""",
)
def k6(spark, d):
    """Recordings with an even number of windows stand for those with a positive."""
    counted = v.scored(spark, d).groupBy("subject_id", "edf_id").agg(F.count(F.lit(1)).alias("n"))
    kinds = counted.select("subject_id", "edf_id", (F.col("n") % 2 == 0).cast("int").alias("has_positive"))
    return sl.file_split(kinds, ["subject_id", "edf_id"], "has_positive")


@query(
    "k7_subject_split_checks",
    "constraint violations:l",
    """SELECT 'overlap' AS "constraint", count(*) - count(DISTINCT subject_id) AS violations FROM v_split
    UNION ALL SELECT 'missing', (SELECT count(*) FROM v_split WHERE subject_id NOT IN (SELECT subject_id FROM v_scored))
    UNION ALL SELECT 'unassigned', (SELECT count(DISTINCT subject_id) FROM v_scored
      WHERE subject_id NOT IN (SELECT subject_id FROM v_split))
    UNION ALL SELECT 'empty_split', 3 - count(DISTINCT split) FROM v_split""",
)
def k7(spark, d):
    return sl.split_problems(v.splits(spark, d), v.scored(spark, d))


@query(
    "k8_subject_ordinals",
    "subject_id split ordinal:l overall:l",
    """SELECT *, row_number() OVER (PARTITION BY split ORDER BY subject_id) - 1 AS ordinal, row_number() OVER (ORDER BY
      CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END, subject_id) - 1 AS overall FROM v_split""",
)
def k8(spark, d):
    return sl.subject_ordinals(v.splits(spark, d))


@query(
    "j8_split_join",
    "subject_id edf_id windows:l",
    """SELECT p.subject_id, p.edf_id, count(*) AS windows FROM v_scored p JOIN v_split s ON p.subject_id = s.subject_id
    WHERE s.split = 'test' GROUP BY 1, 2""",
)
def j8(spark, d):
    test = sl.rows_of_split(v.scored(spark, d), v.splits(spark, d), "test")
    return test.groupBy("subject_id", "edf_id").agg(F.count(F.lit(1)).alias("windows"))


@query(
    "u2_leaking_customers",
    "subject_id",
    """SELECT CAST(o_custkey AS VARCHAR) AS subject_id FROM orders WHERE o_orderstatus = 'F' INTERSECT
    SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'O'""",
)
def u2(spark, d):
    orders = v.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("subject_id"), "o_orderstatus")
    return sl.leaking_subjects(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'O'"))


@query(
    "u3_unassigned_customers",
    "subject_id",
    """SELECT CAST(c_custkey AS VARCHAR) AS subject_id FROM customer EXCEPT SELECT CAST(o_custkey AS VARCHAR) FROM orders""",
)
def u3(spark, d):
    customers = v.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("subject_id"))
    orders = v.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("subject_id"))
    return sl.subjects_only_in(customers, orders)


@query(
    "u6_partition_totals",
    "original:l train:l validation:l test:l lost:l",
    """SELECT count(*) AS original, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation,
      count(*) FILTER (split = 'test') AS test, count(*) FILTER (split IS NULL) AS lost
    FROM v_scored p LEFT JOIN v_split s ON p.subject_id = s.subject_id""",
)
def u6(spark, d):
    return sl.partition_totals(v.scored(spark, d), v.splits(spark, d))


@query(
    "w10_first_per_class",
    "subject_id label:l edf_id window_index:l",
    """SELECT * FROM v_win QUALIFY row_number() OVER (PARTITION BY subject_id, label ORDER BY edf_id, window_index) <= 3""",
)
def w10(spark, d):
    return first_per_group(v.windows(spark, d), ["subject_id", "label"], ["edf_id", "window_index"], 3, KEY)


@query(
    "k6_split_by_recording_kind",
    "subject_id edf_id has_positive:l split",
    """SELECT subject_id, edf_id, has_positive, CASE WHEN place < n * 70 // 100 THEN 'train' WHEN place < n * 85 // 100
      THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY has_positive ORDER BY
      md5('42|' || subject_id || '|' || edf_id)) - 1 AS place, count(*) OVER (PARTITION BY has_positive) AS n FROM
      (SELECT subject_id, edf_id, max(label) AS has_positive FROM v_win GROUP BY 1, 2))""",
)
def k6_kind(spark, d):
    kinds = recording_kind(v.windows(spark, d)).drop("filetype")
    return sl.file_split(kinds, ["subject_id", "edf_id"], "has_positive")
