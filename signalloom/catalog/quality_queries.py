"""Quality and alignment operators (D2-D16, A8-A11, A17, W6, W7, W11, J1, J2, J12) on the given tables."""

from pyspark.sql import functions as F

from signalloom.catalog import views as v
from signalloom.catalog.core import VIEWS, query
from signalloom.functions import spectral as sp
from signalloom.operators import align as al, quality as q
from signalloom.operators.sequences import boundary_violations, sequences
from signalloom.operators.summarize import by_recording

KEY = ["subject_id", "edf_id", "window_index"]


def checks_sql(source: str, **rules: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{name}' AS \"constraint\", count(*) FILTER (NOT coalesce({ok}, FALSE)) AS violations FROM {source}"
        for name, ok in rules.items()
    )


CHECK = "constraint violations:l"


@query(
    "d2_not_empty",
    "name rows:l",
    "SELECT 'events' AS name, count(*) AS rows FROM events UNION ALL SELECT 'embeddings', count(*) FROM embeddings",
)
def d2(spark, d):
    tables = [
        v.table(spark, d, n).agg(F.count(F.lit(1)).alias("rows")).withColumn("name", F.lit(n))
        for n in ("events", "embeddings")
    ]
    return tables[0].unionByName(tables[1])


@query(
    "d3_duplicate_keys",
    "violations:l keys:l",
    """SELECT coalesce(sum(n - 1), 0) AS violations, count(*) AS keys
    FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""",
)
def d3(spark, d):
    return q.surplus(v.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "d3_duplicate_key_rows",
    "l_orderkey:l l_linenumber:l extra:l",
    "SELECT l_orderkey, l_linenumber, count(*) - 1 AS extra FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def d3_rows(spark, d):
    return q.extra_rows(v.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "d4_recording_in_one_subject",
    "l_orderkey:l partners:l",
    "SELECT l_orderkey, count(DISTINCT l_suppkey) AS partners FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1",
)
def d4(spark, d):
    return q.many_partners(v.table(spark, d, "lineitem"), ["l_orderkey"], ["l_suppkey"])


VIEWS["v_files"] = """
SELECT subject_id, edf_id, n_windows, row_number() OVER (PARTITION BY subject_id ORDER BY edf_id) - 1 AS file_id,
  coalesce(sum(n_windows) OVER (PARTITION BY subject_id ORDER BY edf_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS first_position
FROM (SELECT subject_id, edf_id, count(*) AS n_windows FROM v_pred GROUP BY 1, 2)"""


@query(
    "d5_recording_file_bijection",
    "pairs:l left_violations:l right_violations:l",
    """SELECT (SELECT count(*) FROM v_files) AS pairs,
      (SELECT count(*) FROM (SELECT edf_id FROM v_files GROUP BY subject_id, edf_id HAVING count(*) > 1)) AS left_violations,
      (SELECT count(*) FROM (SELECT file_id FROM v_files GROUP BY subject_id, file_id HAVING count(*) > 1)) AS right_violations""",
)
def d5(spark, d):
    files = al.recording_positions(v.predictions(spark, d))
    return q.bijection_check(files, ["subject_id", "edf_id"], ["subject_id", "file_id"])


@query(
    "d6_d8_prediction_rules",
    CHECK,
    checks_sql(
        "v_pred",
        finite_start="isfinite(start_sec)",
        finite_end="isfinite(end_sec)",
        finite_score="isfinite(y_prob)",
        end_after_start="end_sec > start_sec",
        binary_truth="y_true IN (0, 1)",
        binary_prediction="y_pred IN (0, 1)",
    ),
)
def d68(spark, d):
    return q.violations(v.predictions(spark, d), q.prediction_rules())


@query(
    "d7_constant_shape",
    CHECK,
    checks_sql("v_win", length="abs(end_sec - start_sec - 14400) <= 1e-8 + 1e-5 * 14400", events="n = 1"),
)
def d7(spark, d):
    rules = {"length": q.close_to(F.col("end_sec") - F.col("start_sec"), 14400.0), "events": F.col("n") == 1}
    return q.violations(v.windows(spark, d), rules)


@query(
    "d9_d11_array_health",
    CHECK,
    checks_sql("v_arr", size="len(x) = 64", finite="len(list_filter(x, lambda a: NOT isfinite(a))) = 0"),
)
def d911(spark, d):
    return q.array_health(v.arrays(spark, d), "x", 64)


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey"]


@query(
    "d10_number_health",
    "column nulls:l nans:l infs:l",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER (isnan(CAST({c} AS DOUBLE))) AS nans,
        count(*) FILTER (isinf(CAST({c} AS DOUBLE))) AS infs FROM lineitem"""
        for c in NUMERIC
    ),
)
def d10(spark, d):
    return q.number_health(v.table(spark, d, "lineitem"), NUMERIC)


@query(
    "j1_d12_alignment",
    "matched:l left_only:l right_only:l",
    """SELECT count(*) FILTER (d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS matched,
      count(*) FILTER (l.doc_id IS NULL) AS left_only, count(*) FILTER (d.doc_id IS NULL) AS right_only
    FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""",
)
def j1(spark, d):
    return al.orphans(v.table(spark, d, "documents"), v.table(spark, d, "labels"), ["doc_id"])


@query(
    "j1_row_aligned_join",
    "subject_id edf_id window_index:l y_true:l label:l",
    """SELECT p.subject_id, p.edf_id, p.window_index, p.y_true, w.label FROM v_pred p JOIN v_win w
    ON p.subject_id = w.subject_id AND p.edf_id = w.edf_id AND p.window_index = w.window_index""",
)
def j1_rows(spark, d):
    left = v.predictions(spark, d).select(*KEY, "y_true")
    return al.aligned(left, v.windows(spark, d).select(*KEY, "label"), KEY)


@query(
    "d15_sequences_in_one_recording",
    "constraint violations:l",
    """WITH s AS (SELECT window_index - lag(window_index, 4) OVER (PARTITION BY edf_id ORDER BY window_index) AS wide FROM v_win)
    SELECT 'sequences' AS "constraint", count(*) AS violations FROM s WHERE wide = 4
    UNION ALL SELECT 'one_recording', 0 UNION ALL SELECT 'length', 0 UNION ALL SELECT 'consecutive', 0""",
)
def d15(spark, d):
    """Violations over all sequences of five, and how many sequences there are."""
    return boundary_violations(sequences(v.windows(spark, d), 5, ["label"]), 5, counted="sequences")


@query(
    "d16_expected_subject",
    CHECK,
    checks_sql("v_pred", subject="subject_id = 's' || lpad(CAST(CAST(substr(edf_id, 2) AS BIGINT) % 15 AS VARCHAR), 2, '0')"),
)
def d16(spark, d):
    expected = F.concat(F.lit("s"), F.lpad((F.substring("edf_id", 2, 18).cast("long") % 15).cast("string"), 2, "0"))
    return q.violations(v.predictions(spark, d), {"subject": F.col("subject_id") == expected})


@query(
    "w6_contiguous_blocks",
    "subject_id blocks:l values:l contiguous:l",
    """SELECT subject_id, sum(fresh) AS blocks, count(DISTINCT event_type) AS "values",
      CAST(sum(fresh) = count(DISTINCT event_type) AS INTEGER) AS contiguous
    FROM (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY subject_id ORDER BY event_id) THEN 0 ELSE 1 END AS fresh
      FROM (SELECT 's' || lpad(CAST(user_id % 15 AS VARCHAR), 2, '0') AS subject_id, event_type, event_id FROM events))
    GROUP BY subject_id""",
)
def w6(spark, d):
    rows = v.events(spark, d)
    return q.block_breaks(rows, ["subject_id"], "event_type", ["event_id"], F.floor(F.col("event_id") / 65_536))


@query(
    "w7_index_gaps",
    "subject_id edf_id rows:l misplaced:l",
    """SELECT subject_id, edf_id, count(*) AS rows, count(*) FILTER (rn <> window_index) AS misplaced
    FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, edf_id ORDER BY window_index) - 1 AS rn FROM v_win)
    GROUP BY 1, 2""",
)
def w7(spark, d):
    return q.index_gaps(v.windows(spark, d), ["subject_id", "edf_id"], "window_index", 64)


@query(
    "j2_position_mapping",
    "subject_id edf_id window_index:l file_id:l position:l",
    """SELECT p.subject_id, p.edf_id, p.window_index, f.file_id, f.first_position + p.window_index AS position
    FROM v_pred p JOIN v_files f ON p.subject_id = f.subject_id AND p.edf_id = f.edf_id""",
)
def j2(spark, d):
    windows = v.predictions(spark, d)
    return al.array_positions(windows, al.recording_positions(windows))


@query(
    "w11_global_file_ids",
    "subject_id edf_id file_id:l global_file_id:l",
    "SELECT subject_id, edf_id, file_id, row_number() OVER (ORDER BY subject_id, file_id) - 1 AS global_file_id FROM v_files",
)
def w11(spark, d):
    return al.global_file_ids(al.recording_positions(v.predictions(spark, d)))


@query(
    "j12_partition_differences",
    "item differences:l",
    """WITH j AS (SELECT o.o_orderkey AS a, l.o_orderkey AS b, o.o_orderstatus AS s1, l.o_orderstatus AS s2, o.o_custkey AS c1,
        l.o_custkey AS c2 FROM orders o FULL JOIN (SELECT o_orderkey, 'F' AS o_orderstatus, o_custkey FROM orders
        WHERE o_totalprice > 1000) l ON o.o_orderkey = l.o_orderkey)
    SELECT 'o_orderstatus' AS item, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND s1 IS DISTINCT FROM s2) AS differences FROM j
    UNION ALL SELECT 'o_custkey', count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND c1 IS DISTINCT FROM c2) FROM j
    UNION ALL SELECT 'missing_right', count(*) FILTER (b IS NULL) FROM j
    UNION ALL SELECT 'missing_left', count(*) FILTER (a IS NULL) FROM j""",
)
def j12(spark, d):
    orders = v.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_totalprice")
    other = orders.where("o_totalprice > 1000").withColumn("o_orderstatus", F.lit("F"))
    return al.column_differences(orders, other, ["o_orderkey"], ["o_orderstatus", "o_custkey"])


MOMENTS = "n:l min:6 max:6 mean:6 std:6 nans:l infs:l large:l max_abs:6"


def moments_sql(source: str, groups: str, x: str) -> str:
    return f"""SELECT {groups}, count(*) AS n, min({x}) AS min, max({x}) AS max, sum({x}) / count(*) AS mean,
      sqrt(greatest(0, sum({x} * {x}) / count(*) - (sum({x}) / count(*)) * (sum({x}) / count(*)))) AS std,
      count(*) FILTER (isnan({x})) AS nans, count(*) FILTER (isinf({x})) AS infs, count(*) FILTER (abs({x}) > 100) AS large,
      max(abs({x})) AS max_abs FROM {source} GROUP BY {groups}"""


@query("a8_streaming_moments", "subject_id " + MOMENTS, moments_sql("v_signal", "subject_id", "v"))
def a8(spark, d):
    return q.moments(v.events(spark, d), ["subject_id"])


@query("a8_channel_moments", "subject_id channel:l " + MOMENTS, moments_sql("(SELECT *, ch AS channel FROM v_sample)", "subject_id, channel", "v"))
def a8_channel(spark, d):
    return q.array_moments(v.channel_windows(spark, d), ["subject_id"])


@query(
    "a9_channel_flags",
    "subject_id channel:l flat:l extreme:l",
    """SELECT subject_id, ch AS channel, CAST(stddev_pop(v) < 1e-4 AS INTEGER) AS flat, CAST(max(abs(v)) > 1000 AS INTEGER) AS extreme
    FROM v_sample GROUP BY 1, 2""",
)
def a9(spark, d):
    return q.with_channel_flags(
        q.array_moments(v.channel_windows(spark, d), ["subject_id"])
    )


@query(
    "a10_feature_variance",
    "dim:l variance:6 near_constant:l",
    """SELECT ch * 16 + k AS dim, var_pop(v) AS variance, CAST(var_pop(v) < 1e-6 AS INTEGER) AS near_constant
    FROM v_sample GROUP BY 1""",
)
def a10(spark, d):
    return q.feature_variance(v.arrays(spark, d), "x")


@query(
    "a11_scale_class",
    "subject_id std:6 scale",
    """SELECT subject_id, stddev_pop(v) AS std, CASE WHEN stddev_pop(v) BETWEEN 0.5 AND 2 THEN 'NORMALIZED'
      WHEN stddev_pop(v) < 0.01 THEN 'RAW' ELSE 'UNKNOWN' END AS scale FROM v_sample GROUP BY 1""",
)
def a11(spark, d):
    return q.scale_class(q.array_moments(v.channel_windows(spark, d), ["subject_id"], by_channel=False))


@query(
    "a17_window_quality",
    "window_id:l has_nan:l has_inf:l mean:6 std:6 min:6 max:6 channel_std:6 channel_min:6 channel_max:6 is_flat:l is_clipped:l",
    """SELECT w.*, f.is_flat, f.is_clipped FROM (SELECT window_id, max(CAST(isnan(v) AS INTEGER)) AS has_nan,
        max(CAST(isinf(v) AS INTEGER)) AS has_inf, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max,
        stddev_pop(v) FILTER (ch = 1) AS channel_std, min(v) FILTER (ch = 1) AS channel_min, max(v) FILTER (ch = 1) AS channel_max
      FROM v_sample GROUP BY window_id) w
    JOIN (SELECT c.window_id, max(CAST(c.std < 1e-4 AS INTEGER)) AS is_flat, max(CAST(r.best >= 10 AS INTEGER)) AS is_clipped
      FROM (SELECT window_id, ch, stddev_pop(v) AS std FROM v_sample GROUP BY 1, 2) c
      JOIN (SELECT window_id, ch, max(n) AS best FROM (SELECT window_id, ch, count(*) AS n FROM (SELECT *,
          sum(fresh) OVER (PARTITION BY window_id, ch ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *,
          CASE WHEN v = lag(v) OVER (PARTITION BY window_id, ch ORDER BY k) THEN 0 ELSE 1 END AS fresh FROM v_sample))
          GROUP BY window_id, ch, run) GROUP BY 1, 2) r ON c.window_id = r.window_id AND c.ch = r.ch
      GROUP BY c.window_id) f ON w.window_id = f.window_id""",
)
def a17(spark, d):
    return q.window_quality(v.channel_windows(spark, d), ["window_id"])


@query(
    "d13_expected_totals",
    "split windows:l positives:l",
    """SELECT s.split, count(*) AS windows, sum(y_true) AS positives FROM v_scored p JOIN v_split s
    ON p.subject_id = s.subject_id GROUP BY 1""",
)
def d13(spark, d):
    rows = v.scored(spark, d).withColumn("split", v.split_of()).withColumnRenamed("y_true", "label")
    return by_recording(rows, "split").groupBy("split").agg(
        F.sum("windows").alias("windows"), F.sum("positives").alias("positives")
    )


@query(
    "d1_required_columns",
    "column missing:l empty:l",
    """SELECT 'event_id' AS "column", 0 AS missing, count(*) FILTER (event_id IS NULL) AS empty FROM events
    UNION ALL SELECT 'value', 0, count(*) FILTER (value IS NULL) FROM events
    UNION ALL SELECT 'props', 0, count(*) FILTER (props IS NULL) FROM events
    UNION ALL SELECT 'edf_id', 1, count(*) FROM events""",
)
def d1(spark, d):
    return q.column_presence(v.table(spark, d, "events"), ["event_id", "value", "props", "edf_id"])


@query(
    "d13_totals_verdict",
    "split item expected:l found:l ok:l",
    """WITH found AS (SELECT s.split, count(*) AS windows, sum(y_true) AS positives FROM v_scored p JOIN v_split s
      ON p.subject_id = s.subject_id GROUP BY 1),
    expected AS (SELECT CASE WHEN user_id % 15 < 10 THEN 'train' WHEN user_id % 15 < 12 THEN 'validation' ELSE 'test' END AS split,
      count(DISTINCT event_id) AS windows, count(*) FILTER (event_type = 'error' AND user_id % 15 <> 3) AS positives FROM events GROUP BY 1)
    SELECT *, CAST(expected = found AS INTEGER) AS ok FROM (
      SELECT e.split, 'windows' AS item, e.windows AS expected, f.windows AS found FROM expected e JOIN found f ON e.split = f.split
      UNION ALL SELECT e.split, 'positives', e.positives, f.positives FROM expected e JOIN found f ON e.split = f.split)""",
)
def d13_verdict(spark, d):
    """The expectation leaves out one subject's positives, so one total must be reported."""
    rows = v.scored(spark, d).withColumn("split", v.split_of()).withColumnRenamed("y_true", "label")
    found = by_recording(rows, "split").groupBy("split").agg(F.sum("windows").alias("windows"), F.sum("positives").alias("positives"))
    raw = v.table(spark, d, "events").withColumn("split", v.split_of(v.subject_of("user_id")))
    positive = (F.col("event_type") == "error") & (F.col("user_id") % v.SUBJECTS != 3)
    expected = raw.groupBy("split").agg(F.countDistinct("event_id").alias("windows"), F.count_if(positive).alias("positives"))
    return q.totals_verdict(found, expected, ["split"], ["windows", "positives"])


@query(
    "d14_bins_and_bands",
    "n:l band first_bin:l bins:l",
    """SELECT n, b.band, min(bin) AS first_bin, count(*) AS bins FROM (SELECT n, unnest(range(n // 2 + 1)) AS bin FROM
      (SELECT DISTINCT len(x) AS n FROM v_arr)) JOIN (VALUES ('delta', 0.5, 4.0), ('theta', 4.0, 8.0), ('alpha', 8.0, 13.0),
      ('beta', 13.0, 30.0), ('gamma', 30.0, 40.0)) b(band, lo, hi) ON bin * 128.0 / n >= lo AND bin * 128.0 / n < hi GROUP BY 1, 2""",
)
def d14(spark, d):
    return sp.band_table(v.arrays(spark, d).select(F.size("x").alias("n")).distinct())
