"""Evaluation operators (R1-R12, U5, K3, J9, W9, A12, A13, G17) on the given tables."""

from pyspark.sql import functions as F

from signalloom.catalog import views as v
from signalloom.catalog.core import VIEWS, query
from signalloom.functions.scalars import sigmoid
from signalloom.operators import distribution as dist, metrics as m
from signalloom.operators.ordered import matched, score_ladder

RATES = "tp:l fp:l fn:l tn:l precision:6 recall:6 f1:6"
RATE_SQL = """coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1"""


def confusion_sql(source: str, groups: str = "") -> str:
    keys = f"{groups}," if groups else ""
    by = f"GROUP BY {groups}" if groups else ""
    return f"""SELECT *, {RATE_SQL} FROM (SELECT {keys}
      count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp,
      count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp
    FROM {source} {by})"""


def grid_sql(name: str) -> str:
    steps = {
        "hundredths": "SELECT n * 100 AS n FROM range(1, 100) r(n)",
        "fine": "SELECT n * 100 AS n FROM range(1, 100) r(n) UNION SELECT n * 10 FROM range(991, 1001) r(n)",
        "finest": "SELECT n * 100 AS n FROM range(1, 100) r(n) UNION SELECT n * 10 FROM range(991, 1001) r(n) "
        "UNION SELECT n FROM range(9991, 10001) r(n)",
    }[name]
    return f"SELECT n / 10000 AS threshold FROM ({steps})"


def sweep_sql(source: str, grid: str, groups: str = "") -> str:
    keys = f"{groups}," if groups else ""
    return f"""SELECT *, {RATE_SQL} FROM (SELECT {keys} threshold,
      count(*) FILTER (y_true = 1 AND y_prob >= threshold) AS tp, count(*) FILTER (y_true = 0 AND y_prob >= threshold) AS fp,
      count(*) FILTER (y_true = 1 AND y_prob < threshold) AS fn, count(*) FILTER (y_true = 0 AND y_prob < threshold) AS tn
    FROM {source}, ({grid_sql(grid)}) GROUP BY {keys} threshold)"""


def ladder_sql(source: str, groups: str = "") -> str:
    keys = f"{groups}," if groups else ""
    part = f"PARTITION BY {groups}" if groups else ""
    return f"""SELECT *, sum(p) OVER ({part} ORDER BY y_prob DESC) AS tp, sum(c) OVER ({part} ORDER BY y_prob DESC) AS sel,
      sum(p) OVER ({part}) AS pos, sum(c) OVER ({part}) AS tot
    FROM (SELECT {keys} y_prob, CAST(sum(y_true) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS c FROM {source}
          GROUP BY {keys} y_prob)"""


def ranking_sql(source: str, groups: str = "") -> str:
    keys = f"{groups}," if groups else ""
    by = f"GROUP BY {groups}" if groups else ""
    return f"""SELECT {keys} max(tot) AS n, max(pos) AS positives,
      CASE WHEN max(pos) > 0 AND max(tot) > max(pos)
        THEN sum((c - p) * (tp - p / 2)) / (max(pos) * (max(tot) - max(pos))) END AS roc_auc,
      CASE WHEN max(pos) > 0 AND max(tot) > max(pos) THEN sum(p * tp / sel) / max(pos) END AS pr_auc,
      sum(p * (y_prob - 1) * (y_prob - 1) + (c - p) * y_prob * y_prob) / max(tot) AS brier,
      max(pos) / max(tot) AS prevalence
    FROM ({ladder_sql(source, groups)}) {by}"""


RANKING = "n:l positives:l roc_auc:6 pr_auc:6 brier:6 prevalence:6"

VIEWS["v_scored_split"] = "SELECT s.*, t.split FROM v_scored s JOIN v_split t ON s.subject_id = t.subject_id"
VIEWS["v_sweep_val"] = sweep_sql("(SELECT * FROM v_scored_split WHERE split = 'validation')", "finest")
VIEWS["v_frozen"] = """
SELECT * REPLACE (CAST(y_prob >= (SELECT threshold FROM v_sweep_val ORDER BY f1 DESC, threshold LIMIT 1) AS INTEGER) AS y_pred)
FROM v_scored_split WHERE split = 'test'"""


def split_scores(spark, d):
    return v.scored(spark, d).withColumn("split", v.split_of())


@query("r1_confusion", RATES, confusion_sql("v_scored"))
def r1(spark, d):
    return m.confusion(v.scored(spark, d))


@query("r1_confusion_labels", RATES, confusion_sql("v_cls"))
def r1_cls(spark, d):
    return m.confusion(v.classified(spark, d))


@query("r2_threshold_sweep", "threshold:6 " + RATES, sweep_sql("v_scored", "finest"))
def r2(spark, d):
    return m.threshold_sweep(v.scored(spark, d), m.threshold_grid("finest"))


@query("r2_threshold_sweep_labels", "threshold:6 " + RATES, sweep_sql("v_cls", "fine"))
def r2_cls(spark, d):
    return m.threshold_sweep(v.classified(spark, d), m.threshold_grid("fine"))


LINEAR = m.linear_grid()


@query(
    "r2_linear_sweep",
    "threshold:6 " + RATES,
    f"""SELECT *, {RATE_SQL} FROM (SELECT threshold,
      count(*) FILTER (y_true = 1 AND y_prob >= threshold) AS tp, count(*) FILTER (y_true = 0 AND y_prob >= threshold) AS fp,
      count(*) FILTER (y_true = 1 AND y_prob < threshold) AS fn, count(*) FILTER (y_true = 0 AND y_prob < threshold) AS tn
    FROM v_scored, (SELECT CAST(unnest({[repr(x) for x in LINEAR]!r}) AS DOUBLE) AS threshold) GROUP BY threshold)""",
)
def r2_linear(spark, d):
    return m.threshold_sweep(v.scored(spark, d), LINEAR)


@query("j9_sweep_by_subject", "subject_id threshold:6 " + RATES, sweep_sql("v_scored", "hundredths", "subject_id"))
def j9(spark, d):
    return m.threshold_sweep(v.scored(spark, d), m.threshold_grid("hundredths"), ["subject_id"])


@query(
    "u5_threshold_grid",
    "grid threshold:6 reached:l",
    f"""SELECT grid, threshold, (SELECT count(*) FROM v_scored WHERE y_prob >= threshold) AS reached FROM (
      SELECT 'hundredths' AS grid, * FROM ({grid_sql('hundredths')}) UNION ALL SELECT 'fine', * FROM ({grid_sql('fine')})
      UNION ALL SELECT 'finest', * FROM ({grid_sql('finest')}))""",
)
def u5(spark, d):
    """One sweep over the thresholds of all grids; each then stands under the grids that hold it."""
    grids = {name: m.threshold_grid(name) for name in m.GRIDS}
    every = sorted({t for grid in grids.values() for t in grid})
    swept = m.threshold_sweep(v.scored(spark, d), every)
    held = [F.when(F.col("threshold").isin([float(t) for t in grid]), F.lit(name)) for name, grid in grids.items()]
    return swept.select(
        F.explode(F.array_compact(F.array(*held))).alias("grid"), "threshold", (F.col("tp") + F.col("fp")).alias("reached")
    )


@query(
    "k3_best_threshold",
    "threshold:6 " + RATES,
    f"SELECT * FROM ({sweep_sql('v_scored', 'finest')}) ORDER BY f1 DESC, threshold LIMIT 1",
)
def k3(spark, d):
    return m.best_threshold(m.threshold_sweep(v.scored(spark, d), m.threshold_grid("finest")))


@query(
    "k3_best_threshold_by_subject",
    "subject_id threshold:6 " + RATES,
    f"""SELECT * FROM ({sweep_sql('v_scored', 'fine', 'subject_id')})
    QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY f1 DESC, threshold) = 1""",
)
def k3_subject(spark, d):
    sweep = m.threshold_sweep(v.scored(spark, d), m.threshold_grid("fine"), ["subject_id"])
    return m.best_threshold(sweep, ["subject_id"])


@query("r3_r4_ranking_metrics", RANKING, ranking_sql("v_scored"))
def r34(spark, d):
    return m.ranking_metrics(v.scored(spark, d))


@query("r3_r4_ranking_metrics_labels", RANKING, ranking_sql("v_cls"))
def r34_cls(spark, d):
    return m.ranking_metrics(v.classified(spark, d))


@query("r3_roc_auc", "roc_auc:6", f"SELECT roc_auc FROM ({ranking_sql('v_scored')})")
def r3(spark, d):
    return m.ranking_metrics(v.scored(spark, d))


@query("r4_average_precision", "pr_auc:6", f"SELECT pr_auc FROM ({ranking_sql('v_scored')})")
def r4(spark, d):
    return m.ranking_metrics(v.scored(spark, d))


@query(
    "r5_model_selection",
    "run pr_auc:6 roc_auc:6",
    f"""SELECT * FROM ({ranking_sql("(SELECT split AS run, y_true, y_prob FROM v_scored_split)", "run")})
    ORDER BY pr_auc DESC, run LIMIT 1""",
)
def r5(spark, d):
    scores = split_scores(spark, d).withColumnRenamed("split", "run")
    return m.select_best_run(m.ranking_metrics(scores, ["run"]))


@query(
    "r6_r7_brier_prevalence",
    "brier:6 prevalence:6",
    "SELECT avg((y_prob - y_true) * (y_prob - y_true)) AS brier, avg(y_true) AS prevalence FROM v_scored",
)
def r67(spark, d):
    gap = F.col("y_prob") - F.col("y_true")
    return v.scored(spark, d).agg(F.avg(gap * gap).alias("brier"), F.avg("y_true").alias("prevalence"))


CURVE = "y_prob:6 tpr:6 fpr:6 precision:6"


@query(
    "r8_curve_points",
    CURVE,
    f"SELECT y_prob, tp / pos AS tpr, (sel - tp) / (tot - pos) AS fpr, tp / sel AS precision FROM ({ladder_sql('v_scored')})",
)
def r8(spark, d):
    return m.curve_points(v.scored(spark, d))


@query(
    "w9_running_counts",
    "subject_id y_prob:6 n_ge:l positives_ge:l",
    f"SELECT subject_id, y_prob, sel AS n_ge, tp AS positives_ge FROM ({ladder_sql('v_scored', 'subject_id')})",
)
def w9(spark, d):
    return score_ladder(v.scored(spark, d), ["subject_id"], "y_prob", "y_true")


CALIBRATION_SQL = f"""SELECT len(list_filter({[repr(e) for e in m.inner_edges(10)]!r}::DOUBLE[], lambda e: y_prob > e)) AS bin,
  count(*) AS n, avg(y_prob) AS mean_score, avg(y_true) AS positive_share FROM {{}} GROUP BY 1"""


@query("r9_calibration", "bin:l n:l mean_score:6 positive_share:6", CALIBRATION_SQL.format("v_scored"))
def r9(spark, d):
    return m.calibration(v.scored(spark, d))


@query("r9_calibration_labels", "bin:l n:l mean_score:6 positive_share:6", CALIBRATION_SQL.format("v_cls"))
def r9_cls(spark, d):
    return m.calibration(v.classified(spark, d))


@query(
    "r10_per_subject_metrics",
    f"subject_id {RANKING} {RATES}",
    f"""SELECT * FROM ({ranking_sql('v_scored', 'subject_id')}) JOIN ({confusion_sql('v_scored', 'subject_id')})
    USING (subject_id)""",
)
def r10(spark, d):
    scores = v.scored(spark, d)
    return matched(m.ranking_metrics(scores, ["subject_id"]), m.confusion(scores, ["subject_id"]), ["subject_id"])


@query(
    "r10_per_source_metrics",
    f"subject_id {RANKING} {RATES}",
    f"""SELECT * FROM ({ranking_sql('v_cls', 'subject_id')}) JOIN ({confusion_sql('v_cls', 'subject_id')})
    USING (subject_id)""",
)
def r10_cls(spark, d):
    scores = v.classified(spark, d)
    return matched(m.ranking_metrics(scores, ["subject_id"]), m.confusion(scores, ["subject_id"]), ["subject_id"])


@query("r11_frozen_threshold", RATES, confusion_sql("v_frozen"))
def r11(spark, d):
    scores = split_scores(spark, d)
    sweep = m.threshold_sweep(scores.where("split = 'validation'"), m.threshold_grid("finest"))
    frozen = m.apply_frozen_threshold(scores.where("split = 'test'"), m.best_threshold(sweep))
    return m.confusion(frozen)


@query(
    "r12_classification_report",
    "label:l precision:6 recall:6 f1:6 support:l",
    f"""SELECT label, {RATE_SQL}, tp + fn AS support FROM (
      SELECT c AS label, count(*) FILTER (y_true = c AND y_pred = c) AS tp, count(*) FILTER (y_true <> c AND y_pred = c) AS fp,
        count(*) FILTER (y_true = c AND y_pred <> c) AS fn FROM v_scored, (VALUES (0), (1)) t(c) GROUP BY c)""",
)
def r12(spark, d):
    return m.classification_report(v.scored(spark, d))


DESCRIBE_SQL = """SELECT {g}, count({x}) AS n, min({x}) AS min, max({x}) AS max, avg({x}) AS mean, stddev_pop({x}) AS std,
  quantile_cont({x}, 0.05) AS p5, quantile_cont({x}, 0.25) AS p25, quantile_cont({x}, 0.5) AS median,
  quantile_cont({x}, 0.75) AS p75, quantile_cont({x}, 0.95) AS p95, quantile_cont({x}, 0.99) AS p99
FROM {src} GROUP BY {g}"""
DESCRIBE = "n:l min:6 max:6 mean:6 std:6 p5:9 p25:9 median:9 p75:9 p95:9 p99:9"


@query(
    "a12_score_distribution_by_class",
    "y_true:l " + DESCRIBE,
    DESCRIBE_SQL.format(g="y_true", x="y_prob", src="v_scored"),
)
def a12(spark, d):
    return dist.describe(v.scored(spark, d), ["y_true"], "y_prob")


@query(
    "a12_score_distribution_by_subject",
    "subject_id " + DESCRIBE,
    DESCRIBE_SQL.format(g="subject_id", x="y_prob", src="v_scored"),
)
def a12_subject(spark, d):
    return dist.describe(v.scored(spark, d), ["subject_id"], "y_prob")


@query(
    "a12_score_distribution_by_subject_and_class",
    "subject_id y_true:l " + DESCRIBE,
    DESCRIBE_SQL.format(g="subject_id, y_true", x="y_prob", src="v_scored"),
)
def a12_subject_class(spark, d):
    return dist.describe(v.scored(spark, d), ["subject_id", "y_true"], "y_prob")


@query(
    "a13_exceedance_counts",
    "cutoff:6 n_above:l positives_above:l positives_pct:6",
    """SELECT cutoff, count(*) FILTER (y_prob > cutoff) AS n_above,
      count(*) FILTER (y_prob > cutoff AND y_true = 1) AS positives_above,
      100.0 * count(*) FILTER (y_prob > cutoff AND y_true = 1) / count(*) FILTER (y_true = 1) AS positives_pct
    FROM v_scored, (VALUES (0.01::DOUBLE), (0.05), (0.1), (0.2), (0.3), (0.4), (0.5)) t(cutoff) GROUP BY cutoff""",
)
def a13(spark, d):
    return dist.exceedances(v.scored(spark, d))


@query("g17_sigmoid", "event_id:l p:6", "SELECT event_id, 1 / (1 + exp(-(value - 60) / 20)) AS p FROM events")
def g17(spark, d):
    return v.events(spark, d).select("event_id", sigmoid((F.col("v") - 60) / 20).alias("p"))
