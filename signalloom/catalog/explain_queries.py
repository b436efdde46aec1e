"""Scoring and explanation operators (G16, G18, J10, K2, X1-X6) on the given tables."""

import numpy as np
from pyspark.sql import functions as F

from signalloom.catalog import views as v
from signalloom.catalog.core import VIEWS, query
from signalloom.operators import explain as ex, features as ft, scoring as sc
from signalloom.operators.metrics import ranking_metrics

FEATURES = 16  # four channels by four segments
HEX = "CAST('0x' || substr(h, f // 4 + 1, 1) AS INTEGER)"
VIEWS["v_mask"] = f"""
SELECT window_id, perturbation, f, CASE WHEN perturbation = 0 THEN 1 ELSE ({HEX} >> (f % 4)) & 1 END AS kept
FROM (SELECT window_id, p AS perturbation, md5('42|' || window_id || '|' || p || '|0') AS h FROM v_arr, range(500) r(p)), range(16) b(f)"""

VIEWS["v_segment"] = "SELECT window_id, ch * 4 + k // 4 AS f, sum(v) AS v FROM v_sample GROUP BY 1, 2"


def masks(spark, d):
    return ex.perturbation_masks(v.arrays(spark, d), "window_id", FEATURES)


@query(
    "x1_j10_perturbation_masks",
    "window_id:l perturbation:l bits kept:l",
    """SELECT window_id, perturbation, string_agg(CAST(kept AS VARCHAR), '' ORDER BY f) AS bits, sum(kept) AS kept
    FROM v_mask GROUP BY 1, 2""",
)
def x1(spark, d):
    text = F.array_join(F.col("mask").cast("array<string>"), "")
    return masks(spark, d).select(
        "window_id", "perturbation", text.alias("bits"), F.aggregate("mask", F.lit(0), lambda a, b: a + b).alias("kept")
    )


@query(
    "x1_masked_signal",
    "window_id:l perturbation:l total:4",
    """SELECT m.window_id, m.perturbation, sum(s.v * m.kept) AS total FROM v_mask m JOIN v_segment s
    ON m.window_id = s.window_id AND m.f = s.f GROUP BY 1, 2""",
)
def x1_signal(spark, d):
    """Every perturbation applied to its window, and what is left of its samples."""
    rows = ex.perturbation_masks(v.channel_windows(spark, d), "window_id", FEATURES, carry=["signal"])
    masked = F.flatten(ex.apply_mask(F.col("signal"), F.col("mask"), 4, 16))
    return rows.select("window_id", "perturbation", F.aggregate(masked, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(
    "x2_proximity_weight",
    "window_id:l perturbation:l weight:6",
    """SELECT window_id, perturbation, exp(-pow(1 - avg(kept), 2) / 0.0625) AS weight FROM v_mask GROUP BY 1, 2""",
)
def x2(spark, d):
    return masks(spark, d).select("window_id", "perturbation", ex.proximity(F.col("mask")).alias("weight"))


def linear_logits(x: np.ndarray) -> np.ndarray:
    """Weighs channel c, sample k by (c + 1) * (k + 1) / 100."""
    c = np.arange(x.shape[1])[:, None] + 1.0
    k = np.arange(x.shape[2])[None, :] + 1.0
    return (x * c * k / 100.0).sum(axis=(1, 2))


def load_linear():
    return lambda batch: linear_logits(np.asarray(batch, dtype=np.float64).reshape(len(batch), 4, 16))


LOGIT_SQL = "SELECT window_id, sum(v * (ch + 1) * (k + 1) / 100.0) AS logit FROM v_sample GROUP BY 1"


@query("g16_score_batches", "window_id:l logit:5 y_prob:5", f"SELECT *, 1 / (1 + exp(-logit)) AS y_prob FROM ({LOGIT_SQL})")
def g16(spark, d):
    return sc.score_batches(v.channel_windows(spark, d), load_linear, "signal", [4, 16])


def explanations(spark, d):
    return ex.ridge_explanations(v.channel_windows(spark, d), "window_id", linear_logits)


# The same weighted fit by definition: centred normal equations, solved by elimination.
RIDGE_SQL = f"""WITH RECURSIVE seg AS (SELECT window_id, ch * 4 + k // 4 AS f, sum(v * (ch + 1) * (k + 1) / 100.0) AS part
    FROM v_sample GROUP BY 1, 2),
  fits AS (SELECT m.window_id, m.perturbation, list(CAST(m.kept AS DOUBLE) ORDER BY m.f) AS x, sum(m.kept * s.part) AS y,
      exp(-pow(1 - avg(m.kept), 2) / {ex.KERNEL_WIDTH**2!r}) AS w
    FROM v_mask m JOIN seg s ON m.window_id = s.window_id AND m.f = s.f GROUP BY 1, 2),
  cells AS (SELECT window_id, perturbation, w, f, CASE WHEN f = 16 THEN y ELSE x[f + 1] END AS v FROM fits, range(17) c(f)),
  means AS (SELECT window_id, f, sum(w * v) / sum(w) AS m FROM cells GROUP BY 1, 2),
  far AS (SELECT c.window_id, perturbation, w, c.f, v - m AS v FROM cells c JOIN means n ON c.window_id = n.window_id AND c.f = n.f),
  gram AS (SELECT a.window_id, a.f AS i, b.f AS j, sum(a.w * a.v * b.v) + CASE WHEN a.f = b.f THEN {ex.ALPHA!r} ELSE 0 END AS g
    FROM far a JOIN far b ON a.window_id = b.window_id AND a.perturbation = b.perturbation AND a.f < 16 GROUP BY 1, 2, 3),
  rows AS (SELECT window_id, i, list(g ORDER BY j) AS r FROM gram GROUP BY 1, 2),
  steps AS (SELECT window_id, 1 AS k, list(r ORDER BY i) AS m FROM rows GROUP BY 1
    UNION ALL SELECT window_id, k + 1, [[CASE WHEN i = k THEN m[k][j] / m[k][k] ELSE m[i][j] - m[i][k] / m[k][k] * m[k][j] END
      for j in range(1, 18)] for i in range(1, 17)] FROM steps WHERE k <= 16)
  SELECT window_id, f // 4 AS channel, f % 4 AS segment, m[f + 1][17] AS coefficient FROM steps, range(16) c(f) WHERE k = 17"""


@query("x3_weighted_ridge", "window_id:l channel:l segment:l coefficient:6", RIDGE_SQL)
def x3(spark, d):
    rows = explanations(spark, d).select("window_id", F.posexplode("coefficients").alias("channel", "c"))
    return rows.select("window_id", "channel", F.posexplode("c").alias("segment", "coefficient"))


IMPORTANCE_SQL = "SELECT window_id, ch AS channel, sum(abs(v)) AS importance FROM v_sample GROUP BY 1, 2"


@query("x4_channel_importance", "window_id:l channel:l importance:6", IMPORTANCE_SQL)
def x4(spark, d):
    rows = v.channel_windows(spark, d).select("window_id", ex.channel_importance(F.col("signal")).alias("i"))
    return rows.select("window_id", F.posexplode("i").alias("channel", "importance"))


@query(
    "k2_top_channels",
    "window_id:l rank:l channel:l importance:6",
    f"""SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY importance DESC, channel) - 1 AS rank FROM ({IMPORTANCE_SQL})
    QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY importance DESC, channel) <= 2""",
)
def k2(spark, d):
    top = ex.top_channels(ex.channel_importance(F.col("signal")), 2)
    rows = v.channel_windows(spark, d).select("window_id", F.posexplode(top).alias("rank", "t"))
    return rows.select("window_id", "rank", "t.channel", F.col("t.value").alias("importance"))


@query(
    "x5_global_importance",
    "channel:l mean_abs:6 rank:l",
    """SELECT ch AS channel, avg(abs(v)) AS mean_abs, row_number() OVER (ORDER BY avg(abs(v)) DESC) AS rank FROM v_sample GROUP BY ch""",
)
def x5(spark, d):
    return ex.global_importance(v.channel_windows(spark, d), "signal")


@query(
    "x6_explained_windows",
    "window_id:l subject_id label:l y_prob:5",
    f"""SELECT a.window_id, a.subject_id, a.label, 1 / (1 + exp(-l.logit)) AS y_prob FROM v_arr a JOIN ({LOGIT_SQL}) l
    ON a.window_id = l.window_id WHERE a.label = 1""",
)
def x6(spark, d):
    chosen = v.channel_windows(spark, d).where("label = 1")
    scores = sc.score_batches(chosen.select("window_id", "signal"), load_linear, "signal", [4, 16])
    return ex.explained_windows(chosen.select("window_id", "subject_id", "label"), scores.select("window_id", "y_prob"), ["window_id"])


@query("g18_train_weighted_baseline", "n:l positives:l roc_auc:6 pr_auc:6")
def g18(spark, d):
    """Train on ten subjects, choose on two, evaluate on three; the label is class 0."""
    windows = v.arrays(spark, d).select("window_id", "subject_id", "label", F.array("x").alias("signal"))
    rows = ft.with_band_features(windows, 64).select(
        "window_id", "features", (F.col("label") == 0).cast("int").alias("label"), v.split_of().alias("split")
    )
    part = {s: rows.where(F.col("split") == s) for s in ("train", "validation", "test")}
    model, _ = sc.train_weighted_baseline(part["train"], part["validation"])
    return ranking_metrics(sc.score_with(model, part["test"]), truth="label")


BINARY_SQL = """WITH rows AS (SELECT CAST(x[1] > 0 AS INTEGER) AS a, CAST(label = 0 AS INTEGER) AS y FROM v_arr WHERE label < 4),
  cells AS (SELECT count(*) FILTER (a = 0 AND y = 1) AS p0, count(*) FILTER (a = 0 AND y = 0) AS q0,
    count(*) FILTER (a = 1 AND y = 1) AS p1, count(*) FILTER (a = 1 AND y = 0) AS q1 FROM rows)
SELECT a, ln(CASE a WHEN 0 THEN p0 / q0 ELSE p1 / q1 END * (q0 + q1) / (p0 + p1)) AS logit FROM cells, range(2) r(a)"""


@query("g18_binary_feature", "a:l logit:3", BINARY_SQL)
def g18_binary(spark, d):
    """One binary feature, no penalty: the class-balanced optimum is the log odds of each value."""
    rows = v.arrays(spark, d).where("label < 4").select(
        F.array((F.col("x")[0] > 0).cast("double")).alias("features"), (F.col("label") == 0).cast("int").alias("label")
    )
    model, _ = sc.train_weighted_baseline(rows, rows, reg_params=(0.0,))
    values = rows.select("features").distinct()
    return sc.score_with(model, values).select(F.col("features")[0].cast("int").alias("a"), "logit")
