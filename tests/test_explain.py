import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from signalloom.functions.scalars import sigmoid
from signalloom.operators import explain as ex, scoring as sc

# The models below are sent to the workers with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def windows(spark, n=3, channels=3, samples=10, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, channels, samples))
    return x, spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(x)], "w long, signal array<array<double>>")


@pytest.mark.parametrize("features", [12, 92, 200])
def test_masks_agree_between_expression_and_task(spark, features):
    _, df = windows(spark)
    got = {(r["w"], r["perturbation"]): r["mask"] for r in ex.perturbation_masks(df, "w", features, 40).collect()}
    for w in range(3):
        want = ex.digest_masks(w, features, 40, 42)
        assert all(got[w, p] == want[p].astype(int).tolist() for p in range(40))
    assert got[0, 0] == [1] * features and 0.4 < np.mean([got[0, p] for p in range(1, 40)]) < 0.6


def test_masked_segments_are_silent(spark):
    x, df = windows(spark)
    masked = ex.perturbation_masks(df, "w", 12, 5, carry=["signal"]).withColumn(
        "m", ex.apply_mask(F.col("signal"), F.col("mask"), 3, 10)
    )
    for r in masked.collect():
        keep = np.repeat(np.array(r["mask"]).reshape(3, 4), [2, 2, 2, 4], axis=1)
        np.testing.assert_allclose(r["m"], x[r["w"]] * keep)


def test_proximity(spark):
    df = spark.createDataFrame([([1, 1, 1, 1],), ([1, 0, 1, 1],)], "mask array<int>")
    assert [r[0] for r in df.select(ex.proximity(F.col("mask"))).collect()] == pytest.approx([1.0, np.exp(-1.0)])


def logits(x):
    return (x[:, 0] * 2.0).sum(axis=1) - x[:, 2, 5:].sum(axis=1)


def test_ridge_equals_a_direct_solution(spark):
    x, df = windows(spark)
    for r in ex.ridge_explanations(df, "w", logits, perturbations=200).collect():
        z = ex.digest_masks(r["w"], 12, 200, 42)
        seg = np.minimum(np.arange(10) // 2, 3)
        y = np.array([logits((x[r["w"]] * m.reshape(3, 4)[:, seg])[None])[0] for m in z])
        weights = np.exp(-((1 - z.mean(axis=1)) ** 2) / 0.0625)
        design = np.hstack([np.ones((200, 1)), z])
        penalty = np.diag([0.0] + [1.0] * 12)
        want = np.linalg.solve(design.T @ (design * weights[:, None]) + penalty, design.T @ (weights * y))[1:]
        np.testing.assert_allclose(np.array(r["coefficients"]).ravel(), want, atol=1e-8)
        assert r["logit"] == pytest.approx(float(logits(x[r["w"]][None])[0]))
        # The channel that the model ignores explains nothing.
        assert np.abs(r["coefficients"][1]).sum() < 0.2 * np.abs(r["coefficients"][0]).sum() + 0.5


def test_importance(spark):
    df = spark.createDataFrame([([[1.0, -1.0], [0.0, 5.0], [2.0, 0.0]],)], "c array<array<double>>")
    row = df.select(ex.channel_importance(F.col("c")).alias("i"), ex.top_channels(ex.channel_importance(F.col("c")), 2).alias("t")).first()
    assert row["i"] == [2.0, 5.0, 2.0]
    assert [(t["value"], t["channel"]) for t in row["t"]] == [(5.0, 1), (2.0, 0)]
    ranks = [tuple(r) for r in ex.global_importance(df, "c").orderBy("rank").collect()]
    assert ranks == [(1, 2.5, 1), (0, 1.0, 2), (2, 1.0, 3)]


def load_sum():
    return lambda batch: np.asarray(batch).reshape(len(batch), -1).sum(axis=1)


def test_batched_scores(spark):
    x, df = windows(spark, 20)
    for r in sc.score_batches(df, load_sum, "signal", [3, 10], batch_size=7).collect():
        assert r["logit"] == pytest.approx(x[r["w"]].sum()) and r["y_prob"] == pytest.approx(1 / (1 + np.exp(-r["logit"])))


def test_baseline_learns_and_is_balanced(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        y = int(i % 10 == 0)
        rows.append((rng.normal(loc=2.0 * y, size=3).tolist(), y))
    df = spark.createDataFrame(rows, "features array<double>, label int")
    model, tried = sc.train_weighted_baseline(df.limit(300), df, reg_params=(0.0, 0.01))
    assert [t[0] for t in tried] == [0.0, 0.01] and max(t[1] for t in tried) > 0.7
    scored = sc.score_with(model, df)
    assert scored.where(F.abs(F.col("y_prob") - sigmoid("logit")) > 1e-9).count() == 0
    # Balanced weights put the boundary between the classes, not above the rare one.
    assert scored.where("label = 1 AND y_prob >= 0.5").count() > 30
