import random

import numpy as np
import pytest

from signalloom.operators import distribution as dist, metrics as m


def scores(spark, rows):
    return spark.createDataFrame(rows, "g string, y_true int, y_prob double")


def random_rows(seed=0, n=800, groups=4):
    rng = random.Random(seed)
    return [(f"g{i % groups if i % 3 else 0}", int(rng.random() < 0.2), round(rng.random() ** 3, 2)) for i in range(n)]


def brute(rows):
    y = np.array([r[1] for r in rows])
    p = np.array([r[2] for r in rows])
    pos, neg = p[y == 1], p[y == 0]
    if not len(pos) or not len(neg):
        return None, None
    diff = pos[:, None] - neg[None, :]
    auc = ((diff > 0).sum() + 0.5 * (diff == 0).sum()) / (len(pos) * len(neg))
    ap, seen = 0.0, 0
    for t in sorted(set(p), reverse=True):
        tp = (pos >= t).sum()
        ap += (tp - seen) / len(pos) * tp / (p >= t).sum()
        seen = tp
    return auc, ap


def test_ranking_metrics_equal_brute_force(spark):
    rows = random_rows() + [("only", 0, 0.3), ("only", 0, 0.4)]
    for r in m.ranking_metrics(scores(spark, rows), ["g"]).collect():
        mine = [x for x in rows if x[0] == r["g"]]
        auc, ap = brute(mine)
        assert r["n"] == len(mine) and r["brier"] == pytest.approx(np.mean([(x[2] - x[1]) ** 2 for x in mine]))
        if auc is None:
            assert r["roc_auc"] is None and r["pr_auc"] is None
        else:
            assert r["roc_auc"] == pytest.approx(auc) and r["pr_auc"] == pytest.approx(ap)
    whole = m.ranking_metrics(scores(spark, rows)).first()
    assert (whole["roc_auc"], whole["pr_auc"]) == pytest.approx(brute(rows))


def test_grids():
    assert [len(m.threshold_grid(n)) for n in ("hundredths", "fine", "finest")] == [99, 109, 118]
    assert m.threshold_grid("fine")[-1] == 1.0 and m.threshold_grid("hundredths")[-1] == 0.99
    grid = m.linear_grid()
    assert len(grid) == 50 and grid[0] == 0.01 and grid[-1] == 0.5


@pytest.mark.parametrize("name", ["hundredths", "finest"])
def test_sweep_equals_brute_force(spark, name):
    rows = random_rows(3, 400) + [("g0", 1, 1.0), ("g0", 0, 0.99), ("g1", 1, 0.0)]
    grid = m.threshold_grid(name)
    got = {r["threshold"]: r for r in m.threshold_sweep(scores(spark, rows), grid).collect()}
    assert sorted(got) == grid
    for t in grid:
        tp = sum(y and p >= t for _, y, p in rows)
        fp = sum((not y) and p >= t for _, y, p in rows)
        fn = sum(y and p < t for _, y, p in rows)
        r = got[t]
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (tp, fp, fn, len(rows) - tp - fp - fn)
        assert r["precision"] == pytest.approx(tp / (tp + fp) if tp + fp else 0.0)
        assert r["f1"] == pytest.approx(2 * tp / (2 * tp + fp + fn) if tp else 0.0)


def test_published_sweep_row(spark):
    counts = spark.createDataFrame([(182, 88, 452, 155943)], "tp long, fp long, fn long, tn long")
    assert m.with_rates(counts).first()["f1"] == pytest.approx(0.402655, abs=1e-6)


def test_best_threshold_takes_the_lowest_of_equals(spark):
    sweep = spark.createDataFrame([(0.2, 0.5, 1), (0.1, 0.5, 2), (0.3, 0.4, 3)], "threshold double, f1 double, tp int")
    assert m.best_threshold(sweep).first()["threshold"] == 0.1


def test_frozen_threshold_is_inclusive(spark):
    test = scores(spark, [("g", 1, 0.5), ("g", 0, 0.49)])
    chosen = spark.createDataFrame([(0.5,)], "threshold double")
    assert [r["y_pred"] for r in m.apply_frozen_threshold(test, chosen).orderBy("y_prob").collect()] == [0, 1]


def test_calibration_edges(spark):
    got = {r["bin"]: r["n"] for r in m.calibration(scores(spark, [("g", 0, p) for p in (0.0, 0.1, 0.11, 1.0)])).collect()}
    assert got == {0: 2, 1: 1, 9: 1}
    # 0.7 is below the computed edge 7 * 0.1, although 0.7 * 10 exceeds 7.
    assert m.calibration(scores(spark, [("g", 0, 0.7)])).first()["bin"] == 6


def test_best_run_keeps_the_first_of_equals(spark):
    runs = spark.createDataFrame([(1, 0.2), (2, 0.4), (3, 0.4), (4, None)], "run int, pr_auc double")
    assert m.select_best_run(runs).first()["run"] == 2


def test_percentiles_follow_numpy(spark):
    rows = random_rows(9, 1000)
    got = {r["g"]: r for r in dist.exact_percentiles(scores(spark, rows), ["g"], "y_prob", dist.PERCENTILES).collect()}
    for g in {r[0] for r in rows}:
        values = [r[2] for r in rows if r[0] == g]
        for name, q in dist.PERCENTILES.items():
            assert got[g][name] == pytest.approx(np.percentile(values, 100 * q))


def test_exceedance_is_strict(spark):
    rows = dist.exceedances(scores(spark, [("g", 1, 0.5), ("g", 1, 0.51), ("g", 0, 0.9)])).collect()
    at = {r["cutoff"]: r for r in rows}[0.5]
    assert (at["n_above"], at["positives_above"], at["positives_pct"]) == (2, 1, 50.0)


def test_sweep_has_no_pair_join(spark):
    plan = m.threshold_sweep(scores(spark, random_rows(1, 10)), m.threshold_grid())._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
