"""Chosen designs against the obvious ones, on the same tables.

    BENCH_SF_DIR=/root/testdata/sf0.1 python bench_compare.py

The obvious forms exist only here, for the comparison; they do not scale.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F, types as T  # noqa: E402
from pyspark.sql.window import Window  # noqa: E402

from signalloom.catalog import views as v  # noqa: E402
from signalloom.functions.spectral import BANDS  # noqa: E402
from signalloom.operators import events as ev, features as ft, metrics as m  # noqa: E402
from signalloom.operators.intervals import label_windows  # noqa: E402
from signalloom.session import build_session, set_scratch, settle  # noqa: E402


def pair_sweep(scores, grid):
    """Every score beside every threshold."""
    rows = scores.select("y_true", "y_prob", F.explode(F.array(*[F.lit(t) for t in grid])).alias("threshold"))
    hit = F.col("y_prob") >= F.col("threshold")
    return m.with_rates(
        rows.groupBy("threshold").agg(
            F.count_if(hit & (F.col("y_true") == 1)).alias("tp"),
            F.count_if(hit & (F.col("y_true") == 0)).alias("fp"),
            F.count_if(~hit & (F.col("y_true") == 1)).alias("fn"),
            F.count_if(~hit & (F.col("y_true") == 0)).alias("tn"),
        )
    )


@F.udf(T.ArrayType(T.FloatType()))
def row_features(signal):
    """One window per Python call."""
    out = []
    for trace in signal:
        power = np.abs(np.fft.rfft(np.asarray(trace) * np.hanning(len(trace)))) ** 2
        freqs = np.fft.rfftfreq(len(trace), 1 / 128)
        out += [float(np.log(power[(freqs >= lo) & (freqs < hi)].sum() + 1e-8)) for lo, hi in BANDS.values()]
    return out


def one_task_ranking(scores):
    """Running counts over one global order."""
    counts = scores.groupBy("y_prob").agg(F.sum("y_true").alias("p"), F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.col("y_prob").desc())
    run = counts.withColumn("tp", F.sum("p").over(w)).withColumn("sel", F.sum("n").over(w))
    return run.agg(F.sum((F.col("n") - F.col("p")) * (F.col("tp") - F.col("p") / 2)), F.sum(F.col("p") * F.col("tp") / F.col("sel")))


def recording_sessions(pred):
    """A whole recording per window."""
    keys = ev.KEYS
    w = Window.partitionBy(*keys).orderBy("start_sec")
    fresh = F.coalesce((F.col("start_sec") - F.lag("start_sec").over(w) > 4.000001).cast("int"), F.lit(1))
    marked = pred.where("y_pred = 1").withColumn("_f", fresh).withColumn("_s", F.sum("_f").over(w))
    return marked.groupBy(*keys, "_s").agg(F.min("start_sec"), F.max("end_sec"), F.min_by("end_sec", "start_sec"), F.count(F.lit(1)))


def recording_labels(pred, marks):
    """Windows and annotations of a recording joined on the recording alone."""
    a = marks.select(*ev.KEYS, F.col("start_sec").alias("s"), F.col("end_sec").alias("e"))
    hit = (pred.subject_id == a.subject_id) & (pred.edf_id == a.edf_id) & (a.s < pred.end_sec) & (a.e > pred.start_sec)
    return pred.join(a, hit, "left_semi")


def compare(spark, sf_dir: str, copies: int = 20, runs: int = 3) -> dict[str, float]:
    """Median seconds of each step in the chosen and in the obvious form."""
    # The given windows, repeated along time; the copies continue each recording.
    base = v.predictions(spark, sf_dir)
    longest = base.agg(F.max("start_sec") + 100).scalar()
    many = base.withColumn("_long", longest).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    shift = F.col("_k") * F.col("_long")
    pred = settle(
        many.withColumn("start_sec", F.col("start_sec") + shift).withColumn("end_sec", F.col("end_sec") + shift)
        .withColumn("y_prob", F.col("y_prob") + F.col("_k") / 1e7).drop("_k", "_long"),
        "compare",
    )
    marks = settle(v.marks_of(pred), "compare_marks")
    grid = m.threshold_grid()
    x = v.arrays(spark, sf_dir).withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    windows = settle(x.repartition(8).select("window_id", F.array("x").alias("signal")), "compare_windows")

    def label():
        return label_windows(pred, marks, ev.KEYS, 4.0).where("label = 1")

    pairs = {
        "sweep": (lambda: m.threshold_sweep(pred, grid), lambda: pair_sweep(pred, grid)),
        "band_features": (
            lambda: ft.with_band_features(windows, 64),
            lambda: windows.withColumn("features", row_features("signal")),
        ),
        "ranking": (lambda: m.ranking_metrics(pred), lambda: one_task_ranking(pred)),
        "sessions": (lambda: ev.alarm_sessions(pred), lambda: recording_sessions(pred)),
        "labels": (label, lambda: recording_labels(pred, marks)),
    }
    out = {"windows": pred.count()}
    for name, forms in pairs.items():
        for kind, form in zip(("chosen", "obvious"), forms):
            took = []
            for _ in range(runs):
                began = time.perf_counter()
                form().write.format("noop").mode("overwrite").save()
                took.append(time.perf_counter() - began)
            out[f"{name}_{kind}"] = round(statistics.median(took), 3)
    return out


def main() -> None:
    spark = build_session(
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    set_scratch(spark)
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    print(json.dumps(compare(spark, sf_dir, int(os.environ.get("BENCH_COPIES", "20")))))


if __name__ == "__main__":
    main()
