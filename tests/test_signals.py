import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.functions import filters, spectral as sp
from signalloom.operators import features as ft, signals as sg
from signalloom.plans.recording_windows import incomplete_recordings

REC = ["rec"]


def samples(spark, lengths, seed=0):
    rng = np.random.default_rng(seed)
    data = {f"r{k}": rng.normal(size=n) for k, n in enumerate(lengths)}
    rows = [(rec, i, float(v)) for rec, x in data.items() for i, v in enumerate(x)]
    return data, spark.createDataFrame(rows, "rec string, i long, v double")


def read(df, position="i", value="v"):
    out = {}
    for r in df.orderBy("rec", position).collect():
        out.setdefault(r["rec"], []).append(r[value])
    return out


def centred(x, taps):
    """Convolution with both ends turned about the end sample, zeros beyond the reflection."""
    half = (len(taps) - 1) // 2
    wide = np.zeros(len(x) + 2 * half)
    for k in range(-half, len(x) + half):
        if 0 <= k < len(x):
            wide[k + half] = x[k]
        elif -len(x) < k < 0:
            wide[k + half] = 2 * x[0] - x[-k]
        elif len(x) <= k < 2 * len(x) - 1:
            wide[k + half] = 2 * x[-1] - x[2 * (len(x) - 1) - k]
    return np.convolve(wide, taps)[2 * half : 2 * half + len(x)]


@pytest.mark.parametrize("size", [20, 64, 4096])
def test_chunked_filter_equals_the_whole_recording(spark, size):
    data, df = samples(spark, [1, 19, 20, 21, 333])
    taps = filters.lowpass(32.0, 16.0, 128.0)
    chunks = sg.to_chunks(df, REC, "i", "v", size)
    got = read(sg.to_samples(sg.filter_chunks(chunks, REC, taps, size), REC))
    rows = read(sg.filter_samples(df, REC, "i", "v", taps, "y", size), value="y")
    for rec, x in data.items():
        np.testing.assert_allclose(got[rec], centred(x, taps), atol=1e-12)
        np.testing.assert_allclose(rows[rec], centred(x, taps), atol=1e-12)


def test_filter_guards(spark):
    _, df = samples(spark, [10])
    chunks = sg.to_chunks(df, REC, "i", "v", 4)
    with pytest.raises(ValueError):
        sg.filter_chunks(chunks, REC, [1.0] * 11, 4)
    with pytest.raises(ValueError):
        sg.filter_chunks(chunks, REC, [1.0, 1.0], 4)


def gain(taps, hz, rate):
    n = np.arange(len(taps)) - (len(taps) - 1) / 2
    return float(np.sum(np.asarray(taps) * np.cos(2 * math.pi * hz / rate * n)))


def test_responses():
    band = filters.bandpass()
    assert len(band) == 845 and abs(gain(band, 0.0, 128)) < 0.01 and abs(gain(band, 60.0, 128)) < 0.01
    assert all(abs(gain(band, hz, 128) - 1) < 0.01 for hz in (1, 10, 25, 39))
    stop = filters.notch()
    assert abs(gain(stop, 60.0, 128)) < 0.01 and all(abs(gain(stop, hz, 128) - 1) < 0.01 for hz in (0, 10, 50, 58))
    half = filters.antialias(256.0, 2)
    assert gain(half, 10, 256) == pytest.approx(1, abs=0.01) and abs(gain(half, 70, 256)) < 0.01


def test_decimation_keeps_every_second_sample(spark):
    data, df = samples(spark, [101])
    taps = filters.antialias(256.0, 2)
    chunks = sg.decimate_chunks(sg.to_chunks(df, REC, "i", "v", 64), REC, taps, 2, 64)
    got = sg.to_samples(chunks, REC).orderBy("i").collect()
    assert [r["i"] for r in got] == list(range(51))
    np.testing.assert_allclose([r["v"] for r in got], centred(data["r0"], taps)[::2], atol=1e-12)


@pytest.mark.parametrize("size", [64, 4096])
def test_a_chain_equals_one_filter_after_the_other(spark, size):
    data, df = samples(spark, [1, 63, 64, 65, 700])
    first, second = filters.antialias(256.0, 2)[:41], filters.lowpass(20.0, 40.0, 128.0)
    first = first[:21] if len(first) % 2 == 0 else first
    chunks = sg.to_chunks(df, REC, "i", "v", size)
    got = read(sg.to_samples(sg.filter_chain(chunks, REC, [(first, 2), (second, 1)], size), REC))
    for rec, x in data.items():
        np.testing.assert_allclose(got[rec], centred(centred(x, first)[::2], second), atol=1e-12)


def test_zscore_uses_population_std(spark):
    data, df = samples(spark, [50, 7])
    flat = df.unionByName(spark.createDataFrame([("flat", i, 3.0) for i in range(5)], df.schema))
    got = read(sg.to_samples(sg.zscore_chunks(sg.to_chunks(flat, REC, "i", "v", 8), REC), REC))
    rows = read(sg.zscore_samples(flat, REC, "v", "z"), value="z")
    for rec, x in data.items():
        want = (x - x.mean()) / (x.std() + 1e-8)
        np.testing.assert_allclose(got[rec], want, atol=1e-9)
        np.testing.assert_allclose(rows[rec], want, atol=1e-9)
    assert got["flat"] == [0.0] * 5


@pytest.mark.parametrize("lengths", [[7, 8, 9, 11, 12, 40]])
def test_windows_drop_the_partial_tail(spark, lengths):
    data, df = samples(spark, lengths)
    shape = {"rate": 2.0, "window_sec": 4.0, "overlap": 0.5}
    want = {
        (rec, w): x[4 * w : 4 * w + 8].tolist() for rec, x in data.items() for w in range(max(0, (len(x) - 8) // 4 + 1))
    }
    plain = sg.make_windows(df, REC, "i", "v", **shape)
    sliced = sg.windows_from_chunks(sg.to_chunks(df, REC, "i", "v", 16), REC, 16, **shape)
    for table in (plain, sliced):
        rows = table.collect()
        assert {(r["rec"], r["window_index"]): r["signal"] for r in rows} == want
        assert all(r["start_sec"] == 2.0 * r["window_index"] and r["end_sec"] == r["start_sec"] + 4 for r in rows)
    assert ("r0", 0) not in want  # shorter than one window


def test_stacked_channels_keep_their_order(spark):
    rows = [("w", c, [float(c)]) for c in (2, 0, 1)]
    df = spark.createDataFrame(rows, "w string, channel_pos int, signal array<double>")
    assert sg.stack_channels(df, ["w"]).first()["signal"] == [[0.0], [1.0], [2.0]]


def test_bins_and_bands():
    assert len(np.fft.rfftfreq(512)) == 257 and len(sp.useful_bins()) == 159
    assert [n for _, n in sp.band_bins().values()] == [14, 16, 20, 68, 40]
    assert len(sp.feature_names(23)) == 115 and sp.feature_names(["FP1-F7"])[1] == "FP1-F7__theta"
    with pytest.raises(ValueError):
        sp.band_bins(16)


def test_sine_energy_lands_in_theta(spark):
    t = np.arange(512) / 128.0
    signal = [[float(v) for v in np.sin(2 * math.pi * 6 * t)], [float(v) for v in np.sin(2 * math.pi * 40.0 * t)]]
    df = spark.createDataFrame([(1, signal)], "w int, signal array<array<double>>")
    got = ft.with_band_features(df, channels=2).first()["features"]
    assert len(got) == 10 and max(range(5), key=lambda b: got[b]) == 1
    power = df.select(sp.rfft_power(sp.hann(F.col("signal")[1], 512)).alias("p")).select(
        "p", sp.band_power(F.col("p")).alias("b")
    ).first()
    assert len(power["p"]) == 257
    # The bin at exactly 40 Hz holds the peak but belongs to no band.
    assert power["p"][160] == max(power["p"]) and sum(power["b"]) < power["p"][160]


def test_features_of_a_full_window_equal_numpy(spark):
    x = np.random.default_rng(1).normal(size=(3, 23, 512)).astype(np.float32)
    df = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(x)], "w int, signal array<array<float>>")
    taper, freqs = np.hanning(512), np.fft.rfftfreq(512, 1 / 128)
    for r in ft.with_band_features(df, channels=23).collect():
        power = np.abs(np.fft.rfft(x[r["w"]] * taper, axis=1)) ** 2
        want = [
            np.log(power[c][(freqs >= lo) & (freqs < hi)].sum() + 1e-8) for c in range(23) for lo, hi in sp.BANDS.values()
        ]
        np.testing.assert_allclose(r["features"], want, rtol=1e-5)


@pytest.mark.parametrize(
    "signal, channels", [([[0.0] * 511], 1), ([[float("nan")] + [0.0] * 511], 1), ([[0.0] * 512], 2)]
)
def test_bad_windows_raise(spark, signal, channels):
    df = spark.createDataFrame([(1, signal)], "w int, signal array<array<double>>")
    with pytest.raises(Exception):
        ft.with_band_features(df, channels=channels).collect()


def test_stft_shape_and_short_windows(spark):
    df = spark.createDataFrame([(1, [0.5] * 512), (2, [1.0] * 100), (3, None)], "w int, x array<double>")
    got = {r["w"]: r["s"] for r in df.select("w", sp.stft_db()("x").alias("s")).collect()}
    assert len(got[1]) == 25 and len(got[1][0]) == 40 and got[2] == [] and got[3] is None


def test_layer_norm_and_relative_power(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0],)], "x array<double>")
    row = df.select(sp.layer_norm(F.col("x")).alias("n"), sp.relative_power(F.col("x")).alias("p")).first()
    x = np.array([1.0, 2.0, 4.0])
    np.testing.assert_allclose(row["n"], (x - x.mean()) / np.sqrt(x.var() + 1e-5))
    np.testing.assert_allclose(row["p"], x / x.sum())
    empty = spark.createDataFrame([([0.0, 0.0],)], "x array<double>").select(sp.relative_power(F.col("x")).alias("p"))
    assert empty.first()["p"] is None


def test_cache_misses_by_key_and_by_shape(spark):
    windows = spark.range(5).withColumnRenamed("id", "w")
    cached = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "w long, features array<double>")
    ids = lambda df: sorted(r["w"] for r in df.collect())
    assert ids(ft.missing_features(windows, cached, ["w"])) == [2, 3, 4]
    assert ids(ft.missing_features(windows, cached, ["w"], size=2)) == [1, 2, 3, 4]
    assert ids(ft.missing_features(windows, cached, ["w"], force=True)) == [0, 1, 2, 3, 4]


def test_a_constant_offset_leaves_no_step_at_the_ends(spark):
    df = spark.range(300).selectExpr("'r' AS rec", "id AS i", "5D AS v")
    taps = filters.lowpass(32.0, 16.0, 128.0)
    got = read(sg.to_samples(sg.filter_chunks(sg.to_chunks(df, REC, "i", "v", 64), REC, taps, 64), REC))["r"]
    np.testing.assert_allclose(got, [5.0 * sum(taps)] * 300, atol=1e-9)


def test_gaps_are_refused_inside_a_chunk_and_end_a_recording_between_chunks(spark):
    def chunks(positions):
        df = spark.createDataFrame([("r", i, float(i % 7)) for i in positions], "rec string, i long, v double")
        return df, sg.to_chunks(df, REC, "i", "v", 16)

    shape = {"rate": 2.0, "window_sec": 4.0, "overlap": 0.5}
    for positions in ([*range(16), *range(20, 32)], [0, 1, 3, 4]):
        with pytest.raises(Exception, match="samples are missing"):
            chunks(positions)[1].collect()
    whole = [*range(12), *range(16, 48)]  # the first chunk ends early
    df, cut = chunks(whole)
    got = {r["window_index"]: r["signal"] for r in sg.windows_from_chunks(cut, REC, 16, **shape).collect()}
    assert got == {r["window_index"]: r["signal"] for r in sg.make_windows(df, REC, "i", "v", **shape).collect()}
    taps = filters.lowpass(32.0, 16.0, 128.0)[2:-2]
    half = (len(taps) - 1) // 2
    assert half <= 16
    found = read(sg.to_samples(sg.filter_chunks(cut, REC, taps, 16), REC))["r"]
    apart = [np.array([float(i % 7) for i in part]) for part in (range(12), range(16, 48))]
    np.testing.assert_allclose(found, np.concatenate([centred(x, taps) for x in apart]), atol=1e-12)


def test_a_large_offset_costs_no_digits(spark):
    x = 1e8 + np.random.default_rng(3).normal(size=64) * 1e-2
    df = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(x)], "rec string, i long, v double")
    got = read(sg.to_samples(sg.zscore_chunks(sg.to_chunks(df, REC, "i", "v", 8), REC), REC))["r"]
    np.testing.assert_allclose(got, (x - x.mean()) / (x.std() + 1e-8), atol=1e-5)


def test_moments_of_a_chain_are_those_of_its_samples(spark):
    data, df = samples(spark, [700, 90])
    taps = filters.lowpass(32.0, 16.0, 128.0)
    made = sg.filter_chain(sg.to_chunks(df, REC, "i", "v", 64), REC, [(taps, 1)], 64, with_moments=True)
    plain = read(sg.to_samples(sg.zscore_chunks(made.drop("n", "mean", "squares"), REC), REC))
    given = read(sg.to_samples(sg.zscore_chunks(made, REC), REC))
    for rec in data:
        np.testing.assert_allclose(given[rec], plain[rec], atol=1e-9)


def test_incomplete_recordings_are_named(spark):
    rows = [("s", r, c, [0.0] * n) for r, c, n in (("a", 0, 4), ("a", 1, 4), ("b", 0, 4), ("c", 0, 4), ("c", 1, 3))]
    df = spark.createDataFrame(rows, "subject_id string, edf_id string, channel_pos int, samples array<double>")
    got = {r.edf_id: r.reason for r in incomplete_recordings(df, 2).collect()}
    assert got == {"b": "1 channels instead of 2", "c": "channels of different lengths"}
