"""Conditioning, windowing and spectral operators (G1-G15, S12) on the given tables."""

import uuid

from pyspark.sql import Window, functions as F

from signalloom.catalog import views as v
from signalloom.catalog.core import VIEWS, query
from signalloom.functions import filters, spectral as sp
from signalloom.operators import align as al, features as ft, signals as sg
from signalloom.operators.sequences import sequences
from signalloom.session import scratch_dir
from signalloom.sources import tables

REC = ["subject_id", "edf_id"]
CHUNK_SIZE = 512


def chunks(spark, d, size=CHUNK_SIZE):
    return sg.to_chunks(v.signal(spark, d), REC, "i", "v", size)


def fir_sql(taps, keep: str = "TRUE", position: str = "a.i", source: str = "v_signal", extra: str = "") -> str:
    """A centred filter by definition; ``extra`` names a further key column such as ``ch``.

    Beyond its ends a recording is turned about its first and last sample.
    """
    half = (len(taps) - 1) // 2
    more = f"a.{extra}, " if extra else ""
    key = f"edf_id, {extra}" if extra else "edf_id"
    same = f" AND a.{extra} = b.{extra}" if extra else ""
    wide = f"""(SELECT {key}, unnest([{{'i': i, 'v': v}},
        CASE WHEN i BETWEEN 1 AND {half} THEN {{'i': -i, 'v': 2 * v0 - v}} END,
        CASE WHEN i < n AND i >= n - {half} THEN {{'i': 2 * n - i, 'v': 2 * vn - v}} END]) AS s
      FROM (SELECT *, max(i) OVER (PARTITION BY {key}) AS n, first_value(v) OVER w AS v0, last_value(v) OVER w AS vn FROM {source}
        WINDOW w AS (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))"""
    return f"""SELECT a.subject_id, a.edf_id, {more}{position} AS i, sum(b.v * t.taps[{half} + 1 + a.i - b.i]) AS v
    FROM {source} a JOIN (SELECT {key}, s.i AS i, s.v AS v FROM {wide} WHERE s IS NOT NULL) b
      ON a.edf_id = b.edf_id{same} AND abs(a.i - b.i) <= {half},
      (SELECT {[float(t) for t in taps]!r} AS taps) t WHERE {keep} GROUP BY a.subject_id, a.edf_id, {more}a.i"""


SAMPLE = "subject_id edf_id i:l v:6"
ANTIALIAS = filters.antialias(256.0, 2)
NOTCH = filters.notch()
BANDPASS = filters.bandpass()
SHORT = filters.lowpass(32.0, 16.0, 128.0)


@query("g1_decimate", SAMPLE, fir_sql(ANTIALIAS, "a.i % 2 = 0", "a.i // 2"))
def g1(spark, d):
    return sg.to_samples(sg.decimate_chunks(chunks(spark, d, 64), REC, ANTIALIAS, 2, 64), REC)


@query("g2_notch", SAMPLE, fir_sql(NOTCH))
def g2(spark, d):
    return sg.to_samples(sg.filter_chunks(chunks(spark, d), REC, NOTCH, CHUNK_SIZE), REC)


@query("g3_bandpass", SAMPLE, fir_sql(BANDPASS))
def g3(spark, d):
    return sg.to_samples(sg.filter_chunks(chunks(spark, d), REC, BANDPASS, CHUNK_SIZE), REC)


@query("g3_fir_chunk_borders", SAMPLE, fir_sql(SHORT))
def g3_borders(spark, d):
    """Chunks shorter than the recordings, so that borders matter."""
    return sg.to_samples(sg.filter_chunks(chunks(spark, d, 16), REC, SHORT, 16), REC)


@query("g3_fir_expression", SAMPLE, fir_sql(SHORT))
def g3_rows(spark, d):
    return sg.filter_samples(v.signal(spark, d), REC, "i", "v", SHORT, "y", 64).select(*REC, "i", F.col("y").alias("v"))


ZSCORE_SQL = """SELECT subject_id, edf_id, i, (v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-8) AS v
FROM v_signal WINDOW w AS (PARTITION BY subject_id, edf_id)"""


@query("g4_zscore", SAMPLE, ZSCORE_SQL)
def g4(spark, d):
    rows = v.signal(spark, d).select(*REC, "i", "v")
    return sg.zscore_samples(rows, REC, "v", "z").select(*REC, "i", F.col("z").alias("v"))


@query("g4_zscore_chunks", SAMPLE, ZSCORE_SQL)
def g4_chunks(spark, d):
    return sg.to_samples(sg.zscore_chunks(chunks(spark, d, 16), REC), REC)


WINDOW = "subject_id edf_id window_index:l start_sec:6 end_sec:6 k:l v:6"
WINDOW_SQL = """SELECT subject_id, edf_id, w AS window_index, w * 2.0 AS start_sec, w * 2.0 + 4.0 AS end_sec, i - 4 * w AS k, v
FROM (SELECT *, count(*) OVER (PARTITION BY subject_id, edf_id, w) AS n
      FROM (SELECT *, unnest([i // 4 - 1, i // 4]) AS w FROM v_signal) WHERE w >= 0) WHERE n = 8"""
SHAPE = {"rate": 2.0, "window_sec": 4.0, "overlap": 0.5}


def exploded(windows):
    return windows.select(*REC, "window_index", "start_sec", "end_sec", F.posexplode("signal").alias("k", "v"))


@query("g5_make_windows", WINDOW, WINDOW_SQL)
def g5(spark, d):
    return exploded(sg.make_windows(v.signal(spark, d), REC, "i", "v", **SHAPE))


@query("g5_windows_from_chunks", WINDOW, WINDOW_SQL)
def g5_chunks(spark, d):
    return exploded(sg.windows_from_chunks(chunks(spark, d, 16), REC, 16, **SHAPE))


VIEWS["v_hann"] = """
SELECT window_id, ch, k, v * (0.5 - 0.5 * cos(2 * pi() * k / 63)) AS h
FROM (SELECT window_id, 0 AS ch, ch * 16 + k AS k, v FROM v_sample)"""
VIEWS["v_power"] = """
SELECT window_id, bin, pow(sum(h * cos(2 * pi() * bin * k / 64)), 2) + pow(sum(h * sin(2 * pi() * bin * k / 64)), 2) AS power
FROM v_hann, range(33) r(bin) GROUP BY window_id, bin"""
VIEWS["v_band"] = """
SELECT window_id, b.pos, b.band, sum(power) AS power FROM v_power JOIN (VALUES (0, 'delta', 0.5, 4.0), (1, 'theta', 4.0, 8.0),
  (2, 'alpha', 8.0, 13.0), (3, 'beta', 13.0, 30.0), (4, 'gamma', 30.0, 40.0)) b(pos, band, lo, hi)
  ON bin * 2.0 >= b.lo AND bin * 2.0 < b.hi GROUP BY 1, 2, 3"""


def tapered(spark, d):
    return v.arrays(spark, d).withColumn("x", sp.hann(F.col("x"), 64))


def powers(spark, d):
    return tapered(spark, d).select("window_id", sp.rfft_power("x").alias("power"))


def bands(spark, d):
    return powers(spark, d).select("window_id", sp.band_power(F.col("power"), 64).alias("power"))


@query("g7_hann", "window_id:l k:l h:6", "SELECT * FROM v_hann")
def g7(spark, d):
    return tapered(spark, d).select("window_id", F.posexplode("x").alias("k", "h"))


@query("g8_rfft_power", "window_id:l bin:l power:6", "SELECT * FROM v_power")
def g8(spark, d):
    return powers(spark, d).select("window_id", F.posexplode("power").alias("bin", "power"))


@query("g9_band_power", "window_id:l pos:l power:6", "SELECT * FROM v_band")
def g9(spark, d):
    return bands(spark, d).select("window_id", F.posexplode("power").alias("pos", "power"))


LOG_SQL = "SELECT window_id, pos, CAST(ln(power + 1e-8) AS FLOAT) AS feature FROM v_band"


@query("g10_log_power", "window_id:l pos:l feature:4", LOG_SQL)
def g10(spark, d):
    logged = bands(spark, d).select("window_id", sp.log_power(F.col("power")).alias("f"))
    return logged.select("window_id", F.posexplode("f").alias("pos", "feature"))


def one_channel(spark, d):
    return v.arrays(spark, d).select("window_id", "label", F.array("x").alias("signal"), "x")


@query("g11_fft_features", "window_id:l pos:l feature:4 name",
       "SELECT window_id, pos, CAST(ln(power + 1e-8) AS FLOAT) AS feature, 'channel_1__' || band AS name FROM v_band")
def g11(spark, d):
    names = F.array(*[F.lit(n) for n in sp.feature_names(1)])
    rows = ft.with_band_features(one_channel(spark, d), 64).select(
        "window_id", F.posexplode("features").alias("pos", "feature")
    )
    return rows.withColumn("name", F.get(names, F.col("pos")))


@query(
    "g12_relative_band_power",
    "window_id:l pos:l share:6",
    "SELECT window_id, pos, power / sum(power) OVER (PARTITION BY window_id) AS share FROM v_band",
)
def g12(spark, d):
    shares = bands(spark, d).select("window_id", sp.relative_power(F.col("power")).alias("p"))
    return shares.select("window_id", F.posexplode("p").alias("pos", "share"))


@query(
    "g13_stft_power",
    "window_id:l frame:l bin:l db:4",
    """SELECT window_id, frame, bin - 1 AS bin, 10 * log10(pow(sum(h * cos(2 * pi() * bin * n / 16)), 2)
        + pow(sum(h * sin(2 * pi() * bin * n / 16)), 2) + 1e-6) AS db
    FROM (SELECT window_id, f AS frame, k - 4 * f AS n, v * (0.5 - 0.5 * cos(2 * pi() * (k - 4 * f) / 16)) / 8 AS h
      FROM (SELECT window_id, ch * 16 + k AS k, v FROM v_sample), range(13) r(f) WHERE k - 4 * f BETWEEN 0 AND 15),
      range(1, 6) b(bin) GROUP BY window_id, frame, bin""",
)
def g13(spark, d):
    frames = v.arrays(spark, d).select("window_id", F.posexplode(sp.stft_db(16, 4)("x")).alias("frame", "s"))
    return frames.select("window_id", "frame", F.posexplode("s").alias("bin", "db"))


@query(
    "g13_sliding_frames",
    "window_id:l frame:l k:l v:6",
    """SELECT window_id, f AS frame, ch * 16 + k - 4 * f AS k, v FROM v_sample, range(13) r(f)
    WHERE ch * 16 + k - 4 * f BETWEEN 0 AND 15""",
)
def g13_frames(spark, d):
    frames = v.arrays(spark, d).select("window_id", F.posexplode(sp.sliding_frames(F.col("x"), 16, 4)).alias("frame", "s"))
    return frames.select("window_id", "frame", F.posexplode("s").alias("k", "v"))


@query(
    "g14_fuse_features",
    "window_id:l pos:l value:4",
    """SELECT window_id, pos, (v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-5) AS value FROM (
      SELECT window_id, 0 AS part, ch * 16 + k AS pos, v FROM v_sample
      UNION ALL SELECT window_id, 1, 64 + pos, CAST(ln(power + 1e-8) AS FLOAT)::DOUBLE FROM v_band)
    WINDOW w AS (PARTITION BY window_id, part)""",
)
def g14(spark, d):
    a = v.arrays(spark, d).select("window_id", "x")
    b = ft.with_band_features(one_channel(spark, d), 64).select(
        "window_id", F.col("features").cast("array<double>").alias("f")
    )
    joined = a.join(b, "window_id").select("window_id", ft.fused(F.col("x"), F.col("f")).alias("z"))
    return joined.select("window_id", F.posexplode("z").alias("pos", "value"))


@query(
    "g15_w8_sequences",
    "subject_id edf_id start_index:l target_index:l target:l n_sum:l",
    """SELECT subject_id, edf_id, window_index - 2 AS start_index, window_index AS target_index, label AS target, n_sum
    FROM (SELECT *, lag(window_index, 2) OVER w AS first,
        sum(n) OVER (PARTITION BY subject_id, edf_id ORDER BY window_index ROWS 2 PRECEDING) AS n_sum
      FROM v_win WINDOW w AS (PARTITION BY subject_id, edf_id ORDER BY window_index)) WHERE first = window_index - 2""",
)
def g15(spark, d):
    made = sequences(v.windows(spark, d), 3, ["n"], chunk_size=32)
    return made.withColumn("n_sum", F.aggregate("steps", F.lit(0).cast("long"), lambda a, s: a + s["n"]))


@query(
    "s12_incremental_cache",
    "window_id:l pos:l feature:4",
    f"SELECT * FROM ({LOG_SQL}) WHERE window_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 0)",
)
def s12(spark, d):
    """Windows of class 0 are cached already; only the others are computed."""
    windows = one_channel(spark, d)
    cached = windows.where("label = 0").select("window_id")
    todo = ft.missing_features(windows, cached, ["window_id"])
    return ft.with_band_features(todo, 64).select("window_id", F.posexplode("features").alias("pos", "feature"))


@query("s12_cache_refresh", "window_id:l pos:l feature:4 copies:l", f"SELECT *, 1 AS copies FROM ({LOG_SQL})")
def s12_refresh(spark, d):
    """Three runs over one cache: some subjects, then all windows, then all of them again."""
    windows, path = v.arrays(spark, d).withColumn("signal", F.array("x")), scratch_dir(spark, "features")
    compute = lambda rows: ft.with_band_features(rows, 64).select("subject_id", "window_id", "features")
    for part in (windows.where("subject_id < 's06'"), windows, windows):
        tables.refresh_features(part, path, ["window_id"], "subject_id", compute, size=5)
    copies = F.count(F.lit(1)).over(Window.partitionBy("window_id")).alias("copies")
    cached = spark.read.parquet(path).select("window_id", "features", copies)
    return cached.select("window_id", F.posexplode("features").alias("pos", "feature"), "copies")


@query(
    "j1_bucketed_arrays",
    "window_id:l subject_id label:l total:4 first:4",
    """SELECT a.window_id, a.subject_id, a.label, list_sum(a.x) AS total, f.feature AS first
    FROM v_arr a JOIN (SELECT * FROM ("""
    + LOG_SQL
    + """) WHERE pos = 0) f ON f.window_id = a.window_id""",
)
def j1_buckets(spark, d):
    """Arrays and features lie in tables of one bucket count; neither is shuffled for the join."""
    windows, key, tag = v.arrays(spark, d).withColumn("signal", F.array("x")), ["window_id"], uuid.uuid4().hex[:12]
    written = {"windows": windows, "features": ft.with_band_features(windows, 64).select("window_id", "features")}
    for name, rows in written.items():
        tables.write_bucketed(rows, f"written_{name}_{tag}", scratch_dir(spark, name), key, 8)
    left, right = (spark.table(f"written_{name}_{tag}") for name in written)
    total = F.aggregate(F.element_at("signal", 1), F.lit(0.0), lambda a, x: a + x)
    joined = al.aligned(left, right, key)
    return joined.select("window_id", "subject_id", "label", total.alias("total"), F.element_at("features", 1).alias("first"))
