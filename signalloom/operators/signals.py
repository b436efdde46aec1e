"""Signal conditioning and windowing.

Signals come as samples ``(keys, position, value)`` or as chunks ``(keys,
chunk_id, samples)`` of a fixed size. Borders between chunks are bridged by
copying short tails and heads, never by gathering a recording.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from signalloom.functions.scalars import array_mean, array_var
from signalloom.operators.ordered import CHUNK, cut, matched, with_halo


def to_chunks(samples: DataFrame, keys: Sequence[str], position: str, value: str, size: int) -> DataFrame:
    """Pack samples into arrays of at most ``size`` consecutive positions.

    A chunk must begin at a multiple of ``size`` and hold every position up to its
    last one; positions may only be missing at its end, where a gap or the end of the
    recording begins. Anything else is an error, since arrays would close it up.
    """
    first, n = F.element_at("_s", 1)[position], F.size("_s")
    whole = (first == F.col("chunk_id") * size) & (F.element_at("_s", -1)[position] - first + 1 == n)
    refused = F.raise_error(F.lit("samples are missing inside a chunk; make_windows takes such signals"))
    return (
        samples.select(*keys, F.floor(F.col(position) / size).alias("chunk_id"), position, value)
        .groupBy(*keys, "chunk_id")
        .agg(F.array_sort(F.collect_list(F.struct(position, F.col(value).cast("double").alias("v")))).alias("_s"))
        .select(
            *keys,
            "chunk_id",
            F.element_at("_s", 1)[position].alias("first_position"),
            F.when(whole, F.transform("_s", lambda s: s["v"])).otherwise(refused).alias("samples"),
        )
    )


def to_samples(chunks: DataFrame, keys: Sequence[str], position: str = "i", value: str = "v") -> DataFrame:
    rows = chunks.select(*keys, "first_position", F.posexplode("samples").alias("_k", value))
    return rows.select(*keys, (F.col("first_position") + F.col("_k")).alias(position), value)


def with_borders(chunks: DataFrame, keys: Sequence[str], chunk_size: int, behind: int, ahead: int) -> DataFrame:
    """Add ``before``/``after``: the neighbouring samples of each chunk.

    Each chunk sends its tail to the next and its head to the previous chunk;
    one shuffle brings the pieces together, and the input is read once. A chunk
    shorter than ``chunk_size`` is followed by a gap or by nothing: it has no
    ``after`` and sends no tail.
    """
    full = F.size("samples") == chunk_size
    none = F.lit(None).cast("array<double>")
    own = F.struct(
        F.col("chunk_id").alias("to"),
        "first_position",
        F.col("samples").alias("mid"),
        none.alias("left"),
        none.alias("right"),
    )

    def border(to: Column, left: Column, right: Column) -> Column:
        return F.struct(
            to.alias("to"),
            F.lit(None).cast("long").alias("first_position"),
            none.alias("mid"),
            left.alias("left"),
            right.alias("right"),
        )

    pieces = [own]
    if behind:
        if behind > chunk_size:
            raise ValueError("chunks must hold at least the border")
        tail = F.when(full, F.slice("samples", chunk_size - behind + 1, behind))
        pieces.append(border(F.col("chunk_id") + 1, tail, none))
    if ahead:
        pieces.append(border(F.col("chunk_id") - 1, none, F.slice("samples", 1, ahead)))
    nothing = F.array().cast("array<double>")
    slim = chunks.select(*keys, "chunk_id", F.col("first_position").cast("long"), F.col("samples").cast("array<double>"))
    return (
        slim.select(*keys, F.inline(F.array(*pieces)))
        .groupBy(*keys, F.col("to").alias("chunk_id"))
        .agg(
            F.max("first_position").alias("first_position"),
            F.first("mid", ignorenulls=True).alias("samples"),
            F.first("left", ignorenulls=True).alias("before"),
            F.first("right", ignorenulls=True).alias("after"),
        )
        .where(F.col("samples").isNotNull())
        .withColumn("before", F.coalesce("before", nothing))
        .withColumn("after", F.coalesce(F.when(full, F.col("after")), nothing))
    )


def reflected(x: np.ndarray, half: int, at_start: bool, at_end: bool) -> np.ndarray:
    """``half`` more samples on either side: turned about the end sample at the ends of
    a recording as far as it reaches, zeros beyond that and at a cut edge."""
    out = np.zeros(len(x) + 2 * half)
    out[half : half + len(x)] = x
    n = min(half, len(x) - 1)
    if n > 0 and at_start:
        out[half - n : half] = 2 * x[0] - x[n:0:-1]
    if n > 0 and at_end:
        out[half + len(x) : half + len(x) + n] = 2 * x[-1] - x[-2 : -2 - n : -1]
    return out


FILTERED = "samples array<double>, n long, mean double, squares double"


def _chain(stages: Sequence[tuple[Sequence[float], int]], border: int):
    kernels = [(np.asarray(taps, dtype=np.float64), factor) for taps, factor in stages]
    spectra: dict[tuple[int, int], np.ndarray] = {}

    def centred(x: np.ndarray, stage: int, at_start: bool, at_end: bool) -> np.ndarray:
        kernel = kernels[stage][0]
        half = (len(kernel) - 1) // 2
        wide = reflected(x, half, at_start, at_end)
        size = 1 << (len(wide) + len(kernel) - 2).bit_length()
        if (stage, size) not in spectra:
            spectra[stage, size] = np.fft.rfft(kernel, size)
        return np.fft.irfft(np.fft.rfft(wide, size) * spectra[stage, size], size)[2 * half : 2 * half + len(x)]

    @F.arrow_udf(FILTERED)
    def apply(before: pa.Array, samples: pa.Array, after: pa.Array) -> pa.Array:
        out, moments = [], []
        for parts in zip(before, samples, after):
            left, mid, right = (p.values.to_numpy(zero_copy_only=False) for p in parts)
            x, start, stop = np.concatenate((left, mid, right)), len(left), len(left) + len(mid)
            # Errors of a cut edge reach half a kernel inwards; the border holds them.
            at_start, at_end = len(left) < border, len(right) < border
            for stage, (_, factor) in enumerate(kernels):
                x = centred(x, stage, at_start, at_end)[::factor]
                start, stop = start // factor, -(-stop // factor)
            own = x[start:stop].copy()  # a part alone would keep the whole transform in memory until the batch ends
            out.append(own)
            mean = float(own.mean()) if len(own) else 0.0
            moments.append((len(own), mean, float(((own - mean) ** 2).sum())))
        n, mean, squares = zip(*moments) if moments else ((), (), ())
        offsets = pa.array(np.cumsum([0, *n]), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*out, np.zeros(0)])))
        arrays = [lists, pa.array(n, pa.int64()), pa.array(mean, pa.float64()), pa.array(squares, pa.float64())]
        return pa.StructArray.from_arrays(arrays, ["samples", "n", "mean", "squares"])

    # evaluated once, whatever reads its fields
    return apply.asNondeterministic()


def filter_chain(
    chunks: DataFrame,
    keys: Sequence[str],
    stages: Sequence[tuple[Sequence[float], int]],
    chunk_size: int,
    with_moments: bool = False,
) -> DataFrame:
    """Apply centred odd-length filters one after the other, each keeping every
    ``factor``-th sample: ``stages`` lists ``(taps, factor)``.

    At every stage a recording goes on beyond its ends as its reflection about the
    end sample (``2 * end - x``), as far as it reaches, and as zeros from there. A gap
    ends a recording. The border of a chunk covers all stages together, so the whole
    chain costs one shuffle. ``with_moments`` keeps each chunk's count, mean and squared
    deviation, which :func:`zscore_chunks` then need not work out again.
    """
    border, step = 0, 1
    for taps, factor in stages:
        if len(taps) % 2 == 0:
            raise ValueError("a centred filter needs an odd number of taps")
        border += (len(taps) - 1) // 2 * step
        step *= factor
    border = -(-border // step) * step
    if chunk_size % step:
        raise ValueError("the chunk size must be a multiple of the factors")
    if border > chunk_size:
        raise ValueError(f"chunks must hold at least the border of {border} samples")
    filtered = _chain(stages, border)("before", "samples", "after")
    moments = ["_f.n", "_f.mean", "_f.squares"] if with_moments else []
    return with_borders(chunks, keys, chunk_size, border, border).withColumn("_f", filtered).select(
        *keys, "chunk_id", (F.col("first_position") / step).cast("long").alias("first_position"), "_f.samples", *moments
    )


def filter_chunks(chunks: DataFrame, keys: Sequence[str], taps: Sequence[float], chunk_size: int) -> DataFrame:
    """Apply one symmetric odd-length FIR without phase shift."""
    return filter_chain(chunks, keys, [(taps, 1)], chunk_size)


def filter_samples(
    samples: DataFrame,
    keys: Sequence[str],
    position: str,
    value: str,
    taps: Sequence[float],
    out: str,
    chunk_size: int = 65_536,
) -> DataFrame:
    """The same filter as a plain expression over samples, for short kernels.

    Positions begin at 0 and have no gaps. The reflections beyond an end are further
    rows of the first and last chunk, made from the samples next to that end.
    """
    half = (len(taps) - 1) // 2
    ends = samples.groupBy(*keys).agg(F.max(position).alias("_last"))
    at = F.col(position)
    # the mirrored positions of a sample: about the first and about the last one
    mirror = F.array_compact(
        F.array(
            F.struct(at.alias("_to"), F.lit(True).alias("_real")),
            F.when((at > 0) & (at <= half), F.struct((-at).alias("_to"), F.lit(False).alias("_real"))),
            F.when((at < F.col("_last")) & (at >= F.col("_last") - half),
                   F.struct((2 * F.col("_last") - at).alias("_to"), F.lit(False).alias("_real"))),
        )
    )
    edges = samples.select(*keys, at.alias("_at"), F.col(value).cast("double").alias("_edge"))
    known = matched(samples, ends, keys)
    known = matched(known, edges.where("_at = 0").drop("_at").withColumnRenamed("_edge", "_v0"), keys)
    last = matched(edges, ends, keys).where("_at = _last").select(*keys, F.col("_edge").alias("_vn"))
    rows = matched(known, last, keys).withColumn("_m", F.explode(mirror)).select("*", "_m._to", "_m._real").drop("_m")
    turned = F.when(F.col("_real"), F.col(value)).when(F.col("_to") < 0, 2 * F.col("_v0") - F.col(value)).otherwise(2 * F.col("_vn") - F.col(value))
    spread = cut(with_halo(rows.withColumn("_x", turned), "_to", chunk_size, behind=half, ahead=half), keys)
    w = Window.partitionBy(*keys, CHUNK).orderBy("_to").rangeBetween
    total = F.lit(0.0)
    for k, tap in enumerate(taps):
        shift = half - k
        total = total + F.lit(float(tap)) * F.coalesce(F.sum("_x").over(w(-shift, -shift)), F.lit(0.0))
    kept = spread.withColumn(out, total).where(F.col("_own") & F.col("_real"))
    return kept.drop("_own", CHUNK, "_to", "_real", "_x", "_v0", "_vn", "_last")


def decimate_chunks(
    chunks: DataFrame, keys: Sequence[str], taps: Sequence[float], factor: int, chunk_size: int
) -> DataFrame:
    """Low-pass, then keep every ``factor``-th sample."""
    return filter_chain(chunks, keys, [(taps, factor)], chunk_size)


def zscore_chunks(chunks: DataFrame, keys: Sequence[str], offset: float = 1e-8) -> DataFrame:
    """``(x - mean) / (std + offset)`` per key, population std, over all its samples.

    Count, mean and squared deviation are taken per chunk (those of
    :func:`filter_chain` are used if it left them) and combined; the chunks are then
    joined with two numbers per key instead of being gathered. The chunks are read for
    the moments and once more for the scaling: give a written table.
    """
    given = {"n", "mean", "squares"} <= set(chunks.columns)
    n = F.size("samples")
    counted = [F.col("n"), F.col("mean"), F.col("squares")]
    if not given:
        counted = [n, array_mean(F.col("samples")), array_var(F.col("samples")) * n]
    parts = chunks.select(*keys, *[c.alias(a) for c, a in zip(counted, ("_n", "_m", "_s"))]).where("_n > 0")
    scale = _pooled(parts, keys).select(*keys, "_mean", (F.sqrt("_var") + F.lit(offset)).alias("_scale"))
    scaled = F.transform("samples", lambda x: (x - F.col("_mean")) / F.col("_scale"))
    return matched(chunks, scale, keys, "left").withColumn("samples", scaled).drop("_mean", "_scale", *(["n", "mean", "squares"] if given else []))


def _pooled(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and population variance from ``(_n, _m, _s)`` per part: count, mean, squared deviation.

    Means are summed as distances from one of them, so that a large offset costs no digits.
    """
    near = matched(parts, parts.groupBy(*keys).agg(F.min("_m").alias("_base")), keys)
    far, n = F.col("_m") - F.col("_base"), F.sum("_n")
    sums = near.groupBy(*keys).agg(
        F.max("_base").alias("_base"),
        (F.sum(F.col("_n") * far) / n).alias("_shift"),
        (F.sum(F.col("_n") * far * far) / n).alias("_square"),
        (F.sum("_s") / n).alias("_inside"),
    )
    between = F.greatest(F.col("_square") - F.col("_shift") * F.col("_shift"), F.lit(0.0))
    return sums.select(*keys, (F.col("_base") + F.col("_shift")).alias("_mean"), (F.col("_inside") + between).alias("_var"))


def zscore_samples(samples: DataFrame, keys: Sequence[str], value: str, out: str, offset: float = 1e-8) -> DataFrame:
    stats = samples.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
    scaled = (F.col(value) - F.col("_mean")) / (F.col("_std") + F.lit(offset))
    return matched(samples, stats, keys).withColumn(out, scaled).drop("_mean", "_std")


def window_shape(rate: float, window_sec: float, overlap: float) -> tuple[int, int]:
    """Window length and step in samples."""
    length = int(window_sec * rate)
    step = int(length * (1 - overlap))
    if length < 1 or step < 1:
        raise ValueError("window and step must hold at least one sample")
    return length, step


def _timed(df: DataFrame, rate: float, window_sec: float, step: int) -> DataFrame:
    start = F.col("window_index") * step / F.lit(float(rate))
    return df.withColumn("start_sec", start).withColumn("end_sec", start + F.lit(float(window_sec)))


def make_windows(
    samples: DataFrame,
    keys: Sequence[str],
    position: str,
    value: str,
    rate: float = 128.0,
    window_sec: float = 4.0,
    overlap: float = 0.5,
) -> DataFrame:
    """Overlapping windows of each key; incomplete ones are dropped.

    Each sample is sent to the windows that hold it, so a group never exceeds
    one window however long the recording is.
    """
    length, step = window_shape(rate, window_sec, overlap)
    last = F.floor(F.col(position) / step)
    first = F.greatest(F.lit(0), F.ceil((F.col(position) - (length - 1)) / step))
    spread = samples.select(
        *keys, position, F.col(value).cast("double").alias("_v"), F.explode(F.sequence(first, last)).alias("window_index")
    )
    packed = spread.groupBy(*keys, "window_index").agg(F.collect_list(F.struct(position, "_v")).alias("_s"))
    full = packed.where(F.size("_s") == length)
    signal = F.transform(F.array_sort("_s"), lambda s: s["_v"])
    return _timed(full.withColumn("signal", signal).drop("_s"), rate, window_sec, step)


def windows_from_chunks(
    chunks: DataFrame,
    keys: Sequence[str],
    chunk_size: int,
    rate: float = 128.0,
    window_sec: float = 4.0,
    overlap: float = 0.5,
) -> DataFrame:
    """The same windows cut as slices from chunk arrays: no sample is exploded."""
    length, step = window_shape(rate, window_sec, overlap)
    if chunk_size % step or chunk_size < length:
        raise ValueError("chunks must be a multiple of the step and hold a window")
    joined = with_borders(chunks, keys, chunk_size, 0, length - step).withColumn("_x", F.concat("samples", "after"))
    per_chunk = chunk_size // step
    cut = joined.withColumn("_w", F.explode(F.sequence(F.lit(0), F.lit(per_chunk - 1)))).where(
        F.col("_w") * step + length <= F.size("_x")
    )
    windows = cut.select(
        *keys,
        (F.col("chunk_id") * per_chunk + F.col("_w")).alias("window_index"),
        F.slice("_x", F.col("_w") * step + 1, length).alias("signal"),
    )
    return _timed(windows, rate, window_sec, step)


def stack_channels(
    windows: DataFrame, keys: Sequence[str], channel_pos: str = "channel_pos", signal: str = "signal"
) -> DataFrame:
    """One row per window with all channels, in channel order (bounded by the montage)."""
    packed = windows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(channel_pos, signal))).alias("_c"))
    return packed.withColumn(signal, F.transform("_c", lambda c: c[signal])).drop("_c")


def event_time_windows(events: DataFrame, keys: Sequence[str], ts: str, length: str, step: str, *aggs: Column) -> DataFrame:
    """Sliding windows on event time; the same call serves batch and stream."""
    return events.groupBy(*keys, F.window(ts, length, step)).agg(*aggs)
