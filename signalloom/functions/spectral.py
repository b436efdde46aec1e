"""Spectral column functions. Only the transforms themselves run in Python,
on whole Arrow batches; the rest are built-in array expressions."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from signalloom.functions.scalars import array_mean, array_var, bind

DOUBLES = T.ArrayType(T.DoubleType())

# Sampling rate, window length, log offset, useful range, bands.
RATE = 128.0
SAMPLES = 512
EPSILON = 1e-8
USEFUL_HZ = (0.5, 40.0)
BANDS = {
    "delta": (0.5, 4.0),
    "theta": (4.0, 8.0),
    "alpha": (8.0, 13.0),
    "beta": (13.0, 30.0),
    "gamma": (30.0, 40.0),
}
STFT_SEGMENT, STFT_HOP, STFT_EPSILON = 128, 16, 1e-6


def useful_bins(samples: int = SAMPLES, rate: float = RATE) -> list[int]:
    freqs = np.fft.rfftfreq(samples, d=1.0 / rate)
    low, high = USEFUL_HZ
    return np.flatnonzero((freqs >= low) & (freqs <= high)).tolist()


def band_bins(samples: int = SAMPLES, rate: float = RATE, bands: Mapping = BANDS) -> dict[str, tuple[int, int]]:
    """First bin and number of bins of each half-open band."""
    freqs = np.fft.rfftfreq(samples, d=1.0 / rate)
    useful = useful_bins(samples, rate)
    found = {}
    for name, (low, high) in bands.items():
        inside = [b for b in useful if low <= freqs[b] < high]
        if not inside:
            raise ValueError(f"no frequency bin in band {name} for {samples} samples at {rate} Hz")
        found[name] = (inside[0], len(inside))
    return found


def band_table(sizes: DataFrame, rate: float = RATE, bands: Mapping = BANDS, size: str = "n") -> DataFrame:
    """For each window length in ``sizes``: first bin and number of bins of each band; 0 bins is a fault."""
    bins = sizes.select(size, F.explode(F.sequence(F.lit(0), F.floor(F.col(size) / 2))).alias("_bin"))
    hz = F.col("_bin") * F.lit(float(rate)) / F.col(size)
    low, high = USEFUL_HZ
    useful = (hz >= low) & (hz <= high)
    found = []
    for name, (start, stop) in bands.items():
        inside = useful & (hz >= start) & (hz < stop)
        first, count = F.min(F.when(inside, F.col("_bin"))), F.count_if(inside)
        found.append(F.struct(F.lit(name).alias("band"), first.alias("first_bin"), count.alias("bins")).alias(name))
    return bins.groupBy(size).agg(*found).select(size, F.inline(F.array(*bands)))


def hann(values: Column, size: int) -> Column:
    """Taper by the symmetric Hann window of ``size`` samples."""
    scale = 2.0 * math.pi / (size - 1)
    return F.transform(values, lambda v, n: v * (0.5 - 0.5 * F.cos(n * F.lit(scale))))


def rows_by_length(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Arrow lists as one matrix per length: ``{length: (row numbers, matrix)}``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = {}
    starts = np.concatenate(([0], np.cumsum(np.maximum(sizes, 0))))[:-1]
    for size in np.unique(sizes[sizes >= 0]):
        rows = np.flatnonzero(sizes == size)
        out[int(size)] = (rows, flat[starts[rows][:, None] + np.arange(size)[None, :]])
    return out


def arrow_rows(column: pa.Array, kernel: Callable[[np.ndarray], np.ndarray], kind=pa.float64()) -> pa.Array:
    """Apply a matrix kernel to all lists of a length at once; NULL lists stay NULL."""
    groups = rows_by_length(column)
    if len(groups) == 1 and column.null_count == 0:
        ((_, matrix),) = groups.values()
        return nested_lists(kernel(matrix))
    results: list = [None] * len(column)
    for rows, matrix in groups.values():
        for row, values in zip(rows, kernel(matrix)):
            results[row] = values.tolist()
    return pa.array(results, type=pa.list_(kind))


def nested_lists(values: np.ndarray) -> pa.Array:
    """A matrix (or a stack of matrices) as Arrow lists, one per row."""
    out = pa.array(np.ascontiguousarray(values).reshape(-1))
    for axis in range(values.ndim - 1, 0, -1):
        size, count = values.shape[axis], int(np.prod(values.shape[:axis]))
        out = pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * size), out)
    return out


@F.arrow_udf(DOUBLES)
def rfft_power(values: pa.Array) -> pa.Array:
    """One-sided squared magnitude of the real Fourier transform."""
    return arrow_rows(values, lambda x: np.abs(np.fft.rfft(x.astype(np.float64), axis=1)) ** 2)


def band_power(power: Column, samples: int = SAMPLES, rate: float = RATE) -> Column:
    """Summed power per band, in band order."""
    sums = [
        F.aggregate(F.slice(power, first + 1, count), F.lit(0.0), lambda a, p: a + p)
        for first, count in band_bins(samples, rate).values()
    ]
    return F.array(*sums)


def log_power(power: Column) -> Column:
    return F.transform(power, lambda p: F.log(p + F.lit(EPSILON)).cast("float"))


def relative_power(power: Column) -> Column:
    """Each band's share of the channel's summed band power; NULL when that is 0."""
    total = F.aggregate(power, F.lit(0.0), lambda a, p: a + p)
    return bind(total, lambda t: F.when(t > 0, F.transform(power, lambda p: p / t)))


def feature_names(channels: list[str] | int) -> list[str]:
    """``<channel>__<band>`` in channel-then-band order."""
    names = [f"channel_{i + 1}" for i in range(channels)] if isinstance(channels, int) else channels
    return [f"{c}__{band}" for c in names for band in BANDS]


def band_features(samples: int = SAMPLES, rate: float = RATE, channels: int | None = None):
    """Arrow UDF: channel-major window -> log band powers, channel then band.

    A whole batch of windows goes through one transform. Windows of another
    shape or with a non-finite sample raise, as they must not reach a model.
    """
    spans = list(band_bins(samples, rate).values())
    taper = np.hanning(samples)

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def features(signal: pa.Array) -> pa.Array:
        counts = signal.value_lengths().to_numpy(zero_copy_only=False)
        if channels is not None and (counts != channels).any():
            raise ValueError(f"expected {channels} channels")
        traces = signal.flatten()
        if len(traces) == 0:
            return pa.array([[] for _ in range(len(signal))], type=pa.list_(pa.float32()))
        if (traces.value_lengths().to_numpy(zero_copy_only=False) != samples).any():
            raise ValueError(f"expected {samples} samples per channel")
        matrix = traces.flatten().to_numpy(zero_copy_only=False).reshape(len(traces), samples)
        if not np.isfinite(matrix).all():
            raise ValueError("a window holds NaN or infinite samples")
        power = np.abs(np.fft.rfft(matrix.astype(np.float64) * taper, axis=1)) ** 2
        sums = np.stack([power[:, a : a + n].sum(axis=1) for a, n in spans], axis=1)
        logs = np.log(sums + EPSILON).astype(np.float32).reshape(-1)
        offsets = np.concatenate(([0], np.cumsum(counts * len(spans)))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(logs))

    return features


def stft_db(segment: int = STFT_SEGMENT, hop: int = STFT_HOP, rate: float = RATE):
    """Arrow UDF: samples -> frames x useful bins in dB.

    Frames stay inside the window (no padding); the periodic Hann taper is
    scaled to unit sum, as spectrum scaling does.
    """
    bins = useful_bins(segment, rate)
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / segment)
    taper = taper / taper.sum()

    def kernel(x: np.ndarray) -> np.ndarray:
        if x.shape[1] < segment:
            return np.empty((len(x), 0, len(bins)))
        frames = np.lib.stride_tricks.sliding_window_view(x.astype(np.float64), segment, axis=1)[:, ::hop]
        power = np.abs(np.fft.rfft(frames * taper, axis=2)[:, :, bins]) ** 2
        return 10.0 * np.log10(power + STFT_EPSILON)

    @F.arrow_udf(T.ArrayType(DOUBLES))
    def spectrogram(values: pa.Array) -> pa.Array:
        return arrow_rows(values, kernel, pa.list_(pa.float64()))

    return spectrogram


def sliding_frames(values: Column, size: int, hop: int) -> Column:
    """All full frames of ``size`` samples, ``hop`` apart, as an array of arrays."""
    starts = F.sequence(F.lit(1), F.size(values) - size + 1, F.lit(hop))
    frames = F.transform(starts, lambda i: F.slice(values, i, size))
    return F.when(F.size(values) >= size, frames).otherwise(F.array().cast("array<array<double>>"))


def layer_norm(values: Column, eps: float = 1e-5) -> Column:
    """Centre and scale a vector by its own mean and population variance."""
    moments = F.struct(array_mean(values).alias("m"), F.sqrt(array_var(values) + F.lit(eps)).alias("s"))
    return bind(moments, lambda of: F.transform(values, lambda v: (v - of["m"]) / of["s"]))
