"""Statistics of channel-major windows on whole Arrow batches: no row per sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

#: The struct fields of :func:`channel_parts`, one struct for each channel.
PART = "channel int, n long, min double, max double, s double, q double, nans long, infs long, large long, max_abs double"
QUALITY = (
    "has_nan int, has_inf int, mean double, std double, min double, max double, channel_std double, "
    "channel_min double, channel_max double, is_flat int, is_clipped int"
)


def _unpacked(windows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples of all windows, samples of each channel, channels of each window (missing ones 0)."""
    per_window = windows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    channels = windows.flatten()
    per_channel = channels.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    samples = channels.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return samples, per_channel.astype(np.int64), per_window.astype(np.int64)


def _reduce(ufunc: np.ufunc, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``ufunc`` over consecutive groups; NaN for empty ones."""
    out = np.full(len(sizes), np.nan)
    full = sizes > 0
    if full.any():
        out[full] = ufunc.reduceat(values, (np.cumsum(sizes) - sizes)[full])
    return out


def _spread(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population standard deviation of each group, centred on its mean."""
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = _reduce(np.add, values, sizes) / sizes
        far = values - np.repeat(mean, sizes)
        return mean, np.sqrt(_reduce(np.add, far * far, sizes) / sizes)


def _longest_runs(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Longest run of equal neighbours in each group; NaN equals NaN."""
    if not len(values):
        return np.zeros(len(sizes))
    opens = np.ones(len(values), dtype=bool)
    opens[1:] = ~((values[1:] == values[:-1]) | (np.isnan(values[1:]) & np.isnan(values[:-1])))
    opens[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    starts = np.flatnonzero(opens)
    runs = np.diff(np.append(starts, len(values)))
    owner = np.repeat(np.arange(len(sizes)), sizes)[starts]
    longest = np.zeros(len(sizes))
    np.maximum.at(longest, owner, runs)
    return longest


def _doubles(values: np.ndarray, known: np.ndarray) -> pa.Array:
    return pa.array(values, pa.float64(), mask=~known)


def quality_kernel(channel: int, flat_std: float, plateau: int):
    """Defects, overall and one channel's statistics, flat and clipped flags of each window."""

    @F.arrow_udf(QUALITY)
    def apply(windows: pa.Array) -> pa.Array:
        x, per_channel, per_window = _unpacked(windows)
        first = np.cumsum(per_window) - per_window
        size = np.nan_to_num(_reduce(np.add, per_channel, per_window)).astype(np.int64)
        filled = size > 0
        mean, std = _spread(x, size)
        _, channel_std = _spread(x, per_channel)
        low, high = _reduce(np.fmin, x, per_channel), _reduce(np.maximum, x, per_channel)
        runs = _longest_runs(x, per_channel)

        def some(flags: np.ndarray, sizes: np.ndarray) -> pa.Array:
            return pa.array(np.nan_to_num(_reduce(np.maximum, flags.astype(float), sizes)).astype(np.int32))

        # the one channel, where a window has it
        there = per_window > channel
        at = np.where(there, first + channel, 0)
        one = lambda v: _doubles(v[at] if len(v) else np.full(len(at), np.nan), there & (per_channel[at] > 0 if len(per_channel) else there))
        with np.errstate(invalid="ignore"):
            columns = [
                some(np.isnan(x), size), some(np.isinf(x), size), _doubles(mean, filled), _doubles(std, filled),
                _doubles(_reduce(np.fmin, x, size), filled), _doubles(_reduce(np.maximum, x, size), filled),
                one(channel_std), one(low), one(high),
                some(channel_std < flat_std, per_window), some(runs >= plateau, per_window),
            ]
        return pa.StructArray.from_arrays(columns, [f.split()[0] for f in QUALITY.split(", ")])

    return apply


def parts_kernel(large_abs: float):
    """For each channel of a window the sums that moments are made of; sums cover finite samples."""

    @F.arrow_udf(f"array<struct<{', '.join(f.replace(' ', ': ') for f in PART.split(', '))}>>")
    def apply(windows: pa.Array) -> pa.Array:
        x, per_channel, per_window = _unpacked(windows)
        finite = np.isfinite(x)
        ok = np.where(finite, x, np.nan)
        zero = np.where(finite, x, 0.0)
        with np.errstate(invalid="ignore"):
            high = np.abs(x) > large_abs
        some = _reduce(np.add, finite.astype(float), per_channel) > 0

        def count(flags: np.ndarray) -> pa.Array:
            return pa.array(np.nan_to_num(_reduce(np.add, flags.astype(float), per_channel)).astype(np.int64))

        def total(values: np.ndarray) -> pa.Array:
            return pa.array(np.nan_to_num(_reduce(np.add, values, per_channel)))

        place = np.arange(len(per_channel)) - np.repeat(np.cumsum(per_window) - per_window, per_window)
        columns = [
            pa.array(place.astype(np.int32)), pa.array(per_channel),
            _doubles(_reduce(np.fmin, ok, per_channel), some), _doubles(_reduce(np.fmax, ok, per_channel), some),
            total(zero), total(zero * zero), count(np.isnan(x)), count(np.isinf(x)), count(high),
            _doubles(_reduce(np.fmax, np.abs(ok), per_channel), some),
        ]
        structs = pa.StructArray.from_arrays(columns, [f.split()[0] for f in PART.split(", ")])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per_window)), pa.int32()), structs)

    return apply


def channel_parts(signal: str, large_abs: float) -> Column:
    return parts_kernel(large_abs)(F.col(signal).cast("array<array<double>>"))
