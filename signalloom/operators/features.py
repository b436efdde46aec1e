"""Window features and their cache."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from signalloom.functions.spectral import band_features, layer_norm


def with_band_features(
    windows: DataFrame, samples: int = 512, rate: float = 128.0, channels: int | None = None, signal: str = "signal"
) -> DataFrame:
    """Log band powers (channel then band) of channel-major windows."""
    return windows.withColumn("features", band_features(samples, rate, channels)(F.col(signal)))


def fused(a: Column, b: Column) -> Column:
    """Two feature vectors, each normalised on its own, then joined end to end."""
    return F.concat(layer_norm(a), layer_norm(b))


def missing_features(
    windows: DataFrame, cached: DataFrame, key: Sequence[str], size: int | None = None, force: bool = False
) -> DataFrame:
    """Windows whose features must still be computed.

    A cached row counts only if its vector has the expected size; ``force``
    returns every window.
    """
    if force:
        return windows
    valid = cached if size is None else cached.where(F.size("features") == size)
    return windows.join(valid.select(*key), list(key), "left_anti")
