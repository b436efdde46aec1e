"""From raw signal chunks to labelled, normalised multi-channel windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from signalloom.functions import filters
from signalloom.operators import montage, signals
from signalloom.operators.intervals import label_windows
from signalloom.session import settle

REC = ["subject_id", "edf_id"]
TRACE = [*REC, "channel_pos"]


@dataclass(frozen=True)
class Recipe:
    """Fixed values of the standard preparation; every one can be replaced."""

    source_rate: float = 256.0
    factor: int = 2
    window_sec: float = 4.0
    overlap: float = 0.5
    chunk_size: int = 65_536
    notch_hz: float = filters.LINE_HZ
    pass_hz: tuple[float, float] = filters.PASS_HZ

    @property
    def rate(self) -> float:
        return self.source_rate / self.factor


def conditioned(chunks: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """Decimate, remove line noise, band-pass (one shuffle in all) and normalise.

    The filtered chunks are written once, with their moments: the normalisation reads
    the moments alone, then the samples, and no filter is evaluated twice.
    """
    stages = [
        (filters.antialias(recipe.source_rate, recipe.factor), recipe.factor),
        (filters.notch(recipe.notch_hz, recipe.rate), 1),
        (filters.bandpass(*recipe.pass_hz, recipe.rate), 1),
    ]
    filtered = signals.filter_chain(chunks, TRACE, stages, recipe.chunk_size, with_moments=True)
    return signals.zscore_chunks(settle(filtered, "filtered"), TRACE)


def recording_windows(
    chunks: DataFrame, annotations: DataFrame, dataset: str, recipe: Recipe = Recipe(), channels: int | None = None
) -> DataFrame:
    """Labelled windows with metadata and all channels.

    ``chunks``: ``(subject_id, edf_id, channel_pos, chunk_id, first_position,
    samples)`` of ``recipe.chunk_size`` samples. Windows that lack a channel are
    dropped when ``channels`` is given; :func:`incomplete_recordings` names the
    recordings that have such windows. Labels are found on the keys and times
    alone; the wide signal column takes part in no join but that flag.
    """
    size = recipe.chunk_size // recipe.factor
    cut = signals.windows_from_chunks(
        conditioned(chunks, recipe), TRACE, size, recipe.rate, recipe.window_sec, recipe.overlap
    )
    stacked = signals.stack_channels(cut, [*REC, "window_index", "start_sec", "end_sec"])
    if channels is not None:
        stacked = stacked.where(F.size("signal") == channels)
    length, _ = signals.window_shape(recipe.rate, recipe.window_sec, recipe.overlap)
    labelled = label_windows(stacked, annotations, REC, recipe.window_sec)
    return labelled.select(
        F.lit(dataset).alias("dataset_id"),
        *REC,
        "window_index",
        "start_sec",
        "end_sec",
        "label",
        F.lit(recipe.rate).alias("sampling_rate"),
        F.size("signal").alias("n_channels"),
        F.lit(length).alias("n_samples"),
        "signal",
    )


def incomplete_recordings(chunks: DataFrame, channels: int) -> DataFrame:
    """Recordings set aside, with the reason: a channel count other than ``channels``, or channels of different lengths.

    Only sizes are read, no samples are shuffled.
    """
    per_channel = chunks.groupBy(*TRACE).agg(F.sum(F.size("samples")).alias("_n"))
    whole = per_channel.groupBy(*REC).agg(F.count(F.lit(1)).alias("channels"), F.min("_n").alias("shortest"), F.max("_n").alias("longest"))
    count = F.format_string(f"%d channels instead of {channels}", "channels")
    reason = F.when(F.col("channels") != channels, count).when(F.col("shortest") != F.col("longest"), F.lit("channels of different lengths"))
    return whole.withColumn("reason", reason).where(F.col("reason").isNotNull())


def usable_recordings(
    channels: DataFrame, rules: Mapping = montage.SUBJECT_AUX, target: Sequence[str] = montage.CANONICAL
) -> tuple[DataFrame, DataFrame]:
    """Recordings whose remaining channels match the target, and the rejected ones with a reason.

    Bad recordings are set aside; only if none is left the job stops.
    """
    good, rejected = montage.quarantine(montage.layouts(montage.drop_auxiliary(channels, rules)), target)
    if good.isEmpty():
        raise ValueError("no recording matches the target montage")
    return good, rejected
