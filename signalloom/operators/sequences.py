"""Causal sequences of consecutive windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from signalloom.operators.ordered import CHUNK, cut, with_halo
from signalloom.operators.quality import violations

KEYS = ["subject_id", "edf_id"]


def sequences(
    windows: DataFrame,
    length: int,
    columns: Sequence[str],
    index: str = "window_index",
    label: str = "label",
    chunk_size: int = 4096,
) -> DataFrame:
    """Every run of ``length`` consecutive windows of a recording, oldest first.

    ``steps`` holds the window index and the given ``columns`` of each window;
    ``target`` is the label of the newest. Windows count as consecutive when
    their indices are, so a gap starts a new run. A recording is cut into
    chunks that share ``length - 1`` border windows, so a long recording is
    spread over many tasks.
    """
    if length < 1:
        raise ValueError("length must be at least 1")
    size = max(chunk_size, length)
    spread = cut(with_halo(windows, index, size, behind=length - 1), KEYS)
    w = Window.partitionBy(*KEYS, CHUNK).orderBy(index).rowsBetween(-(length - 1), 0)
    newest = F.col(index)
    fields = [c for c in dict.fromkeys([index, *columns])]
    return (
        spread.withColumn("_first", F.first(index).over(w))
        .withColumn("_count", F.count(F.lit(1)).over(w))
        .withColumn("steps", F.collect_list(F.struct(*KEYS, *fields)).over(w))
        .where(F.col("_own") & (F.col("_count") == length) & (F.col("_first") == newest - (length - 1)))
        .select(
            *KEYS,
            (newest - (length - 1)).alias("start_index"),
            newest.alias("target_index"),
            F.col(label).alias("target"),
            "steps",
        )
    )


def boundary_violations(
    seqs: DataFrame, length: int, index: str = "window_index", counted: str | None = None
) -> DataFrame:
    """Sequences that leave their recording, have a wrong length or skip a window.

    ``counted`` names a further row with the number of sequences, from the same pass.
    """
    steps = F.col("steps")
    recordings = F.array_distinct(F.transform(steps, lambda s: F.struct(s["subject_id"], s["edf_id"])))
    expected = F.sequence(F.col("start_index"), F.col("target_index"))
    rules = {
        "one_recording": F.size(recordings) == 1,
        "length": F.size(steps) == length,
        "consecutive": F.transform(steps, lambda s: s[index]) == expected,
    }
    return violations(seqs, rules | ({counted: F.lit(False)} if counted else {}))
