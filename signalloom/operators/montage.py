"""Channel names, orders and montages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from signalloom.functions.scalars import canonical_channel, canonical_electrode
from signalloom.operators.ordered import matched

KEYS = ["subject_id", "edf_id"]

# The target montage in order, and the order it replaces.
CANONICAL = [
    "FP1-F7", "F7-T7", "T7-P7", "P7-O1", "FP1-F3", "F3-C3", "C3-P3", "P3-O1", "FP2-F4", "F4-C4", "C4-P4", "P4-O2",
    "FP2-F8", "F8-T8", "T8-P8-0", "P8-O2", "FZ-CZ", "CZ-PZ", "P7-T7", "T7-FT9", "FT9-FT10", "FT10-T8", "T8-P8-1",
]
FORMER = [
    "FP1-F7", "F7-T7", "T7-P7", "P7-O1", "FP1-F3", "F3-C3", "C3-P3", "P3-O1", "FZ-CZ", "CZ-PZ", "FP2-F4", "F4-C4",
    "C4-P4", "P4-O2", "FP2-F8", "F8-T8", "T8-P8-0", "P8-O2", "P7-T7", "T7-FT9", "FT9-FT10", "FT10-T8", "T8-P8-1",
]

# Channels every recording loses, and those of two subjects.
AUX_NAMES = ("VNS", "-")
AUX_PREFIX = "--"
SUBJECT_AUX = {
    "chb12": {"names": ["LOC-ROC"], "suffixes": []},
    "chb15": {"names": ["PZ-OZ"], "suffixes": ["-Ref"]},
}

# Electrodes of the second dataset, with 29 and with 19 channels.
ELECTRODES_29 = [
    "FP1", "F3", "C3", "P3", "O1", "F7", "T3", "T5", "FC1", "FC5", "CP1", "CP5", "F9", "FZ", "CZ", "PZ", "FP2",
    "F4", "C4", "P4", "O2", "F8", "T4", "T6", "FC2", "FC6", "CP2", "CP6", "F10",
]
ELECTRODES_19 = [
    "FP1", "F3", "C3", "P3", "O1", "F7", "T3", "T5", "FZ", "CZ", "PZ", "F4", "C4", "P4", "O2", "F8", "T4", "T6",
    "FP2",
]

MISSING = "<MISSING>"


def _texts(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def is_auxiliary(name: str = "name", subject: str = "subject_id", rules: Mapping = SUBJECT_AUX) -> Column:
    """Whether a channel is dropped: by its name, or by a rule of its subject."""
    col = F.col(name)
    drop = col.isin(*AUX_NAMES) | col.startswith(AUX_PREFIX)
    for who, rule in rules.items():
        named = col.isin(*rule["names"])
        for suffix in rule["suffixes"]:
            named = named | col.endswith(suffix)
        drop = drop | ((F.lower(subject) == who.lower()) & named)
    return drop


def drop_auxiliary(channels: DataFrame, rules: Mapping = SUBJECT_AUX) -> DataFrame:
    """Remove auxiliary channels and close the gaps in ``pos``.

    The window covers the channels of one recording, a few dozen rows.
    """
    w = Window.partitionBy(*KEYS).orderBy("pos")
    return channels.where(~is_auxiliary(rules=rules)).withColumn("pos", (F.row_number().over(w) - 1).cast("long"))


def layouts(channels: DataFrame) -> DataFrame:
    """Ordered channel names per recording."""
    packed = channels.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("_c"))
    return packed.select(*KEYS, F.transform("_c", lambda c: c["name"]).alias("names"))


def with_layout_match(recordings: DataFrame, target: Sequence[str]) -> DataFrame:
    """``matches`` = 1 iff the canonical names equal the canonical target, in order."""
    here = F.transform("names", canonical_channel)
    return recordings.withColumn("matches", (here == F.transform(_texts(target), canonical_channel)).cast("int"))


def against_first_recording(recordings: DataFrame) -> DataFrame:
    """Compare each layout with the subject's first recording.

    Another channel count means ``skip``; other names only ``warn``.
    """
    first = recordings.groupBy("subject_id").agg(F.min_by("names", "edf_id").alias("_ref"))
    return matched(recordings, first, ["subject_id"]).select(
        *KEYS,
        F.when(F.size("names") != F.size("_ref"), "skip")
        .when(F.col("names") != F.col("_ref"), "warn")
        .otherwise("keep")
        .alias("verdict"),
    )


def order_differences(recordings: DataFrame, base: Sequence[str]) -> DataFrame:
    """Positions at which a layout differs from the base; a missing side is marked."""
    pairs = F.arrays_zip(F.col("names").alias("here"), _texts(base).alias("base"))
    rows = recordings.select(*KEYS, F.posexplode(pairs).alias("pos", "p"))
    return rows.where(~F.col("p.here").eqNullSafe(F.col("p.base"))).select(
        *KEYS,
        F.col("pos").cast("long").alias("pos"),
        F.coalesce("p.here", F.lit(MISSING)).alias("here"),
        F.coalesce("p.base", F.lit(MISSING)).alias("base"),
    )


def semantic_status(expected: DataFrame, recordings: DataFrame, target: Sequence[str] = CANONICAL) -> DataFrame:
    """``PASS``, ``MISMATCH_n``, ``BAD_COUNT_n`` or ``FILE_MISSING`` for each expected recording."""
    canon = F.transform(_texts(target), canonical_channel)
    same = F.zip_with(F.transform("names", canonical_channel), canon, lambda a, b: a.eqNullSafe(b))
    wrong = F.size(F.filter(same, lambda ok: ~ok))
    return expected.join(recordings, KEYS, "left").select(
        *KEYS,
        F.when(F.col("names").isNull(), "FILE_MISSING")
        .when(F.size("names") != len(target), F.concat(F.lit("BAD_COUNT_"), F.size("names")))
        .when(wrong > 0, F.concat(F.lit("MISMATCH_"), wrong))
        .otherwise("PASS")
        .alias("status"),
    )


def permutation(current: Sequence[str], target: Sequence[str]) -> list[int]:
    """Where each target channel stands now."""
    if sorted(current) != sorted(target) or len(set(current)) != len(current):
        raise ValueError("orders must hold the same distinct channels")
    return [list(current).index(name) for name in target]


def permuted(signal: Column, perm: Sequence[int]) -> Column:
    return F.transform(F.array(*[F.lit(i + 1) for i in perm]), lambda i: F.element_at(signal, i))


def permute_channels(
    windows: DataFrame, order: str, former: Sequence[str], target: Sequence[str], signal: str = "signal"
) -> DataFrame:
    """Reorder windows in the former order; leave those in the target order alone.

    Any other order stops the job: reordering it would mislabel channels.
    """
    moved = permuted(F.col(signal), permutation(former, target))
    return windows.withColumn(
        signal,
        F.when(F.col(order) == _texts(target), F.col(signal))
        .when(F.col(order) == _texts(former), moved)
        .otherwise(F.raise_error(F.lit("channels are in neither known order"))),
    ).withColumn(order, _texts(target))


def verify_permutation(
    before: DataFrame, after: DataFrame, key: Sequence[str], perm: Sequence[int], signal: str = "signal", label: str = "label"
) -> DataFrame:
    """Rows compared, changed samples, changed labels and keys missing on either side."""
    a = before.select(*key, F.col(signal).alias("_a"), F.col(label).alias("_la"))
    b = after.select(*key, F.col(signal).alias("_b"), F.col(label).alias("_lb"))
    both = a.join(b, list(key), "full_outer")
    same = permuted(F.col("_a"), perm) == F.col("_b")
    paired = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return both.agg(
        F.count_if(paired).alias("compared"),
        F.count_if(paired & ~same).alias("changed_signals"),
        F.count_if(paired & ~F.col("_la").eqNullSafe(F.col("_lb"))).alias("changed_labels"),
        F.count_if(~paired).alias("missing"),
        F.sum("_la").alias("positives_before"),
        F.sum("_lb").alias("positives_after"),
    )


def bipolar_coverage(derivations: DataFrame, electrodes: DataFrame) -> DataFrame:
    """Whether each ``A-B`` derivation can be built from a set of electrodes.

    ``derivations``: ``(edf_id, pos, name)``; ``electrodes``: ``(montage, electrode)``,
    a short list per montage that is gathered into one set.
    """
    sets = electrodes.groupBy("montage").agg(F.collect_set(canonical_electrode("electrode")).alias("_have"))
    parts = F.split("name", "-")
    sides = derivations.withColumn("_left", canonical_electrode(F.get(parts, F.lit(0)))).withColumn(
        "_right", canonical_electrode(F.get(parts, F.lit(1)))
    )
    absent = F.filter(F.array("_left", "_right"), lambda e: ~F.array_contains("_have", e))
    listed = sets.agg(F.collect_list(F.struct("montage", "_have"))).scalar()
    rows = sides.withColumn("_sets", listed).select("*", F.inline("_sets"))
    return rows.select(
        *[c for c in derivations.columns],
        "montage",
        F.col("_left").alias("electrode_1"),
        F.col("_right").alias("electrode_2"),
        F.when(F.size(absent) == 0, "YES").otherwise("NO").alias("status"),
        F.concat_ws(", ", absent).alias("missing"),
    )


def coverage_summary(coverage: DataFrame, keys: Sequence[str] = ("montage",)) -> DataFrame:
    """Share of derivations that can be built; repeated derivations count each time."""
    yes = F.col("status") == "YES"
    return coverage.groupBy(*keys).agg(
        F.count_if(yes).alias("reconstructable"),
        F.count(F.lit(1)).alias("derivations"),
        (100.0 * F.avg(yes.cast("int"))).alias("coverage_pct"),
    )


def inventory(headers: DataFrame, annotations: DataFrame | None = None) -> DataFrame:
    """Per recording: rate, channel counts by type, duration and annotation count."""
    kinds = ("eeg", "eog", "ecg", "misc")
    table = headers.groupBy(*KEYS).agg(
        F.max("sampling_rate").alias("sampling_rate"),
        F.count(F.lit(1)).alias("channels"),
        F.max("duration_sec").alias("duration_sec"),
        *[F.count_if(F.col("channel_type") == k).alias(f"{k}_channels") for k in kinds],
    )
    table = table.withColumn("duration_min", F.col("duration_sec") / 60)
    if annotations is None:
        return table
    counts = annotations.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("annotations"))
    return table.join(counts, KEYS, "left").withColumn("annotations", F.coalesce("annotations", F.lit(0)))


def quarantine(recordings: DataFrame, target: Sequence[str] = CANONICAL) -> tuple[DataFrame, DataFrame]:
    """Split layouts into usable recordings and ``(keys, reason)`` of the others."""
    judged = with_layout_match(recordings, target)
    good = judged.where("matches = 1").drop("matches")
    reason = F.when(F.size("names") != len(target), F.concat(F.lit("channel count "), F.size("names"))).otherwise(
        "channel layout"
    )
    return good, judged.where("matches = 0").select(*KEYS, reason.alias("reason"))
