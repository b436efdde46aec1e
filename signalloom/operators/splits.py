"""Leak-free partitions, deterministic sampling and resampling.

Randomness comes from ``md5(seed | key)``, so a draw does not depend on how the
data is partitioned or on how often a task is repeated.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from signalloom.operators.ordered import first_per_group, numbered, matched

SPLITS = ("train", "validation", "test")


#: Rows of a digest slice that one task orders.
SLICE_ROWS = 50_000


def hash_key(*key: str, seed: int = 42) -> Column:
    """Hex digest that orders rows at random but reproducibly."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def _hash_slice(digest: Column, rows: int) -> Column:
    """Slices that grow with the digest: as many leading digits as leave :data:`SLICE_ROWS` rows to one."""
    digits = 1
    while 16**digits * SLICE_ROWS < rows and digits < 12:
        digits += 1
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def split_table(spark: SparkSession, assignment: Mapping[str, Sequence[str]]) -> DataFrame:
    """``(subject_id, split)`` from explicit, short lists; validated before use."""
    listed = [s for subjects in assignment.values() for s in subjects]
    empty = sorted(name for name, subjects in assignment.items() if not subjects)
    if empty:
        raise ValueError(f"empty splits: {empty}")
    repeated = sorted({s for s in listed if listed.count(s) > 1})
    if repeated:
        raise ValueError(f"subjects listed more than once: {repeated}")
    rows = [(s, name) for name, subjects in assignment.items() for s in subjects]
    return spark.createDataFrame(rows, "subject_id string, split string")


def split_problems(assigned: DataFrame, subjects: DataFrame) -> DataFrame:
    """Violations of a split table: overlaps, unknown and unassigned subjects, empty splits."""
    known = subjects.select("subject_id").distinct()
    listed = assigned.select("subject_id").distinct()

    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("constraint"), "violations")

    multiple = assigned.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    filled = assigned.where(F.col("split").isin(*SPLITS)).select("split").distinct()
    parts = [
        rows(multiple, "overlap"),
        rows(listed.join(known, "subject_id", "left_anti"), "missing"),
        rows(known.join(listed, "subject_id", "left_anti"), "unassigned"),
        filled.agg((F.lit(len(SPLITS)) - F.count(F.lit(1))).alias("violations")).select(
            F.lit("empty_split").alias("constraint"), "violations"
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def leaking_subjects(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("subject_id").intersect(b.select("subject_id"))


def subjects_only_in(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("subject_id").distinct().join(b.select("subject_id").distinct(), "subject_id", "left_anti")


def rows_of_split(rows: DataFrame, assigned: DataFrame, split: str) -> DataFrame:
    chosen = assigned.where(F.col("split") == split).select("subject_id")
    return matched(rows, chosen, ["subject_id"], "left_semi")


def partition_totals(rows: DataFrame, assigned: DataFrame) -> DataFrame:
    """Rows per split beside the original total; ``lost`` must be 0."""
    per_subject = rows.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))
    joined = per_subject.join(assigned, "subject_id", "left")
    return joined.agg(
        F.sum("n").alias("original"),
        *[F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n"))), F.lit(0)).alias(s) for s in SPLITS],
    ).withColumn("lost", F.col("original") - sum((F.col(s) for s in SPLITS), F.lit(0)))


def subject_ordinals(assigned: DataFrame) -> DataFrame:
    """Position of each subject in its split and over all splits (one row per subject)."""
    place = F.when(F.col("split") == SPLITS[0], 0).when(F.col("split") == SPLITS[1], 1).otherwise(2)
    inside = Window.partitionBy("split").orderBy("subject_id")
    overall = Window.partitionBy(F.lit(0)).orderBy(place, "subject_id")
    return assigned.select(
        "subject_id",
        "split",
        (F.row_number().over(inside) - 1).alias("ordinal"),
        (F.row_number().over(overall) - 1).alias("overall"),
    )


def fixed_sample(df: DataFrame, strata: Sequence[str], key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows per stratum without replacement (all rows of smaller strata)."""
    ranked = df.withColumn("_h", hash_key(*key, seed=seed))
    return first_per_group(ranked, strata, ["_h", *key], n, key).drop("_h")


def _class_counts(df: DataFrame, label: str) -> Column:
    """``{class: rows}`` as a scalar: classes are few, so rows need no join."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.map_from_entries(F.collect_list(F.struct(label, "_n")))).scalar()


def _both(value: Column) -> Column:
    """``value``, or an error where one of the two classes is missing."""
    return F.when(F.size("_counts") > 1, value).otherwise(F.raise_error(F.lit("only one class present")))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Each row with ``1 / count(its class)``. Both classes must occur."""
    own = F.element_at("_counts", F.col(label))
    return (
        df.withColumn("_counts", _class_counts(df, label))
        .withColumn("weight", _both(1.0 / own))
        .drop("_counts")
    )


def balanced_resample(df: DataFrame, key: Sequence[str], label: str = "label", seed: int = 42) -> DataFrame:
    """As many draws with replacement as there are rows, both classes equally likely.

    Each row stands for one draw: its digest picks a class and a position in
    that class. Positions are numbered in digest order, so the draw is an
    equi-join and no task holds a class. Both classes must occur.
    """
    digest = hash_key(*key, seed=seed)
    placed = numbered(
        df.withColumn("_h", digest), [label], ["_h", *key], _hash_slice(F.col("_h"), df.count()), "_place"
    ).drop("_h")
    draws = (
        df.select(*[F.col(k).alias(f"draw_{k}") for k in key], digest.alias("_h"))
        .withColumn("_counts", _class_counts(df, label))
        .withColumn(label, (F.conv(F.substring("_h", 1, 1), 16, 10).cast("int") >= 8).cast("int"))
        .withColumn("_pick", F.conv(F.substring("_h", 2, 12), 16, 10).cast("long"))
        .withColumn("_place", F.pmod(F.col("_pick"), _both(F.element_at("_counts", F.col(label)))))
        .select(*[f"draw_{k}" for k in key], label, "_place")
    )
    return draws.join(placed, [label, "_place"]).drop("_place")


def file_split(
    recordings: DataFrame, key: Sequence[str], stratum: str, seed: int = 42, percent: tuple[int, int] = (70, 15)
) -> DataFrame:
    """Assign recordings to train/validation/test, stratified, in digest order.

    ``percent`` gives whole per cents of train and validation. A stratum needs at least two recordings overall and two outside train.
    """
    slots = numbered(
        recordings.withColumn("_h", hash_key(*key, seed=seed)),
        [stratum],
        ["_h", *key],
        _hash_slice(F.col("_h"), recordings.count()),
        "_place",
    )
    train = F.floor(F.col("_n") * percent[0] / 100)
    held = F.floor(F.col("_n") * sum(percent) / 100)
    enough = (F.col("_n") >= 2) & (F.col("_n") - train >= 2)
    counted = slots.withColumn("_n", _class_counts(recordings, stratum)).withColumn(
        "_n", F.element_at("_n", F.col(stratum))
    )
    return counted.select(
        *recordings.columns,
        F.when(~enough, F.raise_error(F.lit("not enough recordings of a class to split")))
        .when(F.col("_place") < train, "train")
        .when(F.col("_place") < held, "validation")
        .otherwise("test")
        .alias("split"),
    )
