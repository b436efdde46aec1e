"""CSV, JSON and Parquet tables: window metadata, predictions, splits, arrays."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from signalloom import schemas
from signalloom.operators.features import missing_features
from signalloom.operators.ordered import matched
from signalloom.operators.quality import audited, prediction_rules, require, require_columns, violations
from signalloom.operators.splits import SPLITS
from signalloom.session import exists, publish, settle

KEY = ["subject_id", "edf_id", "window_index"]
ORDER = ["subject_id", "edf_id", "start_sec", "window_index"]


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """CSV files whose header names the schema's columns, in any order and among others.

    A missing column is refused. All files must have the same header: each is compared
    with it while reading, so that no column is taken for another. Empty files add no rows.
    """
    known = {f.name: f.dataType for f in schema.fields}
    header = spark.read.option("header", True).csv(paths).columns
    missing = sorted(set(known) - set(header))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    wide = T.StructType([T.StructField(name, known.get(name, T.StringType())) for name in header])
    rows = (
        spark.read.schema(wide)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(paths)
    )
    return rows.select(*known)


def read_csv_or_reject(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType
) -> tuple[DataFrame, DataFrame]:
    """Good rows, and ``(file, line)`` of the rows that do not parse."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = (
        spark.read.schema(wide)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .csv(paths)
    )
    # Written once: both results come from one parse.
    rows = settle(parsed.select("*", F.col("_metadata.file_name").alias("_file")), "parsed")
    bad = F.col("_corrupt_record").isNotNull()
    return (
        rows.where(~bad).drop("_corrupt_record", "_file"),
        rows.where(bad).select(F.col("_file").alias("file"), F.col("_corrupt_record").alias("line")),
    )


def read_window_metadata(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return read_csv(spark, paths, schemas.WINDOW_METADATA)


def validated_predictions(rows: DataFrame) -> DataFrame:
    """The rows, read once and written to the scratch folder, if they keep the rules, have unique keys and exist."""
    require_columns(rows, schemas.PREDICTIONS.fieldNames()[1:])
    return audited(rows, prediction_rules(), KEY, "predictions")


def load_predictions(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Read, validate and order a prediction table; the text is parsed once."""
    return validated_predictions(read_csv(spark, paths, schemas.PREDICTIONS)).orderBy(*ORDER)


def _joined_predictions(metadata: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores with their window's metadata; unknown windows and other labels are counted."""
    meta = metadata.select(
        "dataset_id", *KEY, "start_sec", "end_sec", F.col("label").cast("int").alias("_label")
    )
    return scores.select(*KEY, "y_true", "y_pred", "y_prob").join(meta, KEY, "left")


def _check_and_write(joined: DataFrame, path: str) -> None:
    """Write, audit, publish: the join is evaluated once, into the scratch folder, and counted meanwhile."""
    own = {
        "known_window": F.col("_label").isNotNull(),
        "label_matches": F.col("_label").isNull() | (F.col("_label") == F.col("y_true")),
    }

    def write(staged: str) -> None:
        rows = audited(joined, {**prediction_rules(), **own}, KEY, "scored")
        fields = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.PREDICTIONS.fields]
        rows.select(*fields).orderBy(*ORDER).write.option("header", True).csv(staged)

    publish(write, joined.sparkSession, path)


def write_window_predictions(metadata: DataFrame, scores: DataFrame, path: str) -> None:
    """Join scores to window metadata by key, check them and write ordered CSV."""
    _check_and_write(_joined_predictions(metadata, scores), path)


def write_sequence_predictions(metadata: DataFrame, scores: DataFrame, length: int, path: str) -> None:
    """Scores of sequences, keyed by ``start_index``: they belong to the newest window."""
    if length < 1:
        raise ValueError("the sequence length must be at least 1")
    target = scores.withColumn("window_index", F.col("start_index") + (length - 1)).drop("start_index")
    _check_and_write(_joined_predictions(metadata, target), path)


def write_split_manifest(assigned: DataFrame, dataset: str, path: str) -> None:
    """One JSON document with the sorted subjects of each split (a short table)."""
    lists = [
        F.array_sort(F.collect_list(F.when(F.col("split") == s, F.col("subject_id")))).alias(s) for s in SPLITS
    ]
    one = assigned.agg(*lists).select(
        F.lit(1).alias("format_version"),
        F.lit("subject_level").alias("split_type"),
        F.lit(dataset).alias("dataset"),
        *SPLITS,
        F.concat(*SPLITS).alias("all_subjects"),
    )
    one.coalesce(1).write.mode("errorifexists").json(path)


def read_split_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(subject_id, split, ordinal)``; an inconsistent manifest raises."""
    one = spark.read.schema(schemas.SPLIT_MANIFEST).option("multiLine", True).json(path)
    listed = F.concat(*SPLITS)
    known = F.lit(True)
    for s in SPLITS:
        known = known & F.col(s).isNotNull()
    require(
        violations(
            one,
            {
                "splits_present": known,
                "splits_filled": sum((F.when(F.size(s) > 0, 0).otherwise(1) for s in SPLITS), F.lit(0)) == 0,
                "no_repeats": F.size(F.array_distinct(listed)) == F.size(listed),
                "all_subjects": F.col("all_subjects").isNull() | (F.col("all_subjects") == listed),
            },
        )
    )

    def listed_in(split: str):
        named = F.lit(split).alias("split")
        return F.transform(split, lambda x, i: F.struct(x.alias("subject_id"), named, i.alias("ordinal")))

    return one.select(F.inline(F.concat(*[listed_in(s) for s in SPLITS])))


def write_by_split(rows: DataFrame, path: str) -> None:
    """One folder per split; see :func:`write_subject_arrays` on file sizes."""
    rows.hint("rebalance", "split").write.partitionBy("split").mode("errorifexists").parquet(path)


def write_subject_arrays(windows: DataFrame, path: str) -> None:
    """Windows, labels and keys in one table, one folder per subject.

    Rows are rebalanced by subject first: without it every task would write a
    small file per subject. Rebalancing splits a subject that holds much of the
    data over many tasks and files.
    """
    windows.hint("rebalance", "subject_id").write.partitionBy("subject_id").mode("errorifexists").parquet(path)


def write_bucketed(rows: DataFrame, name: str, path: str, key: Sequence[str], buckets: int) -> DataFrame:
    """``rows`` dealt to ``buckets`` files by ``key``, each sorted, and registered as table ``name``.

    Tables of one bucket count are joined on the key without a shuffle of either side (see
    :func:`signalloom.operators.align.aligned`), so wide array rows move once, when they are written. A bucket is read by one
    task: take as many as the largest table needs, and a key that is unique or nearly so.
    """
    dealt = rows.repartition(buckets, *key)
    dealt.write.bucketBy(buckets, *key).sortBy(*key).option("path", path).mode("errorifexists").saveAsTable(name)
    return rows.sparkSession.table(name)


def read_bucketed(spark: SparkSession, name: str, path: str, key: Sequence[str], buckets: int) -> DataFrame:
    """A table of :func:`write_bucketed` under a name of this session, with its buckets."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    keys, place = ", ".join(f"`{k}`" for k in key), path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE `{name}` ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {int(buckets)} BUCKETS LOCATION '{place}'"
    )
    return spark.table(name)


def refresh_features(
    windows: DataFrame, path: str, key: Sequence[str], part: str, compute: Callable[[DataFrame], DataFrame], size: int | None = None, force: bool = False
) -> None:
    """Bring a feature cache up to date, part by part.

    A part (a recording, a subject) in which a window lacks features of the expected size is computed as a whole and
    replaces its folder. So a run that is repeated, or started again after it was cut off, leaves every window once.
    """
    spark = windows.sparkSession
    todo = windows
    if not force and exists(spark, path):
        lacking = missing_features(windows.select(part, *key), spark.read.parquet(path), key, size).select(part).distinct()
        todo = matched(windows, settle(lacking, "lacking"), [part], "left_semi")
    rows = compute(todo).hint("rebalance", part)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static" if force else "dynamic").partitionBy(part).parquet(path)


def append_features(features: DataFrame, path: str, force: bool = False) -> None:
    features.write.mode("overwrite" if force else "append").parquet(path)


def write_scores(rows: DataFrame, path: str) -> None:
    """Continuous scores (y_true, logit, y_prob, subject_id) by model and split."""
    rows.hint("rebalance", "model", "split").write.partitionBy("model", "split").mode("append").parquet(path)


def write_event_report(report, path: str) -> None:
    """Events, truth and matches as CSV folders, metrics as JSON."""
    for name in ("events", "truth", "matches"):
        getattr(report, name).write.mode("errorifexists").option("header", True).csv(f"{path}/{name}")
    report.metrics.coalesce(1).write.mode("errorifexists").json(f"{path}/metrics")
