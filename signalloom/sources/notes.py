"""Annotations and record lists from free text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from signalloom.functions.scalars import clock_seconds, normalized_filename, stripped
from signalloom.operators.align import lookup_ignoring_case, with_single_default
from signalloom.operators.ordered import matched

# Markers and patterns of the two text formats.
FILE_MARK = "File Name:"
PLAIN_START = r"Seizure Start Time:\s*(\d+)\s*seconds"
PLAIN_END = r"Seizure End Time:\s*(\d+)\s*seconds"
NUMBERED_START = r"Seizure \d+ Start Time:\s*(\d+)\s*seconds"
NUMBERED_END = r"Seizure \d+ End Time:\s*(\d+)\s*seconds"
PATIENT = r"(?m)^\s*(PN\d+)"
BLOCK_MARK = "Seizure n"
BLOCK = r"(?i)(?=Seizure\s+n\s*\d+)"
IN_BLOCK = r"(?i)Seizure\s+n\s*\d+"
BLOCK_FILE = r"(?i)File name:\s*(.+?)(?:\n|$)"
BLOCK_START = r"(?i)(?:Seizure start time|Start time):\s*([0-9:.]+)"
BLOCK_END = r"(?i)(?:Seizure end time|End time):\s*([0-9:.]+)"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 1)


def _first(text: Column, pattern: str) -> Column:
    """First capture, NULL when the pattern does not occur."""
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, 1))


def annotation_sections(texts: DataFrame, text: str = "value") -> DataFrame:
    """From one section per file mention: its heading and its intervals.

    The plain form counts if it has a start at all, else the numbered form;
    starts and ends are paired up to the shorter list.
    """
    t = F.col(text)
    plain = _all(t, PLAIN_START)
    starts = F.when(F.size(plain) > 0, plain).otherwise(_all(t, NUMBERED_START))
    ends = F.when(F.size(plain) > 0, _all(t, PLAIN_END)).otherwise(_all(t, NUMBERED_END))
    pairs = F.slice(
        F.arrays_zip(starts.alias("start"), ends.alias("end")), F.lit(1), F.least(F.size(starts), F.size(ends))
    )
    rest = [c for c in texts.columns if c != text]
    return texts.select(*rest, F.get(F.split(t, "\n"), F.lit(0)).alias("heading"), F.inline(pairs)).select(
        *rest, "heading", F.col("start").cast("double").alias("start_sec"), F.col("end").cast("double").alias("end_sec")
    )


def read_annotations(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Sections of summary files: ``(subject_id, heading, start_sec, end_sec)``.

    The file marker is the record separator, so a summary is read section by
    section and may be split between tasks. The subject is the folder
    ``subject_id=...`` or the file name ``<subject>-summary.txt``.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = spark.read.option("lineSep", FILE_MARK).text(paths)
    if "subject_id" not in raw.columns:
        name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)-summary\.txt$", 1)
        raw = raw.select("value", name.alias("subject_id"))
    return annotation_sections(raw)


def annotations_of(sections: DataFrame, recordings: DataFrame, suffix: str = ".edf") -> DataFrame:
    """Intervals of each recording: its file name must occur in the heading.

    Containment becomes an equi-join: the pieces of a heading that end in the
    suffix are looked up. No piece is longer than the longest file name.
    """
    wanted = recordings.select("subject_id", "edf_id", F.concat("edf_id", F.lit(suffix)).alias("_file")).distinct()
    longest = wanted.agg(F.coalesce(F.max(F.length("_file")), F.lit(0))).scalar()
    heading, n = F.col("heading"), len(suffix)
    spots = F.sequence(F.lit(1), F.greatest(F.length(heading), F.lit(1)))
    ends = F.filter(spots, lambda i: F.substring(heading, i, F.lit(n)) == suffix)

    def pieces_until(e: Column) -> Column:
        first = F.least(e, F.greatest(F.lit(1), e + n - F.col("_longest")))
        return F.transform(F.sequence(first, e), lambda s: F.substring(heading, s, e - s + n))

    listed = (
        sections.where(heading.contains(suffix))
        .withColumn("_longest", longest)
        .select(
            "subject_id",
            F.explode(F.array_distinct(F.flatten(F.transform(ends, pieces_until)))).alias("_file"),
            "start_sec",
            "end_sec",
        )
    )
    return matched(listed, wanted, ["subject_id", "_file"]).select("subject_id", "edf_id", "start_sec", "end_sec")


def seizure_blocks(texts: DataFrame, text: str = "value") -> DataFrame:
    """Blocks of the second dataset's lists; blocks without both times are dropped."""
    named = texts.select(_first(F.col(text), PATIENT).alias("patient"), F.col(text).alias("_text"))
    return _blocks(named.where(F.col("patient").isNotNull()))


def _blocks(named: DataFrame) -> DataFrame:
    """Blocks of ``(patient, _text)``."""
    blocks = named.select("patient", F.explode(F.split("_text", BLOCK)).alias("_b")).where(F.regexp_like("_b", F.lit(IN_BLOCK)))
    b = F.col("_b")
    return blocks.select(
        "patient",
        normalized_filename(_first(b, BLOCK_FILE)).alias("filename"),
        stripped(_first(b, BLOCK_START)).alias("start_time"),
        stripped(_first(b, BLOCK_END)).alias("end_time"),
    ).where(F.col("start_time").isNotNull() & F.col("end_time").isNotNull()).select(
        "*", clock_seconds("start_time").alias("start_seconds"), clock_seconds("end_time").alias("end_seconds")
    )


def read_seizure_list(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """List files of any length, each headed by its patient.

    The usual beginning of a block is the record separator, so a file is read block by
    block and may be split between tasks; blocks that are written differently are found
    inside the pieces. The patient of a file is the first one named in it.
    """
    pieces = spark.read.option("lineSep", BLOCK_MARK).text(paths)
    # a file's parts by their offset, and the pieces of a part as they are read
    order = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("piece"))
    pieces = pieces.select("value", F.col("_metadata.file_path").alias("_file"), order.alias("_order"))
    # a piece that begins with a number has lost the separator before it
    headed = F.when(F.regexp_like("value", F.lit(r"^\s*\d")), F.concat(F.lit(BLOCK_MARK), "value")).otherwise(F.col("value"))
    pieces = pieces.withColumn("_text", headed).withColumn("patient", _first(headed, PATIENT))
    first = pieces.where(F.col("patient").isNotNull()).groupBy("_file").agg(F.min_by("patient", "_order").alias("patient"))
    return _blocks(matched(pieces.drop("patient"), first, ["_file"]))


def read_records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``subject/file`` lines; lines of any other shape are skipped."""
    parts = F.split("path", "/")
    return (
        spark.read.text(paths)
        .select(stripped("value").alias("path"))
        .where((F.col("path") != "") & (F.size(parts) == 2))
        .select(F.get(parts, F.lit(0)).alias("subject"), F.get(parts, F.lit(1)).alias("filename"), "path")
    )


def with_inferred_filenames(seizures: DataFrame, records: DataFrame) -> DataFrame:
    return with_single_default(seizures, records, "patient", "subject", "filename", "filename")


def matched_seizures(seizures: DataFrame, records: DataFrame, how: str = "inner") -> DataFrame:
    """Seizures joined to records on patient and file name, ignoring case
    (``how="left_anti"`` for those without a record)."""
    table = records.select(F.col("subject").alias("patient"), "filename")
    return lookup_ignoring_case(seizures, table, "patient", "filename", how)
