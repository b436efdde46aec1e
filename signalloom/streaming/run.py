"""Run a stream over the files that are there, then read its result."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from signalloom.session import scratch_dir, settle

FLUSH = "~flush"


def files_as_stream(spark: SparkSession, path: str, like: DataFrame, **options) -> DataFrame:
    return spark.readStream.schema(like.schema).options(**options).parquet(path)


def write_flush(rows: DataFrame, path: str, ts: str = "ts", after: str = "INTERVAL 400 DAYS", **values) -> None:
    """Append one late row of no real subject, which moves the watermark past all others.

    ``values`` fills columns that a filter of the stream tests: a row that is
    filtered out does not move the watermark.
    """
    known = {"subject_id": FLUSH, **values}
    last = rows.agg(F.max(ts).alias(ts)).select(
        *[
            (F.col(ts) + F.expr(after)).alias(c.name)
            if c.name == ts
            else F.lit(known.get(c.name)).cast(c.dataType).alias(c.name)
            for c in rows.schema
        ]
    )
    last.write.mode("append").parquet(path)


def time_slices(rows: DataFrame, ts: str = "ts", slices: int = 5) -> Iterator[DataFrame]:
    """``rows`` in ``slices`` parts, each a slice of time after the one before.

    The rows are written once by all their partitions, a folder for each slice, so a slice is read without the others.
    Rows without a time belong nowhere in a stream and are refused.
    """
    low, high = (F.unix_micros(f(ts)) for f in (F.min, F.max))
    seen = rows.agg(low.alias("a"), high.alias("b"), F.count_if(F.col(ts).isNull()).alias("timeless")).first()
    if seen["timeless"]:
        raise ValueError(f"{seen['timeless']} rows have no time")
    first = seen["a"] or 0
    width = max(1, ((seen["b"] or 0) - first) // slices + 1)
    path = scratch_dir(rows.sparkSession, "slices")
    part = F.floor((F.unix_micros(ts) - F.lit(first)) / F.lit(width)).cast("int")
    rows.withColumn("_slice", part).write.partitionBy("_slice").parquet(path)
    written = rows.sparkSession.read.schema(f"{_columns(rows)}, _slice int").parquet(path)
    for k in range(slices):
        yield written.where(F.col("_slice") == k).drop("_slice")


def _columns(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def replayed(
    rows: DataFrame, transform: Callable[[DataFrame], DataFrame], name: str, ts: str = "ts", late: DataFrame | None = None, slices: int = 5,
    progress: list | None = None, **closing,
) -> DataFrame:
    """What ``transform`` makes of a table that arrives slice by slice, then of ``late`` rows and a closing row.

    Each slice is appended by all its partitions and then processed by a run of the query that goes on from the last
    one's checkpoint, as a job that is started whenever new files are there. ``closing`` fills columns of the closing row.
    """
    spark = rows.sparkSession
    rows = settle(rows, f"{name}-rows")
    path, out, checkpoint = (scratch_dir(spark, f"{name}-{part}") for part in ("in", "out", "state"))
    schema = None

    def process() -> None:
        nonlocal schema
        made = transform(files_as_stream(spark, path, rows))
        schema = made.schema
        query = made.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
        query = query.trigger(availableNow=True).start()
        query.awaitTermination()
        if progress is not None:
            progress.extend(query.recentProgress)

    for part in [*time_slices(rows, ts, slices), *([late] if late is not None else [])]:
        part.write.mode("append").parquet(path)
        process()
    write_flush(rows, path, ts, **closing)
    process()
    return spark.read.schema(schema).parquet(out)


@contextmanager
def settings(spark: SparkSession, pairs: Iterable[tuple[str, str]]):
    """Session settings for a block of code; the earlier ones come back whatever happens."""
    before = {key: spark.conf.get(key, None) for key, _ in pairs}
    try:
        for key, value in pairs:
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def drained(stream: DataFrame, name: str, progress: list | None = None) -> DataFrame:
    """Process all available input in append mode into a Parquet sink; return its table.

    Append mode writes final rows only: a window still open when the input ends
    stays in state unless a later row (see :func:`write_flush`) closes it. The
    progress reports of the batches are added to ``progress``.
    """
    out, checkpoint = (scratch_dir(stream.sparkSession, f"{name}-{part}") for part in ("out", "state"))
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if progress is not None:
        progress += query.recentProgress
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
