"""Recording files of any binary format, read file by file with a reason for each that is not."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from signalloom.session import settle

#: Rows of one Arrow batch that a decoder's rows are handed on in.
ROWS = 256


def read_or_reject(
    spark: SparkSession, paths: str | Sequence[str], decode: Callable[[str, bytes], Iterator[dict]], schema: str
) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)``: what ``decode(path, content)`` gives for each file, and ``(file, reason)`` of the others.

    Every file is read and decoded in a task, whole, so a file bounds the memory. A file whose decoder raises, even after its first rows,
    or that cannot be read to its end, comes out as a reject, and none of its rows is kept; the others go on. If no file
    is left, that is an error that names the first reasons.
    """
    fields = spark.createDataFrame([], schema).schema
    kinds = to_arrow_schema(fields)
    out = f"{schema}, _file string, _reason string, _done boolean"
    listed = spark.read.format("binaryFile").load(paths).select("path")
    contents = spark.read.format("binaryFile").option("ignoreCorruptFiles", True).load(paths).select("path", "content")

    def batch_of(rows: list[dict], path: str, reason: str | None = None, done: bool = False) -> pa.RecordBatch:
        columns = [pa.array([row.get(f.name) for row in rows], f.type) for f in kinds]
        n = len(rows)
        marks = [pa.array([path] * n, pa.string()), pa.array([reason] * n, pa.string()), pa.array([done] * n, pa.bool_())]
        return pa.RecordBatch.from_arrays([*columns, *marks], [*kinds.names, "_file", "_reason", "_done"])

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    rows: list[dict] = []
                    for row in decode(path, content.as_py()):
                        rows.append(row)
                        if len(rows) >= ROWS:
                            yield batch_of(rows, path)
                            rows = []
                    yield batch_of(rows, path)
                except Exception as fault:  # whatever a decoder meets in a broken file
                    yield batch_of([{}], path, f"{type(fault).__name__}: {fault}")
                else:
                    yield batch_of([{}], path, done=True)

    found = settle(contents.mapInArrow(run, out), "decoded")
    done = found.where("_done").select("_file")
    refused = found.where("_reason IS NOT NULL").select(F.col("_file").alias("file"), F.col("_reason").alias("reason"))
    unread = listed.join(found.select("_file").distinct(), listed["path"] == F.col("_file"), "left_anti")
    rejects = refused.unionByName(unread.select(F.col("path").alias("file"), F.lit("the file could not be read").alias("reason")))
    if not done.limit(1).count():
        first = [f"{r['file']}: {r['reason']}" for r in rejects.orderBy("file").limit(3).collect()]
        raise ValueError("no recording is left; " + "; ".join(first))
    rows = found.where("NOT _done AND _reason IS NULL").join(done, "_file", "left_semi")
    return rows.select(*fields.names, F.col("_file").alias("file")), rejects
