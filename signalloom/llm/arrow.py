"""Shared pieces of the Arrow-based text operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Text of one slice that is held as Python objects at a time, and of a batch sent to a worker.
SLICE_BYTES = 1 << 20
BATCH_BYTES = 8 << 20

#: A single blank between two letters or digits of any script, or a full stop, comma or the like of
#: a script without blanks behind one. No token of the byte-level splitting pattern reaches from a
#: letter or digit into a blank or a punctuation mark, so a text may be cut in front of it without changing any token.
SAFE_CUT = re.compile(r"(?<=[^\W_])(?:[ \n\t](?=[^\W_])|(?=[。、，．！？；：।॥؟،؛።]))")

_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(),
          "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()),
          "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "binary": pa.binary()}


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; -1 where the id is null."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts, F.lit(-1)).cast("int")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: very long texts make a batch of many rows very large."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([a-z]?)b?", spark.conf.get(key).lower()).groups()
    now = int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}[unit]
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes of text each (one row at least)."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
    start = held = 0
    for row, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def column(values: Sequence, kind: str) -> pa.Array:
    return pa.array(values, type=_TYPES[kind])


def add_columns(
    df: DataFrame, text: str, fields: dict[str, str], fn: Callable[[list[str]], dict[str, Sequence]], keep: Sequence[str]
) -> DataFrame:
    """``df`` with columns computed from the texts of a slice; null texts come in as ``""``.

    ``fields`` maps each new column to its type and ``fn`` gives their values for
    a list of texts. Of the input, the columns in ``keep`` stay; one that bears
    the name of a new column gives way to it.
    """
    small_batches(df.sparkSession)
    held = [c for c in keep if c not in fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for c in held for f in [df.schema[c]]),
                        *(f"`{n}` {t}" for n, t in fields.items())])
    inner = df.select(*[F.col(f"`{c}`") for c in held], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text_"):
                made = fn(part.column("_text_").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in held), *(column(made[n], t) for n, t in fields.items())], [*held, *fields]
                )

    return inner.mapInArrow(run, schema)


def pieces(text: str, limit: int) -> Iterator[str]:
    """A text in parts of about ``limit`` characters, cut only where it is safe."""
    start = 0
    while len(text) - start > limit:
        found = SAFE_CUT.search(text, start + limit)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]
