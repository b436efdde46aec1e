"""Mixing sources to target weights by capped water-filling, in built-in expressions only.

Every source gets a share of all words by its weight, but no more than ``max_epochs``
times its own size; what a clamped source cannot take goes to the others by weight,
until nothing is above its cap. A source then takes each of its documents as often
as its target holds its size, and for the rest a seeded selection of documents; the
last document of the selection is taken in part, so that a source's taken words are
its target, rounded down.

Null sources form one source, null and empty texts have size 0 and are taken with
0 words. Rows that repeat are documents of their own; where equal rows share the
last place of a selection, each gives the same part. Everything is a function of
the rows, so reruns agree. An empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from signalloom.session import settle

WORDS = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
EARLIER = (Window.unboundedPreceding, -1)


def n_words(text: Column) -> Column:
    """Every word becomes one mark, blanks go, and the marks are counted."""
    marks = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WORDS, "\u0001")
    return F.length(F.translate(marks, " \t\n\u000b\u000c\r", "")).cast("long")


def _sized(df: DataFrame, doc_id: str, text: str, source: str) -> list[Column]:
    key = F.xxhash64(F.lit(SEED), F.col(f"`{doc_id}`"), F.col(f"`{text}`").cast("string"))
    return [F.col(f"`{source}`").alias("_source"), n_words(F.col(f"`{text}`")).alias("_size"), key.alias("_place")]


def _numbered(sources: DataFrame) -> DataFrame:
    """``_number``: 0-based place by code point, nulls last, without a global sort in one task."""
    order = [F.col("_source").isNull(), F.col("_source")]
    ranged = settle(sources.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(*EARLIER)), F.lit(0))  # a row per partition
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    offsets = parts.select("_part", before.alias("_before"))
    return ranged.withColumn("_local", local).join(offsets, "_part").withColumn("_number", F.col("_local") + F.col("_before"))


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: its size, its documents and its target in words."""
    totals = sized.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    table = F.array(*[F.lit(float(w)) for w in weights])
    weight = F.get(table, (F.col("_number") % len(weights)).cast("int"))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    numbered = _numbered(totals).select("_source", "source_size", "_rows", weight.alias("_weight"), cap.alias("_cap"))
    sources = settle(numbered, "sources")
    budget = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:  # each round but the last clamps a source more; one row comes back
        full = F.col("_cap") <= F.lit(level) * F.col("_weight")
        clamped, weight_left = sources.agg(F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_weight")))).first()
        raised = (budget - (clamped or 0.0)) / weight_left if weight_left else level
        if raised <= level * (1 + 1e-12):
            break
        level = raised
    return sources.select("_source", "source_size", "_rows", F.least("_cap", F.lit(level) * F.col("_weight")).alias("target"))


def selections(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets with whole repetitions and where the selection for the rest ends.

    Documents are ordered by a seeded hash. Sums by hash range find the range in
    which the selection ends; only the documents of that range are ordered. A source
    has as many ranges as a range has documents, so neither ordering is long.
    """
    goal = F.floor("target").cast("long")
    some = F.col("source_size") > 0
    plan = targets.select(
        "*",
        F.when(some, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long").alias("_whole"),
        F.when(some, goal % F.col("source_size")).otherwise(0).cast("long").alias("_rest"),
        F.ceil(F.sqrt("_rows")).cast("long").alias("_buckets"),
    )
    unit = F.pmod(F.col("_place"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    placed = _with_source(sized, plan).withColumn("_order", F.pmod(F.col("_place"), F.lit(1 << 52)))
    placed = placed.withColumn("_bucket", F.floor(unit * F.col("_buckets")))
    by_bucket = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(*EARLIER)
    buckets = placed.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_held"), F.first("_rest").alias("_rest"))
    buckets = buckets.withColumn("_before", F.coalesce(F.sum("_held").over(by_bucket), F.lit(0)))
    last = buckets.where((F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("_held")))
    last = last.select(F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), "_before", F.col("_rest").alias("_left"))
    inside = placed.join(last, placed["_source"].eqNullSafe(last["_s"]) & (placed["_bucket"] == last["_b"]))
    same = inside.groupBy("_source", "_order").agg(
        F.sum("_size").alias("_held"), F.count(F.lit(1)).alias("_equal"), F.first("_before").alias("_before"), F.first("_left").alias("_left")
    )
    by_order = Window.partitionBy("_source").orderBy("_order").rowsBetween(*EARLIER)
    start = F.col("_before") + F.coalesce(F.sum("_held").over(by_order), F.lit(0))
    ends = same.withColumn("_start", start).where((F.col("_start") <= F.col("_left")) & (F.col("_left") < F.col("_start") + F.col("_held")))
    ends = ends.select(
        F.col("_source").alias("_s"), F.col("_order").alias("_end"), F.floor((F.col("_left") - F.col("_start")) / F.col("_equal")).alias("_part")
    )
    return plan.join(ends, plan["_source"].eqNullSafe(ends["_s"]), "left").select("_source", "source_size", "target", "_whole", "_end", "_part")


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows beside their source's columns; the null source is a source too."""
    table = sources.withColumnRenamed("_source", "_s")
    return rows.join(table, rows["_source"].eqNullSafe(table["_s"]), "left").drop("_s")


def mix(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """``keep`` with ``size``, ``source_size``, ``target``, ``repeats`` (whole), ``part`` and ``taken`` words.

    A column of ``keep`` that bears the name of a result gives way to it.
    """
    made = ("size", "source_size", "target", "repeats", "part", "taken")
    sized = settle(df.select(*_sized(df, doc_id, text, source)), "sizes")
    plan = settle(selections(sized, source_targets(sized, weights, max_epochs)), "mix")
    held = [F.col(f"`{c}`") for c in keep if c not in made]
    rows = _with_source(df.select(*held, *_sized(df, doc_id, text, source)), plan)
    order = F.pmod(F.col("_place"), F.lit(1 << 52))
    chosen = F.when(order < F.col("_end"), F.col("_size")).when(order == F.col("_end"), F.least("_part", "_size"))
    part = F.coalesce(chosen, F.lit(0)).cast("long")
    taken = F.col("_whole") * F.col("_size") + part
    return rows.select(
        *held,
        F.col("_size").alias("size"), "source_size", "target",
        (F.col("_whole") + (part == F.col("_size")).cast("long")).alias("repeats"),
        F.when(part < F.col("_size"), part).otherwise(F.lit(0)).cast("long").alias("part"),
        taken.cast("long").alias("taken"),
    )


def materialize(mixed: DataFrame, text: str = "text", whole: bool = False) -> DataFrame:
    """The mix itself: each row as often as it is taken, a part as the text's first words.

    Only the last document of a source's selection is taken in part; with ``whole`` it is taken as it is if the
    part is at least half of it, else not, which is nearer to the target.
    """
    more = F.col("part") * 2 >= F.col("size") if whole else F.lit(True)
    copies = F.col("repeats") + ((F.col("part") > 0) & more).cast("long")
    rows = mixed.where(copies > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
    if whole:
        return rows.drop("_copy")
    heads = F.slice(F.split(F.col(f"`{text}`"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), F.greatest(F.col("part"), F.lit(1)).cast("int"))
    cut = F.when(F.col("_copy") > F.col("repeats"), F.array_join(heads, "")).otherwise(F.col(f"`{text}`"))
    return rows.withColumn(text, cut).drop("_copy")
