"""Ordered computations that never need a whole key in one task.

A plain ``Window.partitionBy(recording).orderBy(time)`` sorts a recording in a
single task, and one recording may hold a third of all rows. Everything here
cuts a key into *chunks* (a monotone function of the order column: an hour of
a recording, a range of scores), works inside a chunk, and then carries a few
numbers per chunk forward over the much smaller chunk summary.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window, WindowSpec

from signalloom.session import settle

CHUNK = "_chunk"
#: Keys and chunk as one struct. Structs compare their fields NULL-safely, so rows
#: whose key or chunk is NULL stay together and are joined like any others.
PLACE = "_chunk_place"
#: The place of rows without key and chunk, before all others.
NO_CHUNK = -(1 << 63)
BEFORE = (Window.unboundedPreceding, -1)
UP_TO = (Window.unboundedPreceding, Window.currentRow)


def _over(keys: Sequence[str | Column], *order: Column | str) -> WindowSpec:
    spec = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return spec.orderBy(*order)


def cut(rows: DataFrame, keys: Sequence[str], chunk: str = CHUNK) -> DataFrame:
    """Shuffle rows by ``(keys, chunk)``.

    Said outright, because Spark would otherwise run a window over ``(keys,
    chunk)`` on rows that an earlier join has gathered by ``keys`` alone.
    """
    return rows.repartition(*keys, chunk)


def matched(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which NULL equals NULL; the keys of ``rows`` stay.

    The keys are joined as one struct. Both sides are therefore shuffled for the
    join itself, so that adaptive execution can split the partitions of a hot key.
    """
    kinds = {f.name: f.dataType for f in rows.schema}
    left = rows.withColumn("_match", F.struct(*[F.col(k).alias(k) for k in keys]))
    right = table.withColumn("_match", F.struct(*[F.col(k).cast(kinds[k]).alias(k) for k in keys])).drop(*keys)
    return left.join(right, "_match", how).drop("_match")


def _placed(df: DataFrame, keys: Sequence[str], chunk: Column) -> DataFrame:
    """Rows with their place. Without keys the chunk itself is the place, which sorts faster."""
    place = F.struct(*keys, CHUNK) if keys else F.coalesce(F.col(CHUNK).cast("long"), F.lit(NO_CHUNK))
    return df.withColumn(CHUNK, chunk).withColumn(PLACE, place)


def _chunk_of(keys: Sequence[str]) -> Column:
    return F.col(PLACE)[CHUNK] if keys else F.col(PLACE)


def _by_key(keys: Sequence[str], *order: Column) -> WindowSpec:
    """Windows over one row per place, inside a key."""
    return _over([F.col(PLACE)[k] for k in keys], *order)


def prefix_totals(
    rows: DataFrame,
    keys: Sequence[str],
    totals: Mapping[str, Column],
    *,
    how=F.sum,
    descending: bool = False,
    whole: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per place: each total taken over all *earlier* chunks of the key.

    ``totals`` maps an output name to an aggregate over the rows of one chunk;
    ``how`` folds those over the earlier chunks. ``whole`` maps further output
    names to totals that are wanted over all chunks of the key. The windows here
    run over one row per chunk, not over the data.
    """
    summary = rows.groupBy(PLACE).agg(*[c.alias(n) for n, c in totals.items()])
    at = _chunk_of(keys)
    order = at.desc() if descending else at.asc()
    earlier = _by_key(keys, order).rowsBetween(*BEFORE)
    every = _by_key(keys, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return summary.select(
        PLACE,
        *[how(n).over(earlier).alias(n) for n in totals],
        *[how(n).over(every).alias(out) for out, n in (whole or {}).items()],
    )


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    chunk: Column,
    out: str = "row_index",
) -> DataFrame:
    """Exact 0-based position of each row in its key, in ``order``.

    ``chunk`` must not decrease along ``order``. Rows without a key form a key.
    """
    rows = _placed(df, keys, chunk)
    offsets = prefix_totals(rows, keys, {"_offset": F.count(F.lit(1))})
    local = F.row_number().over(_over([PLACE], *order)) - 1
    return (
        rows.repartition(PLACE).withColumn("_local", local)
        .join(offsets, PLACE)
        .withColumn(out, (F.col("_local") + F.coalesce("_offset", F.lit(0))).cast("long"))
        .drop(CHUNK, PLACE, "_local", "_offset")
    )


def previous_value(
    df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], chunk: Column, out: str, first: str | None = None
) -> DataFrame:
    """``lag(value)`` inside a key: the last row of the chunk before is carried over.

    ``first`` names a flag for rows without any row before them, which a NULL value
    of the row before does not tell.
    """
    rows = _placed(df, keys, chunk)
    newest = F.max_by(F.struct(value), F.struct(*order))
    carried = prefix_totals(rows, keys, {"_carried": newest}, how=lambda c: F.last(c, True))
    local = F.lag(F.struct(value)).over(_over([PLACE], *order))
    found = rows.repartition(PLACE).withColumn("_local", local).join(carried, PLACE)
    before = F.coalesce("_local", "_carried")
    if first:
        found = found.withColumn(first, before.isNull())
    return found.withColumn(out, before[value]).drop(CHUNK, PLACE, "_local", "_carried")


def first_per_group(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], k: int, spread: Sequence[str], slices: int | None = None
) -> DataFrame:
    """The first ``k`` rows of each group in ``order``.

    Each group is cut into slices by a hash of ``spread`` (the row key); only
    the winners of a slice meet the winners of the other slices. Unless given, the number
    of slices follows the rows, so that in a group of all rows both rounds order about as many: ``sqrt(rows / k)``.
    """
    if slices is None:
        slices = max(1, math.isqrt(df.count() // max(1, k)))
    slot = F.pmod(F.xxhash64(*spread), F.lit(slices))
    in_slice = F.row_number().over(_over([*groups, "_slot"], *order))
    in_group = F.row_number().over(_over(groups, *order))
    kept = df.withColumn("_slot", slot).withColumn("_rank", in_slice).where(F.col("_rank") <= k)
    return kept.drop("_slot").withColumn("_rank", in_group).where(F.col("_rank") <= k).drop("_rank")


def global_index(
    df: DataFrame, levels: Sequence[str], order: Sequence[str], chunk: Column, out: str
) -> DataFrame:
    """0-based position of each row in the order ``(*levels, *order)``, NULLs first.

    Offsets inside the first level come from a window over one row per chunk of
    that level's value (all recordings of a subject in one task, as counts only);
    the only window without a key runs over one row per first-level value.
    """
    rows = _placed(df, levels, chunk)
    counts = rows.groupBy(PLACE).agg(F.count(F.lit(1)).alias("_n"))
    at = [F.col(PLACE)[c] for c in [*levels, CHUNK]]
    inside = _over(at[:1], *at[1:]).rowsBetween(*BEFORE)
    firsts = counts.groupBy(F.struct(at[0]).alias("_first")).agg(F.sum("_n").alias("_m"))
    above = Window.partitionBy(F.lit(0)).orderBy("_first").rowsBetween(*BEFORE)
    firsts = firsts.select("_first", F.coalesce(F.sum("_m").over(above), F.lit(0)).alias("_above"))
    offsets = (
        counts.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .withColumn("_first", F.struct(at[0]))
        .join(firsts, "_first")
        .select(PLACE, (F.col("_inside") + F.col("_above")).alias("_offset"))
    )
    local = F.row_number().over(_over([PLACE], *order)) - 1
    return (
        rows.repartition(PLACE).withColumn("_local", local)
        .join(offsets, PLACE)
        .withColumn(out, (F.col("_offset") + F.col("_local")).cast("long"))
        .drop(CHUNK, PLACE, "_local", "_offset")
    )


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str, overall: str) -> DataFrame:
    """0-based positions in the order ``(*group, *order)``: ``out`` inside the group, ``overall`` in the whole table.

    The rows are sorted once, into ranges that any group may spread over, and written; both positions
    then follow from counts of one row per range and group.
    """
    by = [*group, *order]
    ranges = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id())
    split = ranges.withColumn("_range", F.shiftright("_row", 33)).withColumn("_row", F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)))
    rows = settle(split, "ranked").withColumn(PLACE, F.struct(*group, "_range"))
    counts = rows.groupBy(PLACE).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    at = F.col(PLACE)["_range"]
    in_group = _over([F.col(PLACE)[k] for k in group], at).rowsBetween(*BEFORE)
    # all groups of a range follow each other in it: what lies before a place is its range's beginning and its first row
    sizes = counts.groupBy(at.alias("_range")).agg(F.sum("_n").alias("_m"))
    before = sizes.select("_range", F.coalesce(F.sum("_m").over(_over([], "_range").rowsBetween(*BEFORE)), F.lit(0)).alias("_base"))
    shift = (F.coalesce(F.sum("_n").over(in_group), F.lit(0)) - F.col("_first")).alias("_shift")
    return (
        rows.join(counts.select(PLACE, shift), PLACE).join(before, "_range")
        .withColumn(out, F.col("_row") + F.col("_shift")).withColumn(overall, F.col("_row") + F.col("_base"))
        .drop(PLACE, "_range", "_row", "_shift", "_base")
    )


def _local_heads(df: DataFrame, keys: Sequence[str], start: Column, reach: Column, chunk: Column) -> DataFrame:
    """Rows with ``_head``: the start of their island as seen inside their chunk."""
    w = _over([PLACE], "_start")
    seen = F.col("_seen")
    return (
        _placed(df, keys, chunk)
        .repartition(PLACE)
        .withColumn("_start", start)
        .withColumn("_reach", reach)
        .withColumn("_seen", F.max("_reach").over(w.rowsBetween(*BEFORE)))
        .withColumn("_opens", F.when(seen.isNull() | (F.col("_start") > seen), F.col("_start")))
        .withColumn("_head", F.max("_opens").over(w.rowsBetween(*UP_TO)))
        .drop("_seen", "_opens")
    )


def _linked(local: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``_island``: the head of the whole island, which may have opened in an earlier chunk.

    A head stands for itself unless an earlier chunk reaches it. Heads grow, so the
    island it then continues is the last one that any earlier chunk opened.
    """
    summary = local.groupBy(PLACE).agg(F.max("_reach").alias("_r"), F.max("_head").alias("_h"))
    earlier = _by_key(keys, _chunk_of(keys).asc()).rowsBetween(*BEFORE)
    opened = F.when(F.col("_carry").isNull() | (F.col("_h") > F.col("_carry")), F.col("_h"))
    carries = (
        summary.withColumn("_carry", F.max("_r").over(earlier))
        .withColumn("_from", F.max(opened).over(earlier))
        .select(PLACE, "_carry", "_from")
    )
    own = F.col("_carry").isNull() | (F.col("_head") > F.col("_carry"))
    return local.join(carries, PLACE).withColumn("_island", F.when(own, F.col("_head")).otherwise(F.col("_from")))


def local_islands(
    df: DataFrame, keys: Sequence[str], start: Column, reach: Column, chunk: Column, folds: Mapping[str, tuple]
) -> DataFrame:
    """The islands of each chunk by itself: the first step of :func:`islands`, one shuffle of the rows."""
    return (
        _local_heads(df.where(start.isNotNull() & reach.isNotNull()), keys, start, reach, chunk)
        .groupBy(PLACE, "_head")
        .agg(F.max("_reach").alias("_reach"), *[fold(col).alias(n) for n, (fold, col) in folds.items()])
    )


def linked_islands(local: DataFrame, keys: Sequence[str], folds: Mapping[str, tuple]) -> DataFrame:
    """Islands over all chunks from those of each chunk: the second step of :func:`islands`.

    Reads ``local`` twice, so that it is worth writing first where it comes from much more rows.
    """
    return (
        _linked(local, keys)
        .groupBy(*[F.col(PLACE)[k].alias(k) for k in keys], "_island")
        .agg(*[fold(n).alias(n) for n, (fold, _) in folds.items()])
        .drop("_island")
    )


def islands(
    df: DataFrame,
    keys: Sequence[str],
    start: Column,
    reach: Column,
    chunk: Column,
    folds: Mapping[str, tuple],
) -> DataFrame:
    """Join rows into islands: a row opens a new one iff it starts after every
    earlier row of its key has stopped reaching (``start > max(reach)``).

    ``folds`` maps an output column to ``(fold, column)``, where the fold is an
    aggregate that can be applied to its own results (min, max, sum). Islands
    are first formed inside a chunk; only those are linked across chunks. Rows
    without a start or a reach are no intervals and are left out.
    """
    return linked_islands(local_islands(df, keys, start, reach, chunk, folds), keys, folds)


def island_of_rows(
    df: DataFrame, keys: Sequence[str], start: Column, reach: Column, chunk: Column, out: str
) -> DataFrame:
    """Each row with the start of its island (see :func:`islands`)."""
    rows = _linked(_local_heads(df.where(start.isNotNull() & reach.isNotNull()), keys, start, reach, chunk), keys)
    return rows.withColumn(out, F.col("_island")).drop(
        CHUNK, PLACE, "_head", "_start", "_reach", "_carry", "_from", "_island"
    )


def with_halo(df: DataFrame, position: str, size: int, behind: int, ahead: int = 0) -> DataFrame:
    """Split rows into chunks of ``size`` positions and copy border rows.

    Adds ``_chunk`` and ``_own``: each chunk also receives the ``behind`` rows
    before it and the ``ahead`` rows after it, marked ``_own = false``, so that
    a bounded frame can be evaluated inside ``(key, _chunk)``.
    """
    if max(behind, ahead) > size:
        raise ValueError("a halo may not be longer than a chunk")
    home = F.floor(F.col(position) / size)
    at = F.pmod(F.col(position), F.lit(size))
    spots = [home]
    if behind:
        spots.append(F.when(at >= size - behind, home + 1))
    if ahead:
        spots.append(F.when(at < ahead, home - 1))
    return (
        df.withColumn(CHUNK, F.explode(F.array_compact(F.array(*spots))))
        .withColumn("_own", F.col(CHUNK) == home)
    )


def with_steps_reached(df: DataFrame, value: Column, grid: Column, size: int, out: str) -> DataFrame:
    """Add how many of the ``size`` ascending entries of ``grid`` are ``<= value``.

    Halving steps, one projection each: about log2(size) comparisons in small
    generated code, where one nested expression would grow too large to compile.
    """
    rows = df.withColumn("_grid", grid).withColumn("_value", value).withColumn(out, F.lit(0))
    for width in (1 << k for k in reversed(range(size.bit_length()))):
        low = F.col(out)
        passed = F.get(F.col("_grid"), low + F.lit(width - 1)) <= F.col("_value")
        rows = rows.withColumn(out, F.when(passed, low + width).otherwise(low))
    return rows.drop("_grid", "_value")


def value_cell(value: Column, bits: int) -> Column:
    """A number that never falls as ``value`` grows: binary exponent and first ``bits`` bits behind it.

    Rounding of the logarithm at a power of two moves a value to the cell next to it at
    most, which keeps the order.
    """
    x, size = value.cast("double"), 1 << bits
    far = F.abs(x)
    exponent = F.floor(F.log2(far))
    inside = F.floor((far / F.pow(F.lit(2.0), exponent) - 1) * size).cast("long")
    height = (exponent.cast("long") + 1200) * size + inside
    top = F.lit(2400 * size).cast("long")
    signed = F.when(x == 0, F.lit(0).cast("long")).when(far == float("inf"), top).otherwise(height)
    return F.when(F.isnan(x), top + 1).otherwise(F.when(x < 0, -signed).otherwise(signed))


def score_ladder(
    df: DataFrame, groups: Sequence[str], score: str, label: str | None = None, bits: int = 14
) -> DataFrame:
    """One row per distinct ``(groups, score)`` with running counts.

    Columns: ``n``, ``positives`` at that score; ``n_ge``, ``positives_ge`` at
    or above it; ``n_all``, ``positives_all`` of the group. Scores are counted
    first (map-side combined), then cut into cells of their leading bits, so that
    neither ties nor a group end up in one task: a cell of single-precision scores
    holds 2 ** (23 - bits) rows at most. Cells are a function of the score alone, and
    there are at most 2 ** bits of them between a number and its double. A NULL
    score is the lowest.
    """
    positive = F.sum(F.col(label).cast("long")) if label else F.lit(0).cast("long")
    counts = df.groupBy(*groups, score).agg(F.count(F.lit(1)).alias("n"), positive.alias("positives"))
    celled = _placed(counts, groups, value_cell(F.col(score), bits))
    above = prefix_totals(
        celled,
        groups,
        {"_n": F.sum("n"), "_p": F.sum("positives")},
        descending=True,
        whole={"n_all": "_n", "positives_all": "_p"},
    )
    w = _over([PLACE], F.col(score).desc()).rowsBetween(*UP_TO)
    rows = celled.repartition(PLACE).withColumn("_ln", F.sum("n").over(w)).withColumn("_lp", F.sum("positives").over(w))
    return rows.join(above, PLACE).select(
        *groups,
        score,
        "n",
        "positives",
        (F.col("_ln") + F.coalesce("_n", F.lit(0))).alias("n_ge"),
        (F.col("_lp") + F.coalesce("_p", F.lit(0))).alias("positives_ge"),
        "n_all",
        "positives_all",
    )
