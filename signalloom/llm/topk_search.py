"""Exact top-k search by inner product: the three-phase uniform threshold algorithm.

The components of the vectors are dealt to ``LISTS`` lists. A list holds the partial
scores of all candidates for a query, none of which is ever stored: each list is
computed block by block.

1. Each list gives its best entries of every query. They are gathered, the vectors
   that they name are scored in full, and the k-th best score of a query is its
   safe cutoff: the k best of all rows cannot score less.
2. The cutoff goes back to the lists. A candidate that reaches it has, in at least one
   list, a partial score of ``cutoff / LISTS`` or more; all such entries are collected.
3. A list that did not name a candidate bounds its part from above, which prunes most
   of them. The scores of the others are resolved exactly, and ranked.

Queries and candidates are worked on in blocks of bounded size: a row block meets each
query block once. Scores are integers, computed without rounding; ties go to the
smaller id. Vectors that are null or hold null or non-finite components take no part,
nor do rows without an id; vectors of different lengths share no list and are compared
with those of the query's length only. Repeated ids are candidates of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from signalloom.session import settle

LISTS = 2
SCALE = 1024
#: Rows of a block of candidates and of a block of queries.
ROW_BLOCK = 8192
QUERY_BLOCK = 2048
#: Queries whose partial scores are held at a time.
HELD = 256
#: A list's best entries that phase 1 gathers, as a multiple of k.
GATHER = 4
#: Integers below this are exact as doubles.
EXACT = float(1 << 53)


def usable(vector: str) -> Column:
    """Whether a vector has components, all of them finite."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def whole_numbers(vector: str, scale: int = SCALE) -> Column:
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def parts_of(length: int, lists: int) -> list[slice]:
    edges = [length * i // lists for i in range(lists + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def matrix(column: pa.ChunkedArray | pa.Array, length: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer products: by floating point where that is exact, else by integers."""
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * queries.shape[1]
    if top < EXACT:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return queries @ rows.T


def blocks(vectors: DataFrame, is_query: Column, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Candidates and queries with their blocks, by a hash of the id and vector."""
    total, asked = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum(is_query.cast("long")), F.lit(0))).first()
    n_rows, n_asked = max(1, -(-total // row_block)), max(1, -(-asked // query_block))
    key = F.xxhash64("_id", "_vector", F.lit(29))
    asked_rows = vectors.where(is_query).select("_id", "_row", "_vector", "_length", F.pmod(key, F.lit(n_asked)).alias("_q"))
    rows = vectors.withColumn("_r", F.pmod(key, F.lit(n_rows))).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1)).cast("array<bigint>")))
    asked_rows = asked_rows.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1)).cast("array<bigint>")))
    return rows.select("_id", "_row", "_vector", "_length", "_q", "_r"), asked_rows


def _meet(rows: DataFrame, queries: DataFrame, work, schema: str) -> DataFrame:
    keys = ["_length", "_q", "_r"]

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([pa.array([], f) for f in empty], names)
        return work(int(key[0].as_py()), left, right.rename_columns([c.removeprefix("of_query") for c in right.column_names]))

    names = [part.split()[0] for part in schema.split(", ")]
    empty = [pa.int32() if part.split()[1] == "int" else pa.int64() for part in schema.split(", ")]
    asked = queries.toDF(*[f"of_query{c}" for c in queries.columns])  # both sides come from one table
    return rows.groupBy(*keys).cogroup(asked.groupBy(*[f"of_query{k}" for k in keys])).applyInArrow(run, schema)


def _entries(queries: pa.Table, rows: pa.Table, length: int, lists: int, pick) -> pa.Table:
    """Entries ``(query row, row, list, partial score)`` that ``pick`` chooses from each list."""
    asked, held = matrix(queries["_vector"], length), matrix(rows["_vector"], length)
    asked_row, row = queries["_row"].to_numpy(), rows["_row"].to_numpy()
    out = [[], [], [], []]
    for j, part in enumerate(parts_of(length, lists)):
        for at in range(0, len(asked), HELD):
            scores = products(asked[at : at + HELD, part], held[:, part])
            own = asked_row[at : at + HELD, None] == row[None, :]
            q, r = pick(scores, own, at)
            out[0].append(asked_row[at + q])
            out[1].append(row[r])
            out[2].append(np.full(len(q), j, dtype=np.int32))
            out[3].append(scores[q, r])
    return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in out], ["_query", "_row", "_list", "_partial"])


def top_k(df: DataFrame, is_query: Column, k: int = 10, row_id: str = "vec_id", vector: str = "embedding",
          lists: int = LISTS, scale: int = SCALE, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of each query's k best rows (all, if fewer)."""
    chosen = df.where(usable(vector) & F.col(f"`{row_id}`").isNotNull()).select(
        F.col(f"`{row_id}`").cast("long").alias("_id"), whole_numbers(vector, scale).alias("_vector"), is_query.alias("_asked")
    )
    # a row number of its own, so that equal ids stay apart
    vectors = settle(
        chosen.withColumn("_row", F.monotonically_increasing_id()).withColumn("_length", F.size("_vector")), "vectors"
    )
    rows, queries = blocks(vectors, F.coalesce("_asked", F.lit(False)), row_block, query_block)
    entry = "_query long, _row long, _list int, _partial long"

    def best(length: int, left: pa.Table, right: pa.Table) -> pa.Table:
        def pick(scores, own, at):
            scores = np.where(own, np.iinfo(np.int64).min, scores)
            n = min(GATHER * k, scores.shape[1])
            columns = np.argpartition(-scores, n - 1, axis=1)[:, :n] if n < scores.shape[1] else np.tile(np.arange(n), (len(scores), 1))
            q = np.repeat(np.arange(len(scores)), n)
            r = columns.ravel()
            real = ~own[q, r]
            return q[real], r[real]

        return _entries(right, left, length, lists, pick)

    # phase 1: the best entries of each list, of all blocks together
    local = _meet(rows, queries, best, entry)
    by_list = Window.partitionBy("_query", "_list").orderBy(F.col("_partial").desc(), "_row")
    gathered = local.withColumn("_n", F.row_number().over(by_list)).where(F.col("_n") <= GATHER * k)
    named = gathered.select("_query", "_row").distinct()
    first = resolve(named, vectors).withColumn("_n", F.row_number().over(Window.partitionBy("_query").orderBy(F.col("_score").desc(), "_id")))
    cutoff = settle(first.where(F.col("_n") == k).select("_query", F.col("_score").alias("_cutoff")), "cutoff")

    # phase 2: every entry that reaches its share of the cutoff; without a cutoff (fewer than k rows) all of them.
    # A block has all lists of its rows, so a pair's entries are put together there: a silent list holds less than
    # its share, and a pair that cannot reach the cutoff is not written
    asked = queries.join(cutoff.withColumnRenamed("_query", "_row"), "_row", "left")

    def enough(length: int, left: pa.Table, right: pa.Table) -> pa.Table:
        asked, held = matrix(right["_vector"], length), matrix(left["_vector"], length)
        asked_row, row = right["_row"].to_numpy(), left["_row"].to_numpy()
        known = np.asarray(right["_cutoff"].is_valid())
        cut = right["_cutoff"].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
        share = -(-cut // lists)  # in whole numbers, as the scores are
        out = [[], []]
        for at in range(0, len(asked), HELD):
            some = slice(at, at + HELD)
            most, named = np.zeros((len(asked[some]), len(row)), np.int64), np.zeros((len(asked[some]), len(row)), bool)
            for part in parts_of(length, lists):
                scores, least = products(asked[some, part], held[:, part]), share[some, None]
                found = scores >= least
                most += np.where(found, scores, least - 1)
                named |= found
            kept = (named & (most >= cut[some, None])) | ~known[some, None]
            q, r = np.nonzero(kept & (asked_row[some, None] != row[None, :]))
            out[0].append(asked_row[some][q])
            out[1].append(row[r])
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in out], ["_query", "_row"])

    left = _meet(rows, asked, enough, "_query long, _row long")

    # phase 3: the pairs that are left are resolved exactly
    final = Window.partitionBy("_query").orderBy(F.col("_score").desc(), "_id", "_row")
    ranked = resolve(left, vectors).withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    return ranked.select(F.col("_query_id").alias("query_id"), "rank", F.col("_id").alias("vec_id"), F.col("_score").alias("score"))


def resolve(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Full scores of ``(_query, _row)`` pairs, with both ids."""
    asked = vectors.where("_asked").select(F.col("_row").alias("_query"), F.col("_id").alias("_query_id"), F.col("_vector").alias("_asked_vector"))
    held = vectors.select("_row", "_id", "_vector")
    product = F.aggregate(
        F.zip_with("_asked_vector", "_vector", lambda a, b: a * b), F.lit(0).cast("long"), lambda total, x: total + x
    )
    return pairs.join(asked, "_query").join(held, "_row").select("_query", "_query_id", "_row", "_id", product.alias("_score"))
