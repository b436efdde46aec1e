"""Merkle dataset manifest: one digest for a table, and for each row the proof that it belongs to it.

A row's leaf is the digest of its columns. The leaves of a group, in key order, form a
tree of ``arity`` children a node; the roots of all groups, in the order of the groups, form
a second tree above. Every level is a table of ``(group, position, digest)`` and is joined with
itself: a node computes the positions of its siblings (position XOR 1 in a binary tree,
slot offsets otherwise) and finds them by an equi-join; the rows in slot zero, which then
hold the digests of their whole run, emit the parents. A proof is collected from the top
down: siblings of a node, then the proof of its parent.

Keys of all joins hold the position, so a group with any share of the rows is spread over
all tasks, and a level is written to the shared scratch folder before the next one reads it.
Leaves are numbered by range partitions; a group may cover many of them.

Nulls: a null value is the text ``-`` in its leaf; rows with a null key come first in their
group; a null group is a group of its own, before the others. Rows with equal keys are ordered by
their digests; equal rows have equal digests, each its own leaf. An empty table gives no rows. Texts
are hashed whole; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from signalloom.llm.numbering import numbered
from signalloom.session import settle

ARITY = 3

PROOF = "array<struct<left:binary,right:binary>>"


def hashed(text: Column) -> Column:
    """sha256 as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def no_digest() -> Column:
    return F.unhex(F.lit(""))


def as_text(digests: Column) -> Column:
    """Digests (one or several, joined) as lowercase hex."""
    return F.lower(F.hex(digests))


def leaf_digest(values: Sequence[Column]) -> Column:
    """Digest of values: each its length in bytes, a colon and itself, or ``-`` for null."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return hashed(F.concat(*parts))


def sibling_positions(position: Column, arity: int) -> list[Column]:
    """Positions of the other members of a node's run; the j-th is ``j`` slots on, around the run."""
    if arity == 2:
        return [position.bitwiseXOR(F.lit(1))]
    slot = F.pmod(position, F.lit(arity))
    return [position - slot + F.pmod(slot + j, F.lit(arity)) for j in range(1, arity)]


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Each node with ``_left`` and ``_right``: the digests of its siblings before and behind it."""
    others = nodes.select(F.col("_group").alias("_g"), F.col("_at").alias("_p"), F.col("_digest").alias("_d"))
    found = nodes
    for j, position in enumerate(sibling_positions(F.col("_at"), arity), 1):
        side = others.select("_g", "_p", F.col("_d").alias(f"_d{j}"))
        found = found.withColumn("_want", position).join(side, (F.col("_group") == F.col("_g")) & (F.col("_want") == F.col("_p")), "left")
        found = found.drop("_want", "_g", "_p")
    slot = F.pmod(F.col("_at"), F.lit(arity))
    behind = {j: slot + j < arity for j in range(1, arity)}
    left = F.concat(no_digest(), *[F.when(~behind[j] & F.col(f"_d{j}").isNotNull(), F.col(f"_d{j}")).otherwise(no_digest()) for j in behind])
    right = F.concat(no_digest(), *[F.when(behind[j] & F.col(f"_d{j}").isNotNull(), F.col(f"_d{j}")).otherwise(no_digest()) for j in behind])
    return found.withColumn("_left", left).withColumn("_right", right).drop(*[f"_d{j}" for j in behind])


def parents(level: DataFrame, arity: int) -> DataFrame:
    """The next level, emitted by the nodes in slot zero; groups of one node have reached their root."""
    heads = level.where((F.col("_n") > 1) & (F.pmod(F.col("_at"), F.lit(arity)) == 0))
    return heads.select(
        "_group", F.floor(F.col("_at") / arity).cast("long").alias("_at"), F.ceil(F.col("_n") / arity).cast("long").alias("_n"),
        hashed(as_text(F.concat("_digest", "_right"))).alias("_digest"),
    )


def levels_of(nodes: DataFrame, largest: int, arity: int, name: str) -> list[DataFrame]:
    """All levels from ``nodes`` up to the root of the largest group, each written with its siblings."""
    levels = [settle(with_siblings(nodes, arity), f"{name}-0")]
    while largest > 1:
        largest = -(-largest // arity)
        levels.append(settle(with_siblings(parents(levels[-1], arity), arity), f"{name}-{len(levels)}"))
    return levels


def roots_of(levels: list[DataFrame]) -> DataFrame:
    """``(_group, _level, _digest)``: the only node of each group's last level."""
    tops = [level.where("_n = 1").select("_group", F.lit(i).alias("_level"), "_digest") for i, level in enumerate(levels)]
    return reduce(DataFrame.unionAll, tops)


def proofs_of(levels: list[DataFrame], above: DataFrame, arity: int) -> DataFrame:
    """Every row of the lowest level with ``_proof``; ``above`` holds the proofs of the groups' roots.

    ``above``: ``_group``, ``_level`` of the root, its ``_proof`` and columns that all rows of the group get.
    """
    given = [c for c in above.columns if c not in ("_group", "_level")]
    found = None
    for i in reversed(range(len(levels))):
        ends = above.where(F.col("_level") == i).select("_group", F.lit(0).cast("long").alias("_at"), *given)
        if i == 0:
            extra = [c for c in levels[0].columns if c not in ("_n", "_left", "_right", "_at", "_group")]
            lone = levels[0].where("_n = 1").select("_group", "_at", *extra).join(ends.drop("_at"), "_group")
        else:
            extra, lone = [], ends
        lone = lone.select("_group", "_at", *extra, *given)
        if found is not None:
            up = found.select(F.col("_group").alias("_g"), F.col("_at").alias("_p"), *given)
            level = levels[i].where("_n > 1").withColumn("_run", F.floor(F.col("_at") / arity).cast("long"))
            own = F.array(F.struct(F.col("_left").alias("left"), F.col("_right").alias("right")))
            inner = level.join(up, (F.col("_group") == F.col("_g")) & (F.col("_run") == F.col("_p")))
            inner = inner.withColumn("_proof", F.concat(own, F.col("_proof"))).select("_group", "_at", *extra, *given)
            lone = inner.unionAll(lone)
        found = lone
    return found


def manifest(
    df: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id",
    group: str = "source", arity: int = ARITY, carry: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``df``: ``key``, ``group``, ``leaf``, ``subroot``, ``root`` (hex) and ``proof``.

    ``proof`` holds the siblings' digests (32 bytes each, joined) level by level, those before
    and those behind the node on the path. ``carry`` adds columns computed from the row.
    """
    if arity < 2:
        raise ValueError("a node has two children at least")
    carry = dict(carry or {})
    label = F.coalesce(F.concat(F.lit("+"), F.col(f"`{group}`").cast("string")), F.lit(""))
    leaves = df.select(
        label.alias("_group"), F.col(f"`{key}`").alias("_key"), leaf_digest([F.col(f"`{c}`") for c in columns]).alias("_digest"),
        *[value.alias(f"_carry_{name}") for name, value in carry.items()],
    )
    leaves = settle(leaves, "manifest-leaves").withColumn("_arrival", F.monotonically_increasing_id())
    n_rows = leaves.count()
    nodes = numbered(leaves, ["_key", "_digest", "_arrival"], n_rows).drop("_arrival")
    largest = nodes.agg(F.max("_n")).first()[0] or 0
    levels = levels_of(nodes, largest, arity, "manifest")

    tops = settle(roots_of(levels), "manifest-subroots")
    n_groups = tops.count()
    over = numbered(tops.select(F.lit("").alias("_group"), F.col("_group").alias("_key"), "_level", "_digest"), ["_key"], n_groups)
    upper = levels_of(over.withColumnRenamed("_level", "_own_level"), n_groups, arity, "manifest-groups")
    root = roots_of(upper).first()
    above = roots_of(upper).select("_group", "_level", F.array().cast(PROOF).alias("_proof"))
    subroots = proofs_of(upper, above, arity)
    subroots = subroots.select(F.col("_key").alias("_group"), F.col("_own_level").alias("_level"), "_proof", F.col("_digest").alias("_subroot"))

    rows = proofs_of(levels, settle(subroots, "manifest-above"), arity)
    named = [] if group == key else [F.when(F.col("_group") != "", F.substring("_group", 2, (1 << 31) - 1)).alias(group)]
    return rows.select(
        F.col("_key").alias(key), *named,
        as_text(F.col("_digest")).alias("leaf"), as_text(F.col("_subroot")).alias("subroot"),
        F.lit(root["_digest"].hex() if root else None).cast("string").alias("root"), F.col("_proof").alias("proof"),
        *[F.col(f"_carry_{name}").alias(name) for name in carry],
    )


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings of a proof, level by level, from left to right, as hex."""
    joined = F.aggregate(proof, no_digest(), lambda done, p: F.concat(done, p["left"], p["right"]))
    return F.sha2(as_text(joined), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf (32 bytes) and a proof lead to, as hex."""
    return as_text(F.aggregate(proof, leaf, lambda node, p: hashed(as_text(F.concat(p["left"], node, p["right"])))))


def manifest_checks(
    df: DataFrame, without: str = "\n", text: str = "text", key: str = "doc_id", tampered: Column | None = None,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", arity: int = ARITY,
) -> DataFrame:
    """A manifest held against rows of which some lost characters of their text.

    Where ``tampered`` holds (by default: an even crc32 of the key as text), ``without`` is deleted
    from the text. ``folded_root`` follows from the changed row and the original proof, and ``verified`` says
    whether it is the root.
    """
    body = F.col(f"`{text}`").cast("string")
    if tampered is None:
        tampered = F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 2 == 0
    cut = {c: F.replace(body, F.lit(without), F.lit("")) if c == text else F.col(f"`{c}`") for c in columns}
    hit = F.coalesce(tampered & F.contains(body, F.lit(without)), F.lit(False))
    rows = manifest(df, columns, key, group, arity, carry={"changed_leaf": F.when(hit, leaf_digest(list(cut.values())))})
    now = F.coalesce("changed_leaf", F.unhex("leaf"))
    rows = rows.withColumn("proof_sha256", proof_digest(F.col("proof"))).withColumn("folded_root", folded(now, F.col("proof")))
    return rows.select(key, "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def verify(df: DataFrame, rows: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id") -> DataFrame:
    """``key`` and ``verified`` of each row of ``df``, by a manifest of an earlier state.

    Keys should be unique in the manifest; a row whose key it lacks, or whose content has changed, is not verified.
    """
    now = df.select(F.col(f"`{key}`").alias("_key"), leaf_digest([F.col(f"`{c}`") for c in columns]).alias("_now"))
    held = rows.select(F.col(f"`{key}`").alias("_k"), "root", "proof")
    found = now.join(held, F.col("_key").eqNullSafe(F.col("_k")), "left")
    same = F.coalesce(folded(F.col("_now"), F.col("proof")) == F.col("root"), F.lit(False))
    return found.select(F.col("_key").alias(key), same.alias("verified"))
