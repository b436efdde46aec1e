"""The manifest against trees built in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from signalloom.llm import merkle_manifest as mm, queries

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, **changed):
    values = [changed.get(c, row[c]) for c in COLUMNS]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + arity])) for i in range(0, len(below), arity)])
    return levels


def path(levels, at, arity):
    out = []
    for level in levels[:-1]:
        run = at // arity * arity
        out.append((level[run:at], level[at + 1 : run + arity]))
        at //= arity
    return out


def fold(node, proof):
    for before, behind in proof:
        node = digest("".join(before) + node + "".join(behind))
    return node


def plain(rows, arity):
    groups = {}
    for r in rows:
        groups.setdefault(r.source, []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        held = sorted(groups[s], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r)))
        trees.append((held, tree([leaf_of(r) for r in held], arity)))
    top = tree([levels[-1][0] for _, levels in trees], arity)
    out = []
    for k, (held, levels) in enumerate(trees):
        for i, r in enumerate(held):
            proof = path(levels, i, arity) + path(top, k, arity)
            siblings = digest("".join("".join(a) + "".join(b) for a, b in proof))
            text = r.text
            if text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0:
                text = text.replace("\n", "")
            root = fold(leaf_of(r, text=text), proof)
            out.append((r.doc_id, levels[0][i], levels[-1][0], top[-1][0], siblings, root, root == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_checks_equal_plain_trees(documents, odd, arity):
    for df in (documents, odd, documents.limit(1)):
        got = mm.manifest_checks(df, arity=arity)
        assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        assert sorted(map(tuple, got.collect()), key=str) == plain(df.select(*COLUMNS).collect(), arity)


def test_an_empty_table_has_no_rows(empty):
    assert mm.manifest_checks(empty).count() == 0


def test_a_row_is_verified_until_it_changes(documents):
    rows = mm.manifest(documents)
    changed = documents.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    got = {r.doc_id: r.verified for r in mm.verify(changed, rows).collect()}
    assert got == {r.doc_id: r.doc_id % 7 != 0 for r in documents.select("doc_id").collect()}
    stranger = documents.limit(1).withColumn("doc_id", F.lit(-5).cast("long"))
    assert [r.verified for r in mm.verify(stranger, rows).collect()] == [False]


def test_siblings_of_a_binary_tree_are_found_by_xor(spark):
    got = spark.range(6).select(*[c.alias(f"s{i}") for i, c in enumerate(mm.sibling_positions(F.col("id"), 2))]).collect()
    assert [r.s0 for r in got] == [1, 0, 3, 2, 5, 4]
    three = spark.range(6).select(*[c.alias(f"s{i}") for i, c in enumerate(mm.sibling_positions(F.col("id"), 3))]).collect()
    assert [(r.s0, r.s1) for r in three] == [(1, 2), (2, 0), (0, 1), (4, 5), (5, 3), (3, 4)]
    with pytest.raises(ValueError):
        mm.manifest(spark.createDataFrame([(1, "a")], "doc_id int, source string"), ("doc_id",), arity=1)


def test_joins_are_on_positions(documents):
    """A group is spread over all tasks: every join of a level has the position among its keys."""
    nodes = documents.select(F.lit("hot").alias("_group"), F.col("doc_id").alias("_at"), F.col("text").cast("binary").alias("_digest"), F.lit(9).alias("_n"))
    plan = mm.with_siblings(nodes, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2 and plan.count("_want") >= 2


def test_query_equals_its_sql(spark, sf_dir):
    from oracle import connect

    con = connect(sf_dir)
    want = con.execute(queries.ORACLES["op11_merkle_manifest"])
    names = [c[0] for c in want.description]
    got = queries.QUERIES["op11_merkle_manifest"](spark, sf_dir).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)
