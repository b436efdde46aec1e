"""SimHash groups, exact top-k and the pipeline against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from signalloom.llm import queries, simhash_groups as groups, topk_search


def plain_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    values = np.array(prints, dtype=np.uint64)
    for i in range(len(prints)):
        for j in np.nonzero(np.bitwise_count(values[i] ^ values) <= 2)[0]:
            root[find(int(j))] = find(i)
    return [find(i) for i in range(len(prints))]


def check_groups(rows, prints):
    roots = plain_components(prints)
    least = {}
    for r, root in zip(rows, roots):
        if r.doc_id is not None:
            least[root] = min(least.get(root, r.doc_id), r.doc_id)
    for r, root in zip(rows, roots):
        assert r.component_id == least.get(root)
        assert r.group_rows == roots.count(root)


def test_documents(documents):
    rows = groups.near_duplicates(documents, keep=("doc_id", "text")).collect()
    assert len(rows) == documents.count()
    prints = [plain_print(r.text or "") for r in rows]
    assert [r.fingerprint for r in rows] == [f"{p:016x}" for p in prints]
    check_groups(rows, prints)


def test_odd_rows(odd, empty):
    rows = groups.near_duplicates(odd, keep=("doc_id", "text")).collect()
    check_groups(rows, [int(r.fingerprint, 16) for r in rows])
    assert {r.fingerprint for r in rows if not (r.text or "").strip()} == {"0" * 16}
    assert groups.near_duplicates(empty).count() == 0
    one = groups.one_of_each(odd.select("doc_id", "text", "score"))
    assert one.count() == len({r.fingerprint for r in rows}) and one.columns == ["doc_id", "text", "score"]


def numbers(spark, values):
    return spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "_print long")


@pytest.mark.parametrize("crowd", [0, 600])
def test_links_connect_all_within_two_bits(spark, crowd):
    """Scattered values with near ones, and a crowd that all lies within a few bits."""
    rng = random.Random(crowd)
    values = {rng.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1, 1 << 63}
    for v in list(values)[:150]:
        for _ in range(rng.randint(1, 3)):
            w = v
            for b in rng.sample(range(64), rng.randint(1, 3)):
                w ^= 1 << b
            values.add(w)
    centre = rng.getrandbits(64)
    for _ in range(crowd):
        w = centre
        for b in rng.sample(range(64), rng.randint(0, 4)):
            w ^= 1 << b
        values.add(w)
    values = sorted(values)
    found = groups.components(groups.links(numbers(spark, values)))
    root = {r.node: r.root for r in found.collect()}
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    want = {}
    for s, r in zip(signed, plain_components(values)):
        want.setdefault(r, set()).add(s)
    got = {}
    for s in signed:
        got.setdefault(root.get(s, s), set()).add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_a_crowd_makes_no_pairs(spark):
    """Links of a crowd grow with its size, not with the square."""
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    values = {centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}  # 2016 values, about 130,000 linked pairs
    assert groups.links(numbers(spark, values)).count() < 65 * len(values)


def test_thresholds_are_the_cheapest(spark):
    rng = np.random.default_rng(1)
    cost = rng.random((50, 3, 4))
    cost[:, :, 0] = 0
    least, chosen = groups.allocate(cost, 0)
    options = [(a, b, c) for a in range(-1, 3) for b in range(-1, 3) for c in range(-1, 3) if a + b + c == 0]
    for i in range(50):
        assert chosen[i].sum() == 0
        totals = [sum(cost[i, p, t + 1] for p, t in enumerate(o)) for o in options]
        assert least[i] == pytest.approx(min(totals))
        assert sum(cost[i, p, t + 1] for p, t in enumerate(chosen[i])) == pytest.approx(min(totals))


def test_long_chains_become_one_component(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(1000, 999)], "a long, b long")
    assert {(r.root, r.n) for r in groups.components(edges).groupBy("root").agg(F.count("*").alias("n")).collect()} == {(0, 201), (999, 2)}


def plain_top(rows, k, scale=1024):
    held = [(i, np.floor(np.array(v, dtype=float) * scale).astype(object), asked) for i, v, asked in rows]
    for qi, (q, a, asked) in enumerate(held):
        if asked:
            scores = sorted((-int((a * b).sum()), i) for n, (i, b, _) in enumerate(held) if n != qi and len(b) == len(a))
            yield from ((q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1))


@pytest.mark.parametrize("blocks", [(8192, 2048), (64, 16)])
def test_top_k_equals_brute_force(spark, blocks):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=10).tolist(), i % 20 == 0) for i in range(400)]
    rows += [(400 + i, rows[3][1], False) for i in range(40)]  # ties
    rows += [(500 + i, rng.normal(size=4).tolist(), i == 0) for i in range(5)]  # another length, fewer than k
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, asked boolean")
    out = topk_search.top_k(df, F.col("asked"), k=10, row_block=blocks[0], query_block=blocks[1]).collect()
    assert sorted(map(tuple, out)) == sorted(plain_top(rows, 10))


def test_large_numbers_stay_exact(spark):
    rows = [(i, [1e6 + i, -1e6 + 3 * i, 7.0 * i], i < 2) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, asked boolean")
    assert sorted(map(tuple, topk_search.top_k(df, F.col("asked"), k=3).collect())) == sorted(plain_top(rows, 3))


def test_rows_without_a_usable_vector_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], "x"), (1, None, None), (2, [1.0, None], "x"), (3, [nan, 1.0], "x"), (4, [inf, 1.0], "x"), (5, [], "x"),
            (None, [1.0, 1.0], "x"), (7, [1.0, 2.0], "x"), (7, [1.0, 2.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    out = topk_search.top_k(df, F.col("vec_id") % 100 == 0).collect()
    assert sorted((r.query_id, r.vec_id) for r in out) == [(0, 7), (0, 7)]
    assert topk_search.top_k(df.where("false"), F.lit(True)).count() == 0
    assert topk_search.top_k(df, F.lit(False)).count() == 0


def test_query_equals_sql(spark, sf_dir):
    from oracle import connect

    big = sf_dir.replace("sf0.001", "sf0.01")
    want = connect(big).execute(queries.ORACLES["op3_topk_search"]).fetchall()
    assert want and sorted(want) == sorted(map(tuple, queries.QUERIES["op3_topk_search"](spark, big).collect()))
