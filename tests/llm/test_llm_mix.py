"""The mix against plain water-filling."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from signalloom.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), epochs=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(epochs * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        share = {s: epochs * sizes[s] if s in full else left * weight[s] / open_ for s in names}
        over = {s for s in names if s not in full and share[s] > epochs * sizes[s] * (1 + 1e-12)}
        if not over:
            return share
        full |= over


def check(df):
    rows = mixing.mix(df, keep=("doc_id", "text", "source")).collect()
    assert len(rows) == df.count()
    sizes, taken = Counter(), Counter()
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
        assert r.taken == r.repeats * r["size"] + r.part
    want = plain_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9)
    return rows, want, taken


def test_documents(documents):
    rows, want, taken = check(documents)
    for source, target in want.items():
        assert target - 1 - 1e-6 <= taken[source] <= target + 1e-6
    again = mixing.mix(documents.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in rows)


def test_odd_rows(odd, empty):
    check(odd)
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(odd.withColumn("text", F.lit(None).cast("string"))).agg(F.sum("taken")).first()[0] == 0


def test_caps_pass_on_what_they_cannot_hold(spark):
    docs = [(i, "w " * n, s) for i, (s, n) in enumerate([("a", 10), ("b", 400), ("c", 300), ("d", 2), ("e", 40)] * 5)]
    rows, want, taken = check(spark.createDataFrame(docs, "doc_id int, text string, source string"))
    assert want["a"] == 150 and want["d"] == 30
    assert sum(want.values()) == pytest.approx(sum(r["size"] for r in rows))


def test_materialized_mix_holds_the_taken_words(documents):
    mixed = mixing.mix(documents, keep=("doc_id", "text", "source"))
    out = mixing.materialize(mixed).groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n"))
    want = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    assert {r.source: r.n for r in out.collect()} == want


def test_only_built_in_expressions(documents):
    plan = mixing.mix(documents)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
