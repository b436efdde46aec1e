"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from signalloom.llm import queries, spelling_variants as sv


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_counts(rows):
    counts = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = lower(run)
            mark = zlib.crc32(f"{r.doc_id}:{run}".encode())
            if r.doc_id is not None and mark % 97 == 0:
                run = run[: mark % len(run)] + run[mark % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    form, near = {}, {w: [v for v in counts if one_apart(w, v)] for w in counts}
    for w, around in near.items():
        best = min(around, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def variants_of(spark, counts):
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    return sorted(map(tuple, sv.spelling_variants(df).collect()))


def test_counts_equal_a_loop(documents, odd):
    for df in (documents, odd):
        rows = df.select("doc_id", "text").collect()
        got = sv.count_words(df)
        assert got.columns == ["word", "n"] and {r.word: r.n for r in got.collect()} == plain_counts(rows)


@pytest.mark.parametrize("seed, alphabet", [(1, "ab"), (2, "abé"), (3, "a")])
def test_variants_equal_all_pairs(spark, seed, alphabet):
    """Few letters, so that there are runs of equal ones, ties and long chains."""
    rng = random.Random(seed)
    counts = {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))): 2 ** rng.randint(0, 9) for _ in range(150)}
    assert variants_of(spark, counts) == plain_variants(counts)


def test_ties_go_to_the_smaller_word_and_chains_to_their_end(spark):
    counts = {"colour": 4, "colouré": 8, "coloura": 8, "colourab": 16, "colourabc": 32, "colourabcd": 64, "lonely": 9}
    got = {r[0]: r for r in variants_of(spark, counts)}
    assert got["colour"][1:3] == ("coloura", "colourabcd") and got["colour"][4] == 2
    assert got["lonely"] == ("lonely", None, "lonely", 9, 0, None)
    with pytest.raises(ValueError):
        sv.spelling_variants(spark.createDataFrame([("a", 1)], "word string, n long"), lead=1)


def test_long_words_travel_as_hashes(spark):
    long = "ab" * 900
    counts = {long: 10, long[:700] + "x" + long[701:]: 4, long[:-1]: 5, "q" + long: 3, "other" * 60: 7}
    assert variants_of(spark, counts) == plain_variants(counts)
    rows = sv.rotations(spark.createDataFrame([(0, long, 1)], "number long, word string, n long"))
    assert rows.agg(F.max(F.length("prefix"))).first()[0] <= 64


def test_a_prefix_has_a_row_for_each_end(spark):
    """All words that differ in one place share a prefix; members are counted, pairs are not written."""
    words = [(i, f"base{c}word", 5) for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")] + [(26, "baseword", 9)]
    turned = sv.rotations(spark.createDataFrame(words, "number long, word string, n long"))
    groups = {r.prefix: r["count"] for r in turned.groupBy("prefix").count().collect()}
    assert max(groups.values()) == 27
    plan = sv.neighbours(turned)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "collect_list" in plan


def test_no_rows(empty, spark):
    assert sv.spelling_variants(sv.count_words(empty)).count() == 0


def test_query_equals_its_sql(spark, sf_dir):
    from oracle import connect

    want = connect(sf_dir).execute(queries.ORACLES["op12_spelling_variants"])
    names = [c[0] for c in want.description]
    got = queries.QUERIES["op12_spelling_variants"](spark, sf_dir).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)
