"""The line field: shapes against plain counting, slopes against differences, and held-out rows."""

import itertools
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.llm import line_quality_crf as lq
from signalloom.llm.arrow import fold

LINES = ["Plain words are here.", "AB cd## cd## ||", "x", "12 12 12 a", "  Été\tà la mer !", "ab ab ab ab", "—", "　字字 字字", "é" * 70 + " " + "é" * 70]


def plain_shape(line):
    def kind(c):
        if c.isspace():
            return lq.BLANK
        if c.isalpha():
            return lq.UPPER if c.isupper() else lq.LOWER if c.islower() else lq.LETTER
        if unicodedata.category(c) == "Nd":
            return lq.DIGIT
        return lq.POINT if c in ".,;:?!'\"()-–—’“”«»¿¡" else lq.SIGN

    words = line.split()
    solid = [kind(c) for c in line if not c.isspace()]
    share = lambda n, of: n / max(1, of)
    kinds = [share(solid.count(k), len(solid)) for k in (lq.LOWER, lq.UPPER, lq.LETTER, lq.DIGIT, lq.POINT, lq.SIGN)]
    ends = [share(sum(kind(w[-1]) == lq.SIGN for w in words), len(words)), share(sum(all(kind(c) == lq.SIGN for c in w) for w in words), len(words))]
    again = [share(sum(a == b for a, b in zip(words, words[1:])), len(words)), share(len(set(words)), len(words))]
    edges = [kind(words[0][0]), kind(words[-1][-1])] if words else [lq.KINDS, lq.KINDS]
    values = [len(solid), len(words), share(len(solid), len(words)), *kinds, *ends, *again, *edges]
    return [int(np.searchsorted(s, v)) for v, s in zip(values, lq.MEASURES.values())], len(solid)


def test_shapes_equal_plain_counting():
    steps, solid = lq.shapes([*LINES, ""])
    for line, got, n in zip([*LINES, ""], steps.tolist(), solid.tolist()):
        assert (got, n) == plain_shape(line), line


def test_blocks_neighbours_and_seen_lines(monkeypatch):
    texts = [LINES, ["x", "x", LINES[0]], [""]]
    whole = lq.measure(texts)
    monkeypatch.setattr(lq, "BLOCK", 30)
    for a, b in zip(whole, lq.measure(texts)):
        assert np.array_equal(a, b)
    steps, _, starts = whole
    assert steps[:, -1].tolist() == [0] * len(LINES) + [0, 1, 0] + [0]
    features = lq.with_neighbours(steps, starts)
    m = len(lq.MEASURES)
    at = lambda f: (f - np.arange(3 * m) * lq.WIDTH).reshape(3, m)
    own, before, behind = at(features[1])
    assert np.array_equal(own, steps[1]) and np.array_equal(before, steps[0]) and np.array_equal(behind, steps[2])
    assert (at(features[0])[1] == lq.NO_LINE).all() and (at(features[len(LINES) - 1])[2] == lq.NO_LINE).all()
    assert features.max() < lq.SIZE


def small_case(seed=3, n=7):
    rng = np.random.default_rng(seed)
    model = lq.LineModel(rng.normal(size=lq.SIZE), rng.normal(size=(2, 2)), rng.normal(size=2))
    features = rng.integers(0, lq.SIZE, (n, 5))
    starts = np.zeros(n, bool)
    starts[[0, 3]] = True
    return model, features, starts, rng.integers(0, 2, n)


def log_score(model, features, starts, labels):
    total = 0.0
    for i, y in enumerate(labels):
        half = model.weights[features[i]].sum() / 2
        total += half if y else -half
        total += model.start[y] if starts[i] else model.transition[labels[i - 1], y]
    return total


def test_marginals_and_slopes_equal_all_labellings():
    model, features, starts, truth = small_case()
    every = list(itertools.product([0, 1], repeat=len(truth)))
    weight = np.exp([log_score(model, features, starts, y) for y in every])
    assert np.allclose(model.good(features, starts), (weight[:, None] * np.array(every)).sum(0) / weight.sum())

    def loss():
        return (np.log(np.exp([log_score(model, features, starts, y) for y in every]).sum()) - log_score(model, features, starts, truth)) / len(truth)

    slopes = lq.slopes_of(model, features, starts, truth)
    for value, slope in zip((model.weights, model.transition, model.start), slopes):
        for place in [tuple(i) for i in np.argwhere(slope != 0)[:12]]:
            kept = value[place]
            value[place] = kept + 1e-5
            up = loss()
            value[place] = kept - 1e-5
            down = loss()
            value[place] = kept
            assert (up - down) / 2e-5 == pytest.approx(slope[place], abs=1e-6)


def test_means_weigh_lines_by_their_characters():
    got = lq.weighted_means(np.array([1.0, 0.0, 0.25, 0.75]), np.array([30.0, 10.0, 0.0, 0.0]), np.array([True, False, True, False]))
    assert got.tolist() == [0.75, 0.5]


def test_held_out_quality(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{big}/{name}.parquet") for name in ("documents", "labels"))
    held = fold("doc_id", 5) == 0
    model = lq.train_line_model(docs, labels, ~held)
    rows = lq.score_lines(docs.where(held).join(labels, "doc_id"), model, keep=("doc_id", "quality")).collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert len(good) > 500 and len(bad) > 80
    assert np.mean(np.array(good) >= lq.THRESHOLD) > 0.995 and np.mean(np.array(bad) < lq.THRESHOLD) > 0.9
    again = lq.train_line_model(docs.repartition(5), labels.repartition(3), ~held)
    assert np.allclose(model.weights, again.weights) and model.slope == pytest.approx(again.slope)
    mixed = spark.createDataFrame([(1, "Thes are the words of this line, and on.\n" + "THE!! WORDS!! AND!! ON!! " * 40)], "doc_id int, text string")
    row = lq.score_lines(mixed, model, with_lines=True).first()
    assert len(row.lines) == 2 == row.n_lines and row.line_good[1] < 0.5 and row.score < lq.THRESHOLD


def test_odd_rows_and_missing_marks(spark, odd, empty):
    marks = spark.createDataFrame([(3, 0), (4, 1), (4, 1), (5, 0), (6, 1), (7, 1), (8, 0), (None, 1), (10, None)], "doc_id long, quality int")
    model = lq.train_line_model(odd, marks, F.lit(True))
    assert isinstance(model, lq.LineModel)
    for df, m in ((odd, model), (odd, lq.train_line_model(odd, marks.where("quality = 1"), F.lit(True))), (odd, lq.train_line_model(odd, marks.limit(0), F.lit(True)))):
        rows = lq.score_lines(df, m, keep=("doc_id", "text", "score")).collect()
        assert len(rows) == df.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
        assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
        same = [r.score for r in rows if r.doc_id == 7]
        assert same[0] == same[1]
    assert lq.train_line_model(odd, marks.where("quality = 1"), F.lit(True)) == 1.0
    assert lq.train_line_model(odd, marks.limit(0), F.lit(True)) == 0.5
    assert lq.score_lines(empty, model).count() == 0 and lq.train_line_model(empty, marks, F.lit(True)) == 0.5


def test_the_sample_is_bounded_where_an_id_repeats(spark):
    """One id in a third of all rows brings a part of them only."""
    docs = spark.createDataFrame([(1, "good words of a line")] * 600 + [(i, f"line {i} ## ##") for i in range(2, 1200)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 2)) for i in range(1, 1200)], "doc_id long, quality int")
    grabbed = []
    kept = lq.fit
    try:
        lq.fit = lambda docs, share, rounds: grabbed.append(docs) or lq.LineModel(np.zeros(lq.SIZE), np.zeros((2, 2)), np.zeros(2))
        lq.train_line_model(docs, marks, F.lit(True), docs_per_class=50)
    finally:
        lq.fit = kept
    for mark in (0, 1):
        assert 20 <= sum(d[0] == mark for d in grabbed[0]) <= 90
