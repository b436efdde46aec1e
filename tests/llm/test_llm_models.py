"""Class bigrams, toxicity and language ID: exact figures by brute force, quality on held-out rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.llm import class_lm, language_crf, queries, secret_scan, toxicity_pu
from signalloom.llm.arrow import fold


def plain_base(rows):
    counts, total = Counter(), 0
    for r in rows:
        if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
            words = [*(r.text or "").encode().lower().split(), None]
            counts.update(words)
            total += len(words)
    size = len(counts)
    for r in rows:
        words = [*(r.text or "").encode().lower().split(), None]
        yield r, len(words), sum(counts[w] > 0 for w in words), total, sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (size + 1))) for w in words)


def check_lm(df, **sizes):
    keyed = df.select("doc_id", "text").withColumn("key", F.monotonically_increasing_id()).cache()
    out = class_lm.score_texts(keyed, fold("doc_id", 5) != 1, keep=("doc_id", "key"), **sizes).collect()
    got = {r.key: r for r in out}
    rows = keyed.collect()
    assert len(out) == len(rows)
    for r, n, known, total, base in plain_base(rows):
        g = got[r.key]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (n, known, total)
        assert g.base_score == pytest.approx(base, rel=1e-9)
        assert math.isfinite(g.score) and g.score < 0
    return out


def test_base_scores_and_held_out_gain(documents):
    out = check_lm(documents)
    held = [r for r in out if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_few_kept_words_give_the_same_counts(documents):
    check_lm(documents.where("doc_id < 60"), head=40, clustered=12, k=4, rounds=3)


def test_odd_texts(odd, empty):
    check_lm(odd, k=4, rounds=2)
    assert class_lm.score_texts(empty, F.lit(True)).count() == 0
    untrained = class_lm.score_texts(odd.where("length(text) < 100"), F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in untrained)


def test_the_model_is_a_distribution(documents):
    texts = documents.where("doc_id < 80").select(class_lm._body("text"))
    model, counts, totals = class_lm.fit(documents.sparkSession, texts, head=50, clustered=20, k=5, rounds=2)
    k = len(model.transition)
    assert np.allclose((10**model.transition).sum(1), 1)
    kept = len(model.numbers)
    for c in range(k - 2):
        assert (10 ** model.share[np.nonzero(model.classes[:kept] == c)[0]]).sum() == pytest.approx(1)
    rare = {r.word: r.n for r in counts.collect()}
    clustered = {w.decode() for w, i in model.numbers.items() if model.classes[i] != k - 2}
    inside = sum(n + 0.5 for w, n in rare.items() if w not in clustered) + 0.5
    assert inside == pytest.approx(totals["rare_all"])


def test_moves_are_those_of_the_plain_likelihood():
    rng = np.random.default_rng(4)
    n, k = 12, 4
    pairs = rng.integers(0, 6, (n, n)).astype(float)
    classes = rng.integers(0, k, n)

    def likelihood(classes):
        table = np.zeros((k, k))
        np.add.at(table, (classes[:, None], classes[None, :]), pairs)
        x = class_lm.entropy_terms
        return x(table).sum() - x(table.sum(0)).sum() - x(table.sum(1)).sum(), table

    _, table = likelihood(classes)
    for w in range(n):
        itself = pairs[w, w]
        after, before = np.bincount(classes, pairs[w], k), np.bincount(classes, pairs[:, w], k)
        after[classes[w]] -= itself
        before[classes[w]] -= itself
        got = class_lm.best_classes(classes[[w]], before[None], after[None], np.array([itself]), table, k)[0]
        tried = [likelihood(np.where(np.arange(n) == w, c, classes))[0] for c in range(k)]
        assert tried[got] == pytest.approx(max(tried))


def test_exchange_finds_alternating_classes(spark):
    rng = np.random.default_rng(6)
    texts = spark.createDataFrame([(" ".join(f"{'xy'[i % 2]}{rng.integers(5)}" for i in range(60)),) for _ in range(40)], "_text_ string")
    numbers = {f"{kind}{i}".encode(): n for n, (kind, i) in enumerate((kind, i) for kind in "xy" for i in range(5))}
    near = class_lm.neighbours(texts, spark.sparkContext.broadcast(numbers), 10)
    classes, bigrams = class_lm.exchange(spark, near, 10, k=2, rounds=20, share=4)
    assert sorted([classes[:5].tolist(), classes[5:10].tolist()]) == [[0] * 5, [1] * 5]
    assert bigrams[0, 1] + bigrams[1, 0] == 40 * 59 and bigrams[3].sum() == 40


def test_rare_words_are_dealt_by_the_same_gain():
    rng = np.random.default_rng(9)
    k, rows = 5, 40
    bigrams = rng.integers(60, 400, (k + 2, k + 2)).astype(float)
    before, after = (rng.integers(0, 4, (rows, k + 2)) * (rng.random((rows, k + 2)) < 0.4) * 1.0 for _ in range(2))
    itself = rng.integers(0, 3, rows).astype(float)
    bigrams[k, k] += 1000
    want = class_lm.best_classes(np.full(rows, k), before, after, itself, bigrams, k)
    assert class_lm.classes_of_rare(before, after, itself, bigrams).tolist() == want.tolist() and len(set(want.tolist())) > 2


def test_lists_of_a_rare_word_do_not_grow_with_the_tasks(spark):
    """However many tasks counted a word, it has one entry for each pair of classes beside it."""
    rng = np.random.default_rng(8)
    rows = [(" ".join(w for _ in range(40) for w in (f"x{rng.integers(3)}", "seldom", f"y{rng.integers(3)}")),) for _ in range(64)]
    texts = spark.createDataFrame(rows, "_text_ string")
    numbers = {f"{kind}{i}".encode(): n for n, (kind, i) in enumerate((kind, i) for kind in "xy" for i in range(3))}
    model = class_lm.ClassModel(numbers, np.array([0, 0, 0, 1, 1, 1, 2, 3]), np.zeros((4, 4)), np.zeros(8), np.zeros(8), True,
                                np.ones(8), np.zeros((4, 4)), 6)
    shared = spark.sparkContext.broadcast(model)
    for parts in (1, 4, 16):
        raw = class_lm.rare_words(texts.repartition(parts), shared)
        summed = raw.where("next IS NULL").groupBy("word", "code").agg(F.sum("n").alias("n")).collect()
        assert [(r.word, r.n) for r in summed] == [(class_lm.hash_of(b"seldom"), 64 * 40)]
    assert spark.range(1).select(F.xxhash64(F.lit("Seldöm"))).first()[0] == class_lm.hash_of("Seldöm".encode())


def test_ties_at_the_limit_are_filled_in_word_order(spark):
    counts = spark.createDataFrame([(f"w{i:02d}", 6) for i in range(40)] + [("top", 900), ("once", 1)], "word string, n long")
    assert class_lm.frequent(counts, 30, 2) == [("top", 900), *((f"w{i:02d}", 6) for i in range(29))]
    assert len(class_lm.frequent(counts, 41, 2)) == 41 and class_lm.frequent(counts.where("n = 1"), 5, 2) == []


def test_words_beyond_the_rounds_have_classes(spark):
    """Each of 200 words stands beside 4 clustered ones; an order that never occurs must score lower."""
    rng = np.random.default_rng(2)
    line = lambda: [f"{'xy'[i % 2]}{rng.integers(2) if rng.random() < 0.5 else rng.integers(100)}" for i in range(60)]
    rows = [(i, " ".join(line())) for i in range(60)] + [(100, "x7 y9 x8 y6"), (101, "x7 x8 y9 y6")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for head in (4, 30, 1000):
        got = {r.doc_id: r.score for r in class_lm.score_texts(df, F.col("doc_id") < 100, head=head, clustered=4, k=2, rounds=10).collect()}
        assert got[100] > got[101] + 1


@pytest.mark.parametrize("head", [12, 40, 300])
def test_scores_follow_from_all_words_and_classes(documents, head):
    """However many words are sent along, the score is that of the formula over all classes."""
    spark, docs = documents.sparkSession, documents.where("doc_id < 60").select("doc_id", "text").cache()
    texts = docs.where("doc_id % 3 > 0").select(class_lm._body("text"))
    model, counts, totals = class_lm.fit(spark, texts, head=head, clustered=12, k=4, rounds=3)
    model, rest, totals = class_lm.deal_rest(spark, texts, model, totals)
    size, n = len(model.bigrams), {r.word.encode(): r.n for r in counts.collect()}
    cls = {w: int(model.classes[i]) for w, i in model.numbers.items()}
    cls |= {r.word.encode(): r.cls for r in rest.collect()}
    assert set(cls) == set(n) and all(n[w] > 1 for w in n if cls[w] != size - 2)
    assert sum(cls[w] != size - 2 for w in cls) > 12
    table, in_class = np.zeros((size, size)), np.zeros(size)
    for r in texts.collect():
        way = [size - 1, *(cls[w] for w in class_lm.tokens(r._text_)), size - 1]
        np.add.at(table, (way[:-1], way[1:]), 1)
    assert np.array_equal(table, model.bigrams)
    for w in n:
        in_class[cls[w]] += n[w] + (0.5 if cls[w] == size - 2 else 0)
    in_class[size - 2] += 0.5
    assert np.allclose(in_class[:-1], totals["in_class"][:-1])
    step = class_lm.transitions(table)
    got = {r.doc_id: r.score for r in class_lm.score_texts(docs, F.col("doc_id") % 3 > 0, head=head, clustered=12, k=4, rounds=3).collect()}
    for r in docs.collect():
        words = class_lm.tokens(r.text or "")
        way = [size - 1, *(cls.get(w, size - 2) for w in words), size - 1]
        want = step[way[:-1], way[1:]].sum()
        want += sum(math.log10((n.get(w, 0) + (0.5 if c == size - 2 else 0)) / in_class[c]) for w, c in zip(words, way[1:]))
        assert got[r.doc_id] == pytest.approx(want, rel=1e-9)


def test_toxicity_on_held_out_rows(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    marks = spark.read.parquet(f"{big}/labels.parquet")
    rows = queries.QUERIES["op7_toxicity_pu"](spark, big).join(marks, "doc_id").where("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in toxic) > 0.85 * len(toxic)
    assert sum(r.predicted for r in clean) < 0.03 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_toxicity_without_anything_to_learn(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 0), (None, 1, 1), (6, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity_pu.train_toxicity_model(odd, labels, F.lit(True))
    assert model is None
    out = toxicity_pu.score_toxicity(odd, model).collect()
    assert len(out) == odd.count() and all((r.score, r.predicted) == (0.0, 0) for r in out)
    assert toxicity_pu.score_toxicity(empty, toxicity_pu.train_toxicity_model(empty, labels, F.lit(True))).count() == 0


def test_corrected_risk_beats_counting_unlabelled_as_negative():
    rng = np.random.default_rng(2)
    toxic = [[0] + list(rng.choice(np.arange(2, 40), 3)) for _ in range(400)]
    clean = [[1] + list(rng.choice(np.arange(2, 40), 3)) for _ in range(1600)]
    weights, bias = toxicity_pu.fit_nnpu(toxic[:200], toxic[200:300] + clean[:400], 40, prior=0.2)
    score = lambda d: toxicity_pu.logistic(bias + weights[d].sum())
    assert np.mean([score(d) >= 0.7 for d in toxic[300:]]) > 0.95
    assert np.mean([score(d) >= 0.7 for d in clean[400:]]) < 0.02


def test_language_on_held_out_rows(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{big}/documents.parquet")
    rows = queries.QUERIES["op10_language_crf"](spark, big).join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) > 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(odd, empty):
    model = language_crf.train_language_model(odd, F.lit(True))
    rows = language_crf.identify_language(odd, model, keep=("doc_id", "text", "score"), with_words=True).collect()
    assert len(rows) == odd.count()
    for r in rows:
        letters = any(map(str.isalpha, r.text or ""))
        assert (r.lang_pred in model.languages and r.score > 0) if letters else (r.lang_pred, r.score) == ("und", 0.0)
        assert len(r.words) == len(r.word_langs)
    none = language_crf.train_language_model(empty, F.lit(True))
    assert {r.lang_pred for r in language_crf.identify_language(odd, none).collect()} == {"und"}
    assert language_crf.identify_language(empty, model).count() == 0


def test_code_switched_words(documents, spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    model = language_crf.train_language_model(docs, F.lit(True))
    sample = {r.lang: language_crf.words_of(r.text)[:30] for r in docs.where("n_chars > 1500").collect()}
    mixed = sample["en"] + sample["de"] + sample["fr"]
    df = spark.createDataFrame([(1, " ".join(mixed))], "doc_id long, text string")
    labels = language_crf.identify_language(df, model, with_words=True).first().word_langs
    truth = ["en"] * 30 + ["de"] * 30 + ["fr"] * 30
    assert sum(a == b for a, b in zip(labels, truth)) > 75


def test_forward_backward_equals_the_plain_recursions():
    rng = np.random.default_rng(0)
    n, k = 97, 3
    emission, transition, start = rng.normal(size=(n, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    starts = rng.random(n) < 0.1
    starts[0] = True
    got, joint = language_crf.forward_backward(emission, starts, transition, start, lane=7, pairs=True)
    step, weight = np.exp(transition), np.exp(emission)
    ahead, back = np.zeros((n, k)), np.ones((n, k))
    for t in range(n):
        ahead[t] = (np.exp(start) if starts[t] else ahead[t - 1] @ step) * weight[t]
    for t in range(n - 2, -1, -1):
        if not starts[t + 1]:
            back[t] = step @ (weight[t + 1] * back[t + 1])
    want = ahead * back
    assert np.allclose(got, want / want.sum(1, keepdims=True))
    both = np.zeros((k, k))
    for t in np.nonzero(~starts)[0]:
        x = ahead[t - 1][:, None] * step * (weight[t] * back[t])[None]
        both += x / x.sum()
    assert np.allclose(joint, both)


def test_chains_side_by_side_equal_lanes():
    rng = np.random.default_rng(1)
    n, k = 140, 6
    emission, transition, start = rng.normal(size=(n, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    starts = rng.random(n) < 0.2
    starts[0] = True
    for a, b in zip(
        language_crf.forward_backward(emission, starts, transition, start, pairs=True),
        language_crf.chains_side_by_side(emission, starts, transition, start, pairs=True),
    ):
        assert np.allclose(a, b)


def test_features_and_slopes_of_the_language_field():
    """Summed weights against a loop, and a fit against all labellings of a tiny chain."""
    rng = np.random.default_rng(2)
    weights = rng.normal(size=(language_crf.BUCKETS + 3, 3))
    words = ["der", "the", "étés", "x"]
    features = [language_crf.word_features(w, {"der": (1,), "the": (0, 2)}) for w in words]
    want = np.stack([weights[f].sum(0) for f in features])
    assert np.allclose(language_crf.sum_features(features, weights), want)
    sizes = np.array([len(f) for f in features])
    assert np.allclose(language_crf.sum_weights(np.concatenate(features), sizes, weights, held=9), want)
    assert language_crf.word_features("the", {"the": (0, 2)})[-2:] == [language_crf.BUCKETS, language_crf.BUCKETS + 2]
    assert len(set(language_crf.word_features("der", {}))) == 6 + 3


def test_three_hundred_small_languages(spark):
    """Every labelled language is learned; each has words of its own."""
    rng = np.random.default_rng(3)
    letters = [chr(c) for c in range(0x0430, 0x0450)] + [chr(c) for c in range(0x0561, 0x0580)]
    stems = ["".join(rng.choice(letters, 3)) for _ in range(300)]
    rows = [(i, " ".join(stems[i % 300] + "".join(rng.choice(letters, 2)) for _ in range(8)), f"l{i % 300:03d}") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_crf.train_language_model(df, F.col("doc_id") < 900)
    assert len(model.languages) == 300
    got = language_crf.identify_language(df.where("doc_id >= 900"), model, keep=("doc_id", "lang")).collect()
    right = sum(r.lang == r.lang_pred for r in got)
    assert right > 0.95 * len(got), right
    many = spark.range(600).selectExpr("id AS doc_id", "'a b' AS text", "concat('l', id) AS lang")
    with pytest.raises(ValueError, match="more than 512 languages"):
        language_crf.train_language_model(many, F.lit(True))


def test_samples_are_bounded_where_a_text_repeats(spark, monkeypatch):
    """A text in a third of all rows enters in part, not whole and not never."""
    df = spark.range(9000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'le mot de la fin' ELSE concat('the word ', id, ' is') END AS text",
                                      "CASE WHEN id % 3 = 0 THEN 'fr' ELSE 'en' END AS lang")
    drawn = []
    monkeypatch.setattr(language_crf, "fit", lambda samples: drawn.append(samples))
    language_crf.train_language_model(df, F.lit(True), docs_per_language=200)
    per = {lang: sum(x[0] == lang for x in drawn[0]) for lang in ("fr", "en")}
    assert all(140 <= n <= 270 for n in per.values())
    sampled = secret_scan.sample_of(df.selectExpr("text", "CAST(doc_id AS STRING) AS id"), ["id", "text"], 9000, 900)
    assert 200 <= sampled.where("text LIKE 'le %'").count() <= 400
    marks = df.selectExpr("doc_id", "CAST(doc_id = 0 AS INT) AS toxic")
    monkeypatch.setattr(toxicity_pu, "fit_nnpu", lambda p, u, size, prior: drawn.append((len(p), len(u))) or (np.zeros(size), 0.0))
    repeated = df.selectExpr("CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id END AS doc_id", "text")
    toxicity_pu.train_toxicity_model(repeated, marks, F.lit(True), positives=150, unlabelled=600)
    assert 90 <= drawn[1][0] <= 210 and 480 <= drawn[1][1] <= 720


def plain_risk(weights, bias, positives, unlabelled, prior):
    """The non-negative risk by its definition, with the logistic loss."""
    margin = lambda docs: np.array([bias + sum(weights[f] for f in d) for d in docs])
    loss = lambda m: np.log1p(np.exp(-m))
    rest = loss(-margin(unlabelled)).mean() - prior * loss(-margin(positives)).mean()
    return prior * loss(margin(positives)).mean() + max(0.0, rest), rest


def test_a_step_of_the_risk_goes_down_its_slope():
    """The first step of the fit moves every weight against the slope of the risk, found by differences."""
    rng = np.random.default_rng(5)
    size, prior = 6, 0.3
    docs = lambda n, p: [sorted(np.flatnonzero(rng.random(size) < p).tolist()) for _ in range(n)]
    positives, unlabelled = docs(12, [0.8, 0.7, 0.2, 0.2, 0.5, 0.1]), docs(40, [0.3, 0.2, 0.4, 0.5, 0.5, 0.6])
    weights, bias = toxicity_pu.fit_nnpu(positives, unlabelled, size, prior, steps=1, rate=1e-3, penalty=0.0)
    start = np.log(prior / (1 - prior))
    zero = np.zeros(size)
    assert plain_risk(zero, start, positives, unlabelled, prior)[1] >= 0
    for f in range(size):
        nudge = np.zeros(size)
        nudge[f] = 1e-5
        up, down = (plain_risk(s * nudge, start, positives, unlabelled, prior)[0] for s in (1, -1))
        if abs(up - down) > 1e-9:
            assert np.sign(weights[f]) == -np.sign(up - down)
    assert plain_risk(weights, bias, positives, unlabelled, prior)[0] < plain_risk(zero, start, positives, unlabelled, prior)[0]
    fitted = toxicity_pu.fit_nnpu(positives, unlabelled, size, prior, steps=200)
    assert plain_risk(*fitted, positives, unlabelled, prior)[0] < plain_risk(zero, start, positives, unlabelled, prior)[0] - 0.02


def test_frequencies_and_kept_features_equal_a_loop(spark):
    rows = [(i, f"word{i % 7} bad{i % 2}" if i % 4 == 0 else f"word{i % 7} fine", i % 4 == 0) for i in range(80)]
    df = spark.createDataFrame(rows, "_key long, _text string, _toxic boolean")
    features = toxicity_pu.Features()
    counts = {True: {}, False: {}}
    for _, text, toxic in rows:
        for f in features.of(text):
            counts[toxic][f] = counts[toxic].get(f, 0) + 1
    got = toxicity_pu.document_frequencies(df)
    assert {(r.bucket, r.toxic): r.n for r in got.collect()} == {(f, t): n for t in counts for f, n in counts[t].items()}
    kept = toxicity_pu.telling_features(got, 20, 80)
    z = {}
    for f in counts[True].keys() | counts[False].keys():
        every, among = (counts[True].get(f, 0) + counts[False].get(f, 0)) / 80, counts[True].get(f, 0) / 20
        score = abs(among - every) / np.sqrt(every * (1 - every) / 20 + 1e-12)
        if score >= toxicity_pu.LEAST_Z and (counts[True].get(f, 0) >= toxicity_pu.LEAST_POSITIVES or among < every):
            z[f] = score
    assert kept == sorted(z)
