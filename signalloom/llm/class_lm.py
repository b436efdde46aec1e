"""LM scoring by Brown's class-based bigrams.

The frequent words of the training texts are dealt to classes by exchange
clustering: each word moves to the class that raises the likelihood of the class
bigrams most. A word then has the probability of its class after the class before,
times its share of the class. Every further word seen twice or more is then dealt once,
by the same gain, to the class that its neighbours speak for, and the class bigrams are
counted anew. Words that no class gains by, those seen once and all unseen ones form a
class of their own, in which a word's share comes from its exact count. Words seen once
are never clustered, so that this class has seen words like the unseen ones.

How it is spread out: words are counted in every training text and summed up by
word. The most frequent words, a bounded number, get numbers; their bigrams are
counted and kept as one row per word with its neighbours. A round of clustering is a
scan of those rows, with the bounded class map sent along; only class totals and new
classes come back. The further words are a table, grouped by the 64-bit hash of the word with the classes beside
each, and stay one: the driver gets class totals. (Two words of the same hash would get the same class; their
counts stay their own.) Texts are scored where they lie, with
the counts and classes of a bounded number of words; just the rarest words of a text, and
the transitions from and to them, go through a join with that table.

Null and empty texts consist of the end alone. Rows with a null id are trained on and
scored; rows that repeat count as often as they occur. Without any training text every
word is unseen, and both scores follow from the formulas with zero counts.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from signalloom.llm.arrow import column, slices, small_batches
from signalloom.session import settle

#: Most words whose shares are sent to every worker, and most words that take part in the rounds.
HEAD_WORDS = 1 << 18
CLUSTERED_WORDS = 1 << 15
#: Least count of a clustered word: words seen once stand for the unseen ones.
LEAST_COUNT = 2
CLASSES = 64
ROUNDS = 12
#: One in so many words may move in a round.
SHARE = 2
#: Weight of the overall class shares in a class's transitions.
PRIOR = 5.0
#: Entries that a worker gathers before it passes them on.
HELD_WORDS = 250_000
HELD_TOKENS = 1 << 21
HELD_PAIRS = 1 << 19
#: Words whose moves are evaluated at a time, and least slices of the clustered words.
MOVED = 64
SLICES = 48


def tokens(text: str) -> list[bytes]:
    """Words between blanks, A-Z in lower case."""
    return text.encode().lower().split()


def number(texts: list[str], lookup, rare: int, end: int) -> tuple[list[list[bytes]], np.ndarray]:
    """The words of each text, and the numbers of all: the end, then each text's words and the end again."""
    split = [tokens(t) for t in texts]
    ids = np.empty(sum(map(len, split)) + len(split) + 1, dtype=np.int64)
    ids[0], at = end, 1
    for words in split:
        ids[at : at + len(words)] = np.fromiter(map(lookup, words, repeat(rare)), np.int64, len(words))
        at += len(words) + 1
        ids[at - 1] = end
    return split, ids


def hash_of(word: bytes) -> int:
    """Spark's ``xxhash64`` of the word."""
    h = xxhash.xxh64_intdigest(word, 42)
    return h - (1 << 64) if h >> 63 else h


def _body(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text_")


def count_words(texts: DataFrame) -> DataFrame:
    """``(word, n)`` over all texts."""

    def batch_of(counts: Counter) -> pa.RecordBatch:
        words = pa.array(list(counts), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], ["word", "n"])

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for body in batch.column(0):
                counts.update(tokens(body.as_py()))
                if len(counts) > HELD_WORDS:
                    yield batch_of(counts)
                    counts = Counter()
        yield batch_of(counts)

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int, least: int) -> list[tuple[str, int]]:
    """At most ``most`` words with the highest counts, all with ``least`` or more.

    The limit is found from numbers of words by size of the count, so that no more
    than the words kept come to the driver.
    """
    level = F.floor(F.log2("n") * 16)
    levels = counts.where(F.col("n") >= least).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()
    held, limit, part = 0, None, None
    for row in sorted(levels, key=lambda r: -r.level):  # at most 16 levels for each doubling
        if held + row.words > most:
            part = row.level
            break
        held, limit = held + row.words, row.level
    kept = counts.where(F.col("n") >= least)
    found = kept.where(level >= limit).toArrow().to_pylist() if limit is not None else []
    if part is not None and 2 * held < most:  # of a level that does not fit, the first words, rather than leave most places empty
        rest = kept.where(level == part).orderBy(F.col("n").desc(), "word").limit(most - held)
        found += rest.toArrow().to_pylist()
    return sorted(((row["word"], row["n"]) for row in found), key=lambda x: (-x[1], x[0]))


def neighbours(texts: DataFrame, numbers, rare: int) -> DataFrame:
    """One row per word numbered below ``rare`` with the words before and after it, and how often.

    ``rare`` stands for all other words and ``rare + 1`` for the end, which also
    precedes the first word.
    """
    size, end = rare + 2, rare + 1
    kind = np.uint32 if size**2 <= 1 << 32 else np.int64  # short numbers are sorted faster

    def batch_of(codes: list[np.ndarray]) -> pa.RecordBatch:
        pairs, n = np.unique(np.concatenate(codes), return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array((pairs // size).astype(np.int32)), pa.array((pairs % size).astype(np.int32)), pa.array(n.astype(np.int64))], ["a", "b", "n"]
        )

    def run(batches):
        lookup = numbers.value.get
        codes, held = [], 0
        for batch in batches:
            for part in slices(batch, "_text_"):
                _, ids = number(part.column(0).to_pylist(), lookup, rare, -1)
                ids = np.where(ids < 0, end, np.minimum(ids, rare))
                codes.append((ids[:-1] * size + ids[1:]).astype(kind))
                held += len(ids)
                if held > HELD_TOKENS:
                    yield batch_of(codes)
                    codes, held = [], 0
        if codes:
            yield batch_of(codes)

    pairs = settle(texts.mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "bigrams")
    after = pairs.groupBy(F.col("a").alias("word")).agg(F.collect_list("b").alias("next"), F.collect_list("n").alias("next_n"))
    before = pairs.groupBy(F.col("b").alias("word")).agg(F.collect_list("a").alias("prev"), F.collect_list("n").alias("prev_n"))
    # a list holds each numbered word once at most
    parts = max(SLICES, texts.sparkSession.sparkContext.defaultParallelism)
    joined = after.join(before, "word", "full").repartition(parts, "word")  # a bounded table
    return settle(joined, "neighbours")


def _neighbour_counts(words: np.ndarray, lists: pa.ListArray, counts: pa.ListArray, classes: np.ndarray, k: int):
    """Counts of each word's neighbours by class, and how often the word is its own neighbour."""
    rows = len(words)
    owner = np.repeat(np.arange(rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    near = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    n = counts.flatten().to_numpy(zero_copy_only=False)
    same = near == words[owner]
    itself = np.bincount(owner[same], n[same], rows)
    return np.bincount(owner * k + classes[near], n, rows * k).reshape(rows, k), itself


def _parts(batch: pa.RecordBatch, rows: int = 128):
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def class_bigrams(near: DataFrame, classes, k: int) -> np.ndarray:
    """How often a class follows a class."""

    def run(batches):
        total = np.zeros((k, k))
        for batch in batches:
            for part in _parts(batch):
                word = part.column(0).to_numpy()
                after, _ = _neighbour_counts(word, part.column(1), part.column(2), classes.value, k)
                np.add.at(total, classes.value[word], after)
        a, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((a * k + b).astype(np.int32)), pa.array(total[a, b].astype(np.int64))], ["pair", "n"])

    rows = near.select("word", "next", "next_n").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(k * k)
    for row in rows:  # at most k x k
        out[row.pair] = row.n
    return out.reshape(k, k)


def entropy_terms(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def best_classes(own: np.ndarray, before: np.ndarray, after: np.ndarray, itself: np.ndarray, bigrams: np.ndarray, movable: int) -> np.ndarray:
    """The class of each word that gives the class bigrams the highest likelihood.

    ``before`` and ``after`` hold a word's neighbours by class, without itself;
    ``itself`` how often it follows itself. Only the first ``movable`` classes can be
    chosen. All words are judged against the same totals, each taken out of its class.
    """
    rows, k = before.shape
    at = np.arange(rows)
    total = np.broadcast_to(bigrams, (rows, k, k)).copy()
    total[at, :, own] -= before
    total[at, own, :] -= after
    total[at, own, own] -= itself
    total = np.maximum(total, 0.0)
    plain = np.broadcast_to(entropy_terms(bigrams), (rows, k, k)).copy()  # the totals differ from the bigrams beside the own class only
    plain[at, :, own] = entropy_terms(total[at, :, own])
    plain[at, own, :] = entropy_terms(total[at, own, :])
    into = entropy_terms(total + before[:, :, None]) - plain  # (row, class before, class chosen)
    out = entropy_terms(total + after[:, None, :]) - plain  # (row, class chosen, class after)
    diagonal = np.arange(k)
    loop = total[:, diagonal, diagonal]
    joined = entropy_terms(loop + before + after + itself[:, None]) - entropy_terms(loop)
    gain = into.sum(1) + out.sum(2) - into[:, diagonal, diagonal] - out[:, diagonal, diagonal] + joined
    n_before, n_after = before.sum(1) + itself, after.sum(1) + itself
    # class totals without the word's own occurrences, but with those of its neighbours beside it
    as_next, as_first = total.sum(1) + after, total.sum(2) + before
    gain -= entropy_terms(as_next + n_before[:, None]) - entropy_terms(as_next)
    gain -= entropy_terms(as_first + n_after[:, None]) - entropy_terms(as_first)
    best = gain[:, :movable].argmax(1)
    stays = gain[at, best] <= gain[at, own] + 1e-9
    return np.where(stays, own, best)


def whose_turn(words: np.ndarray, turn: int, share: int) -> np.ndarray:
    """One in ``share`` words, others in each round, so that neighbours seldom swap."""
    mixed = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((turn + 1) * 0xD1B54A32D192ED03 % (1 << 64))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(40)) % np.uint64(share) == 0


def move_words(near: DataFrame, classes, bigrams: np.ndarray, movable: int, turn: int, share: int = SHARE) -> list[tuple[int, int]]:
    """New classes of the words whose turn it is."""
    k = len(bigrams)

    def run(batches):
        for batch in batches:
            word = batch.column(0).to_numpy()
            now = classes.value
            mine = np.nonzero((now[word] < movable) & whose_turn(word, turn, share))[0]
            for at in range(0, len(mine), MOVED):
                part = batch.take(pa.array(mine[at : at + MOVED]))
                ids = part.column(0).to_numpy()
                after, itself = _neighbour_counts(ids, part.column(1), part.column(2), now, k)
                before, _ = _neighbour_counts(ids, part.column(3), part.column(4), now, k)
                own = now[ids].astype(np.int64)
                rows = np.arange(len(ids))
                after[rows, own] -= itself
                before[rows, own] -= itself
                new = best_classes(own, before, after, itself, bigrams, movable)
                moved = new != own
                yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(new[moved].astype(np.int32))], ["word", "cls"])

    rows = near.select("word", "next", "next_n", "prev", "prev_n").mapInArrow(run, "word int, cls int").collect()
    return [(row.word, row.cls) for row in rows]  # at most one for each numbered word


def exchange(spark: SparkSession, near: DataFrame, words: int, k: int = CLASSES, rounds: int = ROUNDS, share: int = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the numbered words, of the rare word and of the end, and the class bigrams.

    Words that move at the same time do not see each other's moves, so a round may
    lose likelihood; the best state of all rounds is the result.
    """
    movable = max(1, min(k, words))
    size = movable + 2
    classes = np.append(np.arange(words) % movable, [movable, movable + 1]).astype(np.int32)
    best = None
    for turn in range(rounds + 1):
        shared = spark.sparkContext.broadcast(classes)
        bigrams = class_bigrams(near, shared, size)
        fit = likelihood(bigrams)
        if best is None or fit > best[0]:
            best = (fit, classes, bigrams)
        if turn == rounds:
            break
        classes = classes.copy()
        for word, cls in move_words(near, shared, bigrams, movable, turn, share):
            classes[word] = cls
    return best[1], best[2]


def likelihood(bigrams: np.ndarray) -> float:
    """Log-likelihood of the class bigrams, up to what does not depend on the classes."""
    return float(entropy_terms(bigrams).sum() - entropy_terms(bigrams.sum(0)).sum() - entropy_terms(bigrams.sum(1)).sum())


@dataclass
class ClassModel:
    """All that a worker needs to score a text up to its rare words."""

    numbers: dict[bytes, int]
    classes: np.ndarray
    transition: np.ndarray  # log10, class before x class
    share: np.ndarray  # log10 of a word's part of its class; 0 for the rare word
    base: np.ndarray  # log10 of a word's smoothed unigram probability; 0 for the rare word
    known_end: bool
    counts: np.ndarray  # of the numbered words, the rare word (0) and the end
    bigrams: np.ndarray  # how often a class follows a class
    dealt: int  # words that took part in the rounds


def fit(spark: SparkSession, texts: DataFrame, head: int = HEAD_WORDS, clustered: int = CLUSTERED_WORDS, k: int = CLASSES, rounds: int = ROUNDS):
    """``(model, counts of all training words, totals)`` from the training texts."""
    counts = settle(count_words(texts), "words")
    n_texts = texts.count()
    n_words, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, vocabulary = n_words + n_texts, kinds + (n_texts > 0)
    top = frequent(counts, head, LEAST_COUNT)
    numbers = {word.encode(): i for i, (word, _) in enumerate(top)}
    dealt, rare, end = min(clustered, len(top)), len(top), len(top) + 1
    near = neighbours(texts, spark.sparkContext.broadcast(numbers), dealt)
    found, bigrams = exchange(spark, near, dealt, k, rounds)
    classes = np.full(end + 1, found[dealt], dtype=np.int32)
    classes[:dealt], classes[end] = found[:dealt], found[dealt + 1]

    n = np.array([c for _, c in top] + [0, n_texts], dtype=float)
    in_class = np.bincount(classes[:dealt], n[:dealt], len(bigrams))
    rare_total, rare_kinds = n_words - int(n[:dealt].sum()), kinds - dealt
    rare_all, base_all = rare_total + 0.5 * (rare_kinds + 1), total + 0.5 * (vocabulary + 1)
    share = np.log10((n + 0.5) / rare_all)
    share[:dealt] = np.log10(n[:dealt] / in_class[classes[:dealt]])
    base = np.log10((n + 0.5) / base_all)
    share[end] = share[rare] = base[rare] = 0.0
    model = ClassModel(numbers, classes, transitions(bigrams), share, base, n_texts > 0, n, bigrams, dealt)
    return model, counts, {"total": total, "base_all": base_all, "rare_all": rare_all}


def transitions(bigrams: np.ndarray) -> np.ndarray:
    """log10 of the smoothed probability that a class follows a class."""
    seen = bigrams.sum(0)
    overall = (seen + 0.5) / (seen.sum() + 0.5 * len(seen))
    return np.log10((bigrams + PRIOR * overall) / (bigrams.sum(1, keepdims=True) + PRIOR))


def rare_words(texts: DataFrame, model) -> DataFrame:
    """``(word, next, code, n)``: what stands beside the words outside the rounds, words as hashes.

    Without ``next``, ``code`` holds the classes before and after an occurrence of the
    word, the number of classes standing for the word itself. With ``next``, another such
    word (or the same) follows it.
    """

    def counted(first: list[np.ndarray], second: list[np.ndarray]):
        """Each pair of entries once, and how often it occurs."""
        if not first:
            return (np.zeros(0, np.int64),) * 3
        a, left = np.unique(np.concatenate(first), return_inverse=True)
        b, right = np.unique(np.concatenate(second), return_inverse=True)
        both, n = np.unique(left * len(b) + right, return_counts=True)
        return a[both // max(1, len(b))], b[both % max(1, len(b))], n

    def batch_of(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        keys, codes, firsts, nexts = zip(*held) if held else ([],) * 4
        word, code, n = counted(keys, codes)
        a, b, m = counted(firsts, nexts)
        none = lambda size, kind: pa.nulls(size, kind)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([word, a])), pa.concat_arrays([none(len(word), pa.int64()), pa.array(b)]),
             pa.concat_arrays([pa.array(code.astype(np.int32)), none(len(a), pa.int32())]), pa.array(np.concatenate([n, m]).astype(np.int64))],
            ["word", "next", "code", "n"],
        )

    def run(batches):
        known = model.value
        lookup, unknown, end = known.numbers.get, len(known.numbers), len(known.numbers) + 1
        size = len(known.bigrams)
        hashes = np.append(np.fromiter(map(hash_of, known.numbers), np.int64, unknown), [0, 0])
        held, entries = [], 0
        for batch in batches:
            for part in slices(batch, "_text_"):
                split, ids = number(part.column(0).to_pylist(), lookup, unknown, end)
                classes = known.classes[ids].astype(np.int64)
                keys = hashes[ids]
                hidden = ids == unknown
                place, words = 1, []
                for found in split:
                    words += [found[i] for i in np.flatnonzero(hidden[place : place + len(found)]).tolist()]
                    place += len(found) + 1
                keys[hidden] = np.fromiter(map(hash_of, words), np.int64, len(words))
                at = np.flatnonzero(classes == size - 2)
                if not len(at):
                    continue
                keys, before, after = keys[at], classes[at - 1], classes[at + 1]
                follow = np.flatnonzero(np.diff(at) == 1)
                itself = follow[keys[follow] == keys[follow + 1]]
                after[itself] = before[itself + 1] = size
                held.append((keys, before * (size + 1) + after, keys[follow], keys[follow + 1]))
                entries += len(keys)
                if entries > HELD_PAIRS:
                    yield batch_of(held)
                    held, entries = [], 0
        yield batch_of(held)

    return texts.mapInArrow(run, "word long, next long, code int, n long")


def classes_of_rare(before: np.ndarray, after: np.ndarray, itself: np.ndarray, bigrams: np.ndarray) -> np.ndarray:
    """:func:`best_classes` of words in the rare class, by the few classes beside each."""
    rows, size = before.shape
    rare = size - 2
    plain, chosen = entropy_terms(bigrams), np.arange(rare)
    n_before, n_after = before.sum(1) + itself, after.sum(1) + itself
    gain, stay = np.zeros((rows, rare)), np.zeros(rows)
    for own, other, table, terms in ((before, after, bigrams, plain), (after, before, bigrams.T, plain.T)):
        row, cls = np.nonzero(own)
        n = own[row, cls][:, None]
        there, was = table[cls][:, :rare], terms[cls][:, :rare]
        mixed = cls == rare  # beside a rare word, the word's own occurrences are among the totals
        if mixed.any():
            there = there.copy()
            there[mixed] = np.maximum(there[mixed] - other[row[mixed]][:, :rare], 0.0)
            was = was.copy()
            was[mixed] = entropy_terms(there[mixed])
        more = entropy_terms(there + n) - was
        more[cls[:, None] == chosen] = 0.0  # counted with the class itself
        if len(row):  # in ascending order
            firsts = np.flatnonzero(np.diff(row, prepend=-1))
            gain[row[firsts]] += np.add.reduceat(more, firsts, axis=0)
        out = cls != rare
        left = np.maximum(table[cls[out], rare] - n[out, 0], 0.0)
        stay += np.bincount(row[out], entropy_terms(left + n[out, 0]) - entropy_terms(left), rows)
    loop = bigrams[chosen, chosen]
    gain += entropy_terms(loop + before[:, :rare] + after[:, :rare] + itself[:, None]) - entropy_terms(loop)
    both = before[:, rare] + after[:, rare] + itself
    left = np.maximum(bigrams[rare, rare] - both, 0.0)
    stay += entropy_terms(left + both) - entropy_terms(left)
    for total, n in ((bigrams.sum(0), n_before), (bigrams.sum(1), n_after)):
        gain -= entropy_terms(total[:rare] + n[:, None]) - entropy_terms(total[:rare])
        left = np.maximum(total[rare] - n, 0.0)
        stay -= entropy_terms(left + n) - entropy_terms(left)
    best = gain.argmax(1)
    return np.where(gain[np.arange(rows), best] <= stay + 1e-9, rare, best)


def deal_rest(
    spark: SparkSession, texts: DataFrame, model: ClassModel, totals: dict, counts: DataFrame | None = None
) -> tuple[ClassModel, DataFrame, dict]:
    """The model with every further repeated word in its class, ``(word, n, cls)`` of all
    words outside the rounds, and the totals with ``rare_all`` and ``in_class`` as they are then.
    ``counts`` are those of :func:`count_words`, if they are known."""
    size = len(model.bigrams)
    rare, bigrams = size - 2, model.bigrams
    raw = settle(rare_words(texts, spark.sparkContext.broadcast(model)), "rare")
    # summed first, so that a list has one entry for each pair of classes at most, however many tasks counted the word
    summed = raw.where("next IS NULL").groupBy("word", "code").agg(F.sum("n").alias("n"))
    grouped = summed.groupBy("word").agg(F.collect_list("code").alias("codes"), F.collect_list("n").alias("ns"), F.sum("n").alias("n"))
    grouped = grouped.where(F.col("n") >= LEAST_COUNT)

    def run(batches):
        moves = np.zeros((2, size, size), dtype=np.int64)  # (after or before the word, its class, the other class)
        for batch in batches:
            for part in _parts(batch):
                rows, n = part.num_rows, part.column(3).to_numpy()
                owner = np.repeat(np.arange(rows), part.column(1).value_lengths().to_numpy(zero_copy_only=False))
                code = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                times = part.column(2).flatten().to_numpy(zero_copy_only=False)
                beside = lambda cls: np.bincount(owner * (size + 1) + cls, times, rows * (size + 1)).reshape(rows, size + 1)
                before, after = beside(code // (size + 1)), beside(code % (size + 1))
                cls = classes_of_rare(before[:, :size], after[:, :size], before[:, size], bigrams)
                moved = np.nonzero(cls != rare)[0]
                np.add.at(moves[0], cls[moved], after[moved, :size].astype(np.int64))
                np.add.at(moves[1], cls[moved], before[moved, :size].astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(moved)), pa.array(n[moved]), pa.array(cls[moved].astype(np.int32))],
                                                 ["word", "n", "cls"])
        moves[:, :, rare] = 0  # pairs of two rare words are counted below
        side, own, other = np.nonzero(moves)
        codes = pa.array(((side * size + own) * size + other).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(codes), pa.int64()), pa.array(moves[side, own, other]), codes], ["word", "n", "cls"])

    dealt = settle(grouped.mapInArrow(run, "word long, n long, cls int"), "dealt")
    moved = dealt.where("word IS NOT NULL").select("word", "cls")
    inside = [(hash_of(word), -1) for word, i in model.numbers.items() if i < model.dealt]
    classed = moved.unionAll(spark.createDataFrame(inside, "word long, cls int")).withColumnRenamed("word", "_hash")
    known = (counts or count_words(texts)).join(classed, F.xxhash64("word") == F.col("_hash"), "left")
    known = known.select("word", "n", F.coalesce("cls", F.lit(rare)).cast("int").alias("cls")).where("cls >= 0")
    known = settle(known, "classes")
    bigrams = bigrams.copy()
    for code, n in dealt.where("word IS NULL").groupBy("cls").agg(F.sum("n")).collect():  # at most 2 x k x k
        (side, own), other = divmod(code // size, size), code % size
        into, out = ((own, other), (rare, other)) if side == 0 else ((other, own), (other, rare))
        bigrams[into] += n
        bigrams[out] -= n
    pairs = raw.where("next IS NOT NULL").groupBy("word", "next").agg(F.sum("n").alias("n"))
    pairs = pairs.join(moved.withColumnRenamed("cls", "a"), "word", "left")
    pairs = pairs.join(moved.select(F.col("word").alias("next"), F.col("cls").alias("b")), "next", "left")
    for a, b, n in pairs.where("a IS NOT NULL OR b IS NOT NULL").groupBy("a", "b").agg(F.sum("n")).collect():  # at most k x k
        bigrams[rare if a is None else a, rare if b is None else b] += n
        bigrams[rare, rare] -= n

    top, classes = len(model.numbers), model.classes.copy()
    if top > model.dealt:
        least, last = int(model.counts[top - 1]), list(model.numbers)[-1].decode()  # numbers follow the count, then the word
        numbered = (F.col("n") > least) | ((F.col("n") == least) & (F.col("word") <= last))
        for word, cls in known.where(numbered & (F.col("cls") != rare)).select("word", "cls").collect():
            classes[model.numbers[word.encode()]] = cls
    in_class = np.bincount(model.classes[: model.dealt], model.counts[: model.dealt], size)
    rare_all = totals["rare_all"]
    for cls, n, kinds in known.where(F.col("cls") != rare).groupBy("cls").agg(F.sum("n"), F.count(F.lit(1))).collect():
        in_class[cls] += n
        rare_all -= n + 0.5 * kinds
    in_class[rare] = rare_all
    share, inside = model.share.copy(), classes[:top] != rare
    share[:top] = np.log10((model.counts[:top] + np.where(inside, 0.0, 0.5)) / in_class[classes[:top]])
    whole = replace(model, classes=classes, transition=transitions(bigrams), share=share, bigrams=bigrams)
    return whole, known, {**totals, "rare_all": rare_all, "in_class": in_class}


def score_texts(
    df: DataFrame, learn: Column, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
    head: int = HEAD_WORDS, clustered: int = CLUSTERED_WORDS, k: int = CLASSES, rounds: int = ROUNDS,
) -> DataFrame:
    """``keep`` with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` and ``perplexity``.

    The model is learned from the rows where ``learn`` holds. ``score`` is the log10
    probability of the text with its end, ``perplexity`` that of a token.
    """
    spark = df.sparkSession
    small_batches(spark)
    texts = df.where(learn).select(_body(text))
    model, counts, totals = fit(spark, texts, head, clustered, k, rounds)
    model, counts, totals = deal_rest(spark, texts, model, totals, counts)
    shared = spark.sparkContext.broadcast(model)
    made = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
    held = [c for c in keep if c not in made]
    inner = df.select(*[F.col(f"`{c}`") for c in held], _body(text))
    schema = ", ".join([*(f"`{c}` {inner.schema[c].dataType.simpleString()}" for c in held),
                        "_tokens long, _known long, _base double, _score double, _rare array<string>, _near array<int>"])

    def run(batches):
        model = shared.value
        lookup, rare, end = model.numbers.get, len(model.numbers), len(model.numbers) + 1
        size = len(model.transition)
        for batch in batches:
            for part in slices(batch, "_text_"):
                split, ids = number(part.column("_text_").to_pylist(), lookup, rare, end)
                sizes = np.array([len(words) + 1 for words in split])
                classes = model.classes[ids]
                firsts = np.cumsum(sizes) - sizes
                hidden = ids == rare  # words whose class only the join gives
                steps = np.where(hidden[:-1] | hidden[1:], 0.0, model.transition[classes[:-1], classes[1:]])
                score = np.add.reduceat(steps + model.share[ids[1:]], firsts)
                base = np.add.reduceat(model.base[ids[1:]], firsts)
                unknown = hidden[1:]
                place = np.nonzero(hidden)[0]
                beside = np.where(hidden, size, classes)
                near = beside[place - 1] * (size + 1) + beside[place + 1]
                known = sizes - np.add.reduceat(unknown.astype(np.int64), firsts) - (0 if model.known_end else 1)
                left = [[words[i] for i in np.nonzero(unknown[f : f + len(words)])[0]] for words, f in zip(split, firsts)]
                lengths = np.cumsum([0, *map(len, left)])
                flat = pa.array([w for words in left for w in words], pa.binary()).cast(pa.string())
                offsets = pa.array(lengths, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, v) for v in (flat, pa.array(near.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in held), column(sizes, "long"), column(known, "long"), column(base, "double"),
                     column(score, "double"), *lists],
                    [*held, "_tokens", "_known", "_base", "_score", "_rare", "_near"],
                )

    # written once, so that the row numbers below stay what they are
    partly = settle(inner.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()), "partly")
    size = len(model.transition)
    listed = partly.select("_row", F.posexplode(F.arrays_zip("_rare", "_near")).alias("_at", "_each"))
    words = listed.select("_row", "_at", F.col("_each._rare").alias("word"), F.col("_each._near").alias("_near"))
    c, cls = F.coalesce(F.col("n"), F.lit(0)), F.coalesce(F.col("cls"), F.lit(size - 2))
    found = words.join(counts, "word", "left").select("_row", "_at", "_near", c.alias("n"), cls.alias("cls"))
    whole = F.array(*[F.lit(float(v)) for v in np.log10(np.maximum(totals["in_class"], 0.5))])
    part = F.log10(F.col("n") + F.when(F.col("cls") == size - 2, 0.5).otherwise(0.0)) - F.get(whole, F.col("cls"))
    packed = (F.col("_at").cast("long") * (size + 1) ** 2 + F.col("_near")) * size + F.col("cls")
    rest = found.groupBy("_row").agg(
        F.sum(F.log10(F.col("n") + 0.5)).alias("_logs"), F.sum(part).alias("_parts"), F.sum((F.col("n") > 0).cast("long")).alias("_more"),
        F.collect_list(packed).alias("_packed"),
    )

    def steps(batches):
        transition = shared.value.transition
        for batch in batches:
            sums = []
            for item in batch.column("_packed"):
                code = np.sort(item.values.to_numpy(zero_copy_only=False))  # by place in the text
                cls, near = code % size, code // size % (size + 1) ** 2
                before, after = near // (size + 1), near % (size + 1)
                first, last = before < size, after < size
                total = transition[before[first], cls[first]].sum() + transition[cls[last], after[last]].sum()
                then = np.nonzero(~last)[0]  # the next rare word follows at once
                sums.append(total + transition[cls[then], cls[then + 1]].sum())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_row", "_logs", "_parts", "_more")), column(sums, "double")],
                                             ["_row", "_logs", "_parts", "_more", "_steps"])

    rest = rest.select("_row", "_logs", "_parts", "_more", "_packed")
    rest = rest.mapInArrow(steps, "_row long, _logs double, _parts double, _more long, _steps double")
    out = partly.select("*", F.size("_rare").alias("_left")).drop("_rare", "_near").join(rest, "_row", "left")
    score = F.col("_score") + F.coalesce("_parts", F.lit(0.0)) + F.coalesce("_steps", F.lit(0.0))
    base = F.col("_base") + F.coalesce("_logs", F.lit(0.0)) - F.col("_left") * F.lit(float(np.log10(totals["base_all"])))
    return out.select(
        *[F.col(f"`{c}`") for c in held],
        F.col("_tokens").alias("n_tokens"),
        (F.col("_known") + F.coalesce("_more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(totals["total"]).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("_tokens")).alias("perplexity"),
    )
