"""Quality classifier: a linear-chain conditional random field that labels every line good or bad.

A line is described by its shape (length, words, shares of kinds of characters, repeated
words, first and last character, whether the document had it before), each measure cut into steps, and
by the same steps of the line before and the line behind. Weights of the steps and of the change from label
to label are learned from documents marked good or bad; a line starts with its document's mark,
and lines of a bad document that the model takes for good are given that label before the model is fitted again, as
a bad document may hold good lines (its worst line stays bad). Forward-backward gives each line its probability of being
good; a document's quality is their mean weighted by the characters of the lines, turned into a
probability by a logistic curve fitted on the training documents.

Lines without a character other than blanks are left out; a text that has no other line (null and
empty ones too) is one line without characters. Texts are read whole. Repeated rows are scored alike; of an id that is
marked twice the worse mark counts, and null ids and marks are not learned from. Without marks
of both kinds no model is fitted, and every text scores the share of good marks (0.5 without any). An empty table gives no rows.

Memory: a slice of texts at a time, its lines measured in blocks of about a million characters (a longer line alone). The
fit uses at most about ``docs_per_class`` documents of each mark, ``lines_per_doc`` lines of each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from signalloom.llm.arrow import add_columns, column, slices, small_batches
from signalloom.llm.language_crf import forward_backward

#: The training sample: documents of each mark, neighbouring lines of a document.
DOCS_PER_CLASS = 4000
LINES_PER_DOC = 64
ROUNDS = 2
STEPS = 60
THRESHOLD = 0.3
BLOCK = 1 << 20

LOWER, UPPER, LETTER, DIGIT, POINT, SIGN, BLANK = range(7)
KINDS = 7
SHARES = (0.0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8, 0.95)
SIZES = (0, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024)
WORD_SIZES = (0.0, 1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 7.5, 9.0, 12.0, 20.0)
CODES = tuple(range(11))
#: Measures of a line and the upper ends of their steps.
MEASURES = {
    "characters": SIZES, "words": SIZES, "word_size": WORD_SIZES, "lower": SHARES, "upper": SHARES, "letters": SHARES, "digits": SHARES,
    "points": SHARES, "signs": SHARES, "words_ending_in_a_sign": SHARES, "words_of_signs": SHARES, "repeated_words": SHARES, "distinct_words": SHARES,
    "first": CODES, "last": CODES, "seen": CODES,
}
#: Steps of a measure; the last one stands for a line that is not there.
WIDTH = len(SHARES) + 2
NO_LINE = WIDTH - 1


def kinds_of_characters() -> np.ndarray:
    table = np.full(1 << 16, SIGN, np.uint8)
    for code in range(1 << 16):
        c = chr(code)
        if c.isspace():
            table[code] = BLANK
        elif c.isalpha():
            table[code] = UPPER if c.isupper() else LOWER if c.islower() else LETTER
        elif c.isdecimal():
            table[code] = DIGIT
        elif c in ".,;:?!'\"()-–—’“”«»¿¡":
            table[code] = POINT
    return table


_tables: dict[str, np.ndarray] = {}


def kind_table() -> np.ndarray:
    if "kinds" not in _tables:
        _tables["kinds"] = kinds_of_characters()
        _tables["mix"] = np.random.default_rng(11).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _tables["kinds"]


def lines_of(text: str) -> list[str]:
    return [line for line in text.split("\n") if not line.isspace() and line] or [""]


def shapes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Steps of all measures but ``seen`` for each line, and the number of its characters that are not blank."""
    table, mix = kind_table(), _tables["mix"]
    codes = np.frombuffer("\n".join([*lines, ""]).encode("utf-32-le"), np.uint32)
    kind = table[np.minimum(codes, (1 << 16) - 1)]
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    ends = np.cumsum(sizes + 1)  # behind the line feed of each line
    starts = ends - sizes - 1

    def per_line(flags):
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[ends - 1] - total[starts]

    of_kind = np.stack([per_line(kind == k) for k in range(KINDS)], axis=1)
    solid = sizes - of_kind[:, BLANK]
    inside = kind != BLANK
    opens = inside & np.concatenate([[True], ~inside[:-1]])
    closes = inside & np.concatenate([~inside[1:], [True]])
    word_at, word_end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    n_words = per_line(opens)
    line_of_word = np.searchsorted(ends, word_at, side="right")
    count = lambda flags: np.bincount(line_of_word, flags, len(lines))
    signs = np.concatenate([[0], np.cumsum(kind == SIGN)])
    all_signs = signs[word_end] - signs[word_at] == word_end - word_at
    if len(word_at):
        at = np.arange(len(codes)) - np.repeat(np.concatenate([[0], word_at]), np.diff(np.concatenate([[0], word_at, [len(codes)]])))
        mixed = np.where(inside, codes.astype(np.uint64) * mix[at % 64], np.uint64(0))
        words = np.add.reduceat(mixed, word_at)
        same = np.concatenate([[False], (words[1:] == words[:-1]) & (line_of_word[1:] == line_of_word[:-1])])
        order = np.lexsort((words, line_of_word))
        new = np.ones(len(words), bool)
        new[order[1:]] = (words[order[1:]] != words[order[:-1]]) | (line_of_word[order[1:]] != line_of_word[order[:-1]])
    else:
        same = new = np.zeros(0, bool)
    per_character, per_word = np.maximum(solid, 1), np.maximum(n_words, 1)
    edge = np.full((2, len(lines)), KINDS)
    held = n_words > 0
    firsts = np.searchsorted(line_of_word, np.flatnonzero(held))
    lasts = np.searchsorted(line_of_word, np.flatnonzero(held), side="right") - 1
    edge[0, held], edge[1, held] = kind[word_at[firsts]], kind[word_end[lasts] - 1]
    values = [
        solid, n_words, solid / per_word, *(of_kind[:, k] / per_character for k in (LOWER, UPPER, LETTER, DIGIT, POINT, SIGN)),
        count(kind[word_end - 1] == SIGN) / per_word, count(all_signs) / per_word, count(same) / per_word, count(new) / per_word,
        edge[0], edge[1],
    ]
    return np.stack([np.searchsorted(steps, v, side="left") for v, steps in zip(values, MEASURES.values())], axis=1).astype(np.uint8), solid


def measure(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the lines of all texts: steps of all measures, characters, and whether the line is a text's first."""
    lines = [line for text in texts for line in text]
    found, begin, held = [], 0, 0
    for i, line in enumerate(lines):
        if held and held + len(line) > BLOCK:
            found.append(shapes(lines[begin:i]))
            begin, held = i, 0
        held += len(line) + 1
    found.append(shapes(lines[begin:]))
    seen = []
    for text in texts:
        known: set[str] = set()
        for line in text:
            seen.append(line in known)
            known.add(line)
    starts = np.zeros(len(lines), bool)
    starts[np.cumsum([0, *map(len, texts)])[:-1]] = True
    steps = np.concatenate([f[0] for f in found])
    return np.column_stack([steps, np.array(seen, np.uint8)]), np.concatenate([f[1] for f in found]), starts


def with_neighbours(steps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Feature numbers of each line: its own steps, those of the line before and those of the line behind."""
    before, behind = np.roll(steps, 1, axis=0), np.roll(steps, -1, axis=0)
    before[starts] = NO_LINE
    behind[np.roll(starts, -1)] = NO_LINE
    every = np.concatenate([steps, before, behind], axis=1).astype(np.int64)
    return every + np.arange(every.shape[1]) * WIDTH


SIZE = 3 * len(MEASURES) * WIDTH


@dataclass
class LineModel:
    weights: np.ndarray
    transition: np.ndarray
    start: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def good(self, features: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Each line's probability of being good."""
        half = self.weights[features].sum(1) / 2
        return forward_backward(np.column_stack([-half, half]), starts, self.transition, self.start)[:, 1]

    def quality(self, means: np.ndarray) -> np.ndarray:
        return logistic(self.slope * odds(means) + self.shift)


def odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def weighted_means(values: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Means per text, weighted by ``weights`` (a text without weight: plain)."""
    at = np.flatnonzero(starts)
    total = np.add.reduceat(weights, at)
    sizes = np.diff(np.append(at, len(values)))
    bare = np.repeat(total == 0, sizes)
    weights = np.where(bare, 1.0, weights)
    return np.add.reduceat(values * weights, at) / np.add.reduceat(weights, at)


def slopes_of(model: LineModel, features: np.ndarray, starts: np.ndarray, truth: np.ndarray) -> list[np.ndarray]:
    """Gradient of the mean negative log-likelihood of a labelling."""
    half = model.weights[features].sum(1) / 2
    posterior, joint = forward_backward(np.column_stack([-half, half]), starts, model.transition, model.start, pairs=True)
    excess = posterior[:, 1] - truth
    seen = np.zeros((2, 2))
    inner = ~starts[1:]
    np.add.at(seen, (truth[:-1][inner], truth[1:][inner]), 1)
    begun = np.array([-excess[starts].sum(), excess[starts].sum()])
    by_feature = np.bincount(features.ravel(), np.repeat(excess, features.shape[1]), SIZE)
    return [by_feature / len(truth), (joint - seen) / len(truth), begun / len(truth)]


def fit_lines(features, starts, truth, model: LineModel | None = None, steps: int = STEPS, rate: float = 0.1, penalty: float = 1e-4) -> LineModel:
    """Maximum conditional likelihood by Adam on the whole sample."""
    model = model or LineModel(np.zeros(SIZE), np.zeros((2, 2)), np.zeros(2))
    values = [model.weights, model.transition, model.start]
    mean, square = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, steps + 1):
        for i, (value, slope) in enumerate(zip(values, slopes_of(model, features, starts, truth))):
            slope = slope + penalty * value
            mean[i] = 0.9 * mean[i] + 0.1 * slope
            square[i] = 0.99 * square[i] + 0.01 * slope * slope
            value -= rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-8)
    return model


def fit(docs: list[tuple[int, np.ndarray, np.ndarray]], share_good: float, rounds: int = ROUNDS) -> LineModel:
    """A model from ``(mark, features of the lines, characters of the lines)`` of each document."""
    marks = np.array([d[0] for d in docs])
    sizes = np.array([len(d[1]) for d in docs])
    features, characters = np.concatenate([d[1] for d in docs]), np.concatenate([d[2] for d in docs]).astype(float)
    starts = np.zeros(len(features), bool)
    starts[np.cumsum(sizes) - sizes] = True
    owner = np.repeat(np.arange(len(docs)), sizes)
    truth = marks[owner]
    model = fit_lines(features, starts, truth)
    for _ in range(rounds - 1):
        good = model.good(features, starts)
        worst = good <= np.minimum.reduceat(good, np.flatnonzero(starts))[owner]
        truth = np.where((marks[owner] == 0) & (good > 0.5) & ~worst, 1, marks[owner])
        model = fit_lines(features, starts, truth, model)
    # the curve weighs documents as they occur, not as they were drawn
    x = odds(weighted_means(model.good(features, starts), characters, starts))
    weight = np.where(marks == 1, share_good / max(1, marks.sum()), (1 - share_good) / max(1, (1 - marks).sum()))
    slope, shift = 1.0, 0.0
    for _ in range(100):
        p = logistic(slope * x + shift)
        away, bend = weight * (p - marks), weight * p * (1 - p)
        first = np.array([(away * x).sum() + 1e-3 * (slope - 1), away.sum() + 1e-3 * shift])
        second = np.array([[(bend * x * x).sum() + 1e-3, (bend * x).sum()], [(bend * x).sum(), bend.sum() + 1e-3]])
        move = np.linalg.solve(second, first)
        move = move / max(1.0, np.abs(move).max())
        slope, shift = max(0.05, slope - move[0]), shift - move[1]
        if np.abs(move).max() < 1e-9:
            break
    model.slope, model.shift = float(slope), float(shift)
    return model


def train_line_model(
    df: DataFrame, labels: DataFrame, learn: Column, text: str = "text", doc_id: str = "doc_id", quality: str = "quality",
    docs_per_class: int = DOCS_PER_CLASS, lines_per_doc: int = LINES_PER_DOC, rounds: int = ROUNDS,
) -> LineModel | float:
    """Fit on documents where ``learn`` (of the id alone) holds and ``labels`` has a mark.

    Ids are drawn by their hash; where ids repeat, rows by their place in the table. Without
    marks of both kinds the share of good marks is returned.
    """
    small_batches(df.sparkSession)
    key = F.col(f"`{doc_id}`")
    marks = labels.where(learn & key.isNotNull() & F.col(f"`{quality}`").isNotNull())
    marks = marks.groupBy(key.alias("_key")).agg(F.min((F.col(f"`{quality}`") > 0).cast("int")).alias("_mark"))
    n = {row["_mark"]: row["n"] for row in marks.groupBy("_mark").agg(F.count(F.lit(1)).alias("n")).collect()}
    share_good = n.get(1, 0) / sum(n.values()) if n else 0.5
    if len(n) < 2:
        return share_good
    share = F.when(F.col("_mark") == 1, min(1.0, docs_per_class / n[1])).otherwise(min(1.0, docs_per_class / n[0]))
    drawn = F.broadcast(marks.where(F.pmod(F.xxhash64("_key", F.lit(17)), F.lit(1_000_000)) < share * 1_000_000))  # bounded by docs_per_class
    rows = df.where(learn).select(key.alias("_key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))
    chosen = rows.join(drawn, "_key")
    held = {row["_mark"]: row["n"] for row in chosen.groupBy("_mark").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(held) < 2:
        return share_good
    share = F.when(F.col("_mark") == 1, min(1.0, docs_per_class / held[1])).otherwise(min(1.0, docs_per_class / held[0]))
    chosen = chosen.where(F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(19)), F.lit(1_000_000)) < share * 1_000_000)
    place = F.pmod(F.xxhash64("_key", F.lit(23)), F.lit(1 << 40))

    def window(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                texts = [lines_of(t) for t in part.column("_text").to_pylist()]
                steps, characters, starts = measure(texts)
                features = with_neighbours(steps, starts).astype(np.int32)
                ends = np.cumsum([0, *map(len, texts)])
                spans = []
                for at, begin, end in zip(part.column("_place").to_pylist(), ends[:-1], ends[1:]):
                    first = begin + at % max(1, end - begin - lines_per_doc + 1)
                    spans.append((first, min(end, first + lines_per_doc)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_mark"), column([features[a:b].tobytes() for a, b in spans], "binary"),
                     column([characters[a:b].tobytes() for a, b in spans], "binary")],
                    ["mark", "features", "characters"],
                )

    sample = chosen.select("_mark", "_text", place.alias("_place")).mapInArrow(window, "mark int, features binary, characters binary").collect()
    sample = sorted((row.mark, bytes(row.features), bytes(row.characters)) for row in sample)
    wide = 3 * len(MEASURES)
    docs = [(m, np.frombuffer(f, np.int32).reshape(-1, wide), np.frombuffer(c, np.int64)) for m, f, c in sample]
    return fit(docs, share_good, rounds)


def score_lines(
    df: DataFrame, model: LineModel | float, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD,
    with_lines: bool = False,
) -> DataFrame:
    """``keep`` with ``score``, ``predicted`` (1 from ``threshold`` on), ``n_lines`` and ``n_bad_lines``.

    ``with_lines`` adds the lines and the probability of each to be good.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    fields = {"score": "double", "n_lines": "long", "n_bad_lines": "long"}
    if with_lines:
        fields |= {"lines": "array<string>", "line_good": "array<double>"}

    def label(bodies: list[str]) -> dict[str, list]:
        model = shared.value
        texts = [lines_of(t) for t in bodies]
        ends = np.cumsum([0, *map(len, texts)])
        if isinstance(model, float):
            good, score = np.full(ends[-1], model), np.full(len(texts), model)
        else:
            steps, characters, starts = measure(texts)
            good = model.good(with_neighbours(steps, starts), starts)
            score = model.quality(weighted_means(good, characters.astype(float), starts))
        bad = np.concatenate([[0], np.cumsum(good < 0.5)])
        out = {"score": score, "n_lines": np.diff(ends), "n_bad_lines": np.diff(bad[ends])}
        if with_lines:
            out |= {"lines": texts, "line_good": [good[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]}
        return out

    found = add_columns(df, text, fields, label, tuple(c for c in keep if c != "predicted"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
