"""Language ID: a linear-chain conditional random field over the words of a text.

Each word is a place of the chain, its label a language. Emissions are sums of
learned weights of hashed affixes, character trigrams and lexicon marks; transitions
are learned from sequences in which runs of documents of different languages follow
each other, so that code-switched text gets its labels by forward-backward. A
document's language is the one with the highest mean posterior over its words, and
the score is that mean.

A text without a letter (null and empty ones too) is ``und`` with score 0, and so is
every text if no labelled row was learned from. Null languages are not learned from;
null and repeated ids do not matter.

All labelled languages are learned. Memory bounds how many there can be: weights of all
features take 260 KB a language, and more than :data:`MODEL_BYTES` of them are refused. The sample of
a language shrinks as their number grows, so that words times languages stay below :data:`FIT_CELLS`, and
texts are labelled in slices of :data:`LABEL_CELLS` words times languages.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from signalloom.llm.arrow import add_columns, small_batches

LETTERS = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 15
UNDETERMINED = "und"

#: The training sample: documents of each language, and words of a document.
DOCS_PER_LANGUAGE = 1500
WORDS_PER_DOC = 64
#: Bytes of the weights of a model; words times languages in a fit, and in a slice of texts.
MODEL_BYTES = 1 << 27
FIT_CELLS = 1 << 23
LABEL_CELLS = 1 << 22
#: Languages up to which chains are cut into lanes; the cost of that grows with their cube.
LANE_LANGUAGES = 8
#: Most frequent words of each language in the sample that make its lexicon.
LEXICON_WORDS = 1500
STEPS = 50
#: Words whose emissions a worker keeps, and most bytes of them.
KEPT_WORDS = 200_000
KEPT_BYTES = 1 << 26


def words_of(text: str) -> list[str]:
    words = LETTERS.findall(text.lower())
    return words if text.isascii() else [w for w in words if any(map(str.isalpha, w))]


def word_features(word: str, lexicon: dict[str, tuple[int, ...]]) -> list[int]:
    marked = f"<{word}>"
    named = [f"p{word[:n]}" for n in (1, 2, 3)] + [f"s{word[-n:]}" for n in (1, 2, 3)]
    named += [marked[i : i + 3] for i in range(len(marked) - 2)]
    return [zlib.crc32(f.encode()) % BUCKETS for f in named] + [BUCKETS + k for k in lexicon.get(word, ())]


def forward_backward(emission, starts, transition, start, lane=64, pairs=False):
    """Posteriors of all places of many chains laid end to end.

    The places are cut into lanes of equal length. Products of the transfer matrices
    of a lane carry both messages across it, so all lanes are worked on at once and
    the result is exact. ``starts`` marks the first place of each chain; ``emission``
    are log-weights. With ``pairs``, also the sum of the posteriors of neighbours.
    With more than :data:`LANE_LANGUAGES` labels the chains are worked on side by side instead.
    """
    n, k = emission.shape
    if k > LANE_LANGUAGES:
        return chains_side_by_side(emission, starts, transition, start, pairs)
    lane = max(1, min(lane, int(n**0.5)))
    lanes = -(-n // lane)
    weight = np.ones((lanes * lane, k))
    weight[:n] = np.exp(emission - emission.max(1, keepdims=True))
    first = np.ones(lanes * lane, dtype=bool)
    first[:n] = starts
    weight = np.ascontiguousarray(weight.reshape(lanes, lane, k).transpose(1, 0, 2))
    first = np.ascontiguousarray(first.reshape(lanes, lane).T)[:, :, None]
    step, begin = np.exp(transition - transition.max()), np.exp(start - start.max())

    across = np.broadcast_to(np.eye(k), (lanes, k, k))
    for t in range(lane):
        moved = np.where(first[t][:, :, None], across.sum(2, keepdims=True) * begin, across @ step)
        across = moved * weight[t][:, None, :]
        across = across / across.max((1, 2), keepdims=True)
    entering, leaving = np.empty((lanes, k)), np.empty((lanes, k))
    message = np.full(k, 1.0 / k)
    for s in range(lanes):
        entering[s] = message
        message = message @ across[s]
        message = message / message.sum()
    message = np.full(k, 1.0)
    for s in range(lanes - 1, -1, -1):
        leaving[s] = message
        message = across[s] @ message
        message = message / message.sum()

    ahead = np.empty((lane, lanes, k))
    message = entering
    before = np.empty((lane, lanes, k)) if pairs else None
    for t in range(lane):
        if pairs:
            before[t] = message
        message = np.where(first[t], begin, message @ step) * weight[t]
        message = message / message.sum(1, keepdims=True)
        ahead[t] = message
    posterior = np.empty((lane, lanes, k))
    message, joint = leaving, np.zeros((k, k))
    for t in range(lane - 1, -1, -1):
        posterior[t] = ahead[t] * message
        seen = weight[t] * message
        if pairs:
            both = before[t][:, :, None] * step * seen[:, None, :]
            both = both / both.sum((1, 2), keepdims=True)
            joint += both[~first[t][:, 0]].sum(0)
        message = np.where(first[t], (seen @ begin)[:, None], seen @ step.T)
        message = message / message.sum(1, keepdims=True)
    posterior /= posterior.sum(2, keepdims=True)
    posterior = posterior.transpose(1, 0, 2).reshape(-1, k)[:n]
    return (posterior, joint) if pairs else posterior


def chains_side_by_side(emission, starts, transition, start, pairs=False):
    """:func:`forward_backward` by places of all chains at once; each place costs labels times labels."""
    n, k = emission.shape
    at = np.flatnonzero(starts)
    sizes = np.diff(np.append(at, n))
    order = np.argsort(-sizes, kind="stable")
    at, sizes = at[order], sizes[order]
    weight = np.exp(emission - emission.max(1, keepdims=True))
    step, begin = np.exp(transition - transition.max()), np.exp(start - start.max())
    open_ = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(int(sizes.max(initial=0)) + 1)]  # chains longer than t
    ahead, posterior, joint = np.empty((n, k)), np.empty((n, k)), np.zeros((k, k))
    message = np.broadcast_to(begin, (len(at), k))
    for t in range(len(open_) - 1):
        rows = at[: open_[t]] + t
        message = (message if t == 0 else message[: len(rows)] @ step) * weight[rows]
        message = message / message.sum(1, keepdims=True)
        ahead[rows] = message
    behind = np.ones((len(at), k))
    for t in range(len(open_) - 2, -1, -1):
        rows = at[: open_[t]] + t
        posterior[rows] = ahead[rows] * behind[: len(rows)]
        if t:
            seen = weight[rows] * behind[: len(rows)]
            into = seen @ step.T
            if pairs:
                before = ahead[rows - 1]
                joint += step * ((before / (before * into).sum(1, keepdims=True)).T @ seen)
            behind[: len(rows)] = into / into.sum(1, keepdims=True)
    posterior /= posterior.sum(1, keepdims=True)
    return (posterior, joint) if pairs else posterior


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray
    transition: np.ndarray
    start: np.ndarray
    lexicon: dict[str, tuple[int, ...]]
    _rows: dict[str, int] = field(default_factory=dict)
    _table: np.ndarray | None = None

    def __getstate__(self):
        return {**self.__dict__, "_rows": {}, "_table": None}

    def emissions(self, words: list[str]) -> np.ndarray:
        """Emission of each word; each distinct word is worked out once."""
        rows = self._rows
        if len(rows) > min(KEPT_WORDS, KEPT_BYTES // (8 * len(self.languages))):
            rows.clear()
            self._table = None
        new = [w for w in dict.fromkeys(words) if w not in rows]
        if new:
            base = len(rows)
            made = sum_features([word_features(w, self.lexicon) for w in new], self.weights)
            if self._table is None or base + len(new) > len(self._table):
                grown = np.empty((2 * (base + len(new)), len(self.languages)))
                if base:
                    grown[:base] = self._table[:base]
                self._table = grown
            self._table[base : base + len(new)] = made
            rows.update(zip(new, range(base, base + len(new))))
        return self._table[np.fromiter(map(rows.__getitem__, words), np.int64, len(words))]

    def posteriors(self, texts: list[list[str]]) -> np.ndarray:
        """Posteriors of all words of non-empty texts, one after the other."""
        words = [w for words in texts for w in words]
        starts = np.zeros(len(words), dtype=bool)
        starts[np.cumsum([0, *map(len, texts)])[:-1]] = True
        return forward_backward(self.emissions(words), starts, self.transition, self.start)


def sum_features(features: list[list[int]], weights: np.ndarray) -> np.ndarray:
    sizes = np.fromiter(map(len, features), np.int64, len(features))
    return sum_weights(np.fromiter((f for fs in features for f in fs), np.int64, int(sizes.sum())), sizes, weights)


def sum_weights(flat: np.ndarray, sizes: np.ndarray, weights: np.ndarray, held: int = FIT_CELLS // 2) -> np.ndarray:
    """Sums of the weights of each word's features, ``sizes`` of them at a time in ``flat``."""
    ends, out = np.cumsum(sizes), np.empty((len(sizes), weights.shape[1]))
    begin = 0
    while begin < len(sizes):
        first = ends[begin] - sizes[begin]
        stop = max(begin + 1, int(np.searchsorted(ends, first + held // weights.shape[1], side="right")))
        part = flat[first : ends[stop - 1]]
        out[begin:stop] = np.add.reduceat(weights[part], ends[begin:stop] - sizes[begin:stop] - first, axis=0)
        begin = stop
    return out


def training_sequences(samples: list[tuple[str, list[str]]], seed: int = 5) -> list[list[tuple[str, str]]]:
    """Half of the samples as they are, the others cut into runs and mixed four at a time."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(samples))
    whole = [[(w, lang) for w in words] for lang, words in (samples[i] for i in order[::2])]
    runs = []
    for lang, words in (samples[i] for i in order[1::2]):
        at = 0
        while at < len(words):
            size = int(rng.integers(4, 20))
            runs.append([(w, lang) for w in words[at : at + size]])
            at += size
    runs = [runs[i] for i in rng.permutation(len(runs))]
    return whole + [sum(runs[i : i + 4], []) for i in range(0, len(runs), 4)]


def fit(samples: list[tuple[str, list[str]]], steps: int = STEPS, rate: float = 0.15, penalty: float = 1e-4) -> LanguageModel:
    """Maximum conditional likelihood by Adam on the whole sample."""
    samples = sorted((lang, words) for lang, words in samples if words)
    languages = sorted({lang for lang, _ in samples})
    place = {lang: i for i, lang in enumerate(languages)}
    k = len(languages)
    counts = {lang: Counter() for lang in languages}
    for lang, words in samples:
        counts[lang].update(words)
    lexicon: dict[str, tuple[int, ...]] = {}
    for lang, counter in counts.items():
        for word, _ in sorted(counter.items(), key=lambda x: (-x[1], x[0]))[:LEXICON_WORDS]:
            lexicon[word] = (*lexicon.get(word, ()), place[lang])
    model = LanguageModel(languages, np.zeros((BUCKETS + k, k)), np.zeros((k, k)), np.zeros(k), lexicon)
    if not k:
        return model
    sequences = training_sequences(samples)
    types: dict[str, int] = {}
    ids = np.array([types.setdefault(w, len(types)) for s in sequences for w, _ in s])
    labels = np.array([place[lang] for s in sequences for _, lang in s])
    starts = np.zeros(len(ids), dtype=bool)
    starts[np.cumsum([0, *map(len, sequences)])[:-1]] = True
    features = [word_features(w, lexicon) for w in types]
    sizes = np.array([len(f) for f in features])
    flat = np.array([f for fs in features for f in fs])
    owner = np.repeat(np.arange(len(features)), sizes)
    # the places of each word, and the words of each feature, one after the other
    places, n_places = np.argsort(ids, kind="stable"), np.bincount(ids, minlength=len(types))
    holders, n_holders = owner[np.argsort(flat, kind="stable")], np.bincount(flat, minlength=BUCKETS + k)
    used = np.flatnonzero(n_holders)  # the others keep their weight of zero
    flat, n_holders = np.searchsorted(used, flat), n_holders[used]
    weights = np.zeros((len(used), k))

    truth = np.eye(k)[labels]
    seen = np.zeros((k, k))
    np.add.at(seen, (labels[:-1][~starts[1:]], labels[1:][~starts[1:]]), 1)
    values = [weights, model.transition, model.start]
    mean, square = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, steps + 1):
        emission = sum_weights(flat, sizes, weights)[ids]
        posterior, joint = forward_backward(emission, starts, model.transition, model.start, pairs=True)
        excess = posterior - truth
        by_feature = sum_weights(holders, n_holders, sum_weights(places, n_places, excess))
        slopes = [by_feature / len(ids), (joint - seen) / len(ids), excess[starts].sum(0) / len(ids)]
        for i, (value, slope) in enumerate(zip(values, slopes)):
            slope = slope + penalty * value / max(1, len(ids) // 1000)
            mean[i] = 0.9 * mean[i] + 0.1 * slope
            square[i] = 0.99 * square[i] + 0.01 * slope * slope
            value -= rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-8)
    model.weights[used] = weights
    return model


def train_language_model(
    df: DataFrame, learn: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
    docs_per_language: int = DOCS_PER_LANGUAGE, words_per_doc: int = WORDS_PER_DOC,
) -> LanguageModel:
    """Fit on a sample of the rows where ``learn`` holds.

    About ``docs_per_language`` documents of each language (fewer of very many languages), chosen by a hash of
    id and text, and of each a window of ``words_per_doc`` words at a place given by the
    hash. Only the windows come to the driver. Languages that do not fit into memory are an error.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    key = F.col(f"`{doc_id}`").cast("string") if doc_id in df.columns else F.lit(None).cast("string")
    rows = df.where(learn & F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{lang}`").cast("string").alias("_lang"), key.alias("_id"), body.alias("_text"))
    rows = rows.withColumn("_hash", F.xxhash64(F.lit(3), "_id", "_text")).withColumn("_row", F.monotonically_increasing_id())
    most = MODEL_BYTES // (8 * BUCKETS)
    first = F.min(F.struct("_hash", "_row")).alias("first")
    sizes = rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("n"), first).orderBy("_lang").limit(most + 1).collect()
    if len(sizes) > most:
        raise ValueError(f"more than {most} languages: their weights take more than {MODEL_BYTES} bytes")
    if not sizes:
        return fit([])
    docs_per_language = max(1, min(docs_per_language, FIT_CELLS // (len(sizes) ** 2 * words_per_doc)))
    small_batches(df.sparkSession)
    # shares as a constant: texts of one language are never gathered
    share = F.create_map(*[F.lit(x) for row in sizes for x in (row["_lang"], min(1.0, docs_per_language / row["n"]))])[F.col("_lang")]
    hashed = F.col("_hash")
    # and of each language the row with the least hash, so that none is without any
    ahead = F.create_map(*[F.lit(x) for row in sizes for x in (row["_lang"], row["first"]["_hash"])])[F.col("_lang")]
    place = F.create_map(*[F.lit(x) for row in sizes for x in (row["_lang"], row["first"]["_row"])])[F.col("_lang")]
    chosen = rows.where((F.pmod(hashed, F.lit(1_000_000)) < share * 1_000_000) | ((hashed == ahead) & (F.col("_row") == place)))

    def window(batches):
        for batch in batches:
            langs, texts = [], []
            for language, body, place in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(body)
                if words:
                    at = place % max(1, len(words) - words_per_doc + 1)
                    langs.append(language)
                    texts.append(" ".join(words[at : at + words_per_doc]))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(texts, pa.string())], ["lang", "words"])

    sample = chosen.select("_lang", "_text", F.pmod(hashed, F.lit(1 << 40))).mapInArrow(window, "lang string, words string").collect()
    return fit([(row.lang, row.words.split(" ")) for row in sample])


def identify_language(
    df: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_words: bool = False
) -> DataFrame:
    """``keep`` with ``lang_pred``, ``score`` and ``n_switches`` (neighbouring words of different languages).

    ``with_words`` adds the lower-cased words and the language of each.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    fields = {"lang_pred": "string", "score": "double", "n_switches": "long"}
    if with_words:
        fields |= {"words": "array<string>", "word_langs": "array<string>"}

    def label(texts: list[str]) -> dict[str, list]:
        model = shared.value
        split = [words_of(t) if model.languages else [] for t in texts]
        full = [i for i, words in enumerate(split) if words]
        parts, words = [[]], 0
        for i in full:
            if parts[-1] and (words + len(split[i])) * len(model.languages) > LABEL_CELLS:
                parts.append([])
                words = 0
            parts[-1].append(i)
            words += len(split[i])
        out = {"lang_pred": [UNDETERMINED] * len(texts), "score": [0.0] * len(texts), "n_switches": [0] * len(texts)}
        if with_words:
            out |= {"words": split, "word_langs": [[] for _ in texts]}
        for some in parts if full else []:
            posterior = model.posteriors([split[i] for i in some])
            sizes = np.array([len(split[i]) for i in some])
            ends = np.cumsum(sizes)
            means = np.add.reduceat(posterior, ends - sizes, axis=0) / sizes[:, None]
            best = posterior.argmax(1)
            switched = np.concatenate([[0], np.cumsum(best[1:] != best[:-1])])
            for at, i in enumerate(some):
                start, end = ends[at] - sizes[at], ends[at]
                top = int(means[at].argmax())
                out["lang_pred"][i] = model.languages[top]
                out["score"][i] = min(1.0, float(means[at, top]))
                out["n_switches"][i] = int(switched[end - 1] - switched[start])
                if with_words:
                    out["word_langs"][i] = [model.languages[c] for c in best[start:end]]
        return out

    return add_columns(df, text, fields, label, keep)
