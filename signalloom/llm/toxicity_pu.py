"""Toxicity by non-negative positive-unlabelled learning.

Only documents confirmed as toxic count as labels; all other text is unlabelled and
holds a share of toxic documents itself, the class prior. The classifier minimises the
class-prior-corrected risk, in which the negatives' part is estimated from unlabelled
text minus the positives' part; where that estimate falls below zero the step goes back
on it, as it then fits the sample and not the classes.

Features are words and word beginnings of a document, each present or not. Their
document frequencies among the positives and in all training text are counted over
every row, and those that differ most are kept. The weights are fitted on a bounded
sample.

Null and empty texts have no features and get the score of the bias alone. Without
positives (or without training text) nothing can be learned: every score is 0.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from signalloom.llm.arrow import add_columns, column, small_batches

LETTERS = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 20
#: Beginnings that are features beside the word.
BEGINNINGS = (4, 5)
#: Features that are kept, the least standard score, and the least number of positives that hold one.
KEPT = 4096
LEAST_Z = 4.0
LEAST_POSITIVES = 5
#: Documents that the weights are fitted on, at most about.
POSITIVES = 10_000
UNLABELLED = 30_000
#: Class prior where the labels hold positives only.
PRIOR = 0.1
STEPS = 600
THRESHOLD = 0.7
KEPT_WORDS = 300_000


def buckets_of(word: str) -> tuple[int, ...]:
    """Hashed features of a lower-case word."""
    names = {word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) >= n)}
    return tuple(sorted(zlib.crc32(n.encode()) % BUCKETS for n in names))


class Features(dict):
    """Kept features of each word; what a worker has seen is remembered."""

    def __init__(self, kept: dict[int, int] | None = None):
        super().__init__()
        self.kept = kept

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > KEPT_WORDS:
            self.clear()
        found = buckets_of(word)
        if self.kept is not None:
            found = tuple(self.kept[b] for b in found if b in self.kept)
        self[word] = found
        return found

    def of(self, text: str) -> set[int]:
        return {f for word in set(LETTERS.findall(text.lower())) for f in self[word]}


@dataclass
class ToxicityModel:
    kept: dict[int, int]
    weights: np.ndarray
    bias: float
    _features: Features | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_features": None}

    def score(self, text: str) -> float:
        if self._features is None:
            self._features = Features(self.kept)
        value = self.bias + sum(self.weights[f] for f in sorted(self._features.of(text)))
        return float(1 / (1 + np.exp(-np.clip(value, -500, 500))))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_nnpu(positives: list[list[int]], unlabelled: list[list[int]], size: int, prior: float,
             steps: int = STEPS, rate: float = 0.1, penalty: float = 3e-5) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk with logistic loss.

    risk = prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))
    """
    docs = [*positives, *unlabelled]
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    flat = np.array([f for d in docs for f in d], dtype=np.int64)
    n_pos, n_unl = len(positives), len(unlabelled)
    is_pos = np.arange(len(docs)) < n_pos
    value = np.zeros(size + 1)
    value[size] = np.log(prior / (1 - prior))
    mean, square = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        margin = np.bincount(owner, value[flat], len(docs)) + value[size]
        share = logistic(margin)
        # losses: positive log(1 + exp(-g)) with slope share - 1, negative log(1 + exp(g)) with slope share
        as_negative = np.logaddexp(0, margin)
        rest = as_negative[~is_pos].sum() / n_unl - prior * as_negative[is_pos].sum() / n_pos
        negative_slope = np.where(is_pos, -prior * share / n_pos, share / n_unl)
        positive_slope = np.where(is_pos, prior * (share - 1) / n_pos, 0.0)
        slope_of = positive_slope + negative_slope if rest >= 0 else -negative_slope
        slope = np.append(np.bincount(flat, slope_of[owner], size), slope_of.sum())
        slope[:size] += penalty * value[:size]
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope**2
        value -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return value[:size], float(value[size])


def document_frequencies(rows: DataFrame) -> DataFrame:
    """``(bucket, toxic, n)``: documents of ``(_text, _toxic)`` that hold each feature."""

    def run(batches):
        features = Features()
        counts = {True: np.zeros(BUCKETS, np.int32), False: np.zeros(BUCKETS, np.int32)}
        for batch in batches:
            for body, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                found = features.of(body.as_py())
                counts[bool(toxic)][np.fromiter(found, np.int64, len(found))] += 1
        for toxic, n in counts.items():
            place = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays(
                [column(place, "int"), column(np.full(len(place), toxic), "boolean"), column(n[place], "long")], ["bucket", "toxic", "n"]
            )

    return rows.select("_text", "_toxic").mapInArrow(run, "bucket int, toxic boolean, n long").groupBy("bucket", "toxic").agg(F.sum("n").alias("n"))


def telling_features(frequencies: DataFrame, positives: int, documents: int, most: int = KEPT) -> list[int]:
    """Buckets whose share among the positives differs most from that in all documents."""
    held = frequencies.groupBy("bucket").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("pos"))
    share, among = F.col("all") / F.lit(float(documents)), F.col("pos") / F.lit(float(positives))
    z = F.abs(among - share) / F.sqrt(share * (1 - share) / positives + 1e-12)
    kept = held.withColumn("z", z).where((F.col("z") >= LEAST_Z) & ((F.col("pos") >= LEAST_POSITIVES) | (among < share)))
    return sorted(row.bucket for row in kept.orderBy(F.col("z").desc(), "bucket").limit(most).select("bucket").collect())


def train_toxicity_model(
    df: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic",
    prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED,
) -> ToxicityModel | None:
    """Fit on the rows where ``learn`` holds; ``labels`` says which of them are toxic.

    ``learn`` may use the id alone and holds for both tables. An id that is labelled
    twice is toxic if one label says so. Of the toxic ids, at most about ``positives``
    are used, chosen by a hash, so that they can be sent to the texts and no text is
    shuffled. The class prior is the toxic share of the labelled ids unless given.
    """
    small_batches(df.sparkSession)
    marks = labels.where(learn & F.col(f"`{toxic}`").isNotNull() & F.col(f"`{doc_id}`").isNotNull())
    marks = marks.groupBy(F.col(f"`{doc_id}`").alias("_key")).agg(F.max(F.col(f"`{toxic}`").cast("int")).alias("_label"))
    n_labelled, n_toxic = marks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("_label").cast("long")), F.lit(0))).first()
    if not n_toxic:
        return None
    place = F.pmod(F.xxhash64("_key", F.lit(31)), F.lit(1_000_000)) / 1e6
    chosen = marks.where((F.col("_label") == 1) & (place < min(1.0, positives / n_toxic)))
    confirmed = F.broadcast(chosen.select("_key", F.lit(True).alias("_toxic")))  # bounded by ``positives``

    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text")
    rows = df.where(learn).select(F.col(f"`{doc_id}`").alias("_key"), body).join(confirmed, "_key", "left")
    rows = rows.withColumn("_toxic", F.coalesce("_toxic", F.lit(False)))
    n, n_confirmed = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("_toxic").cast("long")), F.lit(0))).first()
    if not n_confirmed or n == n_confirmed:
        return None
    if prior is None:
        prior = n_toxic / n_labelled if n_labelled > n_toxic else PRIOR
    prior = min(max(prior, 1e-4), 0.9)
    kept = {bucket: i for i, bucket in enumerate(telling_features(document_frequencies(rows), n_confirmed, n))}
    if not kept:
        return None

    # unlabelled text is all training text, with the toxic documents that it holds
    also = (F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(37)), F.lit(1_000_000)) / 1e6 < min(1.0, unlabelled / n)).cast("int")
    # an id that many rows bear does not bring more positives than asked for
    told = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(41)), F.lit(1_000_000)) / 1e6 < min(1.0, positives / n_confirmed)
    role = (F.col("_toxic") & told).cast("int")
    sample = rows.select("_text", role.alias("_role"), also.alias("_also")).where("_role + _also > 0")

    def run(batches):
        features = Features(kept)
        for batch in batches:
            found = [sorted(features.of(body.as_py())) for body in batch.column(0)]
            yield pa.RecordBatch.from_arrays([column(found, "array<int>"), batch.column(1), batch.column(2)], ["found", "role", "also"])

    drawn = sample.mapInArrow(run, "found array<int>, role int, also int").toArrow().to_pylist()
    drawn.sort(key=lambda r: r["found"])
    weights, bias = fit_nnpu([r["found"] for r in drawn if r["role"]], [r["found"] for r in drawn if r["also"]], len(kept), prior)
    return ToxicityModel(kept, weights, bias)


def score_toxicity(
    df: DataFrame, model: ToxicityModel | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD
) -> DataFrame:
    """``keep`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str]) -> dict[str, list]:
        found = shared.value
        return {"score": [found.score(t) if found else 0.0 for t in texts]}

    out = add_columns(df, text, {"score": "double"}, run, tuple(c for c in keep if c != "predicted"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
