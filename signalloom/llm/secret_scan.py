"""Secret scans: fixed rules, and character Markov models of random strings and identifiers.

Both models are first-order chains over characters. The random model is trained on
values that the fixed rules found in the corpus, and on seeded random strings over
the usual key alphabets; the ordinary model on all other identifier-like strings of
a sample of documents, and on the compound names that their words would make. A string that no rule matched is a secret if it holds letters
and digits and its log-likelihood ratio, in all and for each character, is high. Of a
string that a rule matched in part, each rest of the least length is judged by itself.

Null and empty texts have no spans. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from signalloom.llm.arrow import add_columns, small_batches

# The base rules and the least length of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "markov")
MASK = "[SECRET]"

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CODE = np.full(256, len(ALPHABET), dtype=np.int16)
CODE[np.frombuffer(ALPHABET.encode(), dtype=np.uint8)] = np.arange(len(ALPHABET))
STATES = len(ALPHABET) + 1  # the last one stands for the ends of a string

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])")
IDENTIFIER = re.compile(r"[A-Za-z0-9+/_=-]{6,}")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def outside(text: str, pattern: re.Pattern, spans: list[Span]) -> list[re.Match]:
    """Matches that share no character with a span."""
    out, merged = [], merge(spans)
    at = 0
    for m in pattern.finditer(text):
        while at < len(merged) and merged[at][1] <= m.start():
            at += 1
        if at == len(merged) or merged[at][0] >= m.end():
            out.append(m)
    return out


def remains(text: str, pattern: re.Pattern, spans: list[Span]) -> list[tuple[int, int]]:
    """What the spans leave of the matches, where a piece of it still matches by itself."""
    out, merged = [], merge(spans)
    at = 0
    for m in pattern.finditer(text):
        while at < len(merged) and merged[at][1] <= m.start():
            at += 1
        start, next_ = m.start(), at
        while next_ < len(merged) and merged[next_][0] < m.end():
            out.append((start, merged[next_][0]))
            start, next_ = merged[next_][1], next_ + 1
        out.append((start, m.end()))
    return [(a, b) for a, b in out if a < b and pattern.fullmatch(text, a, b)]


def merge(spans: list[Span]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end, _ in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def transitions(strings: list[str]) -> np.ndarray:
    """Counts of neighbouring states over all strings, with their ends."""
    data = "\n".join(["", *strings, ""]).encode("ascii", "replace")
    codes = CODE[np.frombuffer(data, dtype=np.uint8)].astype(np.int64)
    counts = np.bincount(codes[:-1] * STATES + codes[1:], minlength=STATES * STATES).reshape(STATES, STATES)
    return counts


def compounds(words: list[str]) -> list[str]:
    """Names as people build them: camel case, snake case, dates and versions."""
    out = []
    for i in range(0, len(words) - 2, 3):
        a, b, c = (w.lower() for w in words[i : i + 3])
        number = len(a) * 7 % 31 + 1
        out += [f"{a}{b.capitalize()}{c.capitalize()}{number % 10}", f"{a}_{b}_{c}_{2000 + number}", f"20{number:02d}-{number % 12 + 1:02d}-{number:02d}-{a}-{b}"]
    return out


@dataclass(frozen=True)
class SecretModel:
    """Log-likelihood ratio of each transition, and the least ratio of a secret."""

    ratio: np.ndarray
    least_total: float = 16.0
    least_mean: float = 1.0

    def score(self, string: str) -> float:
        codes = CODE[np.frombuffer(string.encode("ascii", "replace"), dtype=np.uint8)]
        return float(self.ratio[codes[:-1], codes[1:]].sum())

    def is_secret(self, string: str) -> bool:
        if not MIXED.match(string):  # numbers and plain words are no keys
            return False
        score = self.score(string)
        return score >= self.least_total and score >= self.least_mean * (len(string) - 1)

    def spans(self, text: str) -> list[Span]:
        base = base_spans(text)
        more = [(start, end, "markov") for start, end in remains(text, CANDIDATE, base) if self.is_secret(text[start:end])]
        return ordered(base + more) if more else base


def log_chain(counts: np.ndarray) -> np.ndarray:
    """Transition log-probabilities, smoothed towards the overall character shares."""
    share = (counts.sum(0) + 0.5) / (counts.sum() + 0.5 * STATES)
    return np.log((counts + 20 * share) / (counts.sum(1, keepdims=True) + 20))


def seeded_strings(n: int, seed: int = 7) -> list[str]:
    """Random strings over the alphabets that keys are written in."""
    rng = np.random.default_rng(seed)
    alphabets = [ALPHABET[52:62] + "abcdef", ALPHABET[26:62], ALPHABET[:62], ALPHABET[:64]]
    return ["".join(rng.choice(list(alphabets[i % 4]), size=int(rng.integers(16, 48)))) for i in range(n)]


def sample_of(df: DataFrame, keys: Sequence[str], rows: int, bound: int) -> DataFrame:
    """About ``bound`` of ``rows`` rows by a hash of ``keys``; all if there are fewer."""
    if rows <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(*keys, F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * bound / rows))


def train_secret_model(df: DataFrame, text: str = "text", doc_id: str = "doc_id", sample_docs: int = 40_000, seeded: int = 2_000) -> SecretModel:
    """Both chains from about ``sample_docs`` documents, counted on the executors.

    Documents are chosen by a hash of id and text, so that copies of a text do not all come in.
    """
    small_batches(df.sparkSession)
    key = F.col(f"`{doc_id}`").cast("string") if doc_id in df.columns else F.lit(None).cast("string")
    texts = df.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text_"), key.alias("_id_"))
    chosen = sample_of(texts, ["_id_", "_text_"], texts.count(), sample_docs).select("_text_")

    def count(batches):
        random = np.zeros((STATES, STATES), dtype=np.int64)
        plain = np.zeros((STATES, STATES), dtype=np.int64)
        for batch in batches:
            for t in batch.column(0):
                t = t.as_py()
                spans = base_spans(t)
                found = [ASSIGN.match(t[s:e]).group(2) if kind == "assign" else t[s:e] for s, e, kind in spans]
                random += transitions(found) if found else 0
                names = [m.group() for m in outside(t, IDENTIFIER, spans)]
                plain += transitions(names) + transitions(compounds([n for n in names if n.isalpha()]))
        for kind, counts in ((0, random), (1, plain)):
            a, b = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(a), kind, np.int32)), pa.array((a * STATES + b).astype(np.int32)), pa.array(counts[a, b])], ["kind", "pair", "n"]
            )

    rows = chosen.mapInArrow(count, "kind int, pair int, n long").groupBy("kind", "pair").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((2, STATES * STATES))
    for row in rows:  # at most 2 x STATES x STATES
        counts[row.kind, row.pair] = row.n
    random, plain = counts.reshape(2, STATES, STATES)
    drawn = transitions(seeded_strings(seeded))
    if random.sum():  # neither source outweighs the other
        random = random * (drawn.sum() / random.sum())
    return SecretModel(log_chain(random + drawn) - log_chain(plain))


def scan_secrets(df: DataFrame, model: SecretModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with counts by rule, a digest of the rules' spans, all spans, and the masked text.

    ``spans`` is ``kind:start:end`` by start, comma-joined; ``masked`` is the text
    with every span replaced.
    """
    fields = {"n_assign": "long", "n_access": "long", "n_hex": "long", "n_markov": "long",
              "base_sha256": "string", "spans": "string", "masked": "string"}
    shared = df.sparkSession.sparkContext.broadcast(model)

    def scan(texts: list[str]) -> dict[str, list]:
        out: dict[str, list] = {name: [] for name in fields}
        for t in texts:
            spans = shared.value.spans(t)
            kinds = [s[2] for s in spans]
            for kind in KINDS:
                out[f"n_{kind}"].append(kinds.count(kind))
            base = written([s for s in spans if s[2] != "markov"])
            out["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
            out["spans"].append(written(spans))
            out["masked"].append(masked(t, spans))
        return out

    return add_columns(df, text, fields, scan, keep)


def masked(text: str, spans: list[Span]) -> str:
    if not spans:
        return text
    out, at = [], 0
    for start, end in merge(spans):
        out += [text[at:start], MASK]
        at = end
    return "".join([*out, text[at:]])
