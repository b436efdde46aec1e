"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string exactly one token can be the last token of the
prefix's encoding. A table that holds it for each prefix gives the whole encoding
by walking backwards; appending bytes only adds entries, and an edit only
recomputes entries behind it. A candidate last token is the right one if it can
stand behind the last token of the shorter prefix, which is decided by undoing
merges on both sides of the seam.

A text is split by the pattern first; each match is encoded separately.
:class:`EncodedText` keeps the matches, so that an edit re-encodes the matches
around it and stops at the first old boundary.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from signalloom.llm.arrow import add_columns, pieces

#: Matches kept per worker with their ids (as many again of the time before), the longest match that is kept, and the characters split at a time.
CACHE_MATCHES = 300_000
CACHE_CHARS = 64
PIECE_CHARS = 1 << 18


class Vocabulary:
    """Tokens by rank, and the pair each token was merged from (found when needed)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values(), default=-1) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        #: rank of a token, -1 for bytes that only begin one
        self.steps: dict[bytes, int] = {token[:n]: -1 for token in ranks for n in range(1, len(token))} | ranks
        self.longest = max(map(len, ranks), default=1)
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._follows: dict[int, bool] = {}

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens of the last merge, or None for a token that no merge makes."""
        if token not in self._parts:
            made = list(self.tokens[token][i : i + 1] for i in range(len(self.tokens[token])))
            while len(made) > 2:
                ranked = [(self.ranks.get(a + b, self.size), i) for i, (a, b) in enumerate(zip(made, made[1:]))]
                rank, i = min(ranked)
                if rank >= token:
                    break
                made[i : i + 2] = [made[i] + made[i + 1]]
            merged = len(made) == 2 and all(p in self.ranks for p in made)
            self._parts[token] = (self.ranks[made[0]], self.ranks[made[1]]) if merged else None
        return self._parts[token]

    def follows(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes is just these two tokens."""
        key = left * self.size + right
        known = self._follows.get(key)
        if known is None:
            if len(self._follows) > 500_000:
                self._follows.clear()
            known = self._follows[key] = self._seam_holds(left, right)
        return known

    def _seam_holds(self, left: int, right: int) -> bool:
        """Undo the later merge of the two sides, again and again.

        ``bound`` is the rank below which a merge across the seam would have come
        first; at equal rank the leftmost merge wins, hence the +1 on the right.
        """
        bound = self.size + 1
        while True:
            across = self.ranks.get(self.tokens[left] + self.tokens[right])
            if across is not None and across < bound:
                return False
            by_left, by_right = self.parts(left), self.parts(right)
            if by_left is None and by_right is None:
                return True
            if by_right is None or (by_left is not None and left > right):
                bound, left = left, by_left[1]
            else:
                bound, right = right + 1, by_right[0]


class PrefixTable:
    """A byte string with the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data = vocabulary, b""
        self.last: list[int] = []
        if data:
            self.append(data)

    def append(self, more: bytes) -> None:
        """Add bytes; entries of earlier prefixes stay as they are."""
        if not more:
            return
        old, self.data = len(self.data), self.data + more
        data, last, n = self.data, self.last, len(self.data)
        known, steps, size = self.vocabulary._follows, self.vocabulary.steps, self.vocabulary.size
        # the last token of each new prefix; it may begin before the seam
        begin = max(0, old - self.vocabulary.longest)
        found: list[int | None] = [None] * (n - begin + 1)
        for start in range(begin, n):
            if start > old:
                last.append(self._held(found[start - begin]))
            before = last[start - 1] if start else -1
            stop = start + 1
            token = steps.get(data[start:stop])
            while token is not None:
                if token >= 0 and stop > old:
                    fits = not start or known.get(before * size + token)
                    if fits is None:
                        fits = self.vocabulary.follows(before, token)
                    if fits:
                        found[stop - begin] = token
                stop += 1
                if stop > n:
                    break
                token = steps.get(data[start:stop])
        last.append(self._held(found[n - begin]))

    @staticmethod
    def _held(token: int | None) -> int:
        if token is None:
            raise ValueError("the vocabulary lacks a byte")
        return token

    def replace(self, start: int, stop: int, new: bytes) -> None:
        """Exchange a range of bytes; prefixes that end before it keep their entries."""
        rest = new + self.data[stop:]
        self.data = self.data[:start]
        del self.last[start:]
        if rest:
            self.append(rest)

    def ids(self) -> list[int]:
        out, stop = [], len(self.data)
        while stop:
            token = self.last[stop - 1]
            out.append(token)
            stop -= len(self.vocabulary.tokens[token])
        return out[::-1]


class Encoder(dict):
    """Ids of each match as little-endian 32-bit integers; matches met lately are kept."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.vocabulary, self.split = Vocabulary(ranks), regex.compile(pattern)
        self.earlier: dict[str, bytes] = {}

    def __missing__(self, match: str) -> bytes:
        packed = self.earlier.get(match)
        if packed is None:
            data = match.encode()
            whole = self.vocabulary.ranks.get(data)
            ids = [whole] if whole is not None else PrefixTable(self.vocabulary, data).ids()
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(match) <= CACHE_CHARS:
            if len(self) >= CACHE_MATCHES:
                self.earlier = dict(self)
                self.clear()
            self[match] = packed
        return packed

    def encode(self, text: str) -> bytes:
        return b"".join([self[m] for part in pieces(text, PIECE_CHARS) for m in self.split.findall(part)])

    def decode(self, packed: bytes) -> bytes:
        tokens = self.vocabulary.tokens
        return b"".join([tokens[i] for i in np.frombuffer(packed, dtype="<u4").tolist()])


class EncodedText:
    """A text with the ids of each match, kept up to date under edits."""

    def __init__(self, encoder: Encoder, text: str):
        self.encoder, self.text = encoder, text
        self.starts: list[int] = []
        self.packed: list[bytes] = []
        for found in encoder.split.finditer(text):
            self.starts.append(found.start())
            self.packed.append(encoder[found.group()])

    def replace(self, start: int, stop: int, new: str) -> int:
        """Exchange characters; gives the number of matches that were encoded anew.

        Matching starts one match before the edit, since a run of blanks looks at
        the character behind it, and ends where a new boundary meets an old one.
        """
        first = max(0, int(np.searchsorted(self.starts, start, side="left")) - 2)
        shift = len(new) - (stop - start)
        self.text = self.text[:start] + new + self.text[stop:]
        old = {s + shift: i for i, s in enumerate(self.starts) if s >= stop}
        begin = self.starts[first] if self.starts else 0
        starts, packed, resume = [], [], len(self.starts)
        for found in self.encoder.split.finditer(self.text, begin):
            if found.start() > start + len(new) and found.start() in old:
                resume = old[found.start()]
                break
            starts.append(found.start())
            packed.append(self.encoder[found.group()])
        self.starts = self.starts[:first] + starts + [s + shift for s in self.starts[resume:]]
        self.packed = self.packed[:first] + packed + self.packed[resume:]
        return len(starts)

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def ids(self) -> bytes:
        return b"".join(self.packed)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def encoder(path: str | None = None, pattern: str | None = None) -> Encoder:
    if path is None or pattern is None:
        import public_tokenizers

        path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    return Encoder(read_ranks(path), pattern)


def encode_documents(
    df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, with_ids: bool = True
) -> DataFrame:
    """``keep`` with each text's token ids and the proof of the way back.

    ``n_tokens``; ``ids`` (array of int) unless ``with_ids`` is off;
    ``ids_sha256`` over the ids as little-endian unsigned 32-bit integers;
    ``decoded_sha256`` over the bytes that the ids decode to. Null and empty texts
    have no ids. Nulls and repeats in other columns do not matter.
    """
    fields = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    if with_ids:
        fields["ids"] = "array<int>"

    def encode(texts: list[str]) -> dict[str, list]:
        codec = encoder(path)
        packed = [codec.encode(t) for t in texts]
        out = {
            "n_tokens": [len(p) // 4 for p in packed],
            "ids_sha256": [hashlib.sha256(p).hexdigest() for p in packed],
            "decoded_sha256": [hashlib.sha256(codec.decode(p)).hexdigest() for p in packed],
        }
        if with_ids:
            out["ids"] = [np.frombuffer(p, dtype="<u4").astype("int32") for p in packed]
        return out

    return add_columns(df, text, fields, encode, keep)
