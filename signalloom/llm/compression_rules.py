"""Quality rules: word and line repetition, and compression bands.

The bands compare raw to zstandard-compressed size, for the whole text and for
fixed chunks of it. Repeated text compresses too well, random text too badly, and
what is usual depends on the length, so every length has its own limits. A text is
kept if the base rules pass, its whole ratio is inside the band of its length, and
the chunks outside their band hold no more than a small share of its bytes, and of a
long text no more than a fixed number. Every byte lies in a chunk that is judged: a
short last chunk by the band of its own length, and one too short to tell together
with the bytes before it.

Null and empty texts have no words and fail the base rules.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from signalloom.llm.arrow import add_columns

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Bytes from which on a band holds, lowest and highest ratio (raw / compressed).
#: Prose at zstandard level 3 gives about 1.4 at 250 bytes and 2.6 at 64 KB; twice a
#: copy of everything or a random alphabet leaves these bands. 4-letter words of random
#: letters and digits give up to 1.19 at 254 bytes, 1.23 at 374, 1.28 at 499, 1.36 at 999 and
#: 1.41 at 1,999; pieces of clean documents of these lengths at least 1.23, 1.27, 1.33, 1.66, 1.71.
BANDS = ((0, 0.95, 2.4), (128, 1.06, 2.4), (192, 1.15, 2.4), (224, 1.2, 2.4), (256, 1.24, 2.6), (384, 1.29, 2.6),
         (512, 1.37, 2.6), (1024, 1.42, 3.0), (4096, 1.42, 3.5), (16384, 1.5, 4.0), (65536, 1.55, 5.0))
CHUNK_BYTES = 4096
CHUNK_BAND = (1.45, 3.5)
#: Share of the bytes that may lie in chunks outside their band, and most such bytes.
CHUNK_SHARE = 0.05
CHUNK_MOST = 8192
#: Bytes of a piece whose ratio tells something.
LEAST_PIECE = 256
LEVEL = 3


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more, first occurrences included."""
    n = len(words)
    if n < 4 or len(set(zip(words, words[1:], words[2:]))) == n - 2:
        return 0
    ids: dict[bytes, int] = {}
    code = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    pair = np.unique(code[:-1] * len(ids) + code[1:], return_inverse=True)[1]
    _, place, count = np.unique(pair[:-1] * len(ids) + code[2:], return_inverse=True, return_counts=True)
    repeated = count[place] > 1
    covered = np.zeros(n, dtype=bool)
    for offset in range(3):
        covered[offset : offset + n - 2] |= repeated
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return len(lines) - len(set(lines))


def band(size: int, bands=BANDS) -> tuple[float, float]:
    return next((low, high) for start, low, high in reversed(bands) if size >= start)


def ratios(data: bytes, compressor, chunk_bytes: int = CHUNK_BYTES) -> tuple[float, list[tuple[int, int, float]]]:
    """Ratio of the whole text; bytes, bytes judged and ratio of each chunk.

    A last chunk below ``LEAST_PIECE`` bytes is judged together with the bytes before it.
    """
    whole = len(data) / len(compressor.compress(data)) if data else 0.0
    parts = []
    for at in range(0, len(data), chunk_bytes):
        own = min(chunk_bytes, len(data) - at)
        piece = data[max(0, min(at, at + own - LEAST_PIECE)) : at + own]
        parts.append((own, len(piece), len(piece) / len(compressor.compress(piece))))
    return whole, parts


def quality_rules(
    df: DataFrame,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    bands=BANDS,
    chunk_bytes: int = CHUNK_BYTES,
    chunk_band: tuple[float, float] = CHUNK_BAND,
    chunk_share: float = CHUNK_SHARE,
    chunk_most: int = CHUNK_MOST,
) -> DataFrame:
    """``keep`` with the counts, ``base_failed``, the ratios behind the verdict, and ``kept``.

    ``ratio`` is 0 for an empty text; ``chunks_low`` and ``chunks_high`` count the
    chunks below and above their band: ``chunk_band`` from half a chunk on, else ``bands``.
    """
    fields = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
              "base_failed": "boolean", "ratio": "double", "chunks": "long", "chunks_low": "long", "chunks_high": "long",
              "kept": "boolean"}

    def judge(texts: list[str]) -> dict[str, list]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        rows = []
        for t in texts:
            data = t.encode()
            words = data.split()
            n, again = len(words), repeated_words(words)
            failed = n < 50 or 100 * again > 50 * n
            whole, parts = ratios(data, compressor, chunk_bytes)
            below = above = outside = 0
            for own, judged, ratio in parts:
                low, high = chunk_band if judged >= chunk_bytes // 2 else band(judged, bands)
                below, above = below + (ratio < low), above + (ratio > high)
                outside += 0 if low <= ratio <= high else own
            low, high = band(len(data), bands)
            fits = low <= whole <= high and outside <= min(chunk_share * len(data), chunk_most)
            rows.append((n, len(t) - sum(map(t.count, BLANKS)), sum(map(t.count, SYMBOLS)), duplicate_lines(t), again,
                         failed, whole, len(parts), below, above, not failed and fits))
        return dict(zip(fields, map(list, zip(*rows))))

    return add_columns(df, text, fields, judge, keep)
