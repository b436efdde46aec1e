"""Token counts: batches balanced by bytes, long texts split where no token can cross.

Only lengths leave the tokenizer. Texts beyond ``PIECE_CHARS`` are cut at blanks
between ASCII letters or digits; a run without such a place stays whole, so the
count is always that of the uncut text.

Null and empty texts have 0 bytes and 0 tokens. Null and repeated ids, and any
further columns, do not matter: one row comes out for each row that went in.
"""

from __future__ import annotations

import os
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F

from signalloom.llm.arrow import add_columns, pieces

#: Characters above which a text is cut, and bytes that one call of the library gets.
PIECE_CHARS = 1 << 16
BATCH_BYTES = 1 << 18


@lru_cache(maxsize=2)
def _tokenizer(path: str | None):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Tokenizer.from_file(path)


def balanced(sizes: list[int], limit: int) -> list[tuple[int, int]]:
    """Ranges of neighbours with about equal bytes, none much above ``limit``."""
    total = sum(sizes)
    share = total / max(1, -(-total // limit))
    out, start, held = [], 0, 0
    for i, size in enumerate(sizes):
        held += size
        if held >= share:
            out.append((start, i + 1))
            start, held = i + 1, 0
    if start < len(sizes):
        out.append((start, len(sizes)))
    return out


def count_texts(texts: list[str], path: str | None = None, piece_chars: int = PIECE_CHARS) -> list[int]:
    tokenizer = _tokenizer(path)
    owners, parts = [], []
    for row, text in enumerate(texts):
        for part in pieces(text, piece_chars):
            owners.append(row)
            parts.append(part)
    counts = [0] * len(texts)
    for start, stop in balanced([len(p) if p.isascii() else len(p.encode()) for p in parts], BATCH_BYTES):
        for row, done in zip(owners[start:stop], tokenizer.encode_batch_fast(parts[start:stop], add_special_tokens=False)):
            counts[row] += len(done)
    return counts


def token_counts(
    df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, limit: int = 1024
) -> DataFrame:
    """``keep`` with ``n_bytes``, ``n_tokens`` and whether the text is over ``limit`` tokens.

    ``path`` names a tokenizer file that every executor can open; by default the
    installed byte-level vocabulary.
    """

    def count(texts: list[str]) -> dict[str, list]:
        return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": count_texts(texts, path)}

    out = add_columns(df, text, {"n_bytes": "long", "n_tokens": "long"}, count, keep)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
