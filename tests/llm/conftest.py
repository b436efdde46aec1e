import random

import pytest
from pyspark.sql import Row

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_tokens string, size string, word string"


def row(doc_id, text, lang="en", source="a"):
    return Row(doc_id, text, lang, source, None if text is None else len(text), 0.5, "clash", "clash", "clash")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns named like results."""
    rng = random.Random(3)
    words = ["the", "of", "thing", "and", "other", "Haus", "été", "<|endoftext|>", "x1", "token=abc123def"]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    unbroken = "".join(rng.choice("abcdeé") for _ in range(70_000))
    rows = [
        row(1, None), row(2, ""), row(3, " \n\t "), row(4, long), row(5, unbroken), row(6, "one two three four", None, None),
        row(7, "one two three four", "fr"), row(7, "one two three four", "fr"), row(None, "one two three four"), row(None, None, None, None),
        row(8, "le la les une des et", "fr", "b"), row(9, "123 456 ++ --", None, "b"), row(10, "A B C", "en", "c"),
        Row(11, "plain words here", "en", "c", None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
