"""Spelling variants: words one edit apart, each led to the more frequent one by permuterm rotations.

A word is closed by a terminator and turned into all its rotations. The rotation that ends
in a character shares all but that end with every word that has another character there, or one
character more; without its end it is a rotation of the word that lacks the character. So the
rotations, sorted by the prefix that skips their last character, put the neighbours by one replacement,
insertion or deletion side by side, and a scan over the rows of one prefix gives each member its number of neighbours and
the most frequent of them. Pairs are never written: a prefix and an end make one word,
so a prefix has at most one row for each character of the alphabet, and one without an end.

A replacement is found at its place and nowhere else. A deletion inside a run of equal
characters gives one word for each of them; only the first counts.

Counting sums runs within each slice of texts and shuffles one row per task and word. Words are
numbered in code-point order, and only numbers travel with the rotations; rotations of more than
:data:`LONG` code points travel as two 64-bit hashes. Roots are found by pointer doubling:
counts at least double from word to form, so chains are short.

Null and empty texts hold no word; a null id deletes nothing. Repeated rows count each time. Ties
go to the smaller word in code-point order. Texts are read whole; an empty table gives no rows, and further columns
are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from signalloom.llm.arrow import slices, small_batches
from signalloom.llm.numbering import numbered
from signalloom.session import settle

RUN = re.compile("[a-zÀ-ÿ]+")
END = "$"
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: A form has at least this many times the occurrences of the word.
LEAD = 2
#: Of so many (document, word) pairs one has a slip of the key.
SLIP = 97
#: Code points up to which a rotation travels as text.
LONG = 64
#: Words a worker counts before it hands its counts on.
KEPT_WORDS = 400_000


def slip(doc_id: str, run: str, one_in: int = SLIP) -> str:
    """The run, without one code point where the checksum of id and run says so."""
    mark = zlib.crc32(f"{doc_id}:{run}".encode())
    if mark % one_in:
        return run
    at = mark % len(run)
    return run[:at] + run[at + 1 :]


def count_words(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
    change: Callable[[str, str], str] | None = slip,
) -> DataFrame:
    """``(word, n)`` of all words with ``least_length`` code points and ``least_count`` occurrences."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(f"`{doc_id}`").cast("string").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))

    def run(batches):
        counts: Counter[str] = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for part in slices(batch, "_text"):
                for key, body in zip(part.column(0).to_pylist(), part.column(1)):
                    # lower() of bytes changes A-Z only
                    found = Counter(RUN.findall(body.as_py().encode().lower().decode())) if body.is_valid else {}
                    for word, n in found.items():
                        if len(word) >= least_length:
                            if change and key is not None:
                                word = change(key, word)
                                if len(word) < least_length:
                                    continue
                            counts[word] += n
                if len(counts) > KEPT_WORDS:
                    yield flush()
        if counts:
            yield flush()

    counted = rows.where("_text is not null").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def rotations(words: DataFrame, long: int = LONG) -> DataFrame:
    """``(prefix, role, number, n)``: role 0 for a whole rotation, 1 or 2 for one that skips its last character.

    Role 2 marks a character that repeats the one before it.
    """
    word, place = F.col("word"), F.col("_place")
    turned = words.withColumn("_place", F.explode(F.sequence(F.lit(0), F.length("word"))))
    marked = F.concat(word, F.lit(END))
    head = F.substr(marked, F.lit(1), F.greatest(place - 1, F.lit(0)))
    skipped = F.concat(F.substr(marked, place + 1), head)
    own = F.substr(word, place, F.lit(1))
    repeats = (place > 1) & (own == F.substr(word, place - 1, F.lit(1)))
    whole = F.struct(F.when(place > 0, F.concat(skipped, own)).otherwise(marked).alias("prefix"), F.lit(0).alias("role"))
    short = F.struct(skipped.alias("prefix"), F.when(repeats, 2).otherwise(1).alias("role"))
    rows = turned.select("number", "n", F.inline(F.when(place > 0, F.array(whole, short)).otherwise(F.array(whole))))
    prefix = F.col("prefix")
    hashed = F.concat_ws(" ", F.xxhash64(F.lit(1), prefix), F.xxhash64(F.lit(2), prefix))
    return rows.withColumn("prefix", F.when(F.length(prefix) > long, hashed).otherwise(prefix))


def _best(*found: Column) -> Column:
    """The most frequent of some ``(-n, number)``, the smaller word on ties."""
    return F.array_min(F.array_compact(F.array(*found)))


def neighbours(turned: DataFrame) -> DataFrame:
    """``(number, near, best)`` of each word: its neighbours, and ``(-n, number)`` of the foremost."""
    member = F.struct((-F.col("n")).alias("n"), "number", "role")
    groups = turned.repartition("prefix").groupBy("prefix").agg(F.collect_list(member).alias("_all")).where(F.size("_all") > 1)
    groups = groups.select(
        "_all",
        F.sort_array(F.filter("_all", lambda m: m["role"] > 0)).alias("_ends"),
        F.filter("_all", lambda m: m["role"] == 0).alias("_whole"),
    ).select("_all", "_ends", "_whole", F.filter("_ends", lambda m: m["role"] == 1).alias("_firsts"))
    # numbers alone are compared from here on
    at = lambda members, i: F.when(F.size(members) > i, F.struct(F.get(members, F.lit(i))["n"].alias("n"), F.get(members, F.lit(i))["number"].alias("number")))
    groups = groups.select(
        F.explode("_all").alias("_m"), F.size("_ends").alias("_n_ends"), F.size("_firsts").alias("_n_firsts"), F.size("_whole").alias("_n_whole"),
        at("_ends", 0).alias("_top"), at("_ends", 1).alias("_second"), at("_firsts", 0).alias("_first"), at("_whole", 0).alias("_lacking"),
    )
    role = F.col("_m")["role"]
    others = F.when(F.col("_top")["number"] == F.col("_m")["number"], F.col("_second")).otherwise(F.col("_top"))
    near = F.when(role == 0, F.col("_n_firsts")).when(role == 1, F.col("_n_ends") - 1 + F.col("_n_whole")).otherwise(F.col("_n_ends") - 1)
    best = F.when(role == 0, F.col("_first")).when(role == 1, _best(others, F.col("_lacking"))).otherwise(others)
    found = groups.select(F.col("_m")["number"].alias("number"), near.cast("long").alias("near"), best.alias("best")).where("near > 0")
    return found.groupBy("number").agg(F.sum("near").alias("near"), F.min("best").alias("best"))


def follow(links: DataFrame) -> DataFrame:
    """``(number, root)`` of each ``(number, form)``: pointers jump to the pointer of their end until none moves."""
    at = settle(links.select("number", F.col("form").alias("root"), F.lit(True).alias("_moved")), "variant-links")
    while at.where("_moved").limit(1).count():
        ahead = at.select(F.col("number").alias("_end"), F.col("root").alias("_next"))
        moved = at.join(ahead, at["root"] == F.col("_end"), "left")
        at = settle(moved.select("number", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "variant-links")
    return at.select("number", "root")


def spelling_variants(counted: DataFrame, lead: int = LEAD) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of each row of ``(word, n)``.

    The form is the most frequent word one edit away, if it has at least ``lead`` times the
    occurrences; the root is where forms lead to, the word itself if it has none.
    """
    if lead < 2:
        raise ValueError("forms lead in circles unless they have twice the occurrences")
    counted = settle(counted.select(F.lit("").alias("_group"), "word", F.col("n").cast("long").alias("n")), "variant-counts")
    words = settle(numbered(counted, ["word"], counted.count()).select(F.col("_at").alias("number"), "word", "n"), "variant-words")
    found = neighbours(rotations(words))
    form_n = -F.col("best")["n"]
    leads = form_n >= lead * F.col("n")
    stats = settle(
        words.join(found, "number", "left").select(
            "number", "word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
            F.when(leads, F.col("best")["number"]).alias("_form"), F.when(leads, form_n).alias("form_n"),
        ),
        "variant-forms",
    )
    roots = follow(stats.where("_form is not null").select("number", F.col("_form").alias("form")))
    named = lambda number, word: words.select(F.col("number").alias(number), F.col("word").alias(word))
    return (
        stats.join(roots.withColumnRenamed("root", "_root"), "number", "left")
        .join(named("_form", "form"), "_form", "left")
        .join(named("_root", "root"), "_root", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    )
