"""SimHash near-duplicates by the general pigeonhole principle.

The 64 bits are dealt to three partitions, correlated bits together. Two fingerprints
that differ in at most two bits must, for any thresholds that add up to
``MAX_BITS - partitions + 1``, be within its threshold in at least one partition
(-1 leaves a partition out). Each fingerprint gets thresholds of its own, by dynamic
programming on the candidates it would meet; it probes the index of all fingerprints
with the values of a partition within the threshold, and each candidate is verified.

A fingerprint that would meet more than ``DENSE`` candidates under every allocation
sits in a crowd. Crowded fingerprints are linked among each other through the 65
values within one bit of each: two fingerprints within two bits share such a value.
So a fingerprint costs at most a fixed number of rows, and no link is lost: of two
linked fingerprints, either one probes, or both are crowded.

Equal fingerprints are one from the start, so copies are never paired. A text
without words has fingerprint zero. Rows with a null id are linked as well; a
component without any id has a null component. Repeated rows stay repeated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from signalloom.llm.arrow import add_columns
from signalloom.session import settle

BITS = 64
#: Fixed by the way crowded fingerprints are linked (one bit from either side).
MAX_BITS = 2
PARTITIONS = 3
SEED = 42
SHINGLE = 3
#: Shingles of one text that are held at a time.
HELD = 1 << 16
#: Candidates above which a fingerprint counts as crowded: what the other way costs.
DENSE = BITS + 1
#: Fingerprints from which the correlation of bits is measured.
CORRELATION_SAMPLE = 20_000


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Majority of the hash bits over all shingles, as an unsigned number."""
    words = text.encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, HELD):
        stop = min(n, at + HELD)
        hashes = np.array([digest(b" ".join(words[i : i + shingle]), SEED) for i in range(at, stop)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """``keep`` with ``_print``, the fingerprint as a signed 64-bit number."""

    def run(texts: list[str]) -> dict[str, list]:
        return {"_print": np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)}

    return add_columns(df, text, {"_print": "long"}, run, keep)


def deal_bits(sample: np.ndarray, partitions: int = PARTITIONS) -> list[list[int]]:
    """Partitions of the bits: each is begun by the bit most correlated with the bits
    left, and takes the bits most correlated with its own until it is full."""
    left = list(range(BITS))
    if len(sample) > 1:
        bits = np.unpackbits(np.ascontiguousarray(sample).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
        bits -= bits.mean(0)
        norm = np.sqrt((bits**2).sum(0))
        norm[norm == 0] = 1.0
        close = np.abs((bits / norm).T @ (bits / norm))
    else:
        close = np.zeros((BITS, BITS))
    out = []
    for p in range(partitions):
        size = len(left) // (partitions - p)
        own = [max(left, key=lambda b: (close[b, left].sum(), -b))]
        left.remove(own[0])
        while len(own) < size:
            best = max(left, key=lambda b: (close[b, own].mean(), -b))
            own.append(best)
            left.remove(best)
        out.append(sorted(own))
    return out


def value_of(bits: list[int], column: str = "_print") -> Column:
    """The bits of a fingerprint that belong to a partition, as one number."""
    out = F.lit(0).cast("long")
    for place, bit in enumerate(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.col(column), bit).bitwiseAND(F.lit(1).cast("long")), place))
    return out


def values_within(value: int, width: int, distance: int) -> list[int]:
    """Partition values that differ in at most ``distance`` bits."""
    found, ring = {value}, {value}
    for _ in range(max(0, distance)):
        ring = {v ^ (1 << b) for v in ring for b in range(width)}
        found |= ring
    return sorted(found) if distance >= 0 else []


def allocate(cost: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Least cost and thresholds of each row: dynamic programming over partitions.

    ``cost[row, partition, t + 1]`` is what threshold ``t`` (from -1) costs; the
    thresholds of a row add up to ``total``.
    """
    rows, parts, options = cost.shape
    spend = total + parts  # in steps of t + 1
    best = np.full((rows, spend + 1), np.inf)
    best[:, 0] = 0
    picks = []
    for p in range(parts):
        made, pick = np.full_like(best, np.inf), np.zeros(best.shape, dtype=np.int64)
        for step in range(min(options, spend + 1)):
            through = best[:, : spend + 1 - step] + cost[:, p, step, None]
            better = through < made[:, step:]
            made[:, step:][better] = through[better]
            pick[:, step:][better] = step
        best = made
        picks.append(pick)
    chosen, at = np.zeros((rows, parts), dtype=np.int64), np.full(rows, spend)
    for p in range(parts - 1, -1, -1):
        chosen[:, p] = picks[p][np.arange(rows), at]
        at = at - chosen[:, p]
    return best[:, spend], chosen - 1


def links(prints: DataFrame) -> DataFrame:
    """Pairs ``(a, b)``, ``a > b``, that connect all fingerprints within ``MAX_BITS`` bits.

    ``prints`` has distinct values in ``_print``. Pairs of crowded fingerprints are
    given as links to the least fingerprint around a shared neighbouring value.
    """
    rows = prints.count()
    sample = prints
    if rows > CORRELATION_SAMPLE:
        sample = prints.where(F.pmod(F.xxhash64("_print", F.lit(23)), F.lit(1_000_000)) < int(1e6 * CORRELATION_SAMPLE / rows))
    drawn = np.array([r[0] for r in sample.select("_print").collect()], dtype=np.int64)
    deal = deal_bits(np.sort(drawn))
    widths = [len(bits) for bits in deal]

    index = settle(
        prints.select("_print", F.posexplode(F.array(*[value_of(bits) for bits in deal])).alias("_part", "_value")), "index"
    )
    shared = settle(index.groupBy("_part", "_value").agg(F.count(F.lit(1)).alias("_held")).where("_held > 1"), "shared")

    # what each fingerprint meets at threshold 0; a value of its own meets nobody
    met = index.join(shared, ["_part", "_value"]).groupBy("_print").agg(
        *[F.coalesce(F.max(F.when(F.col("_part") == p, F.col("_held"))), F.lit(1)).alias(f"_met{p}") for p in range(PARTITIONS)]
    )
    # those without a shared value may still have a partner only if every partition differs,
    # which takes PARTITIONS > MAX_BITS bits
    plan = settle(met.mapInArrow(_allocator(deal, widths, rows), "_print long, _crowded boolean, _part int, _value long"), "probes")
    probes = plan.where("not _crowded").select(F.col("_print").alias("_from"), "_part", "_value")
    # estimates may be low: count what the probes meet, and move those over the limit to the crowd
    weight = probes.join(shared, ["_part", "_value"]).groupBy("_from").agg(F.sum("_held").alias("_met"))
    over = settle(weight.where(F.col("_met") > 4 * DENSE).select(F.col("_from").alias("_print")), "over")
    crowd = plan.where("_crowded").select("_print").unionByName(over).distinct()
    probes = probes.join(over.withColumnRenamed("_print", "_from"), "_from", "left_anti")

    everywhere = probes.join(index, ["_part", "_value"])
    near = F.bit_count(F.col("_from").bitwiseXOR(F.col("_print")))
    found = everywhere.where((F.col("_from") != F.col("_print")) & (near <= MAX_BITS))
    pairs = found.select(F.greatest("_from", "_print").alias("a"), F.least("_from", "_print").alias("b")).distinct()

    ball = F.array(F.col("_print"), *[F.col("_print").bitwiseXOR(F.lit(-(1 << 63) if b == 63 else 1 << b)) for b in range(BITS)])
    around = settle(crowd.select("_print", F.explode(ball).alias("_center")), "around")
    least = settle(around.groupBy("_center").agg(F.min("_print").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "least")
    met_there = around.join(least, "_center").where(F.col("_print") > F.col("b"))
    return pairs.unionByName(met_there.select(F.col("_print").alias("a"), "b").distinct())


def _allocator(deal: list[list[int]], widths: list[int], rows: int):
    """Thresholds by cost, and the probes they ask for; crowded fingerprints come without."""

    def run(batches):
        places = [np.array(bits) for bits in deal]
        for batch in batches:
            prints = batch.column(0).to_numpy()
            met = np.stack([batch.column(1 + p).to_numpy() for p in range(PARTITIONS)], axis=1).astype(float)
            if not len(prints):
                continue
            cost = np.zeros((len(prints), PARTITIONS, MAX_BITS + 2))
            for p, width in enumerate(widths):
                variants = 1
                for t in range(MAX_BITS + 1):
                    variants += 0 if t == 0 else int(np.prod([width - i for i in range(t)]) / np.prod(range(1, t + 1)))
                    # candidates: those counted at 0, and the even share of the neighbouring values
                    cost[:, p, t + 1] = variants + met[:, p] + (variants - 1) * rows / 2.0**width
            least, chosen = allocate(cost, MAX_BITS - PARTITIONS + 1)
            bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64)
            out: list[tuple] = []
            for i, print_ in enumerate(prints.tolist()):
                if least[i] > DENSE:
                    out.append((print_, True, None, None))
                    continue
                for p, width in enumerate(widths):
                    t = int(chosen[i, p])
                    if t == 0 and met[i, p] <= 1:
                        continue  # nobody else has the value
                    if t >= 0:
                        value = int((bits[i, places[p]] << np.arange(width)).sum())
                        out += [(print_, False, p, v) for v in values_within(value, width, t)]
            columns = list(zip(*out)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.bool_(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["_print", "_crowded", "_part", "_value"]
            )

    return run


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)``: the least node reachable, for every node of an edge.

    Every round hangs the neighbours of a node on their least one, first the larger
    and then the smaller ones, until each node has one edge, to its root.
    """
    edges = settle(edges.select("a", "b"), "edges")
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settle(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")
        larger = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        larger = settle(larger.distinct(), "larger")
        root = settle(larger.groupBy("a").agg(F.min("b").alias("m")), "root")
        smaller = larger.join(root, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = settle(smaller.unionByName(root.withColumnRenamed("m", "b")).distinct(), "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _by_print(rows: DataFrame, doc_id: str) -> DataFrame:
    """``(_print, _root, component_id, group_rows)`` of each distinct fingerprint in ``rows``."""
    prints = settle(rows.groupBy("_print").agg(F.min(doc_id).alias("_first"), F.count(F.lit(1)).alias("_rows")), "distinct")
    found = settle(components(links(prints.select("_print"))), "components")
    rooted = prints.join(found, prints["_print"] == found["node"], "left")
    rooted = settle(rooted.select("_print", "_first", "_rows", F.coalesce("root", "_print").alias("_root")), "rooted")
    whole = settle(rooted.groupBy("_root").agg(F.min("_first").alias("component_id"), F.sum("_rows").alias("group_rows")), "groups")
    return settle(rooted.join(whole, "_root").select("_print", "_root", "component_id", "group_rows"), "by_print")


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE
) -> DataFrame:
    """``keep`` with ``fingerprint`` (16 hex digits), ``component_id`` (least id of the
    linked group) and ``group_rows`` (rows of the group)."""
    made = ("fingerprint", "component_id", "group_rows")
    held = [c for c in keep if c not in made]
    rows = settle(fingerprints(df, text, tuple(dict.fromkeys([doc_id, *held])), shingle), "prints")
    out = rows.join(_by_print(rows, doc_id).drop("_root"), "_print")
    digits = F.lpad(F.lower(F.hex("_print")), 16, "0").alias("fingerprint")
    return out.select(*held, digits, "component_id", "group_rows")


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row of each linked group, that with the least id (a null id only if there is no other)."""
    printed = fingerprints(df, text, tuple(df.columns), shingle)
    rows = settle(printed.withColumn("_row", F.monotonically_increasing_id()), "rows")  # written, so the numbers stay
    slim = rows.select(doc_id, "_row", "_print")
    slim = slim.join(_by_print(slim, doc_id).select("_print", "_root"), "_print")
    first = slim.groupBy("_root").agg(F.min(F.struct(F.col(doc_id).isNull(), doc_id, "_row")).alias("_first"))
    kept = settle(first.select("_first._row"), "kept")
    # a row for each group: no bound on its size is known, so it is never broadcast
    return rows.join(kept.hint("merge"), "_row", "left_semi").select(*df.columns)
