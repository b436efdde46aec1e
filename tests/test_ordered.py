"""Chunked ordered operators against plain loops, with chunks small enough to matter."""

import random

import pytest
from pyspark.sql import functions as F

from signalloom.operators.events import (
    alarm_sessions, hours_of_swept, negative_hours, predicted_events, session_of_windows, sweep_events, true_events,
)
from signalloom.operators.intervals import bounded_bin, dyadic_cover, label_windows, merge_intervals, overlapping_pairs
from signalloom.operators.ordered import (
    first_per_group,
    global_index,
    numbered,
    previous_value,
    ranked,
    score_ladder,
    value_cell,
    with_halo,
)

KEYS = ["subject_id", "edf_id"]
MARK_SCHEMA = "subject_id string, edf_id string, start_sec double, end_sec double"


def random_positives(seed=1, recordings=40):
    """Windows at even seconds; recording 0 is far longer than the others."""
    rng = random.Random(seed)
    rows = []
    for r in range(recordings):
        n = 600 if r == 0 else rng.randint(0, 40)
        density = rng.choice([0.1, 0.4, 0.8])
        for i in range(n):
            rows.append((f"s{r % 3}", f"r{r}", i, 2.0 * i, 2.0 * i + 4.0, int(rng.random() < density)))
    return rows


def loop_sessions(rows, gap=4.0):
    out = []
    for key in sorted({r[:2] for r in rows}):
        current = None
        for _, _, _, start, end, pred in sorted(r for r in rows if r[:2] == key):
            if not pred:
                continue
            if current and start - current[5] <= gap + 1e-6:
                current[1], current[3], current[5] = max(current[1], end), current[3] + 1, start
            else:
                if current:
                    out.append((*key, *current[:4]))
                current = [start, end, end, 1, None, start]
        if current:
            out.append((*key, *current[:4]))
    return out


@pytest.mark.parametrize("chunk_sec", [6.0, 50.0, 1e9])
def test_sessions_equal_a_loop(spark, chunk_sec):
    rows = random_positives()
    df = spark.createDataFrame(
        rows, "subject_id string, edf_id string, window_index long, start_sec double, end_sec double, y_pred int"
    )
    got = {tuple(r) for r in alarm_sessions(df, 4.0, chunk_sec).collect()}
    assert got == set(loop_sessions(rows))


def test_event_ids_follow_the_global_order(spark):
    rows = random_positives(5)
    df = spark.createDataFrame(
        rows, "subject_id string, edf_id string, window_index long, start_sec double, end_sec double, y_pred int"
    )
    got = predicted_events(df, 4.0, 30.0).orderBy("event_id").collect()
    assert [r["event_id"] for r in got] == list(range(len(got)))
    order = [(r["subject_id"], r["edf_id"], r["start_sec"]) for r in got]
    assert order == sorted(order)
    starts = session_of_windows(df, 4.0, 30.0).groupBy(*KEYS, "session_start").count().collect()
    assert {(r[0], r[1], r[2], r[3]) for r in starts} == {
        (r["subject_id"], r["edf_id"], r["start_sec"], r["n_positive_windows"]) for r in got
    }


def test_gap_must_cover_a_step(spark):
    with pytest.raises(ValueError):
        alarm_sessions(spark.range(0), 1.0)


def random_intervals(seed, keys=30):
    rng = random.Random(seed)
    rows = []
    for k in range(keys):
        for _ in range(300 if k == 0 else rng.randint(1, 25)):
            start = float(rng.randint(0, 400))
            rows.append(("s", f"r{k}", start, start + rng.choice([1, 2, 5, 150]) * (1 if k else 0.01)))
    return rows


def loop_merge(rows):
    out = []
    for key in sorted({r[:2] for r in rows}):
        spans = sorted((r[2], r[3]) for r in rows if r[:2] == key)
        merged = [list(spans[0])]
        for start, end in spans[1:]:
            if start <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([start, end])
        out += [(*key, *m) for m in merged]
    return out


@pytest.mark.parametrize("bin_sec", [3.0, 40.0, 1e9])
def test_merged_intervals_equal_a_loop(spark, bin_sec):
    rows = random_intervals(3)
    df = spark.createDataFrame(rows, "subject_id string, edf_id string, start_sec double, end_sec double")
    got = {tuple(r) for r in merge_intervals(df, KEYS, bin_sec=bin_sec).collect()}
    assert got == set(loop_merge(rows))


def test_touching_intervals_merge_and_ids_restart(spark):
    df = spark.createDataFrame(
        [("s", "a", 0.0, 4.0), ("s", "a", 4.0, 6.0), ("s", "a", 7.0, 8.0), ("s", "b", 1.0, 2.0)],
        "subject_id string, edf_id string, start_sec double, end_sec double",
    )
    got = sorted(tuple(r) for r in true_events(df).select(*KEYS, "true_event_id", "start_sec", "end_sec").collect())
    assert got == [("s", "a", 0, 0.0, 6.0), ("s", "a", 1, 7.0, 8.0), ("s", "b", 0, 1.0, 2.0)]


@pytest.mark.parametrize("bin_sec", [2.0, 30.0, 1e6])
def test_overlapping_pairs_equal_brute_force(spark, bin_sec):
    a, b = random_intervals(7, 6), random_intervals(8, 6)
    left = spark.createDataFrame(a, "subject_id string, edf_id string, start_sec double, end_sec double")
    right = spark.createDataFrame(b, "subject_id string, edf_id string, true_start double, true_end double")
    got = sorted(
        tuple(r) for r in overlapping_pairs(left, right, KEYS, bin_sec)
        .select("edf_id", "start_sec", "end_sec", "true_start", "true_end", "overlap_sec").collect()
    )
    want = sorted(
        (x[1], x[2], x[3], y[2], y[3], min(x[3], y[3]) - max(x[2], y[2]))
        for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3]
    )
    assert got == want


@pytest.mark.parametrize("bin_sec", [3.0, 1000.0])
def test_labels_need_a_real_overlap(spark, bin_sec):
    marks = random_intervals(11, 5)
    windows = [("s", f"r{k}", 2.0 * i, 2.0 * i + 4.0) for k in range(6) for i in range(200)]
    w = spark.createDataFrame(windows, "subject_id string, edf_id string, start_sec double, end_sec double")
    m = spark.createDataFrame(marks, "subject_id string, edf_id string, start_sec double, end_sec double")
    got = {(r["edf_id"], r["start_sec"]): r["label"] for r in label_windows(w, m, KEYS, 4.0, bin_sec=bin_sec).collect()}
    assert len(got) == len(windows)
    for _, rec, start, end in windows:
        assert got[rec, start] == int(any(x[1] == rec and x[2] < end and x[3] > start for x in marks))


def test_numbering_and_previous_value(spark):
    rng = random.Random(2)
    rows = [(f"k{rng.choice([0, 0, 1, 2])}", t, rng.choice("abc")) for t in rng.sample(range(1000), 400)]
    df = spark.createDataFrame(rows, "k string, t long, x string")
    placed = {(r["k"], r["t"]): r["n"] for r in numbered(df, ["k"], ["t"], F.floor(F.col("t") / 7), "n").collect()}
    before = {
        (r["k"], r["t"]): r["p"] for r in previous_value(df, ["k"], "x", ["t"], F.floor(F.col("t") / 7), "p").collect()
    }
    for key in {r[0] for r in rows}:
        last = None
        for n, (_, t, x) in enumerate(sorted(r for r in rows if r[0] == key)):
            assert placed[key, t] == n and before[key, t] == last
            last = x


def test_global_index_equals_a_sort(spark):
    rows = [(f"s{i % 3}", f"r{i % 11}", i * 37 % 1009) for i in range(500)]
    df = spark.createDataFrame(rows, "a string, b string, t long")
    got = global_index(df, ["a", "b"], ["t"], F.floor(F.col("t") / 50), "n").orderBy("n").collect()
    assert [tuple(r)[:3] for r in got] == sorted(rows) and [r["n"] for r in got] == list(range(500))


def test_first_per_group_keeps_exactly_the_first(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", (i * 7919) % 10_007, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, o long, id long")
    got = {tuple(r) for r in first_per_group(df, ["g"], ["o"], 4, ["id"], slices=8).collect()}
    assert got == {tuple(r) for r in first_per_group(df, ["g"], ["o"], 4, ["id"]).collect()}
    want = {r for g in {r[0] for r in rows} for r in sorted((x for x in rows if x[0] == g), key=lambda x: x[1])[:4]}
    assert got == want


def test_halo_covers_every_bounded_frame(spark):
    df = spark.range(50).withColumnRenamed("id", "i")
    rows = with_halo(df, "i", 8, behind=3, ahead=2).collect()
    held = {}
    for r in rows:
        held.setdefault(r["_chunk"], set()).add(r["i"])
    own = [r["i"] for r in rows if r["_own"]]
    assert sorted(own) == list(range(50))
    for i in own:
        assert set(range(max(0, i - 3), min(49, i + 2) + 1)) <= held[i // 8]


def test_cells_never_fall(spark):
    rng = random.Random(1)
    edges = [s * 2.0**e * f for s in (-1, 1) for e in range(-40, 40, 3) for f in (1, 1 - 2**-53, 1 + 2**-52)]
    values = [0.0, -0.0, 5e-324, -5e-324, 1.7e308, float("inf"), -float("inf")] + edges
    values = sorted(values + [rng.uniform(-1, 1) ** 9 for _ in range(2000)])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    for bits in (0, 5, 14):
        cells = [r[0] for r in df.orderBy("i").select(value_cell(F.col("v"), bits)).collect()]
        assert cells == sorted(cells)
    assert df.select(F.max(value_cell(F.col("v"), 5)) < F.max(value_cell(F.lit(float("nan")), 5))).first()[0]


@pytest.mark.parametrize("bits", [0, 3, 14])
def test_score_ladder_counts(spark, bits):
    rng = random.Random(4)
    rows = [("hot" if i % 3 else "cold", rng.choice([0.0, 1.0, round(rng.random() ** 6, 4)]), int(rng.random() < 0.3))
            for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, p double, y int")
    for r in score_ladder(df, ["g"], "p", "y", bits).collect():
        mine = [x for x in rows if x[0] == r["g"]]
        assert r["n"] == sum(x[1] == r["p"] for x in mine)
        assert r["n_ge"] == sum(x[1] >= r["p"] for x in mine)
        assert r["positives_ge"] == sum(x[1] >= r["p"] and x[2] for x in mine)
        assert r["n_all"] == len(mine) and r["positives_all"] == sum(x[2] for x in mine)


def test_a_cover_has_two_nodes_a_level_and_holds_just_its_bins(spark):
    rng = random.Random(4)
    pairs = [(0, 0), (-1, 0), (5, 4), (-(1 << 44), 1 << 44), (1, (1 << 40) - 2)]
    pairs += [tuple(sorted((rng.randrange(-200, 200), rng.randrange(-200, 200)))) for _ in range(60)]
    df = spark.createDataFrame(pairs, "a long, b long").withColumn("c", dyadic_cover(F.col("a"), F.col("b")))
    for row in df.collect():
        levels = [n.level for n in row.c]
        assert all(levels.count(k) <= 2 for k in levels)
        assert sum(1 << n.level for n in row.c) == max(0, row.b - row.a + 1)
        if 0 <= row.b - row.a < 1000:
            held = sorted(b for n in row.c for b in range(n.place << n.level, (n.place + 1) << n.level))
            assert held == list(range(row.a, row.b + 1))


def test_absurd_intervals_cost_a_bounded_number_of_rows(spark):
    """A year, a wrong end time and one without an end, among short intervals."""
    marks = [("r", 100.0, 110.0), ("r", 5000.0, 5000.0 + 365 * 86400.0), ("r", 9000.0, 1e12), ("r", 40.0, float("inf")), ("x", 0.0, 1.0)]
    marked = spark.createDataFrame([("s", *m) for m in marks], MARK_SCHEMA)
    covers = marked.select(F.size(dyadic_cover(bounded_bin(F.col("start_sec")), bounded_bin(F.col("end_sec")))).alias("n"))
    assert max(r.n for r in covers.collect()) <= 2 * 46
    starts = [10.0, 100.0, 4998.0, 5001.0, 8990.0, 1e7, 4e7, 9e11, 2e12]
    windows = spark.createDataFrame([("s", "r", t, t + 4.0) for t in starts], MARK_SCHEMA)
    got = {r.start_sec: r.label for r in label_windows(windows, marked, KEYS, 4.0).collect()}
    assert got == {t: int(any(s < t + 4 and e > t for k, s, e in marks if k == "r")) for t in starts}
    right = marked.select("subject_id", "edf_id", F.col("start_sec").alias("true_start"), F.col("end_sec").alias("true_end"))
    pairs = sorted((r.start_sec, r.true_start) for r in overlapping_pairs(windows, right, KEYS).collect())
    assert pairs == sorted((t, s) for t in starts for k, s, e in marks if k == "r" and s < t + 4 and t < e)


def test_ranked_equals_a_sort(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), rng.randrange(10_000)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, t long").repartition(5)
    got = sorted(((r.overall, r.k, r.t, r.n) for r in ranked(df, ["k"], ["t"], "n", "overall").collect()))
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    seen: dict = {}
    for i, (k, t) in enumerate(want):
        assert got[i] == (i, k, t, seen.get(k, 0))
        seen[k] = seen.get(k, 0) + 1
    assert ranked(df.where("false"), ["k"], ["t"], "n", "overall").count() == 0


@pytest.mark.parametrize("chunk_sec", [7.0, 60.0, 3600.0])
def test_a_sweep_equals_the_single_steps(spark, chunk_sec):
    rows = [(*r[:5], r[5], None if r[1] == "r3" else 0) for r in random_positives(9)]
    pred = spark.createDataFrame(rows, "subject_id string, edf_id string, window_index long, start_sec double, end_sec double, y_pred int, x int")
    marks = spark.createDataFrame([*random_intervals(12), ("s0", "unscored", 1.0, 2.0)], MARK_SCHEMA)
    swept = sweep_events(pred, marks, chunk_sec=chunk_sec)
    plain = lambda df, columns: sorted(tuple(r) for r in df.select(*columns).collect())
    columns = [*KEYS, "start_sec", "end_sec", "detection_sec", "n_positive_windows", "event_id"]
    assert plain(swept.events, columns) == plain(predicted_events(pred), columns)
    columns = [*KEYS, "true_event_id", "start_sec", "end_sec"]
    assert plain(swept.truth, columns) == plain(true_events(marks, pred), columns)
    hours = negative_hours(pred, true_events(marks, pred)).collect()
    got = {r.edf_id: r.negative_hours for r in hours_of_swept(swept).collect()}
    assert got == {r.edf_id: pytest.approx(r.negative_hours) for r in hours}
