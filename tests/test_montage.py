import random

import pytest
from pyspark.sql import functions as F

from signalloom.functions.scalars import canonical_channel, canonical_electrode, clock_seconds, normalized_filename
from signalloom.operators import montage as mo


def channels(spark, **recordings):
    rows = [(name[:5], name, i, c) for name, names in recordings.items() for i, c in enumerate(names)]
    return spark.createDataFrame(rows, "subject_id string, edf_id string, pos int, name string")


def test_fixed_orders():
    assert len(mo.CANONICAL) == len(mo.FORMER) == 23
    assert mo.permutation(mo.FORMER, mo.CANONICAL) == [*range(8), *range(10, 18), 8, 9, *range(18, 23)]
    assert (len(mo.ELECTRODES_29), len(mo.ELECTRODES_19)) == (29, 19)
    with pytest.raises(ValueError):
        mo.permutation(["a", "a"], ["a", "b"])


def test_auxiliary_channels(spark):
    extra = ["VNS", "-", "--0", "LOC-ROC", "EKG-Ref", "PZ-OZ"]
    df = channels(spark, chb12_1=["A-B", *extra, "C-D"], chb15_1=["A-B", *extra], chb01_1=extra)
    kept = {}
    for r in mo.drop_auxiliary(df).orderBy("edf_id", "pos").collect():
        kept.setdefault(r["edf_id"], []).append((r["pos"], r["name"]))
    assert kept["chb12_1"] == [(0, "A-B"), (1, "EKG-Ref"), (2, "PZ-OZ"), (3, "C-D")]
    assert kept["chb15_1"] == [(0, "A-B"), (1, "LOC-ROC")]
    assert kept["chb01_1"] == [(0, "LOC-ROC"), (1, "EKG-Ref"), (2, "PZ-OZ")]


def test_names(spark):
    df = spark.createDataFrame([(" T8-P8-0\t", "t3", " PNO6-1.edf\n"), ("T8-P8-1", " T6 ", "PN11-.edf"), ("P7-O1", "fz", None)], "c string, e string, f string")
    got = df.select(canonical_channel("c"), canonical_electrode("e"), normalized_filename("f")).collect()
    assert [tuple(r) for r in got] == [("T8-P8", "T7", "PN06-1.edf"), ("T8-P8", "P8", "PN11-1.edf"), ("P7-O1", "FZ", None)]


@pytest.mark.parametrize(
    "text, seconds",
    [("19.58.36", 71916), ("00:00:00", 0), (" 1:02.03 ", 3723), ("24.00.00", None), ("10.60.00", None), ("1.2", None),
     ("a.b.c", None), ("1.2.3.4", None), (None, None), ("23.59.59", 86399)],
)
def test_clock(spark, text, seconds):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(clock_seconds("t").alias("s")).first()["s"] == seconds


def test_layout_status_and_quarantine(spark):
    doubled = [c if not c.startswith("T8-P8") else "T8-P8" for c in mo.CANONICAL]
    swapped = [mo.CANONICAL[1], mo.CANONICAL[0], *mo.CANONICAL[2:]]
    df = mo.layouts(channels(spark, s0001=mo.CANONICAL, s0002=doubled, s0003=swapped, s0004=mo.CANONICAL[:22]))
    expected = df.select("subject_id", "edf_id").unionByName(
        spark.createDataFrame([("s0005", "s0005")], "subject_id string, edf_id string")
    )
    status = {r["edf_id"]: r["status"] for r in mo.semantic_status(expected, df).collect()}
    assert status == {"s0001": "PASS", "s0002": "PASS", "s0003": "MISMATCH_2", "s0004": "BAD_COUNT_22", "s0005": "FILE_MISSING"}
    good, rejected = mo.quarantine(df)
    assert {r["edf_id"] for r in good.collect()} == {"s0001", "s0002"}
    assert {(r["edf_id"], r["reason"]) for r in rejected.collect()} == {("s0003", "channel layout"), ("s0004", "channel count 22")}
    diffs = {(r["edf_id"], r["pos"], r["here"], r["base"]) for r in mo.order_differences(df, mo.CANONICAL).collect()}
    assert ("s0003", 0, "F7-T7", "FP1-F7") in diffs and ("s0004", 22, mo.MISSING, "T8-P8-1") in diffs


def test_first_recording_decides(spark):
    df = channels(spark, s0001_1=["a", "b"], s0001_2=["b", "a"], s0001_3=["a"], s0001_4=["a", "b"])
    got = {r["edf_id"][-1]: r["verdict"] for r in mo.against_first_recording(mo.layouts(df)).collect()}
    assert got == {"1": "keep", "2": "warn", "3": "skip", "4": "keep"}


def test_permutation_round_trip(spark):
    rng = random.Random(0)
    target = list("abcdef")
    former = target[:]
    rng.shuffle(former)
    rows = [(i, [[rng.random() for _ in range(4)] for _ in target], former if i % 2 else target, i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "w int, signal array<array<double>>, order array<string>, label int")
    fixed = mo.permute_channels(df, "order", former, target)
    perm = mo.permutation(former, target)
    moved, same = df.where("w % 2 = 1"), df.where("w % 2 = 0")
    check = mo.verify_permutation(moved, fixed.where("w % 2 = 1"), ["w"], perm).first()
    assert (check["compared"], check["changed_signals"], check["changed_labels"], check["missing"]) == (10, 0, 0, 0)
    assert mo.verify_permutation(same, fixed.where("w % 2 = 0"), ["w"], list(range(6))).first()["changed_signals"] == 0
    broken = fixed.withColumn("signal", F.reverse("signal")).withColumn("label", 1 - F.col("label")).where("w > 2 AND w % 2 = 1")
    check = mo.verify_permutation(moved, broken, ["w"], perm).first()
    assert (check["changed_signals"], check["changed_labels"], check["missing"]) == (9, 9, 1)
    unknown = df.withColumn("order", F.reverse("order"))
    with pytest.raises(Exception, match="neither known order"):
        mo.permute_channels(unknown, "order", former, target).collect()


def test_coverage_of_the_target_montage(spark):
    df = channels(spark, s0001=mo.CANONICAL).select("edf_id", "pos", "name")
    sets = [("29", e) for e in mo.ELECTRODES_29] + [("19", e) for e in mo.ELECTRODES_19]
    cover = mo.bipolar_coverage(df, spark.createDataFrame(sets, "montage string, electrode string"))
    rows = {(r["montage"], r["name"]): r for r in cover.collect()}
    assert rows["29", "T7-FT9"]["missing"] == "FT9" and rows["19", "FT9-FT10"]["missing"] == "FT9, FT10"
    assert rows["29", "F7-T7"]["status"] == "YES"
    share = {r["montage"]: (r["reconstructable"], r["derivations"]) for r in mo.coverage_summary(cover).collect()}
    assert share == {"29": (20, 23), "19": (20, 23)}


def test_inventory(spark):
    rows = [("s", "r", k, 512.0, 60.0) for k in ("eeg", "eeg", "ecg", "misc")]
    df = spark.createDataFrame(rows, "subject_id string, edf_id string, channel_type string, sampling_rate double, duration_sec double")
    marks = spark.createDataFrame([("s", "r")], "subject_id string, edf_id string")
    r = mo.inventory(df, marks).first()
    assert (r["channels"], r["eeg_channels"], r["eog_channels"], r["duration_min"], r["annotations"]) == (4, 2, 0, 1.0, 1)


def test_a_job_without_usable_recordings_stops(spark):
    from signalloom.plans.recording_windows import usable_recordings

    good, rejected = usable_recordings(channels(spark, s0001=["VNS", *mo.CANONICAL], s0002=["a"]))
    assert [r["edf_id"] for r in good.collect()] == ["s0001"] and rejected.count() == 1
    with pytest.raises(ValueError, match="no recording"):
        usable_recordings(channels(spark, s0002=["a"]))
