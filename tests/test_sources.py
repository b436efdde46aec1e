import json
import os

import pytest
from pyspark.sql import functions as F

from signalloom import schemas
from signalloom.operators import splits as sl
from signalloom.operators.align import aligned
from signalloom.sources import notes, tables

SUMMARY = """Data Sampling Rate: 256 Hz
File Name: a_01.edf
Number of Seizures in File: 0

File Name: a_03.edf
Seizure Start Time: 2996 seconds
Seizure End Time: 3036 seconds

File Name: a_04.edf
Seizure 1 Start Time: 10 seconds
Seizure 1 End Time: 20 seconds
Seizure 2 Start Time:  30 seconds
Seizure 2 End Time: 45 seconds

File Name: a_05.edf
Seizure 1 Start Time: 5 seconds
Seizure 1 End Time: 6 seconds
Seizure 2 Start Time: 7 seconds

File Name: a_06.edf
Seizure Start Time: 1 seconds
Seizure 1 Start Time: 50 seconds
Seizure End Time: 2 seconds
Seizure 1 End Time: 60 seconds
"""


def test_annotations(spark, tmp_path):
    (tmp_path / "a-summary.txt").write_text(SUMMARY)
    (tmp_path / "b-summary.txt").write_text("File Name: xa_03.edf\nSeizure Start Time: 1 seconds\nSeizure End Time: 9 seconds\n")
    sections = notes.read_annotations(spark, str(tmp_path))
    wanted = [("a", f"a_0{i}") for i in range(1, 7)] + [("b", "a_03"), ("b", "xa_03")]
    recs = spark.createDataFrame(wanted, "subject_id string, edf_id string")
    got = {tuple(r) for r in notes.annotations_of(sections, recs).collect()}
    assert got == {
        ("a", "a_03", 2996.0, 3036.0), ("a", "a_04", 10.0, 20.0), ("a", "a_04", 30.0, 45.0), ("a", "a_05", 5.0, 6.0),
        ("a", "a_06", 1.0, 2.0),
        # The heading only has to contain the file name.
        ("b", "a_03", 1.0, 9.0), ("b", "xa_03", 1.0, 9.0),
    }


def test_long_headings_stay_bounded(spark):
    heading = "x" * 5000 + "r1.edf and r22.edf"
    df = spark.createDataFrame([("s", f"{heading}\nSeizure Start Time: 1 seconds\nSeizure End Time: 2 seconds")], "subject_id string, value string")
    recs = spark.createDataFrame([("s", "r1"), ("s", "r22"), ("s", "r2"), ("s", "r3")], "subject_id string, edf_id string")
    got = notes.annotations_of(notes.annotation_sections(df), recs)
    # "r2.edf" does occur in "r22.edf" only with another digit before the suffix.
    assert {r["edf_id"] for r in got.collect()} == {"r1", "r22"}


LIST = """PN00
PNO6 is another patient
Seizure n 1
File name: PN00-1.edf
Registration start time: 19.39.33
Start time: 19.58.36
End time: 19.59.46
seizure N 2 (in sleep)
File name:  PNO6-2.edf
Seizure start time: 02:38:37
Seizure end time: 24.00.00
Seizure n 3
Start time: 1.2.3
"""


def test_seizure_list(spark, tmp_path):
    (tmp_path / "list.txt").write_text(LIST)
    rows = [tuple(r) for r in notes.read_seizure_list(spark, str(tmp_path)).collect()]
    assert rows == [
        # The first "start time" of a block counts, whatever stands before it.
        ("PN00", "PN00-1.edf", "19.39.33", "19.59.46", 70773, 71986),
        ("PN00", "PN06-2.edf", "02:38:37", "24.00.00", 9517, None),
    ]
    none = spark.createDataFrame([("no patient\nSeizure n 1\nStart time: 1.1.1\nEnd time: 1.1.2",)], "value string")
    assert notes.seizure_blocks(none).count() == 0


def test_records_and_lookup(spark, tmp_path):
    (tmp_path / "RECORDS").write_text("PN00/PN00-1.edf\n\n  PN01/PN01-1.edf \nbad\na/b/c\nPN02/PN02-1.edf\nPN02/PN02-2.edf\n")
    records = notes.read_records(spark, str(tmp_path / "RECORDS"))
    assert {r["path"] for r in records.collect()} == {"PN00/PN00-1.edf", "PN01/PN01-1.edf", "PN02/PN02-1.edf", "PN02/PN02-2.edf"}
    seizures = spark.createDataFrame(
        [("PN00", "pn00-1.EDF"), ("PN01", None), ("PN02", None), ("PN03", "x.edf")], "patient string, filename string"
    )
    filled = notes.with_inferred_filenames(seizures, records)
    assert {tuple(r) for r in filled.collect()} == {
        ("PN00", "pn00-1.EDF"), ("PN01", "PN01-1.edf"), ("PN02", None), ("PN03", "x.edf"),
    }
    hits = notes.matched_seizures(filled, records)
    assert {(r["patient"], r["record_name"]) for r in hits.collect()} == {("PN00", "PN00-1.edf"), ("PN01", "PN01-1.edf")}
    assert {r["patient"] for r in notes.matched_seizures(filled, records, "left_anti").collect()} == {"PN02", "PN03"}


META = [("d", "s", "r", i, 2.0 * i, 2.0 * i + 4, int(i > 2), 128.0, 23, 512) for i in range(6)]


def metadata(spark):
    return spark.createDataFrame(META, schemas.WINDOW_METADATA)


def test_metadata_headers_are_checked(spark, tmp_path):
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    metadata(spark).write.option("header", True).csv(good)
    (tmp_path / "good" / "empty.csv").write_text("")
    assert tables.read_window_metadata(spark, good).count() == 6
    metadata(spark).drop("label").write.option("header", True).csv(bad)
    with pytest.raises(Exception):
        tables.read_window_metadata(spark, [good, bad]).collect()


def test_rejected_lines(spark, tmp_path):
    (tmp_path / "p.csv").write_text(",".join(schemas.PREDICTIONS.fieldNames()) + "\nd,s,r,0,0,4,0,0,0.5\nd,s,r,x,0,4,0,0,0.5\n")
    good, bad = tables.read_csv_or_reject(spark, str(tmp_path / "p.csv"), schemas.PREDICTIONS)
    assert good.count() == 1 and bad.collect()[0]["line"] == "d,s,r,x,0,4,0,0,0.5"


def scores(spark, shift=0, flip=False):
    rows = [("s", "r", i + shift, int(i > 2) ^ int(flip), 1, 0.25 * i) for i in range(4)]
    return spark.createDataFrame(rows, "subject_id string, edf_id string, window_index long, y_true int, y_pred int, y_prob double")


def test_window_predictions_round_trip(spark, tmp_path):
    path = str(tmp_path / "pred")
    tables.write_window_predictions(metadata(spark), scores(spark), path)
    rows = tables.load_predictions(spark, path).collect()
    assert [r["window_index"] for r in rows] == [0, 1, 2, 3] and rows[3]["end_sec"] == 10.0


@pytest.mark.parametrize("change, text", [({"flip": True}, "label_matches: 4"), ({"shift": 90}, "known_window: 4")])
def test_bad_predictions_are_not_written(spark, tmp_path, change, text):
    with pytest.raises(ValueError, match=text):
        tables.write_window_predictions(metadata(spark), scores(spark, **change), str(tmp_path / "x"))
    assert not os.path.exists(tmp_path / "x")


def test_empty_and_doubled_predictions_raise(spark, tmp_path):
    with pytest.raises(ValueError, match="not_empty"):
        tables.write_window_predictions(metadata(spark), scores(spark).limit(0), str(tmp_path / "x"))
    with pytest.raises(ValueError, match="unique_key: 4"):
        doubled = scores(spark).unionByName(scores(spark))
        tables.write_window_predictions(metadata(spark), doubled, str(tmp_path / "y"))


def test_checks_do_not_evaluate_the_join_again_and_leave_nothing_behind(spark, tmp_path):
    """The scores count how often they are worked out; a refused table leaves no file, an existing one is kept."""
    worked = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            worked.add(batch.num_rows)
            yield batch

    counted = scores(spark).mapInArrow(run, scores(spark).schema)
    tables.write_window_predictions(metadata(spark), counted, str(tmp_path / "once"))
    assert worked.value == 4
    with pytest.raises(ValueError, match="label_matches: 4"):
        tables.write_window_predictions(metadata(spark), scores(spark, flip=True), str(tmp_path / "x"))
    with pytest.raises(FileExistsError):
        tables.write_window_predictions(metadata(spark), scores(spark), str(tmp_path / "once"))
    assert sorted(os.listdir(tmp_path)) == ["once"]
    assert tables.load_predictions(spark, str(tmp_path / "once")).count() == 4


def test_sequence_predictions_belong_to_the_newest_window(spark, tmp_path):
    path = str(tmp_path / "seq")
    rows = [("s", "r", i, int(i + 2 > 2), 0, 0.5) for i in range(4)]
    seqs = spark.createDataFrame(rows, "subject_id string, edf_id string, start_index long, y_true int, y_pred int, y_prob double")
    tables.write_sequence_predictions(metadata(spark), seqs, 3, path)
    assert [r["window_index"] for r in tables.load_predictions(spark, path).collect()] == [2, 3, 4, 5]
    with pytest.raises(ValueError):
        tables.write_sequence_predictions(metadata(spark), seqs, 0, path)


def test_manifest_round_trip_and_checks(spark, tmp_path):
    assignment = {"train": ["s2", "s1"], "validation": ["s3"], "test": ["s4"]}
    path = str(tmp_path / "manifest")
    tables.write_split_manifest(sl.split_table(spark, assignment), "demo", path)
    rows = {(r["subject_id"], r["split"], r["ordinal"]) for r in tables.read_split_manifest(spark, path).collect()}
    assert rows == {("s1", "train", 0), ("s2", "train", 1), ("s3", "validation", 0), ("s4", "test", 0)}
    good = {"format_version": 1, "split_type": "subject_level", "dataset": "demo", "train": ["a"], "validation": ["b"], "test": ["c"]}
    for name, change in {"all_subjects": {"all_subjects": ["a", "c", "b"]}, "no_repeats": {"test": ["a"]}, "splits_filled": {"test": []}}.items():
        file = tmp_path / f"{name}.json"
        file.write_text(json.dumps({**good, **change}, indent=2))
        with pytest.raises(ValueError, match=name):
            tables.read_split_manifest(spark, str(file))
    file = tmp_path / "ok.json"
    file.write_text(json.dumps(good, indent=2))
    assert tables.read_split_manifest(spark, str(file)).count() == 3


def test_feature_cache_append_and_force(spark, tmp_path):
    path = str(tmp_path / "features")
    rows = spark.createDataFrame([(1, [0.5])], "w long, features array<double>")
    tables.append_features(rows, path)
    tables.append_features(rows, path)
    assert spark.read.parquet(path).count() == 2
    tables.append_features(rows, path, force=True)
    assert spark.read.parquet(path).count() == 1


def test_arrays_and_scores_are_partitioned(spark, tmp_path):
    df = spark.createDataFrame([("s1", [0.5], "train"), ("s2", [1.5], "test")], "subject_id string, x array<double>, split string")
    tables.write_subject_arrays(df, str(tmp_path / "arrays"))
    assert {"subject_id=s1", "subject_id=s2"} <= set(os.listdir(tmp_path / "arrays"))
    tables.write_by_split(df, str(tmp_path / "splits"))
    plan = spark.read.parquet(str(tmp_path / "splits")).where(F.col("split") == "test")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_bucketed_tables_are_joined_without_an_exchange(spark, tmp_path):
    rows = spark.range(500).selectExpr("concat('s', id % 3) AS subject_id", "id AS w", "array(double(id), 2D) AS x")
    features = rows.selectExpr("subject_id", "w", "array(x[0] * 2) AS f")
    key = ["subject_id", "w"]
    for name, df in (("wins", rows), ("feats", features)):
        tables.write_bucketed(df, f"bucketed_{name}", str(tmp_path / name), key, 4)
    again = tables.read_bucketed(spark, "bucketed_again", str(tmp_path / "feats"), key, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for right in (spark.table("bucketed_feats"), again):
            joined = aligned(spark.table("bucketed_wins"), right, key)
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "SortMergeJoin" in plan and "Bucketed: true" in plan
            assert joined.where("f[0] = 2 * x[0]").count() == 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("wins", "feats", "again"):
            spark.sql(f"DROP TABLE bucketed_{name}")


def test_a_refreshed_cache_holds_every_window_once(spark, tmp_path):
    path, seen = str(tmp_path / "cache"), []
    windows = spark.createDataFrame([(f"r{i % 3}", i, float(i)) for i in range(30)], "edf_id string, w long, x double")

    def compute(rows):
        seen.append(sorted(r.edf_id for r in rows.select("edf_id").distinct().collect()))
        return rows.select("edf_id", "w", F.array("x", "x").alias("features"))

    refresh = lambda rows, **more: tables.refresh_features(rows, path, ["w"], "edf_id", compute, 2, **more)
    refresh(windows.where("edf_id = 'r0'"))
    refresh(windows)
    refresh(windows)
    extra = windows.union(spark.createDataFrame([("r2", 99, 1.0)], windows.schema))
    refresh(extra)
    assert seen == [["r0"], ["r1", "r2"], [], ["r2"]]
    rows = spark.read.parquet(path)
    assert rows.count() == 31 and rows.select("w").distinct().count() == 31
    refresh(windows, force=True)
    assert spark.read.parquet(path).count() == 30


def test_unreadable_recordings_are_rejected_with_a_reason(spark, tmp_path):
    import struct

    from signalloom.sources.recordings import read_or_reject

    def decode(path, content):
        count = struct.unpack("<i", content[:4])[0]
        for i in range(count):
            yield {"i": i, "x": struct.unpack_from("<d", content, 4 + 8 * i)[0]}

    def write(name, values, claimed=None):
        (tmp_path / name).write_bytes(struct.pack(f"<i{len(values)}d", claimed or len(values), *values))

    write("a.rec", [1.0, 2.0])
    write("cut.rec", [float(i) for i in range(400)], claimed=500)
    write("empty.rec", [])
    (tmp_path / "short.rec").write_bytes(b"x")
    rows, rejects = read_or_reject(spark, str(tmp_path), decode, "i long, x double")
    assert [(os.path.basename(r.file), r.i, r.x) for r in rows.orderBy("i").collect()] == [("a.rec", 0, 1.0), ("a.rec", 1, 2.0)]
    reasons = {os.path.basename(r.file): r.reason for r in rejects.collect()}
    assert set(reasons) == {"cut.rec", "short.rec"} and all(r.startswith("error: unpack") for r in reasons.values())
    with pytest.raises(ValueError, match="no recording is left; .*short.rec: error"):
        read_or_reject(spark, str(tmp_path / "short.rec"), decode, "i long, x double")
