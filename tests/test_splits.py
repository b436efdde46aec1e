import pytest
from pyspark.sql import functions as F

from signalloom.operators import splits as sl


def test_split_lists_are_validated(spark):
    with pytest.raises(ValueError, match="more than once"):
        sl.split_table(spark, {"train": ["a", "b"], "test": ["a"]})
    with pytest.raises(ValueError, match="empty"):
        sl.split_table(spark, {"train": ["a"], "test": []})


def test_split_problems(spark):
    assigned = spark.createDataFrame([("a", "train"), ("a", "test"), ("x", "train")], "subject_id string, split string")
    subjects = spark.createDataFrame([("a",), ("b",), ("b",)], "subject_id string")
    got = {r["constraint"]: r["violations"] for r in sl.split_problems(assigned, subjects).collect()}
    assert got == {"overlap": 1, "missing": 1, "unassigned": 1, "empty_split": 1}
    totals = sl.partition_totals(subjects, assigned.where("split = 'train'")).first()
    assert (totals["original"], totals["lost"]) == (3, 2)


def rows(spark, parts):
    return spark.range(0, 3000, 1, parts).select(
        F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("g"), (F.col("id") % 10 == 0).cast("int").alias("label")
    )


def test_sample_does_not_depend_on_partitions(spark):
    a, b = ({r["k"] for r in sl.fixed_sample(rows(spark, p), ["g"], ["k"], 50).collect()} for p in (1, 17))
    assert a == b and len(a) == 100
    assert {r["k"] for r in sl.fixed_sample(rows(spark, 3), ["g"], ["k"], 50, seed=7).collect()} != a
    assert sl.fixed_sample(rows(spark, 3), ["g"], ["k"], 1000).where("g = 'rare'").count() == 300


def test_resample_balances_and_keeps_the_size(spark):
    drawn = sl.balanced_resample(rows(spark, 5), ["k"]).cache()
    assert drawn.count() == 3000 and drawn.select("draw_k").distinct().count() == 3000
    share = drawn.agg(F.avg("label")).first()[0]
    assert 0.45 < share < 0.55
    assert drawn.where((F.col("label") == 1) != (F.col("k") % 10 == 0)).count() == 0


def test_one_class_is_an_error(spark):
    one = rows(spark, 2).where("label = 0")
    with pytest.raises(Exception, match="only one class"):
        sl.class_weights(one).collect()
    weights = {r["label"]: r["weight"] for r in sl.class_weights(rows(spark, 2)).select("label", "weight").distinct().collect()}
    assert weights == {0: 1 / 2700, 1: 1 / 300}


def test_file_split_shares_and_guard(spark):
    files = spark.range(200).select(F.concat(F.lit("r"), "id").alias("edf_id"), (F.col("id") % 4 == 0).cast("int").alias("pos"))
    got = {(r["pos"], r["split"]): r["count"] for r in sl.file_split(files, ["edf_id"], "pos").groupBy("pos", "split").count().collect()}
    assert got == {(1, "train"): 35, (1, "validation"): 7, (1, "test"): 8, (0, "train"): 105, (0, "validation"): 22, (0, "test"): 23}
    with pytest.raises(Exception, match="not enough"):
        sl.file_split(files.where("pos = 0 OR edf_id = 'r0'"), ["edf_id"], "pos").collect()


def test_ordinals(spark):
    table = sl.split_table(spark, {"train": ["b", "a"], "validation": ["d"], "test": ["c"]})
    got = {r["subject_id"]: (r["ordinal"], r["overall"]) for r in sl.subject_ordinals(table).collect()}
    assert got == {"a": (0, 0), "b": (1, 1), "d": (0, 2), "c": (0, 3)}
