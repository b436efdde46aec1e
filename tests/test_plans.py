"""What the physical plans look like: narrow scans, few shuffles, chunked windows."""

import re

from pyspark.sql import functions as F

from signalloom.catalog import QUERIES, views as v
from signalloom.functions import filters
from signalloom.operators import metrics as m, signals as sg
from signalloom.operators.intervals import label_windows
from signalloom.operators.ordered import matched, numbered


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(plan):
    return len(re.findall(r"Exchange hashpartitioning", plan))


def test_scans_read_only_what_is_used(spark, sf_dir):
    plan = plan_of(QUERIES["r1_confusion"](spark, sf_dir))
    assert "ReadSchema: struct<event_type:string,value:double>" in plan
    plan = plan_of(QUERIES["d3_duplicate_keys"](spark, sf_dir))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in plan


def test_filters_reach_the_scan(spark, sf_dir):
    table = v.table(spark, sf_dir, "events").where("event_type = 'error' AND value > 3")
    plan = plan_of(table.groupBy("user_id").count())
    assert "EqualTo(event_type,error)" in plan and "GreaterThan(value,3.0)" in plan


def test_a_sweep_is_one_scan_and_one_shuffle_of_counts(spark, sf_dir):
    plan = plan_of(m.threshold_sweep(v.scored(spark, sf_dir), m.threshold_grid()))
    assert plan.count("FileScan") == 1 and shuffles(plan) == 1
    assert "partial_sum" in plan


def test_a_filter_chain_is_one_shuffle(spark):
    df = spark.range(1).selectExpr("'a' AS rec", "0L AS chunk_id", "0L AS first_position", "array(1D, 2D) AS samples")
    stages = [(filters.antialias(256.0, 2), 2), (filters.notch(), 1), (filters.bandpass(), 1)]
    plan = plan_of(sg.filter_chain(df, ["rec"], stages, 65_536))
    assert shuffles(plan) == 1 and "Join" not in plan


def test_row_windows_are_cut_into_chunks(spark):
    df = spark.range(10).selectExpr("'hot' AS k", "id AS t")
    plan = plan_of(numbered(df, ["k"], ["t"], F.floor(F.col("t") / 4), "n"))
    ranked = re.findall(r"row_number\(\) windowspecdefinition\(([^)]*)\)", plan)
    assert ranked and all("_chunk_place" in spec for spec in ranked)


def test_labels_come_from_an_equi_join_that_keeps_rows_single(spark):
    w = spark.range(4).selectExpr("'s' AS subject_id", "'r' AS edf_id", "2D * id AS start_sec", "2D * id + 4 AS end_sec")
    plan = plan_of(label_windows(w, w, ["subject_id", "edf_id"], 4.0))
    assert "ExistenceJoin" in plan and "NestedLoop" not in plan


def test_chunks_are_cut_even_after_a_join_by_key(spark):
    """Without the explicit shuffle the window would run on rows gathered by ``k``."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(100).selectExpr("id % 2 AS k", "id AS t")
        joined = left.join(spark.range(2).selectExpr("id AS k", "id AS x"), "k")
        plan = plan_of(numbered(joined, ["k"], ["t"], F.floor(F.col("t") / 4), "n"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"Exchange hashpartitioning\(_chunk_place#\d+L?, \d+\), REPARTITION_BY_COL", plan)


def test_a_match_copies_nothing_and_can_be_split(spark):
    """Both sides are shuffled for the join itself, even one that is grouped by the key already."""
    left = spark.range(1000).selectExpr("if(id % 10 = 0, NULL, 'hot') AS k", "id AS t")
    table = spark.createDataFrame([("hot", 1), ("cold", 2), (None, 3)], "k string, x int")
    for how, n in (("inner", 1000), ("left", 1000), ("left_semi", 1000), ("left_anti", 0)):
        assert matched(left, table, ["k"], how).count() == n
    assert matched(left, table.where("k = 'cold'"), ["k"], "left").where("x IS NULL").count() == 1000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(matched(left, left.groupBy("k").count(), ["k"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Generate" not in plan and len(re.findall(r"hashpartitioning\(_match#\d+, \d+\), ENSURE_REQUIREMENTS", plan)) == 2


def test_the_event_report_reads_each_table_once_or_twice(spark, sf_dir):
    from signalloom.catalog import QUERIES

    for name in ("entry_subject_alarms", "r13_event_metrics", "w4_first_hit_classification"):
        plan = plan_of(QUERIES[name](spark, sf_dir))
        assert plan.count("FileScan") <= 3 and plan.count("Exchange") <= 20, name
    tracker = spark.sparkContext.statusTracker()
    jobs = len(tracker.getJobIdsForGroup())
    QUERIES["flow_frozen_report_by_subject"](spark, sf_dir)
    assert len(tracker.getJobIdsForGroup()) <= jobs + 1  # the schema of the table that it reads


def test_the_sweep_shuffles_its_stream_once_and_spreads_a_hot_recording(spark):
    from signalloom.operators import events as ev
    from signalloom.operators.intervals import time_bin
    from signalloom.operators.ordered import local_islands

    rows = spark.range(40_000).selectExpr("'s' AS subject_id", "'hot' AS edf_id", "false AS is_truth", "10.0 * id AS start_sec")
    start = F.col("start_sec")
    local = local_islands(rows, [*ev.KEYS, "is_truth"], start, start + 4, time_bin(start), {"start_sec": (F.min, "start_sec")})
    plan = plan_of(local)
    assert plan.count("Exchange") == 1 and "Join" not in plan
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r.n for r in local.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) == 8 and max(sizes) < 12_000


