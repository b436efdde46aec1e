"""Sources, sinks and text (S1-S16, P12, J5-J7) on the given tables.

Inputs are first written to the shared scratch folder from the given tables and
then read back with the reader under test.
"""

from pyspark.sql import functions as F

from signalloom.catalog import views as v
from signalloom.catalog.core import VIEWS, query
from signalloom.functions.scalars import clock_seconds, normalized_filename
from signalloom.operators import montage as mo
from signalloom.operators.events import recordings_of
from signalloom.operators.sequences import sequences
from signalloom.plans.event_report import event_report
from signalloom.session import scratch_dir
from signalloom.sources import notes, tables
from signalloom.sources.recordings import read_or_reject

REC = ["subject_id", "edf_id"]
KEY = ["subject_id", "edf_id", "window_index"]


def metadata(spark, d):
    return v.windows(spark, d).select(
        "dataset_id", *KEY, "start_sec", "end_sec", F.col("label").cast("int").alias("label"),
        F.lit(128.0).alias("sampling_rate"), F.lit(23).alias("n_channels"), F.lit(512).alias("n_samples"),
    )


META = "subject_id edf_id window_index:l start_sec:6 end_sec:6 label:l"


@query("s1_read_window_metadata", META, "SELECT subject_id, edf_id, window_index, start_sec, end_sec, label FROM v_win")
def s1(spark, d):
    path = scratch_dir(spark, "metadata")
    metadata(spark, d).write.option("header", True).csv(path)
    return tables.read_window_metadata(spark, path)


VIEWS["v_note_true"] = "SELECT subject_id, edf_id, start_sec, end_sec FROM v_true"


def notes_text(spark, d):
    """A summary section per true event: the first plain, the later ones numbered."""
    event = F.col("true_event_id")
    number = F.when(event == 0, "").otherwise(F.concat(F.lit(" "), (event + 1).cast("string")))

    def line(what, value):
        seconds = F.col(value).cast("long").cast("string")
        return F.concat(F.lit("Seizure"), number, F.lit(f" {what} Time: "), seconds, F.lit(" seconds\n"))

    section = F.concat(
        F.lit("File Name: "), "edf_id", F.lit(".edf\n"), line("Start", "start_sec"), line("End", "end_sec")
    )
    return v.truth(spark, d).select("subject_id", section.alias("value"))


def written_notes(spark, d):
    path = scratch_dir(spark, "notes")
    notes_text(spark, d).write.partitionBy("subject_id").text(path)
    return path


@query("s2_read_annotations", "subject_id edf_id start_sec:6 end_sec:6", "SELECT * FROM v_note_true")
def s2(spark, d):
    sections = notes.read_annotations(spark, written_notes(spark, d))
    return notes.annotations_of(sections, recordings_of(v.scored(spark, d)))


# One block per event: patient and record from the user, times from the clock.
VIEWS["v_block"] = """
SELECT 'PN' || lpad(CAST(user_id % 15 AS VARCHAR), 2, '0') AS patient,
  CASE WHEN value < 5 THEN NULL WHEN value < 20 THEN 'pn' || lpad(CAST(user_id % 15 AS VARCHAR), 2, '0') || '-' || user_id || '.EDF'
    ELSE 'PN' || lpad(CAST(user_id % 15 AS VARCHAR), 2, '0') || '-' || user_id || '.edf' END AS filename,
  strftime(ts, '%H.%M.%S') AS start_time,
  CASE WHEN value > 100 THEN '24.00.00' ELSE strftime(ts + INTERVAL 1 MINUTE, '%H:%M:%S') END AS end_time
FROM events"""


def blocks(spark, d):
    user = F.col("user_id")
    number = F.lpad((user % 15).cast("string"), 2, "0")
    ts = F.col("ts").cast("timestamp")
    return (
        v.table(spark, d, "events")
        .select(
            F.concat(F.lit("PN"), number).alias("patient"),
            F.when(F.col("value") < 5, None)
            .when(F.col("value") < 20, F.concat(F.lit("pn"), number, F.lit("-"), user, F.lit(".EDF")))
            .otherwise(F.concat(F.lit("PN"), number, F.lit("-"), user, F.lit(".edf")))
            .alias("filename"),
            F.date_format(ts, "HH.mm.ss").alias("start_time"),
            F.when(F.col("value") > 100, "24.00.00")
            .otherwise(F.date_format(ts + F.expr("INTERVAL 1 MINUTE"), "HH:mm:ss"))
            .alias("end_time"),
            "event_id",
        )
    )


def written_lists(spark, d):
    """One list for each patient, headed by its name."""
    rows = blocks(spark, d).select(
        "patient",
        F.col("patient").alias("folder"),
        "event_id",
        F.concat(
            F.lit("Seizure n "), F.col("event_id").cast("string"),
            F.coalesce(F.concat(F.lit("\nFile name: "), F.col("filename")), F.lit("")),
            F.lit("\nStart time: "), "start_time", F.lit("\nSeizure end time: "), "end_time", F.lit("\n"),
        ).alias("value"),
    )
    heads = rows.select("patient", "folder").distinct().select(
        "patient", "folder", F.lit(-1).cast("long").alias("event_id"),
        F.concat(F.col("patient"), F.lit("\nseizure list\n")).alias("value"),
    )
    path = scratch_dir(spark, "lists")
    (
        rows.unionByName(heads).repartition("folder").sortWithinPartitions("folder", "event_id")
        .select("folder", "value").write.partitionBy("folder").text(path)
    )
    return path


BLOCK = "patient filename start_time end_time start_seconds:l end_seconds:l"
SECONDS_SQL = """SELECT *, CAST(start_time[1:2] AS BIGINT) * 3600 + CAST(start_time[4:5] AS BIGINT) * 60 + CAST(start_time[7:8] AS BIGINT)
    AS start_seconds, CASE WHEN end_time[1:2] <> '24' THEN CAST(end_time[1:2] AS BIGINT) * 3600 + CAST(end_time[4:5] AS BIGINT) * 60
    + CAST(end_time[7:8] AS BIGINT) END AS end_seconds FROM v_block"""


@query("s3_read_seizure_list", BLOCK, SECONDS_SQL)
def s3(spark, d):
    return notes.read_seizure_list(spark, written_lists(spark, d))


VIEWS["v_record"] = """
SELECT DISTINCT 'PN' || lpad(CAST(user_id % 15 AS VARCHAR), 2, '0') AS subject,
  'PN' || lpad(CAST(user_id % 15 AS VARCHAR), 2, '0') || '-' || user_id || '.edf' AS filename FROM events"""


def written_records(spark, d):
    number = F.lpad((F.col("user_id") % 15).cast("string"), 2, "0")
    name = F.concat(F.lit("PN"), number)
    users = v.table(spark, d, "events").select("user_id").distinct()
    lines = users.select(F.concat(name, F.lit("/"), name, F.lit("-"), F.col("user_id"), F.lit(".edf ")).alias("value"))
    noise = users.select(F.concat(F.lit("a/b/"), F.col("user_id")).alias("value"))
    blank = users.select(F.lit("  ").alias("value"))
    path = scratch_dir(spark, "records")
    lines.unionByName(noise).unionByName(blank).write.text(path)
    return path


@query("s4_read_records", "subject filename path", "SELECT subject, filename, subject || '/' || filename AS path FROM v_record")
def s4(spark, d):
    return notes.read_records(spark, written_records(spark, d))


FILLED_SQL = """SELECT b.patient, coalesce(b.filename, o.only) AS filename, b.start_time, b.end_time FROM v_block b LEFT JOIN
  (SELECT subject, min(filename) AS only FROM v_record GROUP BY subject HAVING count(*) = 1) o ON b.patient = o.subject"""


def filled(spark, d):
    return notes.with_inferred_filenames(blocks(spark, d).drop("event_id"), notes.read_records(spark, written_records(spark, d)))


@query("j7_default_filename", "patient filename start_time end_time", FILLED_SQL)
def j7(spark, d):
    return filled(spark, d)


@query(
    "j5_lookup_ignoring_case",
    "patient filename start_time record_name",
    f"""SELECT f.*, r.filename AS record_name FROM ({FILLED_SQL}) f JOIN v_record r
    ON f.patient = r.subject AND lower(f.filename) = lower(r.filename)""",
)
def j5(spark, d):
    return notes.matched_seizures(filled(spark, d), notes.read_records(spark, written_records(spark, d)))


@query(
    "j6_unmatched_seizures",
    "patient filename start_time",
    f"""SELECT * FROM ({FILLED_SQL}) f WHERE NOT EXISTS (SELECT 1 FROM v_record r
    WHERE f.patient = r.subject AND lower(f.filename) = lower(r.filename))""",
)
def j6(spark, d):
    return notes.matched_seizures(filled(spark, d), notes.read_records(spark, written_records(spark, d)), "left_anti")


@query(
    "p12_normalize_filename",
    "event_id:l name",
    """SELECT event_id, CASE WHEN user_id % 15 = 11 THEN 'PN11-1.edf' ELSE 'PN06-' || user_id || '.edf' END AS name FROM events""",
)
def p12(spark, d):
    user = F.col("user_id")
    messy = F.when(user % 15 == 11, " PN11-.edf").otherwise(F.concat(F.lit("  PNO6-"), user, F.lit(".edf ")))
    return v.table(spark, d, "events").select("event_id", normalized_filename(messy).alias("name"))


@query(
    "f_clock_seconds",
    "event_id:l seconds:l",
    """SELECT event_id, CASE WHEN hour(ts) + 1 <= 23 THEN (hour(ts) + 1) * 3600 + minute(ts) * 60 + second(ts) END AS seconds
    FROM events""",
)
def clock(spark, d):
    ts = F.col("ts").cast("timestamp")
    text = F.format_string("%d:%s", F.hour(ts) + 1, F.date_format(ts, "mm.ss"))
    return v.table(spark, d, "events").select("event_id", clock_seconds(text).alias("seconds"))


@query(
    "s5_s6_split_manifest",
    "subject_id split ordinal:l",
    "SELECT *, row_number() OVER (PARTITION BY split ORDER BY subject_id) - 1 AS ordinal FROM v_split",
)
def s56(spark, d):
    path = scratch_dir(spark, "manifest")
    tables.write_split_manifest(v.splits(spark, d), "events", path)
    return tables.read_split_manifest(spark, path)


PRED = "dataset_id subject_id edf_id window_index:l start_sec:6 end_sec:6 y_true:l y_pred:l y_prob:6"


def pred_metadata(pred):
    return pred.select("dataset_id", *KEY, "start_sec", "end_sec", F.col("y_true").alias("label"))


@query("s7_s9_window_predictions", PRED, "SELECT * FROM v_pred")
def s7(spark, d):
    pred = v.predictions(spark, d)
    path = scratch_dir(spark, "predictions")
    tables.write_window_predictions(pred_metadata(pred), pred.select(*KEY, "y_true", "y_pred", "y_prob"), path)
    return tables.load_predictions(spark, path)


@query("s8_sequence_predictions", PRED, "SELECT * FROM v_pred WHERE window_index >= 4")
def s8(spark, d):
    pred = v.predictions(spark, d)
    seqs = sequences(pred, 5, ["y_pred", "y_prob"], label="y_true")
    newest = F.element_at("steps", -1)
    scores = seqs.select(
        *REC, "start_index", F.col("target").alias("y_true"), newest["y_pred"].alias("y_pred"), newest["y_prob"].alias("y_prob")
    )
    path = scratch_dir(spark, "sequence_predictions")
    tables.write_sequence_predictions(pred_metadata(pred), scores, 5, path)
    return tables.load_predictions(spark, path)


@query(
    "k1_canonical_order",
    "position:l subject_id edf_id window_index:l",
    """SELECT row_number() OVER (ORDER BY subject_id, edf_id, start_sec, window_index) - 1 AS position, subject_id, edf_id, window_index
    FROM v_pred""",
)
def k1(spark, d):
    from signalloom.operators.ordered import global_index

    pred = v.predictions(spark, d)
    return global_index(pred, REC, ["start_sec", "window_index"], F.floor(F.col("start_sec") / 3600), "position")


@query(
    "s10_write_partitions",
    "split windows:l positives:l",
    """SELECT split, count(*) AS windows, sum(label) AS positives FROM v_win w JOIN v_split s ON w.subject_id = s.subject_id GROUP BY 1""",
)
def s10(spark, d):
    path = scratch_dir(spark, "partitions")
    tables.write_by_split(metadata(spark, d).withColumn("split", v.split_of()), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("windows"), F.sum("label").alias("positives"))


@query(
    "s11_subject_arrays",
    "subject_id windows:l positives:l total:4",
    """SELECT subject_id, count(*) AS windows, sum(CAST(label = 1 AS INTEGER)) AS positives, sum(list_sum(x)) AS total FROM v_arr GROUP BY 1""",
)
def s11(spark, d):
    path = scratch_dir(spark, "arrays")
    tables.write_subject_arrays(v.channel_windows(spark, d).drop("x"), path)
    total = F.aggregate(F.flatten("signal"), F.lit(0.0), lambda a, x: a + x)
    return spark.read.parquet(path).groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("windows"), F.sum((F.col("label") == 1).cast("int")).alias("positives"), F.sum(total).alias("total")
    )


@query(
    "s13_event_report_files",
    "classification n:l",
    "SELECT classification, count(*) AS n FROM v_match GROUP BY 1",
)
def s13(spark, d):
    path = scratch_dir(spark, "report")
    pred = v.predictions(spark, d)
    tables.write_event_report(event_report(pred, v.marks_of(pred)), path)
    return spark.read.option("header", True).csv(f"{path}/matches").groupBy("classification").agg(F.count(F.lit(1)).alias("n"))


# Montages: by the number of events a recording has the canonical order, the former
# order, or the canonical order followed by auxiliary channels.
EXTRA = ["VNS", "-", "--1", "LOC-ROC", "EKG-Ref", "PZ-OZ"]
RULES = {"s02": {"names": ["LOC-ROC"], "suffixes": []}, "s05": {"names": ["PZ-OZ"], "suffixes": ["-Ref"]}}
VIEWS["v_rec"] = """
SELECT 's' || lpad(CAST(user_id % 15 AS VARCHAR), 2, '0') AS subject_id, 'r' || user_id AS edf_id, count(*) AS n, max(value) AS top
FROM events GROUP BY user_id"""
VIEWS["v_chan"] = f"""
SELECT subject_id, edf_id, unnest(range(len(names))) AS pos, unnest(names) AS name FROM (SELECT subject_id, edf_id,
  CASE n % 3 WHEN 0 THEN {mo.CANONICAL!r} WHEN 1 THEN {mo.FORMER!r} ELSE {mo.CANONICAL + EXTRA!r} END AS names FROM v_rec)"""
VIEWS["v_kept"] = """
SELECT subject_id, edf_id, row_number() OVER (PARTITION BY subject_id, edf_id ORDER BY pos) - 1 AS pos, name FROM v_chan
WHERE name NOT IN ('VNS', '-') AND name NOT LIKE '--%' AND NOT (subject_id = 's02' AND name = 'LOC-ROC')
  AND NOT (subject_id = 's05' AND (name = 'PZ-OZ' OR name LIKE '%-Ref'))"""
CANON_SQL = "CASE WHEN trim(name) IN ('T8-P8-0', 'T8-P8-1') THEN 'T8-P8' ELSE trim(name) END"
VIEWS["v_target"] = f"SELECT unnest(range(23)) AS pos, unnest({mo.CANONICAL!r}) AS name"


def texts(values):
    return F.array(*[F.lit(x) for x in values])


def recordings(spark, d):
    return v.events(spark, d).groupBy(*REC).agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))


def channels(spark, d):
    names = (
        F.when(F.col("n") % 3 == 0, texts(mo.CANONICAL))
        .when(F.col("n") % 3 == 1, texts(mo.FORMER))
        .otherwise(texts(mo.CANONICAL + EXTRA))
    )
    return recordings(spark, d).select(*REC, F.posexplode(names).alias("pos", "name"))


def kept(spark, d):
    return mo.drop_auxiliary(channels(spark, d), RULES)


@query("p1_drop_aux_channels", "subject_id edf_id pos:l name", "SELECT * FROM v_kept")
def p1(spark, d):
    return kept(spark, d)


@query("p2_canonical_channel", "subject_id edf_id pos:l name", f"SELECT subject_id, edf_id, pos, {CANON_SQL} AS name FROM v_chan")
def p2(spark, d):
    return channels(spark, d).withColumn("name", mo.canonical_channel("name"))


@query(
    "p3_canonical_electrode",
    "subject_id electrode n:l",
    f"""SELECT subject_id, CASE e WHEN 'T3' THEN 'T7' WHEN 'T4' THEN 'T8' WHEN 'T5' THEN 'P7' WHEN 'T6' THEN 'P8' ELSE e END
      AS electrode, count(*) AS n FROM (SELECT subject_id, unnest({mo.ELECTRODES_29!r}) AS e FROM v_rec) GROUP BY 1, 2""",
)
def p3(spark, d):
    messy = F.explode(F.transform(texts(mo.ELECTRODES_29), lambda e: F.concat(F.lit(" "), F.lower(e))))
    named = recordings(spark, d).select("subject_id", messy.alias("e"))
    return named.groupBy("subject_id", mo.canonical_electrode("e").alias("electrode")).agg(F.count(F.lit(1)).alias("n"))


VIEWS["v_layout"] = f"""
SELECT subject_id, edf_id, string_agg(name, ',' ORDER BY pos) AS names, count(*) AS n,
  string_agg({CANON_SQL}, ',' ORDER BY pos) AS canon FROM v_kept GROUP BY 1, 2"""
TARGET_SQL = f"(SELECT string_agg({CANON_SQL}, ',' ORDER BY pos) FROM v_target)"


@query("p4_layout_matches", "subject_id edf_id matches:l", f"SELECT *, CAST(canon = {TARGET_SQL} AS INTEGER) AS matches FROM v_layout")
def p4(spark, d):
    return mo.with_layout_match(mo.layouts(kept(spark, d)), mo.CANONICAL)


@query(
    "p5_first_file_reference",
    "subject_id edf_id verdict",
    """SELECT subject_id, edf_id, CASE WHEN n <> first_value(n) OVER w THEN 'skip' WHEN names <> first_value(names) OVER w THEN 'warn'
      ELSE 'keep' END AS verdict FROM v_layout WINDOW w AS (PARTITION BY subject_id ORDER BY edf_id)""",
)
def p5(spark, d):
    return mo.against_first_recording(mo.layouts(kept(spark, d)))


@query(
    "p6_channel_order_diff",
    "subject_id edf_id pos:l here base",
    """SELECT subject_id, edf_id, pos, coalesce(here, '<MISSING>') AS here, coalesce(base, '<MISSING>') AS base FROM (
      SELECT r.subject_id, r.edf_id, p.pos, k.name AS here, t.name AS base FROM v_rec r, range(29) p(pos)
      LEFT JOIN v_kept k ON k.edf_id = r.edf_id AND k.pos = p.pos LEFT JOIN v_target t ON t.pos = p.pos)
    WHERE here IS DISTINCT FROM base""",
)
def p6(spark, d):
    return mo.order_differences(mo.layouts(kept(spark, d)), mo.CANONICAL)


@query(
    "p7_semantic_channel_check",
    "subject_id edf_id status",
    f"""SELECT r.subject_id, r.edf_id, CASE WHEN r.top <= 100 THEN 'FILE_MISSING' WHEN l.n <> 23 THEN 'BAD_COUNT_' || l.n
      WHEN m.wrong > 0 THEN 'MISMATCH_' || m.wrong ELSE 'PASS' END AS status
    FROM v_rec r JOIN v_layout l ON r.edf_id = l.edf_id
    JOIN (SELECT k.edf_id, count(*) FILTER (replace(replace(k.name, '-0', ''), '-1', '') <> replace(replace(t.name, '-0', ''), '-1', ''))
        AS wrong FROM v_kept k LEFT JOIN v_target t ON k.pos = t.pos GROUP BY 1) m ON r.edf_id = m.edf_id""",
)
def p7(spark, d):
    """Recordings without a value above 100 have no channel list."""
    every = recordings(spark, d)
    listed = mo.layouts(kept(spark, d)).join(every.where("top > 100").select(*REC), REC, "left_semi")
    return mo.semantic_status(every.select(*REC), listed)


ORDERS = {"former": ["a", "b", "c", "d"], "target": ["c", "a", "b", "d"]}


def ordered_windows(spark, d):
    was = F.when(F.col("label") < 5, texts(ORDERS["former"])).otherwise(texts(ORDERS["target"]))
    return v.channel_windows(spark, d).withColumn("order", was)


@query(
    "p8_permute_channels",
    "window_id:l ch:l k:l v:6",
    "SELECT window_id, CASE WHEN label >= 5 OR ch = 3 THEN ch ELSE (ch + 1) % 3 END AS ch, k, v FROM v_sample",
)
def p8(spark, d):
    fixed = mo.permute_channels(ordered_windows(spark, d), "order", ORDERS["former"], ORDERS["target"])
    rows = fixed.select("window_id", F.posexplode("signal").alias("ch", "s"))
    return rows.select("window_id", "ch", F.posexplode("s").alias("k", "v"))


@query(
    "p9_verify_permutation",
    "compared:l changed_signals:l changed_labels:l missing:l positives_before:l positives_after:l",
    """SELECT count(*) AS compared, 0 AS changed_signals, 0 AS changed_labels, 0 AS missing, sum(label) AS positives_before,
      sum(label) AS positives_after FROM v_arr""",
)
def p9(spark, d):
    """Windows in the former order must be permuted, those in the target order untouched."""
    before = ordered_windows(spark, d)
    after = mo.permute_channels(before, "order", ORDERS["former"], ORDERS["target"])
    counts = []
    for name, order in ORDERS.items():
        same = F.col("order") == texts(order)
        counts.append(
            mo.verify_permutation(before.where(same), after.join(before.where(same).select("window_id"), "window_id", "left_semi"),
                                  ["window_id"], mo.permutation(order, ORDERS["target"]))
        )
    both = counts[0].unionByName(counts[1])
    return both.agg(*[F.sum(c).alias(c) for c in both.columns])


ELECTRODE_SQL = "CASE {0} WHEN 'T3' THEN 'T7' WHEN 'T4' THEN 'T8' WHEN 'T5' THEN 'P7' WHEN 'T6' THEN 'P8' ELSE {0} END"
VIEWS["v_cover"] = f"""
SELECT edf_id, pos, montage, array_to_string(list_filter([a, b], lambda e: NOT list_contains(have, e)), ', ') AS missing FROM
  (SELECT edf_id, pos, {ELECTRODE_SQL.format("upper(split_part(name, '-', 1))")} AS a, {ELECTRODE_SQL.format("upper(split_part(name, '-', 2))")} AS b
   FROM v_kept), (SELECT '29' AS montage, list({ELECTRODE_SQL.format('e')}) AS have FROM (SELECT unnest({mo.ELECTRODES_29!r}) AS e)
   UNION ALL SELECT '19', list({ELECTRODE_SQL.format('e')}) FROM (SELECT unnest({mo.ELECTRODES_19!r}) AS e))"""


def coverage(spark, d):
    sets = [
        spark.range(1).select(F.lit(name).alias("montage"), F.explode(texts(values)).alias("electrode"))
        for name, values in (("29", mo.ELECTRODES_29), ("19", mo.ELECTRODES_19))
    ]
    return mo.bipolar_coverage(kept(spark, d).select("edf_id", "pos", "name"), sets[0].unionByName(sets[1]))


@query(
    "p10_bipolar_coverage",
    "edf_id pos:l montage status missing",
    "SELECT *, CASE WHEN missing = '' THEN 'YES' ELSE 'NO' END AS status FROM v_cover",
)
def p10(spark, d):
    return coverage(spark, d)


@query(
    "p10_coverage_summary",
    "edf_id montage reconstructable:l derivations:l coverage_pct:6",
    """SELECT edf_id, montage, count(*) FILTER (missing = '') AS reconstructable, count(*) AS derivations,
      100.0 * count(*) FILTER (missing = '') / count(*) AS coverage_pct FROM v_cover GROUP BY 1, 2""",
)
def p10_summary(spark, d):
    return mo.coverage_summary(coverage(spark, d), ["edf_id", "montage"])


@query(
    "s14_quarantine",
    "subject_id edf_id reason",
    f"""SELECT subject_id, edf_id, CASE WHEN n <> 23 THEN 'channel count ' || n ELSE 'channel layout' END AS reason
    FROM v_layout WHERE canon <> {TARGET_SQL}""",
)
def s14(spark, d):
    _, rejected = mo.quarantine(mo.layouts(kept(spark, d)))
    return rejected


def decode_values(path, content):
    """One number a line, the last line ``end``; anything else is a broken file."""
    *lines, last = content.decode().split()
    if last != "end":
        raise ValueError("the file ends early")
    for line in lines:
        yield {"v": float(line)}


@query(
    "s14_unreadable_recordings",
    "subject_id samples:l total:4 rejected:l",
    """SELECT subject_id, CASE WHEN subject_id = 's03' THEN 0 ELSE count(*) END AS samples, CASE WHEN subject_id <> 's03' THEN sum(v) END AS total,
      CAST(subject_id = 's03' AS INTEGER) AS rejected FROM v_signal GROUP BY subject_id""",
)
def s14_files(spark, d):
    """A file for each subject's values; that of one subject lacks its end."""
    path = scratch_dir(spark, "files")
    rows = v.events(spark, d).select("subject_id", F.col("v").cast("string").alias("line"), F.lit(0).alias("last"))
    ends = rows.select("subject_id").distinct().where("subject_id <> 's03'").select("subject_id", F.lit("end").alias("line"), F.lit(1).alias("last"))
    # a file is written by one task, its end last
    dealt = rows.unionByName(ends).repartition("subject_id").sortWithinPartitions("subject_id", "last")
    dealt.select("subject_id", "line").write.partitionBy("subject_id").text(path)
    good, rejects = read_or_reject(spark, path, decode_values, "v double")
    subject = lambda file: F.regexp_extract(file, "subject_id=([^/]+)", 1)
    kept = good.groupBy(subject("file").alias("subject_id")).agg(F.count(F.lit(1)).alias("samples"), F.sum("v").alias("total"))
    lost = rejects.groupBy(subject("file").alias("subject_id")).agg(F.lit(1).alias("rejected"))
    both = kept.join(lost, "subject_id", "full_outer")
    return both.select("subject_id", F.coalesce("samples", F.lit(0)).alias("samples"), "total", F.coalesce("rejected", F.lit(0)).alias("rejected"))


KIND_SQL = """CASE WHEN name LIKE 'EKG%' THEN 'ecg' WHEN name LIKE 'LOC%' THEN 'eog' WHEN name IN ('VNS', '-', '--1') THEN 'misc' ELSE 'eeg' END"""


@query(
    "s15_recording_inventory",
    "subject_id edf_id sampling_rate:6 channels:l duration_min:6 eeg_channels:l eog_channels:l ecg_channels:l misc_channels:l annotations:l",
    f"""SELECT c.*, r.n / 128.0 / 60 AS duration_min, coalesce(t.annotations, 0) AS annotations FROM (SELECT subject_id, edf_id,
      128.0 AS sampling_rate, count(*) AS channels, count(*) FILTER ({KIND_SQL} = 'eeg') AS eeg_channels, count(*) FILTER
      ({KIND_SQL} = 'eog') AS eog_channels, count(*) FILTER ({KIND_SQL} = 'ecg') AS ecg_channels, count(*) FILTER ({KIND_SQL} = 'misc')
      AS misc_channels FROM v_chan GROUP BY 1, 2) c JOIN v_rec r ON c.edf_id = r.edf_id
    LEFT JOIN (SELECT edf_id, count(*) AS annotations FROM v_true GROUP BY 1) t ON c.edf_id = t.edf_id""",
)
def s15(spark, d):
    name = F.col("name")
    kind = (
        F.when(name.startswith("EKG"), "ecg").when(name.startswith("LOC"), "eog")
        .when(name.isin("VNS", "-", "--1"), "misc").otherwise("eeg")
    )
    lengths = recordings(spark, d).select(*REC, (F.col("n") / 128.0).alias("duration_sec"))
    headers = channels(spark, d).join(lengths, REC).select(
        "*", kind.alias("channel_type"), F.lit(128.0).alias("sampling_rate")
    )
    return mo.inventory(headers, v.truth(spark, d))


@query(
    "s16_score_sink",
    "model split n:l positives:l mean_prob:6",
    """SELECT 'value' AS model, split, count(*) AS n, sum(y_true) AS positives, avg(1 / (1 + exp(-(y_prob * 10 - 1)))) AS mean_prob
    FROM v_scored p JOIN v_split s ON p.subject_id = s.subject_id GROUP BY 2""",
)
def s16(spark, d):
    from signalloom.functions.scalars import sigmoid

    path = scratch_dir(spark, "scores")
    logit = F.col("y_prob") * 10 - 1
    rows = v.scored(spark, d).select(
        "subject_id", "y_true", logit.cast("float").alias("logit"), sigmoid(logit).alias("y_prob"),
        F.lit("value").alias("model"), v.split_of().alias("split"),
    )
    tables.write_scores(rows, path)
    return spark.read.parquet(path).groupBy("model", "split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y_true").alias("positives"), F.avg("y_prob").alias("mean_prob")
    )
