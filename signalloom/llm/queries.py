"""One query per operator over the given tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from signalloom.llm import (
    class_lm, compression_rules, language_crf, line_quality_crf, merkle_manifest, mixing, prefix_bpe, secret_scan, simhash_groups,
    spelling_variants, token_counts, topk_search, toxicity_pu,
)
from signalloom.llm.arrow import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query
def op5_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe.encode_documents(table(spark, sf_dir, "documents"), with_ids=False)


@query
def op6_compression_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_rules.quality_rules(table(spark, sf_dir, "documents"))


@query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = secret_scan.train_secret_model(documents)
    return secret_scan.scan_secrets(documents, model).drop("masked")


@query
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("repeats", "part")


@query
def op10_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language_crf.train_language_model(documents, learn=fold("doc_id", 4) != 2)
    found = language_crf.identify_language(documents, model)
    return found.withColumn("held_out", fold("doc_id", 4) == 2)


@query
def op2_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 100 == 0)


ORACLES["op3_topk_search"] = """
WITH whole AS (
    SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) for x in embedding] AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = len(embedding)
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
    SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query
def op1_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 5) == 1
    return class_lm.score_texts(documents, learn=~held_out).withColumn("held_out", held_out)


@query
def op7_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, held_out = table(spark, sf_dir, "documents"), fold("doc_id", 3) == 1
    model = toxicity_pu.train_toxicity_model(documents, table(spark, sf_dir, "labels"), learn=~held_out)
    return toxicity_pu.score_toxicity(documents, model).withColumn("held_out", held_out)


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest_checks(table(spark, sf_dir, "documents"))


ORACLES["op11_merkle_manifest"] = r"""
WITH RECURSIVE crc_table AS (
    SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
               lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS steps
), marked AS (
    SELECT doc_id, source, lang, n_chars, text,
           xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
               lambda c, b: xor(c // 256, steps[CAST(xor(c, b) % 256 AS BIGINT) + 1]))) % 2 = 0 AS hit
    FROM documents, crc_table
), fields AS (
    SELECT doc_id, source,
           coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
               || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
           text, CASE WHEN hit THEN replace(text, chr(10), '') ELSE text END AS changed
    FROM marked
), leaves AS (
    SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
           sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS now,
           row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
    FROM fields
), nodes AS (
    SELECT source, 0 AS level, pos, n, leaf AS digest FROM leaves
    UNION ALL
    SELECT source, level + 1, pos // 3, CAST(ceil(n / 3) AS BIGINT), sha256(string_agg(digest, '' ORDER BY pos))
    FROM nodes WHERE n > 1 GROUP BY source, level, pos // 3, n
), subroots AS (
    SELECT source, level, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper AS (
    SELECT 0 AS level, pos, n, digest FROM subroots
    UNION ALL
    SELECT level + 1, pos // 3, CAST(ceil(n / 3) AS BIGINT), sha256(string_agg(digest, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY level, pos // 3, n
), runs AS (
    SELECT source, level, pos // 3 AS run, list(digest ORDER BY pos) AS held FROM nodes WHERE n > 1 GROUP BY ALL
), upper_runs AS (
    SELECT level, pos // 3 AS run, list(digest ORDER BY pos) AS held FROM upper WHERE n > 1 GROUP BY ALL
), walk AS (
    SELECT l.doc_id, l.source, 0 AS level, l.pos, l.now AS folded, '' AS others, s.level AS last, s.digest AS subroot, s.pos AS s_pos, l.leaf
    FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source
    UNION ALL
    SELECT w.doc_id, w.source, w.level + 1, w.pos // 3,
           sha256(array_to_string(list_transform(r.held, lambda h, i: CASE WHEN i = w.pos % 3 + 1 THEN w.folded ELSE h END), '')),
           w.others || array_to_string(list_filter(r.held, lambda h, i: i <> w.pos % 3 + 1), ''), w.last, w.subroot, w.s_pos, w.leaf
    FROM walk w JOIN runs r ON r.source IS NOT DISTINCT FROM w.source AND r.level = w.level AND r.run = w.pos // 3
), above AS (
    SELECT doc_id, 0 AS level, s_pos AS pos, folded, others, subroot, leaf FROM walk WHERE level = last
    UNION ALL
    SELECT w.doc_id, w.level + 1, w.pos // 3,
           sha256(array_to_string(list_transform(r.held, lambda h, i: CASE WHEN i = w.pos % 3 + 1 THEN w.folded ELSE h END), '')),
           w.others || array_to_string(list_filter(r.held, lambda h, i: i <> w.pos % 3 + 1), ''), w.subroot, w.leaf
    FROM above w JOIN upper_runs r ON r.level = w.level AND r.run = w.pos // 3
)
SELECT w.doc_id, w.leaf, w.subroot, u.digest AS root, sha256(w.others) AS proof_sha256, w.folded AS folded_root, w.folded = u.digest AS verified
FROM above w JOIN upper u ON u.n = 1 AND w.level = u.level
"""


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(spelling_variants.count_words(table(spark, sf_dir, "documents")))


ORACLES["op12_spelling_variants"] = r"""
WITH RECURSIVE crc_table AS (
    SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
               lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS steps
), runs AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
    WHERE length(run) >= 5 GROUP BY ALL
), marked AS (
    SELECT run, c, hex(encode(doc_id || ':' || run)) AS code FROM runs
), summed AS (
    SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, length(code) // 2),
               lambda i: CAST(strpos('123456789ABCDEF', substr(code, 2 * i + 1, 1)) * 16 + strpos('123456789ABCDEF', substr(code, 2 * i + 2, 1)) AS BIGINT))),
               lambda h, b: xor(h // 256, steps[CAST(xor(h, b) % 256 AS BIGINT) + 1]))) AS mark
    FROM marked, crc_table
), words AS (
    SELECT word, CAST(sum(c) AS BIGINT) AS n
    FROM (SELECT CASE WHEN mark % 97 = 0 THEN substr(run, 1, CAST(mark % length(run) AS BIGINT)) || substr(run, CAST(mark % length(run) AS BIGINT) + 2) ELSE run END AS word, c FROM summed)
    WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), places AS (
    SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), holes AS (
    SELECT word, n, i, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS hole FROM places
), less AS (
    SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS lesser FROM places
), near AS (
    SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
    UNION ALL
    SELECT l.word, w.word, w.n FROM less l JOIN words w ON w.word = l.lesser
    UNION ALL
    SELECT w.word, l.word, l.n FROM less l JOIN words w ON w.word = l.lesser
), best AS (
    SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word
), forms AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 2 * w.n THEN b.other END AS form,
           CASE WHEN b.other_n >= 2 * w.n THEN b.other_n END AS form_n
    FROM words w LEFT JOIN best b ON b.word = w.word
), walk AS (
    SELECT word, word AS at_word FROM forms
    UNION ALL
    SELECT k.word, f.form FROM walk k JOIN forms f ON f.word = k.at_word WHERE f.form IS NOT NULL
), roots AS (
    SELECT k.word, k.at_word AS root FROM walk k JOIN forms f ON f.word = k.at_word WHERE f.form IS NULL
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN roots r ON r.word = f.word
"""


@query
def op13_line_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, held_out = table(spark, sf_dir, "documents"), fold("doc_id", 5) == 0
    model = line_quality_crf.train_line_model(documents, table(spark, sf_dir, "labels"), learn=~held_out)
    return line_quality_crf.score_lines(documents, model).withColumn("held_out", held_out)
