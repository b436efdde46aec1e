"""The pipeline's stages, each on what the one before it kept."""

from collections import Counter

import corpus_pipeline as pipeline
from pyspark.sql import functions as F
from test_llm_similar import similar_pairs

from signalloom.llm import mixing, prefix_bpe, secret_scan


def test_stages(spark, sf_dir, documents):
    docs, seen = documents, {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        seen[name] = docs
        if name != "token_ids":
            assert docs.columns == list(pipeline.COLUMNS)
    assert seen["language_id"].count() == documents.where(F.col("text").rlike(r"\p{L}")).count()
    before = sorted(seen["language_id"].collect(), key=lambda r: r.doc_id)
    kept = {r.doc_id for r in seen["near_dedup"].collect()}
    partners = similar_pairs([r.text for r in before])
    assert partners and {r.doc_id for r in before} - kept <= {before[i].doc_id for pair in partners for i in pair}
    assert len({r.text for r in before if r.doc_id in kept}) == len(kept)
    assert sum({before[a].doc_id, before[b].doc_id} <= kept for a, b in partners) <= 0.1 * len(partners)
    assert seen["secret_scan"].count() == seen["near_dedup"].count()
    assert all(not secret_scan.base_spans(r.text.replace(secret_scan.MASK, " ")) for r in seen["secret_scan"].collect())
    assert all(r.n_chars == len(r.text) for r in seen["source_mix"].collect())
    masked = {r.doc_id: r for r in seen["secret_scan"].collect()}
    size = lambda r: len((r.text or "").encode().split())
    taken, copies = Counter(), Counter()
    for r in seen["source_mix"].collect():
        assert r == masked[r.doc_id]  # whole documents only
        taken[r.source] += size(r)
        copies[r.doc_id] += 1
    assert max(copies.values()) <= 3
    targets = {r.source: r.target for r in mixing.mix(seen["secret_scan"], keep=("source",)).collect()}
    for source, target in targets.items():
        assert abs(taken[source] - target) <= max(size(r) for r in masked.values() if r.source == source) / 2 + 1
    codec = prefix_bpe.encoder()
    texts = sorted((r.doc_id, len(codec.encode(r.text)) // 4) for r in seen["source_mix"].collect())
    assert sorted((r.doc_id, len(r.ids)) for r in seen["token_ids"].collect()) == texts


def test_odd_and_empty_tables(spark, odd, empty, sf_dir):
    for docs in (odd, empty):
        lettered = {r.text for r in docs.collect() if any(map(str.isalpha, r.text or ""))}
        for name, stage in pipeline.STAGES[:3]:
            docs = stage(spark, docs, sf_dir)
        # of the rows with one text that of the least id, none without a letter
        assert sorted(r.doc_id for r in docs.collect()) == ([4, 5, 6, 8, 10, 11] if lettered else [])
        for name, stage in pipeline.STAGES[3:]:
            docs = stage(spark, docs, sf_dir)
        assert (docs.count() > 0) == bool(lettered)


def test_run_is_the_query(spark, sf_dir):
    from __spark_entry__ import queries

    out = queries()["pipeline"](spark, sf_dir)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and out.count() > 0
