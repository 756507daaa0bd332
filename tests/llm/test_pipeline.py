"""The pipeline's stages on small documents: columns, order and effect."""

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "suffix-array dedup", "secret scans", "packing"]


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    (_, good), (_, near), (_, cut), (_, masked), (_, packed) = corpus_pipeline.STAGES
    kept = good(spark, docs, "").cache()
    assert kept.columns == columns and kept.join(docs, columns, "left_anti").isEmpty() and 0.5 < kept.count() / docs.count() <= 1
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    groups = brute.near_groups(sorted(texts.items()), 5)
    single = near(spark, kept, "").cache()
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == sorted(i for i, c in groups.items() if i == c)
    texts = {r["doc_id"]: r["text"] for r in single.collect()}
    want = brute.without_repeats(texts.items(), 250)
    less = cut(spark, single, "").cache()
    assert less.columns == columns
    for r in less.collect():
        assert r["text"] == want[r["doc_id"], texts[r["doc_id"]]][2].decode(errors="ignore") and r["n_chars"] == len(r["text"])
    clean = masked(spark, less, "").cache()
    assert clean.columns == columns and not any(brute.base_secrets(r["text"]) for r in clean.collect())
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r["doc_id"]: np.array([*library.encode(r["text"], add_special_tokens=False).ids, 1], "<u4") for r in clean.collect()}
    rows = packed(spark, clean, "").collect()
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    assert all(r["ids"] == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes() for r in rows)


def test_stages_take_empty_and_odd_documents(spark, odd, empty):
    for docs in (empty, odd.select(*empty.columns)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
            docs.count()


def test_run_equals_its_stages(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
