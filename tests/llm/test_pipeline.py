from __future__ import annotations

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs, counts = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.dtypes == documents.dtypes, name
        counts.append(docs.count())
    assert documents.count() > counts[0] > counts[1] >= counts[2] == counts[3]
    assert docs.where("text like '%@mail%'").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages_of_odd_tables(spark):
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "a plain text of words", "en", "a", 21), (3, "a plain text of words", "en", "a", 21)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for start in (docs, docs.limit(0)):
        now = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SF)
        now.count()


def test_rows_without_or_with_repeated_ids_are_judged_one_by_one(spark):
    benchmark = max((r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), key=len)
    plain = ["wolves crossed the frozen lake before anyone in the village had woken", "seven tall ships of grain were unloaded at the southern harbour today"]
    mail = "write to quorvath@mailbox.example.org about the missing parcel of books"
    rows = [(None, plain[0]), (None, mail), (None, benchmark), (7, plain[1]), (7, mail + " again and the broken clock"), (7, benchmark), (9, plain[1])]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda frame: sorted(r.text for r in frame.collect())
    clean = stages["decontamination"](spark, docs, SF)
    assert texts(clean) == sorted(t for _, t in rows if t != benchmark)
    kept = stages["near_duplicates"](spark, clean, SF)
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(0, plain[0]), (0, mail), (7, plain[1]), (7, mail + " again and the broken clock")])
    twice = clean.union(clean)
    redacted = stages["pii"](spark, twice, SF).collect()
    assert len(redacted) == twice.count() and not any("@" in r.text for r in redacted)
    assert all(r.n_chars == len(r.text) for r in redacted) and sum(r.doc_id is None for r in redacted) == 4


def test_toxicity_judges_rows_without_an_id(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)["toxicity"]
    kept = {r.text for r in stage(spark, documents, SF).collect()}
    unnamed = documents.withColumn("doc_id", F.lit(None).cast("long"))
    both = stage(spark, documents.unionByName(unnamed), SF).where("doc_id is null")
    assert 0 < len(kept) < documents.select("text").distinct().count()
    assert {r.text for r in both.collect()} == kept


def test_columns_of_any_name_and_no_tables_left(spark):
    rows = [(i, f"some words of text number {i} sent by a{i}@mail.example.org", "en", "a", 9, "x", "y", "z", 3, 4) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, clean string, clean_id string, kept_id string, kept_row long, score long")
    for name in ("__no_text boolean", "no_text", "own", "_rest", "stage_row", "__stage_row", "key", "told", "found_row", "own_row", "a.b"):
        docs = docs.withColumn(name.split()[0], F.lit(False))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.dtypes == docs.dtypes, name
    assert now.count() > 0 and not [r for r in now.collect() if "@" in r.text]


def test_run_leaves_only_its_result(spark):
    import os

    from proseloom.sources.tables import shared_dir

    folder = f"{shared_dir(spark)}/proseloom".removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert corpus_pipeline.run(spark, SF).count() > 0
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and next(iter(left)).startswith("stage-packing")
