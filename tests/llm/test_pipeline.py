"""The stages on whole tables, each against its operator's decisions."""

from __future__ import annotations

import corpus_pipeline
from evalspark.llm import contamination, near, outliers, personal, pieces
from evalspark.llm.common import table

FOLDER = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def _ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_take_effect(spark):
    docs = table(spark, FOLDER, "documents")
    kept = STAGES["quality_rules"](spark, docs, FOLDER)
    assert _ids(kept) == _ids(outliers.quality(docs).filter("kept")) and kept.columns == docs.columns
    single = STAGES["near_duplicates"](spark, kept, FOLDER)
    groups = near.similar_groups(kept).collect()
    assert _ids(single) == {r.class_id for r in groups} and single.columns == docs.columns
    clean = STAGES["decontamination"](spark, single, FOLDER)
    found = contamination.contaminated(single, table(spark, FOLDER, "benchmark"))
    assert _ids(clean) == _ids(found.filter("not contaminated")) and clean.columns == docs.columns
    masked = STAGES["personal_data"](spark, clean, FOLDER)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert {r.doc_id: r.text for r in masked.collect()} == {i: personal.redacted(t) for i, t in texts.items()}
    assert masked.columns == docs.columns
    coded = STAGES["tokenization"](spark, masked, FOLDER)
    decoder = pieces.Decoder(pieces.Pieces.load(pieces.MODEL))
    for row in coded.collect():
        assert decoder.decode(row["ids"]) == row.text == personal.redacted(texts[row.doc_id])


def test_run_equals_the_stages(spark):
    result = corpus_pipeline.run(spark, FOLDER)
    docs = table(spark, FOLDER, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert sorted(result.collect()) == sorted(docs.collect()) and result.count() > 50


def test_empty_tables(spark):
    docs = table(spark, FOLDER, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0
