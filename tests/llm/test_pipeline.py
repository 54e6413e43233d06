"""The stages on the smallest tables: columns, effects, and the last stage's rows."""

import corpus_pipeline
from tracewell.llm.tables import DOCUMENT, stored, table


def test_stages_keep_columns_and_follow_each_other(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(*DOCUMENT)
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"test-{name}")
        kept = [r.doc_id for r in docs.select("doc_id").collect()]
        assert docs.columns == DOCUMENT and len(set(kept)) == len(kept) and set(kept) <= ids
        ids = set(kept)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in mixed.select("doc_id").collect()} <= ids


def test_empty_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(*DOCUMENT).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
