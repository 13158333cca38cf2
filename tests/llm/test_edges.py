"""Every operator and stage on odd rows and on empty tables: defined results, no crash."""

from __future__ import annotations

import pytest

import corpus_pipeline
from quillmesh.llm import registry
from quillmesh.llm.common import table

NAMES = sorted(registry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_give_no_rows(spark, empty, name):
    assert registry.queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", [n for n in NAMES if n not in ("op3_hnsw", "op8_packing", "op10_mixing")])
def test_one_row_for_each_document(spark, odd, texts, name):
    got = registry.queries()[name](spark, odd).select("doc_id").collect()
    key = lambda i: (i is None, i or 0)
    assert sorted((r.doc_id for r in got), key=key) == sorted((i for i, _ in texts), key=key)


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_keep_the_columns_of_documents(spark, odd, empty, k):
    name, stage = corpus_pipeline.STAGES[k]
    for folder in (odd, empty):
        docs = table(spark, folder, "documents")
        out = stage(spark, docs, folder)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
        n = out.count()
        assert (n == 0) == (folder is empty)


def test_pipeline_runs(spark, odd, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
    assert corpus_pipeline.run(spark, odd).count() > 0


def test_toxic_stage_keeps_clean_rows(spark, odd, texts):
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, table(spark, odd, "documents"), odd).select("doc_id").collect()}
    clean = {i for i, t in texts if "idiot" not in (t or "")}
    assert clean <= kept
    assert not [i for i, t in texts if i is not None and i < 40 and "idiot" in (t or "") and i in kept]


def test_near_duplicate_stage_keeps_one_of_each_group(spark, odd):
    from test_shingles import kept

    docs = table(spark, odd, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, odd).collect()} == kept(rows)
