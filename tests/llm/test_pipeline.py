"""The pipeline's stages, one after another, on the smallest tables."""

from __future__ import annotations

import corpus_pipeline
from notelake.llm import decontaminate, near_duplicates, secret_scan
from notelake.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    at = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, docs, SF), f"test-{name}")
        assert after.columns == docs.columns
        at[name], docs = after, after
    assert near_duplicates.near_duplicates(at["near_duplicates"], percent=80, rows=5).filter("not kept").count() == 0
    assert decontaminate.report(at["decontamination"], table(spark, SF, "benchmark")).filter("contaminated").count() == 0
    left = secret_scan.digest(secret_scan.findings(at["secrets"]))
    assert left.filter("n_assign + n_access + n_hex > 0").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_run_gives_the_last_stage(spark):
    assert {"doc_id", "sequence_id", "offset"} <= set(corpus_pipeline.run(spark, SF).columns)
