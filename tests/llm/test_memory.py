"""What workers hold: batches and buffers of bounded size, and no workers without work."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notelake.llm import decontaminate, hashing, language_id, near_duplicates, packing, secret_scan, token_counts
from notelake.llm.common import ARROW_SETTING, in_batches


@pytest.fixture
def unset(spark):
    spark.conf.unset(ARROW_SETTING)
    yield
    spark.conf.unset(ARROW_SETTING)


def sizes(parts):
    for batch in parts:
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "bytes"])


@pytest.mark.parametrize("own, most", [(None, 4 << 20), ("1m", 1 << 20)])
def test_batches_are_bounded_by_their_bytes(spark, unset, own, most):
    """By ours, or by what the session sets itself; all rows come."""
    if own:
        spark.conf.set(ARROW_SETTING, own)
    docs = spark.range(0, 5000, 1, 1).select("id", F.repeat(F.lit("x"), 3000).alias("text"))
    got = in_batches(docs, sizes, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in got) == 5000 and max(r["bytes"] for r in got) < most + 10_000


@pytest.mark.parametrize("operator", [
    language_id.accepted, language_id.identify, near_duplicates.sketches, near_duplicates.full_sets, token_counts.count_tokens, packing.pack,
    lambda docs: decontaminate.overlap(docs, docs.select(F.lit("i").alias("item_id"), "text")),
])
def test_operators_bound_their_batches(spark, unset, operator):
    operator(spark.createDataFrame([(1, "some words of a text", "en")], "doc_id long, text string, lang string"))
    assert spark.conf.get(ARROW_SETTING, None)


def test_an_empty_ledger_starts_no_python_workers(spark, tmp_path):
    ledger = secret_scan.ledger_at(spark, str(tmp_path / "none"))
    assert "ExistingRDD" not in ledger._jdf.queryExecution().toString()  # rows that Python workers would make
    assert ledger.schema == spark.createDataFrame([], secret_scan.LEDGER).schema and ledger.count() == 0


@pytest.mark.parametrize("read", [lambda texts: list(near_duplicates.shingle_sets(texts)) and None, lambda texts: token_counts.encoder(token_counts.VOCABULARY).batch(texts, want_ids=False)])
def test_buffers_of_texts_are_small(read):
    """8 MB of texts took 58 MB with buffers of a megabyte."""
    texts = [b"the quick brown fox jumps over a lazy dog " * 100] * 2000
    read(texts[:1])
    hashing._cache.clear()
    tracemalloc.start()
    read(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 25e6
