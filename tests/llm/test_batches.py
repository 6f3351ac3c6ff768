"""Batches that go to Python are small in the pipeline, and counts do not depend on them."""

from __future__ import annotations

import pyarrow as pa
import pytest

from freightaudit.llm import language
from tests.llm import cases

import corpus_pipeline

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize(("before", "after"), [("10000", 500), ("0", 500), ("20", 20)])
def test_stages_hand_few_documents_to_python_at_a_time(spark, before, after):
    own = spark.conf.get(KEY)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(KEY, before)
            stage(spark, cases.empty(spark), "/root/testdata/sf0.001")
            assert int(spark.conf.get(KEY)) == after
    finally:
        spark.conf.set(KEY, own)


def test_counts_are_added_up_over_batches(monkeypatch):
    texts = ["plain words", "more plain words", "das Wort", "plain again", "ein Wort", "words"] * 20
    names = ["en", "en", "de", "en", "de", "en"] * 20
    whole = pa.table({"lang": names, "text": texts})

    def counted(rows: int) -> tuple[dict, int]:
        found, emitted = {}, 0
        for batch in language._counts(iter(whole.to_batches(max_chunksize=rows))):
            for row in batch.to_pylist():
                key = row["lang"], row["gram"]
                found[key] = found.get(key, 0) + row["n"]
                emitted += 1
        return found, emitted

    once = counted(len(whole))
    assert counted(3) == once and once[1] == len(once[0])
    monkeypatch.setattr(language, "HELD", 10)
    assert counted(3)[0] == once[0] and counted(3)[1] > once[1]
    assert list(language._counts(iter([]))) == []
