"""A corpus pipeline: each stage works on all its predecessor kept, written and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freightaudit.llm import bpe, decontaminate, language, near_copies, pii
from freightaudit.sources.sinks import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Documents that go to Python at a time.  An executor's cores hold a batch each, before and behind
#: Python, outside the heap; texts may be long, so Spark's 10,000 are beyond what it has.
BATCH_ROWS = 500


def _small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have ``BATCH_ROWS`` rows at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:  # 0 and less stand for no limit
        spark.conf.set(key, BATCH_ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Profiles are learned from all documents with a language; documents that are ``und`` (no
    text, or no letter in it) are rejected, the others go on as they are."""
    _small_batches(spark)
    rows = docs.select(F.struct("*").alias("whole"), "text")
    found = language.predict(rows, language.learn(docs))
    return found.where(F.col("lang_pred") != language.UNKNOWN).select("whole.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id.  Near copies
    share four fifths of their shingles of five words.  op9's grid over fingerprints proposes pairs;
    as three bits would miss most of them, MinHash bands propose further ones."""
    _small_batches(spark)
    return near_copies.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    _small_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs, benchmark).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every identifier that is found is replaced by its kind; all documents stay."""
    _small_batches(spark)
    return pii.redact(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the digests of the ids and of what they decode to."""
    _small_batches(spark)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("byte_bpe", byte_bpe),
]

#: SQL has neither rank-order profiles nor byte-pair merges; tests/llm holds the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, one after another."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stored(docs)
    return docs
