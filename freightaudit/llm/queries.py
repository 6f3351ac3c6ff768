"""The corpus operators applied to the whole test tables, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freightaudit.llm import (
    alignment,
    bpe,
    checks,
    decontaminate,
    fingerprints,
    language,
    pii,
    quality,
    repeats,
    simhash,
    token_counts,
    url_filter,
    variants,
    warc,
)

#: The end-of-document id, which the ranks leave free.
END = 50256
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_BPE, PIECE_BPE = (
    public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc_part(3) == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out.alias("held_out"), "text")
    labels = table(spark, sf_dir, "labels").where(~held_out)
    return quality.score(docs, quality.fit(docs.where("not held_out"), labels))


def op3_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared_with_next(table(spark, sf_dir, "documents"))


def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.drop("text_hash")


#: The rules of the URL query.
URL_RULES = [
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
]


def op5_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the quality label of the document that it carries, whose number stands
    in its url."""
    document = F.regexp_extract(F.coalesce("url", F.lit("")), "/([0-9]+)", 1)
    pages = table(spark, sf_dir, "pages").withColumn("_key", document.try_cast("long"))
    outcomes = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("_key"), (1 - F.col("quality")).alias("bad")
    )
    return url_filter.judge(pages, outcomes, URL_RULES)


def op6_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.make_valid_utf8(F.coalesce("html", F.lit(""))).cast("binary")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", payload.alias("payload"))
    archives = warc.write_archives(warc.plan_records(pages))
    return warc.read_archives(archives).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op7_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.document_token_counts(
        docs, bpe.read_ranks(RANKS), public_tokenizers.PATTERN, END
    )


def crc_part(parts: int):
    """crc32 of doc_id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def op8_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_part(4) == 2, F.lit(False))
    profiles = language.learn(docs.where(~held_out))
    return language.predict(
        docs.select("doc_id", held_out.alias("held_out"), "text"), profiles
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(RANKS)
    encoded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.digests(encoded, ranks)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents")).select(
        "word", "form", "root", "n", "n_near", "form_n"
    )


QUERIES: dict[str, Query] = {
    "op1_bootstrapped_pii": op1_bootstrapped_pii,
    "op2_subword_quality": op2_subword_quality,
    "op3_quartile_digest": op3_quartile_digest,
    "op4_template_decontamination": op4_template_decontamination,
    "op5_host_reputation": op5_host_reputation,
    "op6_dictionary_warc": op6_dictionary_warc,
    "op7_separator_scan": op7_separator_scan,
    "op8_rank_order_language": op8_rank_order_language,
    "op9_simhash": op9_simhash,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_token_alignment": op11_token_alignment,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op5_host_reputation": checks.HOST_REPUTATION,
    "op6_dictionary_warc": checks.DICTIONARY_WARC,
    "op12_suffix_dedup": checks.SUFFIX_DEDUP,
}
