"""Human review: the override log, the queue and the log filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightaudit import dims

CONFIDENCE = "confidence_percent"


def override_log(actions: DataFrame) -> DataFrame:
    """Supervisor actions as decisions.

    ``actions(email_id, action, notes, ts)``: ``approve`` sets OK, ``escalate`` sets
    NEEDS_REVIEW; blank notes get the default text.
    """
    approve = F.col("action") == "approve"
    note = F.when(approve, F.lit(dims.APPROVE_NOTE)).otherwise(F.lit(dims.ESCALATE_NOTE))
    return actions.where(F.col("action").isin("approve", "escalate")).select(
        "email_id",
        F.when(approve, F.lit("OK")).otherwise(F.lit("NEEDS_REVIEW")).alias("status"),
        F.coalesce(F.nullif("notes", F.lit("")), note).alias("notes"),
        "ts",
    )


def latest_override(log: DataFrame) -> DataFrame:
    """The last decision per mail; combined map-side, so busy mails are no hot spot."""
    return (
        log.groupBy("email_id")
        .agg(F.max(F.struct("ts", "status", "notes")).alias("last"))
        .select("email_id", "last.status", "last.notes", "last.ts")
    )


def join_override(decisions: DataFrame, latest: DataFrame) -> DataFrame:
    """Overrides replace the status and add notes."""
    latest = latest.select(
        "email_id", F.col("status").alias("_status"), F.col("notes").alias("_notes")
    )
    return (
        decisions.join(latest, "email_id", "left")
        .withColumn("status", F.coalesce("_status", "status"))
        .withColumn("supervisor_notes", F.coalesce("_notes", F.lit("")))
        .drop("_status", "_notes")
    )


def review_queue(decisions: DataFrame, low_confidence_too: bool = False) -> DataFrame:
    """What waits for a person.  Apply after ``join_override``: decided mails leave."""
    waiting = F.col("status").isin("NEEDS_REVIEW", "MISMATCH")
    if low_confidence_too:
        waiting = waiting | (
            F.coalesce(F.col(CONFIDENCE), F.lit(100.0)) < dims.LOW_CONFIDENCE_PERCENT
        )
    return decisions.where(waiting)


def log_filter(
    decisions: DataFrame,
    categories: Sequence[str],
    statuses: Sequence[str],
    sources: Sequence[str],
) -> DataFrame:
    return decisions.where(
        F.col("category").isin(list(categories))
        & F.col("status").isin(list(statuses))
        & F.col("source").isin(list(sources))
    )


def log_search(decisions: DataFrame, query: str, regex: bool = False) -> DataFrame:
    """Case-insensitive search over id, subject, category and defect fields.

    The query is plain text; ``regex`` reads it as a pattern instead.
    """
    if not query:
        return decisions
    defects = F.coalesce(F.nullif(F.array_join("defect_fields", ", "), F.lit("")), F.lit("None"))
    hit = F.lit(False)
    for value in (F.col("email_id"), F.col("subject"), F.col("category"), defects):
        low = F.lower(F.coalesce(value, F.lit("")))
        hit = hit | (low.rlike(query.lower()) if regex else low.contains(query.lower()))
    return decisions.where(hit)


def low_confidence(decisions: DataFrame) -> DataFrame:
    """Fallback or unsure decisions; an unknown confidence counts as sure."""
    return decisions.where(
        F.col("source").isin("keyword_fallback", "llm")
        | (F.coalesce(F.col(CONFIDENCE), F.lit(100.0)) < dims.LOW_CONFIDENCE_PERCENT)
    )


def diff_scope(decisions: DataFrame, scope: str = "mismatches") -> DataFrame:
    """``mismatches`` (and escalations), ``comparisons``, or ``all``."""
    if scope == "mismatches":
        return decisions.where(F.col("status").isin("MISMATCH", "NEEDS_REVIEW"))
    if scope == "comparisons":
        return decisions.where(F.col("category") == "BL_COMPARISON")
    if scope == "all":
        return decisions
    raise ValueError(f"unknown scope: {scope}")
