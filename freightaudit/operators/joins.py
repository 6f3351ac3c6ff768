"""Lookups as joins, safe against keys that hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 64
HOT_SHARE = 1000
SALTS = 64


def hot_keys(rows: DataFrame, key: str, min_rows: int = 100_000) -> DataFrame:
    """Values of ``key`` with at least ``min_rows`` rows and one in ``HOT_SHARE`` of all rows: at
    most ``HOT_SHARE`` values, whatever the input, so the result may be broadcast.

    Counts are exact, combined map-side, and found by all tasks.  They steer where rows go and
    never what the result is.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_rows"))
    total = counts.agg(F.sum("_rows")).scalar()
    return counts.where(
        (F.col("_rows") >= min_rows) & (F.col("_rows") * HOT_SHARE >= total)
    ).select(key)


def spread_left_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread_by: Sequence[str],
    hot: DataFrame | None = None,
) -> DataFrame:
    """``left`` LEFT JOIN ``right`` on ``key`` (``right`` holds each key once).

    Rows of hot keys are spread over ``SALTS`` tasks by a hash of ``spread_by`` and the
    matching right rows are repeated that often; all other keys are joined as usual.  Rows
    without a key are spread as well instead of meeting in one task.
    """
    marked = F.broadcast((hot_keys(left, key) if hot is None else hot).select(key).withColumn(
        "_hot", F.lit(True)
    ))
    place = F.xxhash64(*[F.col(c) for c in spread_by])
    salted_left = left.join(marked, key, "left").withColumn(
        "_salt",
        F.when(F.col(key).isNull(), place)
        .when(F.col("_hot"), F.pmod(place, F.lit(SALTS)))
        .otherwise(F.lit(0)),
    )
    copies = F.when(
        F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    ).otherwise(F.array(F.lit(0).cast("long")))
    salted_right = (
        right.join(marked, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    )
    return (
        salted_left.drop("_hot")
        .join(salted_right, [key, "_salt"], "left")
        .drop("_salt")
    )


def find_si_bl_paths(attachments: Column) -> Column:
    """First SI-named and first BL-named path as ``STRUCT<si_path, bl_path>``."""

    def first(kind: str) -> Column:
        named = F.filter(attachments, lambda path: path.rlike(rf"(?is)_{kind}\.[^.]+$"))
        return F.get(named, F.lit(0))

    return F.struct(first("SI").alias("si_path"), first("BL").alias("bl_path"))


def join_mail_docs(mails: DataFrame, facts: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds ``si`` and ``bl`` (document facts as structs) to mails with ``si_path``/``bl_path``.

    A path without a document gives NULL.  ``refs(path)`` lists all references mails make; it
    only serves to find paths that very many mails share, so pass the cheapest source of it.
    """
    fact = facts.select(
        "path", F.struct(*[c for c in facts.columns if c != "path"]).alias("fact")
    )
    hot = hot_keys(refs, "path")
    joined = mails
    for role in ("si", "bl"):
        joined = spread_left_join(
            joined,
            fact.select(F.col("path").alias(f"{role}_path"), F.col("fact").alias(role)),
            f"{role}_path",
            ["email_id"],
            hot.select(F.col("path").alias(f"{role}_path")),
        )
    return joined


def join_report(decisions: DataFrame, report: DataFrame) -> DataFrame:
    """Evidence for each decision; decisions without any keep NULLs."""
    return decisions.join(report, "email_id", "left")


def unscored_ids(decisions: DataFrame, truth: DataFrame) -> DataFrame:
    """Ids with a decision and no label."""
    return decisions.select("email_id").join(truth.select("email_id"), "email_id", "left_anti")
