"""Label decisions as DataFrame operators.

``classify_labels`` scores each *distinct* label once.  ``with_accepted_label`` decides labels
where they stand (no shuffle, no join): words of a known alias are decided by a literal
lookup; each other distinct label of a batch is decided once, and scored only if it can reach
the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightaudit import dims
from freightaudit.functions import labels as L
from freightaudit.functions.once import with_columns_once
from freightaudit.functions.pyudf import char_similarity
from freightaudit.functions.text import fold_text


def distinct_label_keys(labels: DataFrame, label: str = "label") -> DataFrame:
    """Distinct label keys; the aggregation combines map-side, so hot labels do not hurt.  Equal
    labels are folded once."""
    spelled = labels.select(F.col(label).alias("label")).distinct()
    return spelled.select(L.label_key(fold_text(F.col("label"))).alias("label_key")).distinct()


def join_label_alias(keys: DataFrame) -> DataFrame:
    """Every label key against every known alias, with the score and its parts."""
    every = F.explode(L.alias_array(L.ALIASES))
    pairs = keys.select("label_key", every.alias("known")).withColumn(
        "similarity",
        char_similarity(
            F.replace("label_key", F.lit(" "), F.lit("")),
            F.replace("known.key", F.lit(" "), F.lit("")),
        ),
    )
    return pairs.select(
        "label_key",
        L.label_profile(F.col("label_key")).alias("profile"),
        "known",
        "similarity",
    ).select(
        "label_key",
        F.col("known.field").alias("field"),
        F.col("known.field_ord").alias("field_ord"),
        F.col("known.alias").alias("alias"),
        F.col("known.alias_ord").alias("alias_ord"),
        L.score_breakdown(
            L.score_parts(F.col("profile"), F.col("known")), F.col("similarity")
        ).alias("points"),
    )


def decide_keys(keys: DataFrame) -> DataFrame:
    """Adds ``decision`` to a table of (distinct) ``label_key``, staged so that nothing is computed
    twice."""
    key = F.col("label_key")
    rows = keys.withColumns({"_profile": F.when(key.isNotNull(), L.label_profile(key))})
    rows = rows.withColumns({"_sims": L.similarities(key)})
    decision = F.when(
        key.isNotNull(),
        L.label_decision(L.field_candidates(F.col("_profile"), F.col("_sims"))),
    )
    return with_columns_once(rows, {"decision": decision}).drop("_profile", "_sims")


def classify_labels(labels: DataFrame, label: str = "label") -> DataFrame:
    """(label_key, decision) for every distinct label of a table."""
    return decide_keys(distinct_label_keys(labels, label))


def with_accepted_label(
    rows: DataFrame, keys: dict[str, str], others: dict[str, Column] | None = None
) -> DataFrame:
    """Decide label keys in place.

    ``keys`` maps a key column to an output column ``STRUCT<field, score>``; the output is NULL
    where the label is not accepted.  Words of a known alias are looked up; the UDFs of all keys
    run in one Arrow pass and get NULL for those.  ``others`` are UDF columns of the same pass.
    """
    exact = {key: L.exact_field(F.col(key)) for key in keys}
    rows = rows.withColumns(
        {f"_known_{key}": found for key, found in exact.items()}
    ).withColumns(
        {
            f"_found_{key}": L.accepted_field(F.when(F.col(f"_known_{key}").isNull(), F.col(key)))
            for key in keys
        }
        | (others or {})
    )
    accepted = {
        out: F.when(
            F.col(f"_known_{key}").isNotNull(),
            F.struct(
                F.col(f"_known_{key}").alias("field"), F.lit(dims.EXACT_SCORE).alias("score")
            ),
        ).when(F.col(f"_found_{key}.field").isNotNull(), F.col(f"_found_{key}"))
        for key, out in keys.items()
    }
    return rows.withColumns(accepted).drop(
        *[f"_{stage}_{k}" for k in keys for stage in ("known", "found")]
    )
