"""Comparison of SI and BL fields and the decision per mail."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightaudit import dims
from freightaudit.functions.once import with_columns_once
from freightaudit.functions.text import field_title, or_dash
from freightaudit.functions.values import lenient_equal
from freightaudit.operators.joins import find_si_bl_paths
from freightaudit.operators.rules import needs_attachment_review


def field_state(si: Column, bl: Column) -> Column:
    return (
        F.when(si.isNull() | bl.isNull(), F.lit("REVIEW_NEEDED"))
        .when(si == bl, F.lit("MATCHED"))
        .otherwise(F.lit("NOT_MATCHED"))
    )


def field_comparisons() -> Column:
    """One struct per field, in field order, from the document facts ``si`` and ``bl``."""
    rows = []
    for order, field in enumerate(dims.FIELDS):
        si, bl = F.col(f"si.{field}"), F.col(f"bl.{field}")
        rows.append(
            F.struct(
                F.lit(field).alias("field"),
                F.lit(order).alias("field_ord"),
                field_state(si["normalised"], bl["normalised"]).alias("result"),
                si["raw_value"].alias("si_raw"),
                bl["raw_value"].alias("bl_raw"),
                si["normalised"].alias("si_normalised"),
                bl["normalised"].alias("bl_normalised"),
                si["raw_label"].alias("si_label"),
                bl["raw_label"].alias("bl_label"),
            )
        )
    return F.array(*rows)


def compare_fields(pairs: DataFrame) -> DataFrame:
    """Adds ``comparisons`` to rows with the document facts ``si`` and ``bl``."""
    return with_columns_once(pairs, {"comparisons": field_comparisons()})


def _fields_in(comparisons: Column, state: str) -> Column:
    return F.array_compact(
        F.array(
            *[
                F.when(comparisons[i]["result"] == state, F.lit(field))
                for i, field in enumerate(dims.FIELDS)
            ]
        )
    )


def _decision(
    status: str | Column, reason: str | None, defects: Column, has_defect: bool | Column
) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_column(status).alias("status"),
        F.lit(reason).cast("string").alias("review_reason"),
        defects.alias("defect_fields"),
        as_column(has_defect).alias("has_defect"),
    )


def _no_fields() -> Column:
    return F.array().cast("array<string>")


def ok_decision() -> Column:
    return _decision("OK", None, _no_fields(), False)


def review_decision(reason: str) -> Column:
    """The constant escalated decision with its reason."""
    return _decision("NEEDS_REVIEW", reason, _no_fields(), False)


def pair_status(comparisons: Column) -> Column:
    """Decision of one compared pair: a missing value outranks a mismatch."""
    reviews = _fields_in(comparisons, "REVIEW_NEEDED")
    mismatches = _fields_in(comparisons, "NOT_MATCHED")
    return (
        F.when(F.size(reviews) > 0, review_decision("missing_value"))
        .when(F.size(mismatches) > 0, _decision("MISMATCH", None, mismatches, True))
        .otherwise(ok_decision())
    )


def with_pair_status(compared: DataFrame) -> DataFrame:
    """Adds status columns, ``review_fields`` and ``known_mismatches`` to compared pairs."""
    return compared.select(
        "*",
        pair_status(F.col("comparisons")).alias("_d"),
        _fields_in(F.col("comparisons"), "REVIEW_NEEDED").alias("review_fields"),
        _fields_in(F.col("comparisons"), "NOT_MATCHED").alias("known_mismatches"),
    ).select("*", "_d.*").drop("_d")


def readable_error(fact: Column) -> Column:
    """Read error of a joined document; a reference to no document at all is one too."""
    return F.when(fact.isNull(), F.lit("missing file")).otherwise(fact["error"])


def decide_comparison(joined: DataFrame) -> DataFrame:
    """Decision of every mail routed to comparison, constant OK for all others.

    Needs ``category``, ``subject``/``body`` test result ``asks_for_files``,
    ``attachment_count``, ``si_path``, ``bl_path``, ``si``, ``bl``.
    Checks in order: fewer than two files, no named pair, unreadable, wrong document type,
    comparison.
    """
    compared = with_columns_once(joined, {"comparisons": field_comparisons()})
    no_pair = (F.coalesce("si_path", F.lit("")) == "") | (F.coalesce("bl_path", F.lit("")) == "")
    unreadable = readable_error(F.col("si")).isNotNull() | readable_error(F.col("bl")).isNotNull()
    wrong = F.col("si.wrong_type") | F.col("bl.wrong_type")
    reaches_compare = (
        (F.col("category") == "BL_COMPARISON")
        & (F.col("attachment_count") >= 2)
        & ~no_pair
        & ~unreadable
        & ~wrong
    )
    decision = (
        F.when(F.col("category") != "BL_COMPARISON", ok_decision())
        .when(
            F.col("attachment_count") < 2,
            F.when(F.col("asks_for_files"), review_decision("missing_attachment")).otherwise(
                ok_decision()
            ),
        )
        .when(no_pair, review_decision("missing_attachment"))
        .when(unreadable, review_decision("unreadable"))
        .when(wrong, review_decision("wrong_doc_type"))
        .otherwise(pair_status(F.col("comparisons")))
    )
    decided = with_columns_once(
        compared,
        {"_d": decision, "comparisons": F.when(reaches_compare, F.col("comparisons"))},
    )
    return decided.select("*", "_d.*").drop("_d")


def mail_inputs() -> dict[str, Column]:
    """What a decision needs to know of a mail, whatever its category turns out to be."""
    attachments = F.coalesce("attachments", F.array().cast("array<string>"))
    several = F.size(attachments) >= 2
    paths = find_si_bl_paths(attachments)
    return {
        "attachment_count": F.size(attachments),
        "asks_for_files": F.when(
            ~several, needs_attachment_review(F.col("subject"), F.col("body"), attachments)
        ),
        "si_path": F.when(several, paths["si_path"]),
        "bl_path": F.when(several, paths["bl_path"]),
    }


def routed_only(classified: DataFrame) -> DataFrame:
    """The inputs of a comparison kept where the category asks for one."""
    routed = F.col("category") == "BL_COMPARISON"
    return classified.withColumns(
        {c: F.when(routed, F.col(c)) for c in ("asks_for_files", "si_path", "bl_path")}
    )


def comparison_inputs(classified: DataFrame) -> DataFrame:
    """The narrow columns a decision needs; bodies do not travel through the joins."""
    routed = F.col("category") == "BL_COMPARISON"
    inputs = mail_inputs()
    count = inputs.pop("attachment_count")
    return classified.withColumns(
        {"attachment_count": count} | {c: F.when(routed, v) for c, v in inputs.items()}
    )

def diff_frame(compared: DataFrame) -> DataFrame:
    """Seven display rows per compared mail."""
    return compared.select("email_id", F.explode("comparisons").alias("c")).select(
        "email_id",
        F.col("c.field_ord").alias("field_ord"),
        field_title(F.col("c.field")).alias("field"),
        or_dash(F.col("c.si_raw")).alias("si_value"),
        or_dash(F.col("c.bl_raw")).alias("bl_value"),
        or_dash(F.col("c.si_label")).alias("si_label"),
        or_dash(F.col("c.bl_label")).alias("bl_label"),
        F.col("c.result").alias("result"),
    )


# ------------------------------------------------------------------ tolerant comparison


def lenient_compare(fields: DataFrame) -> DataFrame:
    """Adds ``matches`` to rows ``(field, si_value, bl_value)``."""
    return fields.withColumn(
        "matches", lenient_equal(F.col("field"), F.col("si_value"), F.col("bl_value"))
    )


def lenient_case(
    pairs: DataFrame, key: Sequence[str] = ("email_id",), si: str = "si", bl: str = "bl"
) -> DataFrame:
    """Tolerant decision per pair of structs holding the seven raw values.

    Missing values ask for a person but do not stop the comparison of the others.
    """
    values = [(f, F.col(f"{si}.{f}"), F.col(f"{bl}.{f}")) for f in dims.FIELDS]
    different = F.array_compact(
        F.array(
            *[
                F.when(
                    ~lenient_equal(F.lit(f), a, b),
                    F.struct(
                        F.lit(f).alias("key"),
                        F.struct(a.alias("si"), b.alias("bl")).alias("value"),
                    ),
                )
                for f, a, b in values
            ]
        )
    )
    missing = F.array_compact(
        F.array(*[F.when(a.isNull() | b.isNull(), F.lit(f)) for f, a, b in values])
    )
    return pairs.select(
        *key,
        F.map_from_entries(different).alias("mismatches"),
        (F.size(different) > 0).alias("has_mismatch"),
        (F.size(missing) > 0).alias("needs_human_review"),
        F.when(
            F.size(missing) > 0,
            F.concat(
                F.lit("Uncertain values or missing fields: "), F.array_join(missing, ", ")
            ),
        ).alias("review_reason"),
    )

