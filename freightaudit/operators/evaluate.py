"""Scoring decisions against labels, and monitoring aggregates.

Labels and decisions meet in one join by mail id; every score is then an aggregate over the
joined rows that combines map-side down to a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freightaudit import dims


def _no_fields() -> Column:
    return F.array().cast("array<string>")


def _dimension(spark: SparkSession, values: list[str], name: str) -> DataFrame:
    rows = F.posexplode(F.array(*[F.lit(v) for v in values])).alias(f"{name}_ord", name)
    return spark.range(1).select(rows)


def _ratio(top: Column, bottom: Column) -> Column:
    """0 where nothing is to divide by."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(F.try_divide(top, bottom))


def prf(tp: Column, fp: Column, fn: Column) -> Column:
    """Precision, recall and F1 with 0 for an empty denominator."""
    precision = _ratio(tp, tp + fp)
    recall = _ratio(tp, tp + fn)
    return F.struct(
        precision.alias("precision"),
        recall.alias("recall"),
        _ratio(precision * recall * 2.0, precision + recall).alias("f1"),
    )


def _prediction(submission: DataFrame) -> DataFrame:
    decided = (
        F.col("decided_by") if "decided_by" in submission.columns else F.lit(None).cast("string")
    )
    return submission.select(
        "email_id",
        F.col("category").alias("p_category"),
        F.col("status").alias("p_status"),
        F.coalesce("has_defect", F.lit(False)).alias("p_has_defect"),
        F.coalesce("defect_fields", _no_fields()).alias("p_fields"),
        decided.alias("p_decided_by"),
    )


def _gold(truth: DataFrame) -> DataFrame:
    return truth.select(
        "email_id",
        F.col("category").alias("t_category"),
        F.col("status").alias("t_status"),
        F.col("review_reason").alias("t_reason"),
        F.coalesce("has_defect", F.lit(False)).alias("t_has_defect"),
        F.coalesce("defect_fields", _no_fields()).alias("t_fields"),
    )


def join_truth_outer(truth: DataFrame, submission: DataFrame) -> DataFrame:
    """Every label with its decision; a missing decision counts as GENERAL without defects."""
    return (
        _gold(truth)
        .join(_prediction(submission), "email_id", "left")
        .withColumns(
            {
                "p_category": F.coalesce("p_category", F.lit("GENERAL")),
                "p_has_defect": F.coalesce("p_has_defect", F.lit(False)),
                "p_fields": F.coalesce("p_fields", _no_fields()),
            }
        )
    )


def join_truth_inner(truth: DataFrame, submission: DataFrame) -> DataFrame:
    """Only mails that have both a label and a decision."""
    return _gold(truth).join(_prediction(submission), "email_id", "inner")


def confusion(scored: DataFrame) -> DataFrame:
    """Label x decision counts over the five categories, zeros included."""
    counts = (
        scored.groupBy(F.col("t_category").alias("actual"))
        .pivot("p_category", dims.CATEGORIES)
        .count()
    )
    actual = _dimension(scored.sparkSession, dims.CATEGORIES, "actual")
    return (
        actual.join(counts, "actual", "left")
        .fillna(0, dims.CATEGORIES)
        .select("actual", *dims.CATEGORIES)
    )


def per_category_counts(scored: DataFrame) -> DataFrame:
    """tp, fp, fn per category; a prediction outside the five adds no fp."""
    hit = F.col("t_category") == F.col("p_category")
    sides = F.array(
        F.struct(
            F.col("t_category").alias("category"),
            hit.cast("long").alias("tp"),
            F.lit(0).cast("long").alias("fp"),
            (~hit).cast("long").alias("fn"),
        ),
        F.struct(
            F.col("p_category").alias("category"),
            F.lit(0).cast("long").alias("tp"),
            (~hit).cast("long").alias("fp"),
            F.lit(0).cast("long").alias("fn"),
        ),
    )
    counts = (
        scored.select(F.explode(sides).alias("s"))
        .select("s.*")
        .groupBy("category")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    )
    known = _dimension(scored.sparkSession, dims.CATEGORIES, "category")
    return (
        known.join(counts, "category", "left")
        .fillna(0, ["tp", "fp", "fn"])
        .select("category", "category_ord", "tp", "fp", "fn")
    )


def category_report(scored: DataFrame) -> DataFrame:
    """Precision, recall, F1 (three digits) and support per category."""
    rates = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return per_category_counts(scored).select(
        "category",
        F.round(rates["precision"], 3).alias("precision"),
        F.round(rates["recall"], 3).alias("recall"),
        F.round(rates["f1"], 3).alias("f1"),
        (F.col("tp") + F.col("fn")).alias("support"),
    )


def rule_share_of(decided_by: Column) -> Column:
    """Share decided by rule among the rows that say how they were decided (else NULL)."""
    return F.avg(F.when(decided_by.isNotNull(), (decided_by == "rule").cast("double")))


def rule_share(scored: DataFrame) -> DataFrame:
    return scored.agg(rule_share_of(F.col("p_decided_by")).alias("rule_share"))


def _stage1_aggregates() -> list[Column]:
    hit = F.col("t_category") == F.col("p_category")
    aggregates = [
        F.count("*").alias("n_emails"),
        F.count_if(hit).alias("hits"),
        rule_share_of(F.col("p_decided_by")).alias("rule_share"),
    ]
    for i, c in enumerate(dims.CATEGORIES):
        aggregates += [
            F.count_if(hit & (F.col("t_category") == c)).alias(f"tp{i}"),
            F.count_if(~hit & (F.col("p_category") == c)).alias(f"fp{i}"),
            F.count_if(~hit & (F.col("t_category") == c)).alias(f"fn{i}"),
        ]
    return aggregates


def _stage3_aggregates() -> list[Column]:
    comparable = (F.col("t_category") == "BL_COMPARISON") & ~F.col("t_status").eqNullSafe(
        "NEEDS_REVIEW"
    )
    routed = F.col("p_category") == "BL_COMPARISON"
    flagged = routed & F.col("p_has_defect")
    gold = F.array_distinct("t_fields")
    found = F.when(routed, F.array_distinct("p_fields")).otherwise(_no_fields())
    both = F.size(F.array_intersect(gold, found))
    return [
        F.count_if(comparable).alias("doc_total"),
        F.count_if(comparable & F.col("t_has_defect") & flagged).alias("d_tp"),
        F.count_if(comparable & ~F.col("t_has_defect") & flagged).alias("d_fp"),
        F.count_if(comparable & F.col("t_has_defect") & ~flagged).alias("d_fn"),
        F.coalesce(F.sum(F.when(comparable, both)), F.lit(0)).alias("f_tp"),
        F.coalesce(F.sum(F.when(comparable, F.size(found) - both)), F.lit(0)).alias("f_fp"),
        F.coalesce(F.sum(F.when(comparable, F.size(gold) - both)), F.lit(0)).alias("f_fn"),
        F.count_if(
            comparable & (F.array_sort(gold) == F.array_sort(found))
        ).alias("exact"),
    ]


def _reliability_aggregates() -> list[Column]:
    gold = F.coalesce(F.col("t_status") == "NEEDS_REVIEW", F.lit(False))
    flagged = F.coalesce(F.col("p_status") == "NEEDS_REVIEW", F.lit(False))
    return [
        F.count_if(gold).alias("gold_review"),
        F.count_if(flagged).alias("pred_review"),
        F.count_if(gold & flagged).alias("both_review"),
    ]


def _end_to_end_aggregates() -> list[Column]:
    planted = (F.col("t_category") == "BL_COMPARISON") & F.col("t_has_defect")
    caught = (
        planted
        & (F.col("p_category") == "BL_COMPARISON")
        & F.col("p_has_defect")
        & (
            F.array_sort(F.array_distinct("p_fields"))
            == F.array_sort(F.array_distinct("t_fields"))
        )
    )
    return [F.count_if(planted).alias("planted"), F.count_if(caught).alias("caught")]


def _stage1_columns() -> list[Column]:
    f1 = F.lit(0.0)
    for i in range(len(dims.CATEGORIES)):
        f1 = f1 + prf(F.col(f"tp{i}"), F.col(f"fp{i}"), F.col(f"fn{i}"))["f1"]
    return [
        _ratio(F.col("hits"), F.col("n_emails")).alias("accuracy"),
        (f1 / len(dims.CATEGORIES)).alias("macro_f1"),
        F.col("rule_share"),
    ]


def _stage3_columns() -> list[Column]:
    defects = prf(F.col("d_tp"), F.col("d_fp"), F.col("d_fn"))
    fields = prf(F.col("f_tp"), F.col("f_fp"), F.col("f_fn"))
    return [
        defects["precision"].alias("defect_precision"),
        defects["recall"].alias("defect_recall"),
        defects["f1"].alias("defect_f1"),
        fields["f1"].alias("field_f1"),
        _ratio(F.col("exact"), F.col("doc_total")).alias("exact_match_rate"),
        F.col("doc_total"),
    ]


def _reliability_columns() -> list[Column]:
    recall = _ratio(F.col("both_review"), F.col("gold_review"))
    precision = _ratio(F.col("both_review"), F.col("pred_review"))
    return [
        recall.alias("escalation_recall"),
        precision.alias("escalation_precision"),
        _ratio(precision * recall * 2.0, precision + recall).alias("escalation_f1"),
        F.col("gold_review"),
        F.col("pred_review"),
    ]


def _end_to_end_columns() -> list[Column]:
    return [
        F.col("caught").alias("success"),
        F.col("planted").alias("total"),
        _ratio(F.col("caught"), F.col("planted")).alias("rate"),
    ]


def stage1_score(scored: DataFrame) -> DataFrame:
    return scored.agg(*_stage1_aggregates()).select(*_stage1_columns())


def stage3_score(scored: DataFrame) -> DataFrame:
    return scored.agg(*_stage3_aggregates()).select(*_stage3_columns())


def reliability_score(scored: DataFrame) -> DataFrame:
    return scored.agg(*_reliability_aggregates()).select(*_reliability_columns())


def end_to_end_score(scored: DataFrame) -> DataFrame:
    return scored.agg(*_end_to_end_aggregates()).select(*_end_to_end_columns())


def per_reason_caught(scored: DataFrame) -> DataFrame:
    """Labelled escalations and those caught, per review reason, zeros included."""
    caught = F.coalesce(F.col("p_status") == "NEEDS_REVIEW", F.lit(False))
    counts = (
        scored.where(F.col("t_status") == "NEEDS_REVIEW")
        .groupBy(F.col("t_reason").alias("review_reason"))
        .agg(F.count("*").alias("total"), F.count_if(caught).alias("caught"))
    )
    reasons = _dimension(scored.sparkSession, dims.REVIEW_REASONS, "review_reason")
    return (
        reasons.join(counts, "review_reason", "left")
        .fillna(0, ["total", "caught"])
        .select("review_reason", "total", "caught")
    )


def final_score(scored: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """All axes and the weighted final score, from one pass over the joined rows."""
    w = weights or dims.SCORE_WEIGHTS
    row = scored.agg(
        *_stage1_aggregates(),
        *_stage3_aggregates(),
        *_reliability_aggregates(),
        *_end_to_end_aggregates(),
    ).select(
        "n_emails",
        *_stage1_columns(),
        *_stage3_columns(),
        *_reliability_columns(),
        *_end_to_end_columns(),
    )
    return row.withColumn(
        "final_score",
        F.col("macro_f1") * w["stage1"]
        + F.col("defect_f1") * w["stage3"]
        + F.col("rate") * w["end_to_end"],
    )


def misclassified(scored: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """Mails whose category is wrong, with decision source and confidence if known."""
    wrong = scored.where(F.col("t_category") != F.col("p_category")).select(
        "email_id", F.col("t_category").alias("actual"), F.col("p_category").alias("predicted")
    )
    if report is None:
        return wrong
    kept = [c for c in ("subject", "source", "confidence") if c in report.columns]
    return wrong.join(report.select("email_id", *kept), "email_id", "left")


def accuracy_by_source(scored: DataFrame, report: DataFrame) -> DataFrame:
    """Accuracy in percent (one digit) and mails per deciding source."""
    hit = (F.col("t_category") == F.col("p_category")).cast("double")
    return (
        scored.join(report.select("email_id", "source"), "email_id", "left")
        .groupBy(F.coalesce("source", F.lit("n/a")).alias("source"))
        .agg(F.round(F.avg(hit) * 100, 1).alias("accuracy"), F.count("*").alias("emails"))
    )


def category_totals(decisions: DataFrame) -> DataFrame:
    """Decisions per category, zeros shown."""
    counts = decisions.groupBy("category").agg(F.count("*").alias("n"))
    known = _dimension(decisions.sparkSession, dims.RULE_CATEGORIES, "category")
    return known.join(counts, "category", "left").fillna(0, ["n"]).select("category", "n")


def ambiguous_total(decisions: DataFrame) -> DataFrame:
    return decisions.agg(F.count_if("ambiguous").alias("ambiguous"))


def status_totals(decisions: DataFrame) -> DataFrame:
    """Decisions per status, zeros shown."""
    counts = decisions.groupBy("status").agg(F.count("*").alias("n"))
    known = _dimension(decisions.sparkSession, dims.STATUSES, "status")
    return known.join(counts, "status", "left").fillna(0, ["n"]).select("status", "n")


def audit_kpis(decisions: DataFrame) -> DataFrame:
    """Headline counts and shares of a run."""
    total = F.count("*")

    def share(condition: Column) -> Column:
        return _ratio(F.count_if(condition), total)

    status, source = F.col("status"), F.col("source")
    local = source.isin("attachment_pair", "ml_model")
    return decisions.agg(
        total.alias("total"),
        F.count_if(status == "OK").alias("ok"),
        F.count_if(status == "MISMATCH").alias("mismatch"),
        F.count_if(status == "NEEDS_REVIEW").alias("review"),
        share(status == "OK").alias("ok_rate"),
        share(status == "MISMATCH").alias("mismatch_rate"),
        share(status == "NEEDS_REVIEW").alias("review_rate"),
        share(local).alias("local_rate"),
        F.count_if(source == "llm").alias("llm"),
    )


def distribution(decisions: DataFrame, column: str) -> DataFrame:
    """Value counts, most frequent first."""
    return (
        decisions.groupBy(column)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), column)
    )


def inbox_profile(mails: DataFrame) -> DataFrame:
    """Mails, mails with attachments, and the first of these by id."""
    attached = F.size(F.coalesce("attachments", _no_fields())) > 0
    return mails.agg(
        F.count("*").alias("mails"),
        F.count_if(attached).alias("with_attachments"),
        F.min(F.when(attached, F.col("email_id"))).alias("first_example"),
    )
