"""Scoring, monitoring and review over labels and decisions derived from the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from freightaudit import dims
from freightaudit.bindings.registry import query
from freightaudit.bindings.views import mails, q, view
from freightaudit.operators import evaluate, joins, review, rules
from freightaudit.sources import sinks
from freightaudit.streaming import overrides

CATS = [q(c) for c in dims.CATEGORIES]
_VALUES = "(VALUES " + ", ".join(f"({c})" for c in CATS) + ") AS c(category)"
_STATUS_VALUES = "(VALUES " + ", ".join(f"({q(s)})" for s in dims.STATUSES) + ") AS c(status)"
_REASON_VALUES = (
    "(VALUES " + ", ".join(f"({q(r)})" for r in dims.REVIEW_REASONS) + ") AS c(review_reason)"
)

_JOINED = """joined AS (SELECT t.email_id, t.category AS tc, t.status AS ts, t.review_reason AS tr,
  t.has_defect AS td, t.defect_fields AS tf, coalesce(p.category, 'GENERAL') AS pc, p.status AS ps,
  coalesce(p.has_defect, FALSE) AS pd, coalesce(p.defect_fields, CAST([] AS VARCHAR[])) AS pf,
  p.decided_by AS db, p.email_id IS NOT NULL AS answered
  FROM v_truth t LEFT JOIN v_pred p ON p.email_id = t.email_id)"""
_COUNTS = f"""{_JOINED}, counts AS (SELECT category,
  count_if(tc = category AND pc = category) AS tp, count_if(tc <> category AND pc = category) AS fp,
  count_if(tc = category AND pc <> category) AS fn FROM {_VALUES}, joined GROUP BY category)"""


def ratio(top: str, bottom: str) -> str:
    return f"(CASE WHEN {bottom} = 0 THEN 0.0 ELSE CAST({top} AS DOUBLE) / ({bottom}) END)"


def f1(tp: str, fp: str, fn: str) -> str:
    p, r = ratio(tp, f"{tp} + {fp}"), ratio(tp, f"{tp} + {fn}")
    return f"(CASE WHEN {p} + {r} = 0 THEN 0.0 ELSE 2 * {p} * {r} / ({p} + {r}) END)"


def scored(spark, sf):
    return evaluate.join_truth_outer(view(spark, sf, "v_truth"), view(spark, sf, "v_pred"))


@query(
    "join_truth_outer",
    f"WITH {_JOINED} SELECT email_id, tc AS actual, pc AS predicted, pd AS has_defect FROM joined",
)
def join_truth_outer(spark, sf):
    return scored(spark, sf).select(
        "email_id",
        F.col("t_category").alias("actual"),
        F.col("p_category").alias("predicted"),
        F.col("p_has_defect").alias("has_defect"),
    )


@query(
    "join_truth_inner",
    f"WITH {_JOINED} SELECT email_id, tc AS actual, pc AS predicted FROM joined WHERE answered",
)
def join_truth_inner(spark, sf):
    both = evaluate.join_truth_inner(view(spark, sf, "v_truth"), view(spark, sf, "v_pred"))
    return both.select(
        "email_id", F.col("t_category").alias("actual"), F.col("p_category").alias("predicted")
    )


@query(
    "unscored_ids",
    """SELECT m.email_id FROM v_mail m WHERE NOT EXISTS (
      SELECT 1 FROM v_truth t WHERE t.k = m.k)""",
)
def unscored_ids(spark, sf):
    truth = view(spark, sf, "v_truth").select(
        F.expr("concat('mail_', cast(k as string))").alias("email_id")
    )
    return joins.unscored_ids(mails(spark, sf), truth)


@query(
    "prf",
    f"""WITH {_COUNTS} SELECT category, {ratio('tp', 'tp + fp')} AS precision,
      {ratio('tp', 'tp + fn')} AS recall, {f1('tp', 'fp', 'fn')} AS f1 FROM counts""",
)
def prf(spark, sf):
    counts = evaluate.per_category_counts(scored(spark, sf))
    rates = evaluate.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select("category", rates.alias("r")).select("category", "r.*")


@query(
    "confusion",
    f"""WITH {_JOINED} SELECT category AS actual, {", ".join(
        f"count_if(tc = category AND pc = {c}) AS {c[1:-1]}" for c in CATS)}
    FROM {_VALUES}, joined GROUP BY category""",
)
def confusion(spark, sf):
    return evaluate.confusion(scored(spark, sf))


@query("per_category_counts", f"WITH {_COUNTS} SELECT category, tp, fp, fn FROM counts")
def per_category_counts(spark, sf):
    return evaluate.per_category_counts(scored(spark, sf)).drop("category_ord")


@query(
    "category_report",
    f"""WITH {_COUNTS} SELECT category, round({ratio('tp', 'tp + fp')}, 3) AS precision,
      round({ratio('tp', 'tp + fn')}, 3) AS recall, round({f1('tp', 'fp', 'fn')}, 3) AS f1,
      tp + fn AS support FROM counts""",
)
def category_report(spark, sf):
    return evaluate.category_report(scored(spark, sf))


_STAGE1 = f"""s1 AS (SELECT avg({f1('tp', 'fp', 'fn')}) AS macro_f1 FROM counts),
  a1 AS (SELECT avg(CAST(tc = pc AS INT)) AS accuracy,
    avg(CASE WHEN db IS NOT NULL THEN CAST(db = 'rule' AS INT) END) AS rule_share,
    count(*) AS n_emails FROM joined)"""


@query(
    "stage1_score",
    f"""WITH {_COUNTS}, {_STAGE1} SELECT round(accuracy, 9) AS accuracy,
      round(macro_f1, 9) AS macro_f1, round(rule_share, 9) AS rule_share FROM s1, a1""",
)
def stage1_score(spark, sf):
    row = evaluate.stage1_score(scored(spark, sf))
    return row.select(*[F.round(c, 9).alias(c) for c in row.columns])


@query(
    "rule_share",
    f"WITH {_COUNTS}, {_STAGE1} SELECT round(rule_share, 9) AS rule_share FROM a1",
)
def rule_share(spark, sf):
    return evaluate.rule_share(scored(spark, sf)).select(F.round("rule_share", 9).alias("rule_share"))


_STAGE3 = f"""m3 AS (SELECT td, pc = 'BL_COMPARISON' AND pd AS flagged, list_distinct(tf) AS g,
    CASE WHEN pc = 'BL_COMPARISON' THEN list_distinct(pf) ELSE CAST([] AS VARCHAR[]) END AS f
  FROM joined WHERE tc = 'BL_COMPARISON' AND ts <> 'NEEDS_REVIEW'), c3 AS (
  SELECT count(*) AS doc_total, count_if(td AND flagged) AS tp, count_if(NOT td AND flagged) AS fp,
    count_if(td AND NOT flagged) AS fn, sum(len(list_intersect(g, f))) AS ftp,
    sum(len(f) - len(list_intersect(g, f))) AS ffp, sum(len(g) - len(list_intersect(g, f))) AS ffn,
    count_if(list_sort(g) = list_sort(f)) AS exact FROM m3), s3 AS (
  SELECT {ratio('tp', 'tp + fp')} AS defect_precision, {ratio('tp', 'tp + fn')} AS defect_recall,
    {f1('tp', 'fp', 'fn')} AS defect_f1, {f1('ftp', 'ffp', 'ffn')} AS field_f1,
    {ratio('exact', 'doc_total')} AS exact_match_rate, doc_total FROM c3)"""
_S3 = ["defect_precision", "defect_recall", "defect_f1", "field_f1", "exact_match_rate"]


@query(
    "stage3_score",
    f"WITH {_JOINED}, {_STAGE3} SELECT {', '.join(f'round({c}, 9) AS {c}' for c in _S3)}, doc_total FROM s3",
)
def stage3_score(spark, sf):
    row = evaluate.stage3_score(scored(spark, sf))
    return row.select(*[F.round(c, 9).alias(c) for c in _S3], "doc_total")


_RELIABLE = f"""cr AS (SELECT count_if(ts = 'NEEDS_REVIEW') AS gold,
    count_if(ps = 'NEEDS_REVIEW') AS pred, count_if(ts = 'NEEDS_REVIEW' AND ps = 'NEEDS_REVIEW')
    AS both_n FROM joined), rel AS (SELECT {ratio('both_n', 'gold')} AS escalation_recall,
    {ratio('both_n', 'pred')} AS escalation_precision,
    {f1('both_n', '(pred - both_n)', '(gold - both_n)')} AS escalation_f1,
    gold AS gold_review, pred AS pred_review FROM cr)"""
_REL = ["escalation_recall", "escalation_precision", "escalation_f1"]


@query(
    "reliability_score",
    f"""WITH {_JOINED}, {_RELIABLE} SELECT {', '.join(f'round({c}, 9) AS {c}' for c in _REL)},
      gold_review, pred_review FROM rel""",
)
def reliability_score(spark, sf):
    row = evaluate.reliability_score(scored(spark, sf))
    return row.select(*[F.round(c, 9).alias(c) for c in _REL], "gold_review", "pred_review")


@query(
    "per_reason_caught",
    f"""WITH {_JOINED} SELECT review_reason, count_if(ts = 'NEEDS_REVIEW' AND tr = review_reason)
      AS total, count_if(ts = 'NEEDS_REVIEW' AND tr = review_reason AND ps = 'NEEDS_REVIEW')
      AS caught FROM {_REASON_VALUES}, joined GROUP BY review_reason""",
)
def per_reason_caught(spark, sf):
    return evaluate.per_reason_caught(scored(spark, sf))


_E2E = f"""ce AS (SELECT count(*) AS total, count_if(pc = 'BL_COMPARISON' AND pd
    AND list_sort(list_distinct(pf)) = list_sort(list_distinct(tf))) AS success
  FROM joined WHERE tc = 'BL_COMPARISON' AND td), e2e AS (
  SELECT success, total, {ratio('success', 'total')} AS rate FROM ce)"""


@query(
    "end_to_end_score",
    f"WITH {_JOINED}, {_E2E} SELECT success, total, round(rate, 9) AS rate FROM e2e",
)
def end_to_end_score(spark, sf):
    row = evaluate.end_to_end_score(scored(spark, sf))
    return row.withColumn("rate", F.round("rate", 9))


@query(
    "final_score",
    f"""WITH {_COUNTS}, {_STAGE1}, {_STAGE3}, {_RELIABLE}, {_E2E}
    SELECT n_emails, round(0.3 * macro_f1 + 0.2 * defect_f1 + 0.5 * rate, 9) AS final_score,
      round(0.6 * macro_f1 + 0.4 * rate, 9) AS reweighted
    FROM s1, a1, s3, rel, e2e""",
)
def final_score(spark, sf):
    rows = scored(spark, sf)
    row = evaluate.final_score(rows)
    again = F.col("macro_f1") * 0.6 + F.col("rate") * 0.4
    return row.select(
        "n_emails", F.round("final_score", 9).alias("final_score"), F.round(again, 9).alias("reweighted")
    )


@query(
    "misclassified",
    f"""WITH {_JOINED} SELECT j.email_id, tc AS actual, pc AS predicted, p.source,
      p.confidence_percent AS confidence FROM joined j LEFT JOIN v_pred p ON p.email_id = j.email_id
    WHERE tc <> pc""",
)
def misclassified(spark, sf):
    pred = view(spark, sf, "v_pred").withColumn("confidence", F.col("confidence_percent"))
    return evaluate.misclassified(scored(spark, sf), pred.drop("subject"))


@query(
    "accuracy_by_source",
    f"""WITH {_JOINED} SELECT coalesce(p.source, 'n/a') AS source,
      round(avg(CAST(tc = pc AS INT)) * 100, 1) AS accuracy, count(*) AS emails
    FROM joined j LEFT JOIN v_pred p ON p.email_id = j.email_id GROUP BY 1""",
)
def accuracy_by_source(spark, sf):
    return evaluate.accuracy_by_source(scored(spark, sf), view(spark, sf, "v_pred"))


@query(
    "category_totals",
    f"""SELECT c.category, count(p.category) AS n FROM {_VALUES}
    LEFT JOIN v_pred p ON p.category = c.category GROUP BY c.category""",
)
def category_totals(spark, sf):
    return evaluate.category_totals(view(spark, sf, "v_pred"))


@query("ambiguous_total", "SELECT count_if(ambiguous) AS ambiguous FROM v_pred")
def ambiguous_total(spark, sf):
    return evaluate.ambiguous_total(view(spark, sf, "v_pred"))


@query(
    "status_totals",
    f"""SELECT c.status, count(p.status) AS n FROM {_STATUS_VALUES}
    LEFT JOIN v_pred p ON p.status = c.status GROUP BY c.status""",
)
def status_totals(spark, sf):
    return evaluate.status_totals(view(spark, sf, "v_pred"))


@query(
    "audit_kpis",
    """SELECT count(*) AS total, count_if(status = 'OK') AS ok, count_if(status = 'MISMATCH')
      AS mismatch, count_if(status = 'NEEDS_REVIEW') AS review,
      round(avg(CAST(status = 'OK' AS INT)), 9) AS ok_rate,
      round(avg(CAST(source IN ('attachment_pair', 'ml_model') AS INT)), 9) AS local_rate,
      count_if(source = 'llm') AS llm FROM v_pred""",
)
def audit_kpis(spark, sf):
    row = evaluate.audit_kpis(view(spark, sf, "v_pred")).drop("mismatch_rate", "review_rate")
    return row.withColumns({c: F.round(c, 9) for c in ("ok_rate", "local_rate")})


@query(
    "distribution",
    """SELECT 'category' AS what, category AS value, count(*) AS n FROM v_pred GROUP BY category
    UNION ALL SELECT 'source', source, count(*) FROM v_pred GROUP BY source""",
)
def distribution(spark, sf):
    pred = view(spark, sf, "v_pred")
    parts = [
        evaluate.distribution(pred, c).select(F.lit(c).alias("what"), F.col(c).alias("value"), "n")
        for c in ("category", "source")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "inbox_profile",
    """SELECT count(*) AS mails, count_if(len(attachments) > 0) AS with_attachments,
      min(CASE WHEN len(attachments) > 0 THEN email_id END) AS first_example FROM v_mail""",
)
def inbox_profile(spark, sf):
    return evaluate.inbox_profile(mails(spark, sf))


# ------------------------------------------------------------------------- dashboard

_LOW = "(source IN ('keyword_fallback', 'llm') OR coalesce(confidence_percent, 100) < 60)"
_SEARCHED = """(contains(lower(email_id), 'general') OR contains(lower(subject), 'general')
  OR contains(lower(category), 'general') OR contains(lower(coalesce(nullif(array_to_string(
  defect_fields, ', '), ''), 'None')), 'general'))"""


@query(
    "log_filter",
    """SELECT email_id, category, status, source FROM v_pred WHERE category IN ('SPAM', 'GENERAL',
      'BL_COMPARISON') AND status IN ('OK', 'MISMATCH') AND source IN ('llm', 'ml_model')""",
)
def log_filter(spark, sf):
    rows = review.log_filter(
        view(spark, sf, "v_pred"),
        ["SPAM", "GENERAL", "BL_COMPARISON"],
        ["OK", "MISMATCH"],
        ["llm", "ml_model"],
    )
    return rows.select("email_id", "category", "status", "source")


@query("log_search", f"SELECT email_id, category FROM v_pred WHERE {_SEARCHED}")
def log_search(spark, sf):
    return review.log_search(view(spark, sf, "v_pred"), "General").select("email_id", "category")


@query("low_confidence", f"SELECT email_id, source FROM v_pred WHERE {_LOW}")
def low_confidence(spark, sf):
    return review.low_confidence(view(spark, sf, "v_pred")).select("email_id", "source")


@query(
    "low_conf_list",
    "SELECT email_id FROM v_pred WHERE source NOT IN ('ml_model', 'attachment_pair')",
)
def low_conf_list(spark, sf):
    return rules.low_conf_list(view(spark, sf, "v_pred")).select("email_id")


@query(
    "diff_scope",
    """SELECT 'mismatches' AS scope, email_id FROM v_pred WHERE status IN ('MISMATCH', 'NEEDS_REVIEW')
    UNION ALL SELECT 'comparisons', email_id FROM v_pred WHERE category = 'BL_COMPARISON'
    UNION ALL SELECT 'all', email_id FROM v_pred""",
)
def diff_scope(spark, sf):
    pred = view(spark, sf, "v_pred")
    parts = [
        review.diff_scope(pred, s).select(F.lit(s).alias("scope"), "email_id")
        for s in ("mismatches", "comparisons", "all")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "join_report",
    """SELECT t.email_id, t.category, p.source, p.confidence_percent FROM v_truth t
    LEFT JOIN v_pred p ON p.email_id = t.email_id""",
)
def join_report(spark, sf):
    report = view(spark, sf, "v_pred").select("email_id", "source", "confidence_percent")
    return joins.join_report(view(spark, sf, "v_truth").select("email_id", "category"), report)


_LOG = f"""log AS (SELECT email_id, ts, CASE WHEN action = 'approve' THEN 'OK' ELSE 'NEEDS_REVIEW' END
    AS status, CASE WHEN notes <> '' THEN notes WHEN action = 'approve' THEN {q(dims.APPROVE_NOTE)}
    ELSE {q(dims.ESCALATE_NOTE)} END AS notes FROM v_actions WHERE action <> 'open'), latest AS (
  SELECT email_id, arg_max(status, ts) AS status, arg_max(notes, ts) AS notes FROM log
  GROUP BY email_id), shown AS (
  SELECT p.email_id, p.category, coalesce(l.status, p.status) AS status, coalesce(l.notes, '')
    AS supervisor_notes, p.confidence_percent FROM v_pred p
  LEFT JOIN latest l ON l.email_id = p.email_id)"""


def overridden(spark, sf):
    log = review.override_log(view(spark, sf, "v_actions"))
    return review.join_override(view(spark, sf, "v_pred"), review.latest_override(log))


@query("override_log", f"WITH {_LOG} SELECT email_id, epoch_us(ts) AS at, status, notes FROM log")
def override_log(spark, sf):
    log = review.override_log(view(spark, sf, "v_actions"))
    return log.select("email_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "status", "notes")


@query("latest_override", f"WITH {_LOG} SELECT email_id, status, notes FROM latest")
def latest_override(spark, sf):
    log = review.override_log(view(spark, sf, "v_actions"))
    return review.latest_override(log).drop("ts")


@query("override_snapshot", f"WITH {_LOG} SELECT email_id, status, notes FROM latest")
def override_snapshot(spark, sf):
    """The log in three batches, each folded into the snapshot of those before."""
    log = sinks.stored(review.override_log(view(spark, sf, "v_actions")))
    kept = overrides.snapshot(sinks.shared_folder(spark), log.schema)
    for number in range(3):
        batch = log.where(F.pmod(F.xxhash64("ts"), F.lit(3)) == number)
        overrides.fold_batch(batch, kept, number)
    return kept.read(spark).drop("ts")


@query("join_override", f"WITH {_LOG} SELECT email_id, status, supervisor_notes FROM shown")
def join_override(spark, sf):
    return overridden(spark, sf).select("email_id", "status", "supervisor_notes")


@query(
    "review_queue",
    f"""WITH {_LOG} SELECT email_id, category, status FROM shown
    WHERE status IN ('NEEDS_REVIEW', 'MISMATCH') OR coalesce(confidence_percent, 100) < 60""",
)
def review_queue(spark, sf):
    queue = review.review_queue(overridden(spark, sf), low_confidence_too=True)
    return queue.select("email_id", "category", "status")
