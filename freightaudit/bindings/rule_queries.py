"""Rule classification, cascade and the LLM tables over the derived mails."""

from __future__ import annotations

from pyspark.sql import functions as F

from freightaudit import dims
from freightaudit.bindings.registry import query
from freightaudit.bindings.text_queries import CURRENT, LIST, NORM, SHORT
from freightaudit.bindings.views import mails, q, view
from freightaudit.operators import joins, rules


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


_PREPARED = f"""prepared AS (
  SELECT email_id, subject, body, attachments,
    regexp_extract_all(lower(subject), '[a-z]+') AS sw,
    regexp_extract_all(lower(b), '[a-z]+') AS bw,
    {NORM.format('subject')} AS sn, {NORM.format('b')} AS bn
  FROM (SELECT *, {CURRENT.format('body')} AS b FROM v_mail) m)"""


def _phrase_count(text: str, category: str) -> str:
    terms = [f"CAST(contains({text}, {q(p)}) AS INT)" for p in dims.PHRASES[category]]
    return "(" + " + ".join(terms) + ")"


def _score_rows() -> str:
    rows = []
    for order, category in enumerate(dims.RULE_CATEGORIES):
        words = sql_list(dims.KEYWORDS[category])
        rows.append(
            f"{{'category': {q(category)}, 'ord': {order}, "
            f"'subject_score': 2 * len(list_intersect(sw, {words})), "
            f"'body_score': len(list_intersect(bw, {words})), "
            f"'bonus': 2 * {_phrase_count('sn', category)} + {_phrase_count('bn', category)}}}"
        )
    return "[" + ", ".join(rows) + "]"


_SCORES = f"""{_PREPARED}, scores AS (
  SELECT email_id, attachments, s.category, s.ord, s.subject_score, s.body_score, s.bonus,
    s.subject_score + s.body_score + s.bonus AS total
  FROM (SELECT email_id, attachments, unnest({_score_rows()}) AS s FROM prepared) x)"""

_RANKED = f"""{_SCORES}, ranked AS (
  SELECT email_id, any_value(attachments) AS attachments,
    CASE WHEN max(total) = 0 THEN 'GENERAL' ELSE first(category ORDER BY total DESC,
      subject_score DESC, bonus DESC, ord) END AS keyword_category
  FROM scores GROUP BY email_id), routed AS (
  SELECT *, CASE WHEN len(list_filter(attachments, lambda a: regexp_matches(a, '(?i)_SI\\.[^.]+$'))) > 0
      AND len(list_filter(attachments, lambda a: regexp_matches(a, '(?i)_BL\\.[^.]+$'))) > 0
      THEN 'BL_COMPARISON' ELSE keyword_category END AS category,
    CASE WHEN len(list_filter(attachments, lambda a: regexp_matches(a, '(?i)_SI\\.[^.]+$'))) > 0
      AND len(list_filter(attachments, lambda a: regexp_matches(a, '(?i)_BL\\.[^.]+$'))) > 0
      THEN 'si_bl_attachment_pair' ELSE 'keyword_score' END AS routing_reason FROM ranked),
  decided AS (
  SELECT r.email_id, r.keyword_category, r.category, r.routing_reason,
    max(CASE WHEN s.category = r.category THEN s.total END) AS winning,
    max(CASE WHEN s.category <> r.category THEN s.total END) AS other
  FROM routed r JOIN scores s ON s.email_id = r.email_id
  GROUP BY r.email_id, r.keyword_category, r.category, r.routing_reason)"""

_WORD_ROWS = f"""{_PREPARED}, words AS (
  SELECT email_id, 'subject' AS part, unnest(sw) AS word FROM prepared
  UNION ALL SELECT email_id, 'body', unnest(bw) FROM prepared), useful AS (
  SELECT * FROM words WHERE NOT list_contains({LIST}, word)
    AND (length(word) >= 3 OR list_contains({SHORT}, word))), dim AS (
  SELECT * FROM (VALUES """ + ", ".join(
    f"({q(c)}, {q(w)})" for c in dims.RULE_CATEGORIES for w in dims.KEYWORDS[c]
) + ") AS d(category, keyword))"


@query(
    "count_matches",
    f"""WITH {_WORD_ROWS} SELECT email_id, part, category, keyword, count(*) AS n
    FROM useful JOIN dim ON keyword = word GROUP BY email_id, part, category, keyword""",
)
def count_matches(spark, sf):
    return rules.count_matches(mails(spark, sf))


@query(
    "join_words_keywords",
    f"""WITH {_WORD_ROWS} SELECT category, keyword, count(*) AS hits,
      count(DISTINCT email_id) AS mails FROM useful JOIN dim ON keyword = word
    GROUP BY category, keyword""",
)
def join_words_keywords(spark, sf):
    matches = rules.count_matches(mails(spark, sf))
    per_mail = matches.groupBy("category", "keyword", "email_id").agg(F.sum("n").alias("n"))
    return per_mail.groupBy("category", "keyword").agg(
        F.sum("n").alias("hits"), F.count("*").alias("mails")
    )


_PHRASES = f"""WITH {_PREPARED}, texts AS (
  SELECT email_id, 'subject' AS part, sn AS text FROM prepared
  UNION ALL SELECT email_id, 'body', bn FROM prepared), dim AS (SELECT * FROM (VALUES """ + ", ".join(
    f"({q(c)}, {q(p)})" for c in dims.RULE_CATEGORIES for p in dims.PHRASES[c]
) + ") AS d(category, phrase))"


@query(
    "find_phrases",
    f"""{_PHRASES} SELECT email_id, part, category, string_agg(phrase, '|' ORDER BY phrase)
      AS phrases FROM texts JOIN dim ON contains(text, phrase)
    GROUP BY email_id, part, category""",
)
def find_phrases(spark, sf):
    found = rules.matched_phrases(mails(spark, sf))
    return found.withColumn("phrases", F.array_join("phrases", "|"))


@query(
    "join_phrases",
    f"""{_PHRASES} SELECT category, phrase, part, count(*) AS mails
    FROM texts JOIN dim ON contains(text, phrase) GROUP BY category, phrase, part""",
)
def join_phrases(spark, sf):
    found = rules.matched_phrases(mails(spark, sf))
    return (
        found.select("category", F.explode("phrases").alias("phrase"), "part")
        .groupBy("category", "phrase", "part")
        .agg(F.count("*").alias("mails"))
    )


@query(
    "score_category",
    f"""WITH {_SCORES} SELECT email_id, category, CAST(subject_score AS BIGINT) AS subject_score,
      CAST(body_score AS BIGINT) AS body_score, CAST(bonus AS BIGINT) AS bonus,
      CAST(total AS BIGINT) AS total FROM scores""",
)
def score_category(spark, sf):
    scored = rules.category_scores(mails(spark, sf))
    return scored.select("email_id", F.explode("scores").alias("s")).select(
        "email_id",
        "s.category",
        F.col("s.subject_keyword_score").cast("long").alias("subject_score"),
        F.col("s.body_keyword_score").cast("long").alias("body_score"),
        F.col("s.phrase_bonus").cast("long").alias("bonus"),
        F.col("s.total_score").cast("long").alias("total"),
    )


@query("rank_categories", f"WITH {_RANKED} SELECT email_id, keyword_category FROM ranked")
def rank_categories(spark, sf):
    return rules.classify_by_rules(mails(spark, sf)).select("email_id", "keyword_category")


@query(
    "attachment_pair_rule",
    f"WITH {_RANKED} SELECT email_id, category, routing_reason FROM routed",
)
def attachment_pair_rule(spark, sf):
    return rules.classify_by_rules(mails(spark, sf)).select(
        "email_id", F.col("rule_category").alias("category"), "routing_reason"
    )


@query(
    "classification_margin",
    f"""WITH {_RANKED} SELECT email_id, CAST(winning AS BIGINT) AS winning,
      CAST(winning - other AS BIGINT) AS margin,
      routing_reason = 'keyword_score' AND winning > 0 AND winning = other AS ambiguous
    FROM decided""",
)
def classification_margin(spark, sf):
    return rules.classify_by_rules(mails(spark, sf)).select(
        "email_id",
        F.col("winning_score").cast("long").alias("winning"),
        F.col("score_margin").cast("long").alias("margin"),
        "ambiguous",
    )


# Stage tables of the cascade, derived from the mails.
_PROBA = "CASE WHEN k % 3 = 0 THEN 0.40 ELSE 0.46 + (k % 50) / 100.0 END"
_CATEGORY = """CASE WHEN k % 10 < 4 THEN 'BL_COMPARISON' WHEN k % 10 < 6 THEN 'SI_REQUEST'
  WHEN k % 10 < 8 THEN 'INVOICE_QUERY' WHEN k % 10 = 8 THEN 'GENERAL' ELSE 'SPAM' END"""


def stage_probabilities(spark, sf):
    rows = view(spark, sf, "v_mail").select(
        "email_id", F.expr(_PROBA).cast("double").alias("p"), F.expr(_CATEGORY).alias("top")
    )
    values = [
        F.when(F.col("top") == c, F.col("p")).otherwise((1 - F.col("p")) / 4)
        for c in dims.CATEGORIES
    ]
    entries = [x for c, v in zip(dims.CATEGORIES, values) for x in (F.lit(c), v)]
    return rows.select("email_id", F.create_map(*entries).alias("probabilities"))


@query(
    "cascade",
    f"""WITH {_RANKED} SELECT d.email_id,
      CASE WHEN d.routing_reason = 'si_bl_attachment_pair' THEN 'BL_COMPARISON'
           WHEN p >= 0.45 THEN top ELSE keyword_category END AS category,
      round(CASE WHEN d.routing_reason = 'si_bl_attachment_pair' THEN 1.0 ELSE p END, 6)
        AS confidence,
      CASE WHEN d.routing_reason = 'si_bl_attachment_pair' THEN 'attachment_pair'
           WHEN p >= 0.45 THEN 'ml_model' ELSE 'keyword_fallback' END AS source
    FROM decided d JOIN (SELECT email_id, CAST({_PROBA} AS DOUBLE) AS p, {_CATEGORY} AS top
                         FROM v_mail) m ON m.email_id = d.email_id""",
)
def cascade(spark, sf):
    decided = rules.cascade(mails(spark, sf), stage_probabilities(spark, sf))
    return decided.select(
        "email_id", "category", F.round("confidence", 6).alias("confidence"), "source"
    )


_CONTENT = r"""content AS (SELECT email_id, subject, body, attachments, k,
    lower(trim(subject) || ' ' || trim(body)) AS c,
    lower(trim(subject) || ' ' || trim(body)) || ' '
      || lower(array_to_string(attachments, ''', ''')) AS f FROM v_mail)"""


def _any(text: str, markers) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(m)})" for m in markers) + ")"


_SPAM = f"({_any('c', dims.SPAM_MARKERS)} AND NOT {_any('c', dims.SHIPPING_MARKERS)})"
_SI, _BL = _any("f", dims.SI_MARKERS), _any("f", dims.BL_MARKERS)
_COMPARE = _any("f", dims.COMPARE_MARKERS)
_PRE = f"""CASE WHEN {_SPAM} THEN 'SPAM' WHEN {_COMPARE} OR ({_SI} AND {_BL}
  AND contains(f, 'draft')) THEN 'BL_COMPARISON' WHEN {_SI} AND NOT {_BL} THEN 'SI_REQUEST' END"""
_FALLBACK = f"""CASE WHEN {_COMPARE} OR ({_SI} AND {_BL}) THEN 'BL_COMPARISON'
  WHEN {_SI} OR {_any('c', dims.SI_FALLBACK_MARKERS)} THEN 'SI_REQUEST'
  WHEN {_any('lower(subject)', dims.INVOICE_SUBJECT_MARKERS)} THEN 'INVOICE_QUERY'
  ELSE 'GENERAL' END"""


@query("spam_prefilter", f"WITH {_CONTENT} SELECT email_id, {_SPAM} AS spam FROM content")
def spam_prefilter(spark, sf):
    return mails(spark, sf).select("email_id", rules.spam_prefilter().alias("spam"))


@query(
    "intent_flags",
    f"""WITH {_CONTENT} SELECT email_id, {_SI} AS has_si, {_BL} AS has_bl, {_COMPARE} AS has_compare
    FROM content""",
)
def intent_flags(spark, sf):
    flagged = mails(spark, sf).select("email_id", rules.intent_flags().alias("x"))
    return flagged.select("email_id", "x.has_si", "x.has_bl", "x.has_compare")


@query("intent_prefilter", f"WITH {_CONTENT} SELECT email_id, {_PRE} AS category FROM content")
def intent_prefilter(spark, sf):
    return mails(spark, sf).select("email_id", rules.intent_prefilter().alias("category"))


@query(
    "llm_request_rows",
    f"""WITH {_CONTENT} SELECT email_id, md5('Subject: ' || trim(subject) || chr(10)
      || 'Attachments: [' || array_to_string(list_transform(attachments, lambda a: '"' || a || '"'),
      ', ') || ']' || chr(10) || chr(10) || 'Email Body:' || chr(10) || left(trim(body), 2500))
      AS prompt FROM content WHERE {_PRE} IS NULL""",
)
def llm_request_rows(spark, sf):
    return rules.llm_request_rows(mails(spark, sf)).withColumn("prompt", F.md5("prompt"))


_ANSWER = """CASE k % 5 WHEN 0 THEN concat('{"category": " ', lower({c}), ' "}')
  WHEN 1 THEN concat('{"category": "maybe ', lower({c}), '"}') WHEN 2 THEN '{"category": "other"}'
  WHEN 3 THEN concat('{"category": "', {c}) ELSE NULL END""".replace("{c}", f"({_CATEGORY})")
_PARSED = f"CASE WHEN k % 5 IN (0, 1) THEN {_CATEGORY} END"


@query("parse_llm_category", f"SELECT email_id, {_PARSED} AS category FROM v_mail")
def parse_llm_category(spark, sf):
    return view(spark, sf, "v_mail").select(
        "email_id", rules.parse_llm_category(F.expr(_ANSWER)).alias("category")
    )


@query("llm_fallback_rules", f"WITH {_CONTENT} SELECT email_id, {_FALLBACK} AS category FROM content")
def llm_fallback_rules(spark, sf):
    return mails(spark, sf).select("email_id", rules.llm_fallback().alias("category"))


@query(
    "cascade_with_responses",
    f"""WITH {_CONTENT} SELECT email_id,
      CASE WHEN pair THEN 'BL_COMPARISON' ELSE coalesce({_PRE}, {_PARSED}, {_FALLBACK}) END
        AS category, CASE WHEN pair THEN 'attachment_pair' ELSE 'llm' END AS source
    FROM (SELECT *, len(attachments) = 2 AS pair FROM content) x""",
)
def cascade_with_responses(spark, sf):
    answers = view(spark, sf, "v_mail").select("email_id", F.expr(_ANSWER).alias("response"))
    decided = rules.cascade(mails(spark, sf), llm_responses=answers)
    return decided.select("email_id", "category", "source")


@query(
    "needs_attachment_review",
    f"""SELECT email_id, len(attachments) = 1 OR (len(attachments) = 0 AND
      {_any(NORM.format("subject || ' ' || body"), dims.ATTACHMENT_PHRASES)}) AS needed FROM v_mail""",
)
def needs_attachment_review(spark, sf):
    needed = rules.needs_attachment_review(F.col("subject"), F.col("body"), F.col("attachments"))
    return mails(spark, sf).select("email_id", needed.alias("needed"))


@query(
    "find_si_bl_paths",
    r"""SELECT email_id, list_filter(attachments, lambda a: regexp_matches(a, '(?i)_SI\.[^.]+$'))[1]
        AS si_path,
      list_filter(attachments, lambda a: regexp_matches(a, '(?i)_BL\.[^.]+$'))[1] AS bl_path
    FROM v_mail""",
)
def find_si_bl_paths(spark, sf):
    found = mails(spark, sf).select(
        "email_id", joins.find_si_bl_paths(F.col("attachments")).alias("p")
    )
    return found.select("email_id", "p.si_path", "p.bl_path")


_SHAPES = """CASE k % 3
  WHEN 0 THEN concat('{"si": "a/', CAST(k AS STRING), '", "bill_of_lading": "b/', CAST(k AS STRING), '"}')
  WHEN 1 THEN concat('[{"role": "Shipping", "path": "a/0"}, {"type": "SI", "file": "a/',
    CAST(k AS STRING), '"}, {"name": "lading", "filename": "b/', CAST(k AS STRING), '"}]')
  ELSE concat('["x/si_', CAST(k AS STRING), '", "y_bl.', CAST(k AS STRING), '", "other"]') END"""


@query(
    "attachment_roles",
    """SELECT email_id, CASE WHEN k % 3 < 2 THEN concat('a/', k) ELSE concat('x/si_', k) END
      AS si_path, CASE WHEN k % 3 < 2 THEN concat('b/', k) ELSE concat('y_bl.', k) END AS bl_path
    FROM v_mail""",
)
def attachment_roles(spark, sf):
    raw = view(spark, sf, "v_mail").select("email_id", F.parse_json(F.expr(_SHAPES)).alias("a"))
    found = raw.select("email_id", rules.attachment_roles(F.col("a")).alias("p"))
    return found.select("email_id", "p.si_path", "p.bl_path")
