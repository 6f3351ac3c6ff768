"""Labels, extraction, comparison and the audit over the derived documents.

The checks know the answers from the order tables; the engine finds them in the texts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from freightaudit import dims
from freightaudit.bindings.registry import query
from freightaudit.bindings.rule_queries import sql_list
from freightaudit.bindings.text_queries import _TRUE_VALUE, _WORDS
from freightaudit.bindings.views import documents, mails, q, table, view
from freightaudit.functions import labels as L
from freightaudit.functions.pyudf import char_similarity
from freightaudit.operators import compare, extract, joins, labels, rules
from freightaudit.plans import audit
from freightaudit.sources import attachments as files

# Ratcliff-Obershelp in SQL: the longest common block (earliest in a, then in b) splits both
# strings in two; recursion on the parts, twice the matched length over the total length.
_PAIRS = """pairs AS (
  SELECT DISTINCT regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS a,
    regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS b
  FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""
_RATIO = """parts(a, b, x, y, size) AS (
  SELECT a, b, a AS x, b AS y, CAST(0 AS BIGINT) AS size FROM {pairs}
  UNION ALL
  SELECT a, b, unnest([x[:i - 1], x[i + n:]]), unnest([y[:j - 1], y[j + n:]]), unnest([n, 0])
  FROM (
    SELECT a, b, x, y, m.i AS i, m.j AS j, m.n AS n FROM (
      SELECT a, b, x, y, list_reduce(list_filter(flatten(list_transform(range(1, length(x) + 1),
        lambda i: flatten(list_transform(range(1, length(y) + 1),
          lambda j: list_transform(range(1, least(length(x) - i, length(y) - j) + 2),
            lambda n: {{'n': n, 'i': -i, 'j': -j, 's': x[i:i + n - 1] = y[j:j + n - 1]}}))))),
        lambda e: e.s), lambda p, r: CASE WHEN (r.n, r.i, r.j) > (p.n, p.i, p.j) THEN r ELSE p END)
        AS best
      FROM parts WHERE length(x) > 0 AND length(y) > 0 AND
        len(list_intersect(string_split(x, ''), string_split(y, ''))) > 0) f,
      LATERAL (SELECT best.n AS n, -best.i AS i, -best.j AS j) m) g),
  ratios AS (SELECT a, b, round(20.0 * sum(size) / (length(a) + length(b)), 2) AS similarity
    FROM parts GROUP BY a, b)"""


@query(
    "char_similarity",
    f"""WITH RECURSIVE {_PAIRS}, {_RATIO.format(pairs='pairs')}
    SELECT a, b, CAST(similarity AS DOUBLE) AS similarity FROM ratios""",
)
def similarity(spark, sf):
    nations = table(spark, sf, "nation")
    suppliers = table(spark, sf, "supplier")

    def clean(name):
        return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")

    pairs = suppliers.join(nations, F.col("n_nationkey") == F.col("s_nationkey")).select(
        clean("s_name").alias("a"), clean("n_name").alias("b")
    )
    return pairs.distinct().withColumn("similarity", char_similarity("a", "b"))


def document_labels(spark, sf):
    """All labels before a colon, with how often they occur."""
    docs = view(spark, sf, "v_doc_text").select("path", "text")
    lines = extract.document_lines(docs, folded=False)
    return lines.where(F.col("raw").contains(":")).select(
        F.substring_index("raw", ":", 1).alias("label")
    )


_LABEL_ROWS = r"""labels AS (SELECT DISTINCT split_part(line, ':', 1) AS label FROM (
  SELECT unnest(string_split(text, chr(10))) AS line FROM v_doc_text) x WHERE contains(line, ':'))"""
_KEYS = _WORDS.replace("v_field", "labels").replace("SELECT DISTINCT label,", "SELECT label,")
_ALIAS_ROWS = "aliases AS (SELECT * FROM (VALUES " + ", ".join(
    f"({q(a.field)}, {a.field_ord}, {q(a.alias)}, {a.alias_ord}, {q(a.key)}, "
    f"{sql_list(dict.fromkeys(a.meaningful))}, {sql_list(a.acronyms)})"
    for a in L.ALIASES
) + ") AS v(field, field_ord, alias, alias_ord, akey, amean, aacr))"
_PROFILES = f"""{_LABEL_ROWS}, keyed AS (SELECT DISTINCT w FROM ({_KEYS}) x), profiles AS (
  SELECT array_to_string(w, ' ') AS label_key, array_to_string(w, '') AS joined,
    list_distinct(list_filter(w, lambda x: NOT list_contains(['a','and','of','or','the'], x)))
      AS mean,
    CASE WHEN len(w) = 1 AND regexp_matches(w[1], '^[a-z]{{1,5}}$') THEN [w[1]]
    ELSE list_filter(list_distinct([array_to_string(list_transform(w, lambda x: x[1]), ''),
      array_to_string(list_transform(list_filter(w,
        lambda x: NOT list_contains(['a','and','of','or','the'], x)), lambda x: x[1]), '')]),
      lambda x: x <> '') END AS acr FROM keyed)"""
_SCORED = f"""WITH RECURSIVE {_PROFILES}, {_ALIAS_ROWS}, pairs AS (
  SELECT DISTINCT joined AS a, replace(akey, ' ', '') AS b FROM profiles CROSS JOIN aliases),
  {_RATIO.format(pairs='pairs')}, points AS (
  SELECT label_key, field, field_ord, alias, alias_ord, label_key = akey AS exact,
    15.0 * len(list_intersect(mean, amean)) AS shared_points,
    len(list_filter(list_intersect(acr, aacr), lambda x: length(x) >= 2)) > 0 AS acronym,
    -5.0 * (len(mean) + len(amean) - 2 * len(list_intersect(mean, amean))) AS penalty,
    coalesce(list_max(flatten(list_transform(acr, lambda l: list_transform(aacr, lambda r:
      10.0 * len(list_filter(range(1, least(length(l), length(r)) + 1), lambda i: l[i] = r[i]))
      - 5.0 * least(length(l), length(r)))))), 0) AS initials,
    coalesce(similarity, 0) AS similarity
  FROM profiles CROSS JOIN aliases
  LEFT JOIN ratios ON a = joined AND b = replace(akey, ' ', '')), scored AS (
  SELECT *, CASE WHEN exact THEN 100.0 ELSE round(greatest(0, shared_points + initials + similarity
    + CASE WHEN acronym THEN 30 ELSE penalty END), 2) END AS score FROM points)"""


@query(
    "score_label_alias",
    f"""{_SCORED} SELECT label_key, field, alias, alias_ord, CAST(score AS DOUBLE) AS score, exact
    FROM scored""",
)
def score_label_alias(spark, sf):
    scored = labels.join_label_alias(labels.distinct_label_keys(document_labels(spark, sf)))
    return scored.select(
        "label_key", "field", "alias", "alias_ord",
        F.col("points.score").alias("score"), F.col("points.exact_alias").alias("exact"),
    )


@query(
    "join_label_alias",
    f"""{_SCORED} SELECT field, alias, alias_ord, count(*) AS labels,
      CAST(max(score) AS DOUBLE) AS best FROM scored GROUP BY field, alias, alias_ord""",
)
def join_label_alias(spark, sf):
    scored = labels.join_label_alias(labels.distinct_label_keys(document_labels(spark, sf)))
    return scored.groupBy("field", "alias", "alias_ord").agg(
        F.count("*").alias("labels"), F.max("points.score").alias("best")
    )


_DECIDED = f"""{_SCORED}, best AS (
  SELECT label_key, field, field_ord, max(score) AS score,
    first(alias ORDER BY score DESC, alias_ord) AS alias
  FROM scored GROUP BY label_key, field, field_ord), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label_key ORDER BY score DESC, field_ord) AS rn,
    lead(score) OVER (PARTITION BY label_key ORDER BY score DESC, field_ord) AS second
  FROM best), decided AS (
  SELECT label_key, score >= 30 AND round(score - second, 2) >= 10 AS accepted, field, alias,
    CAST(score AS DOUBLE) AS best_score, CAST(second AS DOUBLE) AS second_score
  FROM ranked WHERE rn = 1)"""


@query(
    "classify_label",
    f"""{_DECIDED} SELECT label_key, accepted, CASE WHEN accepted THEN field END AS field,
      best_score, second_score, alias AS best_alias FROM decided""",
)
def classify_label(spark, sf):
    return labels.classify_labels(document_labels(spark, sf)).select(
        "label_key", "decision.accepted", "decision.field", "decision.best_score",
        "decision.second_score", "decision.best_alias",
    )


def table_pairs(spark, sf):
    """Each document's labels and values as table cells, with one more label per document."""
    rows = view(spark, sf, "v_field").select(
        "path", F.col("field_ord").cast("long").alias("seq"), "label", "value"
    )
    extra = view(spark, sf, "v_sides").select(
        F.expr("concat('attachments/mail_', cast(k as string), '_', role, '.txt')").alias("path"),
        F.lit(90).cast("long").alias("seq"),
        F.expr("CASE WHEN k % 3 = 0 THEN 'NET WEIGHT' ELSE 'Vessel' END").alias("label"),
        F.lit("17").alias("value"),
    )
    return rows.unionByName(extra)


@query("pairs_candidates", "SELECT path, CAST(field_ord AS BIGINT) AS seq, field FROM v_field")
def pairs_candidates(spark, sf):
    found = extract.choose_candidate(extract.pair_candidates(table_pairs(spark, sf)))
    return found.where(F.col("field").isNotNull()).select(
        "path", F.col("candidate.no").alias("seq"), "field"
    )


@query(
    "uncertain_labels",
    """SELECT concat('attachments/mail_', k, '_', role, '.txt') AS path,
      CASE WHEN k % 3 = 0 THEN 'NET WEIGHT' ELSE 'Vessel' END AS label, 'table' AS source,
      CAST(CASE WHEN k % 3 = 0 THEN 11.0 ELSE 0.0 END AS DOUBLE) AS best_score FROM v_sides""",
)
def uncertain_labels(spark, sf):
    return extract.uncertain_labels(table_pairs(spark, sf)).select(
        "path", "label", "source", F.col("decision.best_score").alias("best_score")
    )


# Line positions of the fields in the derived layout.
_LINE_OF = "CASE WHEN field_ord = 0 THEN 4 ELSE field_ord + 5 END"
_READABLE = "NOT (side = 1 AND k % 97 IN (3, 4))"


def line_fields(spark, sf):
    docs = view(spark, sf, "v_doc_text").select("path", "text")
    return extract.choose_candidate(extract.text_candidates(docs)).where(
        F.col("field").isNotNull()
    )


@query(
    "line_candidate",
    f"""SELECT path, field, concat('line ', {_LINE_OF}) AS source FROM v_field
    WHERE {_READABLE}""",
)
def line_candidate(spark, sf):
    return line_fields(spark, sf).select("path", "field", "candidate.source")


@query(
    "colon_candidates",
    f"""SELECT field, count(*) AS n FROM v_field WHERE {_READABLE} AND k % 5 <> 4
    GROUP BY field""",
)
def colon_candidates(spark, sf):
    docs = view(spark, sf, "v_doc_text").select("path", "text")
    rows = labels.with_accepted_label(
        extract.text_candidates(docs), {"key1": "found1", "key2": "found2"}
    )
    found = F.coalesce("found1", "found2")
    return rows.where(found.isNotNull()).groupBy(found["field"].alias("field")).agg(
        F.count("*").alias("n")
    )


@query(
    "prefix_candidates",
    f"""SELECT path, field, regexp_replace(trim(value), '^[^A-Za-z0-9]+', '') AS value FROM v_field
    WHERE {_READABLE}""",
)
def prefix_candidates(spark, sf):
    docs = view(spark, sf, "v_doc_text").select("path", "text")
    return extract.prefix_candidates(docs).select("path", "field", "value")


@query(
    "join_alias_prefix",
    f"""SELECT field, count(*) AS n FROM v_field WHERE {_READABLE} GROUP BY field""",
)
def join_alias_prefix(spark, sf):
    return prefix_candidates(spark, sf).groupBy("field").agg(F.count("*").alias("n"))


@query(
    "resolve_candidates",
    f"""SELECT f.path, field, CASE WHEN f.k % 5 = 4 THEN regexp_replace(trim(value),
      '^[^A-Za-z0-9]+', '') ELSE trim(value) END AS raw_value, {_TRUE_VALUE} AS normalised
    FROM v_field f JOIN v_sides s ON s.k = f.k AND s.side = f.side
    WHERE NOT (f.side = 1 AND f.k % 97 IN (3, 4))""",
)
def resolve_candidates(spark, sf):
    docs = documents(spark, sf)
    return extract.resolve_candidates(extract.field_candidates(docs)).select(
        "path", "field", "raw_value", "normalised"
    )


@query(
    "extract_fields",
    f"""SELECT path, {", ".join(
        f"max(CASE WHEN field = {q(f)} AND {_READABLE.replace('side', 'f.side').replace('k %', 'f.k %')} "
        f"THEN {_TRUE_VALUE} END) AS {f}" for f in dims.FIELDS)}
    FROM v_field f JOIN v_sides s ON s.k = f.k AND s.side = f.side
    WHERE NOT (f.side = 1 AND f.k % 97 = 3) GROUP BY path""",
)
def extract_fields(spark, sf):
    found = extract.extract_fields(documents(spark, sf))
    return found.select(
        "path", *[F.col("fields")[f]["normalised"].alias(f) for f in dims.FIELDS]
    )


@query(
    "missing_fields",
    f"""SELECT path, CASE WHEN side = 1 AND k % 97 = 4 THEN {q(",".join(dims.FIELDS))} ELSE '' END
      AS missing FROM v_doc_text""",
)
def missing_fields(spark, sf):
    facts = extract.document_facts(documents(spark, sf))
    return facts.select("path", F.array_join(extract.missing_fields(), ",").alias("missing"))


@query(
    "wrong_document",
    "SELECT path, side = 1 AND k % 97 = 2 AS wrong FROM v_doc_text",
)
def wrong_document(spark, sf):
    facts = extract.document_facts(documents(spark, sf))
    return facts.select("path", F.col("wrong_type").alias("wrong"))


@query(
    "read_status",
    """SELECT path, CASE WHEN side = 1 AND k % 97 = 4
      THEN 'The attachment contains no readable text.' END AS error FROM v_doc_text""",
)
def read_status(spark, sf):
    return documents(spark, sf).select("path", "error")


@query(
    "attachment_format",
    """SELECT path, 'txt' AS format FROM v_values
    UNION ALL SELECT url AS path, CASE WHEN regexp_matches(split_part(url, '/', -1), '^.+\\.[^.]+$')
      THEN lower(split_part(split_part(url, '/', -1), '.', -1)) ELSE '' END FROM pages""",
)
def attachment_format(spark, sf):
    paths = view(spark, sf, "v_values").select("path").unionByName(
        table(spark, sf, "pages").select(F.col("url").alias("path"))
    )
    return paths.select("path", files.attachment_format(F.col("path")).alias("format"))


@query(
    "required_formats",
    """SELECT DISTINCT 'txt' AS format, TRUE AS supported FROM v_mail WHERE len(attachments) > 0
    UNION ALL SELECT DISTINCT n_name, FALSE FROM nation""",
)
def required_formats(spark, sf):
    more = table(spark, sf, "nation").select(F.array(F.concat(F.lit("a."), "n_name")).alias("attachments"))
    used = mails(spark, sf).select("attachments").unionByName(more)
    found = files.required_formats(used)
    return found.withColumn(
        "format", F.when(F.col("supported"), F.col("format")).otherwise(F.upper("format"))
    )


# ------------------------------------------------------------------------ comparison


def paired_facts(spark, sf):
    """Every shipment with the facts of both its documents."""
    facts = extract.document_facts(documents(spark, sf))
    pairs = view(spark, sf, "v_shipment").select(
        F.col("k").cast("string").alias("email_id"),
        *[
            F.concat(F.lit("attachments/mail_"), F.col("k").cast("string"), F.lit(f"_{r}.txt")).alias(
                f"{r.lower()}_path"
            )
            for r in ("SI", "BL")
        ],
    )
    refs = pairs.select(F.explode(F.array("si_path", "bl_path")).alias("path"))
    return joins.join_mail_docs(pairs, facts, refs)


_STATES = """states AS (SELECT CAST(k AS VARCHAR) AS email_id, field, field_ord, k,
  CASE WHEN k % 97 IN (3, 4) OR (field = 'consignee' AND k % 97 = 1) THEN 'REVIEW_NEEDED'
    WHEN (field = 'port_of_discharge' AND k % 13 = 0) OR (field = 'container_count' AND k % 7 = 0)
      OR (field = 'gross_weight_kg' AND k % 11 = 0) THEN 'NOT_MATCHED' ELSE 'MATCHED' END AS result
  FROM v_field WHERE side = 0)"""


@query("compare_fields", f"WITH {_STATES} SELECT email_id, field, result FROM states")
def compare_fields(spark, sf):
    compared = compare.compare_fields(paired_facts(spark, sf))
    return compared.select("email_id", F.explode("comparisons").alias("c")).select(
        "email_id", "c.field", "c.result"
    )


@query(
    "join_si_bl_fields",
    f"""WITH {_STATES} SELECT field, result, count(*) AS n FROM states GROUP BY field, result""",
)
def join_si_bl_fields(spark, sf):
    return compare_fields(spark, sf).groupBy("field", "result").agg(F.count("*").alias("n"))


@query(
    "pair_status",
    f"""WITH {_STATES}, folded AS (SELECT email_id,
      coalesce(string_agg(CASE WHEN result = 'REVIEW_NEEDED' THEN field END, ',' ORDER BY field_ord),
        '') AS reviews,
      coalesce(string_agg(CASE WHEN result = 'NOT_MATCHED' THEN field END, ',' ORDER BY field_ord),
        '') AS mismatches FROM states GROUP BY email_id)
    SELECT email_id, CASE WHEN reviews <> '' THEN 'NEEDS_REVIEW' WHEN mismatches <> '' THEN
      'MISMATCH' ELSE 'OK' END AS status,
      CASE WHEN reviews <> '' THEN 'missing_value' END AS review_reason,
      CASE WHEN reviews <> '' THEN '' ELSE mismatches END AS defects, reviews,
      mismatches AS known_mismatches FROM folded""",
)
def pair_status(spark, sf):
    decided = compare.with_pair_status(compare.compare_fields(paired_facts(spark, sf)))
    return decided.select(
        "email_id", "status", "review_reason",
        F.array_join("defect_fields", ",").alias("defects"),
        F.array_join("review_fields", ",").alias("reviews"),
        F.array_join("known_mismatches", ",").alias("known_mismatches"),
    )


@query(
    "diff_frame",
    """SELECT CAST(s.k AS VARCHAR) AS email_id, array_to_string(list_transform(
        string_split(s.field, '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS field,
      coalesce(nullif(CASE WHEN s.k % 5 = 4 THEN regexp_replace(trim(s.value), '^[^A-Za-z0-9]+', '')
        ELSE trim(s.value) END, ''), '—') AS si_value,
      CASE WHEN s.k % 97 IN (3, 4) THEN '—' ELSE coalesce(nullif(trim(b.value), ''), '—') END
        AS bl_value
    FROM v_field s JOIN v_field b ON b.k = s.k AND b.field = s.field AND b.side = 1
    WHERE s.side = 0""",
)
def diff_frame(spark, sf):
    compared = compare.compare_fields(paired_facts(spark, sf))
    return compare.diff_frame(compared).select("email_id", "field", "si_value", "bl_value")


_AUDIT_COLUMNS = "email_id, category, status, review_reason, defects, has_defect"


def audited(spark, sf):
    return audit.audit_mails(mails(spark, sf), documents(spark, sf))


@query("audit_mails", f"SELECT {_AUDIT_COLUMNS} FROM v_audit")
def audit_mails(spark, sf):
    return audit.decisions(audited(spark, sf)).select(
        "email_id", "category", "status", "review_reason",
        F.array_join("defect_fields", ",").alias("defects"), "has_defect",
    )


@query(
    "decide_comparison",
    """SELECT email_id, status, review_reason FROM v_audit WHERE category = 'BL_COMPARISON'""",
)
def decide_comparison(spark, sf):
    return audited(spark, sf).where(F.col("category") == "BL_COMPARISON").select(
        "email_id", "status", "review_reason"
    )


@query(
    "review_decision",
    """SELECT review_reason, count(*) AS n, count_if(has_defect) AS defects FROM v_audit
    WHERE status = 'NEEDS_REVIEW' GROUP BY review_reason""",
)
def review_decision(spark, sf):
    reviews = audited(spark, sf).where(F.col("status") == "NEEDS_REVIEW")
    return reviews.groupBy("review_reason").agg(
        F.count("*").alias("n"), F.count_if("has_defect").alias("defects")
    )


@query(
    "join_mail_docs",
    """SELECT email_id, len(attachments) = 2 AS si_found,
      len(attachments) = 2 AND k % 97 <> 3 AS bl_found FROM v_mail""",
)
def join_mail_docs(spark, sf):
    rows = mails(spark, sf).select(
        "email_id",
        F.when(F.size("attachments") == 2, joins.find_si_bl_paths(F.col("attachments"))).alias("p"),
    ).select("email_id", "p.si_path", "p.bl_path")
    facts = documents(spark, sf).select("path", "error")
    refs = mails(spark, sf).select(F.explode("attachments").alias("path"))
    return joins.join_mail_docs(rows, facts, refs).select(
        "email_id", F.col("si").isNotNull().alias("si_found"), F.col("bl").isNotNull().alias("bl_found")
    )


@query(
    "route_comparisons",
    """SELECT email_id, category, CASE WHEN category = 'BL_COMPARISON' THEN 'compare' ELSE 'OK' END
      AS status FROM v_audit""",
)
def route_comparisons(spark, sf):
    routed, others = audit.route_comparisons(rules.cascade(mails(spark, sf)))
    return others.select("email_id", "category", "status").unionByName(
        routed.select("email_id", "category", F.lit("compare").alias("status"))
    )


@query(
    "write_report",
    """SELECT a.email_id, m."from" AS sender, left(m.body, 500) AS body_preview, a.status,
      CASE WHEN len(m.attachments) = 2 THEN 'attachment_pair' ELSE 'keyword_fallback' END AS source,
      CASE WHEN len(m.attachments) = 2 AND m.k % 97 NOT IN (2, 3, 4) THEN 7 END AS compared,
      CASE WHEN len(m.attachments) = 2 AND m.k % 97 = 3 THEN 'missing file'
           WHEN len(m.attachments) = 2 AND m.k % 97 = 4
           THEN 'The attachment contains no readable text.' END AS bl_error
    FROM v_audit a JOIN v_mail m ON m.email_id = a.email_id""",
)
def write_report(spark, sf):
    report = audit.audit_report(mails(spark, sf), documents(spark, sf))
    return report.select(
        "email_id", F.col("from").alias("sender"), "body_preview", "status", "source",
        F.when(F.col("comparisons").isNotNull(), F.size("comparisons")).cast("long").alias("compared"),
        F.try_element_at("errors", F.lit("bl")).alias("bl_error"),
    )


@query(
    "example_rows",
    "SELECT email_id, category, status, defects FROM v_audit ORDER BY email_id LIMIT 10",
)
def example_rows(spark, sf):
    return audit.example_rows(audited(spark, sf), 10).select(
        "email_id", "category", "status", F.array_join("defect_fields", ",").alias("defects")
    )


@query("limit_batch", "SELECT email_id, subject FROM v_mail ORDER BY email_id LIMIT 500")
def limit_batch(spark, sf):
    return audit.limit_batch(mails(spark, sf), 500).select("email_id", "subject")


@query(
    "default_submission",
    """SELECT email_id, 'GENERAL' AS category, 'OK' AS status, CAST(NULL AS VARCHAR) AS
      review_reason, FALSE AS has_defect FROM v_mail""",
)
def default_submission(spark, sf):
    return audit.default_submission(mails(spark, sf)).drop("defect_fields")


# ------------------------------------------------------------------ tolerant comparison


def lenient_pairs(spark, sf):
    """SI and BL values side by side, blank values as NULL."""
    rows = view(spark, sf, "v_values")
    side = {
        r: rows.where(F.col("role") == r).select(
            "k",
            F.struct(
                *[F.nullif(F.trim(f"v_{f}"), F.lit("")).alias(f) for f in dims.FIELDS]
            ).alias(r.lower()),
        )
        for r in ("SI", "BL")
    }
    return side["SI"].join(side["BL"], "k")


_LENIENT = """CASE WHEN nullif(trim(s.value), '') IS NULL OR nullif(trim(b.value), '') IS NULL THEN TRUE
  WHEN s.field = 'port_of_discharge' THEN s.k % 13 <> 0
  WHEN s.field = 'container_count' THEN s.k % 7 <> 0
  WHEN s.field = 'gross_weight_kg' THEN s.k % 11 <> 0
  WHEN s.field = 'consignee' THEN s.k % 97 <> 1 OR trim(s.value) IN ('', '???') ELSE TRUE END"""
_LENIENT_FROM = """v_field s JOIN v_field b ON b.k = s.k AND b.field = s.field AND b.side = 1
  WHERE s.side = 0"""


@query("lenient_compare", f"SELECT s.k, s.field, {_LENIENT} AS matches FROM {_LENIENT_FROM}")
def lenient_compare(spark, sf):
    wide = lenient_pairs(spark, sf)
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.col(f"si.{f}").alias("si_value"),
                F.col(f"bl.{f}").alias("bl_value"),
            )
            for f in dims.FIELDS
        ]
    )
    long = wide.select("k", F.explode(rows).alias("r")).select("k", "r.*")
    return compare.lenient_compare(long).select("k", "field", "matches")


@query(
    "lenient_mismatches",
    f"""SELECT s.k, coalesce(string_agg(CASE WHEN NOT {_LENIENT} THEN
      s.field || '=' || trim(s.value) || '/' || trim(b.value) END, ';' ORDER BY s.field_ord), '')
      AS mismatches FROM {_LENIENT_FROM} GROUP BY s.k""",
)
def lenient_mismatches(spark, sf):
    cases = compare.lenient_case(lenient_pairs(spark, sf), ("k",))
    shown = F.transform(
        F.map_entries("mismatches"),
        lambda e: F.concat(e["key"], F.lit("="), e["value"]["si"], F.lit("/"), e["value"]["bl"]),
    )
    return cases.select("k", F.array_join(shown, ";").alias("mismatches"))


@query(
    "lenient_case",
    f"""SELECT s.k, bool_or(NOT {_LENIENT}) AS has_mismatch,
      bool_or(nullif(trim(s.value), '') IS NULL) AS needs_human_review,
      CASE WHEN bool_or(nullif(trim(s.value), '') IS NULL)
        THEN 'Uncertain values or missing fields: consignee' END AS review_reason
    FROM {_LENIENT_FROM} GROUP BY s.k""",
)
def lenient_case(spark, sf):
    return compare.lenient_case(lenient_pairs(spark, sf), ("k",)).drop("mismatches")


