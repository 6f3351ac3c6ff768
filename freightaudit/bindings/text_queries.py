"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from freightaudit import dims
from freightaudit.bindings.registry import query
from freightaudit.bindings.views import mails, q, table, view
from freightaudit.functions import labels as L
from freightaudit.functions import text as X
from freightaudit.functions import values as V
from freightaudit.operators import extract, responses, rules

LIST = "[" + ", ".join(q(w) for w in dims.STOPWORDS) + "]"
SHORT = "[" + ", ".join(q(w) for w in dims.SHORT_WORDS) + "]"
FOLDED = "replace(lower(nfc_normalize(text)), 'ß', 'ss')"
CURRENT = (
    r"regexp_replace({}, '(?im)^\s*(?:best regards|kind regards|regards|thanks and regards|best),?"
    r"\s*$(?s:.*)|^_{{5,}}\s*$(?s:.*)|^-{{5,}}\s*original message\s*-{{5,}}$(?s:.*)', '')"
)
NORM = "array_to_string(regexp_extract_all(lower({}), '[a-z0-9]+'), ' ')"
COMPACT = r"regexp_replace(lower(value), '\s', '', 'g')"
MISSING = f"regexp_matches({COMPACT}, '^(tba|tbc|n/a|na|nil|none|[_?.-]*(kg|kgs|mt|mts)?)$')"


def joined(words):
    return F.array_join(words, ",")


@query("fold_text", f"SELECT doc_id, md5({FOLDED}) AS folded FROM documents")
def fold_text(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.md5(X.fold_text_full(F.col("text"))).alias("folded"))


@query(
    "ascii_words",
    f"""SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS words
    FROM (SELECT doc_id, regexp_extract_all({FOLDED}, '[a-z0-9]+') AS w FROM documents) d""",
)
def ascii_words(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", X.ascii_words(F.col("text")).alias("w")
    )
    return docs.select(
        "doc_id",
        F.size("w").cast("long").alias("n"),
        F.md5(F.array_join("w", " ")).alias("words"),
    )


@query(
    "split_lines",
    r"""SELECT doc_id, len(l) AS n, len(list_filter(l, lambda x: trim(x) <> '')) AS filled
    FROM (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS l
          FROM (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0b\f]') AS p
                FROM documents) a) b""",
)
def split_lines(spark, sf):
    lines = X.split_lines(F.col("text"))
    docs = table(spark, sf, "documents").select("doc_id", lines.alias("l"))
    return docs.select(
        "doc_id",
        F.size("l").cast("long").alias("n"),
        F.size(F.filter("l", lambda x: F.trim(x) != "")).cast("long").alias("filled"),
    )


@query(
    "decode_text",
    "SELECT doc_id, md5(text) AS text, length(text) AS n FROM documents",
)
def decode_text(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", X.decode_text(F.encode("text", "UTF-8")).alias("text")
    )
    return docs.select("doc_id", F.md5("text").alias("text"), F.length("text").cast("long").alias("n"))


_WORDS = """SELECT DISTINCT label, list_transform(
      regexp_extract_all(lower(label), '[a-z0-9]+'),
      lambda w: CASE w WHEN 'containers' THEN 'container' WHEN 'kgs' THEN 'kg' WHEN 'no' THEN 'number'
           WHEN 'packages' THEN 'package' WHEN 'wt' THEN 'weight' ELSE w END) AS w FROM v_field"""
_KEPT = "list_filter(w, lambda x: NOT list_contains(['a','and','of','or','the'], x))"


@query("label_words", f"SELECT label, array_to_string(w, ',') AS words FROM ({_WORDS}) d")
def label_words(spark, sf):
    labels = view(spark, sf, "v_field").select("label").distinct()
    return labels.select(
        "label", joined(L.label_words(X.fold_text(F.col("label")))).alias("words")
    )


@query(
    "meaningful_label_words",
    f"SELECT label, array_to_string({_KEPT}, ',') AS words FROM ({_WORDS}) d",
)
def meaningful_label_words(spark, sf):
    labels = view(spark, sf, "v_field").select("label").distinct()
    words = L.label_words(X.fold_text(F.col("label")))
    return labels.select("label", joined(L.meaningful_words(words)).alias("words"))


@query(
    "label_acronyms",
    f"""SELECT label, CASE WHEN len(w) = 1 AND regexp_matches(w[1], '^[a-z]{{1,5}}$') THEN w[1]
      ELSE array_to_string(list_sort(list_distinct([
        array_to_string(list_transform(w, lambda x: x[1]), ''),
        array_to_string(list_transform({_KEPT}, lambda x: x[1]), '')])), ',') END AS forms
    FROM ({_WORDS}) d""",
)
def label_acronyms(spark, sf):
    labels = view(spark, sf, "v_field").select("label").distinct()
    words = L.label_words(X.fold_text(F.col("label")))
    return labels.select("label", joined(F.array_sort(L.label_acronyms(words))).alias("forms"))


@query(
    "remove_boilerplate",
    f"SELECT email_id, {CURRENT.format('body')} AS body FROM v_mail",
)
def remove_boilerplate(spark, sf):
    return mails(spark, sf).select("email_id", X.remove_boilerplate(F.col("body")).alias("body"))


@query("normalise_text", f"SELECT doc_id, md5({NORM.format('text')}) AS text FROM documents")
def normalise_text(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.md5(X.normalise_text(F.col("text"))).alias("text"))


@query(
    "extract_words",
    f"""SELECT email_id, array_to_string(list_filter(
      regexp_extract_all(lower(body), '[a-z]+'), lambda w: NOT list_contains({LIST}, w)
      AND (length(w) >= 3 OR list_contains({SHORT}, w))), ' ') AS words FROM v_mail""",
)
def extract_words(spark, sf):
    return mails(spark, sf).select(
        "email_id", F.array_join(X.extract_words(F.col("body")), " ").alias("words")
    )


@query("is_missing_value", f"SELECT path, field, {MISSING} AS missing FROM v_field")
def is_missing_value(spark, sf):
    return view(spark, sf, "v_field").select(
        "path", "field", V.is_missing_value(F.col("value")).alias("missing")
    )


@query(
    "normalise_text_value",
    f"""SELECT path, field, CASE WHEN NOT {MISSING} THEN nullif(regexp_replace(
      replace(lower(value), '&', 'and'), '[^a-z0-9]', '', 'g'), '') END AS normal FROM v_field""",
)
def normalise_text_value(spark, sf):
    return view(spark, sf, "v_field").select(
        "path", "field", V.normalise_text_value(F.col("value")).alias("normal")
    )


@query(
    "normalise_container_count",
    "SELECT k, role, CAST(container_count AS BIGINT) AS containers FROM v_sides",
)
def normalise_container_count(spark, sf):
    rows = view(spark, sf, "v_field").where(F.col("field") == dims.COUNT_FIELD)
    count = V.normalise_container_count(F.col("value")).cast("long")
    return rows.select("k", "role", count.alias("containers"))


@query(
    "normalise_weight_kg",
    """SELECT k, role, CAST(tonnes * 1000 + CASE WHEN half THEN 500 ELSE 0 END AS DOUBLE) AS kg
    FROM v_sides""",
)
def normalise_weight_kg(spark, sf):
    rows = view(spark, sf, "v_field").where(F.col("field") == dims.WEIGHT_FIELD)
    return rows.select(
        "k", "role", V.normalise_weight_kg(F.col("value")).cast("double").alias("kg")
    )


_TRUE_VALUE = """CASE field WHEN 'shipper' THEN regexp_replace(lower(s.shipper), '[^a-z0-9]', '', 'g')
  WHEN 'consignee' THEN CASE WHEN f.side = 0 AND f.k % 97 = 1 THEN NULL
    ELSE regexp_replace(lower(s.consignee), '[^a-z0-9]', '', 'g') END
  WHEN 'notify_party' THEN regexp_replace(lower(s.notify_party), '[^a-z0-9]', '', 'g')
  WHEN 'port_of_loading' THEN regexp_replace(lower(s.port_of_loading), '[^a-z0-9]', '', 'g')
  WHEN 'port_of_discharge' THEN regexp_replace(lower(s.port_of_discharge), '[^a-z0-9]', '', 'g')
  WHEN 'container_count' THEN CAST(s.container_count AS VARCHAR)
  ELSE CAST(s.tonnes * 1000 + CASE WHEN s.half THEN 500 ELSE 0 END AS VARCHAR) END"""


@query(
    "normalise_field_value",
    f"""SELECT path, field, {_TRUE_VALUE} AS normal
    FROM v_field f JOIN v_sides s ON s.k = f.k AND s.side = f.side""",
)
def normalise_field_value(spark, sf):
    return view(spark, sf, "v_field").select(
        "path", "field", V.normalise_field_value(F.col("field"), F.col("value")).alias("normal")
    )


@query(
    "json_value",
    r"""SELECT o_orderkey, regexp_replace(printf('%.2f', o_totalprice), '\.?0+$', '') AS plain
    FROM orders""",
)
def json_value(spark, sf):
    price = F.round(F.col("o_totalprice"), 2).cast("decimal(28,9)")
    return table(spark, sf, "orders").select("o_orderkey", V.json_value(price).alias("plain"))


@query(
    "lenient_text",
    r"""SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g'))) AS text
    FROM documents""",
)
def lenient_text(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.md5(V.lenient_text(F.col("text"))).alias("text"))


@query(
    "lenient_weight",
    """SELECT k, role, CAST(tonnes * 1000 + CASE WHEN half THEN 500 ELSE 0 END AS DOUBLE) AS kg
    FROM v_sides""",
)
def lenient_weight(spark, sf):
    rows = view(spark, sf, "v_field").where(F.col("field") == dims.WEIGHT_FIELD)
    return rows.select("k", "role", V.lenient_weight(F.col("value")).alias("kg"))


@query(
    "lenient_container_count",
    "SELECT k, role, CAST(container_count AS BIGINT) AS containers FROM v_sides",
)
def lenient_container_count(spark, sf):
    rows = view(spark, sf, "v_field").where(F.col("field") == dims.COUNT_FIELD)
    return rows.select(
        "k", "role", V.lenient_container_count(F.col("value")).cast("long").alias("containers")
    )


@query(
    "structural_tokens",
    """SELECT concat('mail_', k) AS email_id, concat_ws(' ',
      CASE WHEN k % 20 = 2 THEN 'ATTCOUNT1' WHEN k % 10 < 3 THEN 'ATTCOUNT2' ELSE 'ATTCOUNT0' END,
      CASE WHEN k % 10 < 3 THEN 'HASSIATT' END,
      CASE WHEN k % 10 < 3 AND k % 20 <> 2 THEN 'HASBLATT' END,
      CASE k % 3 WHEN 0 THEN 'DOMAIN_harbourexample TLD_example'
        WHEN 1 THEN 'DOMAIN_carrierexamplecom TLD_com' ELSE 'DOMAIN_brokerexampleorg TLD_org' END,
      CASE WHEN k % 4 = 0 THEN 'ISREPLY' END) AS tokens FROM v_key""",
)
def structural_tokens(spark, sf):
    rows = mails(spark, sf)
    return rows.select("email_id", rules.structural_tokens(rows).alias("tokens"))


_RESPONSE = """SELECT path, concat('{"shipper": "', v_shipper, ' ", "consignee": "', v_consignee,
  '", "vessel": "null", "voyage": "", "gross_weight": "', v_gross_weight_kg,
  CASE WHEN k % 19 = 0 THEN '"' ELSE '"}' END) AS response FROM v_values"""


@query(
    "clean_extraction_json",
    f"""SELECT path, CASE WHEN ok THEN nullif(trim(json_extract_string(r, '$.shipper')), '') END
        AS shipper,
      CASE WHEN ok THEN nullif(trim(json_extract_string(r, '$.consignee')), '') END AS consignee,
      CAST(NULL AS VARCHAR) AS vessel,
      CASE WHEN ok THEN nullif(trim(json_extract_string(r, '$.gross_weight')), '') END AS weight
    FROM (SELECT path, json_valid(response) AS ok,
            CASE WHEN json_valid(response) THEN response END AS r FROM ({_RESPONSE}) a) b""",
)
def clean_extraction_json(spark, sf):
    rows = view(spark, sf, "v_values")
    rows.createOrReplaceTempView("checked_values")
    answered = spark.sql(_RESPONSE.replace("v_values", "checked_values"))
    cleaned = responses.with_extraction(answered)
    return cleaned.select(
        "path", "fields.shipper", "fields.consignee", "fields.vessel",
        F.col("fields.gross_weight").alias("weight"),
    )


@query(
    "shipment_prompt_text",
    r"""SELECT m.email_id, md5('Subject: ' || trim(m.subject) || chr(10) || chr(10) || 'Body:'
        || chr(10) || trim(m.body)) AS prompt, d.role, CASE WHEN d.text <> ''
        THEN md5('Document Type: ' || d.role || chr(10)
        || chr(10) || 'Document Text Content:' || chr(10) || left(d.text, 4000)) END AS document_prompt
    FROM v_mail m JOIN v_doc_text d ON d.k = m.k""",
)
def shipment_prompt_text(spark, sf):
    texts = view(spark, sf, "v_doc_text").select("k", "role", "text")
    both = view(spark, sf, "v_mail").join(texts, "k")
    return both.select(
        "email_id",
        "role",
        F.md5(X.shipment_prompt(F.col("subject"), F.col("body"))).alias("prompt"),
        F.md5(X.document_prompt(F.col("text"), F.col("role"))).alias("document_prompt"),
    )


@query(
    "field_title",
    """SELECT path, array_to_string(list_transform(string_split(field, '_'),
        lambda w: upper(w[1]) || w[2:]), ' ') AS title,
      CASE WHEN value = '' THEN '—' ELSE value END AS shown FROM v_field""",
)
def field_title(spark, sf):
    return view(spark, sf, "v_field").select(
        "path",
        X.field_title(F.col("field")).alias("title"),
        X.or_dash(F.col("value")).alias("shown"),
    )


@query("category_map", "SELECT email_id, upper(lower(category)) AS category FROM v_pred")
def category_map(spark, sf):
    return view(spark, sf, "v_pred").select(
        "email_id", X.category_name(F.lower("category")).alias("category")
    )


@query(
    "line_variants",
    r"""SELECT path, line, CASE WHEN regexp_matches(line, '(?i)^total\s+')
        THEN line || '|' || regexp_replace(line, '(?i)^total\s+', '') ELSE line END AS variants
    FROM (SELECT path, trim(unnest(string_split(text, chr(10)))) AS line FROM v_doc_text) a
    WHERE line <> ''""",
)
def line_variants(spark, sf):
    docs = view(spark, sf, "v_doc_text").select("path", "text")
    lines = extract.document_lines(docs, folded=False).select("path", X.strip(F.col("raw")).alias("line"))
    return lines.where(F.col("line") != "").select(
        "path", "line", F.array_join(extract.line_variants(F.col("line")), "|").alias("variants")
    )
