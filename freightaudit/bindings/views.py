"""Freight mail derived from the order tables, as SQL both Spark and the checker understand.

Each order with lines becomes a shipment, a pair of documents and a mail.  What the engine
must recover from the text is known here from columns, which is what makes the results
checkable.  ``ARRAY_OF(...)`` stands for the array constructor of the dialect.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from freightaudit import dims

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

STR = "CAST({} AS STRING)"
NL = "chr(10)"


def s(expr: str) -> str:
    return STR.format(expr)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick(choices: list[str], selector: str) -> str:
    """CASE over ``selector % n``; ``choices`` are SQL expressions."""
    arms = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(choices[:-1]))
    return f"(CASE ({selector}) % {len(choices)} {arms} ELSE {choices[-1]} END)"


def label(field: str, selector: str) -> str:
    return pick([q(a) for a in dims.FIELD_ALIASES[field]], selector)


def count_text(count: str, form: str) -> str:
    return pick(
        [
            f"concat({s(count)}, {q(' x 40')}, chr(39), 'HC')",
            s(count),
            f"concat({s(count)}, ' x 20', chr(39), 'FCL')",
        ],
        form,
    )


def weight_text(tonnes: str, half: str, form: str) -> str:
    return pick(
        [
            f"concat({s(tonnes)}, CASE WHEN {half} THEN ',500 KG' ELSE ',000 KG' END)",
            f"concat({s(tonnes)}, CASE WHEN {half} THEN '500' ELSE '000' END)",
            f"concat({s(tonnes)}, CASE WHEN {half} THEN '.5 MT' ELSE ' MT' END)",
            f"concat({s(tonnes)}, CASE WHEN {half} THEN ',500 KGS' ELSE ',000 KGS' END)",
        ],
        form,
    )


BLANK_TOKENS = ["'TBA'", "'N/A'", "'____'", "'???'", "' '", "'____MT'"]

_SHIPMENT = """
SELECT o.o_orderkey AS k, s.s_name AS shipper, c.c_name AS consignee,
       CASE WHEN o.o_orderkey % 10 < 3 THEN c2.c_name ELSE c.c_name END AS notify_party,
       sn.n_name AS port_of_loading, cn.n_name AS port_of_discharge,
       xn.n_name AS other_port, l.n AS container_count, l.tonnes AS tonnes
FROM orders o
JOIN (SELECT l_orderkey, min(l_suppkey) AS sk, count(*) AS n,
             CAST(sum(l_quantity) AS BIGINT) AS tonnes
      FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
JOIN supplier s ON s.s_suppkey = l.sk
JOIN customer c ON c.c_custkey = o.o_custkey
JOIN customer c2 ON c2.c_custkey = (o.o_custkey + 1) % (SELECT count(*) FROM customer)
JOIN nation sn ON sn.n_nationkey = s.s_nationkey
JOIN nation cn ON cn.n_nationkey = c.c_nationkey
JOIN nation xn ON xn.n_nationkey = (c.c_nationkey + 1) % (SELECT count(*) FROM nation)
"""

# The orders that are shipments, where nothing but the key is needed.
_KEY = "SELECT o_orderkey AS k FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)"

# Both documents of a shipment, long: one row per (order, role) with the true values.
_SIDES = """
SELECT k, 'SI' AS role, 0 AS side, shipper, consignee, notify_party, port_of_loading,
       port_of_discharge, container_count, tonnes, FALSE AS half
FROM v_shipment
UNION ALL
SELECT k, 'BL' AS role, 1 AS side, shipper, consignee, notify_party, port_of_loading,
       CASE WHEN k % 13 = 0 THEN other_port ELSE port_of_discharge END AS port_of_discharge,
       container_count + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS container_count,
       tonnes, k % 11 = 0 AS half
FROM v_shipment
"""


def _values() -> str:
    """Label and value text per field and document, wide."""
    sel = "k + 3 * side"
    columns = []
    for i, field in enumerate(dims.FIELDS):
        columns.append(f"{label(field, f'{sel} + {i}')} AS l_{field}")
    blank = pick(BLANK_TOKENS, "k")
    values = {
        "shipper": "shipper",
        "consignee": f"CASE WHEN side = 0 AND k % 97 = 1 THEN {blank} ELSE consignee END",
        "notify_party": "CASE WHEN side = 1 THEN upper(notify_party) ELSE notify_party END",
        "port_of_loading": "port_of_loading",
        "port_of_discharge": "port_of_discharge",
        "container_count": count_text("container_count", "k + side"),
        "gross_weight_kg": weight_text("tonnes", "half", "k + 2 * side"),
    }
    columns += [f"{expr} AS v_{field}" for field, expr in values.items()]
    return (
        "SELECT k, role, side, "
        f"concat('attachments/mail_', {s('k')}, '_', role, '.txt') AS path, "
        + ", ".join(columns)
        + " FROM v_sides"
    )


def _doc_text() -> str:
    """The document texts; some have no colon after the label, some say TOTAL first."""
    colon = "CASE WHEN k % 5 = 4 THEN ' ' ELSE ': ' END"
    title = (
        "CASE WHEN side = 1 AND k % 97 = 2 THEN 'PACKING LIST' WHEN side = 1 THEN "
        "'BILL OF LADING (DRAFT)' ELSE 'SHIPPING INSTRUCTION' END"
    )
    lines = [title, "'========================================'", "''"]
    for field in dims.FIELDS:
        total = (
            "CASE WHEN k % 6 = 0 THEN 'TOTAL ' ELSE '' END, " if field == dims.WEIGHT_FIELD else ""
        )
        lines.append(f"concat({total}l_{field}, {colon}, v_{field})")
        if field == "shipper":
            lines.append(f"concat('  Unit ', {s('k % 90 + 1')}, ', Quay Road; Harbour Town')")
    lines += [
        f"concat('Vessel: MV SAMPLE ', {s('k % 40')})",
        f"concat('Voyage: V', {s('k % 400')})",
        "'NET WEIGHT: 17'",
        f"concat('B/L No.: BL', {s('k')})",
        "'HS Code: 48105900'",
        "'Freight: PREPAID'",
    ]
    text = f"concat_ws({NL}, {', '.join(lines)})"
    return (
        f"SELECT k, role, side, path, CASE WHEN side = 1 AND k % 97 = 4 THEN '' ELSE {text} END "
        "AS text FROM v_values WHERE NOT (side = 1 AND k % 97 = 3)"
    )


def _mail() -> str:
    k = s("k")
    reply = "CASE WHEN k % 4 = 0 THEN 'RE: ' WHEN k % 4 = 1 THEN 'RE_' ELSE '' END"
    subjects = {
        "k % 10 < 3": f"concat('Confirm docs _ draft BL for shipment ', {k})",
        "k % 10 = 3": f"concat('Verify the BL against SI ', {k})",
        "k % 10 < 6": f"concat('Request SI for booking ', {k})",
        "k % 10 < 8": f"concat('Invoice query ', {k})",
        "k % 10 = 8": f"concat('Daily berthing report ', {k})",
    }
    bodies = {
        "k % 10 < 3": (
            f"concat('Attached are the SI and draft BL for shipment ', {k}, "
            "'. Please check the details and confirm.')"
        ),
        "k % 20 = 3": "'Please compare the SI and draft BL and verify that it matches the SI.'",
        "k % 10 = 3": "'Please check the draft BL and amend BL details where needed.'",
        "k % 10 < 6": (
            "'The shipping instruction is needed. Kindly send the SI and revert with draft BL.'"
        ),
        "k % 10 < 8": "'There are local charges missing on it. What is the invoice amount?'",
        "k % 10 = 8": "'Vessel schedule and operations update: loading completed, rest pending.'",
    }

    def case(arms: dict[str, str], other: str) -> str:
        return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in arms.items()) + f" ELSE {other} END"

    tail = (
        f"CASE WHEN k % 6 = 5 THEN concat({NL}, '-----Original Message-----', {NL}, "
        "'You have won a prize, claim your gift card') ELSE '' END"
    )
    body = (
        f"concat('Hello,', {NL}, {NL}, "
        + case(bodies, "'Claim your gift card today: click here, guaranteed returns.'")
        + f", {NL}, {NL}, 'Best Regards,', {NL}, 'Desk ', {s('k % 17')}, ' invoice survey', {tail})"
    )
    domain = pick(["'harbour.example'", "'carrier.example.com'", "'broker.example.org'"], "k")
    path = f"concat('attachments/mail_', {k}, '_"
    both = f"ARRAY_OF({path}SI.txt'), {path}BL.txt'))"
    one = f"ARRAY_OF({path}SI.txt'))"
    subject = case(subjects, f"concat('You have won a prize ', {k})")
    return (
        f"SELECT k, concat('mail_', {k}) AS email_id, "
        f"concat('desk', {s('k % 17')}, '@', {domain}) AS \"from\", "
        f"concat({reply}, {subject}) AS subject, {body} AS body, "
        f"CASE WHEN k % 20 = 2 THEN {one} WHEN k % 10 < 3 THEN {both} "
        "ELSE CAST(ARRAY_OF() AS STRING_ARRAY) END AS attachments FROM v_key"
    )


# What the audit must find, from columns alone.
_AUDIT = """
SELECT email_id, category, status, review_reason, defects,
       status = 'MISMATCH' AS has_defect
FROM (
  SELECT concat('mail_', CAST(k AS STRING)) AS email_id,
    CASE WHEN k % 10 < 4 THEN 'BL_COMPARISON' WHEN k % 10 < 6 THEN 'SI_REQUEST'
         WHEN k % 10 < 8 THEN 'INVOICE_QUERY' WHEN k % 10 = 8 THEN 'GENERAL'
         ELSE 'SPAM' END AS category,
    CASE WHEN k % 20 IN (2, 3) THEN 'NEEDS_REVIEW' WHEN k % 10 >= 3 THEN 'OK'
         WHEN k % 97 IN (1, 2, 3, 4) THEN 'NEEDS_REVIEW'
         WHEN k % 7 = 0 OR k % 11 = 0 OR k % 13 = 0 THEN 'MISMATCH' ELSE 'OK' END AS status,
    CASE WHEN k % 20 IN (2, 3) THEN 'missing_attachment' WHEN k % 10 >= 3 THEN NULL
         WHEN k % 97 = 1 THEN 'missing_value' WHEN k % 97 = 2 THEN 'wrong_doc_type'
         WHEN k % 97 IN (3, 4) THEN 'unreadable' END AS review_reason,
    CASE WHEN k % 20 IN (2, 3) OR k % 10 >= 3 OR k % 97 IN (1, 2, 3, 4) THEN ''
         ELSE concat_ws(',', CASE WHEN k % 13 = 0 THEN 'port_of_discharge' END,
                             CASE WHEN k % 7 = 0 THEN 'container_count' END,
                             CASE WHEN k % 11 = 0 THEN 'gross_weight_kg' END) END AS defects
  FROM v_key) a
"""

# Events as labels and decisions: the type is the label, every ninth decision is off by one.
_CATEGORY_OF = (
    "CASE {} WHEN 'click' THEN 'BL_COMPARISON' WHEN 'error' THEN 'SI_REQUEST' "
    "WHEN 'purchase' THEN 'INVOICE_QUERY' WHEN 'signup' THEN 'GENERAL' ELSE 'SPAM' END"
)
_NEXT_CATEGORY_OF = (
    "CASE {} WHEN 'click' THEN 'SI_REQUEST' WHEN 'error' THEN 'INVOICE_QUERY' "
    "WHEN 'purchase' THEN 'GENERAL' WHEN 'signup' THEN 'SPAM' ELSE 'BL_COMPARISON' END"
)

_TRUTH = f"""
SELECT event_id AS k, concat('ev_', CAST(event_id AS STRING)) AS email_id, category,
  CASE WHEN category <> 'BL_COMPARISON' THEN 'OK' WHEN value < 10 THEN 'NEEDS_REVIEW'
       WHEN value < 60 THEN 'MISMATCH' ELSE 'OK' END AS status,
  CASE WHEN category = 'BL_COMPARISON' AND value < 10 THEN
    {pick(["'wrong_doc_type'", "'missing_attachment'", "'unreadable'", "'missing_value'"], "event_id")}
  END AS review_reason,
  category = 'BL_COMPARISON' AND value >= 10 AND value < 60 AS has_defect,
  CASE WHEN category = 'BL_COMPARISON' AND value >= 10 AND value < 60 THEN
    CASE WHEN value < 30 THEN ARRAY_OF('consignee') WHEN value < 45 THEN
      ARRAY_OF('consignee', 'gross_weight_kg') ELSE ARRAY_OF('container_count') END
  ELSE CAST(ARRAY_OF() AS STRING_ARRAY) END AS defect_fields
FROM (SELECT event_id, value, {_CATEGORY_OF.format("event_type")} AS category FROM events) e
"""

_PRED = f"""
SELECT k, email_id, user_id, subject, category, status, review_reason, has_defect, defect_fields,
  CASE WHEN k % 3 = 0 THEN 'rule' WHEN k % 3 = 1 THEN 'model' END AS decided_by,
  CASE k % 4 WHEN 0 THEN 'attachment_pair' WHEN 1 THEN 'ml_model' WHEN 2 THEN 'llm'
       ELSE 'keyword_fallback' END AS source,
  CASE WHEN k % 4 = 3 THEN NULL ELSE CAST(k % 101 AS DOUBLE) END AS confidence_percent,
  k % 8 = 0 AS ambiguous
FROM (
  SELECT t.k, t.email_id, e.user_id,
    concat('Shipment ', CAST(t.k AS STRING), ' of desk ', CAST(e.user_id AS STRING)) AS subject,
    CASE WHEN t.k % 9 = 0 THEN {_NEXT_CATEGORY_OF.format("e.event_type")} ELSE t.category END
      AS category,
    CASE WHEN t.k % 7 = 0 THEN 'OK' WHEN t.k % 11 = 0 THEN 'NEEDS_REVIEW' ELSE t.status END
      AS status,
    CASE WHEN t.k % 7 <> 0 AND t.k % 11 = 0 THEN 'unreadable' WHEN t.k % 7 = 0 THEN NULL
         ELSE t.review_reason END AS review_reason,
    CASE WHEN t.k % 7 = 0 OR t.k % 11 = 0 THEN FALSE ELSE t.has_defect END AS has_defect,
    CASE WHEN t.k % 7 = 0 OR t.k % 11 = 0 THEN CAST(ARRAY_OF() AS STRING_ARRAY)
         WHEN t.k % 6 = 0 AND t.has_defect THEN ARRAY_OF('consignee', 'shipper')
         ELSE t.defect_fields END AS defect_fields
  FROM v_truth t JOIN events e ON e.event_id = t.k
  WHERE t.k % 50 <> 0) p
"""

_ACTIONS = """
SELECT concat('ev_', CAST(user_id AS STRING)) AS email_id, ts,
  CASE WHEN event_type IN ('click', 'view') THEN 'approve' WHEN event_type = 'error' THEN 'open'
       ELSE 'escalate' END AS action,
  CASE WHEN event_id % 3 = 0 THEN concat('checked ', CAST(event_id AS STRING)) ELSE '' END AS notes
FROM events
"""


def _field() -> str:
    """Labels and values long: one row per document and field."""
    constants = ", ".join(f"({i}, {q(f)})" for i, f in enumerate(dims.FIELDS))

    def case(prefix: str) -> str:
        arms = " ".join(f"WHEN {i} THEN {prefix}_{f}" for i, f in enumerate(dims.FIELDS))
        return f"CASE f.i {arms} END"

    return (
        f"SELECT k, role, side, path, f.i AS field_ord, f.field, {case('l')} AS label, "
        f"{case('v')} AS value FROM v_values, (VALUES {constants}) AS f(i, field)"
    )


VIEWS = {
    "v_key": _KEY,
    "v_shipment": _SHIPMENT,
    "v_sides": _SIDES,
    "v_values": _values(),
    "v_field": _field(),
    "v_doc_text": _doc_text(),
    "v_mail": _mail(),
    "v_audit": _AUDIT,
    "v_truth": _TRUTH,
    "v_pred": _PRED,
    "v_actions": _ACTIONS,
}

_DIALECT = {
    "spark": {"ARRAY_OF(": "array(", "STRING_ARRAY": "ARRAY<STRING>", '"from"': "`from`"},
    "checker": {
        "ARRAY_OF(": "list_value(",
        "STRING_ARRAY": "VARCHAR[]",
        # the same rows (the key is unique); the checker's own dictionary cache fails without it
        "FROM orders o\n": (
            "FROM (SELECT o_orderkey, max(o_custkey) AS o_custkey FROM orders GROUP BY o_orderkey) o\n"
        ),
    },
}


def _needed(sql: str) -> list[str]:
    """Views a statement uses, directly or not, in definition order."""
    found: set[str] = set()
    stack = [sql]
    while stack:
        for name in set(re.findall(r"\bv_[a-z]+(?:_text)?\b", stack.pop())) & set(VIEWS):
            if name not in found:
                found.add(name)
                stack.append(VIEWS[name])
    return [name for name in VIEWS if name in found]


#: Narrow rows that others make texts of; they are dealt evenly to tasks before that.  Their own
#: input is small in bytes, so it would come in few partitions.
_SPREAD = ("v_key", "v_shipment", "v_truth")


def _definition(name: str, tasks: int | None) -> str:
    if tasks is None or name not in _SPREAD:
        return VIEWS[name]
    return f"SELECT /*+ REPARTITION({tasks}) */ * FROM ({VIEWS[name]}) AS spread_rows"


def with_views(sql: str, dialect: str, tasks: int | None = None) -> str:
    """``sql`` preceded by the view definitions it needs, dealt to so many ``tasks`` if given."""
    definitions = ",\n".join(f"{name} AS ({_definition(name, tasks)})" for name in _needed(sql))
    if definitions:
        extra = sql.lstrip()
        if extra.upper().startswith("WITH RECURSIVE"):
            sql = f"WITH RECURSIVE {definitions},\n" + extra[len("WITH RECURSIVE") :]
        elif extra.upper().startswith("WITH"):
            sql = f"WITH {definitions},\n" + extra[len("WITH") :]
        else:
            sql = f"WITH {definitions}\n{sql}"
    for placeholder, text in _DIALECT[dialect].items():
        sql = sql.replace(placeholder, text)
    return sql


def spread_tasks(spark: SparkSession) -> int:
    """How many tasks costly rows are dealt to: enough that no core waits for a long one."""
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(shuffled, 4 * spark.sparkContext.defaultParallelism)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame over the tables in ``sf_dir``."""
    sql = with_views(f"SELECT * FROM {name}", "spark", spread_tasks(spark))
    for base in TABLES:
        if re.search(rf"\b{base}\b", sql):
            table(spark, sf_dir, base).createOrReplaceTempView(base)
    return spark.sql(sql)


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_mail").drop("k")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as the engine reads them: path, text, read error."""
    from freightaudit.sources.attachments import with_read_status

    docs = view(spark, sf_dir, "v_doc_text").select("path", "text")
    return with_read_status(docs)
