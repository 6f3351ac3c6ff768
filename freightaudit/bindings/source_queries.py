"""Sources, sinks and the stream: derived data written to the shared folder and read back."""

from __future__ import annotations

import io
import zipfile
from datetime import timedelta

import pandas as pd
from pyarrow import fs
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from freightaudit import dims
from freightaudit.bindings.registry import query
from freightaudit.bindings.rule_queries import _RANKED
from freightaudit.bindings.views import documents, mails, view
from freightaudit.functions.text import decode_text
from freightaudit.operators import extract
from freightaudit.plans import audit
from freightaudit.sources import attachments, glyphs, inbox, office, sinks
from freightaudit.streaming import triage, waiting


def written_inbox(spark, sf):
    folder = sinks.shared_folder(spark)
    inbox.raw_json(mails(spark, sf)).write.text(folder)
    return folder


@query(
    "scan_inbox",
    """SELECT email_id, subject, md5(body) AS body, len(attachments) AS files FROM v_mail""",
)
def scan_inbox(spark, sf):
    raw = inbox.scan_inbox(spark, written_inbox(spark, sf), one_mail_per_file=False)
    return inbox.mails_from_raw(raw).select(
        "email_id", "subject", F.md5("body").alias("body"),
        F.size("attachments").cast("long").alias("files"),
    )


@query(
    "resolve_email_id",
    """SELECT CASE WHEN k % 5 = 0 THEN NULL ELSE email_id END AS email_id, subject,
      k % 5 = 0 AS quarantined FROM v_mail""",
)
def resolve_email_id(spark, sf):
    raw = view(spark, sf, "v_mail").select(
        F.expr("CASE WHEN k % 5 = 1 THEN email_id WHEN k % 5 = 2 THEN '' END").alias("email_id"),
        F.expr("CASE WHEN k % 5 IN (2, 3) THEN email_id END").alias("id"),
        F.expr("CASE WHEN k % 5 IN (3, 4) THEN email_id END").alias("message_id"),
        "subject",
    )
    good, quarantined = inbox.resolve_email_id(raw)
    return good.withColumn("quarantined", F.lit(False)).unionByName(
        quarantined.withColumn("quarantined", F.lit(True))
    )


@query("get_email", "SELECT email_id, subject, body FROM v_mail WHERE email_id = 'mail_42'")
def get_email(spark, sf):
    return inbox.get_email(mails(spark, sf), "mail_42").select("email_id", "subject", "body")


@query(
    "scan_attachments",
    """SELECT role, count(*) AS n FROM v_doc_text,
      LATERAL (SELECT unnest(string_split(text, chr(10))) AS line) l
    WHERE trim(line) <> '' GROUP BY role""",
)
def scan_attachments(spark, sf):
    """Documents of a role become attachment files; their bytes are read and split again."""
    folder = sinks.shared_folder(spark)
    texts = view(spark, sf, "v_doc_text").select("role", "text")
    # a file is read whole, so it stays small however many documents there are
    texts.write.option("maxRecordsPerFile", 5000).partitionBy("role").text(folder)
    files = attachments.scan_attachments(spark, folder, "*.txt")
    docs = files.select("path", decode_text(F.col("content")).alias("text"))
    lines = extract.document_lines(docs, folded=False).where(F.trim("raw") != "")
    role = F.regexp_extract("path", "role=([A-Z]+)/", 1)
    return lines.groupBy(role.alias("role")).agg(F.count("*").alias("n"))


def _xml(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")


@F.pandas_udf(BinaryType())
def workbook(labels: pd.Series, values: pd.Series) -> pd.Series:
    """Test data: a one-sheet workbook with two columns."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def build(names, texts) -> bytes:
        rows = "".join(
            f'<row r="{i}"><c r="A{i}" t="inlineStr"><is><t>{_xml(a)}</t></is></c>'
            f'<c r="B{i}" t="inlineStr"><is><t>{_xml(b)}</t></is></c></row>'
            for i, (a, b) in enumerate(zip(names, texts), start=1)
        )
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as archive:
            archive.writestr(
                "xl/workbook.xml",
                f'<workbook {ns} xmlns:r="{rel}"><sheets>'
                '<sheet name="Doc" sheetId="1" r:id="r1"/></sheets></workbook>',
            )
            archive.writestr(
                "xl/_rels/workbook.xml.rels",
                '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/>'
                "</Relationships>",
            )
            archive.writestr(
                "xl/worksheets/sheet1.xml",
                f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>",
            )
        return data.getvalue()

    return pd.Series([None if a is None else build(a, b) for a, b in zip(labels, values)])


def workbooks(spark, sf):
    """One workbook per document of the derived shipments."""
    rows = view(spark, sf, "v_values")
    return rows.select(
        F.regexp_replace("path", "txt$", "xlsx").alias("path"),
        workbook(
            F.array(*[F.col(f"l_{f}") for f in dims.FIELDS]),
            F.array(*[F.col(f"v_{f}") for f in dims.FIELDS]),
        ).alias("content"),
    )


@query(
    "office_cells_job",
    """SELECT replace(path, '.txt', '.xlsx') AS path, 'Doc' AS sheet, CAST(field_ord AS BIGINT)
      AS row_no, label, trim(value) AS value FROM v_field""",
)
def office_cells_job(spark, sf):
    cells = office.office_cells(workbooks(spark, sf))
    return cells.select(
        "path", "sheet", "row_no",
        F.col("cells")[0].alias("label"), F.col("cells")[1].alias("value"),
    )


@query(
    "sheet_text",
    """SELECT replace(path, '.txt', '.xlsx') AS path, md5('--- Sheet: Doc ---' || chr(10) ||
      string_agg(label || ',' || CASE WHEN contains(value, ',') THEN '"' || value || '"'
        ELSE trim(value) END, chr(10) ORDER BY field_ord) || chr(10)) AS text
    FROM v_field GROUP BY path""",
)
def sheet_text(spark, sf):
    texts = office.sheet_text(office.office_cells(workbooks(spark, sf)))
    return texts.withColumn("text", F.md5("text"))


@query(
    "audit_workbooks",
    "SELECT email_id, status, defects FROM v_audit",
)
def audit_workbooks(spark, sf):
    """The audit over workbooks: values come from table cells, not from text lines."""
    known = documents(spark, sf).where(F.col("error").isNull()).select(
        F.regexp_replace("path", "txt$", "xlsx").alias("path")
    )
    cells = sinks.stored(
        office.office_cells(workbooks(spark, sf).join(known, "path", "left_semi"))
    )
    titles = view(spark, sf, "v_doc_text").where("side = 1 AND k % 97 = 2").select(
        F.regexp_replace("path", "txt$", "xlsx").alias("path"),
        F.lit(99).cast("long").alias("line_no"),
        F.lit("PACKING LIST").alias("raw"),
    )
    renamed = F.transform("attachments", lambda a: F.regexp_replace(a, "txt$", "xlsx"))
    rows = audit.audit_mails(
        mails(spark, sf).withColumn("attachments", renamed),
        office.office_documents(cells),
        office.cell_pairs(cells),
        office.cell_lines(cells).unionByName(titles),
    )
    return rows.select(
        "email_id", "status", F.array_join("defect_fields", ",").alias("defects")
    )


def glyph_table(spark, sf):
    """Every character of label and value of the documents with a made-up place on a page."""
    rows = view(spark, sf, "v_field").select(
        F.regexp_replace("path", "txt$", "pdf").alias("path"),
        (F.col("field_ord") * 12.5 + 0.02).alias("top"),
        "label",
        F.trim("value").alias("value"),
    )

    def chars(text, font, start):
        return F.transform(
            F.sequence(F.lit(1), F.length(text)),
            lambda i: F.struct(
                (start + i * 4.0).alias("x0"),
                F.lit(font).alias("fontname"),
                F.substr(text, i, F.lit(1)).alias("ch"),
            ),
        )

    printed = F.concat(
        chars(F.col("value"), "Sans-Regular", F.lit(300.0)),
        chars(F.col("label"), "Sans-Bold", F.lit(20.0)),
    )
    return rows.select("path", F.lit(1).alias("page"), "top", F.explode(printed).alias("g")).select(
        "path", "page", "top", "g.*"
    )


@query(
    "glyph_pairs",
    """SELECT replace(path, '.txt', '.pdf') AS path, trim(label) AS label, trim(value) AS value
    FROM v_field WHERE trim(value) <> ''""",
)
def glyph_pairs(spark, sf):
    return glyphs.glyph_pairs(glyph_table(spark, sf)).select("path", "label", "value")


#: The four formats of the folder, by number of the mail.
FORMATS = ["txt", "xlsx", "docx", "pdf"]


def by_number(path):
    """``path`` with the suffix that the number in it stands for."""
    kind = F.get(F.array(*[F.lit(f) for f in FORMATS]), _number(path) % len(FORMATS))
    return F.concat(F.regexp_replace(path, "txt$", ""), kind)


def _number(path):
    return F.regexp_extract(path, r"mail_(\d+)_", 1).cast("int")


@F.pandas_udf(BinaryType())
def word_file(title: pd.Series, labels: pd.Series, values: pd.Series) -> pd.Series:
    """Test data: a title and a table of two columns."""
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'

    def paragraph(text: str) -> str:
        return f'<w:p><w:r><w:t xml:space="preserve">{_xml(text)}</w:t></w:r></w:p>'

    def build(title, names, texts) -> bytes:
        rows = "".join(
            f"<w:tr><w:tc>{paragraph(a)}</w:tc><w:tc>{paragraph(b)}</w:tc></w:tr>"
            for a, b in zip(names, texts, strict=True)
        )
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as archive:
            body = f"<w:body>{paragraph(title)}<w:tbl>{rows}</w:tbl></w:body>"
            archive.writestr("word/document.xml", f"<w:document {ns}>{body}</w:document>")
        return data.getvalue()

    rows = zip(title, labels, values, strict=True)
    return pd.Series([None if row[1] is None else build(*row) for row in rows])


def written_folder(spark, sf):
    """The documents as files of four formats, and one of a format without a reader."""
    folder = sinks.shared_folder(spark)
    texts = view(spark, sf, "v_doc_text").select("path", "text")
    rows = texts.join(view(spark, sf, "v_values"), "path")
    title = F.get(F.split("text", "\n"), F.lit(0))
    empty = F.col("text") == ""
    none = F.array().cast("array<string>")
    labels = F.when(empty, none).otherwise(F.array(title, *[F.col(f"l_{f}") for f in dims.FIELDS]))
    values = F.when(empty, none).otherwise(
        F.array(F.lit(""), *[F.col(f"v_{f}") for f in dims.FIELDS])
    )
    name = by_number(F.col("path"))
    rows = rows.select(name.alias("path"), "text", title.alias("title"), labels.alias("l"), values.alias("v"))
    kind = attachments.attachment_format(F.col("path"))

    def own(suffix, *columns):
        """Columns of files of a kind; NULL for the others, which are not built."""
        return [F.when(kind == suffix, c) for c in columns]

    word = own("docx", F.col("title"), F.slice("l", 2, 99), F.slice("v", 2, 99))
    content = F.coalesce(
        *own("txt", F.col("text").cast("binary")),
        workbook(*own("xlsx", F.col("l"), F.col("v"))),
        word_file(*word),
        *own("pdf", F.lit(b"%PDF-")),
    )
    files = rows.where(kind.isin(FORMATS)).select("path", content.alias("content"))
    odd = spark.createDataFrame([("attachments/readme.zip", bytearray(b"PK"))], files.schema)

    def write(batches):
        store, base = fs.FileSystem.from_uri(folder)
        made = set()
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                parent = f"{base}/{path}".rpartition("/")[0]
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                with store.open_output_stream(f"{base}/{path}") as out:
                    out.write(content)
            yield batch[["path"]]

    sinks.stored(files.unionByName(odd).mapInPandas(write, "path string"))
    return folder


def printed(spark, sf):
    """The glyphs of the documents that are printed, with their titles."""
    texts = view(spark, sf, "v_doc_text").where("text <> ''").select(
        F.regexp_replace("path", "txt$", "pdf").alias("path"),
        F.get(F.split("text", "\n"), F.lit(0)).alias("title"),
    )
    fields = glyph_table(spark, sf).join(texts.select("path"), "path", "left_semi")
    titles = texts.select("path", F.posexplode(F.split("title", "")).alias("at", "ch")).select(
        "path", F.lit(1).alias("page"), F.lit(-20.0).alias("top"),
        (F.col("at") * 4.0 + 20).alias("x0"), F.lit("Sans-Regular").alias("fontname"), "ch",
    )
    return fields.unionByName(titles)


@query("audit_folder", "SELECT email_id, status, defects FROM v_audit")
def audit_folder(spark, sf):
    """From a folder of four formats to decisions.  Some mails name files that are not there."""
    renamed = F.transform("attachments", by_number)
    rows = audit.audit_folder(
        mails(spark, sf).withColumn("attachments", renamed),
        written_folder(spark, sf),
        printed(spark, sf),
    )
    return rows.select(
        "email_id", "status", F.array_join("defect_fields", ",").alias("defects")
    )


@query(
    "write_decisions",
    "SELECT email_id, category, status, defects, 'r1' AS run_id FROM v_audit",
)
def write_decisions(spark, sf):
    folder = sinks.shared_folder(spark)
    audited = audit.audit_mails(mails(spark, sf), documents(spark, sf))
    sinks.write_decisions(audit.decisions(audited), folder, "r1")
    return spark.read.parquet(folder).select(
        "email_id", "category", "status",
        F.array_join("defect_fields", ",").alias("defects"),
        F.col("run_id").cast("string").alias("run_id"),
    )


_DECISION_ROWS = """SELECT email_id, category, status, review_reason,
  array_to_string(defect_fields, ',') AS defects, has_defect FROM {}"""


def _json_round_trip(spark, sf, name):
    folder = sinks.shared_folder(spark)
    rows = view(spark, sf, name).select(
        "email_id", "category", "status", "review_reason", "defect_fields", "has_defect"
    )
    sinks.write_submission_json(rows, folder)
    loaded = inbox.decisions_from_json(spark.read.text(folder))
    return loaded.select(
        "email_id", "category", "status", "review_reason",
        F.array_join("defect_fields", ",").alias("defects"), "has_defect",
    )


@query("load_truth", _DECISION_ROWS.format("v_truth"))
def load_truth(spark, sf):
    return _json_round_trip(spark, sf, "v_truth")


@query("load_submission", _DECISION_ROWS.format("v_pred"))
def load_submission(spark, sf):
    return _json_round_trip(spark, sf, "v_pred")


@query(
    "stream_triage",
    f"WITH {_RANKED} SELECT email_id, category, routing_reason FROM routed",
)
def stream_triage(spark, sf):
    source, out, checkpoint = written_inbox(spark, sf), *[sinks.shared_folder(spark) for _ in "oc"]
    stream = triage.read_mail_stream(spark, source)
    triage.stream_triage(stream, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select(
        "email_id", F.col("rule_category").alias("category"), "routing_reason"
    )


@query("stream_audit", "SELECT email_id, category, status FROM v_audit")
def stream_audit(spark, sf):
    source, out, checkpoint = written_inbox(spark, sf), *[sinks.shared_folder(spark) for _ in "oc"]
    facts = sinks.stored(extract.document_facts(documents(spark, sf)))
    stream = triage.read_mail_stream(spark, source)
    triage.stream_audit(stream, facts, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("email_id", "category", "status")


@query("stream_audit_waiting", "SELECT email_id, category, status FROM v_audit")
def stream_audit_waiting(spark, sf):
    """Mails come first, their documents in a later run, and a heartbeat when time is out."""
    source, out, checkpoint, kept = written_inbox(spark, sf), *[sinks.shared_folder(spark) for _ in "ock"]
    docs, folder = documents(spark, sf), sinks.shared_folder(spark)

    def audited(wait: timedelta) -> None:
        room = waiting.WaitingRoom(kept, wait)
        texts = spark.readStream.schema(docs.schema).parquet(folder)
        mail_stream = triage.read_mail_stream(spark, source)
        waiting.stream_audit_waiting(mail_stream, texts, room, out, checkpoint).awaitTermination()

    docs.limit(0).write.parquet(folder)
    audited(timedelta(days=1))
    docs.write.mode("append").parquet(folder)
    audited(timedelta(days=1))
    docs.limit(0).write.mode("append").parquet(folder)
    audited(timedelta(0))
    return spark.read.parquet(out).select("email_id", "category", "status")
