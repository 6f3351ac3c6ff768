"""Inputs that the registered queries do not contain."""

import decimal
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from freightaudit.functions import values as V
from freightaudit.operators import joins, rules
from freightaudit.schemas import MAIL
from freightaudit.sources import attachments, inbox, office, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "raw, names",
    [
        ('["a_SI.txt", "b_BL.txt"]', ["a_SI.txt", "b_BL.txt"]),
        ('[{"role":"si","path":"x_SI.txt"},{"type":"bl","filename":"y_BL.txt"}]',
         ["x_SI.txt", "y_BL.txt"]),
        ('{"si":"p.txt","bill_of_lading":"q.txt"}', ["p.txt", "q.txt"]),
        ('["a", {"file":"b"}, {"other":1}, null]', ["a", "b"]),
        ("[]", []), (None, []), ("not json", []), ("7", []),
    ],
)
def test_attachment_shapes(spark, raw, names):
    assert one(spark, inbox.attachment_names(F.lit(raw).cast("string"))) == names


def test_paths_are_relative_to_the_whole_root(spark, tmp_path):
    root = tmp_path / "attachments" / "run" / "attachments"
    root.mkdir(parents=True)
    (root / "m_SI.txt").write_text("x")
    assert [r.path for r in attachments.scan_attachments(spark, str(root)).collect()] == ["m_SI.txt"]


def test_word_cells(spark):
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = "<w:tc>{}<w:p><w:r><w:t>{}</w:t>{}<w:t>{}</w:t></w:r></w:p></w:tc>"
    row = cell.format("", "Gross", "<w:tab/>", "Weight") + cell.format(
        '<w:tcPr><w:gridSpan w:val="2"/></w:tcPr>', "BLUE CO", "<w:br/>", "12 Quay"
    )
    body = f"<w:document {space}><w:body><w:tbl><w:tr>{row}</w:tr></w:tbl></w:body></w:document>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", body)
    files = spark.createDataFrame([("a.docx", bytearray(out.getvalue()))], "path string, content binary")
    assert office.office_cells(files).first().cells == ["Gross\tWeight", "BLUE CO\n12 Quay", "BLUE CO\n12 Quay"]


def test_numbers_are_exact(spark):
    def weight(text):
        return one(spark, V.normalise_field_value(F.lit("gross_weight_kg"), F.lit(text)))

    assert weight("1.00000000001 kg") != weight("1.00000000002 kg")
    assert weight("123456789012345678901234567890 kg") == "123456789012345678901234567890"
    assert weight("1.5 MT") == weight("1,500.000 KG") == "1500"
    assert weight("0.0005 mt") == "0.5" and weight("007 kg") == "7" and weight("٣٤ kg") == "34"
    assert weight("TBA") is None
    for text, plain in (("100", "100"), ("1.500", "1.5"), ("0.000000001", "0.000000001"),
                        ("-0.25", "-0.25"), ("0", "0"), ("-120.0", "-120")):
        assert one(spark, V.json_value(F.lit(decimal.Decimal(text)))) == plain


def test_a_run_written_again_replaces_itself(spark):
    folder = sinks.shared_folder(spark)
    rows = spark.createDataFrame([(1,), (2,)], "email_id long")
    for run in ("a", "b", "a"):
        sinks.write_decisions(rows, folder, run)
    assert spark.read.parquet(folder).groupBy("run_id").count().collect().__len__() == 2
    assert spark.read.parquet(folder).count() == 4


def test_requests_and_responses(spark):
    mail = ("m1", "a@b.c", "hello", "x" * 9000, ['q"\\.txt', "é.txt"])
    mails = spark.createDataFrame([mail], MAIL)
    prompt = rules.llm_request_rows(mails).first().prompt
    assert prompt.endswith("x" * 9000) and r'["q\"\\.txt", "\u00E9.txt"]' in prompt
    assert rules.llm_request_rows(mails, 10).first().prompt.endswith("\n" + "x" * 10)
    good, bad = '{"category": "spam"}', '{"category": "spam"} trailing'
    assert one(spark, rules.parse_llm_category(F.lit(good))) == "SPAM"
    assert one(spark, rules.parse_llm_category(F.lit(bad))) is None


def test_no_text_goes_through_the_joins_of_the_cascade(spark):
    from freightaudit.plans.audit import narrow_mails

    mails = spark.createDataFrame([("m1", "a@b.c", "hello", "body", ["x_SI.txt"])], MAIL)
    chances = spark.createDataFrame([("m1", {"SPAM": 0.9})], "email_id string, probabilities map<string,double>")
    answers = spark.createDataFrame([("m1", '{"category": "spam"}')], "email_id string, response string")
    plan = narrow_mails(mails, chances, answers)
    lines = plan._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, line in enumerate(lines) if "Join LeftOuter" in line)
    below = next(line for line in lines[join:] if "Project" in line)
    assert "body#" not in below.split("AS")[0] and plan.first().category == "SPAM"


def test_hot_keys_are_exact(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 600, 1).otherwise(F.col("id")).alias("k"))
    assert [r.k for r in joins.hot_keys(rows, "k", min_rows=100).collect()] == [1]


def test_written_tables_need_a_shared_folder():
    class Bare:
        conf = type("C", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError):
        sinks.shared_folder(Bare())
