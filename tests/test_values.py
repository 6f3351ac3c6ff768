"""Scalar functions against values worked out by hand."""

import unicodedata
from decimal import Decimal

from pyspark.sql import functions as F

from freightaudit.functions import text as X
from freightaudit.functions import values as V
from freightaudit.functions.pyudf import COLON_LIKE


def apply(spark, fn, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    return [r[0] for r in rows.select(fn(F.col("v")).alias("x"), "i").orderBy("i").select("x").collect()]


def test_fold(spark):
    texts = ["ABC", "Straße", "ＡＢ１", "ﬁne № 5", "É", None, "6 × 40"]
    expected = [None if t is None else unicodedata.normalize("NFKC", t).casefold() for t in texts]
    assert apply(spark, X.fold_text_full, texts) == expected
    words = [None if t is None else "".join(c if c.isascii() else " " for c in t) for t in expected]
    folded = apply(spark, X.fold_text, texts)
    assert [None if t is None else "".join(c if c.isascii() else " " for c in t) for t in folded] == words


def test_colon_like_characters_are_complete():
    found = {
        chr(i)
        for i in range(0x80, 0x110000)
        if not 0xD800 <= i < 0xE000 and ":" in unicodedata.normalize("NFKC", chr(i))
    }
    assert found == set(COLON_LIKE)


def test_folding_makes_no_line_break():
    breaks = set("\n\r\x0b\x0c\x1c\x1d\x1e\x85  ")
    for i in range(0x80, 0x110000):
        if not 0xD800 <= i < 0xE000 and chr(i) not in breaks:
            assert not breaks & set(unicodedata.normalize("NFKC", chr(i)).casefold())


def test_plain_ranges_fold_without_tables():
    for first, last in ((0xC0, 0xDE), (0xE0, 0xFE), (0x410, 0x44F), (0x4E00, 0x9FFF)):
        for i in range(first, last + 1):
            if i not in (0xD7, 0xDF, 0xF7):
                folded = unicodedata.normalize("NFKC", chr(i)).casefold()
                assert not any(c.isascii() for c in folded), hex(i)


def test_missing(spark):
    values = ["", None, " TBA ", "t b c", "N/A", "____", "??.-", "____MT", "kgs", "0", "none", "nope"]
    expected = [True] * 9 + [False, True, False]
    assert apply(spark, V.is_missing_value, values) == expected


def test_text_value(spark):
    values = ["A & B Pty. Ltd", "N/A", "中文", "Ｆｕｌｌ Width", None]
    assert apply(spark, V.normalise_text_value, values) == ["aandbptyltd", None, None, "fullwidth", None]


def test_container_count(spark):
    values = ["6 x 40'HC", "6x40'HC", "6×40", "12", "No 7 of 9", "TBA", "x", None]
    got = apply(spark, V.normalise_container_count, values)
    assert got == [6, None, 6, 12, 7, None, None, None]
    glued = apply(spark, lambda c: V.normalise_container_count(c, glued_units=True), ["6x40'HC"])
    assert glued == [6]


def test_weight(spark):
    values = ["131,058 KG", "131058", "138 MT", "138MT", "1.5 tonnes", "A12", "____MT", "12 345.60 kgs"]
    got = apply(spark, lambda c: V.json_value(V.normalise_weight_kg(c)), values)
    assert got == ["131058", "131058", "138000", "138", "1500", None, None, "12345.6"]
    assert apply(spark, lambda c: V.normalise_weight_kg(c, glued_units=True), ["138MT"]) == [Decimal(138000)]


def test_lines(spark):
    values = ["a\r\nb\n", "", "a b\x0bc", "\n\n", "x"]
    assert apply(spark, X.split_lines, values) == [["a", "b"], [], ["a", "b", "c"], ["", ""], ["x"]]
    assert [v.splitlines() for v in values] == apply(spark, X.split_lines, values)


def test_boilerplate(spark):
    values = ["Hi\nBest Regards,\nX", "a\n______\nold", "a\n-----Original Message-----\nb", "regards to you", "Regards"]
    assert apply(spark, X.remove_boilerplate, values) == ["Hi\n", "a\n", "a\n", "regards to you", ""]


def test_decode(spark):
    rows = spark.createDataFrame([(bytearray(b"a\xffb"),), (bytearray("é".encode()),)], "c BINARY")
    got = [r[0] for r in rows.select(X.decode_text(F.col("c"))).collect()]
    assert got == ["a�b", "é"]


def test_lenient(spark):
    rows = spark.createDataFrame(
        [
            ("gross_weight_kg", "138 MT", "138,000.4 KGS", True),
            ("gross_weight_kg", "138 M/T", "137998", False),
            ("gross_weight_kg", "about", "ABOUT ", True),
            ("container_count", "6 x 40", "6", True),
            ("container_count", "6", "7", False),
            ("shipper", "Acme, Ltd", "LTD acme", True),
            ("shipper", "Acme", None, True),
            ("shipper", "...", "Acme", True),
            ("shipper", "Acme", "Acme Two", False),
        ],
        "field STRING, a STRING, b STRING, expected BOOLEAN",
    )
    got = rows.select(V.lenient_equal(F.col("field"), F.col("a"), F.col("b")).alias("x"), "expected")
    assert all(r["x"] == r["expected"] for r in got.collect())


def test_missing_words_and_numbers_are_worked_out_once(spark):
    texts = [
        None, "", " \t", "t b a", "n / a", "n/a.", "-- k g s", "__ mt", "kgs", "m t s", "kgx",
        "no ne", "none?", "?? .-", "tbak", "n", "mill", "-kg-", "kg kg",
    ]
    missing = [True] * 5 + [False] + [True] * 4 + [False, True, False, True] + [False] * 5
    assert apply(spark, V.folded_missing, texts) == missing
    values = [None, "", "007.50 mt", "1,234.500 kg", "0", "000", "x", "5.0", "٣٫ mt", "12 34 mt"]
    rows = spark.range(1).select(V.folded_weight_text(F.lit("007.50 mt")).alias("weight"))
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract") == 1
    got = apply(spark, V.folded_weight_text, values)
    assert got == [None, None, "7500", "1234.5", "0", "0", None, "5", "3000", "1234000"]


def test_values_that_python_folds_are_formed(spark):
    for form, want in (
        (V.normalise_text_value, "mill1"),
        (lambda v: V.normalise_field_value(F.lit("shipper"), v), "mill1"),
        (lambda v: V.normalise_field_value(F.lit("gross_weight_kg"), v), "1"),
        (lambda v: V.normalise_container_count(v).cast("string"), "1"),
        (lambda v: V.normalise_weight_kg(v).cast("int").cast("string"), "1"),
    ):
        assert apply(spark, form, ["Millé １"]) == [want]
