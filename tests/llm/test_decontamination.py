"""Copies that templates alone do not show: other case, numbers, long and short items, no id."""

from __future__ import annotations

from pyspark.sql import functions as F

from freightaudit.llm import decontaminate


def found(spark, items: list[tuple], texts: list[str]) -> set:
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = decontaminate.contaminated(docs, bench).collect()
    kept = {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
    assert kept == set(range(len(texts))) - {r.doc_id for r in rows}
    assert len(rows) == len({(r.doc_id, r.item_id) for r in rows})
    return {(r.doc_id, r.item_id) for r in rows}


def test_passages_in_any_case(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet")
    rows = decontaminate.contaminated(docs, bench).collect()
    held = docs.join(bench.select("item_id", F.lower("text").alias("item")),
                     F.contains(F.lower("text"), F.col("item")))
    want = {(r.doc_id, r.item_id) for r in held.select("doc_id", "item_id").collect()}
    assert {(1699, 130), (6420, 37), (8376, 101)} <= want
    assert {(r.doc_id, r.item_id) for r in rows} == want


def test_other_numbers_in_capitals(spark):
    item = "Then Anna Berg takes {} kg of rice and {} of the bags to Port Said, so {} bags are left"
    texts = [item.format(12, 3, 3), item.format(12, 3, 3).upper(), item.format(40, 7, 7).upper()]
    texts.append(item.format(40, 7, 8).upper())  # not one to one
    assert found(spark, [(1, item.format(12, 3, 3))], texts) == {(0, 1), (1, 1), (2, 1)}


def test_items_of_placeholders(spark):
    items = [
        (1, "12 + 7 - 3 = 16 or 17?"),
        (2, "3.5 4.25 9 11 2 8 6 1 0 5 7 13 21 34"),
        (3, "of Anna Berg, Carl Diaz, Eva Falk, Gus Hahn, Ida Jung, Kim Lund, Mia Nagy, Ole Pohl"),
    ]
    texts = ["so: " + text + " end" for _, text in items]
    texts += ["12 + 7 - 3 = 16 or 18?", "3.5 4.25 9 11 3 8 6 2 0 5 7 14 21 34"]
    texts += ["of Ann B, Cid D, Ed Fox, Gil Ho, Ira J, Kay Low, May Nil, Oz Pie", texts[2].upper()]
    assert found(spark, items, texts) == {(0, 1), (1, 2), (2, 3), (6, 3)}


def test_passages_of_long_items_and_short_items(spark):
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    items = [(1, " ".join(words)), (2, "12 sheep"), (3, "7"), (4, "Ewe")]
    texts = [
        "before " + " ".join(words[70:130]) + " after",
        " ".join(words[70:83]),
        " ".join(words[70:82]),
        " ".join(words[i] for i in range(0, 200, 2)),
        "there are 12 sheep", "there are 13 sheep", "there are 7", "there are 8", "an ewe", "few",
    ]
    assert found(spark, items, texts) == {(0, 1), (1, 1), (4, 2), (6, 3), (8, 4)}


def test_items_without_id_or_with_one_id(spark):
    one = "the keeper of the mill counts every sack that leaves before the bell rings at night"
    two = "nine villages by the river send their grain to be ground before the first snow falls"
    texts = [one, "see: " + two, one + " and " + two, "neither"]
    assert found(spark, [(None, one), (None, one), (5, two)], texts) == {
        (0, None), (1, 5), (2, None), (2, 5),
    }
    assert found(spark, [(5, one), (5, two)], texts[:2]) == {(0, 5), (1, 5)}
