"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

#: A fixed passage for copies, and columns whose names operators use for themselves.
PASSAGE = (
    "the old mill by the river grinds flour for nine villages and its keeper counts every sack "
    "that leaves before the bell of the tower rings for the evening meal in the town"
)
EXTRA = ["key", "kind", "row", "fp", "text_hash", "score", "lang_pred", "host", "_doc", "_spans"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows() -> list[tuple]:
    rng = random.Random(5)
    words = ["river", "stone", "quietly", "Élan", "naïve", "of", "the", "été", "grün", "señor"]
    texts = [None, "", " ", "\n\t", "a", "Ab c", "7", "!!! ???", "one two", "it's", "x" * 5000]
    texts += [PASSAGE, PASSAGE, PASSAGE.upper(), PASSAGE + " today", "Now: " + PASSAGE]
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(20)]
    texts += [" ".join(rng.choices(words, k=30_000)), "word " * 20_000, "é😀 " * 300]
    found = [(i, t, ["en", "de", None][i % 3], "s", len(t or "")) for i, t in enumerate(texts)]
    found += [found[11], found[11], found[0], (None, PASSAGE, None, None, None)]
    return [*found, (None, None, None, None, None)]


def table(spark: SparkSession, extra: bool = False) -> DataFrame:
    made = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    if extra:
        made = made.selectExpr("*", *[f"'z' as `{c}`" for c in EXTRA])
    return made


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def collected(frame: DataFrame) -> list[tuple]:
    return sorted(map(tuple, frame.collect()), key=repr)
