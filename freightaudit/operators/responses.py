"""Responses of an extraction service, obtained earlier, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightaudit import dims
from freightaudit.functions.text import blank_to_null
from freightaudit.schemas import EXTRACTION


def clean_extraction_json(response: Column) -> Column:
    """The twelve fields of a JSON response, trimmed; empty and ``null`` texts become NULL."""
    parsed = F.from_json(response, EXTRACTION)

    def clean(key: str) -> Column:
        value = blank_to_null(parsed[key])
        return F.when(F.lower(value) != "null", value).alias(key)

    return F.struct(*[clean(key) for key in dims.EXTRACTION_KEYS])


def with_extraction(responses: DataFrame, column: str = "response") -> DataFrame:
    return responses.withColumn("fields", clean_extraction_json(F.col(column)))
