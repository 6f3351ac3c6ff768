"""Columns that are worked out once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, in any branch of a condition.

    It also stays out of the generated code around it: methods beyond 8000 bytes are never compiled
    by the JVM, which a few regular expressions in one row's code reach.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_columns_once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` for costly expressions.

    The values come out of an exploded one-element array.  The optimizer does not copy
    expressions across that step, so later filters and repeated uses read finished values.
    """
    packed = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    kept = [c for c in rows.columns if c not in columns]
    return rows.select(*kept, F.explode(packed).alias("_once")).select(*kept, "_once.*")
