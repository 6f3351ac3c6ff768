"""The Arrow UDFs of the engine: the text functions Spark has no built-in for.

All of them see only the values that need them: callers send NULL for every other row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

# Characters whose compatibility form contains a colon.
COLON_LIKE = "\uff1a\ufe13\ufe55\u2a74"


def _fold(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold()


def text_similarity(left: str, right: str) -> float:
    if not left or not right:
        return 0.0
    return round(SequenceMatcher(None, left, right).ratio() * 10.0, 2)


def of_distinct(texts: pa.Array, values: Callable[[list[str]], pa.Array]) -> pa.Array:
    """One value for each text, NULL for NULL; ``values`` gets every distinct text once."""
    coded = texts.dictionary_encode()
    return values(coded.dictionary.to_pylist()).take(coded.indices)


@F.arrow_udf(StringType())
def fold_unicode(texts: pa.Array) -> pa.Array:
    """NFKC + case folding."""
    return of_distinct(texts, lambda known: pa.array(map(_fold, known), pa.string()))


def _fold_keep_colons(text: str) -> str:
    return "".join(
        piece if piece in COLON_LIKE else _fold(piece)
        for piece in re.split(f"([{COLON_LIKE}])", text)
        if piece
    )


@F.arrow_udf(StringType())
def fold_keep_colons(texts: pa.Array) -> pa.Array:
    """NFKC + case folding that creates no new colon, so label/value splits stay in place."""
    return of_distinct(texts, lambda known: pa.array(map(_fold_keep_colons, known), pa.string()))


@F.pandas_udf(DoubleType())
def char_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ten times the Ratcliff-Obershelp ratio of two strings, two decimals."""
    return pd.Series([text_similarity(a or "", b or "") for a, b in zip(left, right)])


def alias_similarities(alias_texts: tuple[str, ...]):
    """UDF: one string -> its ``char_similarity`` to each of the given fixed strings.

    Labels repeat heavily, so a batch computes each distinct one once.
    """

    @F.pandas_udf(ArrayType(DoubleType()))
    def similarities(texts: pd.Series) -> pd.Series:
        known = {
            text: [text_similarity(text, alias) for alias in alias_texts]
            for text in texts.dropna().unique()
        }
        return texts.map(known.get, na_action="ignore")

    return similarities
