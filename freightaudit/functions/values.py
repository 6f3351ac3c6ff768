"""Column functions that bring compared values to a normal form."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from freightaudit import dims
from freightaudit.functions.once import let
from freightaudit.functions.text import WS, fold_text, strip


def _spaced(word: str) -> str:
    """A pattern for a word with any blanks between its letters."""
    return f"{WS}*+".join(word)


# What counts as missing, the words for tonnes, and where a number stands.
_MISSING = (
    rf"^{WS}*+(?:"
    + "|".join(map(_spaced, [*dims.MISSING_WORDS, "kgs", "kg", "mts", "mt"]))
    + rf"|[_?\-.{WS[1:-1]}]++(?:{_spaced('kg')}(?:{WS}*+s)?|{_spaced('mt')}(?:{WS}*+s)?)?)?{WS}*+\z"
)
_TONNES = r"(?U)\b(?:mt|mts|ton|tons|tonne|tonnes)\b"
_TONNES_GLUED = r"(?U)(?<![a-z])(?:mt|mts|ton|tons|tonne|tonnes)\b"
_NUMBER = r"(?<![a-z0-9])\p{Nd}[\p{Nd}, ]*(?:\.\p{Nd}+)?"

#: Decimal digits of all scripts, by value.
_DIGITS = [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Nd"]


def ascii_digits(text: Column) -> Column:
    """``text`` with the decimal digits of other scripts as 0 to 9."""
    values = "".join(str(unicodedata.digit(c)) for c in _DIGITS)
    return F.translate(text, "".join(_DIGITS), values)


def plain_number(digits: Column) -> Column:
    """Digits with or without a point, without zeros that say nothing: ``007.50`` is ``7.5``."""

    def without_last(whole: Column) -> Column:
        part = F.regexp_replace(whole, r"(\.\d*?)0+$", "$1")
        return F.when(whole.contains("."), F.regexp_replace(part, r"\.$", "")).otherwise(whole)

    def without_first(digits: Column) -> Column:
        whole = F.regexp_replace(digits, r"^0+(?=\d)", "")
        return let(F.when(digits.startswith("0"), whole).otherwise(digits), without_last)

    return let(digits, without_first)


def folded_missing(folded: Column) -> Column:
    return F.coalesce(folded, F.lit("")).rlike(_MISSING)


def _unless_empty(text: Column, otherwise: Column | None = None) -> Column:
    """``text``, worked out once, or ``otherwise`` (NULL) where it is empty or NULL."""
    return let(text, lambda t: F.when(t != "", t).otherwise(otherwise))


def _present(folded: Column, missing: Column | None) -> Column:
    return ~(folded_missing(folded) if missing is None else missing)


def folded_text_value(folded: Column, missing: Column | None = None) -> Column:
    letters = F.regexp_replace(F.replace(folded, F.lit("&"), F.lit("and")), "[^a-z0-9]+", "")
    return F.when(_present(folded, missing), _unless_empty(letters))


def _count_digits(folded: Column, glued_units: bool, missing: Column | None = None) -> Column:
    before_x = r"(?U)\b(\d+)\s*[x×](?=\d|\b)" if glued_units else r"(?U)\b(\d+)\s*[x×]\b"
    first = _unless_empty(F.regexp_extract(folded, r"(?U)\b\d+\b", 0))
    digits = _unless_empty(F.regexp_extract(folded, before_x, 1), first)
    return F.when(_present(folded, missing), ascii_digits(digits))


def folded_count_text(
    folded: Column, glued_units: bool = False, missing: Column | None = None
) -> Column:
    """The count as plain digits, however many."""
    return plain_number(_count_digits(folded, glued_units, missing))


def folded_container_count(folded: Column, glued_units: bool = False) -> Column:
    """Number before ``x``, else the first standalone number.

    ``6x40`` has no word boundary after the ``x`` and gives NULL; ``glued_units`` accepts it.
    """
    return _count_digits(folded, glued_units).try_cast("decimal(38,0)")


def folded_weight_text(
    folded: Column, glued_units: bool = False, missing: Column | None = None
) -> Column:
    """The weight in kg as plain digits, exact at any length: tonnes move the point by three.

    ``138MT`` (no blank) counts as kg unless ``glued_units``.
    """
    found = F.regexp_extract(folded, _NUMBER, 0)
    number = _unless_empty(ascii_digits(F.translate(found, ", ", "")))
    tonnes = folded.rlike(_TONNES_GLUED if glued_units else _TONNES)

    def in_kg(number: Column) -> Column:
        pointed = F.concat(F.regexp_replace(number, r"^(\d+)$", "$1."), F.lit("000"))
        moved = F.regexp_replace(pointed, r"^(\d+)\.(\d{3})", "$1$2.")
        return F.when(tonnes, moved).otherwise(number)

    return F.when(_present(folded, missing), plain_number(let(number, in_kg)))


def folded_weight_kg(folded: Column, glued_units: bool = False) -> Column:
    """The weight in kg as a number of nine decimals, for arithmetic; NULL where it does not fit.
    Comparisons take ``folded_weight_text``."""
    return folded_weight_text(folded, glued_units).try_cast("decimal(38,9)")


def json_value(number: Column) -> Column:
    """Decimal as plain text without exponent and without trailing zeros behind the point."""
    size = F.abs(number)
    # from 1 on no decimal is written with an exponent, so a smaller one is written one higher
    below = F.concat(
        F.when(number < 0, F.lit("-")).otherwise(F.lit("")),
        F.regexp_replace((size + 1).cast("string"), "^1", "0"),
    )
    plain = F.when(size < 1, below).otherwise(number.cast("string"))
    return F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def folded_field_value(
    field: Column, folded: Column, glued_units: bool = False, missing: Column | None = None
) -> Column:
    """The comparable text form of a value that is already folded; ``missing`` says whether it is
    a missing one, if that is known."""
    return (
        F.when(field == dims.COUNT_FIELD, folded_count_text(folded, glued_units, missing))
        .when(field == dims.WEIGHT_FIELD, folded_weight_text(folded, glued_units, missing))
        .otherwise(folded_text_value(folded, missing))
    )


def is_missing_value(value: Column) -> Column:
    return folded_missing(fold_text(value))


def normalise_text_value(value: Column) -> Column:
    return let(fold_text(value), lambda folded: folded_text_value(folded))


def normalise_container_count(value: Column, glued_units: bool = False) -> Column:
    return let(fold_text(value), lambda folded: folded_container_count(folded, glued_units))


def normalise_weight_kg(value: Column, glued_units: bool = False) -> Column:
    return let(fold_text(value), lambda folded: folded_weight_kg(folded, glued_units))


def normalise_field_value(field: Column, value: Column, glued_units: bool = False) -> Column:
    return let(fold_text(value), lambda folded: folded_field_value(field, folded, glued_units))


# ------------------------------------------------------------------ tolerant comparison


def lenient_text(value: Column) -> Column:
    spaced = F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"[^\p{L}\p{N}_]+", " ")
    return F.trim(spaced)


def lenient_weight(value: Column) -> Column:
    """Weight in kg as a double; tonnes when the number is followed by such a unit."""
    text = strip(F.replace(F.upper(value), F.lit(","), F.lit("")))
    pattern = rf"([\d.]+){WS}*(MT|M/T|METRIC TON|KGS|KG)?"
    number = F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("double")
    tonnes = F.regexp_extract(text, pattern, 2).isin("MT", "M/T", "METRIC TON")
    return F.when(tonnes, number * 1000.0).otherwise(number)


def lenient_container_count(value: Column) -> Column:
    digits = F.regexp_extract(F.replace(value, F.lit(","), F.lit("")), r"\d+", 0)
    return F.nullif(digits, F.lit("")).try_cast("decimal(38,0)")


def lenient_equal(field: Column, left: Column, right: Column) -> Column:
    """Do two values agree within tolerance?  A NULL side never disagrees."""
    plain = F.lower(strip(left)) == F.lower(strip(right))
    weights = F.abs(lenient_weight(left) - lenient_weight(right)) < 1.0
    counts = lenient_container_count(left) == lenient_container_count(right)
    left_text, right_text = lenient_text(left), lenient_text(right)

    def token_set(text: Column) -> Column:
        return F.array_sort(F.array_distinct(F.split(text, " ")))

    texts = (
        (left_text == "")
        | (right_text == "")
        | (left_text == right_text)
        | (token_set(left_text) == token_set(right_text))
    )
    return (
        F.when(left.isNull() | right.isNull(), F.lit(True))
        .when(field == dims.WEIGHT_FIELD, F.coalesce(weights, plain))
        .when(field == dims.COUNT_FIELD, F.coalesce(counts, plain))
        .otherwise(texts)
    )
