"""Column functions on text: folding, splitting into lines and words, phrase search."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from freightaudit import dims
from freightaudit.functions import pyudf

# Whitespace in the Unicode sense, as characters and as a regular expression.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WS = (
    r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)
LINE_BREAK = r"(?=[^\x20-\x7f])(?:\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029])"

# Folding such characters only ever yields themselves or other non-ASCII letters, and they
# never combine with an ASCII letter: Latin-1 letters but the sharp s, Cyrillic, ideographs.
# The look ahead is one range, so ASCII is passed over without a try of the others.
_FOLD_NEEDS_TABLES = (
    r"(?=[^\x00-\x7f])[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00de\u00e0-\u00f6\u00f8-\u00fe\u0410-\u044f\u4e00-\u9fff]"
)

_SIGNATURE = (
    rf"(?imdu)^{WS}*(?:best regards|kind regards|regards|thanks and regards|best),?{WS}*$"
    rf"|^_{{5,}}{WS}*$"
    rf"|^-{{5,}}{WS}*original message{WS}*-{{5,}}$"
)


def sql_string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strings(values: Iterable[str]) -> Column:
    """A literal array of strings."""
    return F.expr("array(" + ", ".join(sql_string(value) for value in values) + ")")


def no_strings() -> Column:
    return F.expr("CAST(array() AS ARRAY<STRING>)")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def fold_text(text: Column, keep_colons: bool = False) -> Column:
    """NFKC + case folding as far as later ASCII matching can tell the difference.

    Plain values are lower-cased in the JVM; only values with other characters reach Python.
    """
    special = text.rlike(_FOLD_NEEDS_TABLES)
    udf = pyudf.fold_keep_colons if keep_colons else pyudf.fold_unicode
    return F.coalesce(udf(F.when(special, text)), F.lower(text))


def fold_text_full(text: Column) -> Column:
    """NFKC + case folding, exact for every value that is not pure ASCII."""
    return F.coalesce(pyudf.fold_unicode(F.when(text.rlike(r"[^\x00-\x7f]"), text)), F.lower(text))


def decode_text(content: Column) -> Column:
    """Bytes to text; malformed bytes become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def split_lines(text: Column) -> Column:
    """All lines of a text; the break at the very end opens no further line."""
    parts = F.split(text, LINE_BREAK, -1)
    return F.get(
        F.transform(
            F.array(parts),  # split once
            lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p),
        ),
        F.lit(0),
    )


def ascii_words(text: Column) -> Column:
    return folded_words(fold_text(text))


def folded_words(folded: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(folded, F.lit("")), F.lit("[a-z0-9]+"), F.lit(0))


def remove_boilerplate(body: Column) -> Column:
    """The current message: what stands before the signature or the quoted thread."""
    return F.split(body, _SIGNATURE, 2)[0]


def normalise_text(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_join(words, " ")


def letter_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def extract_words(text: Column) -> Column:
    """Useful words: no stopwords, three letters or more (or a known short word)."""
    stop, short = strings(dims.STOPWORDS), strings(dims.SHORT_WORDS)
    return F.filter(
        letter_words(text),
        lambda w: ~F.array_contains(stop, w)
        & ((F.length(w) >= 3) | F.array_contains(short, w)),
    )


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | text.contains(needle)
    return found


def found_phrases(text: Column, phrases: Iterable[str]) -> Column:
    """The phrases contained in ``text``, in alphabetical order."""
    return F.array_compact(
        F.array(*[F.when(text.contains(p), F.lit(p)) for p in sorted(phrases)])
    )


def count_phrases(text: Column, phrases: Iterable[str]) -> Column:
    total = F.lit(0)
    for phrase in phrases:
        total = total + text.contains(phrase).cast("int")
    return total


def field_title(field: Column) -> Column:
    return F.initcap(F.replace(field, F.lit("_"), F.lit(" ")))


def or_dash(value: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("\u2014"))


def category_name(raw: Column) -> Column:
    """Canonical category: known names in upper case, anything else upper-cased too."""
    return F.upper(raw)


def shipment_prompt(subject: Column, body: Column) -> Column:
    subject, body = (strip(F.coalesce(c, F.lit(""))) for c in (subject, body))
    return F.concat(F.lit("Subject: "), subject, F.lit("\n\nBody:\n"), body)


def document_prompt(text: Column, doc_type: Column, text_chars: int | None = None) -> Column:
    """The request text for one document; NULL (nothing to ask) for blank text.

    The text is whole unless ``text_chars`` says how much of it the receiver takes.
    """
    prompt = F.concat(
        F.lit("Document Type: "),
        doc_type,
        F.lit("\n\nDocument Text Content:\n"),
        text if text_chars is None else F.left(text, F.lit(text_chars)),
    )
    return F.when(blank_to_null(text).isNotNull(), prompt)
