"""Scoring of document labels against the known aliases of the seven fields.

A label takes part only through its *key* (its synonym-replaced words joined by blanks), so
equal keys always get equal decisions.  Scoring is made of array expressions; the single
piece that needs Python is the character similarity, handed in as a column.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from freightaudit import dims
from freightaudit.functions.once import let
from freightaudit.functions.pyudf import alias_similarities, of_distinct, text_similarity
from freightaudit.functions.text import folded_words, sql_string, strings


@dataclass(frozen=True)
class Alias:
    """One known label with what the scoring formula needs of it."""

    field: str
    field_ord: int
    alias: str
    alias_ord: int
    plain_words: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return [dims.LABEL_SYNONYMS.get(word, word) for word in self.plain_words]

    @property
    def key(self) -> str:
        return " ".join(self.words)

    @property
    def meaningful(self) -> list[str]:
        return [word for word in self.words if word not in dims.LABEL_CONNECTORS]

    @property
    def word_mask(self) -> int:
        return sum(1 << _VOCABULARY.index(word) for word in set(self.meaningful))

    @property
    def acronyms(self) -> list[str]:
        if re.fullmatch("[a-z]{1,5}", self.key):
            return [self.key]
        forms = ["".join(w[0] for w in ws) for ws in (self.words, self.meaningful)]
        return list(dict.fromkeys(form for form in forms if form))


def _known_aliases() -> list[Alias]:
    found = []
    for field_ord, (field, labels) in enumerate(dims.FIELD_ALIASES.items()):
        for alias in labels:
            folded = unicodedata.normalize("NFKC", alias).casefold()
            words = tuple(re.findall("[a-z0-9]+", folded))
            found.append(Alias(field, field_ord, alias, len(found), words))
    return found


ALIASES = _known_aliases()
# Different spellings with the same words score the same; the first one names the match.
DISTINCT_ALIASES = list({a.key: a for a in reversed(ALIASES)}.values())[::-1]
_VOCABULARY = sorted({word for a in ALIASES for word in a.meaningful})
_ACRONYMS = sorted({form for a in ALIASES for form in a.acronyms if len(form) >= 2})
_VOCABULARY_SET, _ACRONYM_SET = frozenset(_VOCABULARY), frozenset(_ACRONYMS)
EXACT_KEYS = [a.key for a in DISTINCT_ALIASES]
_EXACT_FIELDS = {
    a.key: a.field for a in sorted(ALIASES, key=lambda a: -dims.FIELDS.index(a.field))
}
#: Aliases by the words they are spelled with, most words first.
PREFIX_ALIASES: dict[str, Alias] = {}
for _alias in sorted(ALIASES, key=lambda a: -len(a.plain_words)):
    PREFIX_ALIASES.setdefault(" ".join(_alias.plain_words), _alias)
_CODED_LETTERS = max(len(form) for a in ALIASES for form in a.acronyms)

_similarities = alias_similarities(tuple("".join(a.words) for a in DISTINCT_ALIASES))


def label_words(folded: Column) -> Column:
    pairs = ", ".join(sql_string(x) for pair in dims.LABEL_SYNONYMS.items() for x in pair)
    synonyms = F.expr(f"map({pairs})")
    return F.transform(
        folded_words(folded), lambda w: F.coalesce(F.try_element_at(synonyms, w), w)
    )


def label_key(folded: Column) -> Column:
    return F.array_join(label_words(folded), " ")


def key_words(key: Column) -> Column:
    return F.filter(F.split(key, " "), lambda w: w != "")


def meaningful_words(words: Column) -> Column:
    """Words without connectors, repeats kept."""
    connectors = strings(dims.LABEL_CONNECTORS)
    return F.filter(words, lambda w: ~F.array_contains(connectors, w))


def _initials(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), "")


def label_acronyms(words: Column) -> Column:
    """Initials with and without connectors; one short word of letters stands for itself."""
    only = F.array_join(words, " ")
    forms = F.array(_initials(words), _initials(meaningful_words(words)))
    return F.when(only.rlike("^[a-z]{1,5}$"), F.array(only)).otherwise(
        F.filter(F.array_distinct(forms), lambda form: form != "")
    )


def exact_field(key: Column) -> Column:
    """The field whose alias has exactly these words, or NULL."""
    found = None
    for field in dims.FIELDS:
        keys = sorted({a.key for a in ALIASES if a.field == field})
        found = (
            F.when(key.isin(keys), F.lit(field))
            if found is None
            else found.when(key.isin(keys), F.lit(field))
        )
    return found


def may_score(key: Column) -> Column:
    """Could the label be accepted at all?

    Without a shared word or acronym the score is bounded by matching initials (+5 per
    letter, at most five letters), ten similarity points and the penalty for the alias's own
    words: 20 at most, below the required 30.
    """
    words = key_words(key)
    return F.arrays_overlap(words, strings(_VOCABULARY)) | F.arrays_overlap(
        label_acronyms(words), strings(_ACRONYMS)
    )


def similarities(key: Column) -> Column:
    """Character similarity of a label key to every distinct alias, in their order."""
    return _similarities(F.replace(key, F.lit(" "), F.lit("")))


def _letter_code(acronym: Column) -> Column:
    """The first letters of an acronym as one number, a byte per letter, first one lowest."""
    letters = F.left(acronym, F.lit(_CODED_LETTERS))
    return F.conv(F.hex(F.reverse(letters)), 16, 10).cast("long")


def _alias_letter_code(acronym: str) -> int:
    return int.from_bytes(acronym.encode(), "little")


def label_profile(key: Column) -> Column:
    """What scoring needs of a label; its known words are one bit each in ``mask``."""
    words = key_words(key)
    meaningful = F.array_distinct(meaningful_words(words))
    vocabulary = strings(_VOCABULARY)

    def add_bit(mask: Column, word: Column) -> Column:
        place = F.array_position(vocabulary, word).cast("int")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), place - 1)
        return F.when(place > 0, mask.bitwiseOR(bit)).otherwise(mask)

    acronyms = label_acronyms(words)
    first, second = F.get(acronyms, F.lit(0)), F.get(acronyms, F.lit(1))
    return F.struct(
        key.alias("key"),
        F.aggregate(meaningful, F.lit(0).cast("long"), add_bit).alias("mask"),
        F.size(meaningful).alias("words"),
        first.alias("acr1"),
        _letter_code(first).alias("code1"),
        F.length(first).alias("len1"),
        second.alias("acr2"),
        _letter_code(second).alias("code2"),
        F.length(second).alias("len2"),
    )


def _alias_sql(alias: Alias, place: int = 0) -> str:
    forms = [*alias.acronyms, None][:2]
    parts = [
        ("key", sql_string(alias.key)),
        ("mask", f"{alias.word_mask}L"),
        ("words", str(len(set(alias.meaningful)))),
    ]
    for i, form in enumerate(forms, start=1):
        parts += [
            (f"acr{i}", sql_string(form) if form else "CAST(NULL AS STRING)"),
            (f"code{i}", f"{_alias_letter_code(form)}L" if form else "CAST(NULL AS BIGINT)"),
            (f"len{i}", str(len(form)) if form else "CAST(NULL AS INT)"),
        ]
    parts += [
        ("field", sql_string(alias.field)),
        ("field_ord", str(alias.field_ord)),
        ("alias", sql_string(alias.alias)),
        ("alias_ord", str(alias.alias_ord)),
        ("place", str(place)),
    ]
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in parts) + ")"


def alias_array(aliases: list[Alias]) -> Column:
    """Known aliases as a literal array of structs."""
    return F.expr("array(" + ", ".join(_alias_sql(a, i) for i, a in enumerate(aliases)) + ")")


def _aliases_by_field() -> Column:
    """The distinct aliases as a literal array of arrays, one per field."""
    groups = [
        ", ".join(_alias_sql(a, i) for i, a in enumerate(DISTINCT_ALIASES) if a.field == field)
        for field in dims.FIELDS
    ]
    return F.expr("array(" + ", ".join(f"array({group})" for group in groups) + ")")


def _initial_points(label: Column, alias: Column) -> Column:
    """Best agreement of two acronym sets: +5 per equal letter, -5 per different letter.

    Letters are compared a byte at a time inside one number: in ``difference + 0x7f7f...``
    the high bit of a byte is set exactly where the two letters differ.
    """
    low, high = (int.from_bytes(bytes([b] * _CODED_LETTERS), "little") for b in (0x7F, 0x80))

    def agreement(i: int, j: int) -> Column:
        shorter = F.least(label[f"len{i}"], alias[f"len{j}"])
        compared = F.call_function("shiftleft", F.lit(1).cast("long"), shorter * 8) - 1
        changed = label[f"code{i}"].bitwiseXOR(alias[f"code{j}"]) + F.lit(low)
        wrong = F.bit_count(changed.bitwiseAND(F.lit(high)).bitwiseAND(compared))
        both = label[f"len{i}"].isNotNull() & alias[f"len{j}"].isNotNull()
        return F.when(both, (shorter - wrong * 2) * F.lit(dims.INITIAL_POINTS))

    return F.coalesce(
        F.greatest(agreement(1, 1), agreement(1, 2), agreement(2, 1), agreement(2, 2)),
        F.lit(0.0),
    )


def _shares_acronym(label: Column, alias: Column) -> Column:
    def same(i: int, j: int) -> Column:
        return F.coalesce(
            (label[f"acr{i}"] == alias[f"acr{j}"]) & (label[f"len{i}"] >= 2), F.lit(False)
        )

    return same(1, 1) | same(1, 2) | same(2, 1) | same(2, 2)


def score_parts(label: Column, alias: Column) -> Column:
    """What one label profile and one alias (both structs) have in common."""
    return F.struct(
        ((label["key"] != "") & (label["key"] == alias["key"])).alias("exact"),
        F.bit_count(label["mask"].bitwiseAND(alias["mask"])).alias("shared"),
        (label["words"] + alias["words"]).alias("words"),
        _shares_acronym(label, alias).alias("acronym"),
        _initial_points(label, alias).alias("initials"),
    )


def points_without_similarity(parts: Column | dict[str, Column]) -> Column:
    different = parts["words"] - parts["shared"] * 2
    return (
        parts["shared"] * F.lit(dims.SHARED_WORD_POINTS)
        + parts["initials"]
        + F.when(parts["acronym"], F.lit(dims.SHARED_ACRONYM_POINTS)).otherwise(
            different * F.lit(-dims.DIFFERENT_WORD_POINTS)
        )
    )


def score_breakdown(parts: Column, similarity: Column) -> Column:
    """The score and its points, from ``score_parts`` and the character similarity."""
    zero = F.lit(0.0)
    exact = parts["exact"]
    word_points = parts["shared"] * F.lit(dims.SHARED_WORD_POINTS)
    acronym_points = F.when(parts["acronym"], F.lit(dims.SHARED_ACRONYM_POINTS)).otherwise(zero)
    different = parts["words"] - parts["shared"] * 2
    penalty = F.when(parts["acronym"], zero).otherwise(
        different * F.lit(-dims.DIFFERENT_WORD_POINTS)
    )
    total = points_without_similarity(parts) + similarity
    score = F.when(exact, F.lit(dims.EXACT_SCORE)).otherwise(
        F.round(F.greatest(zero, total), 2)
    )

    def unless_exact(points: Column, name: str) -> Column:
        return F.when(exact, zero).otherwise(points).alias(name)

    return F.struct(
        score.alias("score"),
        exact.alias("exact_alias"),
        unless_exact(word_points, "whole_word_points"),
        unless_exact(acronym_points, "acronym_points"),
        unless_exact(parts["initials"], "initial_points"),
        unless_exact(similarity, "character_points"),
        unless_exact(penalty, "different_word_penalty"),
    )


def field_candidates(profile: Column, similarity_list: Column) -> Column:
    """The best alias of each field, best field first (ties: dictionary order)."""

    def scored(alias: Column) -> Column:
        points = let(
            score_parts(profile, alias),
            lambda parts: score_breakdown(parts, F.get(similarity_list, alias["place"])),
        )
        return let(
            points,
            lambda p: F.struct(
                p["score"].alias("score"),
                (-alias["alias_ord"]).alias("alias_rank"),
                alias["field"].alias("field"),
                alias["alias"].alias("best_alias"),
                p.alias("breakdown"),
            ),
        )

    per_field = F.transform(
        _aliases_by_field(), lambda aliases: F.array_max(F.transform(aliases, scored))
    )
    return F.sort_array(per_field, asc=False)


def label_decision(candidates: Column) -> Column:
    """Accept the best field when it is strong and clearly ahead of the second."""

    def decide(c: Column) -> Column:
        best, second = F.get(c, F.lit(0)), F.get(c, F.lit(1))
        margin = F.round(best["score"] - second["score"], 2)
        accepted = (best["score"] >= dims.MIN_LABEL_SCORE) & (margin >= dims.MIN_LABEL_MARGIN)
        return F.struct(
            F.when(accepted, best["field"]).alias("field"),
            accepted.alias("accepted"),
            best["score"].alias("best_score"),
            second["score"].alias("second_score"),
            margin.alias("margin"),
            best["best_alias"].alias("best_alias"),
            c.alias("candidates"),
        )

    return let(candidates, decide)


def accepted_label(decision: Column) -> Column:
    """``STRUCT<field, score>`` of an accepting decision, else NULL."""
    accepting = F.filter(F.array(decision), lambda d: d["accepted"])
    return F.get(
        F.transform(
            accepting, lambda d: F.struct(d["field"].alias("field"), d["best_score"].alias("score"))
        ),
        F.lit(0),
    )


class _Label(Alias):
    """A label key: its words are replaced already."""

    @property
    def words(self) -> list[str]:
        return list(self.plain_words)


def _agreement(left: str, right: str) -> float:
    shorter = min(len(left), len(right))
    wrong = sum(a != b for a, b in zip(left, right))
    return (shorter - 2 * wrong) * dims.INITIAL_POINTS


def _points_of_words(label: Alias, alias: Alias) -> tuple[float, bool]:
    """The points without similarity, and whether a word or an acronym is shared: what
    ``points_without_similarity`` says, for two labels in Python."""
    own, known = set(label.meaningful), set(alias.meaningful)
    shared = len(own & known)
    acronym = any(len(form) >= 2 and form in alias.acronyms for form in label.acronyms)
    initials = max(
        (_agreement(a, b) for a in label.acronyms for b in alias.acronyms), default=0.0
    )
    points = shared * dims.SHARED_WORD_POINTS + initials
    if acronym:
        points += dims.SHARED_ACRONYM_POINTS
    else:
        points -= (len(own) + len(known) - 2 * shared) * dims.DIFFERENT_WORD_POINTS
    return points, shared > 0 or acronym


def _accepted(key: str) -> tuple[str | None, float | None]:
    """(field, score) of a label key that is accepted, as ``label_decision`` decides."""
    label = _Label("", 0, key, 0, tuple(w for w in key.split(" ") if w))
    points = [_points_of_words(label, alias) for alias in DISTINCT_ALIASES]
    if not any(related and p + 10.0 >= dims.MIN_LABEL_SCORE for p, related in points):
        return None, None
    best = dict.fromkeys(dims.FIELDS, 0.0)
    for (p, _), alias in zip(points, DISTINCT_ALIASES, strict=True):
        if key and key == alias.key:
            score = dims.EXACT_SCORE
        else:
            similarity = text_similarity(key.replace(" ", ""), "".join(alias.words))
            score = round(max(0.0, p + similarity), 2)
        best[alias.field] = max(best[alias.field], score)
    (field, first), (_, second) = sorted(best.items(), key=lambda e: -e[1])[:2]
    if first >= dims.MIN_LABEL_SCORE and round(first - second, 2) >= dims.MIN_LABEL_MARGIN:
        return field, float(first)
    return None, None


@F.arrow_udf(StructType().add("field", StringType()).add("score", DoubleType()))
def accepted_field(keys: pa.Array) -> pa.Array:
    """The accepted field and score of label keys, NULLs where none is.

    Decided once for each distinct key of a batch; most fail on their words alone, before any
    similarity is worked out.
    """

    def decided(known: list[str]) -> pa.Array:
        found = [_accepted(key) for key in known]
        return pa.StructArray.from_arrays(
            [
                pa.array([field for field, _ in found], pa.string()),
                pa.array([score for _, score in found], pa.float64()),
            ],
            ["field", "score"],
        )

    return of_distinct(keys, decided)


# its result is tested by later filters, into which the optimizer would copy the call
accepted_field = accepted_field.asNondeterministic()


def _key(label: str) -> str:
    folded = unicodedata.normalize("NFKC", label).casefold()
    return " ".join(dims.LABEL_SYNONYMS.get(w, w) for w in re.findall("[a-z0-9]+", folded))


def _may_score(key: str) -> bool:
    """What ``may_score`` says, for a label in Python."""
    label = _Label("", 0, key, 0, tuple(key.split()))
    return not _VOCABULARY_SET.isdisjoint(label.words) or not _ACRONYM_SET.isdisjoint(
        label.acronyms
    )


#: Decisions of label keys that a task has met: so many at most, of keys no longer than that.
_MET: dict[str, tuple[str | None, float | None]] = {}
_MET_KEYS, _MET_CHARS = 20_000, 200


def _decided(key: str) -> tuple[str | None, float | None]:
    """(field, score) of a key that is accepted: words of a known alias, or close enough to one."""
    if key in _EXACT_FIELDS:
        return _EXACT_FIELDS[key], dims.EXACT_SCORE
    found = _MET.get(key)
    if found is None:
        found = _accepted(key)
        if len(_MET) < _MET_KEYS and len(key) <= _MET_CHARS:
            _MET[key] = found
    return found


@F.arrow_udf(
    StructType()
    .add("key", StringType())
    .add("may_score", BooleanType())
    .add("field", StringType())
    .add("score", DoubleType())
)
def read_label(labels: pa.Array) -> pa.Array:
    """The key of a label as it is spelled, whether it ``may_score``, and the field and score that it
    is accepted for, NULLs where none is; all NULL for NULL.

    The key is ``label_key(fold_text(label))``; everything is worked out once for each distinct
    label of a batch, and what may not score is not accepted.
    """

    def read(known: list[str]) -> pa.Array:
        keys = [_key(label) for label in known]
        may = [_may_score(key) for key in keys]
        found = [_decided(key) if m else (None, None) for key, m in zip(keys, may, strict=True)]
        return pa.StructArray.from_arrays(
            [
                pa.array(keys, pa.string()),
                pa.array(may, pa.bool_()),
                pa.array([field for field, _ in found], pa.string()),
                pa.array([score for _, score in found], pa.float64()),
            ],
            ["key", "may_score", "field", "score"],
        )

    return of_distinct(labels, read)


# as above
read_label = read_label.asNondeterministic()


@F.arrow_udf(StructType().add("field", StringType()).add("alias", StringType()))
def known_prefix(matched: pa.Array) -> pa.Array:
    """The field and alias of the known label that a line starts with; NULLs if there is none."""

    def named(known: list[str]) -> pa.Array:
        words = [" ".join(re.findall("[a-z0-9]+", m.lower().replace("ſ", "s"))) for m in known]
        found = [PREFIX_ALIASES.get(w) for w in words]
        return pa.StructArray.from_arrays(
            [pa.array([a and getattr(a, part) for a in found], pa.string()) for part in ("field", "alias")],
            ["field", "alias"],
        )

    return of_distinct(matched, named)


known_prefix = known_prefix.asNondeterministic()
