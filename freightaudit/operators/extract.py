"""Extraction of the seven fields from documents.

Documents arrive as rows (label/value pairs and text lines).  Lines become candidates
without a shuffle; the best candidate per document and field is a ``min`` over an ordered
struct, which Spark combines map-side, so even a document holding a large share of all rows
shrinks to one row per task before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightaudit import dims
from freightaudit.functions import labels as L
from freightaudit.functions.once import let, with_columns_once
from freightaudit.functions.text import LINE_BREAK, WS, contains_any, fold_text, strip
from freightaudit.functions.values import folded_field_value, folded_missing
from freightaudit.operators.joins import spread_left_join
from freightaudit.operators.labels import decide_keys

_TOTAL = rf"(?iu)^total{WS}+"
_AFTER_LABEL = " :-|\t"


def _prefix_pattern() -> str:
    """One pattern for "line starts with a known label", longest label first."""
    labels = "|".join(words.replace(" ", "[^A-Za-z0-9]+") for words in L.PREFIX_ALIASES)
    # most lines start with no label's letter and are done with the look ahead
    first = "".join(sorted({words[0] for words in L.PREFIX_ALIASES}))
    return rf"(?iu)^{WS}*(?=[{first}])(?:{labels})(?:[^A-Za-z0-9]+|$)"


_PREFIX = _prefix_pattern()


def document_lines(docs: DataFrame, folded: bool = True) -> DataFrame:
    """``docs(path, text, ...)`` -> one row per line: ``line_no`` from 1, ``raw``, and ``folded``
    if asked for.

    A document without any line keeps one row with a NULL line.  The break at the very end opens
    no further line.  Folding keeps line breaks as they are, so a line is folded by itself.
    """
    others = [c for c in docs.columns if c != "text"]
    lines = F.posexplode_outer(F.split(_without_last_break(F.col("text")), LINE_BREAK, -1))
    return docs.select(*others, lines.alias("_pos", "raw")).select(
        *others,
        (F.col("_pos") + 1).cast("long").alias("line_no"),
        "raw",
        *([fold_text(F.col("raw"), keep_colons=True).alias("folded")] if folded else []),
    )


def _without_last_break(text: Column) -> Column:
    """The text that its lines are split from; NULL of an empty one, which has no line."""
    ends = F.when(text.endswith("\r\n"), 2).when(F.right(text, F.lit(1)).rlike(LINE_BREAK), 1)
    return F.when(
        text != "", F.when(ends.isNull(), text).otherwise(F.left(text, F.length(text) - ends))
    )


def line_variants(line: Column) -> Column:
    """A line, and the line without a leading ``total`` where there is one."""
    line = strip(line)
    return F.array_distinct(F.array(line, strip(F.regexp_replace(line, _TOTAL, ""))))


def _label_part(line: Column) -> Column:
    return F.when(line.contains(":"), F.substring_index(line, ":", 1))


def _value_part(line: Column) -> Column:
    return F.when(line.contains(":"), F.substr(line, F.instr(line, ":") + 1))


def prefix_label(line: Column) -> Column:
    """The known label a line starts with (NULL if none), including what separates it."""
    return F.nullif(F.regexp_extract(line, _PREFIX, 0), F.lit(""))


def prefix_value(line: Column, matched: Column) -> Column:
    return F.ltrim(F.substr(line, F.length(matched) + 1), F.lit(_AFTER_LABEL))


def prefix_candidates(docs: DataFrame) -> DataFrame:
    """``docs(path, text)`` -> ``(path, line_no, field, value)``: every line, or line without a
    leading ``total``, that starts with a known label, whatever stands behind it."""
    lines = document_lines(docs, folded=False).select(
        "path", "line_no", F.explode(line_variants(F.coalesce("raw", F.lit("")))).alias("line")
    )
    found = with_columns_once(lines, {"matched": prefix_label(F.col("line"))})
    return found.where("matched is not null").select(
        "path",
        "line_no",
        L.known_prefix(F.col("matched"))["field"].alias("field"),
        prefix_value(F.col("line"), F.col("matched")).alias("value"),
    )


def _carried(rows: DataFrame, used: set[str]) -> list[str]:
    return [c for c in rows.columns if c not in used]


def pair_candidates(pairs: DataFrame) -> DataFrame:
    """``pairs(path, seq, label, value)`` in the common candidate row form."""
    carried = _carried(pairs, {"seq", "label", "value"})
    label = F.coalesce("label", F.lit(""))
    return pairs.withColumn("_own", L.read_label(label)).select(
        *carried,
        F.lit(0).alias("kind"),
        F.col("seq").alias("no"),
        label.alias("label1"),
        F.col("_own.key").alias("key1"),
        F.coalesce("value", F.lit("")).alias("value1"),
        *[
            F.lit(None).cast("string").alias(c)
            for c in ("match1", "label2", "key2", "match2", "pvalue")
        ],
        _accepted("_own").alias("found1"),
        F.lit(None).cast("struct<field: string, score: double>").alias("found2"),
    )


def _accepted(own: str) -> Column:
    """What a label that was read is accepted for, as a struct; NULL if it is not."""
    return F.when(
        F.col(f"{own}.field").isNotNull(),
        F.struct(F.col(f"{own}.field").alias("field"), F.col(f"{own}.score").alias("score")),
    )


def read_lines(lines: DataFrame, keep: Column | None = None) -> DataFrame:
    """What may be a label and a value in each line: ``lines(line_no, raw, ...)`` with ``line1``, the
    line without blanks around it, ``line2``, the same without a leading ``total`` where there is
    one, and of either the label before the colon, what is read from it and the known label at its
    start.

    Everything is worked out on plain columns, step by step.  Labels repeat, so their keys and
    decisions come from a UDF that reads each distinct one of a batch once; whatever needs no key is
    done before it, and lines without any label do not get there unless they are the first of their
    document or ``keep`` marks them.
    """
    carried = _carried(lines, {"raw"})
    line1, line2 = F.col("line1"), F.col("line2")
    rows = lines.select(*carried, strip(F.coalesce("raw", F.lit(""))).alias("line1"))
    rows = rows.select(
        *carried,
        "line1",
        F.when(line1.rlike(_TOTAL), strip(F.regexp_replace(line1, _TOTAL, ""))).alias("line2"),
    )
    rows = rows.withColumns(
        {
            "label1": _label_part(line1),
            "label2": _label_part(line2),
            "match1": prefix_label(line1),
            "match2": prefix_label(line2),
        }
    )
    wanted = (
        (F.coalesce("line_no", F.lit(1)) == 1)
        | F.coalesce("label1", "match1", "line2").isNotNull()
    )
    if keep is not None:
        wanted = wanted | keep
    return rows.where(wanted).withColumns(
        {"own1": L.read_label(F.col("label1")), "own2": L.read_label(F.col("label2"))}
    )


def _line_rows(
    lines: DataFrame, carried: list[str], flagged: Column | None = None, keep: Column | None = None
) -> DataFrame:
    """Lines that give a field, and the first of each document, as candidate rows.

    Further lines stay that are ``flagged`` for what they carry, or that ``keep`` marks by what was
    read from them.
    """
    useful = F.coalesce("line_no", F.lit(1)) == 1
    for success in ("own1.field", "match1", "own2.field", "match2"):
        useful = useful | F.col(success).isNotNull()
    for more in (flagged, keep):
        useful = useful if more is None else useful | more
    known = F.coalesce(F.col("own1.key").isin(L.EXACT_KEYS), F.lit(False))
    rows = read_lines(lines, flagged).where(useful).withColumns(
        {c: F.when(~known, F.col(c)) for c in ("match1", "match2")}
    )
    return rows.select(
        *carried,
        F.lit(1).alias("kind"),
        F.col("line_no").alias("no"),
        "label1",
        F.col("own1.key").alias("key1"),
        _value_part(F.col("line1")).alias("value1"),
        "match1",
        "label2",
        F.col("own2.key").alias("key2"),
        "match2",
        F.coalesce(
            prefix_value(F.col("line1"), F.col("match1")),
            prefix_value(F.col("line2"), F.col("match2")),
        ).alias("pvalue"),
        _accepted("own1").alias("found1"),
        _accepted("own2").alias("found2"),
    )


def text_candidates(docs: DataFrame) -> DataFrame:
    """Candidate rows of documents held as one text each."""
    return _line_rows(document_lines(docs, folded=False), [c for c in docs.columns if c != "text"])


def line_candidates(lines: DataFrame) -> DataFrame:
    """Candidate rows of documents held as line rows: ``lines(path, line_no, raw)``."""
    carried = _carried(lines, {"line_no", "raw"})
    # a document of line rows may lack its first line, so whatever may give a field keeps it
    keep = F.coalesce("own1.may_score", F.lit(False)) | F.col("line2").isNotNull()
    flagged = F.coalesce("wrong_type", F.lit(False)) if "wrong_type" in carried else None
    return _line_rows(lines, carried, flagged, keep)


def choose_candidate(rows: DataFrame) -> DataFrame:
    """At most one ``candidate`` per row.

    First success wins: the label before the colon, a known label at the line start, then
    both again for the line without ``total``.  Rows without a success keep a NULL candidate.
    Only the value that is chosen is folded and brought to its normal form.
    """
    used = {
        "kind", "no", "label1", "key1", "value1", "match1", "label2", "key2", "match2", "pvalue",
        "found1", "found2",
    }
    carried = _carried(rows, used)
    which = (
        F.when(F.col("found1").isNotNull(), 1)
        .when(F.col("match1").isNotNull(), 2)
        .when(F.col("found2").isNotNull(), 3)
        .when(F.col("match2").isNotNull(), 4)
    )

    def chosen(*options: Column) -> Column:
        return F.get(F.array(*options), F.col("_which") - 1)

    exact = F.lit(dims.EXACT_SCORE)
    source = F.when(F.col("kind") == 0, F.lit("table")).otherwise(
        F.concat(F.lit("line "), F.col("no").cast("string"))
    )
    by_label = F.col("_which").isin(1, 3)
    picked = rows.withColumn("_which", which).select(
        *carried,
        "kind",
        "no",
        "_which",
        chosen(F.col("found1.field"), F.lit(None), F.col("found2.field"), F.lit(None)).alias("_own"),
        chosen(F.col("found1.score"), exact, F.col("found2.score"), exact).alias("_score"),
        chosen(F.col("label1"), F.lit(None), F.col("label2"), F.lit(None)).alias("_spelled"),
        chosen(F.lit(None), F.col("match1"), F.lit(None), F.col("match2")).alias("_match"),
        strip(F.when(by_label, F.col("value1")).otherwise(F.col("pvalue"))).alias("_value"),
        source.alias("_source"),
    )
    found = F.col("_which").isNotNull()
    folded = picked.withColumns(
        {
            "_known": L.known_prefix(F.col("_match")),
            "_folded": fold_text(F.when(found, F.col("_value"))),
        }
    )
    folded = folded.select(
        *carried,
        "kind",
        "no",
        F.when(by_label, F.col("_own")).otherwise(F.col("_known.field")).alias("field"),
        "_score",
        strip(F.when(by_label, F.col("_spelled")).otherwise(F.col("_known.alias"))).alias("_label"),
        "_value",
        "_source",
        "_folded",
    )
    valued = folded.withColumn("_missing", folded_missing(F.col("_folded"))).withColumn(
        "_normalised",
        let(
            F.col("_folded"),
            lambda folded: folded_field_value(F.col("field"), folded, missing=F.col("_missing")),
        ),
    )
    candidate = F.struct(
        F.col("_missing").alias("is_missing"),
        (-F.col("_score")).alias("score_rank"),
        F.col("kind"),
        F.col("no"),
        F.col("_label").alias("raw_label"),
        F.col("_value").alias("raw_value"),
        F.col("_source").alias("source"),
        F.col("_normalised").alias("normalised"),
    )
    return valued.select(
        *carried, "field", F.when(F.col("field").isNotNull(), candidate).alias("candidate")
    )


def field_candidates(
    docs: DataFrame, pairs: DataFrame | None = None, lines: DataFrame | None = None
) -> DataFrame:
    """All candidates of all documents; extra columns of ``docs`` are carried along.

    ``pairs(path, seq, label, value)`` and ``lines(path, line_no, raw)`` come from formats
    that are read as rows rather than as one text.
    """
    rows = text_candidates(docs)
    if lines is not None:
        rows = rows.unionByName(line_candidates(lines), allowMissingColumns=True)
    if pairs is not None:
        rows = rows.unionByName(pair_candidates(pairs), allowMissingColumns=True)
    return choose_candidate(rows)


def resolve_candidates(candidates: DataFrame) -> DataFrame:
    """One value per (path, field): usable before missing, then score, then first seen."""
    groups = candidates.where(F.col("field").isNotNull()).groupBy(
        F.xxhash64("path").alias("_path_hash"), "path", "field"
    )
    best = groups.agg(F.min("candidate").alias("best"))
    return best.select(
        "path",
        "field",
        F.col("best.raw_label").alias("raw_label"),
        F.col("best.raw_value").alias("raw_value"),
        F.col("best.source").alias("source"),
        (-F.col("best.score_rank")).alias("label_score"),
        F.col("best.normalised").alias("normalised"),
    )


def document_facts(
    docs: DataFrame, pairs: DataFrame | None = None, lines: DataFrame | None = None
) -> DataFrame:
    """One row per document: read error, wrong-type marker and the seven fields.

    ``docs(path, text, error)`` with optional ``pairs`` and ``lines`` as in
    ``field_candidates``; a field that was not found is NULL.
    """
    flagged = docs.select(
        "path",
        "text",
        "error",
        wrong_document_text(F.col("text")).alias("wrong_type"),
    )
    if lines is not None:
        lines = lines.withColumn("wrong_type", wrong_document_text(F.col("raw")))
    candidates = field_candidates(flagged, pairs, lines)
    fields = [
        F.min(F.when(F.col("field") == f, F.col("candidate"))).alias(f) for f in dims.FIELDS
    ]
    # paths begin alike; rows are sorted and told apart by a number first
    groups = candidates.groupBy(F.xxhash64("path").alias("_path_hash"), "path")
    return groups.agg(
        F.max("error").alias("error"),
        F.coalesce(F.max("wrong_type"), F.lit(False)).alias("wrong_type"),
        *fields,
    ).drop("_path_hash")


def wrong_document_text(text: Column) -> Column:
    """Does the text name a document type that is neither SI nor BL?"""
    lower = F.lower(text)
    letters = {"ſ": "s", "ﬁ": "fi", "ﬅ": "st", "ﬆ": "st"}
    folded = lower
    for letter, plain in letters.items():
        folded = F.replace(folded, F.lit(letter), F.lit(plain))
    return F.when(
        contains_any(lower, letters), contains_any(folded, dims.WRONG_DOCUMENT_MARKERS)
    ).otherwise(contains_any(lower, dims.WRONG_DOCUMENT_MARKERS))


def extract_fields(
    docs: DataFrame, pairs: DataFrame | None = None, lines: DataFrame | None = None
) -> DataFrame:
    """The extraction record per document: ``fields`` map and ``missing_fields``."""
    facts = document_facts(docs, pairs, lines)
    entries = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f).isNotNull(),
                    F.struct(
                        F.lit(f).alias("key"),
                        F.struct(
                            F.col(f"{f}.raw_label").alias("raw_label"),
                            F.col(f"{f}.raw_value").alias("raw_value"),
                            F.col(f"{f}.source").alias("source"),
                            (-F.col(f"{f}.score_rank")).alias("label_score"),
                            F.col(f"{f}.normalised").alias("normalised"),
                        ).alias("value"),
                    ),
                )
                for f in dims.FIELDS
            ]
        )
    )
    return facts.select(
        "path",
        "error",
        "wrong_type",
        F.map_from_entries(entries).alias("fields"),
        missing_fields().alias("missing_fields"),
    )


def missing_fields() -> Column:
    """Names of the fields ``document_facts`` did not find, in field order."""
    return F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in dims.FIELDS]))


def uncertain_labels(pairs: DataFrame) -> DataFrame:
    """Pair labels that no field accepts, with the whole decision.

    Distinct labels are decided once and joined back; labels that very many documents share
    are spread over several tasks.
    """
    named = pairs.where(strip(F.coalesce("label", F.lit(""))) != "")
    keyed = named.withColumn("label_key", L.read_label(F.col("label"))["key"])
    open_rows = keyed.where(L.exact_field(F.col("label_key")).isNull())
    decisions = decide_keys(open_rows.select("label_key").distinct()).where(~F.col("decision.accepted"))
    joined = spread_left_join(open_rows, decisions, "label_key", spread_by=["path", "seq"])
    return joined.where(F.col("decision").isNotNull()).select(
        "path", "seq", "label", F.lit("table").alias("source"), "decision"
    )
