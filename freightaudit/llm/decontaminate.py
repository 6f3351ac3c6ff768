"""Benchmark decontamination by template canonicalisation.

A text becomes a template: numbers, the units behind them, and names (runs of capitalised words
within a sentence) are replaced by typed placeholders, the rest is lower-cased words.  Windows of
``WINDOW`` template tokens are hashed and joined to the windows of the benchmark's items, so a
question asked again with other numbers or names still meets its item.  What meets is aligned, and
the slots of an alignment are compared: one value of the item must stand for one value of the
document throughout, and the other way round.  Alignments that break this are not copies and are
dropped.  A document holds an item if the windows that are left cover ``MIN_COVERAGE`` of the
item's windows, or ``RUN`` consecutive tokens of it in one alignment.

Names are known by their capitals, which a copy in other case does not keep.  So the same is done a
second time with lower-cased words that have placeholders for numbers and units only, and what
either way finds counts.  Windows with less than half words of their own (the rest placeholders) say
nothing as templates: they are left out the first time, and the second time compared by value, as
are items of up to ``SHORT`` tokens.  An item of fewer than ``WINDOW`` tokens is one window.  All of
it is DataFrame functions.  Only benchmark windows are broadcast, and only if there are at most
``MAX_BROADCAST``; beyond that the same join is a shuffle.

Defined results: null texts and texts without words hold nothing and are never found; items go by
their text, and equal items are found each; rows that share an id and a text are one document, rows
that share only an id are judged apart and reported under it; null ids of documents and items are
reported as null; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightaudit.functions.once import with_columns_once
from freightaudit.sources.sinks import stored

WINDOW = 8
MIN_COVERAGE = 0.5
#: Consecutive tokens of an item that a document holds it by, however long the item is.
RUN = 13
#: Items of so few tokens are held only as they stand, without slots.
SHORT = 2
MAX_BROADCAST = 1_000_000

NUMBER, NAME, UNIT = "1", "2", "3"
#: Words that are units behind a number.
UNITS = [
    "%", "percent", "kg", "g", "mg", "lb", "lbs", "oz", "t", "tons", "km", "m", "cm", "mm", "mi",
    "miles", "ft", "feet", "inches", "yards", "l", "ml", "litres", "liters", "gallons", "h",
    "hours", "hour", "min", "minutes", "minute", "s", "seconds", "days", "day", "weeks", "months",
    "years", "usd", "eur", "dollars", "euros", "cents", "degrees",
]
NUMBER_PATTERN = r"[0-9]+(?:[.,:/][0-9]+)*"
UNIT_PATTERN = rf"(?i)( {NUMBER} ) *({'|'.join(UNITS)})([^\p{{L}}\p{{N}}]|$)"
NAME_PATTERN = r"([\p{Ll}0-9,;:(] +)(\p{Lu}[\p{L}'-]*(?: \p{Lu}[\p{L}'-]*)*)"
#: A letter that stands for a point within a number.
POINT = "\u02d0"
BREAKS = r"[^\p{L}\p{N}]+"


def _with_units(text: Column) -> Column:
    """Numbers replaced, then the units behind them."""
    numbers = F.regexp_replace(text, NUMBER_PATTERN, f" {NUMBER} ")
    return F.regexp_replace(numbers, UNIT_PATTERN, f"$1 {UNIT} $3")


def template_tokens(text: Column) -> Column:
    """The template of a text: words in lower case, and placeholders."""
    names = F.regexp_replace(_with_units(text), NAME_PATTERN, f"$1 {NAME} ")
    return F.array_remove(F.split(F.lower(names), BREAKS), "")


def slots(text: Column, tokens: Column) -> Column:
    """array<struct<at, kind, value>>: the values behind a template's placeholders, by position
    (from 1).  The n-th placeholder of a kind stands for the n-th match of its pattern."""
    numbers = F.regexp_replace(text, NUMBER_PATTERN, f" {NUMBER} ")
    values = {
        NUMBER: F.regexp_extract_all(text, F.lit(NUMBER_PATTERN), 0),
        UNIT: F.regexp_extract_all(numbers, F.lit(UNIT_PATTERN), 2),
        NAME: F.regexp_extract_all(_with_units(text), F.lit(NAME_PATTERN), 2),
    }
    found = [_placed(kind, own, tokens) for kind, own in values.items()]
    return F.filter(F.concat(*found), lambda s: s["at"].isNotNull())


def _placed(kind: str, values: Column, tokens: Column) -> Column:
    places = F.transform(tokens, lambda t, i: F.when(t == kind, i + 1))
    return F.zip_with(
        F.array_compact(places),
        values,
        lambda i, v: F.struct(i.alias("at"), F.lit(kind).alias("kind"), F.lower(v).alias("value")),
    )


def literal_slots(tokens: Column) -> Column:
    """As ``slots``, of literal tokens."""
    found = F.transform(
        F.arrays_zip(slotted(tokens).alias("kind"), tokens.alias("value")),
        lambda t, i: F.struct((i + 1).alias("at"), t["kind"].alias("kind"), t["value"].alias("value")),
    )
    return F.filter(found, lambda t: t["kind"].isin(NUMBER, UNIT))


#: A window's number is its start, plus this for every size before its own.
_STARTS = 1 << 40


def placed(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """``rows`` (…, tokens) exploded to windows of the given sizes: at (from 1), size.

    Windows are exploded from plain sequences: with a lambda in that step, Spark would copy a text's
    arrays for every window of it, which is quadratic in the length of the text.  The outer explode
    keeps the optimizer from copying ``tokens`` into a filter of its own.
    """
    count = F.size("tokens").cast("long")
    numbers = [
        F.when(
            count >= size, F.sequence(F.lit(i * _STARTS + 1), i * _STARTS + count - (size - 1))
        ).otherwise(F.array().cast("array<bigint>"))
        for i, size in enumerate(sizes)
    ]
    number = F.explode_outer(F.concat(*numbers)).alias("w")
    size = F.lit(sizes[0])
    for i, other in enumerate(sizes[1:], 1):
        size = F.when(F.col("w") >= i * _STARTS, other).otherwise(size)
    found = rows.select("*", number).where("w is not null")
    at = (F.col("w") % _STARTS).cast("int").alias("at")
    return found.select(*rows.columns, at, size.alias("size"))


def windows(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """``rows`` (…, tokens) exploded to windows of the given sizes: at (from 1), hash."""
    kept = [c for c in rows.columns if c != "tokens"]
    cut = F.slice("tokens", F.col("at"), F.col("size"))
    return placed(rows, sizes).select(*kept, "at", F.xxhash64(cut).alias("hash"))


def literal_tokens(text: Column) -> Column:
    """The words and numbers of a text as they stand, in lower case; a number is one token."""
    joined = F.regexp_replace(text, "(?<=[0-9])[.,:/](?=[0-9])", POINT)
    spaced = F.regexp_replace(joined, f"[0-9]+(?:{POINT}[0-9]+)*", " $0 ")
    return F.array_remove(F.split(F.lower(spaced), BREAKS), "")


def slotted(tokens: Column) -> Column:
    """Literal tokens with placeholders for numbers and the units behind them, but not for names."""
    number = lambda t: (t >= "0") & (t < ":")
    return F.transform(
        tokens,
        lambda t, i: F.when(number(t), NUMBER)
        .when(t.isin(UNITS) & (i > 0) & number(F.get(tokens, i - 1)), UNIT)
        .otherwise(t),
    )


def _own_words(cut: Column) -> Column:
    return F.size(F.array_remove(F.array_remove(F.array_remove(cut, NUMBER), UNIT), NAME))


def _literal_hash(tokens: str, plain: str, at: Column, size: Column) -> Column:
    """The hash of a window without name placeholders: by value where placeholders outnumber words
    and in very short windows, else with slots."""
    cut = F.slice(plain, at, size)
    by_value = (2 * _own_words(cut) < size) | (size <= SHORT)
    return F.when(by_value, F.xxhash64(F.lit("v"), F.slice(tokens, at, size))).otherwise(
        F.xxhash64(F.lit("s"), cut)
    )


def literal_windows(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """As ``windows``, of ``rows`` (…, tokens) with literal tokens."""
    kept = [c for c in rows.columns if c != "tokens"]
    both = with_columns_once(rows, {"plain": slotted(F.col("tokens"))})
    hashed = _literal_hash("tokens", "plain", F.col("at"), F.col("size"))
    return placed(both, sizes).select(*kept, "at", hashed.alias("hash"))


def item_windows(items: DataFrame) -> DataFrame:
    """(item, literal, at, size, hash): windows of the benchmark (item, tokens, words) that count:
    of the template those with enough words, without name placeholders all."""
    found = []
    for literal, column in ((False, "tokens"), (True, "words")):
        size = F.least(F.size(column), F.lit(WINDOW))
        placed = items.where(F.size(column) > 0).select(
            "item",
            F.col(column).alias("tokens"),
            slotted(F.col(column)).alias("plain") if literal else F.lit(None).alias("plain"),
            size.alias("size"),
            F.explode(F.sequence(F.lit(1), F.size(column) - size + 1)).alias("at"),
        )
        if literal:
            hashed = _literal_hash("tokens", "plain", F.col("at"), F.col("size"))
        else:
            cut = F.slice("tokens", F.col("at"), F.col("size"))
            placed = placed.where((2 * _own_words(cut) >= F.col("size")) & (F.col("size") > SHORT))
            hashed = F.xxhash64(cut)
        found.append(
            placed.select("item", F.lit(literal).alias("literal"), "at", "size", hashed.alias("hash"))
        )
    return found[0].union(found[1])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE
) -> DataFrame:
    """(doc_id, text_hash, item_id, windows, matched, slots, changed): every item that a document
    holds, how many windows the item has and how many were found, and how many slots were compared
    and how many of them hold another value than the item's (0 for a plain copy).  The counts are
    of the template, or of the windows without name placeholders where only these are held."""
    named = benchmark.where("text is not null").select("item_id", "text").distinct()
    named = named.withColumn("item", F.xxhash64("text"))
    items = stored(
        named.select("item", "text").dropDuplicates(["item"]).select(
            "item",
            "text",
            template_tokens(F.col("text")).alias("tokens"),
            literal_tokens(F.col("text")).alias("words"),
        )
    )
    known = stored(item_windows(items))
    sizes: dict[bool, list[int]] = {False: [], True: []}
    for row in known.select("literal", "size").distinct().orderBy("size").collect():
        sizes[row.literal].append(row.size)
    total = known.groupBy("item", "literal").agg(F.count("*").alias("windows"))
    wanted = known.select("item", "literal", F.col("at").alias("item_at"), "hash")
    small = known.count() <= MAX_BROADCAST
    found = []
    for literal, cut, of_text in (
        (False, windows, template_tokens), (True, literal_windows, literal_tokens),
    ):
        texts = docs.select(
            "doc_id", F.xxhash64("text").alias("text_hash"), of_text(F.col("text")).alias("tokens")
        )
        own = wanted.where(F.col("literal") == literal)
        own = F.broadcast(own) if small else own
        found.append(cut(texts, sizes[literal] or [WINDOW]).join(own, "hash"))
    met = found[0].unionByName(found[1])
    met = stored(
        met.select(
            F.col("doc_id").alias("_doc"),
            "text_hash",
            "item",
            "literal",
            "item_at",
            (F.col("at") - F.col("item_at")).alias("by"),
        ).distinct()
    )
    keys = ["_doc", "text_hash", "item", "literal"]
    compared = _compared_slots(docs, items, met)
    broken = compared.where("not consistent").select(*keys, "by")
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*keys, "by"]]
    sound = met.alias("m").join(broken.alias("b"), same, "left_anti")
    placed = sound.groupBy(*keys, "by").agg(F.sort_array(F.collect_set("item_at")).alias("places"))
    matched = placed.groupBy(*keys).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("matched"),
        F.max(_has_run(F.col("places"))).alias("run"),
    )
    held = matched.join(total, ["item", "literal"]).where(
        F.col("run") | (F.col("matched") >= min_coverage * F.col("windows"))
    )
    counted = (
        compared.where("consistent")
        .groupBy(*keys)
        .agg(F.sum("slots").alias("slots"), F.sum("changed").alias("changed"))
    )
    same = [F.col(f"h.{c}").eqNullSafe(F.col(f"c.{c}")) for c in keys]
    figures = F.struct(
        F.col("h.literal").alias("literal"),
        "windows",
        "matched",
        F.coalesce("slots", F.lit(0)).alias("slots"),
        F.coalesce("changed", F.lit(0)).alias("changed"),
    )
    rows = held.alias("h").join(counted.alias("c"), same, "left").select(
        *[F.col(f"h.{c}").alias(c) for c in keys[:-1]], figures.alias("f")
    )
    rows = rows.groupBy(*keys[:-1]).agg(F.min("f").alias("f"))
    return rows.join(named.select("item", "item_id"), "item").select(
        F.col("_doc").alias("doc_id"),
        "text_hash",
        "item_id",
        *[F.col(f"f.{c}").alias(c) for c in ("windows", "matched", "slots", "changed")],
    )


def _has_run(places: Column) -> Column:
    """Whether ``RUN`` consecutive tokens are found, by the sorted places of one alignment."""
    more = RUN - WINDOW
    return F.exists(
        F.transform(places, lambda p, i: F.get(places, i + more) == p + more),
        lambda whole: F.coalesce(whole, F.lit(False)),
    )


def _compared_slots(docs: DataFrame, items: DataFrame, met: DataFrame) -> DataFrame:
    """For every alignment with slots: their number, how many hold another value than the item's,
    and whether values correspond one to one within each kind."""
    keys = ["_doc", "text_hash", "item", "literal", "by"]
    found = []
    for literal, of_text in (
        (False, lambda text: slots(text, template_tokens(text))),
        (True, lambda text: literal_slots(literal_tokens(text))),
    ):
        item_slots = items.select("item", F.inline(of_text(F.col("text")))).toDF(
            "item", "item_slot", "kind", "item_value"
        )
        asked = (
            met.where(F.col("literal") == literal)
            .join(item_slots, "item")
            .where(F.col("item_slot").between(F.col("item_at"), F.col("item_at") + WINDOW - 1))
            .select(*keys, "kind", "item_value", (F.col("item_slot") + F.col("by")).alias("at"))
            .distinct()
        )
        asked = stored(asked)
        # only texts of which an alignment has a slot are read for their slots
        texts = docs.select(F.xxhash64("text").alias("text_hash"), "text")
        texts = texts.join(asked.select("text_hash").distinct(), "text_hash", "left_semi")
        values = texts.select("text_hash", F.inline(of_text(F.col("text")))).distinct()
        found.append(asked.join(values, ["text_hash", "kind", "at"]))
    pairs = found[0].unionByName(found[1])
    return (
        pairs.groupBy(*keys, "kind")
        .agg(
            F.count("*").alias("slots"),
            F.sum((F.col("value") != F.col("item_value")).cast("int")).alias("changed"),
            F.count_distinct("item_value").alias("theirs"),
            F.count_distinct("value").alias("ours"),
            F.count_distinct("item_value", "value").alias("both"),
        )
        .groupBy(*keys)
        .agg(
            F.sum("slots").alias("slots"),
            F.sum("changed").alias("changed"),
            F.every((F.col("both") == F.col("theirs")) & (F.col("both") == F.col("ours"))).alias(
                "consistent"
            ),
        )
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    found = contaminated(docs, benchmark)
    bad = found.select("doc_id", "text_hash").distinct().toDF("bad_id", "bad_hash")
    same = docs["doc_id"].eqNullSafe(bad["bad_id"]) & (
        F.xxhash64(docs["text"]) == bad["bad_hash"]
    )
    return docs.join(bad, same, "left_anti")
