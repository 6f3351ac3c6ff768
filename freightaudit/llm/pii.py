"""Personal data by patterns, and by contexts that the corpus teaches.

Base kinds (email, ip, card, phone) are found by their patterns.  They seed a bootstrap: the word
before and the word after an identifier are its lexical patterns, and every other identifier-like
token (three digits or an ``@``) is a candidate instance.  Spark builds the graph of patterns and
instances and scores it in rounds:

- a pattern's confidence is the scored occurrences of its instances over **all** occurrences of its
  word in the corpus, and 0 with fewer than ``MIN_SUPPORT`` good instances, so that common words,
  which stand before anything, earn none;
- an instance's score is 1 for a seed and otherwise the chance that one of its patterns is right.

Scores only rise from round to round.  Once none rises by ``TOLERANCE`` or more, candidates that
score ``CONFIDENCE`` or more are spans of kind ``id`` wherever they stand; base spans stay as they
are.

All of it is DataFrame functions.  Texts are scanned once for identifiers and once for word counts
and are never shuffled; positions come from a running sum over a document's own matches.

Defined results: a null text is empty and has no spans; invalid UTF-8 counts as U+FFFD; every row
gets a row, repeated rows and null ids too; positions are code points, ends exclusive; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from freightaudit.functions.once import with_columns_once
from freightaudit.sources.sinks import stored

KINDS = ["email", "ip", "card", "phone", "id"]
TOLERANCE = 1e-3
MIN_SUPPORT = 3
CONFIDENCE = 0.6

#: The kinds' patterns.  They find what the plain forms find; a look behind (or the
#: end of the last match) stands where the plain form would try every position of a long run, and
#: possessive repeats keep long matches off the stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "id": r"(?<![A-Za-z0-9])(?=[A-Za-z._%+/-]*+[0-9@])[A-Za-z0-9][A-Za-z0-9._%+@/-]*+",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _luhn(digits: Column) -> Column:
    places = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")

    def doubled(char: Column, at: Column) -> Column:
        value = char.cast("int") * (1 + at % 2)
        return F.when(value > 9, value - 9).otherwise(value)

    total = F.aggregate(F.transform(places, doubled), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    count = F.length(digits)
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
        .when(kind == "card", count.between(12, 19) & _luhn(F.left(digits, F.lit(19))))
        .when(kind == "phone", count.between(9, 15))
        .otherwise((F.length(match) >= 5) & ((count >= 3) | F.contains(match, F.lit("@"))))
    )


def scan(docs: DataFrame) -> DataFrame:
    """Every document once: row (a number), doc_id, text_hash, and per kind with matches the
    matches and the gaps around them (size, last word, first word)."""
    text = F.make_valid_utf8(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), text.alias("text"))
    may = {
        "email": F.contains("text", F.lit("@")),
        "phone": F.contains("text", F.lit("+")),
    }
    number = F.col("text").rlike("[0-9]")
    either = number | may["email"]
    may |= {"ip": number, "card": number, "id": either}
    none = F.array().cast("array<string>")
    found = with_columns_once(
        rows,
        {
            kind: F.when(
                may[kind], F.regexp_extract_all(F.col("text"), F.lit(PATTERNS[kind]), 0)
            ).otherwise(none)
            for kind in KINDS
        },
    )
    gap = "array<struct<size:int,last:string,first:string>>"
    kinds = [
        F.struct(
            F.lit(kind).alias("kind"),
            F.col(kind).alias("matches"),
            F.when(F.size(kind) > 0, F.transform(F.split("text", PATTERNS[kind], -1), _gap))
            .otherwise(F.array().cast(gap))
            .alias("gaps"),
        )
        for kind in KINDS
    ]
    return stored(
        found.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "text_hash",
            F.filter(F.array(*kinds), lambda k: F.size(k["matches"]) > 0).alias("found"),
        )
    )


def _gap(text: Column) -> Column:
    # from the end of the gap backwards, so the time is linear in its length
    last = F.regexp_extract(text, r"(?s)^(?:.*\s)?(\S+)\s*$", 1)
    first = F.regexp_extract(text, r"^\s*(\S+)", 1)
    return F.struct(
        F.char_length(text).alias("size"), F.lower(last).alias("last"), F.lower(first).alias("first")
    )


def occurrences(scanned: DataFrame) -> DataFrame:
    """(row, kind, start, end, token, last, first) of every valid match: base kinds whole,
    candidates (kind id) without closing punctuation and only where they touch no base span."""
    by_kind = scanned.select("row", F.inline("found"))
    count = F.size("matches")
    placed = by_kind.select(
        "row",
        "kind",
        F.posexplode(
            F.arrays_zip(
                F.col("matches").alias("match"),
                F.slice("gaps", 1, count).alias("before"),
                F.slice("gaps", 2, count).alias("after"),
            )
        ).alias("k", "m"),
    ).select("row", "kind", "k", "m.*")
    size = F.char_length("match")
    along = Window.partitionBy("row", "kind").orderBy("k").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = placed.withColumn("start", F.sum(F.col("before.size") + size).over(along) - size)
    token = F.when(
        F.col("kind") == "id", F.rtrim(F.col("match"), F.lit("._%+@/-"))
    ).otherwise(F.col("match"))
    valid = placed.withColumn("token", token).where(_valid(F.col("kind"), F.col("token")))
    spans = valid.select(
        "row", "kind", "start", (F.col("start") + F.char_length("token")).alias("end"),
        F.lower("token").alias("token"),
        F.col("before.last").alias("last"), F.col("after.first").alias("first"),
    )
    base = F.col("kind") != "id"
    rising, falling = (
        Window.partitionBy("row")
        .orderBy(order)
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
        for order in (F.asc("start"), F.desc("start"))
    )
    earlier = F.max(F.when(base, F.col("end"))).over(rising)
    later = F.min(F.when(base, F.col("start"))).over(falling)
    spans = spans.withColumns({"earlier": earlier, "later": later})
    free = F.coalesce(F.col("earlier") <= F.col("start"), F.lit(True)) & F.coalesce(
        F.col("later") >= F.col("end"), F.lit(True)
    )
    return spans.where(base | free).drop("earlier", "later")


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, total) over all texts, lower-cased, split at white space."""
    words = F.split(F.lower("text"), r"\s+")
    return docs.select(F.explode_outer(words).alias("word")).groupBy("word").agg(
        F.count("*").alias("total")
    )


def learned_instances(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(token, score) of the candidates that score ``CONFIDENCE`` or more."""
    sides = F.array(
        F.struct(F.lit("before").alias("side"), F.col("last").alias("word")),
        F.struct(F.lit("after").alias("side"), F.col("first").alias("word")),
    )
    edges = (
        found.select((F.col("kind") != "id").alias("seed"), "token", F.inline(sides))
        .where("word <> ''")
        .groupBy("side", "word", "token")
        .agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    )
    # only words beside a candidate can teach anything about one
    edges = stored(edges)
    asked = edges.where("not seed").select("side", "word").distinct()
    edges = edges.join(asked, ["side", "word"], "left_semi")
    counted = edges.groupBy("side", "word").agg(F.sum("n").alias("seen"))
    totals = counted.join(word_counts(docs), "word", "left").select(
        "side", "word", F.greatest("seen", F.coalesce("total", F.lit(0))).alias("total")
    )
    graph = stored(edges.join(totals, ["side", "word"]))
    scores = graph.groupBy("token").agg(F.max("seed").alias("seed")).select(
        "token", "seed", F.col("seed").cast("double").alias("score")
    )
    while True:
        before = scores.select("token", F.col("score").alias("before"))
        patterns = (
            graph.join(scores.select("token", "score"), "token")
            .groupBy("side", "word", "total")
            .agg(
                F.sum(F.col("n") * F.col("score")).alias("good"),
                F.count_if(F.col("score") >= CONFIDENCE).alias("support"),
            )
            .select(
                "side",
                "word",
                F.when(F.col("support") >= MIN_SUPPORT, F.col("good") / F.col("total"))
                .otherwise(0.0)
                .alias("confidence"),
            )
        )
        doubt = F.log(1 - F.least(F.col("confidence"), F.lit(0.9999)))
        scores = stored(
            graph.join(patterns, ["side", "word"])
            .groupBy("token")
            .agg(F.max("seed").alias("seed"), (1 - F.exp(F.sum(doubt))).alias("score"))
            .select("token", "seed", F.when(F.col("seed"), 1.0).otherwise(F.col("score")).alias("score"))
        )
        rise = F.max(F.col("score") - F.col("before"))
        # one number passes the driver; null: there is nothing to score
        if (scores.join(before, "token").agg(rise.alias("rise")).first().rise or 0.0) < TOLERANCE:
            break
    return scores.where(~F.col("seed") & (F.col("score") >= CONFIDENCE)).select("token", "score")


def spans_of(scanned: DataFrame, docs: DataFrame) -> DataFrame:
    """(row, kind, start, end): base spans and those that the bootstrap adds."""
    found = stored(occurrences(scanned))
    learned = learned_instances(found, docs)
    columns = ["row", "kind", "start", "end"]
    added = found.where("kind = 'id'").join(learned, "token", "left_semi")
    return found.where("kind <> 'id'").select(columns).union(added.select(columns))


def _written(spans: Column) -> Column:
    """kind:start:end of sorted spans (start, rank, kind, end), comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_learned), one row a document:
    the base spans counted and digested, and all spans."""
    scanned = scan(docs)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    spans = F.struct(F.col("start"), rank.alias("rank"), "kind", "end")
    per_row = (
        spans_of(scanned, docs)
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(spans)).alias("all"))
        .select("row", "all", F.filter("all", lambda s: s["kind"] != "id").alias("base"))
    )
    rows = scanned.select("row", "doc_id").join(per_row, "row", "left")

    def count(kind: str) -> Column:
        own = F.size(F.filter("all", lambda s: s["kind"] == kind))
        return F.coalesce(F.when(F.col("all").isNotNull(), own), F.lit(0)).cast("long")

    return rows.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS[:-1]],
        F.sha2(F.coalesce(_written(F.col("base")), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(_written(F.col("all")), F.lit("")).alias("spans"),
        count("id").alias("n_learned"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets (spans that overlap by that of
    the longest), and ``n_chars`` of the new text.  Texts without spans are kept as they are."""
    scanned = scan(docs)
    here = Window.partitionBy("row").orderBy("start", "end").rowsBetween(
        Window.unboundedPreceding, -1
    )
    spans = spans_of(scanned, docs).withColumn("reached", F.max("end").over(here))
    opens = F.coalesce((F.col("start") >= F.col("reached")).cast("int"), F.lit(1))
    upto = Window.partitionBy("row").orderBy("start", "end").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    islands = (
        spans.withColumn("island", F.sum(opens).over(upto))
        .groupBy("row", "island")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.max_by("kind", F.struct(F.col("end") - F.col("start"), "kind")).alias("kind"),
        )
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("_spans"))
    )
    # equal rows have equal spans, so one of them stands for all
    of_text = (
        scanned.select("row", F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"))
        .join(islands, "row")
        .drop("row")
        .dropDuplicates(["_doc", "_hash"])
    )
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "text")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_hash"))
    text = F.make_valid_utf8("text")

    def piece(span: Column, at: Column) -> Column:
        before = F.when(at == 0, F.lit(0)).otherwise(F.try_element_at("_spans", at)["end"])
        kept = F.substring(text, before + 1, span["start"] - before)
        return F.concat(kept, F.lit("["), F.upper(span["kind"]), F.lit("]"))

    rest = F.substring(text, F.element_at("_spans", -1)["end"] + 1, F.char_length(text))
    changed = F.concat(F.array_join(F.transform("_spans", piece), ""), rest)
    marked = F.col("_spans").isNotNull()
    new = {"text": F.when(marked, changed).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(marked, F.char_length(changed).cast("long")).otherwise(
            F.col("_row.n_chars")
        )
    joined = rows.join(of_text, same, "left")
    return joined.select([new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
