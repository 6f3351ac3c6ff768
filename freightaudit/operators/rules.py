"""Rule-based mail classification.

All five category scores are array expressions on the mail's own row, so classifying needs
no shuffle and no join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightaudit import dims
from freightaudit.functions import text as X
from freightaudit.functions.once import with_columns_once
from freightaudit.operators.joins import find_si_bl_paths


def _or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def mail_words(mails: DataFrame) -> DataFrame:
    """(email_id, part, word): the useful words of subject and current body, repeats kept."""
    parts = F.array(
        F.struct(F.lit("subject").alias("part"), X.extract_words(_or_empty("subject")).alias("w")),
        F.struct(
            F.lit("body").alias("part"),
            X.extract_words(X.remove_boilerplate(_or_empty("body"))).alias("w"),
        ),
    )
    return (
        mails.select("email_id", F.explode(parts).alias("p"))
        .select("email_id", "p.part", F.explode("p.w").alias("word"))
    )


def keyword_dimension() -> Column:
    """The keyword lists as a literal map: word -> categories."""
    by_word: dict[str, list[str]] = {}
    for category in dims.RULE_CATEGORIES:
        for word in dims.KEYWORDS[category]:
            by_word.setdefault(word, []).append(category)
    return F.create_map(
        *[x for word, cats in by_word.items() for x in (F.lit(word), X.strings(cats))]
    )


def count_matches(mails: DataFrame) -> DataFrame:
    """(email_id, part, category, keyword, n): occurrences of every matched keyword."""
    categories = F.try_element_at(keyword_dimension(), F.col("word"))
    return (
        mail_words(mails)
        .select("email_id", "part", F.col("word").alias("keyword"), categories.alias("cats"))
        .where(F.col("cats").isNotNull())
        .groupBy("email_id", "part", "keyword")
        .agg(F.count("*").alias("n"), F.first("cats").alias("cats"))
        .select("email_id", "part", F.explode("cats").alias("category"), "keyword", "n")
    )


def matched_phrases(mails: DataFrame) -> DataFrame:
    """(email_id, part, category, phrases): contained phrases in alphabetical order."""
    rows = []
    texts = {
        "subject": X.normalise_text(_or_empty("subject")),
        "body": X.normalise_text(X.remove_boilerplate(_or_empty("body"))),
    }
    mails = with_columns_once(
        mails.select("email_id", "subject", "body"), {f"_{part}": t for part, t in texts.items()}
    )
    for part in texts:
        norm = F.col(f"_{part}")
        for category in dims.RULE_CATEGORIES:
            rows.append(
                F.struct(
                    F.lit(part).alias("part"),
                    F.lit(category).alias("category"),
                    X.found_phrases(norm, dims.PHRASES[category]).alias("phrases"),
                )
            )
    return (
        mails.select("email_id", F.explode(F.array(*rows)).alias("r"))
        .select("email_id", "r.*")
        .where(F.size("phrases") > 0)
    )


def _matched(words: Column, category: str) -> Column:
    # Keywords are never stopwords and never too short, so the unfiltered words serve.
    return F.array_intersect(words, X.strings(dims.KEYWORDS[category]))


def category_scores(mails: DataFrame, evidence: bool = False) -> DataFrame:
    """Adds ``scores``: one struct per category, in rule order.

    With ``evidence`` the matched keywords and phrases are included.
    """
    prepared = mails.withColumns(
        {"_subject": _or_empty("subject"), "_body": X.remove_boilerplate(_or_empty("body"))}
    ).withColumns(
        {
            "_sw": X.letter_words(F.col("_subject")),
            "_bw": X.letter_words(F.col("_body")),
            "_sn": X.normalise_text(F.col("_subject")),
            "_bn": X.normalise_text(F.col("_body")),
        }
    )
    scores = []
    for order, category in enumerate(dims.RULE_CATEGORIES):
        phrases = dims.PHRASES[category]
        in_subject = _matched(F.col("_sw"), category)
        in_body = _matched(F.col("_bw"), category)
        subject_points = F.size(in_subject) * dims.SUBJECT_KEYWORD_WEIGHT
        body_points = F.size(in_body) * dims.BODY_KEYWORD_WEIGHT
        bonus = (
            X.count_phrases(F.col("_sn"), phrases) * dims.SUBJECT_PHRASE_WEIGHT
            + X.count_phrases(F.col("_bn"), phrases) * dims.BODY_PHRASE_WEIGHT
        )
        parts = [
            (subject_points + body_points + bonus).alias("total_score"),
            subject_points.alias("subject_keyword_score"),
            bonus.alias("phrase_bonus"),
            F.lit(-order).alias("cat_rank"),
            body_points.alias("body_keyword_score"),
            F.lit(category).alias("category"),
        ]
        if evidence:
            parts += [
                F.array_sort(in_subject).alias("subject_matches"),
                F.array_sort(in_body).alias("body_matches"),
                X.found_phrases(F.col("_sn"), phrases).alias("subject_phrases"),
                X.found_phrases(F.col("_bn"), phrases).alias("body_phrases"),
            ]
        scores.append(F.struct(*parts))
    return with_columns_once(prepared, {"scores": F.array(*scores)}).drop(
        "_subject", "_body", "_sw", "_bw", "_sn", "_bn"
    )


def ranked_category(scores: Column) -> Column:
    """Winner by total, subject keywords, phrases, then rule order; no evidence: GENERAL."""
    best = F.array_max(scores)
    return F.when(best["total_score"] == 0, F.lit("GENERAL")).otherwise(best["category"])


def has_si_bl_pair(attachments: Column) -> Column:
    paths = find_si_bl_paths(attachments)
    return (F.coalesce(paths["si_path"], F.lit("")) != "") & (
        F.coalesce(paths["bl_path"], F.lit("")) != ""
    )


#: The columns that a rule decision adds to a mail.
RULE_COLUMNS = [
    "rule_category", "keyword_category", "routing_reason", "winning_score", "score_margin",
    "ambiguous", "scores",
]


def classify_by_rules(mails: DataFrame, evidence: bool = False) -> DataFrame:
    """Adds the rule decision to every mail.

    Columns: ``rule_category``, ``keyword_category``, ``routing_reason``, ``winning_score``,
    ``score_margin``, ``ambiguous``, ``scores``.
    """
    scored = category_scores(mails, evidence).withColumn(
        "keyword_category", ranked_category(F.col("scores"))
    )
    pair = has_si_bl_pair(F.coalesce("attachments", X.no_strings()))
    scored = scored.withColumns(
        {
            "rule_category": F.when(pair, F.lit("BL_COMPARISON")).otherwise(
                F.col("keyword_category")
            ),
            "routing_reason": F.when(pair, F.lit("si_bl_attachment_pair")).otherwise(
                F.lit("keyword_score")
            ),
        }
    )
    totals = {
        c: F.col("scores")[i]["total_score"] for i, c in enumerate(dims.RULE_CATEGORIES)
    }
    winning = F.coalesce(*[F.when(F.col("rule_category") == c, t) for c, t in totals.items()])
    runner_up = F.greatest(
        *[F.when(F.col("rule_category") != c, t) for c, t in totals.items()]
    )
    return scored.withColumns(
        {"winning_score": winning, "score_margin": winning - runner_up}
    ).withColumn(
        "ambiguous",
        (F.col("routing_reason") == "keyword_score")
        & (F.col("winning_score") > 0)
        & (F.col("score_margin") == 0),
    )


def needs_attachment_review(subject: Column, body: Column, attachments: Column) -> Column:
    """A comparison that lacks files, as opposed to a normal request for a draft."""
    count = F.coalesce(F.size(attachments), F.lit(0))
    text = X.normalise_text(
        F.concat(F.coalesce(subject, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")))
    )
    return (count == 1) | ((count < 1) & X.contains_any(text, dims.ATTACHMENT_PHRASES))


def attachment_roles(attachments: Column) -> Column:
    """Looser SI/BL detection over raw attachment JSON (``VARIANT``); the last match wins.

    Accepts an object of roles, a list of objects and a list of names.
    """

    def text(value: Column, path: str) -> Column:
        return F.try_variant_get(value, path, "string")

    def first_text(value: Column, *names: str) -> Column:
        return F.coalesce(*[F.nullif(text(value, f"$.{n}"), F.lit("")) for n in names])

    def kind_of_object(item: Column) -> Column:
        role = F.lower(F.coalesce(first_text(item, "role", "type", "name"), F.lit("")))
        return F.when(X.contains_any(role, ["si", "shipping"]), F.lit("si")).when(
            X.contains_any(role, ["bl", "lading"]), F.lit("bl")
        )

    def kind_of_name(item: Column) -> Column:
        name = F.lower(text(item, "$"))

        def named(short: str, long: str) -> Column:
            return X.contains_any(
                name, [f"_{short}.", f"_{short}_", long, f"/{short}_"]
            ) | name.endswith(f"_{short}")

        return F.when(named("si", "shipping_instruction"), F.lit("si")).when(
            named("bl", "bill_of_lading"), F.lit("bl")
        )

    items = F.try_variant_get(attachments, "$", "array<variant>")

    def role_of(item: Column) -> Column:
        is_object = F.schema_of_variant(item).startswith("OBJECT")
        return F.struct(
            F.when(is_object, kind_of_object(item)).otherwise(kind_of_name(item)).alias("kind"),
            F.when(is_object, first_text(item, "path", "filename", "file"))
            .otherwise(text(item, "$"))
            .alias("path"),
        )

    roles = F.transform(items, role_of)

    def last(kind: str) -> Column:
        return F.try_element_at(F.filter(roles, lambda r: r["kind"] == kind), F.lit(-1))["path"]

    is_map = F.schema_of_variant(attachments).startswith("OBJECT")
    return F.struct(
        F.when(is_map, first_text(attachments, "si", "shipping_instruction"))
        .otherwise(last("si"))
        .alias("si_path"),
        F.when(is_map, first_text(attachments, "bl", "bill_of_lading"))
        .otherwise(last("bl"))
        .alias("bl_path"),
    )


# ----------------------------------------------------------------- model and LLM stages


def structural_tokens(mails: DataFrame, use_sender_features: bool = True) -> Column:
    """Attachment, sender and reply evidence as a blank-separated list of tokens."""
    attachments = F.coalesce("attachments", X.no_strings())
    domain = F.substring_index(F.lower(_or_empty("from")), "@", -1)

    def clean(value: Column) -> Column:
        return F.regexp_replace(value, "[^a-z0-9]", "")

    def has(kind: str) -> Column:
        return F.exists(attachments, lambda path: path.rlike(rf"(?i)_{kind}\."))

    tokens = [
        F.concat(F.lit("ATTCOUNT"), F.least(F.size(attachments), F.lit(3)).cast("string")),
        F.when(has("SI"), F.lit("HASSIATT")),
        F.when(has("BL"), F.lit("HASBLATT")),
    ]
    if use_sender_features:
        tokens += [
            F.concat(F.lit("DOMAIN_"), clean(domain)),
            F.concat(F.lit("TLD_"), clean(F.substring_index(domain, ".", -1))),
        ]
    tokens.append(F.when(_or_empty("subject").rlike(rf"(?iU)^{X.WS}*re\b"), F.lit("ISREPLY")))
    return F.concat_ws(" ", *tokens)


def _mail_content() -> tuple[Column, Column]:
    """(subject and body, the same plus attachments), lower case."""
    subject, body = (X.strip(_or_empty(c)) for c in ("subject", "body"))
    content = F.lower(F.concat(subject, F.lit(" "), body))
    names = F.concat_ws("', '", F.coalesce("attachments", X.no_strings()))
    return content, F.concat(content, F.lit(" "), F.lower(names))


def spam_prefilter() -> Column:
    content, _ = _mail_content()
    return X.contains_any(content, dims.SPAM_MARKERS) & ~X.contains_any(
        content, dims.SHIPPING_MARKERS
    )


def intent_flags() -> Column:
    """Plain substring tests: short markers also match inside longer words."""
    _, full = _mail_content()
    return F.struct(
        X.contains_any(full, dims.SI_MARKERS).alias("has_si"),
        X.contains_any(full, dims.BL_MARKERS).alias("has_bl"),
        X.contains_any(full, dims.COMPARE_MARKERS).alias("has_compare"),
        full.contains("draft").alias("has_draft"),
    )


def intent_prefilter() -> Column:
    """Category decided without a model, or NULL: the mail goes to the request table."""
    flags = intent_flags()
    return (
        F.when(spam_prefilter(), F.lit("SPAM"))
        .when(
            flags["has_compare"] | (flags["has_si"] & flags["has_bl"] & flags["has_draft"]),
            F.lit("BL_COMPARISON"),
        )
        .when(flags["has_si"] & ~flags["has_bl"], F.lit("SI_REQUEST"))
    )


def llm_request_rows(mails: DataFrame, body_chars: int | None = None) -> DataFrame:
    """The request text of every mail that the heuristics leave open.

    The body is whole unless ``body_chars`` says how much of it the receiver takes.
    """
    subject, body = (X.strip(_or_empty(c)) for c in ("subject", "body"))
    if body_chars is not None:
        body = F.left(body, F.lit(body_chars))
    listed = F.to_json(
        F.coalesce("attachments", X.no_strings()), {"writeNonAsciiCharacterAsCodePoint": "true"}
    )
    # quotes within a name are escaped, so this stands only between names
    names = F.replace(listed, F.lit('","'), F.lit('", "'))
    prompt = F.concat(
        F.lit("Subject: "), subject,
        F.lit("\nAttachments: "), names, F.lit("\n\nEmail Body:\n"), body,
    )
    return mails.where(intent_prefilter().isNull()).select("email_id", prompt.alias("prompt"))


def parse_llm_category(response: Column) -> Column:
    """Category named in a JSON response: exact, else the first one contained, else NULL."""
    # as the only element of a list, a response with anything behind its object does not parse
    listed = F.try_parse_json(F.concat(F.lit("["), response, F.lit("]")))
    alone = F.try_variant_get(listed, "$[1]", "variant").isNull()
    raw = F.when(alone, F.try_variant_get(listed, "$[0].category", "string"))
    category = X.strip(F.lower(raw))
    known = [c.lower() for c in dims.CATEGORIES]
    contained = [F.when(category.contains(c), F.lit(c.upper())) for c in known]
    return F.coalesce(F.when(category.isin(known), F.upper(category)), *contained)


def llm_fallback() -> Column:
    """Category when no usable response exists."""
    content, _ = _mail_content()
    flags = intent_flags()
    subject = F.lower(_or_empty("subject"))
    return (
        F.when(flags["has_compare"] | (flags["has_si"] & flags["has_bl"]), F.lit("BL_COMPARISON"))
        .when(
            flags["has_si"] | X.contains_any(content, dims.SI_FALLBACK_MARKERS),
            F.lit("SI_REQUEST"),
        )
        .when(X.contains_any(subject, dims.INVOICE_SUBJECT_MARKERS), F.lit("INVOICE_QUERY"))
        .otherwise(F.lit("GENERAL"))
    )


def llm_stage(response: Column) -> Column:
    """The whole LLM stage over a response obtained earlier (may be NULL)."""
    return F.coalesce(intent_prefilter(), parse_llm_category(response), llm_fallback())


def cascade(
    mails: DataFrame,
    probabilities: DataFrame | None = None,
    llm_responses: DataFrame | None = None,
    threshold: float = dims.MODEL_THRESHOLD,
    evidence: bool = False,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Cheapest stage that can decide: file pair, model, LLM table, keywords.

    ``probabilities(email_id, probabilities MAP<STRING, DOUBLE>)`` and
    ``llm_responses(email_id, response)`` are optional stages.  Adds ``category``,
    ``confidence``, ``source`` to the columns of ``classify_by_rules``.  Whatever reads a text is
    worked out before those tables are joined; with ``keep``, only the named columns of the mails
    (and the rule decision) go through the joins.
    """
    rows = classify_by_rules(mails, evidence)
    if llm_responses is not None:
        rows = with_columns_once(
            rows, {"_prefilter": intent_prefilter(), "_fallback": llm_fallback()}
        )
    if keep is not None:
        early = [c for c in ("_prefilter", "_fallback") if c in rows.columns]
        rows = rows.select("email_id", *keep, *RULE_COLUMNS, *early)
    if probabilities is None:
        rows = rows.withColumn("probabilities", F.lit(None).cast("map<string,double>"))
    else:
        rows = rows.join(probabilities.select("email_id", "probabilities"), "email_id", "left")
    if llm_responses is not None:
        rows = rows.join(
            llm_responses.select("email_id", F.col("response").alias("_response")),
            "email_id",
            "left",
        )
    # classes compete in alphabetical order, the first of equals wins
    ranked = [
        F.struct(
            F.try_element_at("probabilities", F.lit(category)).alias("p"),
            F.lit(-order).alias("rank"),
            F.lit(category).alias("c"),
        )
        for order, category in enumerate(sorted(dims.CATEGORIES))
    ]
    top = F.array_max(F.array(*ranked))
    rows = rows.withColumn("_top", top)
    pair = F.col("routing_reason") == "si_bl_attachment_pair"
    sure = F.col("_top.p") >= threshold
    confidence = F.col("_top.p")

    def decided(category: Column, confidence: Column, source: str) -> Column:
        return F.struct(
            category.alias("category"),
            confidence.cast("double").alias("confidence"),
            F.lit(source).alias("source"),
        )

    choice = F.when(pair, decided(F.lit("BL_COMPARISON"), F.lit(1.0), "attachment_pair")).when(
        sure, decided(F.col("_top.c"), confidence, "ml_model")
    )
    if llm_responses is None:
        choice = choice.otherwise(
            decided(F.col("keyword_category"), confidence, "keyword_fallback")
        )
    else:
        answered = F.coalesce("_prefilter", parse_llm_category(F.col("_response")), "_fallback")
        choice = choice.otherwise(decided(answered, confidence, "llm"))
    rows = with_columns_once(rows, {"_choice": choice}).withColumns(
        {c: F.col(f"_choice.{c}") for c in ("category", "confidence", "source")}
    )
    return rows.drop("_choice", "_top", "_response", "_prefilter", "_fallback")


def low_conf_list(decisions: DataFrame) -> DataFrame:
    """Mails decided neither by the model nor by a file pair."""
    return decisions.where(~F.col("source").isin("ml_model", "attachment_pair"))
