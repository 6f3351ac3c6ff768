"""URL filter by empirical-Bayes host reputation.

Labelled page outcomes (bad or good) are counted by host.  A host's bad rate is shrunk toward that
of its registered domain, the domain's toward its suffix's, and the suffix's toward the rate of all
pages, each level by a beta-binomial prior whose strength comes from how much the units of that
level differ beyond chance (moments).  A page is blocked if the lower posterior bound of its host's
bad rate (mean less ``Z`` standard deviations) exceeds ``MAX_BAD``; hosts without labelled pages
have their domain's mean and the prior's strength.  Explicit rules come first: the longest that
fits decides.

All work is on narrow columns: pages are counted to hosts before anything is joined, and only the
strengths, three numbers, pass the driver.  The join of pages to hosts may have a host with a third
of the rows on its large side; Spark splits such a partition at run time (skew join).

Defined results: a null url, or one without ``://``, has an empty host and path and is judged like
any other host (no domain, no suffix); hosts of digits and dots, or in brackets, are their own
domain; ports and user names do not count for the domain; without any label all is allowed unless a
rule blocks; null outcomes are no outcomes; repeated rows are kept; an empty table gives an empty
result.  Of rules of equal length the first listed wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightaudit.sources.sinks import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
Z, MAX_BAD = 1.96, 0.5
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 10_000.0


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    text = F.coalesce(F.col(url), F.lit(""))
    return pages.withColumns(
        {
            "host": F.translate(F.regexp_extract(text, URL, 1), UPPER, LOWER),
            "path": F.regexp_extract(text, URL, 2),
        }
    )


def rule_verdict(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of ``host`` and ``path`` by ``rules`` of (allow or block, host/path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    longest_last = sorted(reversed(rules), key=lambda r: len(r[1]))
    for what, pattern in longest_last:
        host, _, path = pattern.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith(
            "path", F.lit(f"/{path}")
        )
        rule = F.when(fits, F.lit(pattern)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def with_domain_and_suffix(hosts: DataFrame, suffixes: Sequence[str] = ()) -> DataFrame:
    """``hosts`` with ``suffix``, the longest of ``suffixes`` (such as ``co.uk``) that the name ends
    with and otherwise its last label, and ``domain``, the suffix and the label before it."""
    name = F.regexp_replace("host", r"^.*@|:[0-9]*$", "")
    plain = (name == "") | name.rlike(r"^[0-9.]+$") | name.rlike(r"^\[")
    by_labels: dict[int, list[str]] = {}
    for suffix in suffixes:
        by_labels.setdefault(suffix.count(".") + 1, []).append(suffix.lower())
    labels = F.lit(1)
    for n in sorted(by_labels):
        labels = F.when(F.substring_index(name, ".", -n).isin(by_labels[n]), n).otherwise(labels)
    size = F.size(F.split(name, r"\."))
    last = F.array_join(F.slice(F.split(name, r"\."), -F.least(labels, size), size), ".")
    domain = F.array_join(F.slice(F.split(name, r"\."), -F.least(labels + 1, size), size), ".")
    return hosts.withColumns(
        {
            "domain": F.when(plain, name).otherwise(domain),
            "suffix": F.when(plain, name).otherwise(last),
        }
    )


def _strength(units: DataFrame) -> float:
    """The strength of the prior for ``units`` (bad, n, mean of their parent) by moments."""
    rate = F.col("bad") / F.col("n")
    row = (
        units.where("n > 0")
        .agg(
            F.sum("n").cast("double").alias("n"),
            F.sum(F.col("n") * F.col("n")).cast("double").alias("squares"),
            F.count("*").cast("double").alias("units"),
            F.sum("bad").cast("double").alias("bad"),
            F.sum(F.col("n") * (rate - F.col("parent")) * (rate - F.col("parent"))).alias("spread"),
        )
        .first()
    )
    if not row.n or row.units < 2:
        return MOST_STRENGTH
    share = row.bad / row.n
    variance = share * (1 - share)
    room = variance * (row.n - row.squares / row.n - (row.units - 1))
    excess = row.spread - variance * (row.units - 1)
    if room <= 0 or excess <= 0:
        return MOST_STRENGTH
    return min(MOST_STRENGTH, max(LEAST_STRENGTH, room / excess - 1))


def host_reputation(pages: DataFrame, suffixes: Sequence[str] = ()) -> DataFrame:
    """(host, bad_rate, bad_bound) of every host in ``pages`` (host, bad): ``bad`` is 1 or 0, or
    null for a page without an outcome; ``suffixes`` as in ``with_domain_and_suffix``."""
    # every level and every strength is worked out from these counts, so pages are read once
    hosts = stored(
        with_domain_and_suffix(
            pages.groupBy("host").agg(
                F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
            ),
            suffixes,
        )
    )
    counts = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*counts)
    suffixes = domains.groupBy("suffix").agg(*counts)
    whole = suffixes.agg(*counts).first()
    overall = ((whole.bad or 0) + 0.5) / ((whole.n or 0) + 1.0)

    def shrunk(units: DataFrame, strength: float, name: str) -> DataFrame:
        mean = (F.col("bad") + strength * F.col("parent")) / (F.col("n") + strength)
        return units.withColumn(name, mean)

    suffixes = suffixes.withColumn("parent", F.lit(overall))
    suffixes = shrunk(suffixes, _strength(suffixes), "mean").select(
        "suffix", F.col("mean").alias("parent")
    )
    domains = domains.join(suffixes, "suffix")
    domains = shrunk(domains, _strength(domains), "mean").select(
        "domain", F.col("mean").alias("parent")
    )
    hosts = hosts.join(domains, "domain")
    strength = _strength(hosts)
    mean = F.col("bad_rate")
    spread = F.sqrt(mean * (1 - mean) / (F.col("n") + strength + 1))
    return shrunk(hosts, strength, "bad_rate").select(
        "host", "bad_rate", (mean - Z * spread).alias("bad_bound")
    )


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[tuple[str, str]],
    suffixes: Sequence[str] = (),
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``.  ``outcomes`` has (_key,
    bad) and ``pages`` the column ``_key`` that a page's outcome is found by."""
    named = with_host_and_path(pages.select("page_id", "url", "_key")).drop("url")
    bad = outcomes.where("_key is not null and bad is not null").groupBy("_key").agg(
        F.max(F.col("bad").cast("int")).alias("bad")
    )
    labelled = named.select("host", "_key").join(bad, "_key", "left")
    hosts = host_reputation(labelled, suffixes).select("host", "bad_bound")
    rule, verdict = rule_verdict(rules)
    learned = F.when(F.col("bad_bound") > MAX_BAD, "block").otherwise("allow")
    return named.join(hosts, "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict")
    )
