"""SQL that gives the rows of corpus queries, for those that SQL can express."""

from __future__ import annotations

#: Hosts, outcomes and shrinkage as in url_filter; the prior's strength by moments is a macro-like
#: expression over one row of sums.
_STRENGTH = """
  SELECT CASE
      WHEN n IS NULL OR n = 0 OR units < 2 THEN 10000.0
      WHEN (bad / n) * (1 - bad / n) * (n - squares / n - (units - 1)) <= 0
        OR spread - (bad / n) * (1 - bad / n) * (units - 1) <= 0 THEN 10000.0
      ELSE least(10000.0, greatest(1.0,
        (bad / n) * (1 - bad / n) * (n - squares / n - (units - 1))
        / (spread - (bad / n) * (1 - bad / n) * (units - 1)) - 1))
    END AS k
  FROM (SELECT sum(n)::DOUBLE AS n, sum(n * n)::DOUBLE AS squares, count(*)::DOUBLE AS units,
          sum(bad)::DOUBLE AS bad, sum(n * (bad / n - parent) * (bad / n - parent)) AS spread
        FROM {units} WHERE n > 0)
"""

HOST_REPUTATION = rf"""
WITH named AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
    try_cast(nullif(regexp_extract(coalesce(url, ''), '/([0-9]+)', 1), '') AS BIGINT) AS document
  FROM pages),
outcomes AS (
  SELECT doc_id, max(1 - quality) AS bad FROM labels
  WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
counts AS (
  SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad
  FROM named LEFT JOIN outcomes ON document = doc_id GROUP BY host),
bare AS (SELECT *, regexp_replace(host, '^.*@|:[0-9]*$', '', 'g') AS name FROM counts),
hosts AS (
  SELECT host, n, bad,
    CASE WHEN name = '' OR regexp_matches(name, '^[0-9.]+$') OR starts_with(name, '[') THEN name
      ELSE array_to_string(string_split(name, '.')[-2:], '.') END AS domain,
    CASE WHEN name = '' OR regexp_matches(name, '^[0-9.]+$') OR starts_with(name, '[') THEN name
      ELSE string_split(name, '.')[-1] END AS suffix
  FROM bare),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
whole AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1.0) AS parent FROM domains),
suffixes AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(parent) AS parent
  FROM domains CROSS JOIN whole GROUP BY suffix),
suffix_means AS (
  SELECT suffix, (bad + k * parent) / (n + k) AS mean
  FROM suffixes CROSS JOIN ({_STRENGTH.format(units="suffixes")})),
domain_rows AS (
  SELECT d.*, m.mean AS parent FROM domains d JOIN suffix_means m USING (suffix)),
domain_means AS (
  SELECT domain, (bad + k * parent) / (n + k) AS mean
  FROM domain_rows CROSS JOIN ({_STRENGTH.format(units="domain_rows")})),
host_rows AS (SELECT h.*, m.mean AS parent FROM hosts h JOIN domain_means m USING (domain)),
bounds AS (
  SELECT host, mean - 1.96 * sqrt(mean * (1 - mean) / (n + k + 1)) AS bound
  FROM (SELECT host, n, k, (bad + k * parent) / (n + k) AS mean
        FROM host_rows CROSS JOIN ({_STRENGTH.format(units="host_rows")}))),
ruled AS (
  SELECT *, CASE
      WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/')
        THEN 'example.net/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/')
        THEN 'example.com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
    END AS rule
  FROM named JOIN bounds USING (host))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

#: Base32 writes five hex digits as four of its own.
DICTIONARY_WARC = """
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
    sha1(coalesce(html, '')) AS hex,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::INTEGER >> (5 * (3 - i % 4))) & 31)::INTEGER,
    1)), '') AS payload_digest,
  CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM payloads
"""

#: Every string of 100 bytes, as hex digits; removed bytes are the union of those that are not first.
SUFFIX_DEDUP = """
WITH texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits,
    octet_length(encode(coalesce(text, ''))) AS n_bytes
  FROM documents),
strings AS (
  SELECT doc_id, s, hash(w) AS a, md5_number_lower(w) AS b
  FROM (SELECT doc_id, s, substr(digits, 2 * s + 1, 200) AS w
        FROM (SELECT doc_id, digits, unnest(range(greatest(n_bytes - 99, 0))) AS s FROM texts))),
firsts AS (SELECT a, b, min((doc_id, s)) AS first FROM strings GROUP BY a, b HAVING count(*) > 1),
later AS (
  SELECT doc_id, s FROM strings JOIN firsts USING (a, b) WHERE (doc_id, s) > first),
islands AS (
  SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS island
  FROM (SELECT doc_id, s,
          CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh
        FROM later)),
spans AS (
  SELECT doc_id, min(s) AS start, max(s) + 100 AS stop FROM islands GROUP BY doc_id, island),
edges AS (
  SELECT doc_id, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS kept_from,
    start AS kept_to
  FROM spans
  UNION ALL
  SELECT doc_id, coalesce(max(stop), 0), any_value(n_bytes)
  FROM texts LEFT JOIN spans USING (doc_id) GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(substr(digits, 2 * kept_from + 1, 2 * (kept_to - kept_from)), ''
    ORDER BY kept_from) AS digits, count(*) - 1 AS n_spans
  FROM edges JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n_bytes, n_bytes - length(kept.digits) // 2 AS n_removed, n_spans,
  sha256(unhex(kept.digits)) AS kept_sha256
FROM texts JOIN kept USING (doc_id)
"""
