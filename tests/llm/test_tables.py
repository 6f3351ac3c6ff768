"""Personal data, decontamination, hosts, archives, token files and the pipeline."""

import base64
import hashlib
import random
import re
import tempfile

import duckdb
import public_tokenizers
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from freightaudit.llm import bpe, checks, decontaminate, pii, queries, token_counts, url_filter, warc
from freightaudit.sources.sinks import shared_folder
from scripts.check_queries import canonical
from tests.llm import cases

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))

# personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in doubled) % 10 == 0


def base_spans(text: str) -> str:
    found = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m[0])
            good = {
                "email": lambda m=m: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda d=digits: 12 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=digits: 9 <= len(d) <= 15,
            }[kind]
            if good():
                found.append((m.start(), rank, kind, m.end()))
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found))


def test_base_spans_of_random_texts(spark):
    rng = random.Random(3)
    bits = ["1", "23", "255", "256", ".", "@", "a", "b-c", "_", " ", "-", "+", "(", ")", "é", "😀"]
    bits += ["4984250489669609", "\n", "%", "1.2.3.4", "x@y.zz"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(1500)]
    texts += ["1 " * 3000, "a" * 3000 + "@", "1" * 3000, "a@b" + ".c" * 3000, "+1" + " " * 3000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(9000, None), (None, "x@y.zz"), (0, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.find(docs).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for row in got:
        plain = base_spans(texts[row.doc_id] or "")
        assert row.base_sha256 == hashlib.sha256(plain.encode()).hexdigest()
        assert row.n_email == plain.count("email") and row.n_card == plain.count("card")
        assert row.n_ip == plain.count("ip:") and row.n_phone == plain.count("phone")
        learned = [s for s in row.spans.split(",") if s.startswith("id:")]
        assert len(learned) == row.n_learned
        assert [s for s in row.spans.split(",") if s not in learned] == [plain][: bool(plain)] or (
            ",".join(s for s in row.spans.split(",") if s not in learned) == plain
        )


def test_very_long_numbers_do_not_overflow(spark):
    texts = ["1 " * 60_000, "1" * 100_000, "a@b" + ".c" * 50_000, "1.1" * 30_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = {r.doc_id: (r.n_email, r.n_ip, r.n_card) for r in pii.find(docs).collect()}
    assert counts[0] == (0, 0, 0) and counts[1] == (0, 0, 0) and counts[2] == (1, 0, 0)


def cued(spark):
    """Half the tokens behind a cue are mail addresses, the seeds; the other half are unseen."""
    rows = []
    for i in range(40):
        token = f"{1_000_000 + i * 7919}" + ("@x.org" if i % 2 else "zq")
        rows.append((i, f"Filed today. My badge-no: {token}, and that is all"))
    rows += [(100 + i, f"the year {1990 + i} was good number {12345 + i} in all") for i in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn(
        "n_chars", F.length("text").cast("long")
    )


def test_contexts_discover_unseen_identifiers(spark):
    rows = pii.find(cued(spark)).collect()
    assert {r.doc_id for r in rows if r.n_learned} == set(range(0, 40, 2))
    row = next(r for r in rows if r.doc_id == 0)
    assert row.spans == "id:26:35"


def test_redaction(spark):
    docs = cued(spark).withColumn("_spans", F.lit("z")).withColumn("row", F.lit(1))
    got = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert pii.redact(docs).columns == docs.columns
    assert got[0].text == "Filed today. My badge-no: [ID], and that is all"
    assert got[1].text == "Filed today. My badge-no: [EMAIL], and that is all"
    assert got[0].n_chars == len(got[0].text) and got[105].text.startswith("the year 1995")
    odd = cases.table(spark, extra=True)
    assert cases.collected(pii.redact(odd)) == cases.collected(odd)
    assert pii.redact(cases.empty(spark)).count() == 0 == pii.find(cases.empty(spark)).count()


def test_overlapping_spans_are_redacted_once(spark):
    text = "mail 1.2.3.4@host.example.org or +1 (988) 555-2485 now"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.redact(docs).first().text == "mail [EMAIL] or [PHONE] now"


# decontamination

QUESTION = (
    "A farmer in the valley has {} sheep and {} goats; after he sells {} sheep to {}, how many of "
    "the {} goats remain at home with him, if {} kg of hay is left?"
)


def test_parameters_and_consistency(spark):
    items = spark.createDataFrame(
        [(1, QUESTION.format(12, 7, 12, "Maria Lopez", 7, 5)), (2, ""), (3, None), (4, "Short one")],
        "item_id long, text string",
    )
    texts = {
        1: "Well. " + QUESTION.format(12, 7, 12, "Maria Lopez", 7, 5) + " yes",
        2: QUESTION.format(30, 9, 30, "Ann Jones", 9, 2),
        3: QUESTION.format(30, 9, 31, "Ann Jones", 8, 2),
        4: "A farmer in the valley has 12 sheep",
        5: "This is a short one indeed",
        6: "",
    }
    docs = cases.table(spark, extra=True).union(
        spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], cases.SCHEMA)
        .selectExpr("*", *[f"'z' as `{c}`" for c in cases.EXTRA])
        .withColumn("doc_id", F.col("doc_id") + 1000)
    )
    got = {(r.doc_id - 1000, r.item_id): r for r in decontaminate.contaminated(docs, items).collect()}
    assert set(got) == {(1, 1), (2, 1), (5, 4)}
    assert (got[1, 1].slots, got[1, 1].changed) == (7, 0)
    assert (got[2, 1].slots, got[2, 1].changed) == (7, 6)  # the unit is the same
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns
    assert cases.collected(kept) == cases.collected(
        docs.where("doc_id is null or doc_id not in (1001, 1002, 1005)")
    )


def test_decontamination_of_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(cases.table(spark), items).count() == 0
    some = spark.createDataFrame([(1, cases.PASSAGE)], "item_id long, text string")
    assert decontaminate.contaminated(cases.empty(spark), some).count() == 0
    got = decontaminate.contaminated(cases.table(spark), some).select("doc_id").distinct()
    passage = " ".join(cases.PASSAGE.split())
    want = {r[0] for r in cases.rows() if passage in (r[1] or "").lower()}
    assert {r.doc_id for r in got.collect()} == want


def test_shuffled_windows_give_the_same(spark, monkeypatch):
    some = spark.createDataFrame([(1, cases.PASSAGE), (2, "naïve été stone")], "item_id long, text string")
    first = cases.collected(decontaminate.contaminated(cases.table(spark), some))
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 0)
    assert cases.collected(decontaminate.contaminated(cases.table(spark), some)) == first


def test_passages_in_the_test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    found = decontaminate.contaminated(docs, bench).collect()
    held = docs.join(bench.select("item_id", F.col("text").alias("item")),
                     F.contains("text", F.col("item")))
    assert {(r.doc_id, r.item_id) for r in found} == {
        (r.doc_id, r.item_id) for r in held.select("doc_id", "item_id").collect()
    }


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.001"


# hosts


def test_hosts_paths_and_rules(spark):
    urls = [
        None, "", "no scheme/path", "http://A.Example.NET/en/x?y#z", "x://example.net/EN/",
        "https://b.example.com/de/1", "https://example.com", "ftp://fr.org/fr/", "a://b://c/d",
        "http://u@h.example.net:80/en/", "http://notexample.net/en/", "http://net", "x://É.org/fr/",
        "http://1.2.3.4/a", "http://[::1]/a",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    pages = pages.withColumn("_key", F.lit(None).cast("long")).withColumn("host", F.lit("z"))
    none = spark.createDataFrame([], "_key long, bad int")
    rows = {r.page_id: tuple(r)[1:] for r in url_filter.judge(pages, none, queries.URL_RULES).collect()}
    assert rows[0] == rows[1] == rows[2] == ("", "", None, "allow")
    assert rows[3] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert rows[4] == ("example.net", "/EN/", "net/", "block")
    assert rows[5] == ("b.example.com", "/de/1", "example.com/de/", "block")
    assert rows[6] == ("example.com", "", None, "allow")
    assert rows[7] == ("fr.org", "/fr/", "org/fr/", "allow")
    assert rows[8] == ("b:", "//c/d", None, "allow")
    assert rows[9] == ("u@h.example.net:80", "/en/", None, "allow")
    assert rows[10][2:] == ("net/", "block") and rows[11] == ("net", "", None, "allow")
    assert rows[12][0] == "É.org" and len(rows) == len(urls)


def test_reputation_blocks_bad_hosts_only(spark):
    rows, n = [], 0
    for host, count, bad in (("bad.a.com", 60, 55), ("new.a.com", 2, 2), ("ok.b.com", 80, 4),
                             ("odd.b.com", 1, 1), ("fresh.c.net", 0, 0)):
        for i in range(max(count, 1)):
            rows.append((n, f"http://{host}/{n}", n if count else None, int(i < bad)))
            n += 1
    made = spark.createDataFrame(rows, "page_id long, url string, _key long, bad int")
    outcomes = made.select("_key", "bad")
    judged = url_filter.judge(made.drop("bad"), outcomes, []).groupBy("host").agg(
        F.min("verdict").alias("least"), F.max("verdict").alias("most")
    )
    got = {r.host: (r.least, r.most) for r in judged.collect()}
    assert got["bad.a.com"] == ("block", "block")
    assert all(got[h] == ("allow", "allow") for h in ("ok.b.com", "odd.b.com", "fresh.c.net"))
    empty = made.limit(0).drop("bad")
    assert url_filter.judge(empty, outcomes, []).count() == 0


# archives


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, payload binary")


def test_archives_round_trip(spark):
    rng = random.Random(6)
    words = ["<p>", "</p>", "stone", "river", "été", "\r\n\r\n", "mill", "WARC/1.1"]
    bodies = [" ".join(rng.choices(words, k=rng.randint(0, 200))).encode() for _ in range(200)]
    rows = [(i, f"http://h/{i}" if i % 7 else None, bodies[i % 150]) for i in range(200)]
    rows += [(None, "http://n/\r\nx", b"only here"), (None, None, b"nobody"), (None, None, b"nobody")]
    rows += [(5, "http://h/5", bodies[5]), (300, "é" * 3000, b""), (301, "x", b""), (302, "big", b"z" * 3_000_000)]
    plan = warc.plan_records(pages_of(spark, rows)).repartition(2)
    archives = warc.write_archives(plan, archive_bytes=100_000)
    back = warc.read_archives(archives).collect()
    first: dict = {}
    for page, _, body in rows:
        if page is not None:
            first[body] = min(first.get(body, page), page)
    want = []
    for page, _, body in rows:
        lead = first.get(body)
        whole = lead is None or lead == page
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want.append((page, "response" if whole else "revisit", None if whole else lead, digest,
                     len(body), body if whole else None))
    got = [(r.page_id, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes,
            None if r.payload is None else bytes(r.payload)) for r in back]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    urls = {r.page_id: r.url for r in back}
    assert urls[7] is None and urls[8] == "http://h/8" and urls[300] == "é" * 3000
    assert archives.agg(F.sum("records")).first()[0] == len(rows)


def test_archive_layout(spark):
    rows = [(i, "u", f"<html>page {i} of the same site, {i * i}</html>".encode() * 20) for i in range(300)]
    archive = warc.write_archives(warc.plan_records(pages_of(spark, rows)).coalesce(1)).first()
    data = open(archive.file.removeprefix("file://"), "rb").read()
    assert data[:4] == b"\x5d\x2a\x4d\x18" and len(data) == archive.bytes
    size = int.from_bytes(data[4:8], "little")
    known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    one = zstandard.ZstdDecompressor(dict_data=known).decompressobj().decompress(data[8 + size :])
    assert one.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and one.count(b"WARC/1.1") == 1
    with pytest.raises(ValueError):
        list(warc.frames(data[:-3]))
    assert warc.read_archives(warc.write_archives(pages_of(spark, []).withColumn("refers_to", F.lit(None)))).count() == 0


# token files


def test_token_counts_over_block_boundaries(spark):
    encoder = tiktoken.Encoding(
        "test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={}
    )
    docs = cases.table(spark, extra=True)
    pieces = token_counts.write_token_files(
        docs, RANKS, public_tokenizers.PATTERN, queries.END, file_tokens=2000
    )
    files = pieces.groupBy("file").agg(F.sum("tokens").alias("tokens"))
    want = sorted(len(encoder.encode_ordinary(r[1] or "")) for r in cases.rows())
    for block in (7, 1000, 10_000_000):
        rows = token_counts.count_tokens(files, queries.END, block).collect()
        assert sorted(r.n_tokens for r in rows) == want and all(r.terminated for r in rows)
        ends: dict = {}
        for r in sorted(rows, key=lambda r: (r.file, r.ordinal)):
            assert r.start == ends.get(r.file, 0)
            ends[r.file] = r.start + r.n_tokens + 1
    whole = token_counts.document_token_counts(docs, RANKS, public_tokenizers.PATTERN, queries.END)
    assert cases.collected(whole) == sorted(
        ((r[0], len(encoder.encode_ordinary(r[1] or ""))) for r in cases.rows()), key=repr
    )
    assert token_counts.document_token_counts(
        cases.empty(spark), RANKS, public_tokenizers.PATTERN, queries.END
    ).count() == 0


def test_a_file_that_ends_in_a_document(spark):
    path = tempfile.mkstemp()[1]
    with open(path, "wb") as out:
        out.write(b"".join(i.to_bytes(2, "little") for i in (9, 9, 0, 0, 5, 5, 5)))
    files = spark.createDataFrame([(f"file://{path}", 7)], "file string, tokens long")
    for block in (1, 2, 3, 100):
        rows = token_counts.count_tokens(files, 0, block).orderBy("ordinal").collect()
        assert [tuple(r)[1:] for r in rows] == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 3, False)]


# queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_beside_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    frame = entry.queries()[name](spark, sf)
    columns = sorted(frame.columns)
    got = sorted(tuple(canonical(r[c]) for c in columns) for r in frame.collect())
    result = con.execute(entry.oracle_sql()[name])
    places = [[d[0] for d in result.description].index(c) for c in columns]
    assert got == sorted(tuple(canonical(r[i]) for i in places) for r in result.fetchall())


def test_all_queries_and_a_pipeline():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and checks.HOST_REPUTATION
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "near_duplicates", "decontamination", "personal_data", "byte_bpe",
    ]


def test_pipeline_stages(spark, tmp_path_factory):
    folder = shared_folder(spark)
    docs = cases.table(spark, extra=True)
    docs.write.parquet(f"{folder}/documents.parquet")
    items = spark.createDataFrame([(1, cases.PASSAGE)], "item_id long, text string")
    items.write.parquet(f"{folder}/benchmark.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    letters = {r[0] for r in cases.rows() if any(c.isalpha() for c in r[1] or "")}
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:4], 1):
        after = stage(spark, now, folder)
        assert after.columns == docs.columns
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        if number == 1:
            assert ids == letters
        if number == 2:
            assert after.groupBy("doc_id").count().where("count > 1").count() == 0
            assert 11 in ids and 12 not in ids
        if number == 3:
            assert 11 not in ids and 20 in ids
        now = after
    final = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in final.collect()} == {r.doc_id for r in now.collect()}


def test_pipeline_of_an_empty_table(spark):
    folder = shared_folder(spark)
    cases.empty(spark).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
