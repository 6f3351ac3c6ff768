"""Encoding, near duplicates, languages, fingerprints and quality against brute force."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from freightaudit.llm import bpe, fingerprints, language, quality, simhash
from tests.llm import cases

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
ENCODER = tiktoken.Encoding(
    "test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={}
)


# byte-level BPE


def test_bpe_matches_the_library_on_every_row(spark):
    encoded = bpe.encode(
        cases.table(spark, extra=True), RANKS, public_tokenizers.PATTERN, block_chars=20_000
    )
    rows = bpe.decode(encoded, RANKS).collect()
    got = sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in rows), key=repr)
    want = []
    for row in cases.rows():
        text = row[1] or ""
        want.append((row[0], ENCODER.encode_ordinary(text), text.encode()))
    assert got == sorted(want, key=repr)


def test_bpe_digests(spark):
    docs = spark.createDataFrame([(1, "hello hello 42"), (2, None)], "doc_id long, text string")
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    got = {r.doc_id: tuple(r)[1:] for r in bpe.digests(encoded, RANKS).collect()}
    for key, text in ((1, "hello hello 42"), (2, "")):
        ids = ENCODER.encode_ordinary(text)
        written = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[key] == (len(ids), written, hashlib.sha256(text.encode()).hexdigest())


def test_bpe_empty_and_unknown_ids(spark):
    assert bpe.encode(cases.empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0
    odd = spark.createDataFrame([(1, [0, 999_999]), (2, None), (3, [-1])], "k int, ids array<int>")
    assert [r.decoded for r in bpe.decode(odd, RANKS).collect()] == [None, None, None]


def test_splitter_agrees_with_the_library_on_all_kinds_of_characters():
    split, rng = bpe.splitter(public_tokenizers.PATTERN), random.Random(2)
    points = [p for p in range(0x30000) if not 0xD800 <= p <= 0xDFFF]
    points = points[:0x500] + rng.sample(points[0x500:], 4000)
    for start in range(0, len(points), 50):
        chars = [chr(p) for p in points[start : start + 50]]
        text = "".join(rng.choice(["", " ", "  ", "a", "1", "'s", "\n"]) + c for c in chars)
        pieces = [i for w in split(text) for i in ENCODER.encode_ordinary(w)]
        single = [i for w in split(text) for i in ENCODER._encode_single_piece(w.encode())]
        assert "".join(split(text)) == text
        assert single == ENCODER.encode_ordinary(text) == pieces


# SimHash


def plain_simhash(text: str) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(nodes: dict) -> dict:
    group = {n: n for n in nodes}

    def top(n):
        while group[n] != n:
            n = group[n]
        return n

    for a, b in combinations(nodes, 2):
        if (nodes[a] ^ nodes[b]).bit_count() <= 3:
            group[top(a)] = top(b)
    return {n: top(n) for n in nodes}


def test_simhash_groups(spark):
    got = simhash.near_duplicates(cases.table(spark, extra=True)).collect()
    rows = cases.rows()
    prints = {i: plain_simhash(r[1] or "") for i, r in enumerate(rows)}
    group = components_of(prints)
    least: dict = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[group[i]] = min(least.get(group[i], r[0]), r[0])
    want = sorted(
        ((r[0], prints[i], least.get(group[i])) for i, r in enumerate(rows)), key=repr
    )
    assert sorted(((r[0], r[1] % 2**64, r[2]) for r in got), key=repr) == want


def test_simhash_finds_every_link_of_random_fingerprints(spark):
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for base in prints[:30]:
        for bits in (1, 2, 3, 4):
            prints.append(base ^ sum(1 << b for b in rng.sample(range(64), bits)))
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in set(prints)]
    frame = spark.createDataFrame(signed, "fp long")
    got = {tuple(sorted((a % 2**64, b % 2**64))) for a, b in simhash.close_pairs(frame).collect()}
    want = {
        tuple(sorted(p)) for p in combinations(set(prints), 2) if (p[0] ^ p[1]).bit_count() <= 3
    }
    assert got == want


def test_long_chains_are_one_component(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    roots = dict(map(tuple, simhash.components(pairs).collect()))
    assert roots == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_simhash_empty_and_chunked(spark, monkeypatch):
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0
    text = "A bc  d\te\nf g " * 7
    for size in (1, 2, 3, 5, 100):
        monkeypatch.setattr(simhash, "CHUNK_WORDS", size)
        for cut in (0, 1, 3, 6, 9, len(text)):
            assert simhash.simhash(text[:cut].encode()) == plain_simhash(text[:cut])


# languages


def test_languages_and_texts_without_letters(spark):
    rng = random.Random(1)
    own = {"en": "the and with of ing tion", "de": "der und mit von ung keit", "fr": "le et à été eau"}
    made = []
    for i in range(90):
        name = ["en", "de", "fr"][i % 3]
        made.append((i, " ".join(rng.choices(own[name].split(), k=rng.randint(5, 40))), name))
    odd = [(100, None, "en"), (101, "", None), (102, "12 !?", "de"), (103, "the and", None)]
    docs = spark.createDataFrame(made + odd, "doc_id long, text string, lang string")
    profiles = language.learn(docs.where("doc_id % 4 <> 2"))
    assert sorted(profiles) == ["de", "en", "fr"]
    rows = language.predict(docs.withColumn("score", F.lit("x")), profiles).collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert all(got[i][0] == name for i, _, name in made)
    assert [got[i] for i in (100, 101, 102)] == [("und", 0.0)] * 3 and got[103][0] == "en"
    assert all(0 <= score <= 1 for _, score in got.values())
    assert language.learn(cases.empty(spark)) == {}
    assert {r.lang_pred for r in language.predict(docs, {}).collect()} == {"und"}
    assert language.predict(cases.empty(spark), profiles).count() == 0


def test_language_distance_against_a_plain_one():
    profiles = {}
    for name, text in (("a", "abba baab abab"), ("b", "bcd bcd dcb cab")):
        profiles[name] = language.top(*language.counted(language.letters_of(text)), 20)
    for text in ("abba cab", "dcb", "Zz"):
        own = language.top(*language.counted(language.letters_of(text)), 20).tolist()
        apart = {}
        for name, profile in profiles.items():
            at = {g: i for i, g in enumerate(profile.tolist())}
            apart[name] = sum(abs(at[g] - i) if g in at else 20 for i, g in enumerate(own))
        best = min(sorted(apart), key=apart.get)
        assert language.Ranks(profiles).nearest(text) == (
            best, pytest.approx(1 - apart[best] / (20 * len(own))),
        )


def test_language_counts_in_chunks(monkeypatch):
    codes = language.letters_of("Ab  bcé dé. " * 30)
    whole = dict(zip(*(a.tolist() for a in language.counted(codes)), strict=True))
    monkeypatch.setattr(language, "CHUNK_CHARS", 7)
    parts = dict(zip(*(a.tolist() for a in language.counted(codes)), strict=True))
    assert parts == whole and list(parts) == sorted(parts)


# fingerprints


def test_fingerprints_in_order(spark):
    got = cases.collected(fingerprints.compared_with_next(cases.table(spark, extra=True)))
    rows = [(r[0], r[1] or "") for r in cases.rows()]
    by_id: dict = {}
    for key, text in rows:
        by_id.setdefault(key, set()).add(text)
    unique = [r for r in got if r[0] is not None and r[0] != 0 and r[0] != 11]
    texts = dict(rows)
    for key, n_chars, sha, own, other, near_edited, near_next in unique:
        following = by_id.get(key + 1) or by_id[None]
        options = [fingerprints.compare(texts[key], t) for t in following]
        assert (n_chars, sha, own, other, near_edited, near_next) in options
    assert len(got) == len(rows)
    assert fingerprints.compared_with_next(cases.empty(spark)).count() == 0


def test_fingerprint_of_one_row_and_likeness(spark):
    one = spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")
    row = fingerprints.compared_with_next(one).first()
    assert row.near_next == 1.0
    assert row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(3000)]
    text, other = " ".join(words[:1500]), " ".join(words[1500:])
    changed = fingerprints.edited(text, other)
    near = fingerprints.likeness(fingerprints.digest(text), fingerprints.digest(changed))
    far = fingerprints.likeness(fingerprints.digest(text), fingerprints.digest(other))
    assert 0 <= far < near < 1
    assert fingerprints.likeness(fingerprints.digest(""), fingerprints.digest(text)) >= 0


def test_triplets_in_chunks(monkeypatch):
    data = bytes(range(256)) * 3
    whole = fingerprints.bucket_counts(data)
    assert whole.sum() == len(data) - 2
    monkeypatch.setattr(fingerprints, "CHUNK_BYTES", 10)
    assert (fingerprints.bucket_counts(data) == whole).all()


# quality


def test_quality_learns_and_scores_every_row(spark):
    rng = random.Random(3)
    made = []
    for i in range(300):
        words = ["".join(rng.choices("aeinorst", k=5)) for _ in range(30)]
        if i % 3 == 0:
            words = [w + "###" for w in words] if i % 2 else [words[0]] * 30
        made.append((i, " ".join(words), int(i % 3 > 0)))
    docs = spark.createDataFrame([m[:2] for m in made] + [(900, None), (901, ""), (None, "x")],
                                 "doc_id long, text string")
    labels = [(m[0], m[2]) for m in made if m[0] % 5] + [(7777, 1), (None, 0), (1, None)]
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    rows = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert sum(rows[i].predicted == good for i, _, good in made if i % 5 == 0) >= 57
    assert all(0 <= r.score <= 1 for r in rows.values()) and len(rows) == 303
    assert rows[900].score == rows[901].score > 0.5


def test_quality_word_features_do_not_depend_on_neighbours():
    words = ["a", "bc", "defgh", "é"]
    buckets, owner = quality.word_features(words)
    for place, word in enumerate(words):
        alone, _ = quality.word_features([word])
        assert sorted(buckets[owner == place].tolist()) == sorted(alone.tolist())


def test_quality_without_labels(spark):
    docs = cases.table(spark, extra=True)
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, none)
    assert {r.score for r in quality.score(docs, model).collect()} == {0.5}
    one = spark.createDataFrame([(11, 1)], "doc_id long, quality int")
    assert {r.predicted for r in quality.score(docs, quality.fit(docs, one)).collect()} == {1}
    assert quality.score(cases.empty(spark), model).count() == 0
