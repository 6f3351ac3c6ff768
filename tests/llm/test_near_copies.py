"""Near copies against brute force, and which row of a group stays."""

from __future__ import annotations

import random
from itertools import combinations

from freightaudit.llm import near_copies, simhash
from tests.llm import cases

import corpus_pipeline


def shingles(text: str | None) -> set:
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(one: str, two: str) -> bool:
    a, b = shingles(one), shingles(two)
    return 5 * len(a & b) >= 4 * len(a | b)


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(3)
    texts = ["", " ", "one two", "One  two", "one two three four", "one two three four five"]
    for n in (6, 12, 40, 120, 400):
        for _ in range(3):
            words = [f"w{rng.randrange(5000)}" for _ in range(n)]
            texts.append(" ".join(words))
            for changes in range(1, 7):
                other = list(words)
                for at in rng.sample(range(n), min(changes * max(1, n // 100), n)):
                    other[at] = f"x{rng.randrange(5000)}"
                texts += [" ".join(other), " ".join(other[: n - changes])]
    group = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if near(texts[a], texts[b]) and group[a] != group[b]:
            group = [group[a] if g == group[b] else g for g in group]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    roots = {r.id: r.root for r in near_copies.groups(docs).collect()}
    together = {(a, b) for a, b in combinations(roots, 2) if roots[a] == roots[b]}
    assert together == {(a, b) for a, b in combinations(roots, 2) if group[a] == group[b]}
    kept = {r.doc_id for r in near_copies.representatives(docs).collect()}
    assert kept == {min(i for i in roots if group[i] == g) for g in set(group)}


def test_stage_drops_copies_further_apart_than_three_bits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    some = docs.where("doc_id in (596, 917, 783, 3006, 0, 7818)")
    texts = {r.doc_id: r.text for r in some.collect()}
    for a, b in ((596, 917), (783, 3006), (0, 7818)):
        assert near(texts[a], texts[b])
        bits = simhash.simhash(texts[a].encode()) ^ simhash.simhash(texts[b].encode())
        assert bits.bit_count() > simhash.DISTANCE
    kept = corpus_pipeline.near_duplicates(spark, some, "").collect()
    assert {r.doc_id for r in kept} == {596, 783, 0}


def test_one_large_group_and_empty_table(spark):
    words = cases.PASSAGE.split() * 8
    words = [f"{w}{i}" for i, w in enumerate(words)]
    texts = [" ".join(words[:i] + ["other"] + words[i + 1 :]) for i in range(0, len(words), 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in near_copies.representatives(docs).collect()] == [0]
    assert near_copies.representatives(cases.empty(spark)).count() == 0


def test_rows_that_share_an_id_or_have_none(spark):
    mill, other = cases.PASSAGE, "one two three four five six seven"
    rows = [
        (1, mill), (1, other), (2, other + "!"), (3, mill), (None, "first text of no id"),
        (None, "second text of no id"), (None, "second text of no id"), (None, mill), (5, None),
        (4, other), (4, "apart from " + other), (None, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = cases.collected(corpus_pipeline.near_duplicates(spark, docs, ""))
    want = [*rows[:3], rows[4], rows[5], rows[8], rows[10]]
    assert got == sorted(want, key=repr)


def test_long_texts_in_chunks(monkeypatch):
    found = near_copies.shingles(" ".join(f"w{i}" for i in range(1000)).encode())
    whole = near_copies.band_keys(found)
    for size in (1, 7, 999):
        monkeypatch.setattr(near_copies, "CHUNK", size)
        assert near_copies.band_keys(found) == whole


def test_pairs_come_from_the_grid_of_fingerprints(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:399]), " ".join(words[:398] + ["x", "y"])]
    texts += [" ".join(f"v{i}" for i in range(n)) for n in (300, 301)]
    bits = [simhash.simhash(t.encode()) for t in texts]
    assert (bits[0] ^ bits[1]).bit_count() <= simhash.DISTANCE
    assert (bits[3] ^ bits[4]).bit_count() <= simhash.DISTANCE
    rows = [(1, 300, 0), (2, 300, 7), (3, 290, 7), (4, 30, 7), (5, 300, 255), (6, 300, 254)]
    nodes = spark.createDataFrame(rows, "node long, size int, fp long")
    found = sorted(tuple(sorted(r)) for r in near_copies._of_grid(nodes).collect())
    assert found == [(1, 2), (2, 3), (5, 6)]
    called = []
    grid = near_copies._of_grid
    monkeypatch.setattr(near_copies, "_of_grid", lambda nodes: called.append(nodes) or grid(nodes))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    roots = {r.id: r.root for r in near_copies.groups(docs).collect()}
    assert called and roots[0] == roots[1] and roots[3] == roots[4] and roots[0] != roots[3]


def test_cloud_of_texts_that_are_not_quite_near(spark, monkeypatch):
    """Pairs just below the limit are compared where they meet: no row of a pair leaves a block."""
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for n in range(60):
        words = list(base)
        for at in rng.sample(range(120), 4):
            words[at] = f"x{n}_{at}"
        texts.append(" ".join(words))
        if n % 10 == 0:
            texts.append(" ".join([*words[:-1], "end"]))
    group = list(range(len(texts)))
    pairs = 0
    for a, b in combinations(range(len(texts)), 2):
        one, two = shingles(texts[a]), shingles(texts[b])
        pairs += len(one & two) / len(one | two) >= 0.6
        if near(texts[a], texts[b]) and group[a] != group[b]:
            group = [group[a] if g == group[b] else g for g in group]
    assert pairs > 100 and 1 < len(set(group)) < len(texts)
    sizes = []
    keep = near_copies.stored
    monkeypatch.setattr(
        near_copies, "stored", lambda df: sizes.append((df.columns, (kept := keep(df)).count())) or kept
    )
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    roots = {r.id: r.root for r in near_copies.groups(docs).collect()}
    together = {(a, b) for a, b in combinations(roots, 2) if roots[a] == roots[b]}
    assert together == {(a, b) for a, b in combinations(roots, 2) if group[a] == group[b]}
    # first pairs with the smallest node of a key, from then on nothing but links
    counts = [n for columns, n in sizes if columns[:2] == ["a", "b"]]
    assert sum(counts[1:]) < len(texts) < pairs, (counts, pairs)
