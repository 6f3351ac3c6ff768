"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np

from freightaudit.llm import variants
from tests.llm import cases


def counted(rows) -> Counter:
    counts: Counter = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            number = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if number % 97 == 0:
                at = number % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return counts


def one_error(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(words: dict) -> list[tuple]:
    near = {w: [x for x in words if one_error(w, x)] for w in words}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[word] = best if best and words[best] >= 2 * words[word] else None

    def root(word):
        return root(form[word]) if form[word] else word

    return sorted(
        ((w, n, len(near[w]), form[w], words.get(form[w]), root(w)) for w, n in words.items()),
        key=repr,
    )


def test_whole_table(spark):
    rng = random.Random(1)
    words = ["Berlin", "harbour", "École", "straße", "İstanbul", "×÷ÿÀÿ", "KELVINK", "aaaaa"]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(300)] + ["Aaaaaa aaaaab " * 4]
    rows = [r[:2] for r in cases.rows()] + [(1000 + i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in cases.EXTRA:
        docs = docs.selectExpr("*", f"'z' as `{name}`")
    counts = counted(rows)
    got = {r.word: r.n for r in variants.word_counts(docs).collect()}
    assert got == counts
    kept = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}
    assert cases.collected(variants.variants(docs)) == grouped(kept)


def test_words_of_one_group_in_blocks(spark):
    rng = random.Random(2)
    words = {"".join(rng.choices("ab", k=rng.randint(1, 9))): rng.randint(1, 50) for _ in range(400)}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    want = [(w, k) for w, _, k, *_ in grouped(words) if k]
    for block in (7, 5000):
        found = variants.near_words(frame, block=block, task_rows=50)
        assert sorted((r.word, r.n_near) for r in found.collect()) == sorted(want)
    assert cases.collected(variants.grouped(frame)) == grouped(words)


def test_bit_slices():
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abc", k=rng.choice((6, 7)))) for _ in range(300)})
    all_of = np.ones(len(words), bool)
    got = set(zip(*(x.tolist() for x in variants.near_pairs(words, 6, all_of, all_of)), strict=True))
    pairs = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if one_error(a, b)}
    assert got == {(i, j) for i, j in pairs if min(len(words[i]), len(words[j])) == 6}


def test_chain_and_empty_table(spark):
    chain = [("aaaaa" + "b" * i, 2**i) for i in range(12)]
    frame = spark.createDataFrame(chain, "word string, n long")
    rows = {r.word: r for r in variants.grouped(frame).collect()}
    assert {r.root for r in rows.values()} == {chain[-1][0]}
    assert rows["aaaaa"].form == "aaaaab" and rows[chain[-1][0]].form is None
    assert variants.variants(cases.empty(spark)).count() == 0
