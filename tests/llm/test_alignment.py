"""Alignment of two tokenizers against a byte-by-byte count."""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import accumulate

import numpy as np
import pytest

from freightaudit.llm import alignment
from freightaudit.llm.queries import BYTE_BPE, PIECE_BPE
from tests.llm import cases


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.Tokenizers(BYTE_BPE, PIECE_BPE)


def plain(tokenizers, text: str | None):
    """(a ids, b ids, groups as text, linked ids) of a whole text, by the owner of every byte."""
    if not text:
        return None
    a, b = tokenizers.encode(" " + text)
    tokens = [[table[i] for i in ids] for table, ids in
              ((tokenizers.a_bytes, a), (tokenizers.b_bytes, b))]
    if any(b"".join(own) != (" " + text).encode() for own in tokens):
        return None
    owners = [[i for i, t in enumerate(own) for _ in t] for own in tokens]
    links = sorted(set(zip(*owners, strict=True)))
    ends = [list(accumulate(map(len, own))) for own in tokens]
    groups, at = [], [0, 0]
    for end in sorted(set(ends[0]) & set(ends[1])):
        to = [own.index(end) + 1 for own in ends]
        sides = [ids[i:j] for ids, i, j in zip((a, b), at, to, strict=True)]
        groups.append("|".join(",".join(map(str, side)) for side in sides))
        at = to
    return a, b, groups, [(a[i], b[j]) for i, j in links]


def wanted(tokenizers, rows):
    found = [(key, plain(tokenizers, text)) for key, text in rows]
    count = Counter(link for _, f in found if f for link in f[3])
    highest: dict = {}
    for (_, b), n in count.items():
        highest[b] = max(highest.get(b, 0), n)
    for key, f in found:
        if f is None:
            yield key, 0, 0, 0, 0, 0, 0, ""
            continue
        a, b, groups, links = f
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        best = sum(count[p] == highest[p[1]] for p in links)
        yield key, len(a), len(b), len(groups), len(links), best, sum(count[p] for p in links), digest


ODD = [
    "  two  blanks \n\n  and \t tabs\n x  ", "a▁b c", "<|endoftext|> is text", " x　 y",
    "line\nline\r\nline", " \n", "ends in blanks   ", "\x1c y", "汉字 かな 한글", "é ‍ x",
]


def test_whole_table(spark, tokenizers):
    rows = [(r[0], r[1]) for r in cases.rows()] + [(100 + i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name in cases.EXTRA:
        docs = docs.selectExpr("*", f"'z' as `{name}`")
    want = sorted(wanted(tokenizers, rows), key=repr)
    for size in (2_000, alignment.BLOCK_CHARS):
        got = alignment.aligned(docs, BYTE_BPE, PIECE_BPE, block_chars=size)
        assert cases.collected(got) == want
    assert ODD[1] and dict((r[0], r) for r in want if r[0])[101][1:] == (0, 0, 0, 0, 0, 0, "")


def test_segments_give_what_whole_texts_give(tokenizers):
    for text in ODD:
        parts = alignment.SEGMENT.findall(" " + text)
        assert "".join(parts) == " " + text
        whole = tokenizers.encode(" " + text)
        for side in (0, 1):
            assert sum((list(tokenizers.encode(p)[side]) for p in parts), []) == list(whole[side])


def test_groups_and_links_of_ends():
    groups, links = alignment.align(np.array([2, 3, 6, 9]), np.array([1, 3, 5, 7, 9]))
    assert groups.tolist() == [[2, 2], [4, 5]]
    assert links.tolist() == [[0, 0], [0, 1], [1, 1], [2, 2], [2, 3], [3, 3], [3, 4]]


def test_empty_table(spark):
    assert alignment.aligned(cases.empty(spark), BYTE_BPE, PIECE_BPE).count() == 0
