"""Suffix-array dedup against all strings of all texts."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from freightaudit.llm import queries, repeats
from tests.llm import cases


def plain(rows: list[tuple]) -> list[tuple]:
    """(id, bytes, spans, kept) by a set of the strings of all smaller ids."""
    size, earlier, found = repeats.LENGTH, set(), []
    ranked: dict = {}
    for key, text in rows:
        ranked.setdefault((key is None, key or 0), []).append((key, (text or "").encode()))
    for _, texts in sorted(ranked.items()):
        here = set()
        for key, text in texts:
            gone, own = np.zeros(len(text), bool), set()
            for start in range(len(text) - size + 1):
                string = text[start : start + size]
                if string in earlier or string in own:
                    gone[start : start + size] = True
                own.add(string)
            here |= own
            edges = np.flatnonzero(np.diff(gone.astype(int), prepend=0, append=0)).tolist()
            kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
            found.append((key, len(text), list(zip(edges[::2], edges[1::2], strict=True)), kept))
        earlier |= here
    return sorted(found, key=repr)


def collected(docs) -> list[tuple]:
    rows = repeats.removed(docs).collect()
    return sorted(
        ((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in rows), key=repr
    )


def made() -> list[tuple]:
    rng = random.Random(1)
    rows = [r[:2] for r in cases.rows() if len(r[1] or "") < 30_000]
    base = "".join(rng.choice("ab ") for _ in range(3000))
    for k in range(60):
        at = rng.randrange(2500)
        text = base[at : at + rng.randrange(80, 400)]
        if rng.random() < 0.5:
            p = rng.randrange(len(text))
            text = text[:p] + "X" + text[p + 1 :]
        key = rng.choice([100 + k, 100 + k, None, 105])
        rows.append((key, "é" * rng.randrange(3) + text + base[: rng.randrange(150)]))
    return [*rows, (500, "ab" * 400), (501, "ab" * 120), (502, "a" * 1000), (-3, base[50:300])]


@pytest.mark.parametrize("bucket, block", [(20_000, 4_000_000), (50, 3000)])
def test_whole_table(spark, monkeypatch, bucket, block):
    """With small buckets a frequent string is spread over many of them."""
    monkeypatch.setattr(repeats, "BUCKET_ROWS", bucket)
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for name in cases.EXTRA:
        docs = docs.selectExpr("*", f"'z' as `{name}`")
    assert collected(docs) == plain(rows)


def test_long_text_and_empty_table(spark):
    assert repeats.removed(cases.empty(spark)).count() == 0
    rng = random.Random(2)
    text = "".join(rng.choices("abcdefgh ", k=400_000))
    rows = [(1, text), (2, text[1000:399_000]), (3, "x" * 50 + text[7:300_007])]
    found = collected(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [(r[0], r[2]) for r in found] == [(1, []), (2, [(0, 398_000)]), (3, [(50, 300_050)])]


def test_anchors_do_not_depend_on_chunks(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab", k=n)).encode() for n in (99, 100, 5000, 0, 300)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    whole = repeats.anchors(data, offsets)
    for size in (101, 997):
        monkeypatch.setattr(repeats, "CHUNK", size)
        for one, two in zip(whole, repeats.anchors(data, offsets), strict=True):
            assert (one == two).all()


def test_multikey_sort():
    rng = random.Random(4)
    data = bytes(rng.choice(b"ab") for _ in range(40)) * 12
    places = np.arange(len(data) - repeats.LENGTH + 1)
    order, group = repeats.multikey_sort(np.frombuffer(data, np.uint8), places)
    strings = [data[p : p + repeats.LENGTH] for p in order.tolist()]
    assert strings == sorted(strings) and len(order) == len(places)
    assert (np.unique(strings, return_inverse=True)[1] == np.unique(group, return_inverse=True)[1]).all()


def test_query_digests(spark, tmp_path):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_suffix_dedup(spark, str(tmp_path))
    kept = spark.createDataFrame(
        [(k, n, n - len(t), len(s), bytearray(t)) for k, n, s, t in plain(rows)],
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary",
    )
    want = kept.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
    assert cases.collected(got) == cases.collected(want)
