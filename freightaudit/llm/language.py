"""Language identification by rank-order profiles.

A profile is the list of a text's most frequent letter n-grams (one to three letters, words padded
with a blank) in falling order of frequency, ties by code.  A document is given the language whose
profile is nearest to its own by out-of-place distance: the sum, over the document's n-grams, of
how far their two ranks lie apart, or of the profile's length where the language lacks the n-gram.

Profiles are learned from counts over every learning document, summed in Spark; a language's
profile has ``PROFILE`` n-grams, so what reaches the executors is bounded by the number of
languages.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is every
text when nothing could be learned; rows without a language are not learned from; ties between
languages go to the first by name; repeated rows are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: N-grams in a profile.
PROFILE = 400
UNKNOWN = "und"
#: Characters that are counted at a time, which bounds memory for very long texts.
CHUNK_CHARS = 250_000
#: Cells of a table of counts, and chunks whose counts are added up at a time.
CELLS, CHUNKS = 2_000_000, 32
#: N-grams whose counts a task keeps before it hands them on.
HELD = 500_000
#: Slices of a language's n-grams that are put in order apart.
SLICES = 64


@cache
def _letters() -> np.ndarray:
    """For every code point: its lower-case letter, or 0 if it is no letter."""
    table = np.zeros(0x110000, np.int64)
    for point in range(0x110000):
        char = chr(point)
        if unicodedata.category(char)[0] == "L":
            lower = char.lower()
            table[point] = ord(lower) if len(lower) == 1 else point
    return table


def letters_of(text: str) -> np.ndarray:
    """The letters of ``text``, lower-cased; 0 for everything else, and at either end."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    codes = np.zeros(len(points) + 2, np.int64)
    codes[1:-1] = _letters()[points]
    return codes


#: Tags that keep n-grams of two and three places apart; letters need fewer than 20 bits each.
TWO, THREE = np.int64(1) << 60, np.int64(1) << 61


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, rising, and their counts.  N-grams are letters, pairs with a letter, and
    triples around a letter."""
    if len(codes) <= CHUNK_CHARS:
        return _counted(codes)
    return _added(
        (codes[max(0, start - 2) : stop], sign)
        for start in range(0, len(codes), CHUNK_CHARS)
        # a chunk sees the two places before it; what lies wholly in those was counted already
        for stop, sign in ((start + CHUNK_CHARS, 1), (start, -1))
    )


def counts_of(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """``counted`` over texts, of which short ones are counted together and long ones in chunks."""
    return _added(chunk for part in _joined(texts) for chunk in _chunks(part))


def _joined(texts: Iterable[str]) -> Iterator[str]:
    kept, size = [], 0
    for text in texts:
        if kept and size + len(text) > CHUNK_CHARS:
            yield "\n".join(kept)
            kept, size = [], 0
        kept.append(text)
        size += len(text) + 1
    if kept:
        yield "\n".join(kept)


def _chunks(text: str) -> Iterator[tuple[np.ndarray, int]]:
    for start in range(0, max(1, len(text)), CHUNK_CHARS):
        stop = start + CHUNK_CHARS
        codes = letters_of(text[max(0, start - 2) : stop])
        # the places before and after a text are those of its first and last chunk
        yield codes[int(start > 0) : len(codes) - int(stop < len(text))], 1
        if start:
            yield letters_of(text[max(0, start - 2) : start])[1:-1], -1


def _added(chunks: Iterable[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of chunks added up, or taken off."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for codes, sign in chunks:
        grams, counts = _counted(codes)
        parts.append((grams, sign * counts))
        if len(parts) == CHUNKS:
            parts = [_summed(parts)]
    if not parts:
        return _counted(np.empty(0, np.int64))
    grams, total = parts[0] if len(parts) == 1 else _summed(parts)
    return grams[total > 0], total[total > 0]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    total = np.zeros(len(grams), np.int64)
    np.add.at(total, place, np.concatenate([c for _, c in parts]))
    return grams, total


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    seen = np.bincount(codes)
    alphabet = np.flatnonzero(seen)
    if alphabet[0]:
        alphabet = np.concatenate(([0], alphabet))
    size = len(alphabet)
    if size**3 > min(CELLS, 16 * len(codes) + 100_000):
        left, right = codes[:-1], codes[1:]
        two = (left << 20 | right | TWO)[(left > 0) | (right > 0)]
        three = codes[:-2] << 40 | codes[1:-1] << 20 | codes[2:] | THREE
        grams = np.concatenate((codes[codes > 0], two, three[codes[1:-1] > 0]))
        return np.unique(grams, return_counts=True)
    place = np.zeros(len(seen), np.int64)
    place[alphabet] = np.arange(size)
    ids = place[codes]
    pairs = ids[:-1] * size + ids[1:]
    two_counts = np.bincount(pairs)
    three_counts = np.bincount(pairs[:-1] * size + ids[2:])
    two, three = np.flatnonzero(two_counts), np.flatnonzero(three_counts)
    two = two[two > 0]
    three = three[three // size % size > 0]
    grams = (
        alphabet[1:],
        alphabet[two // size] << 20 | alphabet[two % size] | TWO,
        alphabet[three // size**2] << 40 | alphabet[three // size % size] << 20
        | alphabet[three % size] | THREE,
    )
    return np.concatenate(grams), np.concatenate(
        (seen[alphabet[1:]], two_counts[two], three_counts[three])
    )


def top(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    return grams[np.argsort(-counts, kind="stable")[:size]]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> dict:
    """language -> its n-grams in order, from all rows of ``docs`` with a text and a language.

    Counts are summed per batch, then in Spark; a language's first ``size`` rows are among those of
    its ``SLICES`` slices, so no task gets more than that many rows for each of them.
    """
    rows = docs.select(
        F.col(lang).cast("string").alias("lang"), F.make_valid_utf8(text).alias("text")
    ).where("lang is not null and text is not null")
    counts = (
        rows.mapInArrow(_counts, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    order = [F.desc("n"), F.col("gram")]
    part = F.pmod(F.xxhash64("gram"), F.lit(SLICES))
    ranked = counts.withColumn("slice", part)
    for group in (["lang", "slice"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        ranked = ranked.withColumn("rank", rank).where(F.col("rank") <= size)
    profiles: dict[str, list] = {}
    for row in ranked.orderBy("lang", "rank").collect():
        profiles.setdefault(row.lang, []).append(row.gram)
    return {name: np.array(grams, np.int64) for name, grams in profiles.items()}


def _counts(batches: Iterator[pa.RecordBatch]):
    """Counts by language, added up over batches as long as ``HELD`` n-grams are not exceeded, so
    that small batches do not make many rows."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0
    for batch in batches:
        languages: dict[str, list[str]] = {}
        rows = zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True)
        for name, text in rows:
            languages.setdefault(name, []).append(text)
        for name, texts in languages.items():
            parts = held.setdefault(name, [])
            parts.append(counts_of(texts))
            size += len(parts[-1][0])
            if len(parts) == CHUNKS:
                held[name] = [_summed(parts)]
                size += len(held[name][0][0]) - sum(len(grams) for grams, _ in parts)
        if size > HELD:
            yield from _count_rows(held)
            held, size = {}, 0
    yield from _count_rows(held)


def _count_rows(held: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    for name, parts in held.items():
        grams, counts = _summed(parts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(grams)), pa.array(grams), pa.array(counts)],
            ["lang", "gram", "n"],
        )


class Ranks:
    """The ranks of all profiles, n-gram by n-gram."""

    def __init__(self, profiles: dict[str, np.ndarray]):
        self.names = sorted(profiles)
        self.size = max((len(p) for p in profiles.values()), default=0)
        grams = [profiles[name] for name in self.names]
        self.grams = np.unique(np.concatenate(grams)) if grams else np.empty(0, np.int64)
        self.ranks = np.full((len(self.grams), len(grams)), -1, np.int64)
        for column, profile in enumerate(grams):
            self.ranks[np.searchsorted(self.grams, profile), column] = np.arange(len(profile))

    def nearest(self, text: str | None) -> tuple[str, float]:
        """The nearest language and how near it is: 1 at no distance, 0 at the largest."""
        grams, counts = counts_of([text or ""])
        if not self.names or not len(grams):
            return UNKNOWN, 0.0
        own = top(grams, counts, self.size)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        known = self.grams[at] == own
        ranks = np.where(known[:, None], self.ranks[at], -1)
        places = np.arange(len(own))[:, None]
        apart = np.where(ranks >= 0, np.abs(ranks - places), self.size).sum(axis=0)
        best = int(np.argmin(apart))
        return self.names[best], float(1 - apart[best] / (self.size * len(own)))


def predict(
    docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text"
) -> DataFrame:
    """``docs`` without its text, with lang_pred and score (0 to 1) in place of columns so named."""
    others = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    rows = docs.select(*others, F.make_valid_utf8(text).alias(text))
    fields = ", ".join(f"`{f}` {docs.schema[f].dataType.simpleString()}" for f in others)
    ranks = docs.sparkSession.sparkContext.broadcast(Ranks(profiles))

    def run(batches):
        for batch in batches:
            found = [ranks.value.nearest(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in others],
                    pa.array([name for name, _ in found], pa.string()),
                    pa.array([score for _, score in found], pa.float64()),
                ],
                [*others, "lang_pred", "score"],
            )

    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double")
