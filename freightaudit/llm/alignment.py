"""Cross-tokenizer alignment: the groups of tokens of two tokenizers that cover the same bytes.

The ends of either tokenizer's tokens, summed up in bytes, are dictionaries from end to index; the
ends that both dictionaries hold, in order, cut both id lists into groups, and within a group every
pair of tokens whose bytes overlap is a link (``align``).

A is a byte-level BPE with the usual pattern and B a piece BPE whose pieces have a blank only in
front, so in both a token ends before every blank that follows a non-blank character.  Texts are
therefore cut there, and a distinct segment is encoded and aligned once per block of texts; the
result is that of the whole text.  A block gives one row for each text, with its segments by number,
and one row with its distinct links; links are counted over the corpus in Spark, the counts come
back to the blocks that hold them, and each block sums them up for its texts.  A link is in a block's
row once, so no link is more than a small part of what is shuffled.

Defined results: null and empty texts have no tokens, and neither has a text of which either
tokenizer gives back other bytes (B turns U+2581 into a blank); such rows have zeros and an empty
digest.  Invalid UTF-8 counts as U+FFFD.  Every row of the input gets a row, repeated rows and null
ids too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightaudit.sources.sinks import stored

#: Characters of texts that share a table of segments; a block has one text at least.
BLOCK_CHARS = 4_000_000
#: A blank and what follows, up to a blank that follows a non-blank character.  A single blank at the
#: end stays with what it follows, as B has no token for what is left of it without the blank in front.
SEGMENT = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*(?: \Z)?")
#: Segments that are encoded side by side, texts that are cut side by side.
BATCH, SIDE_BY_SIDE = 1000, 64
#: Segments that a worker keeps for later blocks.
MET = 200_000


class Tokenizers:
    """Both tokenizers as functions from segments to ids and the bytes of their tokens."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        points = _byte_points()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            a_bytes[number] = bytes(points[c] for c in token)
        self.a_bytes = a_bytes
        self.b_bytes = [_piece_bytes(self.b.id_to_piece(i)) for i in range(len(self.b))]
        # ids as text with what may follow
        top = max(len(self.a_bytes), len(self.b_bytes))
        self.shown = {c: np.array([f"{i}{c}" for i in range(top)], object) for c in ",|;"}

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both, of a text that begins with the blank that B puts in front."""
        ours = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return ours, self.b.encode(text[1:], num_threads=1)


def _byte_points() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable bytes stand for
    themselves, the others for the code points from 256 in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _piece_bytes(piece: str) -> bytes:
    if re.fullmatch("<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


@cache
def _tokenizers(byte_bpe: str, piece_bpe: str) -> Tokenizers:
    return Tokenizers(byte_bpe, piece_bpe)


def align(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups and links of two lists of tokens of the same bytes, by where their tokens end: for
    each group the number of A's and of B's tokens up to its end, and for each link the index of A's
    and of B's token."""
    a_index = dict(zip(a_ends.tolist(), range(len(a_ends)), strict=True))
    b_index = dict(zip(b_ends.tolist(), range(len(b_ends)), strict=True))
    common = sorted(a_index.keys() & b_index.keys())
    groups = [
        np.fromiter(map(index.__getitem__, common), np.int64, len(common)) + 1
        for index in (a_index, b_index)
    ]
    # tokens of a slice overlap in one run of bytes, which ends where either of them ends first
    every = np.array(sorted(a_index.keys() | b_index.keys()), np.int64)
    links = np.searchsorted(a_ends, every), np.searchsorted(b_ends, every)
    return np.stack(groups, axis=1), np.stack(links, axis=1)


#: Links as numbers: A's id above, B's below.
SHIFT = 32


class Segments:
    """Distinct segments: their numbers, figures (a, b, groups, links), groups as text and links."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.number: dict[str, int] = {}
        self.figures = np.zeros((1024, 4), np.int64)  # grows by doubling
        self.texts: list[str | None] = []  # None: bytes that differ
        self.links: list[np.ndarray] = []

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The segments of each text, by number."""
        cut = [SEGMENT.findall(" " + text) if text else [] for text in texts]
        new = [s for s in dict.fromkeys(chain.from_iterable(cut)) if s not in self.number]
        # segments side by side are cut where they meet, unless one ends in a blank
        joined = [s for s in new if not s[-1].isspace()]
        for start in range(0, len(joined), BATCH):
            self._add(joined[start : start + BATCH])
        for segment in new:
            if segment not in self.number:
                self._add([segment])
        number = self.number.__getitem__
        return [np.fromiter(map(number, own), np.int64, len(own)) for own in cut]

    def _add(self, segments: list[str]) -> None:
        """Encodes and aligns ``segments``, side by side, and cuts the result at their ends."""
        text = "".join(segments)
        a, b = self.tokenizers.encode(text)
        a_tokens = list(map(self.tokenizers.a_bytes.__getitem__, a))
        b_tokens = list(map(self.tokenizers.b_bytes.__getitem__, b))
        if not b"".join(a_tokens) == b"".join(b_tokens) == text.encode():
            if len(segments) > 1:
                half = len(segments) // 2
                self._add(segments[:half])
                self._add(segments[half:])
                return
            self.number[text] = len(self.number)
            self._put_figures(np.zeros((1, 4), np.int64))
            self.texts.append(None)
            self.links.append(np.empty(0, np.int64))
            return
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        a_ends, b_ends = (
            np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
            for tokens in (a_tokens, b_tokens)
        )
        groups, links = align(a_ends, b_ends)
        codes = a[links[:, 0]] << SHIFT | b[links[:, 1]]
        shown = self._shown(a, b, groups)
        ends = np.cumsum([len(s.encode()) for s in segments])
        to_a = np.searchsorted(a_ends, ends) + 1
        to_group = np.searchsorted(groups[:, 0], to_a) + 1
        to_b = groups[to_group - 1, 1]
        to_link = np.searchsorted(links[:, 0], to_a)
        cuts = np.stack((to_a, to_b, to_group, to_link))
        self._put_figures(np.diff(cuts, axis=1, prepend=0).T)
        at = link = 0
        for segment, to, link_to in zip(
            segments, (to_a + to_b).tolist(), to_link.tolist(), strict=True
        ):
            self.number[segment] = len(self.number)
            self.texts.append("".join(shown[at:to])[:-1])
            self.links.append(codes[link:link_to])
            at, link = to, link_to

    def _put_figures(self, rows: np.ndarray) -> None:
        """Figures of the next segments, before their texts are added."""
        end = len(self.texts) + len(rows)
        while end > len(self.figures):
            self.figures = np.concatenate((self.figures, np.zeros_like(self.figures)))
        self.figures[end - len(rows) : end] = rows

    def _shown(self, a: np.ndarray, b: np.ndarray, groups: np.ndarray) -> list[str]:
        """The ids of both as they are written, group by group, with the sign behind each."""
        to_a, to_b = groups.T
        from_b = np.concatenate(([0], to_b[:-1]))
        table = self.tokenizers.shown
        ours, theirs = table[","][a], table[","][b]
        ours[to_a - 1], theirs[to_b - 1] = table["|"][a[to_a - 1]], table[";"][b[to_b - 1]]
        of_a = np.repeat(from_b, np.diff(to_a, prepend=0))
        of_b = np.repeat(to_a, np.diff(to_b, prepend=0))
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + of_a] = ours
        out[np.arange(len(b)) + of_b] = theirs
        return out.tolist()


def links(
    docs: DataFrame, byte_bpe: str, piece_bpe: str, key: str = "doc_id", text: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(block, key, n_a, n_b, n_groups, n_links, groups_sha256, segments, times, …): a row for each
    row of ``docs``, and a row for each block (``pairs`` not null) with its distinct links, how often
    each stands in it, and the links of its segments as places among them."""
    id_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.make_valid_utf8(text).alias("text"))
    schema = (
        f"block long, key {id_type}, n_a long, n_b long, n_groups long, n_links long, "
        "groups_sha256 string, segments array<int>, times array<int>, "
        "pairs array<long>, pair_times array<long>, starts array<int>, places array<int>"
    )

    def run(batches):
        return _blocks(batches, _tokenizers(byte_bpe, piece_bpe), block_chars)

    return rows.mapInArrow(run, schema)


#: The segments that a Python worker has met in earlier blocks.
_met: list[Segments] = []


def _segments(tokenizers: Tokenizers) -> Segments:
    if not _met or _met[0].tokenizers is not tokenizers or len(_met[0].number) > MET:
        _met[:] = [Segments(tokenizers)]
    return _met[0]


def _blocks(batches: Iterator[pa.RecordBatch], tokenizers: Tokenizers, block_chars: int):
    block, chars = TaskContext.get().partitionId() << 32, 0
    segments, totals = _segments(tokenizers), []
    for batch in batches:
        keys, texts = batch.column("key"), batch.column("text")
        lengths = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
        start = 0
        for at, length in enumerate(lengths):
            full = chars > 0 and chars + length > block_chars
            if full or at - start == SIDE_BY_SIDE:
                rows = _aligned(texts[start:at].to_pylist(), segments, totals)
                yield _doc_rows(block, keys[start:at], rows)
                start = at
            if full:
                if totals:
                    yield _block_row(block, segments, totals, keys.type)
                block, chars = block + 1, 0
                segments, totals = _segments(tokenizers), []
            chars += length
        rows = _aligned(texts[start:].to_pylist(), segments, totals)
        yield _doc_rows(block, keys[start:], rows)
    if totals:
        yield _block_row(block, segments, totals, keys.type)


def _aligned(texts: list[str | None], segments: Segments, totals: list) -> list[tuple]:
    """The figures of texts and their distinct segments with counts, which ``totals`` gets too."""
    rows = []
    for numbers in segments.numbers(texts):
        parts = [segments.texts[i] for i in numbers.tolist()]
        if not parts or None in parts:
            rows.append((0, 0, 0, 0, "", None, None))
            continue
        distinct, times = np.unique(numbers, return_counts=True)
        figures = times @ segments.figures[distinct]
        totals.append((distinct, times))
        digest = hashlib.sha256(";".join(parts).encode()).hexdigest()
        rows.append((*figures.tolist(), digest, distinct, times))
    return rows


def _doc_rows(block: int, keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    longs, none = pa.int64(), pa.nulls(len(rows))
    ints = pa.list_(pa.int32())
    arrays = [
        pa.array([block] * len(rows), longs),
        keys,
        *[pa.array(column, longs) for column in columns[:4]],
        pa.array(columns[4], pa.string()),
        _int_lists(columns[5]),
        _int_lists(columns[6]),
        *[none.cast(pa.list_(longs))] * 2,
        *[none.cast(ints)] * 2,
    ]
    return pa.RecordBatch.from_arrays(arrays, _NAMES)


def _int_lists(lists: tuple) -> pa.ListArray:
    """An array of lists from arrays; None gives a null."""
    sizes = [0 if own is None else len(own) for own in lists]
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), pa.int32())
    none = pa.array([own is None for own in lists], pa.bool_())
    values = np.concatenate([np.empty(0, np.int64), *[own for own in lists if own is not None]])
    return pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int32)), mask=none)


_NAMES = [
    "block", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "segments", "times",
    "pairs", "pair_times", "starts", "places",
]


def _block_row(block: int, segments: Segments, totals: list, key_type) -> pa.RecordBatch:
    numbers, place = np.unique(np.concatenate([d for d, _ in totals]), return_inverse=True)
    times = np.zeros(len(numbers), np.int64)
    np.add.at(times, place, np.concatenate([t for _, t in totals]))
    own = [segments.links[i] for i in numbers.tolist()]
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    pairs, places = np.unique(np.concatenate(own), return_inverse=True)
    weights = np.zeros(len(pairs), np.int64)
    np.add.at(weights, places, np.repeat(times, sizes))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    empty = [pa.nulls(1, t) for t in (key_type, *[pa.int64()] * 4, pa.string())]
    arrays = [
        pa.array([block], pa.int64()), *empty, pa.array([numbers], ints), pa.nulls(1, ints),
        pa.array([pairs], longs), pa.array([weights], longs),
        pa.array([starts], ints), pa.array([places], ints),
    ]
    return pa.RecordBatch.from_arrays(arrays, _NAMES)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, total, best): how many links of the corpus hold a pair of ids linked, and whether no
    pair with the same B id has more."""
    counts = (
        blocks.where("pairs is not null")
        .select(F.inline(F.arrays_zip("pairs", "pair_times")))
        .groupBy(F.col("pairs").alias("pair"))
        .agg(F.sum("pair_times").alias("total"))
    )
    counts = counts.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1)))
    # a window would sort all A ids of a B id; the highest is a sum map-side, and B ids are few
    highest = counts.groupBy("b").agg(F.max("total").alias("highest"))
    return counts.join(highest, "b").select(
        "pair", "total", (F.col("total") == F.col("highest")).alias("best")
    )


def aligned(
    docs: DataFrame, byte_bpe: str, piece_bpe: str, key: str = "doc_id", text: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(``key``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each row
    of ``docs``."""
    id_type = docs.schema[key].dataType.simpleString()
    blocks = stored(links(docs, byte_bpe, piece_bpe, key, text, block_chars))
    known = stored(pair_counts(blocks))
    asked = blocks.where("pairs is not null").select(
        F.col("block").alias("of_block"), F.explode("pairs").alias("pair")
    )
    values = asked.join(known, "pair").select("of_block", "pair", "total", "best")
    schema = (
        f"key {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, "
        "count_sum long, groups_sha256 string"
    )
    found = blocks.drop("pair_times").groupBy("block").cogroup(values.groupBy("of_block"))
    return found.applyInArrow(_summed, schema).withColumnRenamed("key", key)


def _summed(rows: pa.Table, values: pa.Table) -> pa.Table:
    """The rows of a block's texts with the counts of their links summed up."""
    is_block = rows.column("pairs").is_valid()
    head, docs = rows.filter(is_block), rows.filter(pc.invert(is_block))
    sums = np.zeros((len(docs), 2), np.int64)
    if len(head):
        known, per = _segment_sums(head, values)
    for i, (numbers, times) in enumerate(
        zip(docs.column("segments"), docs.column("times"), strict=True)
    ):
        if numbers.is_valid:
            own = np.searchsorted(known, numbers.values.to_numpy())
            sums[i] = times.values.to_numpy() @ per[own]
    names = ["key", "n_a", "n_b", "n_groups", "n_links"]
    return pa.table(
        [
            *[docs.column(c) for c in names],
            pa.array(sums[:, 0]),
            pa.array(sums[:, 1]),
            docs.column("groups_sha256"),
        ],
        [*names, "n_best", "count_sum", "groups_sha256"],
    )


def _segment_sums(head: pa.Table, values: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The segments of a block, and for each how many links are best and the sum of their counts."""
    numbers, pairs, starts, places = (
        head.column(c)[0].values.to_numpy() for c in ("segments", "pairs", "starts", "places")
    )
    figures = np.zeros((len(pairs), 2), np.int64)
    order = np.searchsorted(pairs, values.column("pair").to_numpy())
    figures[order, 0] = values.column("best").to_numpy(zero_copy_only=False)
    figures[order, 1] = values.column("total").to_numpy()
    summed = np.concatenate((np.zeros((1, 2), np.int64), np.cumsum(figures[places], axis=0)))
    return numbers, summed[starts[1:]] - summed[starts[:-1]]
