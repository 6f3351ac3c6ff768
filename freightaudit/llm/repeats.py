"""Removal of repeated byte strings by a distributed sparse suffix array.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts earlier: in a document
with a smaller id, or further to the front of the same document.  All suffixes of a corpus are too
many to be moved, so the array is sparse: of the ``SPAN`` tokens (strings of ``TOKEN`` bytes) within a
string of ``LENGTH`` bytes, the one with the least hash is its anchor, the leftmost of equals.  Equal
strings have their anchors at the same place, so only suffixes that begin at anchors are needed, one
in some 33.  The strings with one anchor lie side by side; together they are its context.

1. Blocks of texts are written to the shared folder.  Their anchors, by the hash of the token and of
   the context, go to parts of the hash space; of equal contexts in a block only the one with the
   smallest id goes.  A part finds the contexts that a smaller id has too, which are repeats as a
   whole, and the tokens that stand in different contexts.  Answers are a byte each and go back to
   the blocks.
2. Suffixes of such tokens, with what their contexts have in front, are range-partitioned by sampled
   splitters, by leading bytes and then by place, so a frequent suffix is spread over buckets.  A
   bucket sorts the strings of its suffixes by multikey quicksort: by eight bytes at a time, and only
   among strings that are equal so far.  Strings that are equal to the end are repeats of the first.
3. A string that is first in its bucket may have equals in another one only if, behind its anchor, it
   is as the bucket's first or last suffix.  Such strings are compared across buckets, by digest.
4. What was found goes back to the blocks, which are read again and cut.

Hashes decide in steps 1 and 3, over 128 bits (token and context; a digest), bytes in step 2.

Defined results: null texts are empty, invalid UTF-8 counts as U+FFFD; a null id is larger than any
other; rows that share an id are not held against each other, as neither's id is smaller; every row
gets a row, repeated rows too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightaudit.llm.files import open_file, put_file
from freightaudit.sources.sinks import shared_folder, stored

LENGTH, TOKEN = 100, 36
SPAN = LENGTH - TOKEN + 1
#: Bytes of texts in a block (one text at least), in a part of the hash space, and hashed at a time.
BLOCK_BYTES, PART_BYTES, CHUNK = 4_000_000, 16_000_000, 1 << 17
#: Suffixes in a bucket.
BUCKET_ROWS = 20_000
NULL_ID = 2**63 - 1

_RANDOM = np.random.default_rng(12)
_BYTES = _RANDOM.integers(0, 2**64, 256, np.uint64)
_STEP = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Bits of an anchor's key that hold its place in a chunk.
_PLACE = np.uint64(18)


class Anchors(NamedTuple):
    """Anchors in order: row of the text, place, first and last start of the strings that have it,
    and the hashes of token and context."""

    row: np.ndarray
    at: np.ndarray
    first: np.ndarray
    last: np.ndarray
    token: np.ndarray
    context: np.ndarray


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(32))
    values *= _MIX
    return values ^ (values >> np.uint64(29))


def _window_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the strings of ``TOKEN`` and of ``LENGTH`` bytes at each place.  Both are sums of
    strings whose lengths are powers of two."""
    grown, size, powers = _BYTES[data], 1, {}
    while size <= LENGTH:
        if size & TOKEN or size & (LENGTH - TOKEN):
            powers[size] = grown
        if 2 * size <= LENGTH:
            grown = grown[:-size] * np.uint64(pow(_STEP, size, 2**64)) + grown[size:]
        size *= 2

    def joined(length: int) -> np.ndarray:
        found, done = None, 0
        for size in sorted(powers, reverse=True):
            if size & length:
                if found is None:
                    found, done = powers[size], size
                else:
                    count = len(powers[size]) - done
                    step = np.uint64(pow(_STEP, size, 2**64))
                    found, done = found[:count] * step + powers[size][done:], done + size
        return found

    token, rest = joined(TOKEN), joined(LENGTH - TOKEN)
    step = np.uint64(pow(_STEP, TOKEN, 2**64))
    count = len(data) - LENGTH + 1
    return _mixed(token), rest[:count] * step + token[LENGTH - TOKEN :][:count]


def anchors(data: np.ndarray, offsets: np.ndarray) -> Anchors:
    """The anchors of texts that lie one behind the other."""
    inside = np.ones(len(data), bool)
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        inside[max(start, end - LENGTH + 1) : end] = False
    found = [
        _chunk_anchors(data[start : start + CHUNK + LENGTH - 1], inside[start:], start)
        for start in range(0, len(data) - LENGTH + 1, CHUNK)
    ]
    if not found:
        none = np.empty(0, np.int64)
        return Anchors(none, none, none, none, none.view(np.uint64), none.view(np.uint64))
    at, first, last, token, begin, end = (np.concatenate(c) for c in zip(*found, strict=True))
    # strings with one anchor may lie on both sides of a chunk's edge
    starts = np.flatnonzero(
        np.concatenate(([True], (at[1:] != at[:-1]) | (first[1:] != last[:-1] + 1)))
    )[: len(at)]
    ends = np.append(starts[1:], len(at))[: len(starts)] - 1
    first, last, at, token = first[starts], last[ends], at[starts], token[starts]
    context = _mixed(
        begin[starts] * np.uint64(3) + _mixed(end[ends]) + (last - first).astype(np.uint64)
    )
    return Anchors(np.searchsorted(offsets, first, "right") - 1, at, first, last, token, context)


def _chunk_anchors(data: np.ndarray, inside: np.ndarray, base: int) -> tuple[np.ndarray, ...]:
    token, whole = _window_hashes(data)
    least = token >> _PLACE << _PLACE | np.arange(len(token), dtype=np.uint64)
    size = 1
    while 2 * size <= SPAN:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < SPAN:
        least = np.minimum(least[: size - SPAN], least[SPAN - size :])
    starts = np.flatnonzero(inside[: len(whole)])
    at = (least[starts] & np.uint64((1 << 18) - 1)).astype(np.int64)
    if not len(starts):
        return at, starts, starts, token[:0], whole[:0], whole[:0]
    edges = np.flatnonzero((at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
    first = starts[np.concatenate(([0], edges))]
    last = starts[np.concatenate((edges - 1, [len(starts) - 1]))]
    at = at[np.concatenate(([0], edges))]
    return at + base, first + base, last + base, token[at], whole[first], whole[last]


class Entries(NamedTuple):
    """What a block says of its contexts: ``order`` sorts anchors by token, context and place,
    ``entry`` is the number of each one's context, and ``later`` whether the block itself has it
    earlier; token, context and smallest id of each entry."""

    order: np.ndarray
    entry: np.ndarray
    later: np.ndarray
    token: np.ndarray
    context: np.ndarray
    rank: np.ndarray


def entries(found: Anchors, ranks: np.ndarray) -> Entries:
    rank = ranks[found.row]
    order = np.lexsort((found.first, found.row, rank, found.context, found.token))
    token, context = found.token[order], found.context[order]
    new = np.ones(len(order), bool)
    new[1:] = (token[1:] != token[:-1]) | (context[1:] != context[:-1])
    entry = np.cumsum(new) - 1
    least = rank[order][new]
    row = found.row[order]
    again = ~new
    again[1:] &= row[1:] == row[:-1]
    later = (rank[order] > least[entry]) | again
    return Entries(order, entry, later, token[new], context[new], least)


# 1. blocks and parts


def _block_file(folder: str, block: int) -> str:
    return f"{folder}/{block:016x}.arrow"


def _read_block(folder: str, block: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Keys, the bytes of the texts one behind the other, and their offsets."""
    with open_file(_block_file(folder, block)) as source:
        rows = pa.ipc.open_file(source).read_all().combine_chunks()
    return rows.column("key").combine_chunks(), *_flat(rows.column("text").combine_chunks())


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _ranks(keys: pa.Array) -> np.ndarray:
    return pc.fill_null(keys.cast(pa.int64()), NULL_ID).to_numpy()


_PACKED = ["block", "part", "token", "context", "rank"]


def _to_parts(batches: Iterator[pa.RecordBatch], folder: str, parts: int):
    block = TaskContext.get().partitionId() << 32
    kept, size = [], 0
    for batch in batches:
        lengths = pc.binary_length(batch.column("text")).to_numpy()
        start = 0
        for at, length in enumerate(lengths.tolist()):
            if size and size + length > BLOCK_BYTES:
                kept.append(batch.slice(start, at - start))
                yield from _block_rows(kept, folder, block, parts)
                kept, size, start, block = [], 0, at, block + 1
            size += length
        kept.append(batch.slice(start))
    if any(b.num_rows for b in kept):
        yield from _block_rows(kept, folder, block, parts)


def _block_rows(kept: list[pa.RecordBatch], folder: str, block: int, parts: int):
    """Writes a block; its entries by part, of which there is one at least."""
    rows = pa.Table.from_batches(kept).combine_chunks()
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    with pa.ipc.new_file(sink, rows.schema, options=options) as writer:
        writer.write_table(rows)
    put_file(_block_file(folder, block), sink.getvalue().to_pybytes())
    data, offsets = _flat(rows.column("text").combine_chunks())
    own = entries(anchors(data, offsets), _ranks(rows.column("key").combine_chunks()))
    home = _home(own.token, parts)
    by_home = np.argsort(home, kind="stable")
    wanted = np.unique(home) if len(home) else np.zeros(1, np.int64)
    edges = np.searchsorted(home[by_home], np.append(wanted, parts))
    for part, a, b in zip(wanted.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        some = by_home[a:b]
        columns = (own.token[some], own.context[some], own.rank[some])
        yield pa.RecordBatch.from_arrays(
            [pa.array([block]), pa.array([part]), *[pa.array([c.tobytes()]) for c in columns]],
            _PACKED,
        )


def _home(token: np.ndarray, parts: int) -> np.ndarray:
    """Parts by the low bits of tokens: anchors have small high bits."""
    return ((token & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int64)


#: Answers: a smaller id has the context; the token stands in another context too.
REPEATED, CONTESTED = 1, 2


def _answers(rows: pa.Table) -> pa.Table:
    """For the entries of each block in a part: whether they are repeated, or contested."""
    token, context = (_joined(rows, c, np.uint64) for c in ("token", "context"))
    rank = _joined(rows, "rank", np.int64)
    order = np.lexsort((rank, context, token))
    token, context, rank = token[order], context[order], rank[order]
    new = np.ones(len(order), bool)
    new[1:] = (token[1:] != token[:-1]) | (context[1:] != context[:-1])
    repeated = rank > rank[new][np.cumsum(new) - 1]
    group = np.cumsum(np.concatenate(([True], token[1:] != token[:-1]))[: len(order)]) - 1
    contexts = np.bincount(group, weights=new) if len(group) else np.empty(0)
    answers = np.empty(len(order), np.uint8)
    answers[order] = np.where(repeated, REPEATED, CONTESTED * (contexts[group] > 1))
    sizes = pc.binary_length(rows.column("token")).to_numpy() // 8
    cuts = np.cumsum(sizes)[:-1]
    return pa.table(
        {
            "block": rows.column("block"),
            "part": rows.column("part"),
            "answers": pa.array([a.tobytes() for a in np.split(answers, cuts)], pa.binary()),
        }
    )


def _joined(rows: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)


_FOUND = [
    "block", "rows", "starts", "ends", "suffix", "front", "rank", "row", "first",
]
_SPANS = "block long, rows array<int>, starts array<int>, ends array<int>"
_SUFFIXES = "suffix binary, front binary, rank long, row int, first int"


def _from_parts(rows: pa.Table, folder: str, parts: int) -> pa.Table:
    """The spans of a block's repeated contexts in one row, and a row for each suffix that is
    contested."""
    block = rows.column("block")[0].as_py()
    keys, data, offsets = _read_block(folder, block)
    found = anchors(data, offsets)
    ranks = _ranks(keys)
    own = entries(found, ranks)
    home, answers = _home(own.token, parts), np.zeros(len(own.token), np.uint8)
    for part, said in zip(
        rows.column("part").to_pylist(), rows.column("answers").to_pylist(), strict=True
    ):
        answers[home == part] = np.frombuffer(said, np.uint8)
    of_anchor = answers[own.entry]
    gone = own.order[own.later | (of_anchor == REPEATED)]
    row = found.row[gone]
    spans = _merged(row, found.first[gone] - offsets[row], found.last[gone] - offsets[row] + LENGTH)
    asked = own.order[~own.later & (of_anchor == CONTESTED)]
    at, first, last = found.at[asked], found.first[asked], found.last[asked] + LENGTH
    whole = data.tobytes()
    suffixes = [whole[a:b] for a, b in zip(at.tolist(), last.tolist(), strict=True)]
    fronts = [whole[a:b] for a, b in zip(first.tolist(), at.tolist(), strict=True)]
    row = found.row[asked]
    none = [None] * len(asked)
    ints = pa.list_(pa.int32())
    return pa.table(
        [
            pa.array([block] * (len(asked) + 1), pa.int64()),
            *[pa.array([c, *none], ints) for c in spans],
            pa.array([None, *suffixes], pa.binary()),
            pa.array([None, *fronts], pa.binary()),
            pa.array([None, *ranks[row].tolist()], pa.int64()),
            pa.array([None, *row.tolist()], pa.int32()),
            pa.array([None, *(first - offsets[row]).tolist()], pa.int32()),
        ],
        _FOUND,
    )


def _merged(
    row: np.ndarray, starts: np.ndarray, ends: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the unions of spans that overlap or touch within a row."""
    wide = row.astype(np.int64) << 32
    order = np.argsort(wide + starts, kind="stable")
    starts, ends = (wide + starts)[order], (wide + ends)[order]
    reach = np.maximum.accumulate(ends)
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] > reach[:-1]) | (starts[1:] >> 32 != starts[:-1] >> 32)
    edges = np.flatnonzero(new)
    starts, ends = starts[edges], reach[np.append(edges[1:], len(reach))[: len(edges)] - 1]
    low = (1 << 32) - 1
    return starts >> 32, starts & low, ends & low


# 2. buckets


def _bucket(batches: Iterator[pa.RecordBatch], parts: int):
    """A bucket's repeats as spans by block, and its strings that may stand in another bucket too,
    by part of the digests."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    rows = pa.Table.from_batches(batches).combine_chunks()
    suffixes, fronts = rows.column("suffix").to_pylist(), rows.column("front").to_pylist()
    rank, block = rows.column("rank").to_numpy(), rows.column("block").to_numpy()
    row, first = rows.column("row").to_numpy(), rows.column("first").to_numpy()
    data = b"".join(f + s for f, s in zip(fronts, suffixes, strict=True))
    ahead = np.fromiter(map(len, fronts), np.int64, len(rows))
    sizes = ahead + np.fromiter(map(len, suffixes), np.int64, len(rows))
    counts = sizes - LENGTH + 1
    of = np.repeat(np.arange(len(rows)), counts)
    step = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = np.repeat(np.cumsum(sizes) - sizes, counts) + step
    start = first[of] + step
    order, group = multikey_sort(np.frombuffer(data, np.uint8), place)
    later = np.zeros(len(of), bool)
    later[order] = _not_first(order, group, of, rank, block, row, start)
    gone = np.flatnonzero(later)
    for one, spans in _by_block(block[of[gone]], row[of[gone]], start[gone]):
        yield _bucket_row([*spans, *[None] * 6], one)
    # of what stands behind the anchor, as much as a string has must be as in the bucket's edge
    behind = LENGTH - ahead[of] + step
    left = np.flatnonzero((_shared_with_edges(suffixes)[of] >= behind) & ~later)
    digests = b"".join(
        xxhash.xxh3_128_digest(data[p : p + LENGTH]) for p in place[left].tolist()
    )
    digests, own = np.frombuffer(digests, "<u8").reshape(-1, 2), of[left]
    home = (digests[:, 0] % np.uint64(parts)).astype(np.int64)
    for part in np.unique(home):
        some = home == part
        columns = (digests[some], rank[own[some]], block[own[some]], row[own[some]], start[left[some]])
        packed = [np.ascontiguousarray(c).astype(c.dtype.newbyteorder("<")).tobytes() for c in columns]
        yield _bucket_row([None] * 3 + [int(part), *packed], None)


def _not_first(order, group, of, rank, block, row, start) -> np.ndarray:
    """Of strings in groups of equals: whether an equal one has a smaller id, or stands further to
    the front of the same text."""
    own = of[order]
    by = np.lexsort((start[order], row[own], block[own], rank[own], group))
    group, own = group[by], own[by]
    new = np.ones(len(by), bool)
    new[1:] = group[1:] != group[:-1]
    same_row = ~new
    same_row[1:] &= (block[own[1:]] == block[own[:-1]]) & (row[own[1:]] == row[own[:-1]])
    least = rank[own][new][np.cumsum(new) - 1]
    found = np.empty(len(by), bool)
    found[by] = (rank[own] > least) | same_row
    return found


def _shared_with_edges(suffixes: list[bytes]) -> np.ndarray:
    """How many leading bytes each suffix shares with the first or the last of them: no more can it
    share with any suffix of another bucket."""
    padded = np.array(suffixes, f"S{LENGTH}").view(np.uint8).reshape(-1, LENGTH)
    sizes = np.fromiter(map(len, suffixes), np.int64, len(suffixes))
    found = np.zeros(len(suffixes), np.int64)
    for edge in (suffixes.index(min(suffixes)), suffixes.index(max(suffixes))):
        other = np.ones((len(suffixes), LENGTH + 1), bool)
        other[:, :LENGTH] = padded != padded[edge]
        found = np.maximum(found, other.argmax(axis=1))
    return np.minimum(found, sizes)


_SORTED = [
    "block", "rows", "starts", "ends", "part", "digests", "rank", "of_block", "row", "start",
]
_OPENED = "part long, digests binary, rank binary, of_block binary, row binary, start binary"


def _bucket_row(values: list, block: int | None) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.list_(pa.int32())] * 3, pa.int64(), *[pa.binary()] * 5]
    arrays = [pa.array([v], kind) for v, kind in zip([block, *values], kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, _SORTED)


def _by_block(block: np.ndarray, row: np.ndarray, start: np.ndarray):
    """(block, (rows, starts, ends)) of strings that go, by block."""
    order = np.argsort(block, kind="stable")
    blocks, cuts = np.unique(block[order], return_index=True)
    for one, here in zip(blocks.tolist(), np.split(order, cuts[1:]), strict=False):
        yield one, _merged(row[here], start[here], start[here] + LENGTH)


def multikey_sort(data: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the strings of ``LENGTH`` bytes at each ``place``, all parts of a level
    at once: strings that are equal so far are parted by their next eight bytes, and one that is
    alone needs no more.  Returns the strings that have equals, in order, and the number of their
    group."""
    words = np.zeros(len(data), np.uint64)
    count = max(0, len(data) - 7)
    for i in range(8):
        words[:count] |= data[i : i + count].astype(np.uint64) << np.uint64(56 - 8 * i)
    order, group = np.arange(len(place)), np.zeros(len(place), np.int64)
    for depth in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        key = words[place[order] + depth]
        by = np.lexsort((key, group))
        order, group, key = order[by], group[by], key[by]
        new = np.ones(len(order) + 1, bool)
        new[1:-1] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        tied = ~(new[:-1] & new[1:])
        order, group = order[tied], (np.cumsum(new[:-1]) - 1)[tied]
    return order, group


# 3. and 4.


def _across(rows: pa.Table) -> pa.Table:
    """Spans of a part's strings that another bucket has earlier."""
    rank, block = _joined(rows, "rank", np.int64), _joined(rows, "of_block", np.int64)
    row, start = _joined(rows, "row", np.int32), _joined(rows, "start", np.int64)
    digests = _joined(rows, "digests", np.uint64).reshape(-1, 2)
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (digests[order[1:]] != digests[order[:-1]]).any(axis=1)
    later = np.zeros(len(order), bool)
    later[order] = _not_first(
        order, np.cumsum(new) - 1, np.arange(len(order)), rank, block, row, start
    )
    gone = np.flatnonzero(later)
    found = list(_by_block(block[gone], row[gone], start[gone]))
    ints = pa.list_(pa.int32())
    return pa.table(
        {
            "block": pa.array([one for one, _ in found], pa.int64()),
            **{
                name: pa.array([spans[i] for _, spans in found], ints)
                for i, name in enumerate(("rows", "starts", "ends"))
            },
        }
    )


def _cut(rows: pa.Table, folder: str) -> pa.Table:
    """The texts of a block without their spans."""
    keys, data, offsets = _read_block(folder, rows.column("block")[0].as_py())
    row, starts, ends = (
        pc.list_flatten(rows.column(c)).to_numpy().astype(np.int64)
        for c in ("rows", "starts", "ends")
    )
    row, starts, ends = _merged(row, starts, ends)
    starts, ends = starts.tolist(), ends.tolist()
    edges = np.searchsorted(row, np.arange(len(keys) + 1)).tolist()
    spans, texts = [], []
    whole = data.tobytes()
    for i, (begin, end) in enumerate(
        zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
    ):
        some = range(edges[i], edges[i + 1])
        spans.append([{"start": starts[k], "end": ends[k]} for k in some])
        parts, at = [], begin
        for k in some:
            parts.append(whole[at : begin + starts[k]])
            at = begin + ends[k]
        texts.append(b"".join([*parts, whole[at:end]]))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.table(
        {
            "key": keys,
            "n_bytes": pa.array(np.diff(offsets), pa.int64()),
            "spans": pa.array(spans, kind),
            "kept": pa.array(texts, pa.binary()),
        }
    )


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, n_bytes, spans array<struct<start, end>>, kept binary), one row for each row of
    ``docs``: the maximal runs of bytes that go, and the bytes that stay.  ``key`` is a whole
    number."""
    folder = shared_folder(docs.sparkSession)
    id_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(
        F.col(key).alias("key"),
        F.make_valid_utf8(F.coalesce(F.col(text), F.lit(""))).cast("binary").alias("text"),
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + size // PART_BYTES
    packed = rows.mapInArrow(
        lambda batches: _to_parts(batches, folder, parts),
        "block long, part long, token binary, context binary, rank binary",
    )
    answers = packed.groupBy("part").applyInArrow(
        _answers, "block long, part long, answers binary"
    )
    found = stored(
        answers.groupBy("block").applyInArrow(
            lambda table: _from_parts(table, folder, parts), f"{_SPANS}, {_SUFFIXES}"
        )
    )
    suffixes = found.where("suffix is not null").drop("rows", "starts", "ends")
    buckets = 1 + suffixes.count() // BUCKET_ROWS
    ordered = suffixes.repartitionByRange(buckets, "suffix", "rank", "block", "row", "first")
    in_order = stored(
        ordered.mapInArrow(lambda batches: _bucket(batches, buckets), f"{_SPANS}, {_OPENED}")
    )
    span_columns = ["block", "rows", "starts", "ends"]
    opened = in_order.where("part is not null").drop(*span_columns)
    spans = (
        found.where("rows is not null").select(*span_columns)
        .union(in_order.where("rows is not null").select(*span_columns))
        .union(opened.groupBy("part").applyInArrow(_across, _SPANS))
    )
    return (
        spans.groupBy("block")
        .applyInArrow(
            lambda table: _cut(table, folder),
            f"key {id_type}, n_bytes long, spans array<struct<start: int, end: int>>, kept binary",
        )
        .withColumnRenamed("key", key)
    )
