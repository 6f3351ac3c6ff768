"""Near duplicates by SimHash: a segment-popcount embedding, a grid range-join, an exact check.

A fingerprint's 64 bits are cut into 16 segments of four; its embedding is the vector of their bit
counts.  The Manhattan distance of two embeddings never exceeds the number of differing bits, so
fingerprints that differ in at most three bits lie within three of each other in the grid.  Then
the eight coordinates of one of the two halves lie within **one** of each other: every fingerprint
stands in its own cell of either half's grid, is looked up there and in the neighbouring cells, and
what meets is held against the distance in the other half and at last bit by bit.

A step of one changes the parity of a cell's sum, so only fingerprints on even cells look into the
neighbours.  Equal fingerprints are one node, however many documents have them; a node has at most
43,744 others within three bits, so pairs grow no faster than nodes times a constant.

Defined results: null and wordless texts have the fingerprint zero and are linked like any other;
invalid UTF-8 counts as U+FFFD; every row gets a row, repeated rows and null ids too (a group whose
ids are all null has a null component); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightaudit.sources.sinks import stored

SHINGLE_WORDS = 3
SEED = 42
DISTANCE = 3
#: Words that are cut from a text at a time, which bounds memory for very long texts.
CHUNK_WORDS = 500_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, fp long), one row for each row of ``docs``."""
    id_type = docs.schema[key].dataType.simpleString()
    texts = docs.select(
        F.col(key).alias("key"),
        F.make_valid_utf8(F.coalesce(F.col(text), F.lit(""))).cast("binary").alias("text"),
    )
    return texts.mapInArrow(_fingerprints, f"key {id_type}, fp long").withColumnRenamed("key", key)


def _fingerprints(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        found = [simhash(text) for text in batch.column("text").to_pylist()]
        prints = pa.array(np.array(found, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("key"), prints], ["key", "fp"])


def simhash(text: bytes) -> int:
    """The fingerprint of a UTF-8 text: the bits set in over half the hashes of its shingles."""
    total, ones = 0, np.zeros(64, np.int64)
    for hashes in _shingle_hashes(text.translate(_LOWER)):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _shingle_hashes(text: bytes) -> Iterator[np.ndarray]:
    """Hashes of the shingles of a lower-cased text, some at a time."""
    hashed, kept, none = xxhash.xxh64_intdigest, [], True
    while text:
        words = text.split(None, CHUNK_WORDS)  # bytes split at \x20 and \x09-\x0D
        text = words.pop() if len(words) > CHUNK_WORDS else b""
        words = kept + words
        joined = b" ".join(words)
        if len(words) >= SHINGLE_WORDS:
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(sizes + 1) - 1
            starts = (ends - sizes)[: 1 - SHINGLE_WORDS].tolist()
            ends = ends[SHINGLE_WORDS - 1 :].tolist()
            yield np.array(
                [hashed(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64
            )
            none = False
        elif words and none and not text:
            yield np.array([hashed(joined, SEED)], np.uint64)
        kept = words[1 - SHINGLE_WORDS :]


def _segment_count(fp: Column, segment: int) -> Column:
    return F.bit_count(F.shiftrightunsigned(fp, 4 * segment).bitwiseAND(F.lit(15)))


def _cell(counts: list[Column]) -> Column:
    """Eight counts as one number, three bits each."""
    number = F.lit(0)
    for i, count in enumerate(counts):
        number = number.bitwiseOR(F.shiftleft(count, 3 * i))
    return number


def close_pairs(nodes: DataFrame, fp: str = "fp") -> DataFrame:
    """Distinct pairs (a, b) of the distinct fingerprints in ``nodes`` that differ in 1 to 3 bits."""
    prints = nodes.select(F.col(fp).alias("fp"))
    sides = []
    for half in (0, 1):
        counts = [_segment_count(F.col("fp"), 8 * half + i) for i in range(8)]
        other = [
            F.bit_count(F.shiftrightunsigned("fp", 32 * (1 - half) + 8 * i).bitwiseAND(F.lit(255)))
            for i in range(4)
        ]
        sides.append(
            F.struct(
                F.lit(half).alias("half"),
                _cell(counts).alias("cell"),
                *[c.alias(f"o{i}") for i, c in enumerate(other)],
            )
        )
    cells = prints.select("fp", F.explode(F.array(*sides)).alias("s")).select("fp", "s.*")
    looked_up = cells.select(
        F.col("fp").alias("from_fp"),
        F.col("half").alias("from_half"),
        *[F.col(f"o{i}").alias(f"from_o{i}") for i in range(4)],
        F.explode(_neighbours(F.col("cell"))).alias("n"),
    ).select("*", F.col("n.cell").alias("from_cell"), F.col("n.step").alias("step"))
    apart = sum((F.abs(F.col(f"o{i}") - F.col(f"from_o{i}")) for i in range(4)), F.lit(0))
    meet = looked_up.join(
        cells,
        (F.col("half") == F.col("from_half"))
        & (F.col("cell") == F.col("from_cell"))
        & ((F.col("step") == 1) | (F.col("from_fp") < F.col("fp")))
        & (apart + F.col("step") <= DISTANCE)
        & (F.bit_count(F.col("fp").bitwiseXOR(F.col("from_fp"))) <= DISTANCE),
    )
    return meet.select(
        F.least("fp", "from_fp").alias("a"), F.greatest("fp", "from_fp").alias("b")
    ).distinct()


def _neighbours(cell: Column) -> Column:
    """Cells to look into: the cell itself and, if its sum is even, those one step away."""
    counts = [F.shiftright(cell, 3 * i).bitwiseAND(F.lit(7)) for i in range(8)]
    even = sum(counts, F.lit(0)) % 2 == 0
    steps = []
    for i, count in enumerate(counts):
        one = 1 << (3 * i)
        steps.append(F.when(even & (count < 4), cell + one))
        steps.append(F.when(even & (count > 0), cell - one))
    near = F.transform(
        F.array_compact(F.array(*steps)), lambda c: F.struct(c.alias("cell"), F.lit(1).alias("step"))
    )
    own = F.array(F.struct(cell.alias("cell"), F.lit(0).alias("step")))
    return F.concat(own, near)


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): for every node of ``pairs`` (a, b), the smallest node that it reaches.

    Each round takes the smallest label among the neighbours and then that label's own label, so
    labels jump and a chain takes far fewer rounds than it has links.  Labels are written to the
    shared folder after each round.
    """
    both = stored(
        pairs.select("a", "b").union(pairs.select("b", "a")).toDF("node", "other").distinct()
    )
    labels = stored(
        both.groupBy("node").agg(F.min("other").alias("low")).select(
            "node", F.least("node", "low").alias("root")
        )
    )
    while True:
        near = (
            both.join(labels.toDF("other", "near"), "other")
            .groupBy("node")
            .agg(F.min("near").alias("near"))
        )
        lowered = labels.join(near, "node").select(
            "node", "root", F.least("root", "near").alias("low")
        )
        # a node's old label is a node, too: follow it once
        jumped = lowered.join(labels.toDF("low", "next"), "low").select(
            "node", F.least("low", "next").alias("new"), F.col("root").alias("old")
        )
        jumped = stored(jumped)
        labels = jumped.select("node", F.col("new").alias("root"))
        if jumped.where("new <> old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, fp long, component_id): the smallest id that is reachable by links of at most
    three differing bits."""
    prints = stored(fingerprints(docs, key, text))
    nodes = prints.groupBy("fp").agg(F.min(key).alias("first"))
    roots = components(close_pairs(nodes))
    firsts = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    lowest = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = firsts.join(lowest, "root").select("fp", "component_id")
    return prints.join(of_fp, "fp").select(key, "fp", "component_id")
