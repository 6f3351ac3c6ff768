"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are cut into pre-tokens and gathered into blocks of some twenty million characters.  A block
numbers its distinct words and keeps, for every document, the sequence of those numbers: each
pre-token with its position.  The distinct words are dealt to partitions by a hash of the word, so
all equal words of the corpus meet and each is encoded once; their ids go back to the blocks that
asked for them, and a block puts its documents together by position.

A very common word has one entry a block, not one an occurrence, so no word makes a hot partition.
A task holds one block, or the distinct words of one part of the word space.

Defined results: a null text is empty and has no ids; invalid UTF-8 counts as U+FFFD; rows are kept
one by one, so repeated rows and null or repeated document ids give rows of their own; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freightaudit.sources.sinks import shared_folder

#: Characters of text that a block gathers before it is closed; it bounds the memory of a task.
BLOCK_CHARS = 20_000_000
#: Pre-tokens in a row of a block's sequences.
ROW_TOKENS = 500_000

BLOCK_SCHEMA = (
    "block string, kind int, part int, numbers binary, lengths binary, payload binary, "
    "docs array<{id}>, counts array<int>"
)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank a line.  Its size is that of the vocabulary."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@cache
def _code_points(kind: str, below: int) -> str:
    """The code points below a bound of a class such as ``\\p{L}``, as ranges for a pattern.

    The tokenizer library itself is asked, with one token a byte, since libraries differ in the
    Unicode version they know: what it does not match it leaves out.
    """
    every = "".join(chr(p) for p in range(below) if not 0xD800 <= p <= 0xDFFF)
    probe = tiktoken.Encoding(
        "probe", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={}
    )
    points = np.array([ord(c) for c in bytes(probe.encode_ordinary(every)).decode()])
    breaks = np.flatnonzero(np.diff(points) > 1)
    starts, ends = points[np.append(0, breaks + 1)], points[np.append(breaks, -1)]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))


@cache
def _finder(pattern: str, below: int):
    """``findall`` of a pattern of the library, with its Unicode classes written out as ranges."""
    classes = {kind: _code_points(kind, below) for kind in (r"\p{L}", r"\p{N}", r"\s")}
    written, inside = [], False
    for piece in re.findall(r"\\p\{\w\}|\\[sS]|\\.|[\[\]]|[^\\\[\]]+", pattern):
        if piece in "[]":
            inside = piece == "["
        elif piece in classes:
            piece = classes[piece] if inside else f"[{classes[piece]}]"
        elif piece == r"\S":
            piece = f"[^{classes[r'\s']}]"
        written.append(piece)
    return re.compile("".join(written)).findall


def splitter(pattern: str):
    """A function from a text to its pre-tokens.  Most texts have no code point above U+FFFF and
    take classes cut off there, which match several times faster."""
    above = re.compile("[\U00010000-\U0010ffff]").search
    basic = _finder(pattern, 0x10000)
    return lambda text: _finder(pattern, 0x110000)(text) if above(text) else basic(text)


def encode(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    key: str = "doc_id",
    text: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(``key``, ids array<int>), one row for each row of ``docs``."""
    spark = docs.sparkSession
    id_type = docs.schema[key].dataType.simpleString()
    schema = BLOCK_SCHEMA.format(id=id_type)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(
        F.col(key).alias("key"),
        F.make_valid_utf8(F.coalesce(F.col(text), F.lit(""))).alias("text"),
    )

    def to_blocks(batches):
        return _blocks(batches, splitter(pattern), parts, block_chars)

    known = spark.sparkContext.broadcast(ranks)

    def to_ids(batches):
        return _encoded_words(batches, known, pattern)

    # bucketed by block, so that the sequences need no shuffle when the ids come back
    name = f"bpe_blocks_{uuid.uuid4().hex}"
    writer = texts.mapInArrow(to_blocks, schema).write.bucketBy(parts, "block")
    writer.option("path", shared_folder(spark)).saveAsTable(name)
    blocks = spark.table(name)
    words = (
        blocks.where("kind = 0")
        .select("part", "block", "numbers", "lengths", "payload")
        .repartition("part")
        .sortWithinPartitions("part")
        .mapInArrow(to_ids, "block string, numbers binary, lengths binary, payload binary")
    )
    sequences = blocks.where("kind = 1").select("block", "payload", "docs", "counts")
    return (
        sequences.groupBy("block")
        .cogroup(words.groupBy("block"))
        .applyInArrow(_documents, f"key {id_type}, ids array<int>")
        .withColumnRenamed("key", key)
    )


def packed(values: np.ndarray) -> bytes:
    """Whole numbers below 2**32, compressed byte plane by byte plane."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


class _Numbers(dict):
    """Words to numbers in the order they first appear."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def _blocks(batches: Iterator[pa.RecordBatch], split, parts: int, block_chars: int):
    numbers, keys, sequences, chars = _Numbers(), [], [], 0
    for batch in batches:
        number = numbers.__getitem__
        for key, text in zip(batch.column("key"), batch.column("text").to_pylist(), strict=True):
            words = split(text)
            keys.append(key.as_py())
            sequences.append(np.fromiter(map(number, words), np.uint32, len(words)))
            chars += len(text)
            if chars >= block_chars:
                yield from _block_rows(numbers, keys, sequences, parts, batch.schema)
                numbers, keys, sequences, chars = _Numbers(), [], [], 0
                number = numbers.__getitem__
    if keys:
        yield from _block_rows(numbers, keys, sequences, parts, batch.schema)


def _block_rows(numbers: dict, keys: list, sequences: list[np.ndarray], parts: int, schema):
    """The rows of a block: its words by part of the word space, and its sequences.  Numbers are
    given anew by falling frequency, which packs better."""
    block = uuid.uuid4().hex
    id_type = schema.field("key").type
    counts = np.bincount(np.concatenate(sequences), minlength=len(numbers))
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    words = [word.encode() for word in numbers]
    home = np.fromiter((zlib.crc32(word) % parts for word in words), np.int32, len(words))
    by_home = np.argsort(home, kind="stable")
    edges = np.searchsorted(home[by_home], np.arange(parts + 1))
    for part in range(parts):
        own = by_home[edges[part] : edges[part + 1]]
        if len(own):
            own = own[np.argsort(place[own])]
            here = [words[i] for i in own.tolist()]
            numbers_of = np.diff(place[own], prepend=np.uint32(0))
            yield _row(
                id_type, block, 0, part, packed(numbers_of),
                packed(np.fromiter(map(len, here), np.uint32, len(here))),
                zstandard.ZstdCompressor(level=3).compress(b"".join(here)), None, None,
            )
    start = size = 0
    for at in range(len(keys) + 1):
        if at == len(keys) or size >= ROW_TOKENS:
            chunk = sequences[start:at]
            payload = packed(place[np.concatenate(chunk)] if size else np.empty(0, np.uint32))
            lengths = [len(sequence) for sequence in chunk]
            yield _row(id_type, block, 1, -1, None, None, payload, keys[start:at], lengths)
            start, size = at, 0
        if at < len(keys):
            size += len(sequences[at])


def _row(id_type, block, kind, part, numbers, lengths, payload, docs, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block]), pa.array([kind], pa.int32()), pa.array([part], pa.int32()),
            pa.array([numbers], pa.binary()), pa.array([lengths], pa.binary()),
            pa.array([payload], pa.binary()), pa.array([docs], pa.list_(id_type)),
            pa.array([counts], pa.list_(pa.int32())),
        ],
        ["block", "kind", "part", "numbers", "lengths", "payload", "docs", "counts"],
    )


def _encoded_words(batches: Iterator[pa.RecordBatch], ranks: Broadcast, pattern: str):
    """Word rows with each word replaced by its ids.  The rows of a part follow each other, and a
    word belongs to one part, so ``known`` sees every distinct word once."""
    encoder = None
    part, known = None, {}
    for batch in batches:
        if encoder is None:
            encoder = tiktoken.Encoding(
                "words", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={}
            )
        for row in range(batch.num_rows):
            cells = {name: batch.column(name)[row] for name in batch.schema.names}
            if cells["part"].as_py() != part:
                part, known = cells["part"].as_py(), {}
            text = zstandard.ZstdDecompressor().decompress(cells["payload"].as_py())
            ends = np.cumsum(unpacked(cells["lengths"].as_py()).astype(np.int64)).tolist()
            ids, sizes, start = [], [], 0
            for end in ends:
                word = text[start:end]
                start = end
                own = known.get(word)
                if own is None:
                    own = known[word] = encoder._encode_single_piece(word)
                ids += own
                sizes.append(len(own))
            found = [
                cells["block"].as_py(), cells["numbers"].as_py(),
                packed(np.array(sizes, np.uint32)), packed(np.array(ids, np.uint32)),
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([cell]) for cell in found], ["block", "numbers", "lengths", "payload"]
            )


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The whole numbers of the ranges that begin at ``starts``, one range after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - ends + sizes, sizes)


def _documents(sequences: pa.Table, words: pa.Table) -> pa.Table:
    """The documents of a block: its sequences of words, and the ids of its words."""
    columns = [words.column(c).to_pylist() for c in ("numbers", "lengths", "payload")]
    starts, sizes, flat = _word_table(list(zip(*columns, strict=True)))
    found = []
    for row in range(sequences.num_rows):
        cells = {name: sequences.column(name)[row] for name in ("payload", "docs", "counts")}
        sequence = unpacked(cells["payload"].as_py())
        own = sizes[sequence]
        counts = np.asarray(cells["counts"].as_py(), np.int64)
        before = np.concatenate(([0], np.cumsum(own)))
        offsets = before[np.concatenate(([0], np.cumsum(counts)))]
        ids = flat[spans(starts[sequence], own)]
        lists = pa.ListArray.from_arrays(offsets.astype(np.int32), ids)
        found.append(pa.RecordBatch.from_arrays([cells["docs"].values, lists], ["key", "ids"]))
    return pa.Table.from_batches(found)


def _word_table(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the ids of each word of a block begin, how many they are, and the ids."""
    if not rows:
        empty = np.empty(0, np.int64)
        return empty, empty, empty.astype(np.int32)
    numbers = np.concatenate([np.cumsum(unpacked(n).astype(np.int64)) for n, _, _ in rows])
    lengths = np.concatenate([unpacked(x) for _, x, _ in rows]).astype(np.int64)
    flat = np.concatenate([unpacked(ids) for _, _, ids in rows]).astype(np.int32)
    starts, sizes = np.empty(len(numbers), np.int64), np.empty(len(numbers), np.int64)
    starts[numbers] = np.cumsum(lengths) - lengths
    sizes[numbers] = lengths
    return starts, sizes, flat


class TokenTable:
    """The token-byte table, id by id, and the decimal form of every id."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        tokens: list[bytes | None] = [None] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.known = np.array([t is not None for t in tokens], bool)
        self.sizes = np.array([len(t or b"") for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(t or b"" for t in tokens), np.uint8)
        width = len(str(size)) + 1
        self.decimals = np.array([f"{i} ".encode() for i in range(size)], f"S{width}")
        self.decimals = self.decimals.view(np.uint8).reshape(size, width)

    def decoded(self, ids: np.ndarray | None) -> bytes | None:
        """The bytes of ``ids``; None if there are none or one of them is unknown."""
        if ids is None or len(ids) and not 0 <= ids.min() <= ids.max() < len(self.known):
            return None
        if not self.known[ids].all():
            return None
        pieces = (ids[at : at + ROW_TOKENS] for at in range(0, len(ids), ROW_TOKENS))
        return b"".join(
            self.flat[spans(self.starts[piece], self.sizes[piece])].tobytes() for piece in pieces
        )

    def written(self, ids: np.ndarray) -> bytes:
        """Decimal ids, joined by a space."""
        pieces = (self.decimals[ids[at : at + ROW_TOKENS]] for at in range(0, len(ids), ROW_TOKENS))
        return b"".join(digits[digits > 0].tobytes() for digits in pieces)[:-1]


def token_table(spark: SparkSession, ranks: dict[bytes, int]) -> Broadcast:
    """It has as many rows as the vocabulary, whatever the input, which is the proven bound for
    sending it to every executor."""
    return spark.sparkContext.broadcast(TokenTable(ranks))


def _id_rows(column: pa.ListArray) -> Iterator[np.ndarray | None]:
    for ids in column:
        yield ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else None


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded`` binary: its ids joined to the token-byte table, in order.
    Null where ids are null or hold an id that the table lacks."""
    table = token_table(encoded.sparkSession, ranks)
    rows = encoded.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches):
        for batch in batches:
            found = [table.value.decoded(own) for own in _id_rows(batch.column(ids))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, "decoded"]
            )

    return rows.mapInArrow(run, f"{schema}, decoded binary")


def digests(encoded: DataFrame, ranks: dict[bytes, int], key: str = "doc_id") -> DataFrame:
    """(``key``, n_tokens, ids_sha256, decoded_sha256): of the decimal ids joined by a space, and
    of the bytes that the ids decode to."""
    table = token_table(encoded.sparkSession, ranks)
    id_type = encoded.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            sizes, of_ids, of_bytes = [], [], []
            for ids in _id_rows(batch.column("ids")):
                sizes.append(len(ids))
                of_ids.append(hashlib.sha256(table.value.written(ids)).hexdigest())
                data = table.value.decoded(ids)
                of_bytes.append(None if data is None else hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key), pa.array(sizes, pa.int64()),
                    pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string()),
                ],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return encoded.select(key, "ids").mapInArrow(
        run, f"`{key}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
