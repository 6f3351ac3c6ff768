"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Every three consecutive bytes of a text are hashed to one of 128 buckets and counted.  A bucket is
written as two bits, the quartile of the bucket counts that its own count falls into; the digest
begins with the length on a logarithmic scale and the ratios of the quartiles:
``LL RR QQ...`` in lower-case hex, 68 digits.  Two digests are compared by a bounded score: what
their lengths, ratios and bucket quartiles differ by, over the largest difference there is; the
likeness is one minus that.

Defined results: a null text is empty; texts with fewer than three bytes count one triplet, padded
with zero bytes, the empty text none; invalid UTF-8 counts as U+FFFD.  Rows are put in order by id
(nulls first), then by text, and every row, repeated ones too, is followed by the next row of that
order, the last by the first (an only row by itself).  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from freightaudit.sources.sinks import stored

BUCKETS = 128
#: Largest differences that count: of the length and the ratios, and of a bucket.
LENGTH_BOUND, RATIO_BOUND, BUCKET_BOUND = 24, 15, 3
#: Bytes that are hashed at a time, which bounds memory for very long texts.
CHUNK_BYTES = 4_000_000


def bucket_counts(data: bytes) -> np.ndarray:
    """Counts of the hashed triplets by bucket."""
    counts = np.zeros(BUCKETS, np.int64)
    if not data:
        return counts
    data = data.ljust(3, b"\0")
    for start in range(0, len(data) - 2, CHUNK_BYTES):
        b = np.frombuffer(data, np.uint8)[start : start + CHUNK_BYTES + 2].astype(np.uint32)
        triplet = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
        hashed = (triplet * np.uint32(2654435761)) ^ (triplet >> 5)
        hashed = (hashed * np.uint32(2246822519)) >> 25
        counts += np.bincount(hashed, minlength=BUCKETS)
    return counts


def digest(text: str) -> str:
    """The fingerprint of a text."""
    data = text.encode()
    counts = bucket_counts(data)
    ordered = np.sort(counts)
    q1, q2, q3 = (int(ordered[BUCKETS * i // 4 - 1]) for i in (1, 2, 3))
    quartile = (counts > q1).astype(np.int64) + (counts > q2) + (counts > q3)
    pairs = quartile.reshape(-1, 4) @ np.array([64, 16, 4, 1])
    length = min(255, round(8 * np.log2(1 + len(data)))) if data else 0
    ratios = (q1 * 100 // q3 % 16) << 4 | (q2 * 100 // q3 % 16) if q3 else 0
    return bytes([length, ratios, *pairs.tolist()]).hex()


def likeness(one: str, other: str) -> float:
    """One minus the bounded difference score of two digests: 1 for equal ones, at least 0."""
    a, b = bytes.fromhex(one), bytes.fromhex(other)
    length = min(LENGTH_BOUND, abs(a[0] - b[0]))
    ratios = 0
    for shift in (4, 0):
        step = abs((a[1] >> shift & 15) - (b[1] >> shift & 15))
        ratios += min(step, 16 - step)
    x, y = (np.frombuffer(d, np.uint8, offset=2) for d in (a, b))
    buckets = 0
    for shift in (0, 2, 4, 6):
        step = np.abs((x >> shift & 3).astype(np.int64) - (y >> shift & 3))
        buckets += int(step.sum())
    worst = LENGTH_BOUND + RATIO_BOUND + 1 + BUCKET_BOUND * BUCKETS
    return 1 - (length + ratios + buckets) / worst


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the beginning of ``following``."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def compare(text: str, following: str) -> tuple:
    """n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    changed = edited(text, following)
    own, other, after = digest(text), digest(changed), digest(following)
    sha = hashlib.sha256(changed.encode()).hexdigest()
    return len(text), sha, own, other, likeness(own, other), likeness(own, after)


FIELDS = (
    "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def compared_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and FIELDS for every row: fingerprints of the text and of its edited form.

    One range shuffle puts the rows in order, and each task goes through its slice row by row.  A
    slice's last row needs the first of the following slice: of every slice those two rows are
    carried on, as many as there are partitions, and joined.
    """
    id_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(
        F.col(key).alias("key"),
        F.make_valid_utf8(F.coalesce(F.col(text), F.lit(""))).alias("text"),
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("key", F.xxhash64("text"), "text")
    slices = (
        rows.repartitionByRange(parts, *order[:2])
        .sortWithinPartitions(*order)
        .withColumn("slice", F.spark_partition_id())
    )
    schema = f"kind int, slice int, key {id_type}, text string, {FIELDS}"
    done = stored(slices.mapInArrow(_through_slices, schema))
    heads = done.where("kind = 1").select("slice", F.col("text").alias("head"))
    ends = done.where("kind = 2").select("slice", "key", "text")
    one = Window.orderBy("slice")  # over as many narrow rows as there are slices
    numbers = heads.select("slice")
    following = numbers.select(
        "slice", F.lead("slice").over(one).alias("next")
    ).join(numbers.agg(F.min("slice").alias("least")))
    following = following.select("slice", F.coalesce("next", "least").alias("head_slice"))
    pairs = ends.join(following, "slice").join(
        heads.withColumnRenamed("slice", "head_slice"), "head_slice"
    )
    last = pairs.select("key", "text", "head").mapInArrow(_pairs, f"key {id_type}, {FIELDS}")
    names = last.columns
    return done.where("kind = 0").select(names).union(last).withColumnRenamed("key", key)


def _through_slices(batches: Iterator[pa.RecordBatch]):
    """Compared rows (kind 0), the first row of the slice (1) and its last (2)."""
    key_type, before, last = None, None, None
    for batch in batches:
        key_type = batch.schema.field("key").type
        keys, found, texts = [], [], batch.column("text").to_pylist()
        if last is None and texts:
            slice_ = batch.column("slice")[0].as_py()
            yield _marked(1, slice_, batch.column("key")[0], texts[0], key_type)
        for key, text in zip(batch.column("key"), texts, strict=True):
            if last is not None:
                keys.append(last[0].as_py())
                after = digest(text)
                found.append(_compared(last[1], before, text, after))
                before = after
            else:
                before = digest(text)
            last = (key, text)
        yield _compared_batch(keys, found, key_type)
    if last is not None:
        yield _marked(2, slice_, *last, key_type)


def _compared(text: str, own: str, following: str, after: str) -> tuple:
    changed = edited(text, following)
    other = digest(changed)
    sha = hashlib.sha256(changed.encode()).hexdigest()
    return len(text), sha, own, other, likeness(own, other), likeness(own, after)


_TYPES = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
_NAMES = [field.split()[0] for field in FIELDS.split(", ")]


def _compared_batch(keys: list, found: list[tuple], key_type) -> pa.RecordBatch:
    n = len(keys)
    columns = [pa.array([row[i] for row in found], t) for i, t in enumerate(_TYPES)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([0] * n, pa.int32()), pa.nulls(n, pa.int32()), pa.array(keys, key_type),
            pa.nulls(n, pa.string()), *columns,
        ],
        ["kind", "slice", "key", "text", *_NAMES],
    )


def _marked(kind: int, slice_: int, key, text: str, key_type) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([kind], pa.int32()), pa.array([slice_], pa.int32()),
            pa.array([key.as_py()], key_type), pa.array([text]), *[pa.nulls(1, t) for t in _TYPES],
        ],
        ["kind", "slice", "key", "text", *_NAMES],
    )


def _pairs(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        texts, heads = (batch.column(c).to_pylist() for c in ("text", "head"))
        found = [compare(t, h) for t, h in zip(texts, heads, strict=True)]
        columns = [pa.array([row[i] for row in found], t) for i, t in enumerate(_TYPES)]
        yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], ["key", *_NAMES])
