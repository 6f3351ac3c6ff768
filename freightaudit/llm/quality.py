"""A quality classifier of supervised subword embeddings.

Words (split at white space) and their character n-grams, and the event that a word repeats the
one before it, are hashed to buckets.  A bucket has a learned vector; a document is the average of
the vectors of all its features, and a softmax layer tells the classes apart.  Vectors and layer
are trained together by stochastic gradient descent in numpy, on at most ``MAX_PER_CLASS`` labelled
documents of either class, drawn by a hash of the id: the documented bound of the fit.  Training
documents are read and scored over their whole texts.

Since the average and the layer are linear, a trained model is a number a bucket: a document's
score is the logistic of the average of those numbers.  That table has ``2**BITS`` entries whatever
the input, and is what executors get.

Defined results: null and wordless texts get the score of a document without features, the share of
good labels; ids with several labels count as good if any is; rows without a label, and labels
other than 0 and 1, teach nothing; with labels of one class, or none, the score is the smoothed
share for all; repeated rows are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from freightaudit.sources.sinks import stored

BITS = 18
DIMENSIONS = 8
NGRAMS = (3, 4)
MAX_PER_CLASS = 3000
EPOCHS = 6
RATE = 1.0
#: The bucket of the event that a word repeats the one before it.
REPEAT = 0
#: Distinct words whose features a task remembers.
MEMORY = 300_000
#: Texts and new words that a task works on at a time.
SLICE_ROWS, SLICE_WORDS = 500, 20_000

_PRIME = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and their n-grams, and for each the place of its word in ``words``."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    points = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "replace"), "<u4")
    points = points.astype(np.uint64) + np.uint64(1)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(points)) - starts[owner]
    powers = np.multiply.accumulate(np.full(int(sizes.max()), _PRIME, np.uint64))
    hashes = [np.add.reduceat(points * powers[place], starts)]
    owners = [np.arange(len(words))]
    for n in NGRAMS:
        if len(points) >= n:
            inside = owner[: len(points) - n + 1] == owner[n - 1 :]
            gram = np.full(len(inside), n, np.uint64)
            for k in range(n):
                gram = (gram * _PRIME) ^ points[k : k + len(inside)]
                gram *= _MIX
            hashes.append(gram[inside])
            owners.append(owner[: len(inside)][inside])
    hashed = np.concatenate(hashes)
    hashed = (hashed ^ (hashed >> np.uint64(29))) * _MIX
    buckets = (hashed >> np.uint64(64 - BITS)).astype(np.int64)
    return np.maximum(buckets, REPEAT + 1), np.concatenate(owners)


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a document and their shares of all its features."""
    words = text.split()
    counts = Counter(words)
    buckets, owner = word_features(list(counts))
    weights = np.fromiter(counts.values(), np.float64, len(counts))[owner]
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    buckets, weights = np.append(buckets, REPEAT), np.append(weights, repeats)
    buckets, inverse = np.unique(buckets, return_inverse=True)
    weights = np.bincount(inverse, weights)
    total = weights.sum()
    return buckets, (weights / total if total else weights).astype(np.float32)


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(text, label) of at most ``per_class`` labelled documents of either class.

    Ids are drawn from the narrow label table first, so that the texts of other documents are
    never shuffled; the ids sent to the executors are bounded by ``2 * per_class``.
    """
    known = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label"))
        .where("_id is not null and label in (0, 1)")
        .groupBy("_id")
        .agg(F.max("label").alias("label"))
    )
    order = Window.partitionBy("label").orderBy(F.xxhash64("_id"), "_id")
    drawn = known.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_class)
    drawn = drawn.drop("n")
    texts = docs.select(F.col("doc_id").alias("_doc"), F.make_valid_utf8("text").alias("text"))
    found = texts.join(F.broadcast(drawn), F.col("_doc") == F.col("_id"))
    return found.groupBy("_id").agg(F.min(F.struct("text", "label")).alias("row")).select("row.*")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality",
        per_class: int = MAX_PER_CLASS) -> np.ndarray:
    """The model: a number for every bucket and, last, the intercept."""
    rows = sample(docs, labels, label, per_class).where("text is not null")
    features = stored(rows.mapInArrow(_featurised, "label int, buckets binary, shares binary"))
    shares = labels.where(F.col(label).isin(0, 1)).agg(
        F.sum(F.col(label).cast("double")).alias("good"), F.count("*").alias("n")
    )
    good, n = shares.first()
    prior = float(np.log(((good or 0) + 1) / (n - (good or 0) + 1)))
    trained = features.repartition(1).mapInArrow(_train, "model binary").first()
    model = np.zeros(2**BITS + 1)
    if isinstance(trained, Row) and trained.model:
        model = np.frombuffer(trained.model, np.float64).copy()
    model[-1] += prior
    return model


def _featurised(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        found = [document_features(text) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("label"),
                pa.array([b.astype("<i4").tobytes() for b, _ in found], pa.binary()),
                pa.array([s.tobytes() for _, s in found], pa.binary()),
            ],
            ["label", "buckets", "shares"],
        )


def _train(batches: Iterator[pa.RecordBatch]):
    """The number of every bucket, learned from the bounded sample."""
    rows = []
    for batch in batches:
        for label, buckets, shares in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append((label, np.frombuffer(buckets, "<i4"), np.frombuffer(shares, np.float32)))
    rows.sort(key=lambda row: (row[0], zlib.crc32(row[1]), zlib.crc32(row[2])))
    classes = Counter(label for label, _, _ in rows)
    if len(classes) < 2:
        return
    rng = np.random.default_rng(7)
    vectors = rng.uniform(-1, 1, (2**BITS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    layer, intercept = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    weight = {label: len(rows) / (2 * n) for label, n in classes.items()}
    for step in range(EPOCHS * len(rows)):
        if step % len(rows) == 0:
            order = rng.permutation(len(rows))
        label, buckets, shares = rows[order[step % len(rows)]]
        rate = np.float32(RATE * weight[label] * (1 - step / (EPOCHS * len(rows))))
        document = shares @ vectors[buckets]
        logits = layer @ document + intercept
        chance = np.exp(logits - logits.max())
        error = chance / chance.sum()
        error[label] -= 1
        back = error @ layer
        layer -= rate * np.outer(error, document)
        intercept -= rate * error
        vectors[buckets] -= rate * np.outer(shares, back)
    numbers = vectors.astype(np.float64) @ (layer[1] - layer[0]).astype(np.float64)
    model = np.append(numbers, float(intercept[1] - intercept[0]))
    yield pa.RecordBatch.from_arrays([pa.array([model.tobytes()], pa.binary())], ["model"])


class _Words(dict):
    """Words to numbers in the order they first appear, and the words that are new."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


def score(docs: DataFrame, model: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` without its text, with score (0 to 1) and predicted (1 from 0.5) in place of columns
    so named."""
    others = [c for c in docs.columns if c not in (text, "score", "predicted")]
    rows = docs.select(*others, F.make_valid_utf8(F.coalesce(text, F.lit(""))).alias(text))
    fields = ", ".join(f"`{f}` {docs.schema[f].dataType.simpleString()}" for f in others)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        return _scored(batches, known.value, others, text)

    return rows.mapInArrow(run, f"{fields}, score double, predicted int")


def _scored(batches: Iterator[pa.RecordBatch], model: np.ndarray, others: list[str], text: str):
    """A word's features are looked up once and remembered as their sum and number.  Texts and new
    words are worked on some at a time, so a task's memory does not follow its batches."""
    numbers, sums, sizes = _Words(), np.empty(0), np.empty(0, np.int64)
    for batch in batches:
        found = []
        for start in range(0, batch.num_rows, SLICE_ROWS):
            if len(numbers) > MEMORY:
                numbers, sums, sizes = _Words(), np.empty(0), np.empty(0, np.int64)
            number = numbers.__getitem__
            sequences = []
            for value in batch.column(text).slice(start, SLICE_ROWS).to_pylist():
                words = value.split()
                sequences.append(np.fromiter(map(number, words), np.int32, len(words)))
            for at in range(0, len(numbers.new), SLICE_WORDS):
                new = numbers.new[at : at + SLICE_WORDS]
                buckets, owner = word_features(new)
                sums = np.append(sums, np.bincount(owner, model[buckets], len(new)))
                sizes = np.append(sizes, np.bincount(owner, minlength=len(new)))
            numbers.new.clear()
            for sequence in sequences:
                repeats = int(np.count_nonzero(sequence[1:] == sequence[:-1]))
                total = int(sizes[sequence].sum()) + repeats
                summed = float(sums[sequence].sum()) + repeats * model[REPEAT]
                found.append(summed / total + model[-1] if total else model[-1])
        scores = 1 / (1 + np.exp(-np.clip(np.array(found), -60, 60)))
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(c) for c in others],
                pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32)),
            ],
            [*others, "score", "predicted"],
        )
