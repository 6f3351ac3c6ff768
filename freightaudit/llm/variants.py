"""Spelling variants: words one error apart, found by a bit-sliced position index.

Words are the runs of letters of all texts, counted in Spark.  Two words are near if one inserted,
deleted or replaced code point turns one into the other.  The vocabulary is cut into groups that
share a half: a pair whose shorter word has m letters agrees in its first or in its last m // 2
letters, so every word stands in the groups of its own length and of the length below, by either
half.  A group's index has a bitset over its words for each (position, letter).  A query runs
through its letters once and keeps four bitsets: the words that agree so far, and those with one
letter replaced, one more or one less, whose bitsets are those of the same, the next and the last
position.  A step takes a few operations for 64 words; many queries go side by side.

Groups of more than ``BLOCK`` words are cut into blocks, and each pair of blocks is a task of its
own, so no task holds more than two blocks of a group.

Defined results: null texts have no words; a null id counts as the empty text in a word's hash; ties
go to the smallest word in code-point order; a word without near words has ``n_near`` 0, no form,
and is its own root; an empty table gives an empty result; rows that repeat count as often as they
stand; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightaudit.sources.sinks import stored

PATTERN = "[A-Za-zÀ-ÿ]+"
#: One of so many occurrences loses a letter.
LOSES = 97
MIN_LETTERS, MIN_COUNT = 5, 3
#: A word's form is so many times as frequent.
TIMES = 2
#: Words of a group that a task holds on either side.
BLOCK = 8192
#: Queries that run side by side.
QUERIES = 512
#: Group rows that a task takes at least.
TASK_ROWS = 4000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What full lower-casing leaves alone or turns as ASCII lower-casing does.
_PLAIN = "^[\\x00-\\x7fß-ÿ‐-›]*$"


def lower_ascii(text: Column) -> Column:
    """``text`` with A to Z in lower case and nothing else changed."""
    return F.when(text.rlike(_PLAIN), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): every run of letters, of which one in ``LOSES`` has lost a letter, by the hash of
    its document's id and the run."""
    words = docs.select(
        F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":")).alias("id"),
        F.explode(F.regexp_extract_all(lower_ascii(F.col(text)), F.lit(PATTERN), 0)).alias("run"),
    )
    hashed = F.crc32(F.concat("id", "run").cast("binary"))
    at = (hashed % F.length("run")).cast("int")
    shorter = F.concat(
        F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run"))
    )
    word = F.when(hashed % LOSES == 0, shorter).otherwise(F.col("run"))
    return words.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def vocabulary(counts: DataFrame) -> DataFrame:
    return counts.where((F.col("n") >= MIN_COUNT) & (F.length("word") >= MIN_LETTERS))


def near_words(words: DataFrame, block: int = BLOCK, task_rows: int = TASK_ROWS) -> DataFrame:
    """(word, n_near, near_n, near): of every word of ``words`` (word, n) that has near words, how
    many, and the most frequent of them."""
    size = F.length("word")
    groups = F.array(
        *[
            F.struct(
                (size - less).alias("m"),
                F.lit(side).alias("side"),
                half(((size - less) / 2).cast("int")).alias("half"),
            )
            for less in (0, 1)
            for side, half in (
                (0, lambda k: F.substring("word", F.lit(1), k)),
                (1, lambda k: F.when(k > 0, F.substring("word", -k, k)).otherwise("")),
            )
        ]
    )
    members = words.select("word", "n", F.explode(groups).alias("g")).select("word", "n", "g.*")
    members = members.where("m > 0")
    keys = ["m", "side", "half"]
    sizes = members.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)
    blocks = F.ceil(F.col("rows") / block).cast("int")
    rows = members.join(sizes, keys).select("*", blocks.alias("blocks"))
    rows = rows.select("*", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int").alias("own"))
    # block i as index and block j as queries: a word is index in its own row, query in its column
    each = F.sequence(F.lit(0), F.col("blocks") - 1)
    as_index = F.transform(
        each, lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(True).alias("index"),
                                 (j == F.col("own")).alias("query"))
    )
    as_query = F.transform(
        F.filter(each, lambda i: i != F.col("own")),
        lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(False).alias("index"),
                           F.lit(True).alias("query")),
    )
    placed = rows.select(*keys, "word", "n", F.inline(F.concat(as_index, as_query)))
    tasks = max(1, 4 * words.count() // task_rows)
    task = F.pmod(F.xxhash64(*keys, "i", "j"), F.lit(tasks)).alias("task")
    found = (
        placed.select(task, *keys, "i", "j", "word", "n", "index", "query")
        .groupBy("task")
        .applyInArrow(_search_task, "word string, n_near long, near_n long, near string")
    )
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near")
    )


def _search_task(table: pa.Table) -> pa.Table:
    """The groups and blocks of a task, one after another."""
    group = ["m", "side", "half", "i", "j"]
    table = table.sort_by([(c, "ascending") for c in [*group, "word"]])
    ends = np.zeros(len(table) + 1, bool)
    ends[[0, -1]] = True
    for name in group:
        codes = table.column(name).combine_chunks().dictionary_encode().indices.to_numpy()
        ends[1:-1] |= codes[1:] != codes[:-1]
    edges = np.flatnonzero(ends)
    names = table.column("word").to_pylist()
    counts = table.column("n").to_numpy()
    sizes, sides = table.column("m").to_numpy(), table.column("side").to_numpy()
    index = table.column("index").to_numpy(zero_copy_only=False)
    query = table.column("query").to_numpy(zero_copy_only=False)
    words, near, numbers = [], [], []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a < 2:
            continue
        own = slice(a, b)
        asked, met = near_pairs(names[own], int(sizes[a]), index[own], query[own], int(sides[a]))
        if not len(asked):
            continue
        # the most frequent first, then by word: names are in order
        order = np.lexsort((met, -counts[own][met], asked))
        asked, met = asked[order], met[order]
        first = np.flatnonzero(np.diff(asked, prepend=-1))
        words += [names[a + w] for w in asked[first].tolist()]
        near += [names[a + w] for w in met[first].tolist()]
        numbers.append(
            np.stack((np.diff(first, append=len(asked)), counts[own][met[first]]), axis=1)
        )
    figures = np.concatenate([np.empty((0, 2), np.int64), *numbers])
    return pa.table(
        {
            "word": pa.array(words, pa.string()),
            "n_near": pa.array(figures[:, 0], pa.int64()),
            "near_n": pa.array(figures[:, 1], pa.int64()),
            "near": pa.array(near, pa.string()),
        }
    )


def near_pairs(
    words: list[str], m: int, index: np.ndarray, query: np.ndarray, side: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (asked, met) of near words of ``m`` and ``m`` + 1 letters, one of them at least of
    ``m``.  With ``side`` 1, pairs that share their first m // 2 letters are left to the groups of
    side 0."""
    codes = np.array(words, f"U{m + 1}").view(np.uint32).reshape(len(words), m + 1)
    alphabet, letters = np.unique(codes, return_inverse=True)
    letters = letters.reshape(codes.shape)
    longer = codes[:, m] > 0
    held = np.flatnonzero(index)
    slices = position_index(letters[held], len(alphabet))
    pairs = []
    for is_longer in (False, True):
        asked = np.flatnonzero(query & (longer == is_longer))
        for start in range(0, len(asked), QUERIES):
            some = asked[start : start + QUERIES]
            same, more, less = one_error(slices, letters[some][:, : m + is_longer])
            for bits, wanted in ((less, ~longer),) if is_longer else ((same, ~longer), (more, longer)):
                row, column = _set_bits(bits, len(held))
                met = held[column]
                keep = wanted[met]
                pairs.append(np.stack((some[row[keep]], met[keep])))
    asked, met = np.concatenate(pairs, axis=1) if pairs else np.empty((2, 0), np.int64)
    if side:
        keep = (letters[asked, : m // 2] != letters[met, : m // 2]).any(axis=1)
        asked, met = asked[keep], met[keep]
    return asked, met


def position_index(letters: np.ndarray, alphabet: int) -> np.ndarray:
    """Bitsets over words, [position, letter, word of 64 bits]; the last position has none."""
    count, places = letters.shape
    width = -(-count // 64)
    bits = np.zeros((places + 1, alphabet, width * 64), bool)
    for place in range(places):
        bits[place, letters[:, place], np.arange(count)] = True
    return np.packbits(bits, axis=2, bitorder="little").view(np.uint64)


def one_error(slices: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each query of one length, bitsets of the words that have one letter replaced, one more
    and one less."""
    none = np.zeros((len(queries), slices.shape[2]), np.uint64)
    equal, replaced, more, less = ~none, none, none, none
    for i in range(queries.shape[1]):
        letter = queries[:, i]
        same = slices[i, letter]
        before = slices[i - 1, letter] if i else none
        replaced = (replaced & same) | (equal & ~same)
        more = (more | equal) & slices[i + 1, letter]
        less = (less & before) | equal
        equal = equal & same
    return replaced, more | equal, less


def _set_bits(bits: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the bits that are set, by the 64-bit words that have any."""
    row, word = np.nonzero(bits)
    single = np.unpackbits(bits[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, bit = np.nonzero(single)
    column = word[at] * 64 + bit
    keep = column < count
    return row[at][keep], column[keep]


def grouped(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of ``words`` (word, n).  Along forms counts at least
    double, so roots are found in a few rounds in which every link jumps."""
    words = stored(words)
    near = words.join(near_words(words), "word", "left")
    far = F.col("near_n") >= TIMES * F.col("n")
    near = stored(
        near.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(far, F.col("near")).alias("form"),
            F.when(far, F.col("near_n")).alias("form_n"),
        )
    )
    roots = stored(near.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = stored(
            roots.join(further, "root", "left").select(
                "word",
                F.coalesce("next", "root").alias("root"),
                F.col("next").isNotNull().alias("moved"),
            )
        )
        roots = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            break
    return near.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the vocabulary of ``docs``."""
    return grouped(vocabulary(word_counts(docs, key, text)))
