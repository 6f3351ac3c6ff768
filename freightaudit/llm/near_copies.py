"""Near copies by Jaccard similarity: SimHash and MinHash propose pairs, whole shingle sets decide.

Two texts are near copies if their sets of shingles of five words are equal to at least four fifths
(intersection over union); texts of fewer words are one shingle, wordless texts are equal.  Texts
with one set are one node, however many there are.

Pairs come first from op9's method, the SimHash grid of ``simhash.close_pairs``, and are checked
exactly: fingerprints of three differing bits or fewer, each by its smallest node, and all nodes of a
fingerprint against that one.  Near copies may differ in more bits (sf0.1: up to 11), so every node
has ``BANDS`` keys, too, each of ``ROWS`` MinHash values; nodes that share a key are held against each
other shingle by shingle, so nothing less similar is linked, and a pair of similarity s shares no key
with probability (1 - s^ROWS)^BANDS: 1.3e-7 at 0.8, less above.

At first every node is held only against the smallest node of each of its keys, so a large group of
near copies costs as many comparisons as it has nodes.  What shares a key and is not linked by then
is held against each other in blocks of ``BLOCK`` nodes: in that block of the first key that a pair
shares, and nowhere else, a byte of each MinHash value is compared.  Pairs that agree in fewer than
``AGREE`` are no near copies (at 0.8 as few come with probability 4e-8).  Texts of nodes that have any
other pair are sent to their blocks and compared there shingle by shingle, the likest first, unless a
block has joined their groups already.  So pairs are never rows: a block takes in its nodes and gives
back at most as many links.

Defined results: words are cut at ASCII blanks and lower-cased in ASCII, null texts are wordless,
invalid UTF-8 counts as U+FFFD; groups are transitive; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightaudit.llm.simhash import _LOWER, close_pairs, components, simhash
from freightaudit.sources.sinks import stored

SHINGLE_WORDS = 5
#: Least similarity, as a fraction of whole numbers.
SIMILAR = (4, 5)
BANDS, ROWS = 40, 5
#: Shingles that get their MinHash values at a time, which bounds memory for very long texts.
CHUNK = 4096
#: MinHash values of all that near copies have in common at least, nodes of a block and shingles of
#: all its nodes, and rows and shingles that a task takes at least.
AGREE, BLOCK, BLOCK_SHINGLES, TASK_ROWS, TASK_SHINGLES = 130, 1000, 1_000_000, 5000, 2_000_000

#: Columns of a node's row in a block.
_PLACED = ["band", "i", "j", "own", "node", "size", "root", "outside"]

_RANDOM = np.random.default_rng(42)
_STEPS = _RANDOM.integers(0, 2**64, SHINGLE_WORDS, np.uint64) | np.uint64(1)
_TIMES = _RANDOM.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)
_PLUS = _RANDOM.integers(0, 2**64, BANDS * ROWS, np.uint64)
_SIGN = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes) -> np.ndarray:
    """The distinct hashes of the shingles of a UTF-8 text, in order."""
    words = text.translate(_LOWER).split()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if len(words) < SHINGLE_WORDS:
        padded = np.zeros(SHINGLE_WORDS, np.uint64)
        padded[: len(words)] = hashes
        hashes = padded if words else hashes
    count = max(0, len(hashes) - SHINGLE_WORDS + 1)
    found = np.zeros(count, np.uint64)
    for i, step in enumerate(_STEPS):
        found += hashes[i : i + count] * step
    found ^= found >> np.uint64(31)
    return np.unique(found)


def min_hashes(found: np.ndarray) -> np.ndarray:
    """``BANDS`` times ``ROWS`` MinHash values of a set of shingles."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for start in range(0, len(found), CHUNK):
        part = found[start : start + CHUNK, None] * _TIMES + _PLUS
        np.minimum(least, part.min(axis=0), out=least)
    return least


def band_keys(found: np.ndarray, least: np.ndarray | None = None) -> list[int]:
    """``BANDS`` keys of a set of shingles; none of the empty set."""
    if not len(found):
        return []
    whole = (min_hashes(found) if least is None else least).reshape(BANDS, ROWS)
    return [
        int(np.int64(np.uint64(xxhash.xxh64_intdigest(row.tobytes(), band))))
        for band, row in enumerate(whole)
    ]


def _marked(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        nodes, sizes, bands, signs, prints = [], [], [], [], []
        for text in batch.column("text"):
            found = shingles(text.as_py())
            prints.append(simhash(text.as_py()))
            nodes.append(xxhash.xxh64_intdigest(found.tobytes()))
            sizes.append(len(found))
            least = min_hashes(found)
            bands.append(band_keys(found, least))
            # the low byte of a product follows few bits of the shingle, the high byte is least
            signs.append(((least * _SIGN) >> np.uint64(56)).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                batch.column("text_hash"),
                pa.array(np.array(nodes, np.uint64).view(np.int64)),
                pa.array(sizes, pa.int32()),
                pa.array(bands, pa.list_(pa.int64())),
                pa.array(signs, pa.binary()),
                pa.array(np.array(prints, np.uint64).view(np.int64)),
            ],
            ["id", "text_hash", "node", "size", "bands", "signs", "fp"],
        )


def _text_bytes(text: str) -> Column:
    return F.make_valid_utf8(F.coalesce(F.col(text), F.lit(""))).cast("binary")


def _alike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the ``pairs`` (a, b) whose ``texts`` (node, text) are near copies."""
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_held, "a long, b long")


def _held(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        kept = [
            _near(shingles(a.as_py()), shingles(b.as_py()))
            for a, b in zip(batch.column("text_a"), batch.column("text_b"), strict=True)
        ]
        yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))


def _near(one: np.ndarray, two: np.ndarray) -> bool:
    least, whole = SIMILAR
    common = len(np.intersect1d(one, two, assume_unique=True))
    return whole * common >= least * (len(one) + len(two) - common)


def _sizes_allow(one: str, two: str) -> Column:
    least, whole = SIMILAR
    return whole * F.least(one, two) >= least * F.greatest(one, two)


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_hash, root long): the group of every row of ``docs``."""
    id_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(
        F.col(key).alias("id"), F.xxhash64(text).alias("text_hash"), _text_bytes(text).alias("text")
    )
    marked = stored(
        rows.mapInArrow(
            _marked,
            f"id {id_type}, text_hash long, node long, size int, bands array<long>, "
            "signs binary, fp long",
        )
    )
    nodes = stored(marked.dropDuplicates(["node"]))
    keys = nodes.select("node", "size", F.explode("bands").alias("band"))
    lows = keys.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    shared = stored(keys.join(lows.where("low < high").drop("high"), "band"))
    sizes = nodes.select(F.col("node").alias("low"), F.col("size").alias("low_size"))

    stars = shared.where("node <> low").select("low", "node", "size").distinct()
    stars = stars.join(sizes, "low").where(_sizes_allow("size", "low_size"))
    asked = _of_grid(nodes).union(stars.select(F.col("low").alias("a"), F.col("node").alias("b")))
    asked = stored(asked.distinct())

    # one text of every node that is asked or shares a key
    wanted = shared.select("node").union(asked.select("a")).union(asked.select("b")).distinct()
    wanted = wanted.join(nodes.select("node", "text_hash"), "node")
    texts = rows.select("text_hash", "text").join(wanted, "text_hash").select("node", "text")
    texts = stored(texts.dropDuplicates(["node"]))

    links = stored(_alike(asked, texts))
    of_node = components(links).select("node", "root")
    labelled = shared.join(of_node, "node", "left").withColumn("root", F.coalesce("root", "node"))
    more = stored(_unlinked(stored(labelled), nodes.select("node", "signs", "bands"), texts))
    if not more.isEmpty():
        of_node = components(links.union(more)).select("node", "root")
    return marked.join(of_node, "node", "left").select(
        "id", "text_hash", F.coalesce("root", "node").alias("root")
    )


def _of_grid(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``nodes(node, size, fp)`` by SimHash: the smallest nodes of fingerprints that
    are close, and every node with the smallest of its fingerprint."""
    firsts = stored(nodes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("first")))
    same = nodes.join(firsts, "fp").where("node <> first.node")
    same = same.where(_sizes_allow("size", "first.size"))
    close = close_pairs(firsts)
    for side in ("a", "b"):
        close = close.join(firsts.toDF(side, f"{side}_first"), side)
    close = close.where(_sizes_allow("a_first.size", "b_first.size"))
    return same.select(F.col("first.node").alias("a"), F.col("node").alias("b")).union(
        close.select("a_first.node", "b_first.node")
    )


def _unlinked(labelled: DataFrame, signs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between nodes of ``labelled(band, node, size, root, low)`` that share a key and
    have different roots: enough of them to join all groups that have near copies in each other."""
    roots = labelled.groupBy("band", "root").agg(
        F.count("*").alias("n"), F.sum("size").alias("shingles")
    )
    bands = roots.groupBy("band").agg(
        F.max(F.struct("n", "root")).alias("most"),
        F.greatest(
            F.ceil(F.sum("n") / BLOCK), F.ceil(F.sum("shingles") / BLOCK_SHINGLES)
        ).cast("int").alias("c"),
        F.count("*").alias("k"),
    )
    bands = bands.where("k > 1").select("band", F.col("most.root").alias("home"), "c")
    rows = labelled.join(bands, "band").select(
        "band", "node", "size", "root", "c", (F.col("root") != F.col("home")).alias("outside"),
        F.pmod(F.xxhash64("node"), F.col("c")).cast("int").alias("own"),
    )
    # the blocks of a key are held against each other and themselves, if either has nodes outside
    outer = rows.where("outside").groupBy("band").agg(F.collect_set("own").alias("outer"))
    each = F.filter(
        F.sequence(F.lit(0), F.col("c") - 1),
        lambda other: F.array_contains("outer", F.col("own")) | F.array_contains("outer", other),
    )
    placed = rows.join(outer, "band").withColumn("other", F.explode(each))
    placed = stored(
        placed.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).select(
            _PLACED
        )
    )
    open_rows = stored(
        _by_block(placed.join(signs, "node"), 1 + placed.count() // TASK_ROWS).applyInArrow(
            _with_candidates, placed.schema
        )
    )
    total = open_rows.agg(F.count("*"), F.sum("size")).first()
    tasks = 1 + total[0] // TASK_ROWS + (total[1] or 0) // TASK_SHINGLES
    whole = open_rows.join(signs, "node").join(texts, "node")
    return _by_block(whole, tasks).applyInArrow(_linked, "a long, b long").distinct()


def _by_block(rows: DataFrame, tasks: int):
    task = F.pmod(F.xxhash64("band", "i", "j"), F.lit(tasks))
    return rows.withColumn("task", task).groupBy("task")


def _blocks(table: pa.Table) -> Iterator[pa.Table]:
    """The rows of each (band, i, j), by node."""
    table = table.sort_by([(c, "ascending") for c in ("band", "i", "j", "node")])
    keys = [table.column(c).to_numpy() for c in ("band", "i", "j")]
    edges = np.ones(len(table) + 1, bool)
    edges[1:-1] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    edges = np.flatnonzero(edges).tolist()
    for start, end in zip(edges[:-1], edges[1:], strict=True):
        yield table.slice(start, end - start)


def _candidates(block: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, rows, agreeing values): rows of a block that may be near copies, every pair once.

    They have different roots, one at least not that of the key's largest group, and come from the
    two blocks that are held against each other; no earlier key of theirs is equal.
    """
    columns = ("own", "size", "root", "outside")
    own, size, root, outside = (
        block.column(c).to_numpy(zero_copy_only=False) for c in columns
    )
    band, i, j = (block.column(c)[0].as_py() for c in ("band", "i", "j"))
    signs = np.frombuffer(b"".join(block.column("signs").to_pylist()), np.uint8)
    signs = signs.reshape(len(block), -1)
    bands = block.column("bands").combine_chunks().flatten().to_numpy().reshape(len(block), -1)
    least, whole = SIMILAR
    second = np.flatnonzero(own == j)
    for one in np.flatnonzero(own == i).tolist():
        met = second if i < j else second[second > one]
        meet = (root[met] != root[one]) & (outside[met] | outside[one])
        meet &= whole * np.minimum(size[met], size[one]) >= least * np.maximum(size[met], size[one])
        met = met[meet]
        agree = (signs[met] == signs[one]).sum(axis=1)
        met, agree = met[agree >= AGREE], agree[agree >= AGREE]
        first = bands[one, np.argmax(bands[met] == bands[one], axis=1)] == band
        if first.any():
            yield one, met[first], agree[first]


def _with_candidates(table: pa.Table) -> pa.Table:
    """The rows that have candidates in their block."""
    plain = table.select(_PLACED)
    kept = [plain.slice(0, 0)]
    for block in _blocks(table):
        wanted = np.zeros(len(block), bool)
        for one, met, _ in _candidates(block):
            wanted[one] = wanted[met] = True
        kept.append(block.select(plain.column_names).filter(pa.array(wanted)))
    return pa.concat_tables(kept).combine_chunks()


def _linked(table: pa.Table) -> pa.Table:
    """Links between the roots of each block: candidates that are near copies and not joined yet."""
    found: list[tuple[int, int]] = []
    for block in _blocks(table):
        node, root = (block.column(c).to_pylist() for c in ("node", "root"))
        texts = block.column("text")
        sets = {}
        above = {r: r for r in root}

        def top(of: int) -> int:
            while above[of] != of:
                above[of] = of = above[above[of]]
            return of

        pairs = [
            np.stack((np.full(len(met), one), met, agree))
            for one, met, agree in _candidates(block)
        ]
        pairs = np.concatenate([np.empty((3, 0), np.int64), *pairs], axis=1)
        for one, two in pairs[:2, np.argsort(-pairs[2], kind="stable")].T.tolist():
            a, b = top(root[one]), top(root[two])
            if a == b:
                continue
            for row in (one, two):
                if row not in sets:
                    sets[row] = shingles(texts[row].as_py())
            if _near(sets[one], sets[two]):
                above[a] = b
                found.append((node[one], node[two]))
    return pa.table(
        {
            "a": pa.array([min(pair) for pair in found], pa.int64()),
            "b": pa.array([max(pair) for pair in found], pa.int64()),
        }
    )


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies: that with the smallest id, a null id
    last, and of several texts under that id the one with the smallest hash."""
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")
    first = groups(docs, key, text).groupBy("root").agg(F.min(order).alias("first"))
    kept = first.select(F.col("first.id").alias("_id"), F.col("first.text_hash").alias("_hash"))
    rows = docs.withColumn("_text_hash", F.xxhash64(text))
    same = rows[key].eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash"))
    rows = rows.join(kept, same, "left_semi")
    return rows.dropDuplicates([key, "_text_hash"]).select(docs.columns)
