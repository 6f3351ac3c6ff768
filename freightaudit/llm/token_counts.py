"""Token counts from flat, unindexed token files by a scan for separators.

A token file is a plain run of little-endian token ids in which every document ends with the
end-of-document id.  Files are cut into blocks that are read and searched on their own, one
vectorised comparison each; a prefix scan over the blocks of a file (the last separator before a
block, and how many came before) then tells where the document that crosses a boundary began and
which number every document has.

Defined results: an empty document has no tokens; what follows the last separator of a file counts
as a document that is not terminated; null texts are empty; an empty file or table gives no rows;
repeated rows and null ids are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from freightaudit.llm.files import new_file, open_file
from freightaudit.sources.sinks import shared_folder, stored

#: Tokens in a file after which a new one is begun, and in a block.
FILE_TOKENS = 16_000_000
BLOCK_TOKENS = 2_000_000


def token_type(end_id: int) -> str:
    return "<u2" if end_id < 2**16 else "<u4"


def write_token_files(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, end_id: int, key: str = "doc_id",
    text: str = "text", file_tokens: int = FILE_TOKENS,
) -> DataFrame:
    """Token files in the shared folder.  Returns, per piece written, (file, tokens, first,
    docs): the size of the piece, the number of its first document in the file, and the ids of
    its documents in order; it says nothing about where a document begins."""
    spark = docs.sparkSession
    id_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(
        F.col(key).alias("key"),
        F.make_valid_utf8(F.coalesce(F.col(text), F.lit(""))).alias("text"),
    )
    folder, known = shared_folder(spark), spark.sparkContext.broadcast(ranks)
    kind = token_type(end_id)

    def run(batches):
        encoder = tiktoken.Encoding(
            "files", pat_str=pattern, mergeable_ranks=known.value, special_tokens={}
        )
        return _written(batches, encoder, end_id, kind, folder, file_tokens)

    schema = f"file string, tokens long, first long, docs array<{id_type}>"
    return stored(rows.mapInArrow(run, schema))


def _written(batches: Iterator[pa.RecordBatch], encoder, end_id, kind, folder, file_tokens):
    batch = next(batches, None)
    while batch is not None:
        first = total = 0
        with new_file(folder, ".tokens") as (uri, out):
            while batch is not None and total < file_tokens:
                size = 0
                for value in batch.column("text").to_pylist():
                    ids = encoder.encode_ordinary(value)
                    ids.append(end_id)
                    out.write(np.array(ids, kind).tobytes())
                    size += len(ids)
                keys = pa.array([batch.column("key").to_pylist()], pa.list_(batch.column("key").type))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uri]), pa.array([size]), pa.array([first]), keys],
                    ["file", "tokens", "first", "docs"],
                )
                first, total = first + batch.num_rows, total + size
                batch = next(batches, None)


def count_tokens(files: DataFrame, end_id: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, start, n_tokens, terminated) of every document in ``files`` (file, tokens):
    its number in the file, its first token, and its size without the separator."""
    kind = token_type(end_id)
    blocks = files.where("tokens > 0").select(
        "file", "tokens",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("tokens") - 1, F.lit(block_tokens))).alias("at"),
    )
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        return _separators(batches, end_id, kind, block_tokens)

    found = stored(
        blocks.repartition(parts, "file", "at").mapInArrow(
            run,
            "file string, tokens long, at long, n long, last long, ends array<long>, sizes array<long>",
        )
    )
    ahead = (
        Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    )  # over a file's blocks
    stitched = found.select(
        "*",
        F.coalesce(F.max("last").over(ahead), F.lit(-1)).alias("before"),
        F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"),
    )
    documents = stitched.select(
        "file", "base", "before", F.posexplode(F.arrays_zip("ends", "sizes")).alias("pos", "d")
    ).select(
        "file",
        (F.col("base") + F.col("pos")).alias("ordinal"),
        F.when(F.col("pos") == 0, F.col("before") + 1)
        .otherwise(F.col("d.ends") - F.col("d.sizes"))
        .alias("start"),
        F.when(F.col("pos") == 0, F.col("d.ends") - F.col("before") - 1)
        .otherwise(F.col("d.sizes"))
        .alias("n_tokens"),
        F.lit(True).alias("terminated"),
    )
    ends = found.groupBy("file").agg(
        F.max("tokens").alias("tokens"),
        F.coalesce(F.max("last"), F.lit(-1)).alias("last"),
        F.sum("n").alias("ordinal"),
    )
    open_ended = ends.where("last < tokens - 1").select(
        "file", "ordinal", (F.col("last") + 1).alias("start"),
        (F.col("tokens") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("terminated"),
    )
    return documents.union(open_ended)


def _separators(batches: Iterator[pa.RecordBatch], end_id: int, kind: str, block_tokens: int):
    """The separators of each block: how many, the last, all, and the sizes between them."""
    width = np.dtype(kind).itemsize
    for batch in batches:
        for row in batch.to_pylist():
            with open_file(row["file"]) as source:
                wanted = min(block_tokens, row["tokens"] - row["at"])
                data = source.read_at(wanted * width, row["at"] * width)
            ends = np.flatnonzero(np.frombuffer(data, kind) == end_id) + row["at"]
            sizes = np.diff(ends, prepend=ends[:1]) - 1
            last = int(ends[-1]) if len(ends) else None
            long = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["file"]]), pa.array([row["tokens"]], long),
                    pa.array([row["at"]], long), pa.array([len(ends)], long),
                    pa.array([last], long), pa.array([ends], pa.list_(long)),
                    pa.array([sizes], pa.list_(long)),
                ],
                ["file", "tokens", "at", "n", "last", "ends", "sizes"],
            )


def document_token_counts(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, end_id: int, key: str = "doc_id"
) -> DataFrame:
    """(``key``, n_tokens): ``docs`` written to token files, and the files counted."""
    pieces = write_token_files(docs, ranks, pattern, end_id, key)
    files = pieces.groupBy("file").agg(F.sum("tokens").alias("tokens"))
    # files have unique names of 32 hex digits, which make a shorter key than their whole path
    name = F.unhex(F.regexp_extract("file", "([0-9a-f]{32})[^/]*$", 1)).alias("name")
    order = pieces.select(name, "first", F.posexplode("docs").alias("pos", "key")).select(
        "name", (F.col("first") + F.col("pos")).alias("ordinal"), F.col("key").alias(key)
    )
    counts = count_tokens(files, end_id).select(name, "ordinal", "n_tokens")
    return order.join(counts, ["name", "ordinal"]).select(key, "n_tokens")
