"""The last override of every mail, kept up to date from an append-only log.

Each batch reads the new log rows and the buckets of the mails they name, not the log again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from freightaudit.operators.review import latest_override
from freightaudit.sources.snapshots import Buckets


def snapshot(path: str, schema: StructType) -> Buckets:
    """The snapshot at ``path`` of a log of ``schema`` (email_id, status, notes, ts)."""
    order = ["email_id", "status", "notes", "ts"]
    return Buckets(path, StructType([schema[c] for c in order]), "email_id")


def fold_batch(log: DataFrame, kept: Buckets, batch_id: int) -> None:
    """The snapshot after ``batch_id`` whose new rows are ``log``.  Tried again, it gives the same."""
    # one row a mail, combined map-side: a busy mail is one row from here on
    new = latest_override(log).persist()
    try:
        known = kept.read(log.sparkSession, batch_id, kept.touched(new))
        kept.replace(latest_override(known.unionByName(new)), batch_id)
    finally:
        new.unpersist()


def stream_overrides(log: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Folds a stream of ``review.override_log`` rows into the snapshot at ``path``."""
    kept = snapshot(path, log.schema)
    writer = log.writeStream.foreachBatch(
        lambda batch, batch_id: fold_batch(batch, kept, batch_id)
    ).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current_overrides(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What ``review.latest_override`` gives of the whole log so far."""
    return snapshot(path, schema).read(spark)
