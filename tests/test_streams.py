"""Streams that keep a state: waiting mails, and the snapshot of overrides."""

import datetime

import pytest
from pyspark.sql import functions as F

from freightaudit.operators import review
from freightaudit.plans import audit
from freightaudit.schemas import MAIL, RAW_MAIL
from freightaudit.sources import inbox, sinks
from freightaudit.sources.attachments import with_read_status
from freightaudit.streaming import overrides, waiting
from tests.test_audit import GOOD, mail

HOUR = datetime.timedelta(hours=1)
START = datetime.datetime(2030, 1, 1, tzinfo=datetime.timezone.utc)


class Run:
    """Mails and documents dropped into folders, and a query that is started anew for each step."""

    def __init__(self, spark):
        self.spark = spark
        self.mails, self.docs, self.room, self.out, self.check = [sinks.shared_folder(spark) for _ in range(5)]
        for path, schema in ((self.docs, "path STRING, text STRING"),):
            spark.createDataFrame([], schema).write.parquet(path)
        inbox.raw_json(spark.createDataFrame([], MAIL)).write.text(self.mails)

    def step(self, mails=(), docs=(), hours=0):
        if mails:
            rows = self.spark.createDataFrame(list(mails), MAIL)
            inbox.raw_json(rows).write.mode("append").text(self.mails)
        # an empty file is the heartbeat
        rows = self.spark.createDataFrame(list(docs), "path STRING, text STRING")
        rows.write.mode("append").parquet(self.docs)
        room = waiting.WaitingRoom(self.room, 2 * HOUR, lambda: START + hours * HOUR)
        waiting.stream_audit_waiting(
            inbox.mails_from_raw(self.spark.readStream.schema(RAW_MAIL).json(self.mails)),
            with_read_status(self.spark.readStream.schema("path STRING, text STRING").parquet(self.docs)),
            room, self.out, self.check,
        ).awaitTermination()
        return self.decided()

    def decided(self):
        rows = self.spark.read.parquet(self.out).collect()
        return sorted((r.email_id or "", r.status, r.review_reason or "") for r in rows)


def test_mails_wait_for_their_documents(spark):
    run = Run(spark)
    both = lambda n: [f"{n}_SI.txt", f"{n}_BL.txt"]
    mails = [mail(n, both(n)) for n in ("a", "b", "late", "shared")]
    mails[3] = mail("shared", ["a_SI.txt", "b_BL.txt"])
    mails += [mail("none"), mail("one", ["one_SI.txt"]), mail("spam", subject="You have won", body="claim your prize")]
    bad = GOOD.replace("Consignee: B", "Consignee: X")
    at_once = [("none", "OK", ""), ("one", "NEEDS_REVIEW", "missing_attachment"), ("spam", "OK", "")]
    assert run.step(mails) == at_once
    assert run.step(docs=[("a_SI.txt", GOOD), ("late_SI.txt", GOOD)], hours=1) == at_once
    # documents of two batches meet; a mail with one document goes on waiting
    got = run.step(docs=[("a_BL.txt", GOOD), ("b_BL.txt", bad)], hours=1)
    assert got == sorted([*at_once, ("a", "OK", ""), ("shared", "MISMATCH", "")])
    # a mail that comes after its documents is decided in its own batch; repeated ids are rows
    got = run.step([mail("new", both("a")), mail("new", both("a"))], [("b_SI.txt", bad)], hours=1)
    assert got == sorted([*at_once, ("a", "OK", ""), ("shared", "MISMATCH", ""), ("b", "OK", ""), *[("new", "OK", "")] * 2])
    assert run.step(hours=1.5) == got
    assert run.step(hours=2) == sorted([*got, ("late", "NEEDS_REVIEW", "unreadable")])
    # what was decided is what the batch audit makes of the same rows
    docs = with_read_status(spark.read.parquet(run.docs))
    whole = audit.audit_mails(inbox.mails_from_raw(spark.read.schema(RAW_MAIL).json(run.mails)), docs)
    columns = ["email_id", *audit.DECISION_COLUMNS]
    stream = spark.read.parquet(run.out).select(columns)
    assert stream.exceptAll(whole.select(columns)).isEmpty()
    assert stream.count() == whole.count()


def test_a_batch_tried_again_changes_nothing(spark):
    folder, out = sinks.shared_folder(spark), sinks.shared_folder(spark)
    room = waiting.WaitingRoom(folder, HOUR, lambda: START)
    rows = [mail("a", ["a_SI.txt", "a_BL.txt"]), mail("b", ["b_SI.txt", "b_BL.txt"])]
    mails, none = spark.createDataFrame(rows, MAIL), spark.createDataFrame([], MAIL)
    docs = with_read_status(spark.createDataFrame([("a_SI.txt", GOOD), ("a_BL.txt", GOOD)], "path STRING, text STRING"))
    for batch_id, batch in ((0, (mails, docs.limit(0))), (0, (mails, docs.limit(0))), (1, (none, docs)), (1, (none, docs))):
        room.decide_batch(*batch, out, batch_id)
    assert [r.email_id for r in spark.read.parquet(out).collect()] == ["a"]
    room.decide_batch(none, docs.limit(0), out, 2)
    assert [r.email_id for r in spark.read.parquet(f"{folder}/waiting/slot=0").collect()] == ["b"]


@pytest.mark.parametrize("again", [False, True])
def test_overrides_are_folded_batch_by_batch(spark, again):
    schema = "email_id STRING, action STRING, notes STRING, ts INT"
    source, path, check = [sinks.shared_folder(spark) for _ in range(3)]
    spark.createDataFrame([], schema).write.parquet(source)
    batches = [
        [("a", "approve", "", 1), ("b", "escalate", "x", 5), (None, "approve", "n", 1)],
        [("a", "escalate", None, 3), ("b", "approve", "old", 2), ("c", "open", "", 9)],
        [("d", "approve", "d", 1), ("a", "approve", "tie", 3), ("a", "approve", "tie", 3)],
    ]
    kept = None
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        if again:
            log = review.override_log(spark.createDataFrame(rows, schema))
            kept = overrides.snapshot(path, log.schema)
            for _ in range(2):
                overrides.fold_batch(log, kept, number)
        else:
            log = review.override_log(spark.readStream.schema(schema).parquet(source))
            overrides.stream_overrides(log, path, check).awaitTermination()
        whole = review.latest_override(review.override_log(spark.read.parquet(source)))
        got = overrides.current_overrides(spark, path, log.schema)
        assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))


def test_only_touched_buckets_are_written(spark):
    path = sinks.shared_folder(spark)
    log = review.override_log(spark.range(2000).select(
        F.concat(F.lit("m"), "id").alias("email_id"), F.lit("approve").alias("action"), F.lit("").alias("notes"), F.col("id").alias("ts")
    ))
    kept = overrides.snapshot(path, log.schema)
    overrides.fold_batch(log, kept, 0)
    one = log.where("email_id = 'm7'").withColumn("ts", F.lit(10**6).cast("long"))
    overrides.fold_batch(one, kept, 1)
    written = spark.read.parquet(path).groupBy("version").agg(F.countDistinct("bucket").alias("n"))
    assert {r.version: r.n for r in written.collect()} == {0: kept.count, 1: 1}
    assert kept.read(spark).count() == 2000
