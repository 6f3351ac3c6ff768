"""The whole audit on a handful of mails, skewed joins, review, folds and the stream."""

import collections

from pyspark.sql import functions as F

from freightaudit.operators import evaluate, features, joins, model, review, rules
from freightaudit.plans import audit
from freightaudit.schemas import MAIL
from freightaudit.sources import attachments, inbox, office, sinks

GOOD = "Shipper: A\nConsignee: B\nNotify Party: C\nPOL: D\nPOD: E\nTotal Containers: 2\nGross Weight (KG): 9"


def mail(email_id, attached=(), subject="Confirm docs", body="attached are the si and draft bl"):
    return (email_id, "x@y.example", subject, body, list(attached))


def test_every_outcome(spark):
    both = lambda n: [f"{n}_SI.txt", f"{n}_BL.txt"]
    rows = [
        mail("ok", both("ok")),
        mail("diff", both("diff")),
        mail("blank", both("blank")),
        mail("lost", both("lost")),
        mail("type", both("type")),
        mail("other", ["a_SI.txt", "b.txt"]),
        mail("one", ["one_SI.txt"]),
        mail("none"),
        mail("dropped", body="Please check, attachments dropped. confirm docs"),
        mail("spam", subject="You have won", body="claim your prize"),
        mail("empty", subject=None, body=None),
    ]
    texts = {"ok_SI": GOOD, "ok_BL": GOOD, "diff_SI": GOOD, "diff_BL": GOOD.replace("Consignee: B", "Consignee: X"),
             "blank_SI": GOOD.replace("POL: D", "POL: TBA"), "blank_BL": GOOD.replace("POD: E", "POD: Q"),
             "lost_SI": GOOD, "type_SI": GOOD, "type_BL": "COMMERCIAL INVOICE\n" + GOOD}
    docs = attachments.with_read_status(
        spark.createDataFrame([(f"{k}.txt", v) for k, v in texts.items()], "path STRING, text STRING")
    )
    got = {r["email_id"]: r for r in audit.audit_mails(spark.createDataFrame(rows, MAIL), docs).collect()}
    outcome = {k: (r["category"], r["status"], r["review_reason"]) for k, r in got.items()}
    bl = "BL_COMPARISON"
    assert outcome == {
        "ok": (bl, "OK", None),
        "diff": (bl, "MISMATCH", None),
        "blank": (bl, "NEEDS_REVIEW", "missing_value"),
        "lost": (bl, "NEEDS_REVIEW", "unreadable"),
        "type": (bl, "NEEDS_REVIEW", "wrong_doc_type"),
        "other": (bl, "NEEDS_REVIEW", "missing_attachment"),
        "one": (bl, "NEEDS_REVIEW", "missing_attachment"),
        "none": (bl, "OK", None),
        "dropped": (bl, "NEEDS_REVIEW", "missing_attachment"),
        "spam": ("SPAM", "OK", None),
        "empty": ("GENERAL", "OK", None),
    }
    assert got["diff"]["defect_fields"] == ["consignee"] and got["diff"]["has_defect"]


def test_spread_join_equals_plain_join(spark):
    left = spark.range(5000).select(
        "id", F.expr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('k', id % 50) END").alias("key")
    )
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 50, 2)], "key STRING, v INT")
    hot = joins.hot_keys(left, "key", min_rows=1000)
    assert [r["key"] for r in hot.collect()] == ["hot"]
    spread = joins.spread_left_join(left, right, "key", ["id"], hot)
    plain = left.join(right, "key", "left")
    assert spread.select("id", "key", "v").exceptAll(plain.select("id", "key", "v")).isEmpty()
    assert spread.count() == 5000


def test_ambiguous_and_tie_order(spark):
    rows = spark.createDataFrame([mail("t", subject="si draft bl", body="")], MAIL)
    row = rules.classify_by_rules(rows).head()
    assert row["keyword_category"] == "SI_REQUEST" and row["ambiguous"] and row["score_margin"] == 0


def test_overrides(spark):
    actions = spark.createDataFrame(
        [("a", "approve", "", 1), ("a", "escalate", None, 2), ("b", "approve", "seen", 1)],
        "email_id STRING, action STRING, notes STRING, ts INT",
    )
    last = {r["email_id"]: (r["status"], r["notes"]) for r in review.latest_override(review.override_log(actions)).collect()}
    assert last == {"a": ("NEEDS_REVIEW", "Escalated externally to forwarder"), "b": ("OK", "seen")}


def test_empty_scores(spark):
    none = spark.createDataFrame([], "email_id STRING, category STRING, status STRING, review_reason STRING, has_defect BOOLEAN, defect_fields ARRAY<STRING>")
    row = evaluate.final_score(evaluate.join_truth_outer(none, none)).head()
    assert row["final_score"] == 0.0 and row["rule_share"] is None


def test_folds_are_even(spark):
    rows = spark.range(3000).select(F.col("id").alias("email_id"), F.when(F.col("id") % 10 == 0, "x").otherwise("y").alias("label"))
    folds = features.stratified_folds(rows, "label", 5).groupBy("label", "fold").count().collect()
    assert {(r["label"], r["count"]) for r in folds} == {("x", 60), ("y", 540)}


def test_term_index_is_dense(spark):
    vocab = spark.range(2000).select(F.lit("b").alias("block"), F.col("id").cast("string").alias("term"))
    assert sorted(r["idx"] for r in features.with_term_index(vocab).collect()) == list(range(2000))


def test_char_grams(spark):
    rows = spark.createDataFrame([("a",), ("ab",), ("abcd",)], "w STRING")
    got = [r[0] for r in rows.select(features.char_grams(F.col("w"))).collect()]
    assert got[0] == [" a "]
    assert got[1] == [" ab", "ab ", " ab "]
    assert collections.Counter(len(g) for g in got[2]) == {3: 4, 4: 3, 5: 2}


def test_model_learns_and_survives_storage(spark):
    rows, labels = [], []
    for i in range(40):
        kind = "SPAM" if i % 2 else "GENERAL"
        rows.append(mail(f"m{i}", subject="win gold" if i % 2 else "berth plan", body=f"text {i}"))
        labels.append((f"m{i}", kind))
    mails = spark.createDataFrame(rows, MAIL)
    fitted = model.fit_classifier(mails, spark.createDataFrame(labels, "email_id STRING, label STRING"), {})
    folder = sinks.shared_folder(spark)
    model.save_model(fitted, folder)
    predicted = model.predict_proba(model.load_model(spark, folder), mails)
    assert {r["email_id"]: r["category"] for r in predicted.collect()} == dict(labels)


def test_inbox_files_and_quarantine(spark, tmp_path):
    (tmp_path / "email_1.json").write_text('{"id": "e1", "subject": "s",\n "attachments": ["a_SI.txt"]}')
    (tmp_path / "email_2.json").write_text('{"subject": "no id", "attachments": {"si": "x"}}')
    raw = inbox.scan_inbox(spark, str(tmp_path / "email_*.json"))
    good, bad = inbox.resolve_email_id(raw)
    assert good.count() == 1 and bad.count() == 1
    assert inbox.mails_from_raw(raw).head()["attachments"] == ["a_SI.txt"]


def test_broken_workbook_is_an_error_row(spark):
    files = spark.createDataFrame([("a.xlsx", bytearray(b"no zip"))], "path STRING, content BINARY")
    row = office.office_documents(office.office_cells(files)).head()
    assert row["path"] == "a.xlsx" and "BadZipFile" in row["error"]
