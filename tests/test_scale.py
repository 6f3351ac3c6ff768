"""Where costly work is dealt out, and that cheaper forms say the same as the plain ones."""

import random
import re

from pyspark.sql import functions as F

from freightaudit.bindings import views
from freightaudit.functions import labels as L
from freightaudit.functions import text as T
from freightaudit.operators import extract, features, labels, rules


def test_derived_texts_are_dealt_to_many_tasks(spark):
    for name in ("v_doc_text", "v_mail"):
        rows = views.view(spark, "/root/testdata/sf0.001", name)
        tasks = rows.select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks >= views.spread_tasks(spark) / 2
    assert "REPARTITION" not in views.with_views("SELECT * FROM v_mail", "checker")


def test_in_place_decisions_equal_scores_on_random_words(spark):
    rng = random.Random(3)
    words = sorted({w for a in L.ALIASES for w in a.words}) + ["net", "x", "b", "l", "hs", "2"]
    keys = {" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(400)}
    rows = spark.createDataFrame([(k,) for k in sorted(keys)], "label_key STRING")
    both = labels.with_accepted_label(
        labels.decide_keys(rows).withColumnRenamed("label_key", "key"), {"key": "found"}
    ).collect()
    assert any(r["found"] for r in both) and not all(r["found"] for r in both)
    for r in both:
        decision = r["decision"]
        expected = (decision["field"], decision["best_score"]) if decision["accepted"] else None
        assert (tuple(r["found"]) if r["found"] else None) == expected, r["key"]
        assert L._accepted(r["key"]) == (expected or (None, None))


def test_lines_without_folding_and_odd_breaks(spark):
    texts = ["", "\n", "a\r\nb", "a\n\n", "a\x1cb c\x85d\x7f", "é\rß", None]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path STRING, text STRING")
    lines = extract.document_lines(docs, folded=False)
    assert "folded" not in lines.columns
    got = {}
    for r in lines.orderBy("line_no").collect():
        got.setdefault(r["path"], []).append(r["raw"])
    for i, text in enumerate(texts):
        assert got[str(i)] == ((text or "").splitlines() or [None])


def test_fold_looks_beyond_ascii(spark):
    texts = ["Plain", "É", "Straße", "ﬁne", "xＡ", "K", "Ωmega"]
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = rows.select(T.fold_text(F.col("t")), F.col("t").rlike(T._FOLD_NEEDS_TABLES)).collect()
    assert [r[0] for r in got] == ["plain", "é", "strasse", "fine", "xa", "k", "ωmega"]
    old = re.sub(r"^\(\?=[^)]*\)", "", T._FOLD_NEEDS_TABLES)
    assert old != T._FOLD_NEEDS_TABLES
    assert [r[1] for r in got] == [bool(re.search(old, t)) for t in texts]


def test_phrases_are_looked_up_in_texts_made_once(spark):
    mails = spark.createDataFrame(
        [("a", "Draft BL", "please send the SI"), ("b", None, None)],
        "email_id STRING, subject STRING, body STRING",
    )
    found = rules.matched_phrases(mails)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[a-z0-9]+") <= 2
    assert {r["email_id"] for r in found.collect()} <= {"a"}


def test_texts_are_shuffled_once_for_their_terms(spark):
    texts = spark.createDataFrame(
        [(1, "b", "aa bb aa"), (1, "b", "AA"), (2, "b", ""), (None, "b", "aa")],
        "email_id LONG, block STRING, text STRING",
    )
    for terms in (features.word_terms(texts), features.char_wb_terms(texts)):
        plan = terms._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
    found = {(r["email_id"], r["term"]): r["tf"] for r in features.word_terms(texts).collect()}
    assert found == {(1, "aa"): 3, (1, "bb"): 1, (1, "aa bb"): 1, (1, "bb aa"): 1, (None, "aa"): 1}
    weighed = features.tfidf(
        features.word_terms(texts), features.vocabulary(features.word_terms(texts), texts)
    )
    assert {(r["block"], r["term"]) for r in weighed.collect()} == {("b", t) for _, t in found}


def test_field_facts_run_as_compiled_code(spark):
    """The JVM never compiles a method beyond 8000 bytes; a label is read once, not in filters too."""
    docs = spark.createDataFrame([("a", "Shipper: Mill\n", None)], "path string, text string, error string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        facts = extract.document_facts(docs)
        plan = facts._jdf.queryExecution()
        stages = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(plan.executedPlan())
        sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
        calls = plan.executedPlan().toString().count("read_label(label1")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert 0 < max(sizes) < 8000
    assert calls == 1
    assert facts.select("shipper.normalised").collect() == [("mill",)]


def test_lines_do_not_carry_their_document(spark):
    docs = spark.createDataFrame(
        [("a", "x\r\n"), ("b", "\n"), ("c", ""), ("d", None), ("e", "x\n\ry"), ("f", "x\n\r")],
        "path string, text string",
    )
    got = extract.document_lines(docs, folded=False).collect()
    assert sorted(got, key=str) == [
        ("a", 1, "x"), ("b", 1, ""), ("c", None, None), ("d", None, None),
        ("e", 1, "x"), ("e", 2, ""), ("e", 3, "y"), ("f", 1, "x"), ("f", 2, ""),
    ]


def test_lines_pass_through_python_twice(spark):
    """Labels are read and decided in one pass; known starts are named and values folded in another."""
    docs = spark.createDataFrame(
        [("a", "Shipper: Mill\nVessel: x\nTotal Gross Weight 007.50 MT\nPOD PORT É\n", None)],
        "path string, text string, error string",
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        facts = extract.document_facts(docs)
        plan = facts._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("ArrowEvalPython") == 2
    got = facts.select(
        "shipper.normalised", "gross_weight_kg.normalised", "gross_weight_kg.raw_label",
        "port_of_discharge.normalised", "notify_party",
    ).collect()
    assert [tuple(r) for r in got] == [("mill", "7500", "GROSS WEIGHT", "port", None)]
