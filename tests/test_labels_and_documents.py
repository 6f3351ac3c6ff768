"""Label decisions and extraction on small documents with quirks."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from freightaudit import dims
from freightaudit.functions import labels as L
from freightaudit.functions.pyudf import char_similarity
from freightaudit.operators import extract, labels


def test_similarity_against_a_loop(spark):
    pairs = [("netweight", "grossweight"), ("abcd", "bcde"), ("", "a"), ("port", "port")]
    rows = spark.createDataFrame(pairs, "a STRING, b STRING")
    got = [r[0] for r in rows.select(char_similarity("a", "b")).collect()]
    assert got == [
        round(SequenceMatcher(None, a, b).ratio() * 10, 2) if a and b else 0.0 for a, b in pairs
    ]


def test_every_alias_is_accepted_for_its_field(spark):
    rows = spark.createDataFrame([(a.alias, a.field) for a in L.ALIASES], "label STRING, field STRING")
    decided = labels.classify_labels(rows)
    got = {r["label_key"]: r["decision"] for r in decided.collect()}
    for alias in L.ALIASES:
        assert got[alias.key]["field"] == alias.field
        assert got[alias.key]["best_score"] == 100.0


LABELS = [
    "PD", "P.O.D.", "Ship", "Shipper Name", "the Shipper", "Gross Weight in KG", "NET WEIGHT",
    "Commodity Code", "Place of Delivery", "Notify Party 2", "Total Gross Wt", "", "B/L No.",
    "Port of Loading Terminal", "Number Containers", "Also Notify Party", "Load Port POL",
]


def test_pruned_decisions_equal_full_decisions(spark):
    rows = spark.createDataFrame([(x,) for x in LABELS], "label STRING")
    keys = labels.distinct_label_keys(rows)
    full = {r["label_key"]: r["decision"] for r in labels.decide_keys(keys).collect()}
    quick = labels.with_accepted_label(keys, {"label_key": "found"}).collect()
    for row in quick:
        decision, found = full[row["label_key"]], row["found"]
        if decision["accepted"]:
            assert (found["field"], found["score"]) == (decision["field"], decision["best_score"])
        else:
            assert found is None
    assert full["pd"]["field"] == "port_of_discharge"
    assert full["net weight"]["field"] is None


def facts_of(spark, texts, pairs=None):
    docs = spark.createDataFrame([(p, t, None) for p, t in texts], "path STRING, text STRING, error STRING")
    rows = extract.document_facts(docs, pairs).collect()
    return {r["path"]: r for r in rows}


def test_candidates_resolve(spark):
    text = "\n".join(
        [
            "BILL OF LADING",
            "Shipper: TBA",
            "Shipper: Blue Sea Ltd",
            "Shipper/Exporter: Later Ltd",
            "Consignee (Non-Negotiable) Red Co",
            "PD: NATION 4",
            "TOTAL Gross Wt (kgs): 5 MT",
            "No. of Containers: 6x40'HC",
            "Vessel: X",
        ]
    )
    row = facts_of(spark, [("a", text), ("b", None), ("c", "")])
    a = row["a"]
    assert a["shipper"]["raw_value"] == "Blue Sea Ltd" and a["shipper"]["source"] == "line 3"
    assert a["consignee"]["normalised"] == "redco"
    assert a["port_of_discharge"]["normalised"] == "nation4"
    assert a["gross_weight_kg"]["normalised"] == "5000"
    assert a["container_count"]["normalised"] is None
    assert a["notify_party"] is None
    assert all(row["b"][f] is None for f in dims.FIELDS) and row["c"]["wrong_type"] is False


def test_table_pairs_win_on_equal_score(spark):
    pairs = spark.createDataFrame(
        [("a", 0, "Shipper", "Cell Ltd"), ("a", 1, "Vessel", "V")],
        "path STRING, seq LONG, label STRING, value STRING",
    )
    row = facts_of(spark, [("a", "Shipper: Line Ltd")], pairs)["a"]
    assert row["shipper"]["raw_value"] == "Cell Ltd" and row["shipper"]["source"] == "table"
    uncertain = extract.uncertain_labels(pairs).collect()
    assert [u["label"] for u in uncertain] == ["Vessel"]


@pytest.mark.parametrize(
    "text,wrong",
    [("PACKING LIST\nx", True), ("needs a Certiﬁcate of Origin", True), ("Packing\nlist", False)],
)
def test_wrong_document(spark, text, wrong):
    assert facts_of(spark, [("a", text)])["a"]["wrong_type"] is wrong


def test_roles_and_paths(spark):
    from freightaudit.operators.joins import find_si_bl_paths

    rows = spark.createDataFrame([(["x/a_si.pdf", "x/b_SI.txt", "c_BL"],), ([],), (None,)], "a ARRAY<STRING>")
    got = [tuple(r["p"]) for r in rows.select(find_si_bl_paths(F.col("a")).alias("p")).collect()]
    assert got == [("x/a_si.pdf", None), (None, None), (None, None)]
