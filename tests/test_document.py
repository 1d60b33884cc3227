import datetime
import json

from tallyforge.operators import close, document
from tallyforge.operators.leg_a import BREAKDOWN, CANDIDATE
from tallyforge.sources import files

DAY = datetime.date(2025, 6, 10)


def test_a_world_is_one_document(spark):
    world = spark.createDataFrame([(0,), (1,)], "world_id long")
    bank = spark.createDataFrame([(0, 0, "t1", DAY, 500, 0), (0, 1, "t2", DAY + datetime.timedelta(2), 0, 120)], "world_id long, row_no long, txn_id string, value_date date, credit_paise long, debit_paise long")
    a = spark.createDataFrame([(0, "match", "matched", ["s1"], ["t1"], "exact", 500, "p1"), (0, "exception", "ambiguous_abstain", ["s2"], [], "", None, "p2"), (0, "exception", "duplicate_credit", [], ["t9"], "", 7, "p1")], "world_id long, kind string, status string, settlement_ids array<string>, bank_txn_ids array<string>, confidence string, received_paise long, pass_name string")
    a = a.selectExpr("*", f"CAST(array() AS {CANDIDATE}) AS candidates", f"CAST(array() AS {BREAKDOWN}) AS discrepancy_breakdown")
    b = spark.createDataFrame([(0, "order", "o1", "order_paid"), (0, "payment", "p1", "payment_applied")], "world_id long, record_type string, record_id string, status string")
    j = spark.createDataFrame([(0, "o1", ""), (0, "o2", "unpaid")], "world_id long, order_id string, first_break string")
    fields = [("i1", "recon_leg_a", "x", 2, 5, ["s2"], "t \"q\"\n", "", "", [], [], None, None), ("i2", "recon_leg_a", "y", 1, 9, ["t9"], "é", "", "", [], [], DAY, 3), ("i3", "recon_leg_b", "y", 1, 90, ["o1"], "z", "", "", [], [], None, None)]
    schema = "world_id long, item_id string, source string, status string, severity int, money_at_risk_paise long, record_ids array<string>, title string, detail string, suggested_action string, evidence array<string>, candidates array<string>, due_date date, days_overdue int"
    queue = spark.createDataFrame([(0, *f) for f in fields], schema)
    faults = spark.createDataFrame([(0, "code", f"r{k:02}") for k in range(12)], "world_id long, code string, record string")
    docs = {r.world_id: json.loads(r.document) for r in document.documents(world, bank, a, b, j, queue, faults).collect()}
    d = docs[0]
    assert [i["item_id"] for i in d["queue"]] == ["i3", "i2", "i1"] and d["queue"][2]["title"] == 't "q"\n'
    assert d["close_date"] == "2025-06-12" and d["cash"]["movement_paise"] == 380 and d["counts"] == {"queue_total": 3, "by_severity": {"S1": 2, "S2": 1, "S3": 0}, "by_source": {"recon_leg_a": 2, "recon_leg_b": 1}}
    assert d["verify_panel"]["leg_a"] == 12 and [s["record"] for s in d["verify_panel"]["samples"]] == [f"r{k:02}" for k in range(10)]
    assert [x["status"] for x in d["decisions_a"]] == ["duplicate_credit", "matched", "ambiguous_abstain"] and len(d["decisions_b"]) == 2
    assert d["leg_b_summary"] == {"by_status": {"order_paid": 1, "payment_applied": 1}, "journeys_total": 2, "journeys_intact": 1, "first_breaks": {"unpaid": 1}}
    assert docs[1] == {"world_id": 1, "verify_panel": {"leg_a": 0, "samples": []}}  # a world without rows
    shown = [(r.place, r.status) for r in document.display_order(a).orderBy("place").collect()]
    assert shown == [(1, "ambiguous_abstain"), (2, "duplicate_credit")]
    assert close.counted(document.read(document.documents(world, bank, a, b, j, queue, faults)), "close_date").count() == 2


def test_log_that_is_not_there_is_empty(spark, tmp_path):
    schema = "item_id string, seq long, action string"
    assert files.read_actions(spark, f"{tmp_path}/log", schema).collect() == []
    files.append_actions(spark.createDataFrame([("a", 1, "note")], schema), f"{tmp_path}/log")
    assert [tuple(r) for r in files.read_actions(spark, f"{tmp_path}/log", schema).collect()] == [("a", 1, "note")]


def test_documents_are_dealt_to_tasks_of_few_worlds(spark):
    """No part of a document is broadcast, and tasks grow with the worlds."""
    n = 20 * document.WORLDS
    world = spark.range(n).selectExpr("id AS world_id")
    bank = world.selectExpr("world_id", "world_id AS row_no", "'t' AS txn_id", "DATE '2025-06-10' AS value_date", "5L AS credit_paise", "0L AS debit_paise")
    a = world.selectExpr("world_id", "'match' AS kind", "'matched' AS status", "array('s') AS settlement_ids", "array('t') AS bank_txn_ids", "'exact' AS confidence", "5L AS received_paise", "'p1' AS pass_name")
    b = world.selectExpr("world_id", "'order' AS record_type", "'o' AS record_id", "'order_paid' AS status")
    j = world.selectExpr("world_id", "'o' AS order_id", "'' AS first_break")
    fields = {"severity": "1", "money_at_risk_paise": "5L", "record_ids": "array('s')", "days_overdue": "1"}
    queue = world.selectExpr("world_id", *(f"{fields.get(c, repr('x'))} AS {c}" for c in document.ITEM))
    faults = world.selectExpr("world_id", "'code' AS code", "'r' AS record")
    docs = document.documents(world, bank, a, b, j, queue, faults)
    assert "Broadcast" not in docs._jdf.queryExecution().executedPlan().toString()
    assert docs.rdd.getNumPartitions() > n // document.WORLDS and docs.count() == n
