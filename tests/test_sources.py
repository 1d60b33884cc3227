import hashlib
import hmac
import json

import pytest

from tallyforge.sources import files, ingest
from tallyforge.streaming import inbox


def test_csv_tables(spark, tmp_path):
    (tmp_path / "settlements.csv").write_text("settlement_id,amount_paise,fees_paise,tax_paise,utr,payment_count,status,created_at,settled_at\nsetl_1,1000,20,4,UTIB1,2,processed,2025-04-02T01:15:00,2025-04-03\n")
    (tmp_path / "bank.csv").write_text('txn_id,txn_date,value_date,narration,ref_no,debit_amount,credit_amount,balance\nB1,03/04/2025,04/04/2025,"A, ""B""",R,,"1,52,340.50","2,00,000.00"\nB2,05/04/2025,05/04/2025,C,,10,,199990\n')
    s = files.settlements(spark, f"{tmp_path}/settlements.csv").first()
    assert (s.amount_paise, str(s.created), str(s.settled), s.row_no) == (1000, "2025-04-02", "2025-04-03", 0)
    b = files.bank_rows(spark, f"{tmp_path}/bank.csv").orderBy("row_no").collect()
    assert [(r.credit_paise, r.debit_paise, r.balance_paise, str(r.value_date), r.narration) for r in b] == [(15234050, 0, 20000000, "2025-04-04", 'A, "B"'), (0, 1000, 19999000, "2025-04-05", "C")]
    assert files.optional(spark, f"{tmp_path}/absent.csv", "settlement_merchants").collect() == []


def test_upsert_and_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, 0), ("b", 2, 1)], "id string, v int, row_no long")
    new = spark.createDataFrame([("b", 3, 0), ("c", 4, 1), ("c", 5, 2)], "id string, v int, seq long")
    merged = files.upsert(old, new, "id")
    assert [(r.id, r.v) for r in merged.orderBy("row_no").collect()] == [("a", 1), ("b", 3), ("c", 5)]
    assert files.digest(merged) == files.digest(merged.repartition(3)) != files.digest(old)
    log = spark.createDataFrame([("x", 1, "resolve")], "item_id string, seq long, action string")
    files.append_actions(log, f"{tmp_path}/log")
    files.append_actions(log, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2
    with pytest.raises(Exception, match="unknown action"):
        files.append_actions(log.selectExpr("item_id", "seq", "'shout' AS action"), f"{tmp_path}/log")
    for value in (1, 2):
        snap = spark.createDataFrame([(0, "2025-06-10", "i", value)], "world_id long, close_date string, item_id string, money long")
        files.write_snapshot(snap, f"{tmp_path}/snap")
    assert [r.money for r in spark.read.parquet(f"{tmp_path}/snap").collect()] == [2]


def test_feeds(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"entity": "collection", "count": 2, "items": [{"id": "setl_1", "entity": "settlement", "amount": 900, "status": "processed", "fees": 5, "tax": 1, "utr": "u1", "created_at": 1743556500}, {"id": "setl_2", "entity": "settlement", "amount": 1, "utr": "u2", "created_at": 0}]}))
    (tmp_path / "r.csv").write_text(",".join(ingest.REPORT) + "\npay_1,payment,0,1,500,INR,5,1,0,1,1743500000,1743600000,setl_1,,,,order_1,upi\nrfnd_1,refund,1,0,50,INR,0,0,0,1,1743500000,1743600000,setl_1,,,,,\npay_2,payment,0,1,400,INR,,,0,1,1743500000,1743700000,setl_1,,,,,card\n")
    report = ingest.report(spark, f"{tmp_path}/r.csv")
    s = {r.settlement_id: r for r in ingest.settlements(ingest.collection(spark, f"{tmp_path}/s.json", ingest.SETTLEMENT), report).collect()}
    assert (s["setl_1"].payment_count, s["setl_1"].settled_at, s["setl_1"].created_at) == (2, "2025-04-02", "2025-04-02T01:15:00")
    assert (s["setl_2"].payment_count, s["setl_2"].settled_at) == (0, "1970-01-01")
    p = {r.payment_id: r for r in ingest.payments_from_report(report).collect()}
    assert set(p) == {"pay_1", "pay_2"} and p["pay_2"].fee_paise == 0 and p["pay_2"].order_id == ""
    (tmp_path / "o.json").write_text(json.dumps({"items": [{"id": "order_1", "entity": "order", "amount": 5, "status": "attempted", "created_at": 0}, {"id": "order_2", "entity": "order", "amount": 5, "status": "paid", "receipt": "r", "created_at": 0}, {"id": "x", "entity": "payment", "amount": 1, "created_at": 0}]}))
    o = {r.order_id: (r.status, r.receipt) for r in ingest.orders(ingest.collection(spark, f"{tmp_path}/o.json", ingest.ORDER)).collect()}
    assert o == {"order_1": ("created", ""), "order_2": ("paid", "r")}


SECRET = "whsec"


def deliver(folder, name, payload, secret=SECRET, sign=True):
    body = json.dumps(payload).encode()
    if sign:
        (folder / f"{name}.json.sig").write_text(hmac.new(secret.encode(), body, hashlib.sha256).hexdigest())
    (folder / f"{name}.json").write_bytes(body)


def event(kind, amount):
    entity = {"id": f"{kind}_1", "entity": kind, "amount": amount, "status": "captured" if kind == "payment" else "paid", "created_at": 0}
    return {"entity": "event", "event": f"{kind}.x", "payload": {kind: {"entity": entity}}, "created_at": 0}


def files_of(spark, folder):
    return spark.read.format("binaryFile").load(str(folder))


def test_inbox_batch(spark, tmp_path):
    deliver(tmp_path, "001", event("payment", 100))
    deliver(tmp_path, "002", event("order", 100))
    deliver(tmp_path, "003", event("payment", 120))  # redelivered with a change
    deliver(tmp_path, "004", event("order", 5), sign=False)
    payments, orders, counts = inbox.consume(files_of(spark, tmp_path), SECRET)
    assert [(r.payment_id, r.amount_paise) for r in payments.collect()] == [("payment_1", 120)] and [r.amount_paise for r in orders.collect()] == [100]
    assert {r.verdict: r["count"] for r in counts.collect()} == {"consumed": 3, "skipped": 1}
    with pytest.raises(ValueError, match="no secret"):
        inbox.consume(files_of(spark, tmp_path), None)
    deliver(tmp_path, "005", event("order", 7), secret="other")
    with pytest.raises(inbox.Forged, match="005"):
        inbox.consume(files_of(spark, tmp_path), SECRET)


def test_inbox_stream(spark, tmp_path):
    folder, seen = tmp_path / "in", {}
    folder.mkdir()

    def write(payments, orders, number):
        for r in payments.collect():
            seen[r.payment_id] = r.amount_paise

    for k, amount in enumerate((100, 130)):
        deliver(folder, f"00{k}", event("payment", amount))
        query = inbox.stream(spark, str(folder), f"{tmp_path}/ckpt", SECRET, write)
        query.awaitTermination()
        assert query.exception() is None and seen == {"payment_1": amount}


def test_stream_of_actions_and_windows(spark, tmp_path):
    spark.createDataFrame([("a", 1, "assign"), ("a", 2, "note"), ("b", 1, "note")], "item_id string, seq long, action string").write.parquet(f"{tmp_path}/a")
    source = spark.readStream.schema("item_id string, seq long, action string").parquet(f"{tmp_path}/a")
    inbox.workflow(source).writeStream.format("memory").queryName("flow").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {r.item_id: (r.last_action, r.n_actions) for r in spark.table("flow").collect()} == {"a": ("assign", 2), "b": ("open", 1)}


def test_a_large_table_is_not_broadcast(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tallyforge.sources import scratch

    monkeypatch.setattr(scratch, "LARGE", 0)
    store = scratch.Store(spark)
    one, two = (store.cut(spark.range(100).withColumn(c, F.col("id") % 7), c) for c in ("a", "b"))
    joined = one.join(two.filter("b < 3").groupBy("id").count(), "id")
    assert joined.count() == sum(n % 7 < 3 for n in range(100))
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().toString()
