"""Queries over files and documents: each world's tables written by the sinks and read back by the sources, the close as one document, workflow
followed as a stream, and lists that people are shown. Each has a DuckDB twin that works from the tables alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import scalars as X
from tallyforge.operators import audit, close, document, grade, verify
from tallyforge.sources import files, ingest
from tallyforge.streaming import workflow


def numbered(df: DataFrame) -> DataFrame:
    """Rows with their place in their file, from 1, in place of row_no."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy("world_id").orderBy("row_no"))).drop("row_no")


def written(r, table: str) -> str:
    """A table of all worlds in the columns of its file, written once."""
    w = r.world
    iso = lambda day: F.date_format(day, "yyyy-MM-dd")
    shown = lambda c: F.when(F.col(c) > 0, X.rupees(F.col(c))).otherwise("")
    made = {
        "settlements": lambda: w.settlements.withColumns({"status": F.lit("processed"), "created_at": F.concat(iso("created"), F.lit("T01:15:00")), "settled_at": iso("settled")}),
        "bank_statement": lambda: verify.running_balance(w.bank_rows).withColumns({"txn_date": F.date_format("value_date", "dd/MM/yyyy"), "debit_amount": shown("debit_paise"), "credit_amount": shown("credit_paise"), "balance": X.rupees(F.col("balance_paise"))}).withColumn("value_date", F.col("txn_date")),
        "payments": lambda: w.payments.withColumns({"method": F.when(F.col("row_no") % 3 == 0, 'card, "saved"').otherwise("upi"), "created_at": X.epoch_text(F.col("created_s"))}),
        "order_book": lambda: w.order_book.withColumn("created_at", X.epoch_text(F.col("row_no") * 60)),
        "golden": lambda: r.golden().withColumns({"row_no": F.substring("record_id", 6, 12).cast("long"), "expected_disposition": F.col("expected"), "counterparty_ids": F.array_join("counterparties", ";"), "scenario_tag": F.col("scenario"), "expected_discrepancy_paise": F.lit(""), "notes": F.lit("line one\nline two")}),
    }
    key = f"file_{table}"
    if key not in r.made:
        folder = w.store.folder(table)
        files.write_csv(made[table](), folder, files.COLUMNS[table])
        r.made[key] = folder
    return r.made[key]


def collections(r) -> DataFrame:
    """Settlements as the processor's JSON collections, one document a world, written and read back."""
    folder = r.world.store.folder("collections")
    s = r.world.settlements
    item = F.struct(F.col("settlement_id").alias("id"), F.lit("settlement").alias("entity"), F.col("amount_paise").alias("amount"), F.lit("processed").alias("status"), F.col("fees_paise").alias("fees"), F.col("tax_paise").alias("tax"), "utr", F.unix_timestamp(F.col("created").cast("timestamp")).alias("created_at"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("row_no", item.alias("item")))), lambda x: x["item"])
    docs = s.groupBy("world_id").agg(F.to_json(F.struct(F.lit("collection").alias("entity"), items.alias("items"))).alias("value"))
    docs.repartition("world_id").select("value", "world_id").write.partitionBy("world_id").text(folder)
    read = ingest.collection(r.spark, folder, ingest.SETTLEMENT)
    paid = r.world.payments.filter("settlement_id <> ''").select(F.col("settlement_id"), F.lit("payment").alias("type"), (F.col("created_s") + 86400).cast("string").alias("settled_at"), F.col("row_no"))
    return ingest.settlements(read, paid)


def events_of(r) -> DataFrame:
    """The action log and the queue's statuses as events of a stream."""
    none = F.lit(None).cast("string")
    actions = r.actions().select("item_id", "seq", "action", "by", "note", none.alias("assignee"), none.alias("snooze_until"), F.col("status_at_action").alias("status"))
    named = r.queue().join(actions.select("item_id").distinct(), "item_id", "left_semi").select("item_id", F.lit(1 << 40).alias("seq"), F.lit("status").alias("action"), none.alias("by"), none.alias("note"), none.alias("assignee"), none.alias("snooze_until"), "status")
    return actions.unionByName(named)


def streamed(r) -> DataFrame:
    """Item states at the end of a stream that gets the events in two batches out of order, and a third of them again."""
    if "streamed" not in r.made:
        store, events = r.world.store, events_of(r)
        source, out = store.folder("events"), store.folder("states")
        events = store.cut(events.withColumn("half", F.pmod(F.xxhash64("item_id", "seq"), F.lit(3))), "log")
        for some in ("half <> 0", "half <> 1"):
            events.filter(some).drop("half").write.mode("append").parquet(source)
        files = len(r.spark.read.parquet(source).inputFiles())
        workflow.stream(r.spark, source, store.folder("checkpoint"), out, (files + 1) // 2).awaitTermination()
        r.made["streamed"] = workflow.latest(r.spark, out)
    return r.made["streamed"]


def documents(r) -> DataFrame:
    w = r.world
    return r.once("documents", lambda: document.documents(w.settlements, w.bank_rows, r.leg_a(), r.leg_b(), r.journeys(), r.queue(), verify.leg_a(w.settlements, w.bank_rows, r.damaged())))


def totals(r) -> DataFrame:
    d = document.read(documents(r))
    by = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return d.select(
        "world_id", "close_date", "cash.n_rows", "cash.movement_paise", "cash.last_txn", "recon_summary.in_scope", "recon_summary.matched", "recon_summary.matched_paise", by(F.col("leg_b_summary.by_status")).alias("by_status"),
        "leg_b_summary.journeys_total", "leg_b_summary.journeys_intact", F.col("verify_panel.leg_a").alias("violations"), F.size("verify_panel.samples").cast("long").alias("samples"), "counts.queue_total",
        *(F.col(f"counts.by_severity.S{s}").alias(f"s{s}") for s in (1, 2, 3)), by(F.col("counts.by_source")).alias("by_source"), F.size("decisions_a").cast("long").alias("decisions_a"), F.size("decisions_b").cast("long").alias("decisions_b"),
    )


def document_queue(r) -> DataFrame:
    items = document.read(documents(r)).select("world_id", F.posexplode("queue").alias("place", "item"))
    return items.select("world_id", "place", "item.source", "item.status", "item.severity", "item.money_at_risk_paise", F.array_join("item.record_ids", ";").alias("record_ids"), "item.item_id", "item.due_date")


def upserted(r) -> DataFrame:
    """Orders with changes by key: every third with a new amount, some of them twice, and new ones at the end."""
    o = r.world.order_book.select("order_id", "amount_paise", "status", "row_no")
    changed = o.filter("row_no % 3 = 0").select("order_id", (F.col("amount_paise") + 1).alias("amount_paise"), "status", F.col("row_no").alias("seq"))
    again = o.filter("row_no % 6 = 0").select("order_id", (F.col("amount_paise") + 2).alias("amount_paise"), F.lit("again").alias("status"), (F.col("row_no") + 10_000_000_000).alias("seq"))
    fresh = o.filter("row_no % 50 = 0").select(F.concat(F.lit("new_"), F.col("order_id")).alias("order_id"), "amount_paise", F.lit("new").alias("status"), (F.col("row_no") + 20_000_000_000).alias("seq"))
    merged = files.upsert(o, reduce(DataFrame.unionByName, [changed, again, fresh]), "order_id")
    return merged.select("order_id", "amount_paise", "status", (F.col("row_no") < 10_000_000_000).alias("kept_place"))


def new_urgent(r, most: int = 5) -> DataFrame:
    """Of each world the most costly items to act on today that an earlier snapshot, here without a third of the items, did not have."""
    snap = close.snapshot(r.queue(), r.dates())
    earlier = snap.filter(F.conv(F.substring("item_id", 1, 2), 16, 10).cast("int") % 3 != 0)
    new = close.delta(earlier, snap).filter("change = 'new'").select("world_id", "item_id")
    urgent = snap.filter("severity = 1").join(new, ["world_id", "item_id"], "left_semi").select("world_id", "item_id", "status", "title", "money_at_risk_paise")
    return document.first(urgent, most, F.desc("money_at_risk_paise"), F.col("item_id"))


def credit_labels(r) -> DataFrame:
    """The answers that the scenario classes imply for bank rows."""
    part, c = F.col("row_no") % 4, F.floor(F.col("row_no") / 4) % 24
    expected = F.when(part == 2, "out_of_scope").when(part == 3, "exception_missing_settlement").when((part == 1) & (c == 16), "duplicate_credit")
    expected = expected.when(c == 5, "ambiguous_abstain").when(c == 23, "non_settlement_credit").otherwise("matched")
    return r.world.bank_rows.select("world_id", F.col("txn_id").alias("record_id"), expected.alias("expected"))


def credit_grades(r) -> DataFrame:
    return grade.credits(credit_labels(r), r.leg_a()).groupBy("world_id", "expected", "got", "correct").agg(F.count("*").alias("n"))


def queries(golden: str, missed: str, title: str) -> dict:
    """Queries by name, of a folder's results, and their twins; ``golden`` is SQL for labels, ``missed`` for the labels that a queue lacks,
    ``title`` for an item's title."""
    source = lambda table, read: (lambda r: numbered(read(r.spark, written(r, table), None)))
    place = "row_number() OVER (PARTITION BY world_id ORDER BY row_no)::INTEGER AS place"
    rank = "CASE status WHEN 'ambiguous_abstain' THEN 0 WHEN 'exception_missing_bank' THEN 1 WHEN 'exception_missing_settlement' THEN 2 WHEN 'duplicate_credit' THEN 3 WHEN 'non_settlement_credit' THEN 4 ELSE 9 END"
    tally = lambda table, key: f"(SELECT world_id, array_to_string(list({key} || '=' || n ORDER BY {key}), ';') AS text FROM (SELECT world_id, {key}, count(*) AS n FROM {table} GROUP BY ALL) GROUP BY ALL)"
    family = "('matched', 'matched_with_discrepancy', 'matched_split', 'matched_merged')"
    return {
        "feed_settlements": (source("settlements", files.settlements), f"SELECT world_id, settlement_id, amount_paise, fees_paise, tax_paise, utr, payment_count, 'processed' AS status, strftime(created, '%Y-%m-%d') || 'T01:15:00' AS created_at, strftime(settled, '%Y-%m-%d') AS settled_at, created, settled, {place} FROM settlements"),
        "feed_bank_rows": (source("bank_statement", files.bank_rows), f"SELECT world_id, txn_id, value_date AS txn_date, value_date, narration, ref_no, debit_paise, credit_paise, (10000000 + sum(credit_paise - debit_paise) OVER (PARTITION BY world_id ORDER BY row_no))::BIGINT AS balance_paise, {place} FROM bank_rows"),
        "feed_payments": (source("payments", files.payments), f"SELECT world_id, payment_id, order_id, CASE WHEN row_no % 3 = 0 THEN 'card, \"saved\"' ELSE 'upi' END AS method, amount_paise, fee_paise, tax_paise, status, strftime(make_timestamp(created_s * 1000000), '%Y-%m-%dT%H:%M:%S') AS created_at, settlement_id, created_s, {place} FROM payments"),
        "feed_order_book": (source("order_book", files.order_book), f"SELECT world_id, order_id, receipt, amount_paise, status, strftime(make_timestamp(row_no * 60 * 1000000), '%Y-%m-%dT%H:%M:%S') AS created_at, {place} FROM order_book"),
        "feed_golden": (lambda r: files.golden(r.spark, written(r, "golden"), None).withColumn("counterparties", F.array_join("counterparties", ";")), f"SELECT world_id, record_type, record_id, expected, counterparties, scenario FROM ({golden})"),
        "feed_collections": (collections, "SELECT settlement_id, amount_paise, fees_paise, tax_paise, utr, coalesce(n, 0) AS payment_count, 'processed' AS status, strftime(created, '%Y-%m-%dT%H:%M:%S') AS created_at, strftime(coalesce(make_timestamp((first + 86400) * 1000000), created), '%Y-%m-%d') AS settled_at FROM settlements LEFT JOIN (SELECT settlement_id AS id, count(*) AS n, min_by(created_s, row_no) AS first FROM payments WHERE settlement_id <> '' GROUP BY ALL) ON id = settlement_id"),
        "upserted_orders": (upserted, """SELECT order_id, CASE WHEN row_no % 6 = 0 THEN amount_paise + 2 WHEN row_no % 3 = 0 THEN amount_paise + 1 ELSE amount_paise END AS amount_paise, CASE WHEN row_no % 6 = 0 THEN 'again' ELSE status END AS status, true AS kept_place FROM order_book
  UNION ALL SELECT 'new_' || order_id, amount_paise, 'new', false FROM order_book WHERE row_no % 50 = 0"""),
        "actions_streamed": (streamed, """SELECT f.item_id, f.last_action, CASE WHEN f.last_action = 'resolve' AND f.seen_status <> q.status THEN 'open' WHEN f.last_action = 'resolve' THEN 'resolved' WHEN f.last_action = 'assign' THEN 'assigned' WHEN f.last_action = 'snooze' THEN 'snoozed' ELSE 'open' END AS workflow,
  f.assignee, NULL::VARCHAR AS snooze_until, f.last_note, f.seen_status, q.status, f.last_action = 'resolve' AND f.seen_status <> q.status AS reopened, f.n_actions FROM folded f JOIN (SELECT DISTINCT item_id, status FROM queue) q ON q.item_id = f.item_id"""),
        "close_document": (totals, f"""SELECT w.world_id, strftime(c.d, '%Y-%m-%d') AS close_date, c.n_rows, c.movement_paise, c.last_txn, a.in_scope, a.matched, a.matched_paise, bs.text AS by_status, j.journeys_total, j.journeys_intact, coalesce(v.n, 0) AS violations, least(coalesce(v.n, 0), 10) AS samples,
  q.queue_total, q.s1, q.s2, q.s3, qs.text AS by_source, a.decisions AS decisions_a, b.decisions AS decisions_b
  FROM (SELECT DISTINCT world_id FROM settlements) w JOIN (SELECT world_id, max(value_date) AS d, count(*) AS n_rows, sum(credit_paise - debit_paise)::BIGINT AS movement_paise, max_by(txn_id, row_no) AS last_txn FROM bank_rows GROUP BY ALL) c ON c.world_id = w.world_id
  JOIN (SELECT world_id, count(*) AS decisions, count(*) FILTER (status NOT IN ('out_of_scope', 'non_settlement_credit')) AS in_scope, count(*) FILTER (status IN {family}) AS matched, coalesce(sum(received_paise) FILTER (status IN {family}), 0)::BIGINT AS matched_paise FROM leg_a GROUP BY ALL) a ON a.world_id = w.world_id
  JOIN (SELECT world_id, count(*) AS decisions FROM leg_b GROUP BY ALL) b ON b.world_id = w.world_id JOIN {tally('leg_b', 'status')} bs ON bs.world_id = w.world_id
  JOIN (SELECT world_id, count(*) AS journeys_total, count(*) FILTER (first_break = '') AS journeys_intact FROM journeys GROUP BY ALL) j ON j.world_id = w.world_id
  JOIN (SELECT world_id, count(*) AS queue_total, count(*) FILTER (severity = 1) AS s1, count(*) FILTER (severity = 2) AS s2, count(*) FILTER (severity = 3) AS s3 FROM queue GROUP BY ALL) q ON q.world_id = w.world_id
  JOIN {tally('queue', 'source')} qs ON qs.world_id = w.world_id LEFT JOIN (SELECT world_id, count(*) AS n FROM broken_dd GROUP BY ALL) v ON v.world_id = w.world_id"""),
        "close_document_queue": (document_queue, "SELECT world_id, (row_number() OVER (PARTITION BY world_id ORDER BY severity, money_at_risk_paise DESC, source, status, ids[1], item_id) - 1)::INTEGER AS place, source, status, severity, money_at_risk_paise::BIGINT AS money_at_risk_paise, array_to_string(ids, ';') AS record_ids, item_id, strftime(due_date, '%Y-%m-%d') AS due_date FROM queue"),
        "queue_new_urgent": (new_urgent, f"SELECT world_id, item_id, status, title, money_at_risk_paise::BIGINT AS money_at_risk_paise, place FROM (SELECT *, {title} AS title, row_number() OVER (PARTITION BY world_id ORDER BY money_at_risk_paise DESC, item_id)::INTEGER AS place FROM queue WHERE severity = 1 AND ('0x' || substr(item_id, 1, 2))::INTEGER % 3 = 0) WHERE place <= 5"),
        "grade_credits": (credit_grades, f"""SELECT world_id, expected, got, CASE WHEN expected = 'matched' THEN got IN {family} ELSE got = expected END AS correct, count(*) AS n FROM (
  SELECT b.world_id, CASE WHEN row_no % 4 = 2 THEN 'out_of_scope' WHEN row_no % 4 = 3 THEN 'exception_missing_settlement' WHEN row_no % 4 = 1 AND row_no // 4 % 24 = 16 THEN 'duplicate_credit' WHEN row_no // 4 % 24 = 5 THEN 'ambiguous_abstain' WHEN row_no // 4 % 24 = 23 THEN 'non_settlement_credit' ELSE 'matched' END AS expected,
    coalesce(d.status, 'unreported') AS got FROM bank_rows b LEFT JOIN (SELECT world_id, tid, min_by(status, (pass_name, status)) AS status FROM (SELECT world_id, unnest(tids) AS tid, status, pass_name FROM leg_a) GROUP BY ALL) d ON d.world_id = b.world_id AND d.tid = b.txn_id) GROUP BY ALL"""),
        "violation_samples": (lambda r: document.first(verify.leg_a(r.world.settlements, r.world.bank_rows, r.damaged()), document.SAMPLES, "code", "record"), "SELECT *, row_number() OVER (PARTITION BY world_id ORDER BY code, record)::INTEGER AS place FROM broken_dd QUALIFY place <= 10"),
        "missed_samples": (lambda r: document.first(audit.missed(r.naive_queue(), r.golden_queue()).select("world_id", "status", "record_id"), document.MISSED, "status", "record_id"), f"SELECT world_id, status, record_id, row_number() OVER (PARTITION BY world_id ORDER BY status, record_id)::INTEGER AS place FROM ({missed}) QUALIFY place <= 20"),
        "exceptions_shown": (lambda r: document.display_order(r.leg_a()).select("world_id", "place", "status", F.array_join(F.concat("settlement_ids", "bank_txn_ids"), ";").alias("records")), f"SELECT world_id, row_number() OVER (PARTITION BY world_id ORDER BY {rank}, array_to_string(list_concat(sids, tids), ';'))::INTEGER AS place, status, array_to_string(list_concat(sids, tids), ';') AS records FROM leg_a WHERE kind = 'exception' AND status <> 'out_of_scope'"),
    }


#: Columns of type date, which results show as ISO text.
DATES = {"feed_settlements": ["created", "settled"], "feed_bank_rows": ["txn_date", "value_date"]}
