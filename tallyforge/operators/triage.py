"""The exception queue: severity, money at risk, overdue settlements fused on, in one order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import scalars as X
from tallyforge.operators import explain
from tallyforge.operators.journey import MATCHED, last_decision

#: Severity of each status that a person must see.
SEVERITY = {
    "exception_missing_bank": 1, "duplicate_credit": 1,
    "ambiguous_abstain": 2, "exception_missing_settlement": 2, "exception_amount_mismatch": 2, "exception_duplicate_payment": 2,
    "needs_review": 3, "exception_unpaid_order": 3, "exception_payment_no_order": 3,
}
COLUMNS = ["world_id", "source", "status", "severity", "money_at_risk_paise", "record_ids", "due_date", "days_overdue", "evidence", "explanation", "candidates"]
#: Columns of overdue settlements.
LATE = "world_id long, settlement_id string, amount_paise long, expected_date date, days_overdue int"
NOTED = "array<struct<id:string,amount_paise:bigint,note:string>>"


def severity(status):
    return F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))[status]


def close_dates(bank_rows: DataFrame) -> DataFrame:
    return bank_rows.groupBy("world_id").agg(F.max("value_date").alias("close_date"))


def overdue(settlements: DataFrame, leg_a: DataFrame, dates: DataFrame) -> DataFrame:
    """Settlements that should have arrived by the close date and are missing or ambiguous."""
    s = settlements.join(dates, "world_id").join(last_decision(leg_a), ["world_id", "settlement_id"])
    s = s.withColumn("expected_date", X.roll_off_sunday(F.col("settled")))
    s = s.filter(F.col("settlement_status").isin("exception_missing_bank", "ambiguous_abstain") & (F.col("created") <= F.col("close_date")) & (F.col("expected_date") <= F.col("close_date")))
    return s.select("world_id", "settlement_id", "amount_paise", "expected_date", F.datediff("close_date", "expected_date").alias("days_overdue"))


def items_from_leg_a(leg_a: DataFrame, late: DataFrame) -> DataFrame:
    status = F.when(F.col("status").isin(MATCHED) & (F.col("confidence") == "needs_review"), "needs_review").otherwise(F.col("status"))
    d = explain.attach(leg_a).withColumn("status", status).filter(F.col("status").isin(*SEVERITY))
    money = (
        F.when(F.col("status") == "exception_missing_bank", F.col("expected_paise")).when(F.col("status").isin("duplicate_credit", "exception_missing_settlement"), F.col("received_paise"))
        .when(F.col("status") == "ambiguous_abstain", F.coalesce("expected_paise", "received_paise")).otherwise(F.abs("discrepancy_paise"))
    )
    d = d.select("world_id", F.lit("recon_leg_a").alias("source"), "status", severity(F.col("status")).alias("severity"), F.coalesce(money, F.lit(0)).alias("money_at_risk_paise"), F.concat("settlement_ids", "bank_txn_ids").alias("record_ids"), "settlement_ids", F.col("rules").alias("evidence"), "explanation", F.col("candidates").cast(NOTED).alias("candidates"))
    named = d.select("world_id", "record_ids", F.explode("settlement_ids").alias("settlement_id")).join(late, ["world_id", "settlement_id"])
    fused = named.groupBy("world_id", "record_ids").agg(F.min("expected_date").alias("due_date"), F.max("days_overdue").alias("days_overdue"))
    return d.join(fused, ["world_id", "record_ids"], "left").select(COLUMNS)


#: Statuses of items that a search over sums may answer.
OPEN = ["ambiguous_abstain", "exception_missing_bank", "exception_missing_settlement"]


def open_items(leg_a: DataFrame) -> DataFrame:
    """(world_id, item_id, record_ids) of the queue's items that are open in leg A. What leg B, due dates and texts add to the queue is no part of them."""
    records = F.concat("settlement_ids", "bank_txn_ids")
    return leg_a.filter(F.col("status").isin(OPEN)).select("world_id", X.item_id(F.lit("recon_leg_a"), records).alias("item_id"), records.alias("record_ids"))


def items_from_leg_b(leg_b: DataFrame, order_book: DataFrame, payments: DataFrame) -> DataFrame:
    """An order's mismatch and its payments' mismatches are one item."""
    none = [F.lit(None).cast("date").alias("due_date"), F.lit(None).cast("int").alias("days_overdue")]
    kind = "exception_amount_mismatch"
    amounts = payments.select("world_id", F.col("payment_id").alias("record_id"), F.col("amount_paise").alias("paid"))
    asked = order_book.select("world_id", F.col("order_id").alias("record_id"), F.col("amount_paise").alias("asked"))
    noted = lambda ids: F.transform(ids, lambda x: F.struct(x.alias("id"), F.lit(None).cast("bigint").alias("amount_paise"), F.lit("").alias("note")))
    display = [F.array("rule").alias("evidence"), F.lit(None).cast("string").alias("explanation"), noted(F.col("candidates")).cast(NOTED).alias("candidates")]
    m = leg_b.filter(F.col("status") == kind)
    of_orders = m.filter("record_type = 'order'").select("world_id", F.col("record_id").alias("order_id"), F.explode_outer("counterparty_ids").alias("record_id"), "rule", "candidates")
    of_payments = m.filter("record_type = 'payment'").select("world_id", "record_id").join(amounts, ["world_id", "record_id"])
    halves = of_orders.join(of_payments, ["world_id", "record_id"], "left").groupBy("world_id", "order_id").agg(F.first("rule").alias("rule"), F.first("candidates").alias("candidates"), F.coalesce(F.sum("paid"), F.lit(0)).alias("paid"), F.array_sort(F.collect_list(F.when(F.col("paid").isNotNull(), F.col("record_id")))).alias("pids"))
    fused = halves.join(asked.withColumnRenamed("record_id", "order_id"), ["world_id", "order_id"], "left")
    fused = fused.select("world_id", F.lit("recon_leg_b").alias("source"), F.lit(kind).alias("status"), F.lit(2).alias("severity"), F.abs(F.col("paid") - F.coalesce("asked", F.lit(0))).alias("money_at_risk_paise"), F.concat(F.array("order_id"), "pids").alias("record_ids"), *none, *display)
    taken = halves.select("world_id", F.explode("pids").alias("record_id"))
    rest = leg_b.filter(F.col("status").isin(*SEVERITY) & ~((F.col("status") == kind) & (F.col("record_type") == "order")))
    unpaid = F.col("status") == "exception_unpaid_order"
    of_orders = rest.filter(unpaid).join(asked.withColumnRenamed("asked", "money"), ["world_id", "record_id"], "left")
    others = rest.filter(~unpaid).join(taken, ["world_id", "record_id"], "left_anti").join(amounts.withColumnRenamed("paid", "money"), ["world_id", "record_id"], "left")
    rest, money = of_orders.unionByName(others), F.col("money")
    rest = rest.select("world_id", F.lit("recon_leg_b").alias("source"), "status", severity(F.col("status")).alias("severity"), F.coalesce(money, F.lit(0)).alias("money_at_risk_paise"), F.concat(F.array("record_id"), F.array_sort("counterparty_ids")).alias("record_ids"), *none, *display)
    return fused.unionByName(rest)


def queue(leg_a_items: DataFrame, leg_b_items: DataFrame) -> DataFrame:
    """All items with their id, title, detail and suggested action."""
    return explain.shown(leg_a_items.unionByName(leg_b_items)).withColumn("item_id", X.item_id(F.col("source"), F.col("record_ids")))



def ordered(items: DataFrame) -> DataFrame:
    return items.orderBy("severity", F.desc("money_at_risk_paise"), "source", "status", F.get("record_ids", F.lit(0)))
