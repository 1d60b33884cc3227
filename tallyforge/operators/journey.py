"""From each order over its payment and settlement to the bank credit, and the first link that is broken."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A journey's breaks in ``breaks`` below are result values too.
MATCHED = ["matched", "matched_split", "matched_merged", "matched_with_discrepancy"]


def last_decision(leg_a: DataFrame) -> DataFrame:
    """(world_id, settlement_id, settlement_status, bank_txn_ids): where several decisions name a settlement, the latest pass wins."""
    per = leg_a.select("world_id", F.explode("settlement_ids").alias("settlement_id"), F.col("status").alias("settlement_status"), F.array_join("bank_txn_ids", ";").alias("bank_txn_ids"), "pass_name")
    turn = F.row_number().over(Window.partitionBy("world_id", "settlement_id").orderBy(F.desc("pass_name"), "bank_txn_ids"))
    return per.withColumn("turn", turn).filter("turn = 1").drop("turn", "pass_name")


def journeys(order_book: DataFrame, payments: DataFrame, leg_a: DataFrame, leg_b: DataFrame) -> DataFrame:
    """One row per order. A missing id is an empty text, as in the source's file."""
    b = leg_b.filter("record_type = 'order'").select("world_id", F.col("record_id").alias("order_id"), F.col("status").alias("order_status"), F.array_join("counterparty_ids", ";").alias("payment_id"))
    paid = F.col("order_status") == "order_paid"
    j = order_book.select("world_id", "order_id", "receipt", F.col("amount_paise").alias("order_amount_paise")).join(b, ["world_id", "order_id"], "left")
    j = j.join(payments.select("world_id", "payment_id", F.col("settlement_id").alias("of_payment")), ["world_id", "payment_id"], "left")
    j = j.withColumn("settlement_id", F.when(paid, F.coalesce("of_payment", F.lit(""))).otherwise(""))
    j = j.join(last_decision(leg_a), ["world_id", "settlement_id"], "left")
    status = F.col("settlement_status")
    breaks = (
        F.when(F.col("order_status").isNull(), "order not assessed").when(F.col("order_status").isin("order_cancelled", "order_refunded"), "").when(F.col("order_status") == "exception_unpaid_order", "never paid")
        .when(F.col("order_status") == "exception_amount_mismatch", "payment amount differs from order").when(F.col("settlement_id") == "", "captured but not yet settled").when(status.isNull(), "settlement not assessed")
        .when(status.isin(MATCHED), "").when(status == "exception_missing_bank", "settlement never hit the bank").when(status == "ambiguous_abstain", "bank credit ambiguous - needs review").otherwise(F.concat(F.lit("settlement issue: "), status))
    )
    shown = F.when(paid & (F.col("settlement_id") != ""), F.coalesce(status, F.lit("unassessed"))).otherwise("")
    return j.select("world_id", "order_id", "receipt", "order_amount_paise", F.coalesce("order_status", F.lit("unknown")).alias("order_status"), F.coalesce("payment_id", F.lit("")).alias("payment_id"), "settlement_id", shown.alias("settlement_status"), F.coalesce("bank_txn_ids", F.lit("")).alias("bank_txn_ids"), breaks.alias("first_break"))
