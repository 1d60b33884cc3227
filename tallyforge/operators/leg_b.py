"""Payments against orders: explicit keys, first capture pays, later ones are duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reconcile(payments: DataFrame, order_book: DataFrame) -> DataFrame:
    """(world_id, record_type, record_id, status, counterparty_ids, rule, candidates) for each payment and order.

    Failed comes before unknown order. The earliest capture of an order counts even if its amount differs, so a later one with the
    right amount is a duplicate. Of several mismatches an order names the first in source order, of several refunds the last.
    """
    o = order_book.select("world_id", "order_id", F.col("row_no").alias("o_no"), F.col("amount_paise").alias("order_amount"), F.col("status").alias("order_status"))
    p = payments.join(o, ["world_id", "order_id"], "left")
    captured = F.col("status") == "captured"
    # The least capture of an order needs no order within it: the rows stay as the join has sorted them, and no task sorts them again.
    earliest = F.min(F.when(captured, F.struct("created_s", "payment_id"))).over(Window.partitionBy("world_id", "order_id"))
    p = p.withColumn("first", earliest["payment_id"])
    known = F.col("order_amount").isNotNull()
    status = (
        F.when(F.col("status") == "failed", "payment_failed").when(~known, "exception_payment_no_order").when(F.col("status") == "refunded", "payment_refunded")
        .when(F.col("amount_paise") != F.col("order_amount"), "exception_amount_mismatch").when(F.col("first") != F.col("payment_id"), "exception_duplicate_payment").otherwise("payment_applied")
    )
    p = p.withColumn("told", status)
    rule = F.create_map(*(F.lit(x) for kv in {"payment_failed": "status_failed", "exception_payment_no_order": "unknown_order", "payment_refunded": "refunded", "exception_amount_mismatch": "amount_mismatch", "exception_duplicate_payment": "duplicate_capture", "payment_applied": "applied"}.items() for x in kv))
    none = F.array().cast("array<string>")
    candidates = F.when(F.col("told") == "exception_duplicate_payment", F.array("first")).when(F.col("told") == "exception_payment_no_order", F.array(F.lit(""))).otherwise(none)
    of_payments = p.select("world_id", F.lit("payment").alias("record_type"), F.col("payment_id").alias("record_id"), F.col("told").alias("status"), F.when(known, F.array("order_id")).otherwise(none).alias("counterparty_ids"), rule[F.col("told")].alias("rule"), candidates.alias("candidates"))
    pick = lambda kind, by: by(F.when(F.col("told") == kind, F.col("payment_id")), F.when(F.col("told") == kind, F.col("row_no")))
    sides = p.filter(known).groupBy("world_id", "order_id").agg(pick("payment_applied", F.max_by).alias("applied"), pick("exception_amount_mismatch", F.min_by).alias("mismatched"), pick("payment_refunded", F.max_by).alias("refunded"))
    q = o.join(sides, ["world_id", "order_id"], "left")
    cancelled = F.col("order_status") == "cancelled"
    status = F.when(cancelled, "order_cancelled").when(F.col("applied").isNotNull(), "order_paid").when(F.col("mismatched").isNotNull(), "exception_amount_mismatch").when(F.col("refunded").isNotNull(), "order_refunded").otherwise("exception_unpaid_order")
    other = F.when(~cancelled, F.coalesce("applied", "mismatched", "refunded"))
    rule = F.create_map(*(F.lit(x) for kv in {"order_cancelled": "cancelled", "order_paid": "paid", "exception_amount_mismatch": "amount_mismatch", "order_refunded": "refunded", "exception_unpaid_order": "no_capture"}.items() for x in kv))
    of_orders = q.select("world_id", F.lit("order").alias("record_type"), F.col("order_id").alias("record_id"), status.alias("status"), F.when(other.isNotNull(), F.array(other)).otherwise(none).alias("counterparty_ids"), rule[status].alias("rule"), none.alias("candidates"))
    return of_payments.unionByName(of_orders)
