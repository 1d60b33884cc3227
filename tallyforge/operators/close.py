"""The daily close of each world: cash, counts, summaries, as-of slices, workflow overlay, snapshots and their differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.journey import MATCHED


def cash(bank_rows: DataFrame) -> DataFrame:
    """Per world: net movement, rows, first and last day, span in days. The last row in source order is last."""
    return bank_rows.groupBy("world_id").agg(
        F.count("*").alias("n_rows"), F.sum(F.col("credit_paise") - F.col("debit_paise")).alias("movement_paise"), F.min("value_date").alias("first_date"), F.max("value_date").alias("close_date"),
        F.datediff(F.max("value_date"), F.min("value_date")).alias("span_days"), F.max_by("txn_id", "row_no").alias("last_txn"),
    )


def leg_a_summary(leg_a: DataFrame) -> DataFrame:
    """Per world: decisions in scope, matched ones, their received sum, and those to review. Ratios are left to the reader, as
    numerator and denominator."""
    scope = ~F.col("status").isin("out_of_scope", "non_settlement_credit")
    matched = F.col("status").isin(MATCHED)
    return leg_a.groupBy("world_id").agg(
        F.count_if(scope).alias("in_scope"), F.count_if(matched).alias("matched"), F.coalesce(F.sum(F.when(matched, F.col("received_paise"))), F.lit(0)).alias("matched_paise"),
        F.count_if(F.col("confidence") == "needs_review").alias("needs_review"), F.count_if(F.col("kind") == "exception").alias("exceptions"),
    )


def overview(leg_a: DataFrame) -> DataFrame:
    """Reconciled money and money in exceptions: expected unless it is 0 or null, else received."""
    amount = F.coalesce(F.nullif("expected_paise", F.lit(0)), "received_paise", F.lit(0))
    return leg_a.groupBy("world_id").agg(
        F.coalesce(F.sum(F.when(F.col("status").isin(MATCHED), F.coalesce("received_paise", F.lit(0)))), F.lit(0)).alias("reconciled_paise"),
        F.coalesce(F.sum(F.when((F.col("kind") == "exception") & (F.col("status") != "non_settlement_credit"), amount)), F.lit(0)).alias("exception_paise"),
    )


def counted(df: DataFrame, *keys: str, money: str | None = None) -> DataFrame:
    """Rows, and a sum of money, per key."""
    sums = [F.sum(money).alias("total_paise")] if money else []
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *sums)


def rollup(items: DataFrame) -> DataFrame:
    """Per world: items, worst severity, money at risk."""
    return items.groupBy("world_id").agg(F.count("*").alias("n_items"), F.min("severity").alias("worst"), F.sum("money_at_risk_paise").alias("money_at_risk_paise"), F.count_if(F.col("days_overdue").isNotNull()).alias("n_overdue"))


def as_of(df: DataFrame, date_column: str, day: Column) -> DataFrame:
    """The rows up to a day, a filter that reaches the scan."""
    return df.filter(F.col(date_column) <= day)


def fold_actions(actions: DataFrame) -> DataFrame:
    """(item_id, ...) from (item_id, seq, action, by, note, status_at_action): a note leaves the workflow as it is; the last
    assignee persists; the last of the other actions sets the workflow."""
    last = lambda value, *kinds: F.max_by(F.when(F.col("action").isin(*kinds), F.col(value)), F.when(F.col("action").isin(*kinds), F.col("seq")))
    return actions.groupBy("item_id").agg(
        F.coalesce(last("action", "resolve", "assign", "snooze"), F.lit("open")).alias("last_action"), last("by", "assign").alias("assignee"), last("note", "note").alias("last_note"),
        F.max_by("status_at_action", "seq").alias("seen_status"), F.count("*").alias("n_actions"),
    )


def overlay(items: DataFrame, folded: DataFrame) -> DataFrame:
    """Items with their workflow. An item that was resolved and has changed its status since is reopened."""
    workflow = F.create_map(*(F.lit(x) for kv in {"resolve": "resolved", "assign": "assigned", "snooze": "snoozed", "open": "open"}.items() for x in kv))
    shown = items.join(folded, "item_id", "left").withColumn("workflow", workflow[F.coalesce("last_action", F.lit("open"))])
    changed = F.coalesce(F.col("seen_status") != F.col("status"), F.lit(False))
    return shown.withColumn("reopened", changed & (F.col("workflow") == "resolved")).withColumn("workflow", F.when(F.col("reopened"), "open").otherwise(F.col("workflow")))


def snapshot(items: DataFrame, dates: DataFrame) -> DataFrame:
    return items.join(dates, "world_id").select("world_id", "close_date", "item_id", "severity", "status", "source", "title", "money_at_risk_paise")


def delta(before: DataFrame, now: DataFrame) -> DataFrame:
    """New, carried and gone items between two snapshots of the same worlds."""
    b = before.select("world_id", "item_id", F.col("status").alias("status_before"), F.col("money_at_risk_paise").alias("money_before"))
    n = now.select("world_id", "item_id", F.col("status").alias("status_now"), F.col("money_at_risk_paise").alias("money_now"))
    kind = F.when(F.col("status_before").isNull(), "new").when(F.col("status_now").isNull(), "gone").otherwise("carried")
    return b.join(n, ["world_id", "item_id"], "full_outer").withColumn("change", kind)


def latest_before(snapshots: DataFrame, day: Column) -> DataFrame:
    """Each world's latest snapshot strictly before a day."""
    earlier = snapshots.filter(F.col("close_date") < day)
    return earlier.join(earlier.groupBy("world_id").agg(F.max("close_date").alias("close_date")), ["world_id", "close_date"], "left_semi")
