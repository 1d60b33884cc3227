"""Independent checks of decisions and queues. Nothing of the matcher is imported: amounts are read and summed anew."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FAMILY = ["matched", "matched_split", "matched_merged", "matched_with_discrepancy"]
WITH_CANDIDATES = ["ambiguous_abstain", "duplicate_credit", "exception_missing_bank", "exception_missing_settlement"]
#: Evidence of which each confidence needs one.
EVIDENCE = {
    "exact": ["utr_exact"],
    "high": ["utr_fuzzy", "decomposed_discrepancy", "sum_exact_parts", "merge_residual_exact"],
    "medium": ["amount_exact_unique", "amount_within_rs1_and_3_days", "amount_exact_first_come"],
}


def _told(df: DataFrame, code: str, record) -> DataFrame:
    return df.select("world_id", F.lit(code).alias("code"), record.cast("string").alias("record"))


def leg_a(settlements: DataFrame, bank_rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """(world_id, code, record) for every violated invariant; empty if all hold."""
    s = settlements.select("world_id", F.col("settlement_id").alias("id"), F.col("amount_paise").alias("amount"))
    c = bank_rows.filter("credit_paise > 0").select("world_id", F.col("txn_id").alias("id"), F.col("credit_paise").alias("amount"))
    d = decisions.withColumn("key", F.concat_ws("|", "pass_name", "status", F.array_join("settlement_ids", ";"), F.array_join("bank_txn_ids", ";")))
    found = []
    sums = d.select("world_id", "key")
    for column, known, name in (("settlement_ids", s, "settlement"), ("bank_txn_ids", c, "credit")):
        named = d.select("world_id", "key", "status", F.explode(column).alias("id"))
        found.append(_told(named.filter("status <> 'out_of_scope'").join(known, ["world_id", "id"], "left_anti"), f"unknown_{name}", F.col("id")))
        claimed = named.join(known, ["world_id", "id"], "left_semi").groupBy("world_id", "id").count()
        found.append(_told(claimed.filter("count > 1"), f"{name}_claimed_twice", F.col("id")))
        found.append(_told(known.join(named, ["world_id", "id"], "left_anti"), f"{name}_uncovered", F.col("id")))
        sums = sums.join(named.join(known, ["world_id", "id"]).groupBy("world_id", "key").agg(F.sum("amount").alias(f"{name}_sum")), ["world_id", "key"], "left")
    m = d.filter(F.col("status").isin(FAMILY)).join(sums.dropDuplicates(["world_id", "key"]), ["world_id", "key"])
    expected, received = F.coalesce("settlement_sum", F.lit(0)), F.coalesce("credit_sum", F.lit(0))
    explained = F.aggregate("discrepancy_breakdown", F.lit(0).cast("bigint"), lambda a, x: a + x["amount_paise"])
    needed = F.create_map(*(x for k, v in EVIDENCE.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))[F.col("confidence")]
    for code, wrong in {
        "expected_sum": ~F.col("expected_paise").eqNullSafe(expected),
        "received_sum": ~F.col("received_paise").eqNullSafe(received),
        "discrepancy": ~F.col("discrepancy_paise").eqNullSafe(received - expected),
        "breakdown": (F.size("discrepancy_breakdown") > 0) & (explained != F.col("discrepancy_paise")),
        "no_evidence": F.size("rules") == 0,
        "unknown_confidence": ~F.col("confidence").isin(*EVIDENCE, "needs_review"),
        "unbacked_confidence": F.coalesce(~F.arrays_overlap("rules", needed), F.lit(False)),
        "exact_with_discrepancy": (F.col("confidence") == "exact") & (F.col("discrepancy_paise") != 0),
    }.items():
        found.append(_told(m.filter(wrong), code, F.col("key")))
    found.append(_told(d.filter(F.col("status").isin(WITH_CANDIDATES) & (F.size("candidates") == 0)), "no_candidates", F.col("key")))
    return reduce(DataFrame.unionByName, found)


def balances(bank_rows: DataFrame) -> DataFrame:
    """Rows whose stated balance does not follow from the row before, unless more than seven days lie between. Needs balance_paise."""
    order = Window.partitionBy("world_id").orderBy("row_no")
    b = bank_rows.withColumn("last", F.lag("balance_paise").over(order)).withColumn("gap", F.coalesce(F.datediff("value_date", F.lag("value_date").over(order)), F.lit(0)))
    broken = F.col("last").isNotNull() & (F.col("last") + F.col("credit_paise") - F.col("debit_paise") != F.col("balance_paise")) & (F.col("gap") <= 7)
    return _told(b.filter(broken), "balance_break", F.col("txn_id"))


def running_balance(bank_rows: DataFrame, opening: int = 10_000_000) -> DataFrame:
    order = Window.partitionBy("world_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    return bank_rows.withColumn("balance_paise", F.sum(F.col("credit_paise") - F.col("debit_paise")).over(order) + opening)


#: How severe each status is that a queue must show.
SEVERE = {
    "exception_missing_bank": 1, "duplicate_credit": 1,
    "ambiguous_abstain": 2, "exception_missing_settlement": 2, "exception_amount_mismatch": 2, "exception_duplicate_payment": 2,
    "needs_review": 3, "exception_unpaid_order": 3, "exception_payment_no_order": 3,
}


def amounts_of(settlements: DataFrame, bank_rows: DataFrame, order_book: DataFrame, payments: DataFrame) -> DataFrame:
    """(world_id, id, kind, amount) of all records, from the sources alone."""
    sides = [(settlements, "settlement_id", "amount_paise", "s"), (bank_rows, "txn_id", "credit_paise", "c"), (order_book, "order_id", "amount_paise", "o"), (payments, "payment_id", "amount_paise", "p")]
    return reduce(DataFrame.unionByName, [df.select("world_id", F.col(i).alias("id"), F.lit(kind).alias("kind"), F.col(n).alias("amount")) for df, i, n, kind in sides])


def due_items(decisions_a: DataFrame, decisions_b: DataFrame, amounts: DataFrame) -> DataFrame:
    """(world_id, status, unit, due, due_money): what a queue must show, from the decisions and the sources' amounts."""
    unit = lambda *ids: F.array_join(F.array_sort(F.concat(*ids)), ";").alias("unit")
    sums = lambda *kinds: [F.sum(F.when(F.col("kind") == k, F.col("amount"))).alias(k) for k in kinds]
    status = F.when(F.col("confidence") == "needs_review", "needs_review").otherwise(F.col("status")).alias("status")
    kept = lambda df, of, *columns: df.select("world_id", F.lit(of).alias("of"), *columns)
    a = kept(decisions_a, "a", status, unit("settlement_ids", "bank_txn_ids"), F.explode(F.concat("settlement_ids", "bank_txn_ids")).alias("id")).filter(F.col("status").isin(*SEVERE))

    mismatch = F.col("status") == "exception_amount_mismatch"
    pairs = decisions_b.filter(mismatch & (F.col("record_type") == "order")).select("world_id", "status", "record_id", "counterparty_ids")
    fused = pairs.select("world_id", F.explode("counterparty_ids").alias("record_id"))
    lines = kept(pairs, "pair", "status", unit(F.array("record_id"), "counterparty_ids"), F.explode(F.concat(F.array("record_id"), "counterparty_ids")).alias("id"))
    single = decisions_b.filter(F.col("status").isin(*SEVERE) & ~(mismatch & (F.col("record_type") == "order"))).join(fused, ["world_id", "record_id"], "left_anti")
    single = kept(single, "single", "status", unit(F.array("record_id"), "counterparty_ids"), F.col("record_id").alias("id"))

    told = reduce(DataFrame.unionByName, [a, lines, single]).join(amounts, ["world_id", "id"])
    per = told.groupBy("world_id", "of", "status", "unit", "id").agg(*sums("s", "c", "o", "p"), F.sum("amount").alias("all"), F.count("*").alias("n"))
    per = per.groupBy("world_id", "of", "status", "unit").agg(*(F.sum(c).alias(c) for c in ("s", "c", "o", "p", "all", "n")), F.count("*").alias("ids"))
    money = F.when(F.col("of") == "pair", F.abs(F.coalesce("p", F.lit(0)) - F.col("o"))).when(F.col("of") == "single", F.col("all"))
    money = money.when(F.col("status") == "needs_review", F.abs(F.col("c") - F.col("s"))).when(F.col("status") == "exception_missing_bank", F.col("s"))
    due = F.when(F.col("of") == "pair", F.lit(1)).when(F.col("of") == "single", F.col("n")).otherwise((F.col("n") / F.col("ids")).cast("long"))
    return per.select("world_id", "status", "unit", due.cast("long").alias("due"), money.when(F.col("status") == "ambiguous_abstain", F.coalesce("s", "c")).otherwise(F.col("c")).alias("due_money"))


def queue(items: DataFrame, due: DataFrame) -> DataFrame:
    """Units that the queue lacks, has twice or has without cause, and wrong severities or money; ``due`` is from ``due_items``."""
    level = F.create_map(*(F.lit(x) for kv in SEVERE.items() for x in kv))
    there = items.groupBy("world_id", "status", F.array_join(F.array_sort("record_ids"), ";").alias("unit"))
    there = there.agg(F.count("*").alias("shown"), F.max("severity").alias("severity"), F.sum("money_at_risk_paise").alias("money"))
    both = due.join(there, ["world_id", "status", "unit"], "full_outer")
    faults = {
        "missing_item": F.col("shown").isNull(), "unfounded_item": F.col("due").isNull(), "item_count": F.col("shown") != F.col("due"),
        "severity": F.col("severity") != level[F.col("status")], "money": F.col("money") != F.col("due_money"),
    }
    codes = F.array_compact(F.array(*(F.when(wrong, code) for code, wrong in faults.items())))
    return both.select("world_id", F.explode(codes).alias("code"), F.concat_ws(":", "status", "unit").alias("record"))


def order(shown: DataFrame) -> DataFrame:
    """Places of a shown queue, (world_id, place, the sort columns), at which an item should stand before the one above it."""
    rank = F.struct("severity", -F.col("money_at_risk_paise"), "source", "status", F.get("record_ids", F.lit(0)))
    above = F.lag(rank).over(Window.partitionBy("world_id").orderBy("place"))
    return _told(shown.withColumn("above", above).filter(F.col("above") > rank), "order", F.col("place"))
