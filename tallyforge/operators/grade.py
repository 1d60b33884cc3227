"""Grading decisions against labelled answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import scalars as X
from tallyforge.operators.journey import MATCHED


def assignments(decisions: DataFrame) -> DataFrame:
    """One decision per record; where several name a record, that of the earliest pass."""
    keep = ["status", "confidence", "settlement_ids", "bank_txn_ids", F.transform("candidates", lambda x: x["record_id"]).alias("candidate_ids"), "pass_name"]
    s = decisions.select("world_id", F.lit("settlement").alias("record_type"), F.explode("settlement_ids").alias("record_id"), *keep)
    c = decisions.select("world_id", F.lit("bank_credit").alias("record_type"), F.explode("bank_txn_ids").alias("record_id"), *keep)
    turn = F.row_number().over(Window.partitionBy("world_id", "record_type", "record_id").orderBy("pass_name", "status"))
    return s.unionByName(c).withColumn("turn", turn).filter("turn = 1").drop("turn", "pass_name")


def graded(golden: DataFrame, decisions: DataFrame) -> DataFrame:
    """Golden rows (world_id, record_type, record_id, expected, counterparties, scenario) with what was decided and whether it is right.

    A matched row is right if status and counterparties agree; an abstention or a duplicate if the candidates include the
    counterparties; other exceptions if the status agrees. A wrong match is a false positive, and a false negative too where a
    match was due.
    """
    g = golden.join(assignments(decisions), ["world_id", "record_type", "record_id"], "left")
    others = F.when(F.col("record_type") == "settlement", F.col("bank_txn_ids")).otherwise(F.col("settlement_ids"))
    due, is_match = F.col("expected").isin(MATCHED), F.coalesce(F.col("status").isin(MATCHED), F.lit(False))
    same = F.coalesce(F.col("status") == F.col("expected"), F.lit(False))
    as_set = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    linked = as_set(others) == as_set(F.col("counterparties"))
    named = F.size(F.array_except("counterparties", F.coalesce("candidate_ids", F.array().cast("array<string>")))) == 0
    right = same & F.when(due, linked).when(F.col("expected").isin("ambiguous_abstain", "duplicate_credit"), named).otherwise(F.lit(True))
    auto = F.coalesce(is_match & F.col("confidence").isin("exact", "high", "medium") | (F.col("status") == "non_settlement_credit"), F.lit(False))
    return g.select("world_id", "record_type", "record_id", "scenario", "expected", F.coalesce("status", F.lit("unreported")).alias("got"), right.alias("correct"), (due & right).alias("tp"), (is_match & ~(due & right)).alias("fp"), (due & ~right).alias("fn"), auto.alias("auto"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts per key; ratios are left as counts, so no rounding is in the way."""
    count = lambda c: F.count_if(F.col(c))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("expected").isin(MATCHED)).alias("matchable"), count("tp").alias("tp"), count("fp").alias("fp"), count("fn").alias("fn"), count("correct").alias("n_correct"),
        F.count_if(F.col("expected") == "ambiguous_abstain").alias("ambiguous"), F.count_if((F.col("expected") == "ambiguous_abstain") & F.col("correct")).alias("abstained"), count("auto").alias("auto_resolved"),
    )


def rates(counts: DataFrame) -> DataFrame:
    """precision, recall, F1 (0 where undefined), accuracy and the Wilson interval of the false-match rate."""
    r = counts.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _ratio(F.col("tp"), F.col("matchable")))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return r.withColumn("f1", f1).withColumn("accuracy", _ratio(F.col("n_correct"), F.col("n_rows"))).withColumn("wrong", X.wilson(F.col("fp"), F.col("tp") + F.col("fp")))


def scenario_table(rows: DataFrame) -> DataFrame:
    """Accuracy per scenario and per expected exception in one pass, by grouping sets."""
    rows = rows.withColumn("exception", F.when(~F.col("expected").isin(MATCHED), F.col("expected")))
    sets = rows.groupingSets([["scenario"], ["exception"]], "scenario", "exception").agg(F.grouping("exception").alias("by_scenario"), F.count("*").alias("n"), F.count_if("correct").alias("n_correct"))
    return sets.filter("by_scenario = 1 OR exception IS NOT NULL").select(F.when(F.col("by_scenario") == 1, "scenario").otherwise("exception").alias("kind"), F.coalesce("scenario", "exception").alias("name"), "n", "n_correct")


def leg_b(golden: DataFrame, decisions: DataFrame) -> DataFrame:
    """Golden rows of payments and orders with whether status and counterparties agree."""
    d = decisions.select("world_id", "record_type", "record_id", "status", F.array_sort("counterparty_ids").alias("others"))
    g = golden.join(d, ["world_id", "record_type", "record_id"], "left")
    right = (F.col("status") == F.col("expected")) & (F.col("others") == F.array_sort("counterparties"))
    return g.select("world_id", "record_type", "record_id", "scenario", "expected", F.coalesce("status", F.lit("unreported")).alias("got"), F.coalesce(right, F.lit(False)).alias("correct"))


def categories(rows: DataFrame) -> DataFrame:
    """Four boxes per scenario: resolved right, resolved wrong, rightly left, wrongly left."""
    box = F.when(F.col("auto") & F.col("correct"), "auto_correct").when(F.col("auto"), "auto_wrong").when(F.col("expected").isin(MATCHED), "wrongly_left").otherwise("rightly_left")
    boxes = ["auto_correct", "auto_wrong", "rightly_left", "wrongly_left"]
    return rows.withColumn("box", box).groupBy("scenario").pivot("box", boxes).count().fillna(0, boxes)


def credits(golden: DataFrame, decisions: DataFrame) -> DataFrame:
    """Labelled bank rows (world_id, record_id, expected) with what the decisions make of them: the status of the earliest decision that names a row,
    and whether it is the label, any kind of match standing for a matched row."""
    named = decisions.select("world_id", F.explode("bank_txn_ids").alias("record_id"), F.struct("pass_name", "status").alias("d"))
    got = named.groupBy("world_id", "record_id").agg(F.min("d")["status"].alias("got"))
    rows = golden.join(got, ["world_id", "record_id"], "left").withColumn("got", F.coalesce("got", F.lit("unreported")))
    same = F.when(F.col("expected") == "matched", F.col("got").isin(MATCHED)).otherwise(F.col("got") == F.col("expected"))
    return rows.withColumn("correct", same)
