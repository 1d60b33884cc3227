"""One JSON document for each world's close: its parts, nested and in order, from which a reader can check the close alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators import close

#: Violations shown in a document and in an audit's list of missed rows, and the order in which kinds of exceptions are shown.
SAMPLES, MISSED = 10, 20
#: Worlds whose lists a task holds at once.
WORLDS = 8
SHOWN = ["ambiguous_abstain", "exception_missing_bank", "exception_missing_settlement", "duplicate_credit", "non_settlement_credit"]
ITEM = ["item_id", "source", "status", "severity", "money_at_risk_paise", "record_ids", "title", "detail", "suggested_action", "evidence", "candidates", "due_date", "days_overdue"]
PARTS = ["cash", "recon_summary", "leg_b_summary", "queue", "verify_panel", "counts", "decisions_a", "decisions_b"]


def first(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows of each world, with their place."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("world_id").orderBy(*order))).filter(F.col("place") <= n)


def display_order(decisions: DataFrame) -> DataFrame:
    """Exceptions that a person reviews, with the place of their kind and then of their records in a world's list."""
    rank = reduce(lambda made, k: made.when(F.col("status") == SHOWN[k], k), range(len(SHOWN)), F.when(F.lit(False), 0)).otherwise(9)
    rows = decisions.filter("kind = 'exception' AND status <> 'out_of_scope'").withColumn("rank", rank)
    order = Window.partitionBy("world_id").orderBy("rank", F.array_join(F.concat("settlement_ids", "bank_txn_ids"), ";"))
    return rows.withColumn("place", F.row_number().over(order))


def listed(rows: DataFrame, name: str, order: list[Column], columns: list[str]) -> DataFrame:
    """(world_id, name): each world's rows as an array in order."""
    keyed = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)), F.struct(*columns).alias("row"))
    return rows.groupBy("world_id").agg(F.transform(F.array_sort(F.collect_list(keyed)), lambda x: x["row"]).alias(name))


def tallied(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(world_id, name): how many rows have each value, as a map in the order of its keys."""
    counted = rows.groupBy("world_id", key).agg(F.count("*").alias("n"))
    return counted.groupBy("world_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(name))


def documents(world: DataFrame, bank_rows: DataFrame, leg_a: DataFrame, leg_b: DataFrame, journeys: DataFrame, queue: DataFrame, violations: DataFrame) -> DataFrame:
    """(world_id, document) for the worlds (world_id): cash, summaries of both legs, the queue in its order, the checks' number and first
    violations, counts, and all decisions. A part without rows is an empty list or absent.

    Lists are objects that Spark does not count as its memory, so every part is dealt once to tasks of about WORLDS worlds, however many
    there are, and meets the others there: no part is sent to the driver."""
    world = world.select("world_id").distinct()
    tasks = 1 + world.count() // WORLDS
    world, bank_rows, leg_a, leg_b, journeys, queue, violations = (df.repartition(tasks, "world_id") for df in (world, bank_rows, leg_a, leg_b, journeys, queue, violations))
    cash = close.cash(bank_rows)
    cash = cash.select("world_id", F.struct(*(c for c in cash.columns if c != "world_id")).alias("cash"))
    summary = close.leg_a_summary(leg_a)
    summary = summary.select("world_id", F.struct(*(c for c in summary.columns if c != "world_id")).alias("recon_summary"))
    chain = journeys.groupBy("world_id").agg(F.count("*").alias("journeys_total"), F.count_if(F.col("first_break") == "").alias("journeys_intact"))
    of_b = tallied(leg_b, "status", "by_status").join(chain.hint("merge"), "world_id", "full_outer").join(tallied(journeys.filter("first_break <> ''"), "first_break", "first_breaks").hint("merge"), "world_id", "left")
    of_b = of_b.select("world_id", F.struct("by_status", "journeys_total", "journeys_intact", "first_breaks").alias("leg_b_summary"))
    items = listed(queue, "queue", [F.col("severity"), -F.col("money_at_risk_paise"), F.col("source"), F.col("status"), F.get("record_ids", F.lit(0)), F.col("item_id")], ITEM)
    samples = listed(first(violations, SAMPLES, "code", "record"), "samples", [F.col("place")], ["code", "record"])
    panel = violations.groupBy("world_id").agg(F.count("*").alias("leg_a")).join(samples.hint("merge"), "world_id").select("world_id", F.struct("leg_a", "samples").alias("verify_panel"))
    totals = queue.groupBy("world_id").agg(F.count("*").alias("queue_total"), *(F.count_if(F.col("severity") == s).alias(f"S{s}") for s in (1, 2, 3))).join(tallied(queue, "source", "by_source").hint("merge"), "world_id")
    totals = totals.select("world_id", F.struct("queue_total", F.struct("S1", "S2", "S3").alias("by_severity"), "by_source").alias("counts"))
    names = lambda df: [c for c in df.columns if c != "world_id"]
    ids = lambda *columns: [F.array_join(F.concat(*columns), ";")]
    a = listed(leg_a, "decisions_a", [F.col("pass_name"), F.col("status"), *ids("settlement_ids", "bank_txn_ids")], names(leg_a))
    b = listed(leg_b, "decisions_b", [F.col("record_type"), F.col("record_id")], names(leg_b))
    parts = reduce(lambda made, part: made.join(part.hint("merge"), "world_id", "left"), [cash, summary, of_b, items, panel, totals, a, b], world)
    none = F.struct(F.lit(0).cast("long").alias("leg_a"), F.array().cast("array<struct<code:string,record:string>>").alias("samples"))
    parts = parts.withColumn("verify_panel", F.coalesce("verify_panel", none)).withColumn("close_date", F.col("cash.close_date"))
    return parts.select("world_id", F.to_json(F.struct("world_id", "close_date", *PARTS)).alias("document"))


def read(documents: DataFrame) -> DataFrame:
    """The documents' parts that readers use, parsed: close_date, cash, queue, verify_panel and counts."""
    item = "item_id:string,source:string,status:string,severity:int,money_at_risk_paise:bigint,record_ids:array<string>,title:string,due_date:string"
    shape = (
        "close_date string, cash struct<n_rows:bigint,movement_paise:bigint,last_txn:string>, recon_summary struct<in_scope:bigint,matched:bigint,matched_paise:bigint>, leg_b_summary struct<by_status:map<string,bigint>,journeys_total:bigint,journeys_intact:bigint>, "
        f"queue array<struct<{item}>>, verify_panel struct<leg_a:bigint,samples:array<struct<code:string,record:string>>>, counts struct<queue_total:bigint,by_severity:struct<S1:bigint,S2:bigint,S3:bigint>,by_source:map<string,bigint>>, decisions_a array<struct<status:string>>, decisions_b array<struct<status:string>>"
    )
    return documents.select("world_id", F.from_json("document", shape).alias("d")).select("world_id", "d.*")
