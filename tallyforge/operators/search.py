"""Questions about a world's records, asked many at a time: a question is a row, and its answers are capped with a flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import scalars as X
from tallyforge.operators.proposals import held

#: Most rows of an answer, most decisions, days of a search, days on each side of a statement's window, grid hits.
MOST_ROWS, MOST_DECISIONS, SPAN_DAYS, SIDE_DAYS, MOST_HITS = 40, 5, 31, 10, 20
#: Fixed value: days around an anchor in which neighbours of the same kind count.
NEIGHBOUR_DAYS = 5
ASKED = ["world_id", "question"]


def capped(hits: DataFrame, order: list[str | Column], most: int) -> DataFrame:
    """The first ``most`` hits of each question by ``order``, and whether there are more."""
    mine = Window.partitionBy(*ASKED)
    placed = hits.withColumn("place", F.row_number().over(mine.orderBy(*order))).withColumn("truncated", F.count("*").over(mine) > most)
    return placed.filter(F.col("place") <= most)


def clamped(questions: DataFrame) -> DataFrame:
    """(low, high) for date_from and date_to: in order, and no more than SPAN_DAYS apart."""
    low = F.least("date_from", "date_to")
    return questions.withColumns({"low": low, "high": F.least(F.greatest("date_from", "date_to"), F.date_add(low, SPAN_DAYS))})


def on_days(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (world_id, day, ...) on each question's days from low to high, by an equality join on the day."""
    return questions.withColumn("day", F.explode(F.sequence("low", "high"))).drop("low", "high").join(rows, ["world_id", "day"])


def unclaimed(rows: DataFrame, claimed: DataFrame) -> DataFrame:
    return rows.join(claimed.select("world_id", "record_id"), ["world_id", "record_id"], "left_anti")


def settlements_of(settlements: DataFrame) -> DataFrame:
    return settlements.select("world_id", F.col("settlement_id").alias("record_id"), F.col("created").alias("day"), "amount_paise", F.concat_ws(" ", "settlement_id", "utr").alias("text"))


def credits_of(bank_rows: DataFrame) -> DataFrame:
    return bank_rows.filter("credit_paise > 0").select("world_id", F.col("txn_id").alias("record_id"), F.col("value_date").alias("day"), F.col("credit_paise").alias("amount_paise"), F.concat_ws(" ", "narration", "ref_no").alias("text"))


def ranged(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """Answers to (world_id, question, date_from, date_to, least_paise, most_paise, contains) among open rows: by day and id. A bound of 0
    is none; letters' case does not count."""
    met = on_days(clamped(questions), rows)
    amount, needle = F.col("amount_paise"), F.upper(F.trim("contains"))
    fits = ((F.col("least_paise") == 0) | (amount >= F.col("least_paise"))) & ((F.col("most_paise") == 0) | (amount <= F.col("most_paise")))
    met = met.filter(fits & ((needle == "") | F.contains(F.upper("text"), needle)))
    return capped(met, ["day", "record_id"], MOST_ROWS).select(*ASKED, "place", "record_id", "day", "amount_paise", "truncated")


def looked_up(questions: DataFrame, bank_rows: DataFrame, claimed: DataFrame) -> DataFrame:
    """The credit that each question's record_id names, whether it is known, and whether it is claimed already."""
    known = credits_of(bank_rows).withColumn("known", F.lit(True))
    taken = claimed.select("world_id", "record_id").distinct().withColumn("taken", F.lit(True))
    told = questions.join(known, ["world_id", "record_id"], "left").join(taken, ["world_id", "record_id"], "left")
    return told.select(*ASKED, "record_id", "day", "amount_paise", "text", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("taken", F.lit(False)).alias("claimed"))


def mentions(questions: DataFrame, leg_a: DataFrame, leg_b: DataFrame) -> DataFrame:
    """Decisions in which some text holds each question's ``needle``; those of leg A first."""
    names = F.transform("candidates", lambda x: F.concat_ws("\n", x["record_id"], x["reason"]))
    a = leg_a.select("world_id", F.lit("leg_a").alias("pool"), "status", F.concat_ws("\n", "kind", "status", "confidence", "pass_name", "settlement_ids", "bank_txn_ids", "rules", names).alias("text"), F.array_join(F.concat("settlement_ids", "bank_txn_ids"), ";").alias("records"))
    b = leg_b.select("world_id", F.lit("leg_b").alias("pool"), "status", F.concat_ws("\n", "record_type", "record_id", "status", "counterparty_ids", "rule", "candidates").alias("text"), F.col("record_id").alias("records"))
    hits = held(a.unionByName(b), "text", questions, "needle")
    return capped(hits, ["pool", "records", "status"], MOST_DECISIONS).select(*ASKED, "place", "pool", "status", "records", "truncated")


def statement_window(questions: DataFrame, bank_rows: DataFrame) -> DataFrame:
    """Statement rows around each question's day (world_id, question, around, before, after), each side at most SIDE_DAYS, in source order."""
    side = lambda c: F.least(F.greatest(F.col(c), F.lit(0)), F.lit(SIDE_DAYS))
    asked = questions.select(*ASKED, F.date_sub("around", side("before")).alias("low"), F.date_add("around", side("after")).alias("high"))
    met = on_days(asked, bank_rows.withColumnRenamed("value_date", "day"))
    return capped(met, ["row_no"], MOST_ROWS).select(*ASKED, "place", "txn_id", "day", "narration", "debit_paise", "credit_paise", "truncated")


def item_context(items: DataFrame, open_settlements: DataFrame, open_credits: DataFrame) -> DataFrame:
    """Open records near each item's anchor (world_id, question, side, anchor). A credit may come up to X.WINDOW_DAYS after its settlement;
    records of the item's own kind count within NEIGHBOUR_DAYS."""
    credit = F.col("side") == "credit"
    found = []
    for kind, rows in (("settlement", open_settlements), ("credit", open_credits)):
        own = F.col("side") == kind
        before = F.when(own, NEIGHBOUR_DAYS).when(credit, X.WINDOW_DAYS).otherwise(0)
        after = F.when(own, NEIGHBOUR_DAYS).when(credit, 0).otherwise(X.WINDOW_DAYS)
        asked = items.select(*ASKED, F.date_sub("anchor", before).alias("low"), F.date_add("anchor", after).alias("high"))
        near = capped(on_days(asked, rows), ["day", "record_id"], MOST_ROWS)
        found.append(near.select(*ASKED, F.lit(kind).alias("kind"), "place", "record_id", "day", "amount_paise", "truncated"))
    return found[0].unionByName(found[1])


def grid_peek(cells: DataFrame, start: int, count: int) -> DataFrame:
    return cells.filter(F.col("row_no").between(start, start + min(max(count, 0), MOST_ROWS) - 1))


def grid_search(cells: DataFrame, needle: str) -> DataFrame:
    """The first rows of a grid whose joined cells hold ``needle``, and whether there are more. Letters' case does not count."""
    hits = cells.filter(F.contains(F.lower(F.array_join("cells", " | ")), F.lit(needle.lower())))
    placed = hits.orderBy("row_no").limit(MOST_HITS + 1)
    return placed.withColumn("truncated", F.lit(placed.count() > MOST_HITS)).orderBy("row_no").limit(MOST_HITS)
