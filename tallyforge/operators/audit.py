"""Auditing a queue against labels, and strategies against each other over many worlds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import grade
from tallyforge.operators.journey import MATCHED

#: Fixed value: a status of the queue that no label has.
SYNTHETIC = "needs_review"


def queue(items: DataFrame, golden: DataFrame) -> DataFrame:
    """Per world, for golden rows (world_id, status, record_id, stake_paise) that a queue should show: how many and how much of the money it
    shows, and how many items a golden row justifies. An item shows a row if it has its status and names its record."""
    named = items.select("world_id", "status", "item_id", F.explode("record_ids").alias("record_id"))
    there = named.select("world_id", "status", "record_id").distinct().withColumn("shown", F.lit(True))
    rows = golden.join(there, ["world_id", "status", "record_id"], "left").withColumn("shown", F.coalesce("shown", F.lit(False)))
    recall = rows.groupBy("world_id").agg(
        F.count("*").alias("worthy"), F.count_if("shown").alias("surfaced"), F.sum("stake_paise").alias("stake_paise"), F.sum(F.when(F.col("shown"), F.col("stake_paise")).otherwise(0)).alias("surfaced_paise"),
    )
    founded = named.join(golden.select("world_id", "status", "record_id"), ["world_id", "status", "record_id"], "left_semi").select("world_id", "item_id", "status").distinct()
    counts = items.groupBy("world_id").agg(F.count("*").alias("items"), F.count_if(F.col("status") != SYNTHETIC).alias("gradable"))
    justified = founded.groupBy("world_id").agg(F.count("*").alias("justified"))
    return recall.join(counts, "world_id", "left").join(justified, "world_id", "left").fillna(0, ["items", "gradable", "justified"])


def missed(items: DataFrame, golden: DataFrame) -> DataFrame:
    """Golden rows that no item shows."""
    named = items.select("world_id", "status", F.explode("record_ids").alias("record_id"))
    return golden.join(named, ["world_id", "status", "record_id"], "left_anti")


def over_worlds(rows: DataFrame, measures: list[str], *keys: str) -> DataFrame:
    """(keys, measure, mean, least, most) of columns of per-world rows; worlds without a value do not count."""
    parts = [rows.groupBy(*keys, F.lit(m).alias("measure")).agg(F.round(F.avg(m), 4).alias("mean"), F.round(F.min(m), 4).alias("least"), F.round(F.max(m), 4).alias("most")) for m in measures]
    return reduce(DataFrame.unionByName, parts)


def queue_rates(audited: DataFrame) -> DataFrame:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return audited.withColumns({"queue_recall": share("surfaced", "worthy"), "money_recall": share("surfaced_paise", "stake_paise"), "queue_precision": share("justified", "gradable")})


def strategies(graded: dict[str, DataFrame]) -> DataFrame:
    """Precision, recall, accuracy and share resolved without a person of each strategy, over its worlds."""
    told = []
    for name, rows in graded.items():
        r = grade.rates(grade.summary(rows, "world_id")).withColumn("auto_rate", F.col("auto_resolved") / F.col("n_rows"))
        told.append(over_worlds(r.withColumn("strategy", F.lit(name)), ["precision", "recall", "accuracy", "auto_rate"], "strategy"))
    return reduce(DataFrame.unionByName, told)


def state(decisions: DataFrame) -> DataFrame:
    """(world_id, record_id, kind, members, tier, explained): what a system did with each record. The earliest decision that names it
    counts; matches that need a review are a person's."""
    first = named(decisions).groupBy("world_id", "record_id").agg(F.min("d").alias("d"))
    return first.select("world_id", "record_id", "d.kind", "d.members", "d.tier", "d.explained")


def named(decisions: DataFrame) -> DataFrame:
    """(world_id, record_id, d): each decision told of each record it names. The least d of a record is its earliest decision."""
    members = F.array_sort(F.concat("settlement_ids", "bank_txn_ids"))
    auto = F.col("status").isin(MATCHED) & F.col("confidence").isin("exact", "high", "medium")
    kind = F.when(auto, "match").when(F.col("status") == "non_settlement_credit", "outside").otherwise("human")
    explained = (F.coalesce("discrepancy_paise", F.lit(0)) == 0) | (F.size("discrepancy_breakdown") > 0) & ~F.exists("discrepancy_breakdown", lambda x: x["label"] == "unexplained")
    fields = ["pass_name", "status", members.alias("members"), kind.alias("kind"), F.col("confidence").alias("tier"), explained.alias("explained")]
    rows = decisions.filter("status <> 'out_of_scope'").select("world_id", F.explode(F.concat("settlement_ids", "bank_txn_ids")).alias("record_id"), *fields)
    return rows.select("world_id", "record_id", F.struct("pass_name", "status", "members", "kind", "tier", "explained").alias("d"))


def apart(accepted: DataFrame) -> DataFrame:
    """Proposals (world_id, settlement_ids, bank_row_ids) of which no other of their world names a record."""
    numbered = accepted.withColumn("members", F.array_sort(F.concat("settlement_ids", "bank_row_ids")))
    shared = numbered.select("world_id", F.explode("members").alias("record_id")).groupBy("world_id", "record_id").count().filter("count > 1")
    clash = numbered.select("world_id", "members", F.explode("members").alias("record_id")).join(shared, ["world_id", "record_id"], "left_semi")
    return numbered.join(clash.select("world_id", "members").distinct(), ["world_id", "members"], "left_anti").select(accepted.columns)


def with_proposals(before: DataFrame, accepted: DataFrame) -> DataFrame:
    """A state in which accepted proposals (world_id, settlement_ids, bank_row_ids, place if there is an order) take the place of what was decided
    about their records. Of two that name a record the later counts for it; without places, the greater by its records."""
    members = F.array_sort(F.concat("settlement_ids", "bank_row_ids"))
    place = F.col("place") if "place" in accepted.columns else F.lit(0)
    named = accepted.select("world_id", F.struct(place.alias("place"), members.alias("members")).alias("p"), F.explode(members).alias("record_id"))
    new = named.groupBy("world_id", "record_id").agg(F.max("p")["members"].alias("proposed"))
    both = before.join(new, ["world_id", "record_id"], "full_outer")
    fresh = F.col("proposed").isNotNull()
    pick = lambda value, old: F.when(fresh, value).otherwise(F.col(old)).alias(old)
    return both.select("world_id", "record_id", pick(F.lit("match"), "kind"), pick(F.col("proposed"), "members"), pick(F.lit("proposal"), "tier"), pick(F.lit(True), "explained"))


def wrong_proposals(golden: DataFrame, proposals: DataFrame) -> DataFrame:
    """(keys, wrong) of proposals (keys, settlement_ids, bank_row_ids): wrong if the label of one of its settlements is no match, or a match of other
    records."""
    members = F.array_sort(F.concat("settlement_ids", "bank_row_ids"))
    due = golden_groups(golden).select("world_id", "record_id", F.when(F.col("expected").isin(MATCHED), F.col("due")).alias("due"))
    of = proposals.select("world_id", "item_id", members.alias("members"), F.explode("settlement_ids").alias("record_id")).join(due, ["world_id", "record_id"], "left")
    return of.groupBy("world_id", "item_id").agg((~F.bool_and(F.coalesce(F.col("due") == F.col("members"), F.lit(False)))).alias("wrong"))


def golden_groups(golden: DataFrame) -> DataFrame:
    """Golden rows with ``due``: all records that belong to the row's match; rows with the same counterparties are one match."""
    together = golden.filter(F.col("expected").isin(MATCHED)).groupBy("world_id", "counterparties").agg(F.collect_list("record_id").alias("ids"))
    together = together.select("world_id", F.explode("ids").alias("record_id"), F.array_sort(F.concat("ids", "counterparties")).alias("due"))
    return golden.join(together, ["world_id", "record_id"], "left")


def categorised(golden: DataFrame, system: DataFrame) -> DataFrame:
    """Golden rows with ``box``: resolved right or wrong without a person, or left to one rightly or wrongly."""
    rows = golden_groups(golden).join(system.hint("merge"), ["world_id", "record_id"], "left")
    return rows.withColumn("box", _box(F.col("kind"), F.col("members"), F.col("explained")))


def _box(kind: Column, members: Column, explained: Column) -> Column:
    due, done = F.col("expected").isin(MATCHED), F.coalesce(kind, F.lit("human"))
    right = F.coalesce(due & (members == F.col("due")) & explained, F.lit(False))
    return F.when((done == "match") & right, "auto_correct").when(done != "human", "auto_wrong").when(due, "wrongly_left").otherwise("rightly_left")


def boxes(systems: dict[str, DataFrame], golden: DataFrame) -> DataFrame:
    """(system, scenario, box, n) of each system over all worlds, and with scenario null the sums."""
    told = [categorised(golden, s).withColumn("system", F.lit(name)) for name, s in systems.items()]
    return _counted(reduce(DataFrame.unionByName, told))


def compared(decisions: dict[str, DataFrame], golden: DataFrame) -> DataFrame:
    """``boxes`` of the states that systems' decisions make. All systems' decisions are dealt and sorted by record together, once, and meet the golden
    rows in one join, however many systems there are."""
    told = reduce(DataFrame.unionByName, [named(df).withColumn("system", F.lit(name)) for name, df in decisions.items()])
    states = told.repartition("world_id", "record_id").groupBy("world_id", "record_id").agg(*(F.min(F.when(F.col("system") == name, F.col("d"))).alias(f"_{name}") for name in decisions))
    of = lambda d: _box(d["kind"], d["members"], d["explained"])
    rows = golden_groups(golden).join(states, ["world_id", "record_id"], "left")
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("system"), of(F.col(f"_{name}")).alias("box")) for name in decisions)))
    return _counted(rows.select("scenario", each.alias("of")).select("of.system", "scenario", "of.box"))


def _counted(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("system", "scenario", "box").agg(F.count("*").alias("n"))
    sets = counts.groupingSets([["system", "scenario", "box"], ["system", "box"]], "system", "scenario", "box")
    return sets.agg(F.sum("n").alias("n"))


def worst(golden: DataFrame, system: DataFrame, amounts: DataFrame, most: int = 10) -> DataFrame:
    """The worst failures of a system: wrong matches first, then matches left to a person; within a kind by amount."""
    rank = F.when(F.col("box") == "auto_wrong", 1).when(F.col("box") == "wrongly_left", 2)
    rows = categorised(golden, system).withColumn("rank", rank).filter("rank IS NOT NULL").join(amounts, ["world_id", "record_id"])
    return rows.orderBy("rank", F.desc("amount_paise"), "world_id", "record_id").limit(most).select("rank", "world_id", "record_id", "scenario", "expected", "box", "amount_paise")


def false_by_tier(golden: DataFrame, system: DataFrame) -> DataFrame:
    return categorised(golden, system).filter("box = 'auto_wrong'").groupBy(F.coalesce("tier", F.lit("none")).alias("tier")).agg(F.count("*").alias("n"))
