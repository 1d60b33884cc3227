"""What becomes of a world's open items when proposals answer them one after the other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.proposals import ITEM, View
from tallyforge.operators.statistics import medians
from tallyforge.sources.scratch import Store


def placed(view: View, items: DataFrame) -> DataFrame:
    """Items (world_id, item_id, record_ids) with ``place``, from 1 in each world: those of credits first, then by day and anchor; the anchor is
    an item's first credit, or its first settlement."""
    records = items.select(*ITEM, F.posexplode("record_ids").alias("at", "id"))
    sides = [records.join(df.select("world_id", F.col(key).alias("id"), F.col(day).alias("day")), ["world_id", "id"]).withColumn("side", F.lit(side)) for side, df, key, day in ((0, view.c, "tid", "value_date"), (1, view.s, "sid", "created"))]
    anchors = reduce(DataFrame.unionByName, sides).groupBy(*ITEM).agg(F.min(F.struct("side", "at", "day", "id")).alias("a"))
    order = Window.partitionBy("world_id").orderBy("a.side", "a.day", "a.id", "item_id")
    return items.join(anchors, ITEM).withColumn("place", F.row_number().over(order)).drop("a")


def outcomes(items: DataFrame, answers: DataFrame, store: Store) -> DataFrame:
    """(world_id, item_id, place, outcome) of items (world_id, item_id, record_ids, place) with answers (world_id, item_id, verdict, settlement_ids,
    bank_row_ids), taken in order of place: an item one of whose records an earlier item's match has taken is skipped, one that has
    no explanation is not asked, and the others are proposed, or abstained where the answer is no match.

    An item is certain once no earlier item that is still open could take one of its records. Each round settles all that are, so
    rounds grow with the longest chain of items that wait for each other.
    """
    matches = answers.filter("verdict = 'match'").select(*ITEM, F.explode(F.concat("settlement_ids", "bank_row_ids")).alias("id"))
    takes = matches.join(items.select(*ITEM, "place"), ITEM).select("world_id", F.col("item_id").alias("earlier"), F.col("place").alias("since"), "id")
    named = items.select(*ITEM, "place", F.explode("record_ids").alias("id"))
    edges = store.cut(named.join(takes, ["world_id", "id"]).filter("since < place").select("world_id", "earlier", F.col("item_id").alias("later")).distinct(), "waits")
    skipped = []
    while not edges.isEmpty():
        later = edges.select("world_id", F.col("later").alias("earlier")).distinct()
        sure = edges.join(later, ["world_id", "earlier"], "left_anti")  # nothing that is open stands before these
        gone = store.cut(sure.select("world_id", "later").distinct(), "skipped")
        skipped.append(gone)
        left = edges.join(gone, ["world_id", "later"], "left_anti").join(gone.withColumnRenamed("later", "earlier"), ["world_id", "earlier"], "left_anti")
        edges = store.cut(left, "waits")
    none = items.select("world_id", F.col("item_id").alias("later")).limit(0)
    gone = reduce(DataFrame.unionByName, skipped, none).select("world_id", F.col("later").alias("item_id"), F.lit(True).alias("gone"))
    told = items.select(*ITEM, "place").join(answers.select(*ITEM, "verdict"), ITEM, "left").join(gone, ITEM, "left")
    outcome = F.when(F.col("gone"), "dedupe_skip").when(F.col("verdict") == "exception", "prefilter_skip").when(F.col("verdict") == "match", "proposed").otherwise("abstained")
    return told.select(*ITEM, "place", outcome.alias("outcome"))


def proposal_stats(told: DataFrame, store: Store) -> DataFrame:
    """Per world, of items (world_id, outcome, accepted, wrong, measure): matches proposed, those that the rules reject, those accepted though the
    labels contradict them, items that were asked, and the median of the measure over these."""
    asked = F.col("outcome").isin("proposed", "abstained")
    accepted, wrong = F.coalesce("accepted", F.lit(False)), F.coalesce("wrong", F.lit(False))
    is_match = F.col("outcome") == "proposed"
    counts = told.groupBy("world_id").agg(
        F.count_if(is_match).alias("match_proposals"), F.count_if(is_match & ~accepted).alias("rejected"), F.count_if(is_match & accepted & wrong).alias("wrong_accepted"), F.count_if(asked).alias("items_asked"),
    )
    middle = medians(told.filter(asked), ["world_id"], "measure", store).select("world_id", F.col("median").alias("median_measure"))
    return counts.join(middle, "world_id", "left")
