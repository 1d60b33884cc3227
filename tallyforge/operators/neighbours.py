"""The nearest rows by a number, over all partitions: a sorted join without a window or task that holds a world."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.sources.scratch import Store

#: Bits of a row's number within its partition, as ``monotonically_increasing_id`` makes them.
BITS = 33


def nearest(askers: DataFrame, rows: DataFrame, k: int, store: Store) -> DataFrame:
    """(world_id, asker, turn, id, amount): for each of ``askers`` (world_id, asker, amount) the k of ``rows`` (world_id, id, no, amount) of
    its world that are nearest in amount, the smaller no first at equal distance; turn counts from 0.

    Of the rows of one amount only the k first can count, so they are one entry. Entries and the amounts that ask are sorted by range together; an
    entry's place is its partition's first place, known from counts, and how many stand before it there. An amount then meets k
    entries below and k above by their places, wherever a border between partitions runs.
    """
    first = F.row_number().over(Window.partitionBy("world_id", "amount").orderBy("no"))
    entries = rows.withColumn("turn", first).filter(F.col("turn") <= k).groupBy("world_id", "amount").agg(F.array_sort(F.collect_list(F.struct("no", "id"))).alias("held"))
    asked = askers.select("world_id", "amount").distinct()
    both = entries.select("world_id", "amount", F.lit(True).alias("entry"), "held").unionByName(asked.select("world_id", "amount", F.lit(False).alias("entry"), F.lit(None).cast(entries.schema["held"].dataType).alias("held")))
    keys = [F.col("world_id"), F.col("amount"), F.desc("entry")]
    lined = store.cut(both.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "lined")
    lined = lined.withColumn("part", F.shiftright("at", BITS))
    starts, before = [], 0
    for part, n in sorted(lined.groupBy("part").agg(F.count_if("entry").alias("n")).collect()):
        starts.append((part, before))
        before += n
    starts = lined.sparkSession.createDataFrame(starts, "part long, start long")
    sofar = F.count_if("entry").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    placed = lined.withColumn("sofar", sofar).join(F.broadcast(starts), "part").select("world_id", "amount", "entry", "held", (F.col("start") + F.col("sofar")).alias("place"))
    asking = placed.filter("NOT entry").select("world_id", F.col("amount").alias("own"), F.explode(F.sequence(F.col("place") - (k - 1), F.col("place") + k)).alias("place"))
    met = asking.join(placed.filter("entry").drop("entry"), ["place", "world_id"]).select("world_id", "own", "amount", F.explode("held").alias("row"))
    turn = F.row_number().over(Window.partitionBy("world_id", "own").orderBy(F.abs(F.col("amount") - F.col("own")), "row.no")) - 1
    best = met.withColumn("turn", turn).filter(F.col("turn") < k).select("world_id", "own", "turn", "row.id", "amount")
    return askers.withColumnRenamed("amount", "own").join(best, ["world_id", "own"]).select("world_id", "asker", "turn", "id", "amount")
