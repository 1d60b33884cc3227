"""Claims on records that only one can have, served as if one after the other, in rounds over all of them at once.

A round settles every claim whose outcome no earlier open claim can change, takes what it takes out of the rest, and the next round goes on
with what is left. The first open claim of any tangle is always settled, so rounds end; how many there are grows with the longest chain
of claims that wait for each other, not with the number of claims or worlds. A round is joins and windows by claim and by record: no
task holds a world, and none a tangle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.sources.scratch import Store


def served(edges: DataFrame, store: Store) -> DataFrame:
    """The edges (world_id, tid, c_no, sid, rank_1, rank_2, more) that serving credits in the order of c_no makes: each takes the best by rank
    of its settlements that is still open.

    An edge is certain if it is the credit's best and no earlier credit wants the settlement. Where all credits that want any settlement of a
    list have that very list, the k-th credit gets the k-th of it, so ties of many equal amounts take one round.
    """
    of_credit, of_settlement = Window.partitionBy("world_id", "tid"), Window.partitionBy("world_id", "sid")
    columns, found = edges.columns, []
    while True:
        told = edges.withColumn("choice", F.row_number().over(of_credit.orderBy("rank_1", "rank_2")))
        told = told.withColumn("list", F.bit_xor(F.xxhash64("sid", "choice")).over(of_credit))
        told = told.withColumn("turn", F.row_number().over(of_settlement.orderBy("c_no")))
        told = told.withColumn("alike", F.min("list").over(of_settlement) == F.max("list").over(of_settlement))
        closed = F.min("alike").over(of_credit)
        sure = (closed & (F.col("turn") == F.col("choice"))) | ((F.col("choice") == 1) & (F.col("turn") == 1))
        told = store.cut(told.withColumn("sure", sure).select(*columns, "sure"), "claims")
        sure, open_ = told.filter("sure").select(columns), told.filter("NOT sure").select(columns)
        found.append(sure)
        edges = open_.join(sure.select("world_id", "tid"), ["world_id", "tid"], "left_anti").join(sure.select("world_id", "sid"), ["world_id", "sid"], "left_anti").select(columns)
        if edges.isEmpty():
            return reduce(DataFrame.unionByName, found)


def merged(rows: DataFrame, store: Store) -> DataFrame:
    """Rows (world_id, sid, s_no, tid, partner, more), a pair with each settlement that would make its credit whole, as pairs are dealt with in
    the order of s_no: the rows of a pair whose partner is the only open one, which takes both settlements and the credit; all rows of
    one with several open partners, which takes the credit only. A pair of which a side is taken, or all partners, has no rows.

    A pair is certain if it comes first among all open pairs that name any of its records.
    """
    columns, found = rows.columns, []
    of_pair = Window.partitionBy("world_id", "s_no")
    while True:
        names = F.array(F.concat(F.lit("s"), F.col("sid")), F.concat(F.lit("s"), F.col("partner")), F.concat(F.lit("c"), F.col("tid")))
        used = rows.select("world_id", "s_no", F.explode(names).alias("used")).distinct()
        waits = used.withColumn("first", F.min("s_no").over(Window.partitionBy("world_id", "used"))).filter("first < s_no").select("world_id", "s_no").distinct()
        told = rows.join(waits.withColumn("waits", F.lit(True)), ["world_id", "s_no"], "left").withColumn("n", F.count("*").over(of_pair))
        told = store.cut(told.select(*columns, F.col("waits").isNull().alias("sure"), "n"), "pairs")
        sure, open_ = told.filter("sure"), told.filter("NOT sure").select(columns)
        found.append(sure.select(columns))
        merges = sure.filter("n = 1")
        gone = merges.select("world_id", F.explode(F.array("sid", "partner")).alias("sid")).distinct()
        rows = open_.join(sure.select("world_id", "tid").distinct(), ["world_id", "tid"], "left_anti").join(gone, ["world_id", "sid"], "left_anti")
        rows = rows.join(gone.withColumnRenamed("sid", "partner"), ["world_id", "partner"], "left_anti").select(columns)
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, found)
