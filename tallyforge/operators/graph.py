"""Connected components of records that links join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.sources.scratch import Store


def components(edges: DataFrame, store: Store) -> DataFrame:
    """(id, component) of each vertex of ``edges`` (a, b): the smallest id that links reach.

    Every round, each vertex takes the smallest label among itself and its neighbours, and then its label's label; paths halve
    as the rounds go on. A round's labels are written, so no plan grows.
    """
    both = store.cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = store.cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("id"), "label"), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("label").alias("seen")), "b").groupBy("a").agg(F.min("seen").alias("seen"))
        stepped = labels.join(near, F.col("id") == F.col("a"), "left").select("id", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("jump"))
        following = store.cut(stepped.join(jump, "label", "left").select("id", F.least("label", "jump").alias("label"), (F.least("label", "jump") != F.col("old")).alias("moved")), "labels")
        if following.filter("moved").isEmpty():
            return following.select("id", F.col("label").alias("component"))
        labels = following.drop("moved")
