"""Which of many names stand in which of many texts, by equality joins and one scan of the texts whatever the names' lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names, or first letters of names, of a world up to which they are compared with a text before it is cut.
FEW = 16
#: Letters of a name's first ones.
HEAD = 4


def seed_length(name: str) -> Column:
    """The largest power of two that is no longer than a name."""
    return F.expr(f"shiftleft(1, length(bin(length(`{name}`))) - 1)")


def meets(texts: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """Pairs of ``texts`` (world_id, keys, the text) and ``names`` (world_id, keys, the name) of one world in which the text holds the name's first
    characters, a power of two of them. Callers test the rest; a pair comes once. Empty names meet nothing.

    Names have few seed lengths, as these are powers of two. A text is cut once, see ``cut``.
    """
    keyed = names.filter(F.col(name) != "").withColumn("_size", seed_length(name)).withColumn("_seed", F.expr(f"left(`{name}`, _size)"))
    return cut(texts, text, keyed).join(keyed, ["world_id", "_seed"]).filter(F.length("_seed") == F.col("_size")).drop("_seed", "_size")


def cut(texts: DataFrame, text: str, keyed: DataFrame) -> DataFrame:
    """``texts`` without the text, a row for each distinct substring ``_seed`` of the lengths that the names of its world, ``keyed`` (world_id, _size,
    _seed), have. Substrings that are no name's first characters are left out where that is cheap: a world with up to ``FEW`` names has these tested
    each, one whose names begin in up to ``FEW`` ways has only substrings that begin so.
    """
    head = lambda seed: F.substring(seed, 1, HEAD)
    mine = Window.partitionBy("world_id").orderBy("_seed")
    told = keyed.select("world_id", "_size", "_seed", F.row_number().over(mine).alias("_turn"), F.dense_rank().over(Window.partitionBy("world_id").orderBy(head("_seed"))).alias("_way"))
    few = lambda place, value: F.when(F.max(place) <= FEW, F.collect_set(F.when(F.col(place) <= FEW, value)))
    known = told.groupBy("world_id").agg(F.collect_set("_size").alias("_sizes"), few("_turn", F.col("_seed")).alias("_seeds"), few("_way", head("_seed")).alias("_heads"))
    whole = F.col(text)
    begins = lambda i, n: F.col("_heads").isNull() | F.array_contains("_heads", F.substr(whole, i, F.least(n, F.lit(HEAD))))
    places = lambda n: F.filter(F.sequence(F.lit(1), F.length(whole) - n + 1), lambda i: begins(i, n))
    grams = lambda n: F.when(F.length(whole) >= n, F.transform(places(n), lambda i: F.substr(whole, i, n))).otherwise(F.array().cast("array<string>"))
    tested = F.filter("_seeds", lambda seed: F.contains(whole, seed))
    seeds = F.when(F.col("_seeds").isNotNull(), tested).otherwise(F.array_distinct(F.flatten(F.transform("_sizes", grams))))
    # With ``explode`` the planner asks first whether there is any seed, and cuts each text once more for it.
    told = texts.join(known, "world_id").withColumn("_seed", F.explode_outer(seeds)).drop("_sizes", "_seeds", "_heads", text)
    return told.filter(F.col("_seed").isNotNull())
