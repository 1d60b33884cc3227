"""Connected components by contraction, for graphs of any size.

Each round every vertex picks one among itself and its neighbours, the first in an order that a hash draws anew for the round; edges
are renamed to the picks, and loops and repeats go. Whatever the shape of a component and the order of its ids, a round leaves a
fixed share of its vertices on average, so rounds grow with the logarithm of its size. The picks of all rounds, applied from the last
to the first, name each vertex's component, which then takes the smallest id in it. Rounds are written to the shared folder, so no
plan grows with their number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import Scratch


#: Tasks that a component's vertices are dealt to when they take its smallest id.
SALTS = 32


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(v, root) for each vertex of ``edges`` (a, b, both long): root is the smallest vertex of v's component, v itself included.

    Vertices without an edge to another do not appear. Order, direction and repeats of edges do not matter.
    """
    rounds: list[DataFrame] = []
    edges = scratch.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges-0")
    while True:
        k = len(rounds) + 1
        ways = [edges.select(F.col(x).alias("v"), F.col(y).alias("pick")) for x, y in ("ab", "aa", "ba", "bb")]
        first = F.min_by("pick", F.struct(F.xxhash64("pick", F.lit(k)), "pick"))
        picks = scratch.write(reduce(DataFrame.unionByName, ways).groupBy("v").agg(first.alias("pick")), f"{name}-picks-{k}")
        if not rounds and picks.isEmpty():
            return picks.select("v", F.col("pick").alias("root"))
        rounds.append(picks)
        to_a, to_b = picks.select(F.col("v").alias("a"), F.col("pick").alias("pa")), picks.select(F.col("v").alias("b"), F.col("pick").alias("pb"))
        renamed = edges.join(to_a, "a").join(to_b, "b").filter("pa <> pb")
        following = scratch.write(renamed.select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct(), f"{name}-edges-{k}")
        scratch.drop(f"{name}-edges-{k - 1}")
        edges = following
        if edges.isEmpty():
            break
    named = rounds[-1].select("v", F.col("pick").alias("root"))
    for picks in reversed(rounds[:-1]):
        later = named.select(F.col("v").alias("pick"), "root")
        named = picks.join(later, "pick", "left").select("v", F.coalesce("root", "pick").alias("root"))
    named = scratch.write(named, f"{name}-named")
    least = named.groupBy("root").agg(F.min("v").alias("least"))
    dealt = named.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return scratch.write(dealt.join(least, ["root", "salt"]).select("v", F.col("least").alias("root")), name)
