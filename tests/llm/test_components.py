import random

from tallyforge.llm.common import Scratch
from tallyforge.llm.components import components


def test_like_union_find(spark):
    draw = random.Random(1)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)]
    edges += [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)] + [(2000, k) for k in range(3000, 3050)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {i: root(i) for i in list(parent)}


def test_no_edges(spark):
    assert components(spark.createDataFrame([(1, 1)], "a long, b long"), Scratch(spark, "t")).collect() == []


def test_a_long_ascending_chain_takes_few_rounds(spark):
    scratch = Scratch(spark, "t")
    edges = spark.range(3000).selectExpr("id AS a", "id + 1 AS b")
    got = components(edges, scratch).collect()
    assert len(got) == 3001 and {r.root for r in got} == {0}
    assert sum("picks" in name for name in scratch.written) < 30
