import random

import pytest

from tallyforge.operators import claims, neighbours
from tallyforge.sources.scratch import Store


def one_by_one(edges):
    taken, got = set(), []
    for world, c_no in sorted({(e[0], e[2]) for e in edges}):
        mine = sorted((e for e in edges if (e[0], e[2]) == (world, c_no) and (world, e[3]) not in taken), key=lambda e: e[4:])
        if mine:
            taken.add((world, mine[0][3]))
            got.append(mine[0])
    return sorted(got)


@pytest.mark.parametrize("seed", [1, 2])
def test_served_like_one_by_one(spark, seed):
    draw, edges = random.Random(seed), set()
    for world in range(60):
        for c in range(draw.randrange(1, 9)):
            for s in draw.sample(range(6), draw.randrange(1, 5)):
                edges.add((world, f"t{c}", c, f"s{s}", draw.randrange(3), s))
    for c in range(40):  # equal lists: all in one round
        edges |= {(60, f"t{c}", c, f"s{s}", 0, s) for s in range(30)}
    edges |= {(61, f"t{c}", c, f"s{c + d}", d, c) for c in range(6) for d in (0, 1)}  # a chain
    rows = sorted(edges)
    df = spark.createDataFrame(rows, "world_id long, tid string, c_no long, sid string, rank_1 long, rank_2 long")
    assert sorted(map(tuple, claims.served(df, Store(spark)).collect())) == one_by_one(rows)
    assert claims.served(df.limit(0), Store(spark)).collect() == []


def merges(rows):
    s_taken, c_taken, got = set(), set(), []
    for world, s_no in sorted({(r[0], r[2]) for r in rows}):
        mine = [r for r in rows if (r[0], r[2]) == (world, s_no)]
        if (world, mine[0][1]) in s_taken or (world, mine[0][3]) in c_taken:
            continue
        left = [r for r in mine if (world, r[4]) not in s_taken]
        if left:
            c_taken.add((world, mine[0][3]))
            if len(left) == 1:
                s_taken |= {(world, mine[0][1]), (world, left[0][4])}
            got += left
    return sorted(got)


@pytest.mark.parametrize("seed", [1, 2])
def test_merged_like_one_by_one(spark, seed):
    draw, rows = random.Random(seed), set()
    for world in range(80):
        for s in draw.sample(range(9), draw.randrange(1, 6)):
            tid = f"t{draw.randrange(5)}"
            rows |= {(world, f"s{s}", s, tid, f"s{p}") for p in draw.sample([x for x in range(9) if x != s], draw.randrange(1, 4))}
    df = spark.createDataFrame(sorted(rows), "world_id long, sid string, s_no long, tid string, partner string")
    assert sorted(map(tuple, claims.merged(df, Store(spark)).collect())) == merges(sorted(rows))


@pytest.mark.parametrize("partitions", ["1", "4", "40"])
def test_nearest_over_borders(spark, partitions):
    draw = random.Random(7)
    rows = [(w, f"r{w}_{k}", k, draw.randrange(0, 400, 7)) for w in range(5) for k in range(0 if w == 3 else draw.randrange(1, 120))]
    asks = [(w, f"a{w}_{k}", draw.randrange(-50, 450)) for w in range(6) for k in range(30)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = neighbours.nearest(spark.createDataFrame(asks, "world_id long, asker string, amount long"), spark.createDataFrame(rows, "world_id long, id string, no long, amount long"), 3, Store(spark)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = []
    for world, asker, amount in asks:
        best = sorted((r for r in rows if r[0] == world), key=lambda r: (abs(r[3] - amount), r[2]))[:3]
        want += [(world, asker, turn, r[1], r[3]) for turn, r in enumerate(best)]
    assert sorted(map(tuple, found)) == sorted(want)
