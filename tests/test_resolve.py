import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import audit, resolve
from tallyforge.operators.statistics import medians
from tallyforge.sources.scratch import Store

ITEMS = "world_id long, item_id string, record_ids array<string>, place long"
ANSWERS = "world_id long, item_id string, verdict string, settlement_ids array<string>, bank_row_ids array<string>"


def one_by_one(items, answers):
    got, taken, by = {}, set(), {a[:2]: a for a in answers}
    for world, item, records, _ in sorted(items, key=lambda i: (i[0], i[3])):
        _, _, verdict, sids, tids = by[world, item]
        if any((world, r) in taken for r in records):
            got[world, item] = "dedupe_skip"
            continue
        got[world, item] = {"exception": "prefilter_skip", "match": "proposed"}.get(verdict, "abstained")
        if verdict == "match":
            taken |= {(world, r) for r in sids + tids}
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_items_like_one_by_one(spark, seed):
    draw, items, answers = random.Random(seed), [], []
    for world in range(40):
        for k in range(draw.randrange(1, 10)):
            items.append((world, f"i{k}", [f"r{x}" for x in draw.sample(range(8), draw.randrange(1, 3))], k + 1))
            hit = draw.random() < 0.7
            answers.append((world, f"i{k}", "match" if hit else draw.choice(["abstain", "exception"]), [f"r{x}" for x in draw.sample(range(8), 2)] if hit else [], [f"c{k}"] if hit else []))
    got = resolve.outcomes(spark.createDataFrame(items, ITEMS), spark.createDataFrame(answers, ANSWERS), Store(spark)).collect()
    assert {(r.world_id, r.item_id): r.outcome for r in got} == one_by_one(items, answers)


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_medians_over_borders(spark, partitions):
    draw = random.Random(5)
    rows = [(k, draw.choice([None, 1.0, 2.0, draw.random()])) for k in range(4) for _ in range(1 if k == 3 else draw.randrange(2, 90))] + [(9, None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows, "k long, v double")
        got = {r.k: (r.n, r.median) for r in medians(df, ["k"], "v", Store(spark)).collect()}
        whole = medians(df, [], "v", Store(spark)).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    by = {k: [v for x, v in rows if x == k and v is not None] for k in (0, 1, 2, 3)}
    assert got == {k: (len(v), pytest.approx(statistics.median(v))) for k, v in by.items() if v}
    values = [v for _, v in rows if v is not None]
    assert (whole.n, whole["median"]) == (len(values), pytest.approx(statistics.median(values)))


def test_proposals_that_share_a_record_fall_and_the_later_of_two_counts(spark):
    schema = "world_id long, settlement_ids array<string>, bank_row_ids array<string>, place long"
    df = spark.createDataFrame([(0, ["a"], ["x"], 1), (0, ["b"], ["x"], 2), (0, ["c"], ["y"], 3), (1, ["a"], ["x"], 1)], schema)
    assert sorted((r.world_id, r.place) for r in audit.apart(df).collect()) == [(0, 3), (1, 1)]
    before = spark.createDataFrame([], "world_id long, record_id string, kind string, members array<string>, tier string, explained boolean")
    after = {(r.world_id, r.record_id): list(r.members) for r in audit.with_proposals(before, df.orderBy(F.rand(3))).collect()}
    assert after[0, "x"] == ["b", "x"] and after[0, "a"] == ["a", "x"] and after[1, "x"] == ["a", "x"]


def test_wrong_proposals(spark):
    golden = spark.createDataFrame([(0, "s1", "matched_merged", ["t1"]), (0, "s2", "matched_merged", ["t1"]), (0, "s3", "exception_missing_bank", [])], "world_id long, record_id string, expected string, counterparties array<string>")
    p = spark.createDataFrame([(0, "whole", ["s1", "s2"], ["t1"]), (0, "half", ["s1"], ["t1"]), (0, "none", ["s3"], ["t1"])], "world_id long, item_id string, settlement_ids array<string>, bank_row_ids array<string>")
    assert {r.item_id: r.wrong for r in audit.wrong_proposals(golden, p).collect()} == {"whole": False, "half": True, "none": True}


def test_sums_leave_no_partial_sums_behind(spark, tmp_path):
    """What a search writes are its pools; sets come in blocks however many there are."""
    import itertools
    import math
    import os

    import numpy as np

    from tallyforge.operators import proposals

    blocks = list(proposals.sets_of(np.full(28, 7, np.int64), 42, 6))
    assert sum(map(len, blocks)) == math.comb(28, 6) and max(map(len, blocks)) <= 2 * proposals.BLOCK
    assert len({tuple(row) for block in blocks for row in block.tolist()}) == math.comb(28, 6)
    amounts = np.array([5, 1, 4, 2, 3, 9, 8, 7], np.int64)
    got = sorted(tuple(row) for block in proposals.sets_of(amounts, 15, 5) for row in block.tolist())
    assert got == sorted(c for n in range(1, 6) for c in itertools.combinations(range(8), n) if amounts[list(c)].sum() == 15)
    store = Store(spark)
    asks = spark.createDataFrame([(0, "i", 0, 1500, 6)], "world_id long, item_id string, ask int, need long, slots int")
    pool = spark.createDataFrame([(0, "i", 0, f"r{k:02}", 200 + k) for k in range(40)], "world_id long, item_id string, ask int, id string, amount long")
    assert proposals.summing(asks, pool, store)[0].count() > 0
    assert {name.rsplit("-", 1)[0] for name in os.listdir(store.root.removeprefix("file://"))} == {"pool", "sizes"}
