import numpy as np
import pytest

from tallyforge.llm import neardup
from tallyforge.llm.common import Scratch


def brute(rows):
    ok = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent = {i: i for i, _, _ in rows if i is not None}
    links = dict.fromkeys(parent, 0)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a, la) in enumerate(ok):
        for j, b, lb in ok[:x]:
            if la == lb and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                links[i] += 1
                links[j] += 1
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return {i: (links[i], root(i), root(i) == i) for i in parent}


@pytest.mark.parametrize("block", [1000, 7])
def test_like_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    draw = np.random.default_rng(block)
    rows = []
    for k in range(60):
        base = draw.standard_normal(32)
        for _ in range(int(draw.integers(1, 8))):
            rows.append((len(rows), (base + draw.standard_normal(32) * draw.choice([0, 0.05, 0.12])).tolist(), int(k % 3)))
    hot = draw.standard_normal(32)
    rows += [(1000 + k, (hot + draw.standard_normal(32) * 0.04).tolist(), 1) for k in range(120)]
    rows += [(2000 + k, hot.tolist(), 1) for k in range(30)] + [(3000, hot.tolist(), 2), (3001, (hot * 3).tolist(), 2)]
    rows += [(4000, None, 1), (4001, [], 1), (4002, [0.0] * 32, 1), (4003, [None] * 32, 1), (4004, [float("nan")] * 32, 1), (4005, hot.tolist(), None), (4006, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<float>, label int, kept string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(df, Scratch(spark, "t")).collect()}
    expected = brute(rows)
    found = sum(got[i][0] for i in expected)
    assert found >= 0.99 * sum(e[0] for e in expected.values())
    assert all(got[i][0] <= expected[i][0] for i in expected)
    assert sum(got[i] == expected[i] for i in expected) >= 0.98 * len(expected)


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (5, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted((tuple(r) for r in neardup.near_duplicates(df, Scratch(spark, "t")).collect()), key=str)
    assert got == [(5, 0, 5, True), (None, 0, None, False)]
    assert neardup.near_duplicates(df.limit(0), Scratch(spark, "t")).collect() == []


def test_copies_near_one_base_only(spark):
    """Copies at cosine 0.983 of one base are far from each other; only the base links them."""
    draw = np.random.default_rng(5)
    base = draw.standard_normal(64)
    base /= np.linalg.norm(base)
    off = draw.standard_normal((3000, 64))
    off -= np.outer(off @ base, base)
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    copies = 0.983 * base + np.sqrt(1 - 0.983**2) * off
    rows = [(0, base.tolist(), 1)] + [(1 + k, v.tolist(), 1 if k < 2500 else 2) for k, v in enumerate(copies)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in neardup.near_duplicates(df, Scratch(spark, "t")).collect()}
    held = np.array([v for _, v, lab in rows if lab == 1], np.float32).astype(float)
    held /= np.linalg.norm(held, axis=1, keepdims=True)
    links = (held @ held.T >= 0.98).sum(axis=1) - 1
    assert links[0] == 2500 and np.median(links[1:]) < 10
    assert [got[i] for i in range(2501)] == [(n, 0) for n in links]


def planted(seed):
    """Groups of many sizes, widths and labels: stars whose copies only the base links, dense groups, lone pairs, and noise."""
    draw = np.random.default_rng(seed)
    rows = []

    def near(base, cosine, n):
        base = base / np.linalg.norm(base)
        off = draw.standard_normal((n, len(base)))
        off -= np.outer(off @ base, base)
        off /= np.linalg.norm(off, axis=1, keepdims=True)
        return cosine * base + np.sqrt(1 - cosine**2) * off

    for width in (16, 64):
        for label in range(3):
            found = [draw.standard_normal((150, width))]
            for size, cosine in ((150, 0.982), (40, 0.995), (12, 0.985)):
                base = draw.standard_normal(width)
                found += [base[None, :], near(base, cosine, size)]
            for _ in range(25):
                base = draw.standard_normal(width)
                found += [base[None, :], near(base, 0.9805, 1)]
            rows += [(v.tolist(), label) for v in np.concatenate(found)]
    draw.shuffle(rows)
    return [(i, v, lab) for i, (v, lab) in enumerate(rows)]


def test_recall_and_same_rows_for_any_partitioning(spark, monkeypatch):
    """Small windows and blocks, so that borders and widening count; the rows do not depend on the number of partitions."""
    for name, value in (("WINDOW", 8), ("SPAN", 16), ("ASKING", 32), ("BLOCK", 20)):
        monkeypatch.setattr(neardup, name, value)
    rows, told = planted(3), []
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        told.append({r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(df.repartition(int(n)), Scratch(spark, "t")).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert told[0] == told[1]
    expected = brute(rows)
    assert all(told[0][i][0] <= expected[i][0] for i in expected)
    found, due = sum(v[0] for v in told[0].values()), sum(v[0] for v in expected.values())
    assert due > 5000 and found >= 0.95 * due
    assert sum(told[0][i] == expected[i] for i in expected) >= 0.95 * len(expected)


def test_each_row_of_a_repeated_id_is_a_vector(spark):
    rows = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (5, [1.0, 0.0], 1), (7, [0.0, 2.0], 1), (9, [1.0, 0.05], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in neardup.near_duplicates(df, Scratch(spark, "t")).collect())
    assert got == [(5, 1, 5, True), (5, 2, 5, True), (5, 2, 5, True), (7, 1, 5, False), (9, 2, 5, False)]
