import math

import numpy as np
import pytest

from tallyforge.llm import ann
from tallyforge.llm.common import Scratch


def fit(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, asks, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and fit(v)]
    found = {}
    for q, a in ok:
        if asks(q):
            scored = sorted((-float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)), i) for i, b in ok if i != q and len(b) == len(a))[:k]
            found[q, tuple(a)] = [(rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return found


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<float>, score string")


def search(spark, rows, asks="vec_id % 10 = 0", k=5):
    df = frame(spark, rows)
    got = {}
    for r in ann.search(df, df.filter(asks), Scratch(spark, "ann"), k).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(r) for q, r in got.items()}


def as_floats(draw, n, width):
    return [[float(x) for x in v] for v in draw.standard_normal((n, width)).astype(np.float32)]


def test_small_tables_nulls_ties_copies_and_widths(spark, monkeypatch):
    monkeypatch.setattr(ann, "FIRST", 64)  # every list at once, and no bound when they are scanned: exact
    monkeypatch.setattr(ann, "DOUBT", 1e9)
    draw = np.random.default_rng(1)
    rows = list(enumerate(as_floats(draw, 300, 16)))
    rows += [(300 + i, rows[i % 3][1]) for i in range(40)]  # copies
    rows += [(341, [2 * x for x in rows[0][1]]), (342, [x * 2.0**80 for x in rows[0][1]]), (350, [-0.0] + rows[0][1][1:]), (351, [0.0] + rows[0][1][1:])]
    rows += [(400, None), (410, []), (420, [1.0, None] + [0.0] * 14), (430, [float("nan")] * 16), (440, [float("inf")] * 16), (450, [0.0] * 16), (460, [1.0] * 4), (None, [1.0] * 16), (461, [0.5] * 4)]
    got, want = search(spark, rows), brute(rows, lambda q: q % 10 == 0, 5)
    assert set(got) == {q for q, _ in want}
    for (q, _), best in want.items():
        assert [r for r, _, _ in got[q]] == [r for r, _, _ in best]
        assert np.allclose([s for _, _, s in got[q]], [s for _, _, s in best], atol=1e-12)
        if abs(best[-1][2] - 1) > 1e-9:
            assert [i for _, i, _ in got[q]] == [i for _, i, _ in best]
    assert [i for _, i, _ in got[300]] == sorted(i for _, i, _ in got[300])  # its copies, smallest first


def test_repeated_ids(spark):
    rows = [(10, [1.0, 0.0]), (10, [1.0, 0.0]), (10, [0.0, 1.0]), (1, [0.5, 0.0]), (2, [0.0, 0.5]), (2, [0.0, 0.5])]
    df = frame(spark, rows)
    got = sorted(tuple(r) for r in ann.search(df, df.filter("vec_id = 10"), Scratch(spark, "ann"), 3).collect())
    assert got == sorted([(10, 1, 1, 1.0), (10, 2, 2, 0.0), (10, 3, 2, 0.0), (10, 1, 2, 1.0), (10, 2, 2, 1.0), (10, 3, 1, 0.0)])


@pytest.mark.parametrize("kind", ["without structure", "clusters", "one dense group"])
def test_recall(spark, monkeypatch, kind):
    monkeypatch.setattr(ann, "PART", 60)
    draw = np.random.default_rng(2)
    vectors = draw.standard_normal((4000, 48))
    if kind == "clusters":
        vectors = vectors * 0.4 + draw.standard_normal((40, 48))[draw.integers(0, 40, 4000)]
    elif kind == "one dense group":
        vectors[:1500] = vectors[0] + vectors[:1500] * 0.05
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors.astype(np.float32))]
    got, want = search(spark, rows, "vec_id % 20 = 0"), brute(rows, lambda q: q % 20 == 0, 5)
    share = [len({i for _, i, _ in got[q]} & {i for _, i, _ in best}) / 5 for (q, _), best in want.items()]
    assert np.mean(share) >= 0.93, np.mean(share)
    assert all(len(got[q]) == 5 for q, _ in want)


def test_dense_regions_are_answered_from_few_lists():
    draw = np.random.default_rng(3)
    centre = draw.standard_normal((64, 32))
    lists = ann.Lists(ann.unit(centre))
    lists.rows[:], lists.mean[:], lists.spread[:] = 1000, 0.95, 0.1
    assert len(lists.others(ann.unit(centre[:1])[0], 0.97, 8, 0.15)) < 10
    assert len(lists.others(ann.unit(centre[:1])[0], 0.1, 8, 0.15)) > 30


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search(df, df, Scratch(spark, "ann")).collect() == []
