import math
import random

import pytest

from tallyforge.llm import topk


def brute(rows, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    for q, a in ok:
        if q % 10 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q and len(b) == len(a))[:k]
            for rank, (score, i) in enumerate(found, 1):
                yield q, rank, i, -score


@pytest.mark.parametrize("block", [16384, 50])
def test_like_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    draw = random.Random(8)
    rows = [(i, [draw.gauss(0, 0.2) for _ in range(16)]) for i in range(300)]
    rows += [(300 + i, rows[i % 3][1]) for i in range(40)]  # ties
    rows += [(400, None), (410, []), (420, [1.0, None] + [0.0] * 14), (430, [float("nan")] * 16), (440, [float("inf")] * 16), (450, [0.0] * 16), (460, [1.0] * 4), (None, [1.0] * 16), (461, [0.5] * 4)]
    rows = [(i, v and [None if x is None else float(__import__("numpy").float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = sorted(tuple(r) for r in topk.search(df, df.filter("vec_id % 10 = 0")).collect())
    assert got == sorted(brute(rows, 10))


def test_stops_early_on_proof():
    import numpy as np

    draw = np.random.default_rng(1)
    vectors = np.floor(draw.standard_normal((4000, 64)) * 100).astype(np.int64)
    vectors[17] = vectors[5] + 1
    ids, scores = topk.Index(np.arange(4000), vectors).search(vectors[5], 5, 1)
    assert ids.tolist() == [17] and scores[0] == vectors[17] @ vectors[5]
    assert topk.Index(np.arange(4000), vectors).search(vectors[5], 5, 3, int(scores[0]) + 1)[0].tolist() == []


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(df, df).collect() == []


def test_repeated_queries_are_one_and_other_vectors_of_an_id_are_others(spark):
    rows = [(10, [1.0, 0.0]), (10, [1.0, 0.0]), (10, [0.0, 1.0]), (1, [0.5, 0.0]), (2, [0.0, 0.5]), (2, [0.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.search(df, df.filter("vec_id = 10"), 3).collect()]
    half = 512 * 1024
    assert sorted(got) == sorted([(10, 1, 1, half), (10, 2, 2, 0), (10, 3, 2, 0), (10, 1, 2, half), (10, 2, 2, half), (10, 3, 1, 0)])


def test_too_large_components_are_an_error(spark):
    df = spark.createDataFrame([(10, [1e30, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        topk.search(df, df).collect()
