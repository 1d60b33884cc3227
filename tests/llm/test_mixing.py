import pytest

from tallyforge.llm import mixing
from tallyforge.llm.common import Scratch


def fill(sizes, weights, share=1.5, most=2.0):
    """Targets by plain water filling."""
    open_, target = set(sizes), {}
    left = share * sum(sizes.values())
    while open_:
        level = left / sum(weights[s] for s in open_)
        above = {s for s in open_ if weights[s] * level > most * sizes[s]}
        if not above:
            return target | {s: weights[s] * level for s in open_}
        for s in above:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= above
    return target


def test_targets_like_plain_filling(spark):
    sizes = {"a": 1000, "b": 10, "c": 5000, "d": 0, None: 300}
    rows = [(i, s, n) for i, (s, n) in enumerate(sizes.items())]
    totals = mixing.cycled_weights(spark.createDataFrame(rows, "i int, source string, source_size long"), [3, 1, 2], Scratch(spark, "t"))
    weights = {r.source: r.weight for r in totals.collect()}
    assert weights == {"a": 3, "b": 1, "c": 2, "d": 3, None: 1}
    got = {r.source: r.target for r in mixing.targets(totals, 1.5, 2.0).collect()}
    assert got == pytest.approx(fill(sizes, weights))


def test_report_and_mix_agree(spark, corpus):
    told = mixing.report(corpus, [3, 1, 2], 1.5, 2.0, Scratch(spark, "t")).collect()
    assert len(told) == corpus.count()
    assert all(r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in told)
    assert {r.doc_id: r.size for r in told if r.doc_id in (5, 6, 7, 9)} == {5: 0, 6: 0, 7: 0, 9: 2}
    again = mixing.report(corpus.repartition(3), [3, 1, 2], 1.5, 2.0, Scratch(spark, "t")).collect()
    assert sorted(map(str, told)) == sorted(map(str, again))
    mixed = mixing.mix(corpus, [3, 1, 2], 1.5, 2.0, Scratch(spark, "t"))
    assert mixed.columns == corpus.columns
    expected = sum(r.taken // r.size for r in told if r.size)
    assert mixed.filter("text rlike '[^\\\\x20\\\\x09-\\\\x0D]'").count() == expected


def test_empty_table(spark, nothing):
    assert mixing.report(nothing, [3, 1, 2], 1.5, 2.0, Scratch(spark, "t")).collect() == []


def test_sources_come_near_their_targets(spark):
    rows = [(i, "word " * (1 + i % 50), f"s{i % 4}") for i in range(8000)]
    told = mixing.report(spark.createDataFrame(rows, "doc_id long, text string, source string"), [3, 1, 2], 1.5, 2.0, Scratch(spark, "t"))
    for r in told.groupBy("target").sum("taken").collect():
        assert r["sum(taken)"] == pytest.approx(r.target, rel=0.03)
