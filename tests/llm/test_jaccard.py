import random

import numpy as np
import pytest

from tallyforge.llm import jaccard
from tallyforge.llm.common import Scratch


def shingles(text, width):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width, share):
    ids = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= share * len(a | b):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return {i: root(i) for i in ids}


def noisy(draw, base, edits):
    words = base.split()
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"e{draw.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize(("width", "share", "chunk"), [(3, 90, 250), (5, 80, 250), (3, 90, 6), (5, 80, 6)])
def test_like_brute_force(spark, monkeypatch, width, share, chunk):
    """Families of copies with few and many edits, short texts, and (last cases) families that Spark splits."""
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    draw = random.Random(width * share)
    rows = []
    for size in (9, 10, 12, 20, 40, 150, 400):
        base = " ".join(f"w{draw.randrange(3000)}" for _ in range(size))
        rows += [noisy(draw, base, draw.randrange(0, max(2, size // 25))) for _ in range(12)]
        rows += [base + f" x{k}" for k in range(3)]
    rows = [(i, t) for i, t in enumerate(rows)]
    draw.shuffle(rows)
    got = {r.doc_id: r.component_id for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t"), width, share).collect()}
    assert got == brute(rows, width, share)


def test_odd_rows(spark, corpus, nothing):
    got = jaccard.link(corpus, Scratch(spark, "t"), 3, 90).collect()
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    expected = brute(rows, 3, 90)
    assert len(got) == len(rows) and all(r.component_id == expected.get(r.doc_id) for r in got)
    sizes = {(r.doc_id, len(shingles(r.text, 3))) for r in corpus.collect()}
    assert {(r.doc_id, r.n_shingles) for r in got} == sizes
    assert jaccard.link(nothing, Scratch(spark, "t"), 3, 90).collect() == []


@pytest.mark.parametrize("part", [0, 0.3, 0.7, 0.85, 1])
def test_signatures_meet(part):
    """Linked sets always share a signature, whatever part of their shingles is common."""
    draw = np.random.default_rng(4)
    for share in (80, 90):
        for n in [*range(4, 60), 100, 500, 3000]:
            base = np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
            common = np.sort(base[draw.random(len(base)) < part])
            for gone in range(0, n // 4 + 1, max(1, n // 40)):
                for new in range(0, n // 4 + 1, max(1, n // 40)):
                    both = len(base) - gone
                    if gone + new and 100 * both >= share * (len(base) + new):
                        other = np.unique(np.append(draw.permutation(base)[gone:], draw.integers(0, 2**63, new).astype(np.uint64)))
                        assert np.intersect1d(jaccard.signatures(base, share, common), jaccard.signatures(other, share, common)).size


def test_a_set_enters_no_more_regions_than_its_own_size_calls_for():
    """Signatures of 5-word shingles at 80 percent: 0.25 of a set's size in either of two rings and a few more, not the ring's largest set's."""
    draw = np.random.default_rng(1)
    for n in range(200, 400, 7):
        found = np.unique(draw.integers(0, 2**64, n, np.uint64))
        assert len(jaccard.signatures(found, 80, np.zeros(0, np.uint64))) <= 0.5 * n + 4


def test_copies_of_texts_go_round_by_round(spark, monkeypatch):
    """A round of large regions leaves links behind and no copies of texts."""
    monkeypatch.setattr(jaccard, "CHUNK", 6)
    gone, drop = [], Scratch.drop
    monkeypatch.setattr(Scratch, "drop", lambda self, name: (gone.append(name), drop(self, name))[1])
    draw = random.Random(2)
    base = " ".join(f"w{draw.randrange(3000)}" for _ in range(60))
    rows = [(i, noisy(draw, base, 3)) for i in range(60)]
    got = {r.doc_id: r.component_id for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t"), 5, 80).collect()}
    assert got == brute(rows, 5, 80)
    assert {"members", "large-0", "placed-1", "stuck-1"} <= set(gone) and gone.index("placed-1") < gone.index("members", gone.index("members") + 1)
