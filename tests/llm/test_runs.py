import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tallyforge.llm import runs


def plain_runs(words):
    """Each period on its own: stretches of equal words that far apart, without those of a smaller period."""
    found = {}
    for period in range(1, len(words) // 4 + 1):
        start = None
        for i in range(len(words) - period + 1):
            if i < len(words) - period and words[i] == words[i + period]:
                start = i if start is None else start
            elif start is not None:
                length = i - start + period
                if length >= max(6, 4 * period):
                    found.setdefault((start, length), period)
                start = None
    return sorted((s, n, p) for (s, n), p in found.items())


def plain(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32((b"" if doc_id is None else str(doc_id).encode()))
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    milli = best[0] if best[0] is None else 1000 * best[1] // best[2]
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *best, milli, sha("".join(f"{s},{length},{p}\n" for s, length, p in found)), sha(kept))


def texts():
    draw = random.Random(11)
    yield from (None, "", " \t\n", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "x a b a b a b a b a y", "\x0ba\x1ca a\xa0b\n" * 7)
    yield " ".join("ab"[k % 2] for k in range(3000))
    yield "z " * 5000
    for _ in range(150):
        words = [draw.choice("ab" if draw.random() < 0.5 else "abcde") for _ in range(draw.randrange(60))]
        for _ in range(draw.randrange(3)):
            root = [draw.choice("abcd") for _ in range(draw.randrange(1, 6))]
            at = draw.randrange(len(words) + 1)
            words[at:at] = root * draw.randrange(2, 7) + root[: draw.randrange(len(root))]
        yield draw.choice([" ", "\n", "  "]).join(words)
    a, b = ["a"], ["a", "b"]
    while len(b) < 400:  # a Fibonacci word is full of squares
        a, b = b, b + a
    yield " ".join(b)


@pytest.mark.parametrize(("block", "together"), [(512, 500_000), (2, 20)])
def test_like_each_period_on_its_own(spark, monkeypatch, block, together):
    monkeypatch.setattr(runs, "BLOCK", block)
    monkeypatch.setattr(runs, "TOGETHER", together)
    rows = [*enumerate(texts()), (None, "q r " * 20), (7, "twice twice " * 9), (7, "twice twice " * 9)]
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, length string").coalesce(1)
    got = runs.digests(runs.repeating(df)).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted((plain(*r) for r in rows), key=key)


def test_squares_alone_find_the_runs_without_cuts():
    draw = random.Random(5)
    for _ in range(300):
        words = [draw.randrange(2) for _ in range(draw.randrange(80))]
        assert runs.runs_of(np.array(words)) == plain_runs(words)


def test_real_outputs_nulls_and_clashing_names(spark, corpus, nothing):
    found = {r.doc_id: r for r in runs.find_runs(spark.createDataFrame([(1, "x a b a b a b a b y", 5), (2, None, 5)], "doc_id long, text string, runs long")).collect()}
    assert [tuple(r) for r in found[1].runs] == [(1, 8, 2)] and found[1].collapsed == "x a b y" and found[1].n_words == 10
    assert found[2].runs == [] and found[2].collapsed == "" and found[2].n_words == 0
    assert runs.find_runs(corpus).count() == corpus.count() and runs.digests(nothing).collect() == []


def test_long_text_of_one_word_stays_fast():
    codes = np.zeros(60_000, np.int64)
    assert runs.runs_of(codes) == [(0, 60_000, 1)]
