import math
from collections import Counter, defaultdict

import pytest

from tallyforge.llm import lm
from tallyforge.llm.common import Scratch


def split(text):
    return (text or "").encode().lower().split() + [b"</s>"]


class Plain:
    """The same model from dictionaries."""

    def __init__(self, texts):
        self.words, self.pairs = Counter(), Counter()
        for text in texts:
            w = split(text)
            self.words.update(w)
            self.pairs.update(zip([b"<s>", *w[:-1]], w, strict=True))
        self.preceded = Counter(w for _, w in self.pairs)
        of = lambda c: [Counter(c.values())[k] for k in range(1, 5)]
        self.high, self.low = lm.discounts_of(*of(self.pairs)), lm.discounts_of(*of(self.preceded))
        self.total, self.spare = Counter(), defaultdict(float)
        for (v, _), c in self.pairs.items():
            self.total[v] += c
            self.spare[v] += self.high[min(c, 3) - 1]
        self.floor = (sum(self.low[min(c, 3) - 1] for c in self.preceded.values()) / len(self.pairs) if self.pairs else 1) / (len(self.words) + 1)

    def lower(self, w):
        c = self.preceded[w]
        return self.floor + ((c - self.low[min(c, 3) - 1]) / len(self.pairs) if c else 0)

    def chance(self, v, w):
        if not self.total[v]:
            return self.lower(w)
        c = self.pairs[v, w]
        return ((c - self.high[min(c, 3) - 1]) if c else 0) / self.total[v] + self.spare[v] / self.total[v] * self.lower(w)

    def told(self, text):
        w, n, v = split(text), sum(self.words.values()), len(self.words)
        base = sum(math.log10((self.words[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        return len(w), sum(x in self.words for x in w), base, sum(math.log10(self.chance(a, b)) for a, b in zip([b"<s>", *w[:-1]], w, strict=True))


@pytest.mark.parametrize("held", [800_000, 50])
def test_like_plain(spark, corpus, monkeypatch, held):
    monkeypatch.setattr(lm, "HELD", held)
    rows = corpus.collect()
    training = [r.text for r in rows if r.doc_id is None or r.doc_id % 3]
    model = lm.train(corpus.filter("doc_id IS NULL OR doc_id % 3 <> 0"), Scratch(spark, "t"))
    plain = Plain(training)
    assert model.sums["tokens"] == sum(plain.words.values()) and model.sums["words"] == len(plain.words) and model.sums["pairs"] == len(plain.pairs)
    got = lm.score(corpus, model).collect()
    assert len(got) == len(rows)
    for r in got:
        n, known, base, score = plain.told(r.text)
        assert (r.n_tokens, r.n_known) == (n, known)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)


def test_chances_sum_to_one():
    plain = Plain(["a b a c a b", "b a", "c c c a d"])
    words = [*plain.words, b"never seen"]
    for v in [b"<s>", *plain.words]:
        assert sum(plain.chance(v, w) for w in words) == pytest.approx(1)


def test_no_training_and_no_documents(spark, corpus, nothing):
    model = lm.train(nothing, Scratch(spark, "t"))
    assert {(r.n_known, r.score) for r in lm.score(corpus, model).collect()} == {(0, 0.0)}
    assert lm.score(nothing, model).collect() == []


def test_frequent_contexts_and_few_maps(spark, monkeypatch):
    """Hot contexts that are dealt over all shards, counts above a byte, and files mapped one at a time."""
    monkeypatch.setattr(lm, "MAPS", 1)
    texts = [" ".join(["the"] + [f"w{(k * j) % 97}" for k in range(60)] + ["the", f"x{j}"]) for j in range(150)] + ["a b " * 700]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, plain = lm.train(rows, Scratch(spark, "t")), Plain(texts)
    assert len(model.hot) > 1
    for r in lm.score(rows, model).collect():
        n, known, base, score = plain.told(r.text)
        assert (r.n_tokens, r.n_known) == (n, known)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
