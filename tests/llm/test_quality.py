import numpy as np

from tallyforge.llm import quality


def test_learns_and_scores(spark, corpus):
    good = [(i, f"The report {i} says that people walk home in the evening, and then rest.", 1) for i in range(60)]
    bad = [(100 + i, f"BUY!! NOW{i}!! CHEAP!! WOW!! DEALS!! " * 3, 0) for i in range(40)]
    rows = spark.createDataFrame([*good, *bad, (500, "unlabelled", None)], "doc_id long, text string, label int")
    model = quality.train(rows.select("doc_id", "text"), rows.select("doc_id", "label"))
    got = quality.score(spark.createDataFrame([(1, "A new text tells how people rest at home.", "s"), (2, "NEW!! OFFER!! BUY!! CHEAP!!", "s")], "doc_id long, text string, score string"), model)
    scores = {r.doc_id: r.score for r in got.collect()}
    assert scores[1] > 0.7 > 0.3 > scores[2]
    told = quality.score(corpus, model).collect()
    assert len(told) == corpus.count() and all(0 <= r.score <= 1 for r in told)


def test_bounded_sample_and_degenerate_labels(spark, nothing):
    rows = spark.createDataFrame([(i, f"text {i}", i % 2) for i in range(400)], "doc_id long, text string, label int")
    assert quality.train(rows.select("doc_id", "text"), rows.select("doc_id", "label"), most=50).weights.any()
    one_kind = quality.train(rows.select("doc_id", "text"), rows.select("doc_id", "label").filter("label = 1"))
    assert {r.score for r in quality.score(rows.select("doc_id", "text"), one_kind).collect()} == {0.5}
    assert quality.score(nothing, one_kind).collect() == []


def test_descent_reaches_the_optimum():
    """Dual coordinate descent agrees with projected gradient descent on the dual."""
    draw = np.random.default_rng(3)
    rows = [np.unique(draw.integers(0, 60, 12)) for _ in range(80)]
    labels = np.array([1.0 if (r < 30).mean() > 0.5 else -1.0 for r in rows])
    ratios = np.zeros(quality.SIZE)
    ratios[:60] = draw.standard_normal(60)
    weights = quality.descend(rows, labels, ratios)
    x = np.array([np.bincount(r, quality.scaled(r, ratios), 60)[:60] for r in rows])
    share = np.array([(labels < 0).mean(), (labels > 0).mean()])
    costs = quality.COST * len(rows) ** 0.5 * np.where(labels > 0, share[0], share[1]) * 2
    kernel, alpha = (x * labels[:, None]) @ (x * labels[:, None]).T, np.zeros(len(rows))
    for _ in range(20000):
        alpha = np.clip(alpha - 0.02 * (kernel @ alpha - 1), 0, costs)
    primal = lambda w: 0.5 * w @ w + (costs * np.maximum(0, 1 - labels * (x @ w))).sum()
    assert primal(weights[:60]) <= primal((x * labels[:, None]).T @ alpha) * 1.05 + 1e-6


def plain_features(text):
    """A text's features by single steps on Python's own numbers."""
    import xxhash

    cap, mix = 1 << 64, int(quality.MIX)
    words = (text or "").encode().split()
    hashed = [xxhash.xxh64_intdigest(w) for w in words]
    codes = [2 * quality.shape(w.decode()) + (i > 0 and hashed[i] == hashed[i - 1]) for i, w in enumerate(words)]
    found = {(h * mix % cap) >> (64 - quality.WORD_BITS) for h in hashed}
    found |= {quality.PAIRS + (((b ^ (a * mix % cap)) * mix % cap) >> (64 - quality.PAIR_BITS)) for a, b in zip(hashed, hashed[1:], strict=False)}
    for n in range(1, quality.ORDER + 1):
        for i in range(len(codes) - n + 1):
            gram = 1 + codes[i]
            for c in codes[i + 1 : i + n]:
                gram = (gram * 128 + c) % cap
            mixed = (gram + n) * mix % cap
            found.add(quality.SHAPES + (((mixed ^ (mixed >> 29)) * mix % cap) >> (64 - quality.SHAPE_BITS)))
    return sorted(found)


def test_whole_query_like_plain_steps(spark):
    """Features, ratios, weights, curve and scores, on texts of all kinds, against plain accounts of each."""
    import random

    draw = random.Random(4)
    some = lambda words, n: " ".join(draw.choice(words) for _ in range(n))
    good, bad = ["The", "house", "walks,", "evening.", "12", "über", "and"], ["BUY!!", "NOW", "cheap$$", "x9x9", "and", "WOW!"]
    rows = [(i, some(good if i % 3 else bad, draw.randrange(1, 30)), i % 3 > 0) for i in range(90)]
    texts = [None, "", " \n", "one", "one one one", "é" * 5000, some(good, 3000), some(bad, 8), *(t for _, t, _ in rows)]
    features = quality.Features()
    assert all(features.of(t).tolist() == plain_features(t) for t in texts)

    df = spark.createDataFrame([(i, t, int(lab)) for i, t, lab in rows], "doc_id long, text string, label int")
    model = quality.train(df.select("doc_id", "text"), df.select("doc_id", "label"))
    fitted = [(plain_features(t), lab) for i, (_, t, lab) in enumerate(rows) if i % quality.KEPT]
    counts = {lab: {f: sum(f in x for x, own in fitted if own == lab) + 1 for f in {f for x, _ in fitted for f in x}} for lab in (True, False)}
    totals = {lab: sum(c.values()) + quality.SIZE - len(c) for lab, c in counts.items()}
    ratio = {f: np.log(counts[True][f] / totals[True]) - np.log(counts[False][f] / totals[False]) for f in counts[True]}
    assert all(abs(model.ratios[f] - r) < 1e-9 for f, r in ratio.items())
    got = quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for row, text in zip(got, texts, strict=True):
        found = plain_features(text)
        values = [model.ratios[f] for f in found]
        length = max(sum(v * v for v in values) ** 0.5, 1e-9)
        margin = sum(model.weights[f] * v / length for f, v in zip(found, values, strict=True))
        assert abs(row.score - 1 / (1 + np.exp(-np.clip(model.slope * margin + model.offset, -30, 30)))) < 1e-9
    assert got[6].score > 0.7 > 0.3 > got[7].score


def test_labels_of_one_kind_among_the_documents_score_half(spark):
    docs = spark.createDataFrame([(k, f"good words {k} and more of them") for k in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 if k < 20 else 0) for k in range(40)], "doc_id long, label int")
    assert {r.score for r in quality.score(docs, quality.train(docs, labels)).collect()} == {0.5}


def test_a_task_gives_its_memory_back():
    """Many small arrays between which one stays would else keep the worker large."""
    import re
    from pathlib import Path

    from tallyforge.llm.common import frugal

    def held() -> float:
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

    def task(batches):
        for n in batches:
            some = [np.ones(500) for _ in range(n)]
            kept.append(some[-1])
            yield len(some)

    kept, before = [], held()
    assert list(frugal(task)(iter([60_000]))) == [60_000]
    assert held() < before + 60
