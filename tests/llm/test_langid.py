import numpy as np

from tallyforge.llm import langid
from tallyforge.llm.common import Scratch


def longest_phrases(codes, sample):
    """Greedy parse into the longest substrings of the sample, by search."""
    text = lambda xs: "".join(chr(100 + x) for x in xs)
    where, at, count = text(sample), 0, 0
    while at < len(codes):
        size = 1
        while at + size <= len(codes) and text(codes[at : at + size]) in where:
            size += 1
        at += max(1, size - 1)
        count += 1
    return count


def test_parser_finds_longest_phrases():
    draw = np.random.default_rng(2)
    alphabet = langid.Alphabet("abc")
    sample = draw.integers(0, 4, 300).tolist()
    parser = langid.Parser("x", len(sample), langid.automaton(sample, alphabet.width), alphabet)
    for n in (1, 2, 50, 200):
        codes = draw.integers(0, 5, n)
        lanes = np.full((langid.SEGMENT, 1), alphabet.padding, np.int32)
        lanes[:n, 0] = codes
        assert parser.phrases(lanes, np.array([False]))[0][0] == longest_phrases(codes.tolist(), sample)


def brute(model, samples, text):
    """Language and score of a text, with phrases found by search in the samples."""
    codes = model.alphabet.codes(text or "").tolist()
    if not codes:
        return "und", 0.0
    found = sorted((longest_phrases(codes, s) * np.log2(len(s)), name) for name, s in samples.items())
    return found[0][1], found[1][0] / (found[0][0] + found[1][0])


def test_whole_query_like_search_in_the_samples(spark, monkeypatch):
    """Short texts, texts of many segments that go on over a group of lanes, and wide scripts."""
    monkeypatch.setattr(langid, "LANES", 3)
    monkeypatch.setattr(langid, "WARM", 2)
    draw = np.random.default_rng(9)
    wide = lambda first, n: "".join(chr(0x4E00 + first + k) for k in draw.integers(0, 300, n))
    rows = [(i, prose("no", i, 200), "no") for i in range(6)] + [(50 + i, prose("ni", i, 200), "ni") for i in range(6)]
    rows += [(100 + i, wide(0, 400) + prose("no", 70 + i, 5), "aa") for i in range(6)] + [(150 + i, wide(200, 400), "zz") for i in range(6)]
    scratch = Scratch(spark, "t")
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), scratch)
    taken = spark.read.parquet(f"{scratch.root}/sample").toPandas().sort_values("turn", kind="stable")
    samples = {name: model.alphabet.codes(" ".join(some["piece"])).tolist() for name, some in taken.groupby("lang")}
    texts = [None, "", "12 !", "é", prose("no", 1, 3), prose("ni", 2, 900), wide(0, 30), wide(200, 3000), wide(100, 700) + " " + prose("no", 1, 300), "ж" * 600 + prose("no", 3, 90)]
    texts += [rows[0][1], rows[3][1] + rows[9][1], *(prose(s, 500 + k, 40 * k + 1) for k in range(5) for s in ("no", "ni", "nu"))]
    got = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), model).orderBy("doc_id").collect()
    here = zip(*model.predict(texts), strict=True)  # in this process, where lanes are few
    for row, (own_language, own_score), text in zip(got, here, texts, strict=True):
        language, score = brute(model, samples, text)
        assert row.lang_pred == own_language == language and abs(row.score - score) < 1e-12 and abs(own_score - score) < 1e-12


def test_languages(spark, corpus, nothing):
    en, de = "the cat and the dog are in the house with the other one ", "der hund und die katze sind im haus mit dem anderen "
    rows = [(i, en * 5, "en", "c") for i in range(20)] + [(50 + i, de * 5, "de", "c") for i in range(20)] + [(99, None, "en", "c"), (98, "x", None, "c")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), Scratch(spark, "t"))
    texts = [(1, "the house and the cat " * 200), (2, "die katze im haus"), (3, None), (4, ""), (5, "123 !!"), (6, "漢字")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert [got[i].lang_pred for i in range(1, 6)] == ["en", "de", "und", "und", "und"]
    assert got[6].lang_pred in ("de", "en") and all(0 <= r.score <= 1 for r in got.values())
    assert len(langid.identify(corpus, model).collect()) == corpus.count()
    empty = langid.train(nothing, Scratch(spark, "t"))
    assert {r.lang_pred for r in langid.identify(corpus, empty).collect()} == {"und"}
    assert langid.identify(nothing, model).collect() == []


def prose(stem, seed, n):
    draw = np.random.default_rng(seed)
    return " ".join(f"{stem}{'abcdefgh'[draw.integers(8)]}{'ijklm'[draw.integers(5)]}{stem}" for _ in range(n))


def test_training_reads_beyond_the_start(spark):
    """Each language's texts open with a notice in the other."""
    rows = [(i, prose("zu", i, 150) + " " + prose("no", 100 + i, 1500), "no") for i in range(15)] + [(50 + i, prose("no", i, 150) + " " + prose("zu", 100 + i, 1500), "zu") for i in range(15)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), Scratch(spark, "t"))
    assert model.predict([prose("no", 999, 100), prose("zu", 998, 100)])[0] == ["no", "zu"]


def test_a_language_learns_alike_among_few_and_many(spark):
    rows = [(100 * k + i, prose("no", 100 * k + i, 150), f"l{k:02}") for k in range(14) for i in range(60)]
    learned = []
    for most in (2, 14):
        labelled = spark.createDataFrame([r for r in rows if r[2] < f"l{most:02}"], "doc_id long, text string, lang string")
        learned.append({p.language: p.log_letters for p in langid.train(labelled, Scratch(spark, "t")).parsers})
    assert len(learned[1]) == 14 and learned[0] == {k: learned[1][k] for k in learned[0]}
    assert min(learned[1].values()) > np.log2(31_000)


def test_every_letter_has_its_own_code(spark):
    """Two languages of one wide script, each with hundreds of letters and none in common."""
    draw = np.random.default_rng(8)
    text = lambda first, n: "".join(chr(0x4E00 + first + k) for k in draw.integers(0, 400, n))
    rows = [(i, text(0, 500), "aa") for i in range(12)] + [(50 + i, text(1000, 500), "zz") for i in range(12)]
    rows += [(100 + i, prose("no", i, 600), "no") for i in range(30)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), Scratch(spark, "t"))
    assert len(model.alphabet.letters) > 800
    assert model.predict([text(0, 80), text(1000, 80), prose("no", 999, 40)])[0] == ["aa", "zz", "no"]
