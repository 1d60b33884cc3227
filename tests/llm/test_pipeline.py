import hashlib
import math
import re
from collections import Counter

import public_tokenizers
from test_jaccard import brute as linked
from test_lines import WHITE
from test_quality import plain_features
from tokenizers import Tokenizer

import corpus_pipeline
from tallyforge.llm import jaccard, lines, mixing, quality
from tallyforge.llm.common import Scratch


def test_stages_keep_columns_and_take_effect(spark, corpus, tmp_path):
    text = "People of the town walk to the market in the morning and talk of the weather number"
    rows = [(i, f"{text} {i} " + " ".join(f"a{i}b{k}" for k in range(20)) + ("\n" + "shared passage that is long enough to be counted as a line" if i % 2 else ""), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, f"BUY!! NOW{i}!! CHEAP!! WOW!! " * 4, "en", "s0", 1) for i in range(30)]
    rows += [(200, rows[4][1] + " tail", "en", "s1", 1), (201, None, "en", "s1", 0), (202, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    scratch = Scratch(spark, "t")
    held, counts = docs, []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        held = scratch.write(stage(spark, held, str(tmp_path)), f"s{number}")
        counts.append(held.count())
        if number < 4:
            assert held.columns == docs.columns
        if number == 0:
            kept = {r.doc_id for r in held.select("doc_id").collect()}
            assert set(range(60)) <= kept and not kept & set(range(100, 130))
        if number == 1:
            assert held.filter("text LIKE '%shared passage%'").count() == 1
            assert held.filter("n_chars <> length(text)").count() == 0
        if number == 2:
            assert held.filter("doc_id = 200").count() == 0
    assert held.filter("NOT round_trip").count() == 0 and held.columns[:5] == docs.columns
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, whole.collect())) == sorted(map(str, held.collect()))


def test_empty(spark, nothing, tmp_path):
    docs = nothing.drop("size")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.collect() == []


def test_operators_import_apart_from_the_pipeline():
    assert jaccard.link and lines.dedup_lines and mixing.mix


def plain_lines(rows):
    """Texts without the lines that five or more documents share, but in the one with the largest id."""
    key = lambda x: x.strip(WHITE).translate(str.maketrans(lines.UPPER, lines.LOWER))
    holders = {}
    for doc_id, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 40 and doc_id is not None:
                holders.setdefault(k, []).append(doc_id)
    last = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    return [(i, "\n".join(x for x in (t or "").split("\n") if i is None or last.get(key(x), i) == i)) for i, t in rows]


def plain_mix(rows):
    """How often the mix takes each of (doc_id, text, source)."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals = Counter()
    for _, text, source in rows:
        totals[source] += size(text)
    names = sorted(totals, key=lambda x: (x is None, x or ""))
    weights = {n: (3, 1, 2)[k % 3] for k, n in enumerate(names)}
    held, level = set(), 0.0
    while len(held) < len(names):
        level = (1.5 * sum(totals.values()) - sum(2.0 * totals[n] for n in held)) / sum(weights[n] for n in names if n not in held)
        more = {n for n in names if weights[n] * level > 2.0 * totals[n]}
        if more <= held:
            break
        held |= more
    rate = {n: min(2.0 * totals[n], weights[n] * level) / totals[n] if totals[n] else 0.0 for n in names}
    draw = lambda i: int(hashlib.md5(f"{mixing.SEED}:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 16**13
    return [math.floor(rate[s]) + (draw(i) < rate[s] - math.floor(rate[s])) for i, _, s in rows]


def test_each_stage_like_a_plain_account_of_it(spark, corpus, tmp_path):
    docs = corpus.drop("size")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i != 11), 0) for i in (1, 2, 4, 8, 9, 11, 20, 21)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    scratch, given = Scratch(spark, "t"), [tuple(r) for r in docs.collect()]
    model = quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet").filter(corpus_pipeline.remainder("doc_id", 4) != 2).selectExpr("doc_id", "quality AS label"))

    def good(text):
        found = plain_features(text)
        values = [model.ratios[f] for f in found]
        margin = sum(model.weights[f] * v for f, v in zip(found, values, strict=True)) / max(sum(v * v for v in values) ** 0.5, 1e-9)
        return 1 / (1 + math.exp(-max(-30, min(30, model.slope * margin + model.offset)))) >= 0.7

    def expected(number, rows):
        if number == 0:
            return [r for r in rows if good(r[1])]
        if number == 1:
            return [(i, text, *r[2:4], len(text)) for r, (i, text) in zip(rows, plain_lines([r[:2] for r in rows]), strict=True)]
        if number == 2:
            roots = linked([r[:2] for r in rows], 5, 80)
            return [r for r in rows if roots.get(r[0], r[0]) == r[0]]
        if number == 3:
            return [r for r, n in zip(rows, plain_mix([(r[0], r[1], r[3]) for r in rows]), strict=True) for _ in range(n)]
        library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        ids = [library.encode(r[1] or "", add_special_tokens=False).ids for r in rows]
        return [(*r, i, len(i), True) for r, i in zip(rows, ids, strict=True)]

    held = docs
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        held = scratch.write(stage(spark, held, str(tmp_path)), f"s{number}")
        due, given = expected(number, given), [tuple(r) for r in held.collect()]
        assert sorted(map(str, given)) == sorted(map(str, due)), number
    assert given
