import hashlib
from collections import defaultdict

from tallyforge.llm import lines
from tallyforge.llm.common import Scratch

WHITE = " \t\n\x0b\x0c\r"


def plain(rows):
    """The contract, document by document."""
    lower = str.maketrans(lines.UPPER, lines.LOWER)
    holders = defaultdict(list)
    for doc_id, text in rows:
        if doc_id is not None:
            for key in {x.strip(WHITE).translate(lower) for x in (text or "").split("\n")}:
                if len(key) >= 40:
                    holders[key].append(doc_id)
    last = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    for doc_id, text in rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if doc_id is None or last.get(x.strip(WHITE).translate(lower), doc_id) == doc_id]
        yield doc_id, len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()


def test_like_plain(spark, corpus):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    got = [tuple(r) for r in lines.digests(corpus, Scratch(spark, "t")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(rows)))
    assert sum(r[2] for r in got) == 5


def test_random_lines(spark):
    import random

    draw = random.Random(5)
    pool = [f"line number {k} of a pool of lines that repeat {'é' * (k % 9)}" for k in range(40)]
    rows = [(i, "\n".join(draw.choice(pool)[: draw.choice([39, 60])] for _ in range(draw.randrange(6)))) for i in range(200)]
    got = [tuple(r) for r in lines.digests(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(rows)))


def test_keeps_other_columns_and_empty_table(spark, corpus, nothing):
    done = lines.dedup_lines(corpus, Scratch(spark, "t"))
    assert done.columns == [*corpus.columns, "n_lines", "n_dropped"] and done.count() == corpus.count()
    assert lines.digests(nothing, Scratch(spark, "t")).collect() == []


def test_runs_stay_disjoint_and_compact(spark):
    store = lines.LineRuns(Scratch(spark, "t"))
    for k in range(5):
        store.add(spark.createDataFrame([(i, i, 1, k) for i in range(k * 2, k * 2 + 5)], "h1 long, h2 long, docs long, last long"))
    keys = [(r.h1, r.h2) for r in store.runs().collect()]
    assert len(keys) == len(set(keys)) == 13
    assert [len(level) for level in store.levels] == [1, 0, 1]
    assert {r.h1: r.docs for r in store.frequent(2).collect()} == {i: n for i in range(13) if (n := sum(k * 2 <= i < k * 2 + 5 for k in range(5))) >= 2}
