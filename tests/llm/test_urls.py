import random

import duckdb
import pytest

from tallyforge.llm import urls
from tallyforge.llm.common import Scratch

CASES = {
    "https://WWW.Example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
    "http://shop.example.com/en/2?x=/en/": ("shop.example.com", "/en/2", "example.com/en/", "block"),
    "http://a.com": ("a.com", "", None, "allow"),
    "http://a.com/": ("a.com", "/", "com/", "allow"),
    "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
    "ftp://x.net/es/a#b": ("x.net", "/es/a", "net/es/", "block"),
    "http://x.net/es": ("x.net", "/es", None, "allow"),
    "no scheme": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    "://?q": ("", "", None, "allow"),
    "http://a.com:80/x": ("a.com:80", "/x", None, "allow"),
}


def test_rules(spark):
    rows = [(i, u, "clash") for i, u in enumerate([*CASES, None, None])]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, path string"), Scratch(spark, "t")).collect()}
    assert len(got) == len(rows)
    for i, expected in enumerate(CASES.values()):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == expected
    assert got[len(CASES)].host == got[len(CASES)].path == ""


def test_templates_generalise_and_reject(spark):
    """Labelled pages under /ads/ are blocked; unlabelled ones there follow, those elsewhere do not."""
    rules = [("block", "x.org/ads/b"), ("allow", "x.org/news/a")]
    rows = [(f"http://x.org/ads/b{i}") for i in range(60)] + [f"http://x.org/ads/c{i}" for i in range(30)]
    rows += [f"http://x.org/news/a{i}" for i in range(60)] + [f"http://x.org/news/z{i}" for i in range(30)]
    got = urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), Scratch(spark, "t"), rules).collect()
    assert {r.template for r in got} == {"x.org/ads/*", "x.org/news/*"}
    assert all(r.verdict == ("block" if "/ads/" in r.url else "allow") for r in got)


def test_empty_and_null(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert urls.verdicts(df, Scratch(spark, "t")).collect() == []
    one = spark.createDataFrame([(None, None)], "page_id long, url string")
    assert [tuple(r) for r in urls.verdicts(one, Scratch(spark, "t")).collect()] == [(None, "", "", None, "allow", "")]


def judged(spark, rows, rules, **clash):
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    for name in clash:
        df = df.withColumn(name, df.page_id)
    return {r.url: r for r in urls.judge(df, Scratch(spark, "t"), rules).collect()}


def test_similar_siblings_merge_and_labelled_ones_stay_apart_from_unlabelled(spark):
    rules = [("block", "x.net/es/"), ("block", "x.net/fr/"), ("allow", "x.net/ok/")]
    rows = [f"http://x.net/{s}/{i}" for s, n in (("es", 3), ("fr", 40), ("ok", 30), ("en", 30), ("de", 4)) for i in range(n)]
    got = judged(spark, rows, rules, template=1, host=1, purity=1, salt=1)
    assert got["http://x.net/es/1"].template.split("/")[1] == got["http://x.net/fr/1"].template.split("/")[1] == "{*-,fr}"
    assert got["http://x.net/en/1"].template.split("/")[1] == got["http://x.net/de/1"].template.split("/")[1] == "{*,en}"
    assert got["http://x.net/ok/1"].template.split("/")[1] == "ok"
    assert all(r.verdict == ("block" if r.rule in ("x.net/es/", "x.net/fr/") else "allow") for r in got.values())


def test_six_levels(spark):
    """Branches that differ only at the sixth segment are told apart; unlabelled pages follow their own branch."""
    rules = [("block", "x.org/a/b/c/d/e/bad/1"), ("allow", "x.org/a/b/c/d/e/good/1")]
    rows = [f"http://x.org/a/b/c/d/e/{s}/{k}{i}" for s in ("bad", "good") for k, n in ((1, 30), (2, 15)) for i in range(100, 100 + n)]
    got = judged(spark, rows, rules)
    assert {r.template for r in got.values()} == {"x.org/a/b/c/d/e/bad/*", "x.org/a/b/c/d/e/good/*"}
    assert all(r.verdict == ("block" if "/bad/" in r.url else "allow") for r in got.values())


def test_long_urls_and_small_nodes(spark):
    rows = ["http://x.org/" + "/".join(map(str, range(3000))), "http://y.org/" + "z" * 100_000, *(f"http://z.org/{i}" for i in range(3))]
    got = judged(spark, rows, urls.RULES)
    assert {r.template for r in got.values()} == {"x.org/**", "y.org/**", "z.org/**"} and {r.verdict for r in got.values()} == {"allow"}


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_templates_like_the_sql(spark, seed):
    """Rules that name part of what hangs together: the method rejects the rest of some templates and keeps others, as the SQL does."""
    draw = random.Random(seed)
    rules = [("block", "a.org/spam/x"), ("allow", "a.org/docs/x"), ("block", "b.org/ads/x"), ("allow", "b.org/ads/y"), ("block", "c.org/")]
    rows = []
    for host in ("a.org", "b.org", "c.org", "d.org"):
        for kind, labelled in (("spam", 0.8), ("docs", 0.7), ("ads", 0.9), ("few", 0.3), ("x", 0.5)):
            for k in range(draw.randrange(5, 90)):
                rows.append(f"http://{host}/{kind}/{draw.choice('xxxy') if draw.random() < labelled else 'z'}{k}" + draw.choice(["", "/p", "/p/q"]))
    got = judged(spark, rows, rules)
    free = [r for r in got.values() if r.rule is None]
    assert 5 <= sum(r.verdict == "block" for r in free) < len(free) / 2
    assert all("/spam/" in r.url or "/ads/" in r.url for r in free if r.verdict == "block")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(rows)))
    want = {rows[i]: (rule, verdict, template) for i, _, _, rule, verdict, template in con.execute(urls._oracle(rules)).fetchall()}
    assert {u: (r.rule, r.verdict, r.template) for u, r in got.items()} == want


def test_a_trap_of_many_levels_ends_where_labels_do(spark):
    """Hundreds of levels without a label are one template; levels under labels are split as far as those go."""
    trap = [f"http://t.org/{'a/' * 300}{k}" for k in range(12)]
    deep = [f"http://x.org/{'b/' * 3}{k}{i}" for k in ("bad", "new") for i in range(20)]
    got = judged(spark, trap + deep, [("block", "x.org/b/b/b/bad")])
    assert {r.template for u, r in got.items() if "t.org" in u} == {"t.org/**"}
    assert {r.template for u, r in got.items() if "x.org" in u} == {"x.org/b/b/b/*"} and all(r.verdict == "block" for u, r in got.items() if "x.org" in u)


def test_every_node_with_enough_pages_is_split(spark):
    """Nodes all of whose pages have labels, and nodes without any, have templates below them; chains of any length take one round."""
    deep = "/".join(f"d{k}" for k in range(120))
    rows = [f"http://all.org/{s}/{i}" for s in ("a", "b") for i in range(20)] + [f"http://none.org/{s}/{i}" for s in ("a", "b") for i in range(20)]
    rows += [f"http://deep.org/{deep}/{s}/{i}" for s in ("x", "y") for i in range(15)] + [f"http://deep.org/{deep}" for _ in range(3)]
    got = judged(spark, rows, [("block", "all.org/")])
    named = {r.template for r in got.values()}
    assert {"all.org/{a,b}/*-", "none.org/{a,b}/*", f"deep.org/{deep}/{{x,y}}/*", f"deep.org/{deep}"} == named
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [(i, u) for i, u in enumerate(rows) if "deep" not in u])
    want = {rows[i]: (verdict, template) for i, _, _, _, verdict, template in con.execute(urls._oracle([("block", "all.org/")])).fetchall()}
    assert {u: (r.verdict, r.template) for u, r in got.items() if "deep" not in u} == want


def test_no_table_of_segments_or_templates_is_broadcast(spark):
    """Copies for the salts are many times the size that the planner knows."""
    plans = []

    class Watched(Scratch):
        def write(self, df, name, partition_by=None):
            plans.append(str(df._jdf.queryExecution().executedPlan()))
            return super().write(df, name, partition_by)

    rows = [(i, f"http://{h}.org/{s}/{i}") for i, (h, s) in enumerate((h, s) for h in "xy" for s in ("ads", "new") for _ in range(12))]
    told = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), Watched(spark, "t"), [("block", "x.org/ads/1")])
    plans.append(str(told._jdf.queryExecution().executedPlan()))
    assert len(plans) > 4 and not [p for p in plans if "Broadcast" in p]
    assert {r.template for r in told.collect()} >= {"y.org/{ads,new}/*"}
