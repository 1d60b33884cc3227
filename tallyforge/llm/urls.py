"""URL filtering by rules and, where none fits, by a tree of path templates.

Each host's paths form a tree of segments, which is generalised from the root down. At a node nearly all of whose segments are
new, as ids are, the rare ones become the wildcard ``*``. At another node, rare segments share a branch with those whose pages rules
have labelled alike: not at all, all blocked, all allowed, or mixed. The branches are then merged where their shares of blocked pages
among the labelled ones do not differ significantly; a branch with labels never merges with one without. What remains is a
template. Its purity is the share of blocked pages among its labelled ones, smoothed toward its host's, which is smoothed toward that of
all pages; its coverage is the share of labelled pages among all,
zero with fewer than SUPPORT. A template is rejected if its purity is at least one half and its
coverage too, so that few labels do not speak for many pages.

Every node that has enough pages is split, whatever labels they have. Segments that all pages of a node go on with are taken in one step,
so rounds grow with the branchings on a path and not with its length. A round's work is that of the pages under nodes that are split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, rule); a rule is a host and the start of a path.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: A segment is a branch of its own if it has at least so many pages, and one in so many of its node's.
SUPPORT, PARTS = 10, 50
#: A node's segments are new if there are so many for each page.
NEW = 0.9
#: Labelled pages that the host's rate counts for in a template, and the rate of all pages in a host; and the purity and the coverage at which
#: a template is rejected.
PRIOR, HOST_PRIOR, REJECT, COVER = 10, 10, 0.5, 0.5
#: Copies of the small side of a join on hosts or templates.
SALTS = 16


def split_url(pages: DataFrame, url: str) -> DataFrame:
    """Add host and path."""
    rest = F.when(F.expr(f"instr(`{url}`, '://') > 0"), F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    pattern = r"^([^/?#]*)([^?#]*)"
    cut = pages.withColumn("rest", rest)
    return cut.withColumn("host", F.translate(F.regexp_extract("rest", pattern, 1), UPPER, LOWER)).withColumn("path", F.regexp_extract("rest", pattern, 2)).drop("rest")


def ruled(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Add rule (the longest that fits host and path, else null) and ruled (its verdict, else null)."""
    rule = verdict = None
    for said, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + path)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(said)) if verdict is None else verdict.when(fits, F.lit(said))
    return pages.withColumn("rule", rule if rules else F.lit(None).cast("string")).withColumn("ruled", verdict if rules else F.lit(None).cast("string"))


def beside(left: DataFrame, right: DataFrame, keys: list[str], turn: Column, how: str = "left") -> DataFrame:
    """Join ``right``, one row per key, to ``left``, whose rows of a key are dealt by ``turn`` so that a frequent key is no single task's. The copies
    are never broadcast: the planner takes their size for that of ``right`` as compressed, and the driver would hold all of them."""
    copies = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return left.withColumn("salt", F.pmod(F.xxhash64(turn), F.lit(SALTS)).cast("int")).join(copies, [*keys, "salt"], how).drop("salt")


def apart(b: str, n: str, other_b: str, other_n: str) -> Column:
    """Whether two shares b / n differ by more than two standard errors."""
    b1, n1, b2, n2 = (F.col(c).cast("double") for c in (b, n, other_b, other_n))
    gap = b1 * n2 - b2 * n1
    return gap * gap * (n1 + n2) > 4.0 * n1 * n2 * (b1 + b2) * (n1 + n2 - b1 - b2)


def split_nodes(paths: DataFrame) -> DataFrame:
    """The templates of ``paths`` that are to be split, with pages."""
    return paths.groupBy("template").agg(F.sum("n").alias("pages")).filter(F.col("pages") >= SUPPORT)


def advance(paths: DataFrame, level: int, scratch: Scratch) -> DataFrame:
    """``paths`` with ``at`` and ``template`` moved past the segments that all pages of a node to be split share, but for each path's last. Such
    a segment is its node's only one, so its branch is itself. What all share is what the least and the greatest share."""
    left = F.slice("segs", F.col("at") + 1, F.size("segs") - F.col("at") - 1)
    ends = paths.groupBy("template").agg(F.sum("n").alias("pages"), F.min(left).alias("low"), F.max(left).alias("high")).filter(F.col("pages") >= SUPPORT)
    unlike = F.filter(F.sequence(F.lit(0), F.least(F.size("low"), F.size("high"))), lambda i: ~F.get("low", i).eqNullSafe(F.get("high", i)))
    shared = F.coalesce(F.array_min(unlike), F.least(F.size("low"), F.size("high")))
    ends = ends.select("template", F.slice("low", 1, shared).alias("shared")).filter(F.size("shared") > 0)
    moved = beside(paths, ends, ["template"], F.col("path"))
    longer = F.when(F.col("shared").isNotNull(), F.concat_ws("/", "template", F.array_join("shared", "/"))).otherwise(F.col("template"))
    at = F.col("at") + F.when(F.col("shared").isNotNull(), F.size("shared")).otherwise(0)
    return scratch.write(moved.withColumn("at", at).withColumn("template", longer).drop("shared"), f"advanced-{level}")


def grow(paths: DataFrame, level: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Paths that go on below this round's branches, with longer templates, and paths whose templates are done. ``paths`` has host, path, segs,
    at, template, n, labelled, blocked and a segment at ``at`` each; templates of nodes that are split end in a slash and a branch."""
    paths = advance(paths, level, scratch).withColumn("seg", F.get("segs", F.col("at")))
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    children = scratch.write(paths.groupBy("template", "seg").agg(*sums), f"children-{level}")
    nodes = split_nodes(children).join(children.groupBy("template").agg(F.count("*").alias("kinds")).hint("merge"), "template")
    known = beside(children, nodes, ["template"], F.col("seg"), "inner")
    frequent = (F.col("n") >= SUPPORT) & (F.col("n") * PARTS >= F.col("pages"))
    alike = F.when(F.col("labelled") == 0, "*").when(F.col("blocked") == F.col("labelled"), "*-").when(F.col("blocked") == 0, "*+").otherwise("*~")
    branch = F.when(frequent, F.col("seg")).when(F.col("kinds") >= F.col("pages") * F.lit(NEW), F.lit("*")).otherwise(alike)
    known = scratch.write(known.select("template", "seg", branch.alias("branch"), "labelled", "blocked"), f"known-{level}")

    branches = known.groupBy("template", "branch").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    share = F.col("blocked").cast("double") / F.col("labelled")
    branches = branches.withColumn("share", F.when(F.col("labelled") > 0, share))
    line = Window.partitionBy("template").orderBy(F.col("share").asc_nulls_first(), "branch")
    before = [F.lag(c).over(line).alias(f"last_{c}") for c in ("labelled", "blocked")]
    cut = F.when(F.col("last_labelled").isNull(), True).when((F.col("labelled") == 0) & (F.col("last_labelled") == 0), False)
    cut = cut.when(F.col("last_labelled") == 0, True).otherwise(apart("blocked", "labelled", "last_blocked", "last_labelled"))
    lined = branches.select("*", *before).withColumn("group", F.sum(cut.cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    groups = lined.groupBy("template", "group").agg(F.array_sort(F.collect_list("branch")).alias("branches"))
    name = F.when(F.size("branches") == 1, F.get("branches", F.lit(0))).otherwise(F.concat(F.lit("{"), F.array_join("branches", ","), F.lit("}")))
    named = groups.select("template", F.explode("branches").alias("branch"), name.alias("name"))
    steps = beside(known.select("template", "seg", "branch"), named, ["template", "branch"], F.col("seg"), "inner").drop("branch")

    grown = beside(paths, steps, ["template", "seg"], F.col("path")).withColumn("at", F.col("at") + 1)
    longer = F.when(F.col("name").isNotNull(), F.concat("template", F.lit("/"), "name")).otherwise(F.col("template"))
    on = F.col("name").isNotNull() & (F.size("segs") > F.col("at"))
    grown = scratch.write(grown.withColumn("template", longer).withColumn("on", on).drop("seg", "name"), f"paths-{level + 1}")
    return grown.filter("on").drop("on"), grown.filter("NOT on").drop("on")


def templates(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, path, template, n, labelled, blocked) of each distinct host and path of ``pages`` (host, path, ruled)."""
    counts = pages.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    segs = F.filter(F.split("path", "/"), lambda s: s != "")
    paths = scratch.write(counts.select("*", segs.alias("segs"), F.lit(0).alias("at"), F.col("host").alias("template")), "paths-0")
    open_, done, level = paths.filter(F.size("segs") > 0), [paths.filter(F.size("segs") == 0)], 0
    while not split_nodes(open_).isEmpty():
        open_, ended = grow(open_, level, scratch)
        done.append(ended)
        level += 1
    paths = reduce(DataFrame.unionByName, [*done, open_])
    rest = F.when(F.size("segs") > F.size(F.split("template", "/")) - 1, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))
    return paths.withColumn("template", rest).drop("segs", "at")


def purities(paths: DataFrame) -> DataFrame:
    """``paths`` with the purity and the coverage of their templates."""
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    leaves = paths.groupBy("host", "template").agg(*sums)
    hosts = leaves.groupBy("host").agg(*sums)
    rate = hosts.agg(F.sum("blocked") / F.nullif(F.sum("labelled"), F.lit(0))).first()[0] or 0.0
    hosts = hosts.select("host", ((F.col("blocked") + F.lit(HOST_PRIOR * rate)) / (F.col("labelled") + F.lit(HOST_PRIOR))).alias("host_rate"))
    leaves = beside(leaves, hosts, ["host"], F.col("template"), "inner")
    purity = (F.col("blocked") + PRIOR * F.col("host_rate")) / (F.col("labelled") + F.lit(PRIOR))
    told = leaves.select("host", "template", purity.alias("purity"), F.when(F.col("labelled") >= SUPPORT, F.col("labelled") / F.col("n")).otherwise(0.0).alias("coverage"))
    return beside(paths.select("host", "path", "template"), told, ["host", "template"], F.col("path"))


def judge(pages: DataFrame, scratch: Scratch, rules: list[tuple[str, str]] = RULES, url: str = "url") -> DataFrame:
    """``pages`` plus host, path, rule, verdict, template, purity and coverage.

    A URL that is null or has no ``://`` has an empty host and path, and so falls to the template of empty hosts. Rows are kept
    one for one, repeated ones too; columns already named like the added ones are replaced. Segments of any number and length are
    taken. At a node with fewer pages than SUPPORT the rest of a path is ``**``.
    """
    made = ["host", "path", "rule", "verdict", "ruled", "template", "purity", "coverage", "rest", "salt"]
    named = ruled(split_url(pages.drop(*[c for c in made if c != url]), url), rules)
    judged = scratch.write(purities(templates(named, scratch)), "templates")
    scratch.tidy("templates")
    told = beside(named, judged, ["host", "path"], F.col(url))
    by_tree = F.when((F.col("purity") >= REJECT) & (F.col("coverage") >= COVER), F.lit("block")).otherwise(F.lit("allow"))
    return told.withColumn("verdict", F.coalesce("ruled", by_tree)).drop("ruled")


def verdicts(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template."""
    return judge(pages.select("page_id", "url"), scratch).select("page_id", "host", "path", "rule", "verdict", "template")


def _oracle(rules: list[tuple[str, str]] = RULES, levels: int | None = None) -> str:
    """DuckDB SQL for ``verdicts``, for paths of so many segments at most."""
    fits, levels = [], levels or ORACLE_LEVELS
    for said, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, slash, path = text.partition("/")
        fits.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{path}')", text, said))
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{t}'" for f, t, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits) + " END"
    sql = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM cut),
t0 AS (
  SELECT page_id, host, path, {rule} AS rule, {verdict} AS ruled, host AS template,
         list_filter(string_split(path, '/'), lambda s: s <> '') AS segs FROM split)"""
    for k in range(levels):
        seg = f"segs[{k + 1}]"
        sql += f""",
c{k} AS (
  SELECT template, {seg} AS seg, count(*) AS n, count(ruled) AS l, count(*) FILTER (ruled = 'block') AS b FROM t{k} WHERE {seg} IS NOT NULL GROUP BY ALL),
k{k} AS (
  SELECT c.template, c.seg, c.l, c.b,
         CASE WHEN n >= {SUPPORT} AND n * {PARTS} >= pages THEN c.seg WHEN kinds >= pages * {NEW}::DOUBLE THEN '*'
              WHEN l = 0 THEN '*' WHEN b = l THEN '*-' WHEN b = 0 THEN '*+' ELSE '*~' END AS branch
  FROM c{k} c JOIN (SELECT template, sum(n) AS pages, count(*) AS kinds FROM c{k} GROUP BY ALL HAVING sum(n) >= {SUPPORT}) p ON c.template = p.template),
b{k} AS (SELECT template, branch, sum(l)::DOUBLE AS l, sum(b)::DOUBLE AS b FROM k{k} GROUP BY ALL),
l{k} AS (
  SELECT *, lag(l) OVER w AS pl, lag(b) OVER w AS pb FROM b{k}
  WINDOW w AS (PARTITION BY template ORDER BY CASE WHEN l > 0 THEN b / l END NULLS FIRST, branch)),
g{k} AS (
  SELECT template, branch, sum(CASE WHEN pl IS NULL THEN 1 WHEN l = 0 AND pl = 0 THEN 0 WHEN pl = 0 THEN 1
         WHEN (b * pl - pb * l) * (b * pl - pb * l) * (l + pl) > 4.0::DOUBLE * l * pl * (b + pb) * (l + pl - b - pb) THEN 1 ELSE 0 END)
         OVER (PARTITION BY template ORDER BY CASE WHEN l > 0 THEN b / l END NULLS FIRST, branch ROWS UNBOUNDED PRECEDING) AS grp FROM l{k}),
n{k} AS (
  SELECT template, grp, CASE WHEN count(*) = 1 THEN min(branch) ELSE '{{' || string_agg(branch, ',' ORDER BY branch) || '}}' END AS name FROM g{k} GROUP BY ALL),
s{k} AS (
  SELECT k.template, k.seg, n.name FROM k{k} k JOIN g{k} g ON k.template = g.template AND k.branch = g.branch
  JOIN n{k} n ON g.template = n.template AND g.grp = n.grp),
t{k + 1} AS (
  SELECT t.page_id, t.host, t.path, t.rule, t.ruled, t.template || coalesce('/' || s.name, '') AS template, t.segs
  FROM t{k} t LEFT JOIN s{k} s ON t.template = s.template AND t.{seg} = s.seg)"""
    return sql + f""",
f AS (
  SELECT page_id, host, path, rule, ruled, template || CASE WHEN len(segs) > len(string_split(template, '/')) - 1 THEN '/**' ELSE '' END AS template
  FROM t{levels}),
h AS (
  SELECT host, (count(*) FILTER (ruled = 'block') + {HOST_PRIOR} * (SELECT count(*) FILTER (ruled = 'block') / count(ruled)::DOUBLE FROM f)) / (count(ruled) + {HOST_PRIOR})::DOUBLE AS rate
  FROM f GROUP BY ALL),
p AS (SELECT host, template, count(*) AS n, count(ruled) AS l, count(*) FILTER (ruled = 'block') AS b FROM f GROUP BY ALL)
SELECT f.page_id, f.host, f.path, f.rule,
       coalesce(f.ruled, CASE WHEN (p.b + {PRIOR} * coalesce(h.rate, 0)) / (p.l + {PRIOR})::DOUBLE >= {REJECT} AND p.l >= {COVER} * p.n AND p.l >= {SUPPORT} THEN 'block' ELSE 'allow' END) AS verdict, f.template
FROM f JOIN p ON f.host = p.host AND f.template = p.template JOIN h ON f.host = h.host
"""


#: The SQL spells levels out, more than the paths of the test tables have.
ORACLE_LEVELS = 4
ORACLE = _oracle()
