"""Near-duplicate embeddings by sorted projection passes.

Each pass gives a vector a key, the concatenated sides of random hyperplanes on which it lies, and orders the vectors of a label by
it. Near vectors agree in most bits, so they often stand close; each is compared with a window of its followers, and verified pairs are
united across passes. A window may be too small, as where one vector has thousands of copies that are far from each
other: a vector with a link in the outer half of its window is compared with the next ranks, as many as so far, until none is left
that has. Ranks count over all partitions, so no pair is missed at a border. Links are counted at last among the vectors of each
component, in pairs of blocks; equal vectors count as one row with a number of copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import Scratch, numbered
from tallyforge.llm.components import components

#: Passes, bits of a key, and ranks of the first window.
PASSES, BITS, WINDOW = 10, 63, 48
#: Ranks that a task takes as rows, at least WINDOW, and ranks from which it takes wider vectors.
SPAN, ASKING = 256, 1024
#: Rows of a block of the count.
BLOCK = 256


def unit(vectors: list) -> np.ndarray:
    found = np.stack(vectors).astype(np.float64)
    found /= np.abs(found).max(axis=1, keepdims=True)
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def keys(vectors: np.ndarray) -> np.ndarray:
    """(rows x passes) keys; a greater bit's hyperplane comes first."""
    planes = np.random.default_rng([11, vectors.shape[1]]).standard_normal((vectors.shape[1], PASSES * BITS))
    sides = (vectors @ planes > 0).reshape(len(vectors), PASSES, BITS)
    return sides @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, label, width, keys) of (c, label, width, embedding)."""
    for whole in batches:
        for start in range(0, whole.num_rows, 2000):
            batch = whole.slice(start, 2000)
            vectors, found = batch.column(3).to_pylist(), [None] * batch.num_rows
            width = batch.column(2).to_numpy()
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                for i, row in zip(at, keys(unit([vectors[i] for i in at])), strict=True):
                    found[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int64()))], ["c", "label", "width", "keys"])


def tied(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (v, root) that connect what the pairs (a, b) connect, one for each vertex that is not a root."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        parent[root(x)] = root(y)
    pairs = [(x, root(x)) for x in parent]
    found = np.array([p for p in pairs if p[0] != p[1]], np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def told(a: np.ndarray, b: np.ndarray, wide: pd.DataFrame) -> pd.DataFrame:
    """Edges (side 0), and the vectors whose windows are to widen."""
    v, root = tied(a, b)
    edges = pd.DataFrame({"c": v, "other": root, "run": 0, "rank": 0, "side": 0})
    return pd.concat([edges, wide.assign(other=0)[["c", "other", "run", "rank", "side"]]])


TOLD = "c long, other long, run long, rank long, side int"


def alike(left: pd.Series, right: pd.Series, least: float) -> np.ndarray:
    """(left x right) whether vectors are of one width and near."""
    widths = left.map(len).to_numpy(), right.map(len).to_numpy()
    near = np.zeros((len(left), len(right)), bool)
    for w in np.intersect1d(*widths):
        some, others = (x[n == w].to_list() for x, n in zip((left, right), widths, strict=True))
        near[np.ix_(widths[0] == w, widths[1] == w)] = unit(some) @ unit(others).T >= least
    return near


def near_in_window(rows: pd.DataFrame, block: int, least: float, span: int, window: int) -> pd.DataFrame:
    """Links of the rows of a block of ``span`` ranks with their followers."""
    rows = rows.sort_values("rank", kind="stable")
    rank, run, c = rows["rank"].to_numpy(), rows["run"].to_numpy(), rows["c"].to_numpy()
    own = rank // span == block
    near = alike(rows["embedding"][own], rows["embedding"], least)
    ahead = rank[None, :] - rank[own][:, None]
    near &= (ahead > 0) & (ahead <= window) & (run[own][:, None] == run[None, :])
    i, j = np.nonzero(near)
    outer = ahead[i, j] > window // 2
    wide = pd.concat([rows.iloc[np.unique(x[outer])][["c", "run", "rank"]].assign(side=side) for x, side in ((i, 1), (j, -1))])
    return told(c[i], c[j], wide)


def near_beyond(asking: pd.DataFrame, rows: pd.DataFrame, reach: int, least: float) -> pd.DataFrame:
    """Links of vectors with the rows that are more than ``reach`` ranks off, but not more than twice that, on the side they ask for."""
    off = (rows["rank"].to_numpy()[None, :] - asking["rank"].to_numpy()[:, None]) * asking["side"].to_numpy()[:, None]
    meets = (off > reach) & (off <= 2 * reach) & (asking["run"].to_numpy()[:, None] == rows["run"].to_numpy()[None, :])
    near = alike(asking["embedding"], rows["embedding"], least)
    i, j = np.nonzero(near & meets)
    wide = asking.iloc[np.unique(i[off[i, j] > reach + reach // 2])]
    return told(asking["c"].to_numpy()[i], rows["c"].to_numpy()[j], wide)


def within(span: int, window: int, least: float):
    return lambda key, rows: near_in_window(rows, key[0], least, span, window)


def beyond(reach: int, least: float):
    return lambda asking, rows: near_beyond(asking, rows, reach, least)


def ranked(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """(c, run, rank): the rank of each vector in each pass, over all passes, labels and widths; a run is one of these."""
    keyed = vectors.select("c", "label", "width", "embedding").mapInArrow(_keyed, "c long, label long, width int, keys array<long>")
    keyed = keyed.select("c", "label", "width", F.posexplode("keys").alias("pass", "key"))
    lined = numbered(keyed, [F.col(c) for c in ("pass", "label", "width", "key", "c")], scratch, "lined")
    return lined.select("c", F.xxhash64("pass", "label", "width").alias("run"), "rank")


def block_of(rank: Column | str) -> Column:
    return F.floor((F.col(rank) if isinstance(rank, str) else rank) / SPAN)


def edges_of(vectors: DataFrame, scratch: Scratch, least: float) -> DataFrame:
    """Edges (a, b) that connect the vectors (c, label, width, embedding) which are near."""
    ranks = scratch.write(ranked(vectors, scratch), "ranks")
    placed = ranks.join(vectors.select("c", "embedding"), "c")
    blocks = F.when(F.col("rank") % SPAN < WINDOW, F.array(block_of("rank"), block_of("rank") - 1)).otherwise(F.array(block_of("rank")))

    reach = WINDOW

    found = [scratch.write(placed.withColumn("block", F.explode(blocks)).groupBy("block").applyInPandas(within(SPAN, WINDOW, least), TOLD), "met-0")]
    while True:
        wide = found[-1].filter("side <> 0").select("c", "run", "rank", "side").distinct()
        if wide.isEmpty():
            return reduce(DataFrame.unionByName, found).filter("side = 0").select(F.col("c").alias("a"), F.col("other").alias("b"))
        ends = [block_of(F.col("rank") + F.col("side") * n) for n in (reach + 1, 2 * reach)]
        asked = wide.withColumn("block", F.explode(F.sequence(F.least(*ends), F.greatest(*ends)))).withColumn("from", F.floor(F.col("rank") / ASKING))
        asked = scratch.write(asked.filter("block >= 0"), f"asked-{len(found)}")
        needed = asked.select("block", "from").distinct()
        rows = ranks.withColumn("block", block_of("rank")).join(needed, "block").join(vectors.select("c", "embedding"), "c")
        rows = rows.select(*(F.col(c).alias(c) for c in rows.columns))
        asking = asked.join(vectors.select("c", "embedding"), "c")

        met = asking.groupBy("block", "from").cogroup(rows.groupBy("block", "from")).applyInPandas(beyond(reach, least), TOLD)
        found.append(scratch.write(met, f"met-{len(found)}"))
        reach *= 2


def _near(frame: pd.DataFrame, least: float) -> pd.DataFrame:
    """For two blocks of a component, or one with itself: (c, near), the copies near each vector."""
    left, right = frame[frame["side"] == 0], frame[frame["side"] == 1]
    alone = frame["i"].iloc[0] == frame["j"].iloc[0]
    if alone:
        right = left
    if not len(left) or not len(right):
        return pd.DataFrame({"c": [], "near": []})
    near = alike(left["embedding"], right["embedding"], least)
    if alone:
        np.fill_diagonal(near, True)
    counted = [pd.DataFrame({"c": left["c"], "near": near @ right["copies"].to_numpy()})]
    if not alone:
        counted.append(pd.DataFrame({"c": right["c"], "near": left["copies"].to_numpy() @ near}))
    return pd.concat(counted)


def counted(members: DataFrame, scratch: Scratch, least: float) -> DataFrame:
    """(c, near) for the members (root, c, copies, embedding) of components: copies near each, its own included."""
    sizes = scratch.write(members.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "blocks")
    dealt = members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")))
    later, earlier = F.explode(F.sequence("block", F.col("blocks") - 1)), F.explode(F.sequence(F.lit(0).cast("long"), F.col("block") - 1))
    left = dealt.select("root", F.col("block").alias("i"), later.alias("j"), F.lit(0).alias("side"), "c", "copies", "embedding")
    right = dealt.filter("block > 0").select("root", earlier.alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), "c", "copies", "embedding")

    def near(frame: pd.DataFrame) -> pd.DataFrame:
        return _near(frame, least)

    return left.unionByName(right).groupBy("root", "i", "j").applyInPandas(near, "c long, near long").groupBy("c").agg(F.sum("near").alias("near"))


def near_duplicates(embeddings: DataFrame, scratch: Scratch, least: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``embeddings`` (vec_id, embedding, label).

    Vectors link if they have the same label, not null, the same width, and a cosine of at least ``least``. component_id is the smallest
    vec_id that links reach, its own included; kept says that this is the row's own. Vectors that are null, empty, zero, or hold null or
    non-finite components, and rows with a null label, link with nothing. Each row is a vector, also where rows repeat an id, and
    gets a row. A null id has no links and a null component_id, and is not kept. No link below ``least`` is told; a link is missed
    if no pass brings its ends, or what connects them, together.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.expr("vec_id IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0") & ~bad & F.exists("embedding", lambda x: x != 0)
    rows = embeddings.select("vec_id", F.col("label").cast("long").alias("label"), "embedding", F.coalesce(fit, F.lit(False)).alias("fit"))
    same = ["label", "h1", "h2"]
    rows = rows.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding"))
    classes = rows.filter("fit").groupBy(*same).agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    classes = scratch.write(classes.withColumn("c", F.monotonically_increasing_id()).withColumn("width", F.size("embedding")), "classes")
    roots = components(edges_of(classes, scratch, least), scratch).select(F.col("v").alias("c"), "root")
    members = scratch.write(classes.select("c", "first", "copies", "embedding").join(roots, "c"), "members")
    least_ids = members.groupBy("root").agg(F.min("first").alias("component"))
    near = counted(members.drop("first"), scratch, least)
    linked = scratch.write(members.select("c", "root").join(near, "c").join(least_ids, "root").select("c", "near", "component"), "linked")
    of_class = classes.select(*same, "copies", "first", "c").join(linked, "c", "left")
    of_class = of_class.select(*same, (F.coalesce("near", "copies") - 1).alias("n_links"), F.coalesce("component", "first").alias("component"))
    keyed = rows.select("vec_id", *(F.when(F.col("fit"), F.col(k)).alias(k) for k in same))
    joined = keyed.join(scratch.write(of_class, "of-class"), same, "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id)::BIGINT AS n_links, min(r.b) AS component_id, min(r.b) = e.vec_id AS kept
FROM embeddings e JOIN reach r ON r.a = e.vec_id GROUP BY e.vec_id
"""
