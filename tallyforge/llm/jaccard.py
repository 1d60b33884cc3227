"""Exact Jaccard join of shingle sets in metric space: pivots, Voronoi regions and triangle-inequality windows.

1. Sets that are equal meet by their hash; one document stands for each.
2. Unrelated texts are at distance 1 from one another and from any pivot, so documents as pivots cannot tell them apart. The first
   regions are therefore drawn in parts of the universe. Shingles are dealt into k parts by hash; restricted to a
   part, the Jaccard distance is a metric again, and the pivots there are the contents that occur. Two linked sets differ in at
   most D shingles, so with more than D parts that hold shingles, in at least one part their distance is 0: both lie in the region
   of the same pivot. k follows from a ring of sizes, so that its smallest set fills more than D parts; a set near the upper edge of its ring also enters the next one (the window
   that the distance to the universe itself requires). Shingles that many documents share (found on a bounded sample; any choice
   gives the same links) have parts of their own, which only sets without enough other shingles enter: else passages that
   many documents quote would draw all of these into one region.
3. Regions with a document in common are joined to families. No link leaves a family. For this, pairs of signature and set are sorted
   by range once, so that no signature, however frequent, needs a task of its own, and equal sets count as one.
4. A family is split by pivots from its own documents: the most central one, and others. What links with a pivot is
   connected and not compared among itself, so a group of m copies near one of them takes about m comparisons. Each document belongs to
   its nearest pivot's region and is copied to every other within twice the radius, which is where the triangle inequality allows links.
5. Regions are split recursively. Families that a task can hold are split there (``regions.py``). Larger ones are split by Spark,
   block by block. Where that no longer helps, documents with too many shingles of their own to link at all go, and the rest
   is joined in pairs of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import tee

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import Scratch, frugal
from tallyforge.llm.components import components
from tallyforge.llm.regions import connected, voronoi

#: Weight of what one task joins: a document weighs 1, and 1 more for each so many characters. Larger regions are split.
CHUNK, CHARACTERS = 250, 4000
#: Documents whose common shingles tell a large region's centre, and pivots drawn by a hash beside the central one.
SAMPLED, DRAWN = 64, 8
#: A large region goes on being split if it keeps no more than this share of what it was cut from.
SHRUNK = 0.75
#: Ratio of the sizes of a ring.
RING = 1.25
#: A shingle is common if so many of about so many sampled documents hold it; at most so many, the commonest, are told apart.
HELD, SAMPLE, MOST_COMMON = 2, 8000, 500_000
#: Words that a task remembers.
MEMORY = 50_000
#: Pairs of signature and set that a task sorts, few enough to need no disk.
SORTED = 1_500_000

A, B, C, M = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M
    x = (x ^ (x >> np.uint64(27))) * A
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sorted distinct 64-bit hashes of a text's shingles of ``width`` words."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def word(self, word: bytes) -> int:
        import xxhash

        if len(self.known) >= MEMORY:
            self.known.clear()
        made = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self.known[word] = made
        return made

    def of(self, text: str | None, width: int) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known.get
        hashes = np.array([known(w) or self.word(w) for w in words], np.uint64)
        size = min(width, len(words))
        total = np.full(len(hashes) - size + 1, size, np.uint64)
        for k in range(size):
            total = mixed(total * B + hashes[k : len(hashes) - size + 1 + k])
        return np.unique(total)



def most_apart(a: int, b: int, share: int) -> int:
    """The largest symmetric difference of linked sets of at most a and b shingles, linked at ``share`` percent."""
    return (a + b) * (100 - share) // (100 + share)


def ring_of(n: int) -> int:
    return int(np.floor(np.log(n) / np.log(RING) + 1e-9))


def signatures(found: np.ndarray, share: int, common: np.ndarray) -> np.ndarray:
    """Numbers of the first regions that a set lies in, in each ring that it enters; see ``signatures_of_ring``."""
    n = len(found)
    if 100 * n < share * (n + 1):
        return np.zeros(0, np.uint64)  # no other set can be near enough
    is_common = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found if len(common) else np.zeros(n, bool)
    rings = range(ring_of(n), ring_of(n * 100 // share) + 1)
    return np.concatenate([signatures_of_ring(found[~is_common], found[is_common], ring, share) for ring in rings])


@lru_cache(maxsize=1024)
def parts_in(ring: int, share: int) -> tuple[int, int]:
    """How much linked sets of a ring differ at most, and into how many parts they are cut: so many that the smallest set that enters
    the ring fills more parts than that, with a margin."""
    top, least = int(np.ceil(RING ** (ring + 1))), max(1, int(RING**ring * share / 100))
    apart = most_apart(top, top, share)
    wanted, k = min(apart + 1 + (apart + 1) ** 0.5, 0.93 * least), apart + 2
    while k * (1 - np.exp(-least / k)) < wanted:
        k += 1 + k // 50
    return apart, k


def parts_of(found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of the parts, of k, that hold some of the sorted shingles, a hash of what each holds, and how many."""
    if not len(found):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    part = ((found >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)  # rises with the hash, so parts are runs of the sorted set
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    return part[starts], np.add.reduceat(mixed(found ^ A), starts), np.diff(np.append(starts, len(found)))


def signatures_of_ring(rare: np.ndarray, common: np.ndarray, ring: int, share: int) -> np.ndarray:
    """Linked sets in a ring differ in at most D shingles, so in at most D parts; D is a set's own, by the largest size that its partners in
    the ring have. Parts with what they hold have one order for all
    sets: rare before common, then those that hold most. Of the first part that is the same in two linked sets, at most D filled
    parts stand before it in either, so a set with more than D filled parts enters the regions of the first D + 1 only. A set
    with D or less enters those of all its parts, the empty ones too: of two such sets, some part is the same in both."""
    most, k = parts_in(ring, share)
    n = len(rare) + len(common)
    apart = min(most, most_apart(n, min(n * 100 // share, int(np.ceil(RING ** (ring + 1)))), share))
    of_rare, of_common = parts_of(rare, k), parts_of(common, k)
    parts, content, held = (np.append(x, y) for x, y in zip(of_rare, of_common, strict=True))
    is_common = np.arange(len(parts)) >= len(of_rare[0])
    parts = parts + is_common.astype(np.uint64) * np.uint64(k)
    filled = len(parts)
    if filled <= apart:
        empty = np.setdiff1d(np.arange(2 * k, dtype=np.uint64), parts)
        parts, content = np.append(parts, empty), np.append(content, np.zeros(len(empty), np.uint64))
    made = mixed(content + mixed(parts * B + np.full(1, ring, np.uint64) * C))
    return made if filled <= apart else made[np.lexsort((made, -held, is_common))[: apart + 1]]


@frugal
def _listed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    shingles = Shingles()
    for batch in batches:
        found = [shingles.of(t, width).astype(np.int64) for t in batch.column(0).to_pylist()]
        offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))], ["shingles"])


def common_shingles(documents: DataFrame, width: int) -> np.ndarray:
    """Sorted hashes of the shingles that at least HELD of about SAMPLE documents hold, chosen by a hash of doc_id. The table that
    reaches the driver has MOST_COMMON rows at most."""
    n = documents.count()
    taken = documents.filter(F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE / max(1, n)))).select("text")

    def listed(batches):
        return _listed(batches, width)

    counted = taken.mapInArrow(listed, "shingles array<long>").select(F.explode("shingles").alias("h")).groupBy("h").count().filter(F.col("count") >= HELD)
    top = counted.orderBy(F.desc("count"), "h").limit(MOST_COMMON).select("h").toPandas()["h"]
    return np.sort(top.to_numpy(np.int64).view(np.uint64))


@frugal
def _describe(batches: Iterator[pa.RecordBatch], width: int, share: int, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each text. Of equal sets that a task meets, one lists its signatures."""
    seen: set[tuple[int, int]] = set()
    shingles = Shingles()
    for whole in batches:
        for start in range(0, whole.num_rows, 1000):
            batch = whole.slice(start, 1000)
            sizes, h1, h2, all_signatures = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = shingles.of(text, width)
                sizes.append(len(found))
                h1.append(int(mixed(found).sum().astype(np.int64)) if len(found) else 0)
                h2.append(int(mixed(found ^ C).sum().astype(np.int64)) if len(found) else 0)
                if not len(found) or doc_id is None or (h1[-1], h2[-1]) in seen:
                    all_signatures.append(np.zeros(0, np.int64))
                    continue
                if len(seen) >= MEMORY:
                    seen.clear()
                seen.add((h1[-1], h2[-1]))
                all_signatures.append(signatures(found, share, common).astype(np.int64))
            offsets = np.cumsum([0, *map(len, all_signatures)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(all_signatures)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), lists], ["doc_id", "n", "h1", "h2", "signatures"])


@frugal
def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(signature, a, b) of a partition's sorted rows (signature, set): each set with the first that has its signature here. The
    partition's first and last signature may go on in its neighbours; the first sets of these are told as a = b, with the signature."""

    def told(signatures: list[int] | None, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        named = pa.nulls(len(a), pa.int64()) if signatures is None else pa.array(signatures, pa.int64())
        return pa.RecordBatch.from_arrays([named, pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["signature", "a", "b"])

    last = first = None
    for batch in batches:
        signature, sets = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        if not len(signature):
            continue
        starts = np.append(True, signature[1:] != signature[:-1])
        firsts = sets[starts]
        if last is None:
            yield told([signature[0]], sets[:1], sets[:1])
        elif signature[0] == last:
            firsts[0] = first
        heads = firsts[np.cumsum(starts) - 1]
        linked = heads != sets
        yield told(None, sets[linked], heads[linked])
        last, first = signature[-1], firsts[-1]
    if last is not None:
        yield told([last], np.array([first]), np.array([first]))


def distance_to(pivot: np.ndarray, sets: list[np.ndarray], share: int) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard distances of sets to a pivot, and whether they link with it."""
    sizes = np.array(list(map(len, sets)))
    data = np.concatenate(sets)
    held = pivot[np.minimum(np.searchsorted(pivot, data), len(pivot) - 1)] == data
    both = np.add.reduceat(held.astype(np.int64), np.cumsum(sizes) - sizes)
    union = len(pivot) + sizes - both
    return 1 - both / union, 100 * both >= share * union


def join_packed(frame: pd.DataFrame, width: int, share: int) -> pd.DataFrame:
    """(a, b): links that connect the documents of each region of a pack that belong together."""
    shingles, links = Shingles(), [pd.DataFrame({"a": [], "b": []}, dtype=np.int64)]
    for _, some in frame.sort_values("doc_id", kind="stable").groupby("region"):
        ids = some["doc_id"].to_numpy()
        roots = connected([shingles.of(t, width) for t in some["text"]], some["native"].to_numpy(), share, some["near"].to_numpy())
        linked = roots != np.arange(len(ids))
        links.append(pd.DataFrame({"a": ids[linked], "b": ids[roots[linked]]}))
    return pd.concat(links)


def packed(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Regions of ``rows`` dealt into packs of about CHUNK together. ``sizes`` has the regions' weights, CHUNK each at most."""
    packs = max(1, -(-(sizes.agg(F.sum("m")).first()[0] or 0) // CHUNK))
    return rows.withColumn("pack", F.pmod(F.xxhash64("region"), F.lit(packs)))


def core(frame: pd.DataFrame, width: int) -> pd.DataFrame:
    """The shingles that at least half of some sampled documents of a region hold."""
    shingles = Shingles()
    names, held = np.unique(np.concatenate([shingles.of(t, width) for t in frame["text"]]), return_counts=True)
    return pd.DataFrame({"region": [frame["region"].iloc[0]], "core": [names[2 * held >= len(frame)].view(np.int64)]})


def beside(rows: DataFrame, given: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """The rows of large regions dealt into blocks, a copy of what is ``given`` for a region beside each of its blocks, and the keys."""
    blocks = F.ceil(F.col("m") / CHUNK)
    counts = rows.select("region", blocks.alias("blocks")).distinct()
    copies = given.join(counts, "region").withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))).drop("blocks")
    copies = copies.select(*(F.col(c).alias(c) for c in copies.columns))
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(10)), blocks)), copies, ["region", "block"]


def choose_pivots(rows: DataFrame, scratch: Scratch, name: str, width: int, share: int) -> DataFrame:
    """(region, pivot, text, central): of each large region the document nearest to the core of a sample, and a few by a hash."""

    def cores(frame: pd.DataFrame) -> pd.DataFrame:
        return core(frame, width)

    def nearness(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        middle = np.array(right["core"].iloc[0] if len(right) else [], np.int64).view(np.uint64)
        if not len(left) or not len(middle):
            return pd.DataFrame({"region": [], "doc_id": [], "apart": []})
        shingles = Shingles()
        apart, _ = distance_to(middle, [shingles.of(t, width) for t in left["text"]], share)
        return left[["region", "doc_id"]].assign(apart=apart).sort_values(["apart", "doc_id"]).head(1)

    turn = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000)) * F.col("m")
    middles = scratch.write(rows.filter(turn < 1_000_000 * SAMPLED).groupBy("region").applyInPandas(cores, "region long, core array<long>"), f"core-{name}")
    left, right, keys = beside(rows, middles)
    nearest = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearness, "region long, doc_id long, apart double")
    central = nearest.groupBy("region").agg(F.min_by("doc_id", F.struct("apart", "doc_id")).alias("central"))
    chosen = rows.join(scratch.write(central, f"central-{name}"), "region", "left").withColumn("is_central", F.coalesce(F.col("doc_id") == F.col("central"), F.lit(False)))
    chosen = chosen.filter(F.col("is_central") | (turn < 1_000_000 * DRAWN))
    return scratch.write(chosen.groupBy("region", F.col("doc_id").alias("pivot")).agg(F.min("text").alias("text"), F.max("is_central").alias("central")), f"pivots-{name}")


def split(left: pd.DataFrame, right: pd.DataFrame, width: int, share: int) -> pd.DataFrame:
    """A block of a large region's documents in the regions of its pivots. Pivots so near to an earlier one that windows would cover
    both regions are left out."""
    import xxhash

    columns = ["region", "native", "near", "pivot", "doc_id", "text", "weight", "of"]
    if not len(left):
        return pd.DataFrame(columns=columns)
    shingles, radius = Shingles(), 1 - share / 100
    sets, kept, names, apart, near = [shingles.of(t, width) for t in left["text"]], [], [], [], []
    for name, text in right.sort_values(["central", "pivot"], ascending=[False, True])[["pivot", "text"]].itertuples(index=False):
        pivot = shingles.of(text, width)
        if not kept or distance_to(pivot, kept, share)[0].min() > 4 * radius:
            kept.append(pivot)
            names.append(name)
            for held, found in zip((apart, near), distance_to(pivot, sets, share), strict=True):
                held.append(found)
    own, reached = voronoi(np.array(apart).reshape(-1, len(sets)), radius)
    near.append(np.zeros(len(sets), bool))
    out = []
    for k, pivot in enumerate([*names, None]):
        region = xxhash.xxh64_intdigest(f"{left['region'].iloc[0]}/{pivot}") >> 1
        if reached[k].any():
            some = left[reached[k]].rename(columns={"m": "of"})
            out.append(some.assign(pivot=pivot, near=near[k][reached[k]], region=region, native=some["native"] & (own == k)[reached[k]]))
    return pd.concat(out)[columns].astype({"pivot": "Int64"})


def without_lone(rows: DataFrame, width: int, share: int) -> DataFrame:
    """Rows of regions, (region, near, doc_id, text and more), without those that hold so many shingles which no other document of
    the region holds that they can link with none. Rows that link with a pivot stay.

    A partner holds at most the c shingles that are not a document's own, and no fewer shingles in all than the smallest
    size in the region that a partner can have; with those the similarity is at its highest.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in zip(*_twice(batches, width), strict=True):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), sets.column(0)], ["region", "text_id", "shingles"])

    text_id = F.xxhash64("text")
    exploded = rows.select("region", "text", text_id.alias("text_id")).mapInArrow(listed, "region long, text_id long, shingles array<long>")
    exploded = exploded.select("region", "text_id", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    reach = f"RANGE BETWEEN {1e-9 - float(np.log(share / 100))!r}D PRECEDING AND CURRENT ROW"
    sizes = exploded.select("region", "n").distinct().selectExpr("region", "n", f"min(n) OVER (PARTITION BY region ORDER BY ln(n) {reach}) AS smallest")
    once = exploded.groupBy("region", "shingle").agg(F.count("*").alias("times"), F.max("text_id").alias("text_id"), F.max("n").alias("n")).filter("times = 1")
    lone = once.groupBy("region", "text_id").agg(F.count("*").alias("own"), F.max("n").alias("n")).join(sizes, ["region", "n"])
    held = F.col("n") - F.col("own")
    lone = lone.filter(100 * held < share * (F.col("n") + F.greatest("smallest", held) - held))
    lone = lone.select("region", "text_id", F.lit(True).alias("lone"))
    return rows.withColumn("text_id", text_id).join(lone, ["region", "text_id"], "left").filter("near OR lone IS NULL").drop("lone", "text_id")


def _twice(batches: Iterator[pa.RecordBatch], width: int) -> tuple[Iterator[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    """Batches (region, text, ...) and the shingles of their texts."""
    one, two = tee(batches)
    return one, _listed((b.select([1]) for b in two), width)


def in_chunks(rows: DataFrame) -> DataFrame:
    """Regions that pivots cannot split, as pairs of chunks. Rows that link with the region's pivot are connected already and meet no
    other such; the rest meets these and itself. In a pair the first chunk's rows are native."""
    rows = rows.withColumn("part", F.col("near").cast("int"))
    sums = rows.groupBy("region").agg(*(F.ceil(F.sum(F.when(F.col("near") == near, F.col("weight")).otherwise(0)) / CHUNK).cast("long").alias(c) for near, c in ((False, "open"), (True, "closed"))))
    dealt = rows.join(sums, "region").filter("open > 0").withColumn("c", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.when(F.col("near"), F.col("closed")).otherwise(F.col("open"))))
    first = dealt.filter("NOT near").withColumn("i", F.col("c")).withColumn("j", F.explode(F.expr("sequence(c, open + closed - 1)"))).withColumn("native", F.lit(True))
    second = dealt.filter("near OR c > 0").withColumn("j", F.when(F.col("near"), F.col("c") + F.col("open")).otherwise(F.col("c")))
    second = second.withColumn("i", F.explode(F.when(F.col("near"), F.expr("sequence(0L, open - 1)")).otherwise(F.expr("sequence(0L, c - 1)")))).withColumn("native", F.lit(False))
    return first.unionByName(second).select(F.xxhash64("region", "i", "j").alias("region"), "native", "near", "doc_id", "text")


def links_of_large(large: DataFrame, scratch: Scratch, width: int, share: int) -> list[DataFrame]:
    """Links (a, b) that connect what belongs together in regions (region, native, doc_id, text, weight, m) of more than CHUNK.

    Each round splits all of them by pivots. Regions that are connected or without natives are done, small ones are joined in a task,
    large ones that shrank go on, and those that did not are joined chunk by chunk.
    """

    def cut(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return split(left, right, width, share)

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        return join_packed(frame, width, share)

    columns, links, level = ["region", "native", "near", "doc_id", "text"], [], 0
    while not large.isEmpty():
        level += 1
        left, right, keys = beside(large, choose_pivots(large, scratch, str(level), width, share))
        schema = "region long, native boolean, near boolean, pivot long, doc_id long, text string, weight long, of long"
        placed = scratch.write(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(cut, schema), f"placed-{level}")
        found = [placed.filter("near AND doc_id <> pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b"))]
        sizes = placed.groupBy("region").agg(F.sum("weight").alias("m"), F.max("of").alias("before"), F.max("native").alias("any_native"), F.min("near").alias("whole"), F.count("*").alias("rows"))
        sizes = scratch.write(sizes.filter("any_native AND NOT whole AND rows > 1").select("region", "m", "before"), f"sizes-{level}")
        fits, shrank = F.col("m") <= CHUNK, F.col("m") <= SHRUNK * F.col("before")
        placed = placed.drop("of")
        small = sizes.filter(fits).select("region", "m")
        found.append(packed(placed.join(small, "region").select(columns), small).groupBy("pack").applyInPandas(joined, "a long, b long"))
        stuck = placed.join(sizes.filter(~fits & ~shrank).select("region"), "region").select(*columns, "weight")
        stuck = scratch.write(without_lone(stuck, width, share), f"stuck-{level}")
        found.append(in_chunks(stuck).groupBy("region").applyInPandas(joined, "a long, b long"))
        links.append(scratch.write(reduce(DataFrame.unionByName, found), f"links-{level}"))
        large = scratch.write(placed.join(sizes.filter(~fits & shrank).select("region", "m"), "region").select("region", "native", "doc_id", "text", "weight", "m"), f"large-{level}")
        for gone in (f"placed-{level}", f"stuck-{level}", f"large-{level - 1}"):
            scratch.drop(gone)
    return links


def link(documents: DataFrame, scratch: Scratch, width: int = 5, share: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``documents`` (doc_id, text).

    A set holds the distinct shingles of ``width`` words (white space is ASCII, A-Z lower-cased), or the whole sequence if it is
    shorter; without words it is empty and links with nothing. Documents link when their sets' Jaccard similarity is at
    least ``share`` percent. component_id is the smallest doc_id that links reach. Rows that repeat an id with different texts
    count as one document with several sets. A null id links with nothing and keeps a null component_id. Shingles are compared by 64-bit
    hashes.
    """
    texts = documents.select("doc_id", "text")

    common = documents.sparkSession.sparkContext.broadcast(common_shingles(texts, width))

    def describe(batches):
        return _describe(batches, width, share, common.value)

    described = scratch.write(texts.mapInArrow(describe, "doc_id long, n long, h1 long, h2 long, signatures array<long>"), "described")
    order = ["signature", "a"]
    pairs = described.agg(F.sum(F.size("signatures"))).first()[0] or 0
    tasks = max(1 + pairs // SORTED, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    entries = described.select(F.explode("signatures").alias("signature"), F.col("h1").alias("a")).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    met = scratch.write(entries.mapInArrow(_meetings, "signature long, a long, b long"), "met")
    sets = scratch.write(described.drop("signatures"), "sets")
    scratch.drop("described")
    ends = met.filter("a = b").select("signature", "a")
    across = ends.join(ends.groupBy("signature").agg(F.min("a").alias("b")), "signature")
    families = components(met.filter("a <> b").select("a", "b").unionByName(across.select("a", "b")), scratch, "families").select(F.col("v").alias("h1"), F.col("root").alias("family"))

    usable = sets.filter("n > 0 AND doc_id IS NOT NULL")
    same = usable.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    same = scratch.write(same.select("h1", "h2", F.col("n").alias("same_n"), "first"), "same")
    matched = usable.select("doc_id", "h1", "h2", "n").join(same, ["h1", "h2"]).filter("n = same_n AND doc_id <> first")
    copies = scratch.write(matched.select(F.col("doc_id").alias("a"), F.col("first").alias("b")), "copies")

    standing = usable.select("doc_id", "h1").join(copies.select(F.col("a").alias("doc_id")).hint("merge"), "doc_id", "left_anti")
    placed = standing.join(families.hint("merge"), "h1").select(F.col("family").alias("region"), "doc_id").distinct()
    weight = (F.length("text") / CHARACTERS + 1).cast("long").alias("weight")
    members = scratch.write(texts.join(placed.hint("merge"), "doc_id").select("region", F.lit(True).alias("native"), F.lit(False).alias("near"), "doc_id", "text", weight), "members")
    sizes = scratch.write(members.groupBy("region").agg(F.sum("weight").alias("m"), F.count("*").alias("rows")).filter("rows > 1").drop("rows"), "sizes")

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        return join_packed(frame, width, share)

    small = sizes.filter(F.col("m") <= CHUNK)
    links = [copies, packed(members.join(small.select("region"), "region"), small).groupBy("pack").applyInPandas(joined, "a long, b long")]
    links = [scratch.write(reduce(DataFrame.unionByName, links), "links-0")]
    large = scratch.write(members.drop("near").join(sizes.filter(F.col("m") > CHUNK), "region"), "large-0")
    scratch.drop("members")
    links += links_of_large(large, scratch, width, share)
    roots = components(reduce(DataFrame.unionByName, links), scratch, "linked")
    scratch.tidy("sets", "linked")
    told = sets.select("doc_id", F.col("n").alias("n_shingles")).join(roots.hint("merge"), F.col("doc_id") == F.col("v"), "left")
    return told.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
