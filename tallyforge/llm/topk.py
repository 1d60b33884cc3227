"""Exact top-k search by inner product over an impact-ordered index, score at a time.

Vectors are dealt into blocks. In a block, the rows whose component j falls on quantised level l form the posting segment (j, l).
For a query, a segment's impact is the most that its level can add to a score. Segments are processed in waves of descending
impact; every row has a bound: what its processed segments add at most, plus the current impact for each component not yet
seen. Processing stops only when the rows whose bounds reach the k-th best exact score so far are few (or segments have run
out); those possible members are rescored exactly. A query meets one block first; the k-th score it has from there is the least that
counts in the others. A task holds one block's index at a time and its queries stream past. Results are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block.
BLOCK = 16_384
#: Components are scaled by this and floored.
SCALE = 1024
#: Values of a quantised level.
STEP = 32
#: Share of a block's postings that a wave processes, and possible members that may be rescored.
WAVE, FEW = 16, 128
#: A score may be this large at most, so that sums of products stay whole.
LARGEST = 1 << 62


class Index:
    """Impact-ordered postings of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        rows, self.width = self.vectors.shape
        levels = np.floor_divide(self.vectors, STEP)
        keyed = np.argsort(levels, axis=0, kind="stable")
        self.postings = keyed.T.ravel().astype(np.int32)
        sorted_levels = np.take_along_axis(levels, keyed, 0).T
        new = np.ones(sorted_levels.shape, bool)
        new[:, 1:] = sorted_levels[:, 1:] != sorted_levels[:, :-1]
        self.starts = np.flatnonzero(new.ravel())
        self.lengths = np.diff(np.append(self.starts, rows * self.width))
        self.component = self.starts // max(rows, 1)
        self.low = sorted_levels.ravel()[self.starts] * STEP

    def search(self, query: np.ndarray, own: int, k: int, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best of the block, its own row left out, of those that score ``least`` at least."""
        n = len(self.ids)
        weights = query[self.component]
        impact = np.maximum(weights * self.low, weights * (self.low + STEP - 1))
        order = np.argsort(-impact, kind="stable")
        ends = np.cumsum(self.lengths[order])
        others = self.ids != own
        reached, seen = np.zeros(n), np.zeros(n)
        at, per_wave = 0, max(1, ends[-1] // WAVE)
        members = np.arange(n)
        while at < len(order):
            last = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + per_wave, "right")))
            some = order[at:last]
            lengths = self.lengths[some]
            places = np.arange(lengths.sum()) + np.repeat(self.starts[some] - np.append(0, np.cumsum(lengths)[:-1]), lengths)
            rows = self.postings[places]
            reached += np.bincount(rows, np.repeat(impact[some], lengths), n)
            seen += np.bincount(rows, minlength=n)
            at = last
            following = impact[order[at]] if at < len(order) else 0
            bounds = np.where(others, reached + (self.width - seen) * following, -np.inf)
            if others.sum() <= k:
                break
            best = np.argpartition(-bounds, k - 1)[:k]
            worst = (self.vectors[best] @ query).min()
            worst = worst if least is None else max(worst, least)
            members = np.flatnonzero(bounds >= worst)
            if len(members) <= FEW:
                break
        members = members[others[members]]
        ids, scores = self.ids[members], self.vectors[members] @ query
        if least is not None:
            ids, scores = ids[scores >= least], scores[scores >= least]
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]


def whole_numbers(column: pa.ListArray, width: int) -> np.ndarray:
    """A list column's vectors as scaled whole numbers. Vectors too large for exact scores are an error."""
    found = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width) * SCALE)
    if len(found) and np.abs(found).max() ** 2 * width > LARGEST:
        raise ValueError("components are too large for exact 64-bit scores")
    return found.astype(np.int64)


def _answers(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, twin, vec_id, score) from rows (width, block, twin, least, vec_id, embedding) in which each block's vectors, twin null,
    come before its queries."""
    key, ids, vectors, index = None, [], [], None
    for batch in batches:
        width, block = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        asks = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.append(True, (width[1:] != width[:-1]) | (block[1:] != block[:-1]) | (asks[1:] != asks[:-1]))[: len(width)])
        found = []
        for start, end in zip(starts, [*starts[1:], len(width)], strict=True):
            if key != (width[start], block[start]):
                key, ids, vectors, index = (width[start], block[start]), [], [], None
            some = batch.slice(start, end - start)
            numbers = whole_numbers(some.column(5), int(key[0]))
            if not asks[start]:
                ids.append(some.column(4).to_numpy())
                vectors.append(numbers)
            elif vectors:
                index = index or Index(np.concatenate(ids), np.concatenate(vectors))
                for query, twin, least, vector in zip(some.column(4).to_pylist(), some.column(2).to_pylist(), some.column(3).to_pylist(), numbers, strict=True):
                    best, scores = index.search(vector, query, k, least)
                    found.append((np.full(len(best), query), np.full(len(best), twin), best, scores))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "twin", "vec_id", "score"])


def usable(embeddings: DataFrame) -> DataFrame:
    """Rows with an id and a vector without null or non-finite components, and the vector's width."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embeddings.filter("vec_id IS NOT NULL AND size(embedding) > 0").filter(~bad).select("vec_id", "embedding", F.size("embedding").alias("width"))


def dealt(of: str, n: int) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(n)).cast("int")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k best vectors of equal width by integer inner product, all if fewer.

    Both tables have vec_id and embedding. Rows with the query's own id are left out; equal scores go to the smaller id. Candidate rows
    that repeat an id count each. Query rows that repeat an id and its vector are one query; with other vectors of that id
    each is a query of its own, so the id has several rows of each rank. Null ids, null or empty vectors, and null or non-finite
    components take no part. Components so large that a score could exceed 62 bits are an error. An empty table gives no rows.
    """
    vectors, queries = usable(vectors), usable(queries).withColumn("twin", F.xxhash64("embedding")).dropDuplicates(["vec_id", "twin"])
    blocks = max(1, -(-vectors.count() // BLOCK))
    stored = vectors.select("width", dealt("vec_id", blocks).alias("block"), F.lit(None).cast("long").alias("twin"), F.lit(None).cast("long").alias("least"), "vec_id", "embedding")
    columns = stored.columns
    same, home = ["query_id", "twin"], dealt("twin", blocks)

    def answered(asked: DataFrame) -> DataFrame:
        rows = stored.unionByName(asked.select(columns)).repartition("width", "block").sortWithinPartitions("width", "block", F.col("twin").asc_nulls_first())
        return rows.mapInArrow(lambda batches: _answers(batches, k), "query_id long, twin long, vec_id long, score long")

    found = answered(queries.withColumn("block", home).withColumn("least", F.lit(None).cast("long")))
    if blocks > 1:
        least = found.groupBy(*same).agg(F.when(F.count("*") >= k, F.min("score")).alias("least")).withColumnRenamed("query_id", "vec_id")
        elsewhere = F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b != home)
        found = found.unionByName(answered(queries.join(least, ["vec_id", "twin"], "left").withColumn("block", F.explode(elsewhere))))
    rank = F.row_number().over(Window.partitionBy(*same).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
