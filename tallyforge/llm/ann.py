"""Approximate nearest neighbours by cosine: inverted lists, scanned in blocks of rotated dimensions with early abandoning.

Vectors are made unit vectors and turned by a random rotation, after which any few dimensions hold a fair share of a squared distance. Each
goes to the list of its nearest centre. A list's part is stored by columns, in blocks of dimensions. A query adds up squared differences
block by block; after each block a candidate is dropped if its partial distance is too large for one that ends within the best so far,
by a test whose chance to err falls with the square of ``DOUBT``. Those that last are scored exactly on the original vectors.

A query first scans its ``FIRST`` nearest lists. From the k-th best it then has, and from each other list's size, mean nearness to its centre
and spread around it, follows how many members of that list are expected to be better. Lists are scanned by that number until
what the rest is expected to hold is at most ``MISSED`` of k. So a query in a dense region stops early, and where vectors have no structure
it scans as many lists as it must.

Equal vectors are one row with their smallest ids, so copies cost nothing. The centres are fitted on a bounded sample; every row is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import Scratch

#: Components of the vectors that the centres are fitted on, about (131,072 vectors of 64); rounds of fitting.
SAMPLE, ROUNDS = 1 << 23, 8
#: Lists of a width: at least, at most, the rows of one that are aimed at, and the rows of the sample for each.
LEAST, MOST, ROWS, FITTED = 64, 2048, 4096, 48
#: Rows of a part of a list, and rows that are scanned before the bound is set anew.
PART, CHUNK = 2048, 512
#: Dimensions of a block.
BLOCK = 16
#: Weight of the deviation that a partial distance is allowed.
DOUBT = 2.1
#: Lists that a query scans at first, and the share of its k nearest that may be expected in those that it leaves out.
FIRST, MISSED = 8, 0.03


def unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; powers of two keep squares in range and change no digit of a quotient."""
    found = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])
    return found / np.sqrt((found * found).sum(axis=1, keepdims=True))


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact cosines, in double precision, of a vector with others."""
    scaled = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])
    query = np.ldexp(query, -np.frexp(np.abs(query).max())[1])
    return (scaled * query).sum(axis=1) / (np.sqrt((scaled * scaled).sum(axis=1)) * np.sqrt((query * query).sum()))


def rotation(width: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng([12, width]).standard_normal((width, width)))[0]


def nearest(vectors: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each unit vector, and the cosine with it."""
    which, near = np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
    for start in range(0, len(vectors), 1024):
        found = vectors[start : start + 1024] @ of.T
        which[start : start + 1024] = best = found.argmax(axis=1)
        near[start : start + 1024] = found[np.arange(len(best)), best]
    return which, near


def centres(vectors: np.ndarray, lists: int) -> np.ndarray:
    """Unit centres of ``lists`` groups of unit vectors."""
    found = vectors[np.random.default_rng(12).choice(len(vectors), lists, replace=False)]
    for _ in range(ROUNDS):
        sums = np.zeros_like(found)
        np.add.at(sums, nearest(vectors, found)[0], vectors)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        found = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), found)
    return found


class Lists:
    """Of one width: the centres, and of each list its rows, its parts, the mean cosine with the centre and the mean square beside it."""

    def __init__(self, found: np.ndarray):
        self.centres = found
        self.rows = np.zeros(len(found), np.int64)
        self.mean, self.spread = np.zeros(len(found)), np.ones(len(found))

    def nearest(self, query: np.ndarray) -> np.ndarray:
        return np.argsort(-(self.centres @ query), kind="stable")

    def others(self, query: np.ndarray, least: float, first: int, missed: float) -> np.ndarray:
        """The lists to scan beyond the ``first`` nearest, where ``least`` is the k-th best cosine so far; the others are expected to hold
        ``missed`` better members at most."""
        near = self.centres @ query
        rest = self.nearest(query)[first:]
        if not np.isfinite(least):
            return rest[self.rows[rest] > 0]
        across = np.sqrt(np.maximum(1 - near * near, 1e-12) * np.maximum(self.spread, 1e-12) / max(1, self.centres.shape[1] - 1))
        expected = self.rows * tail((least - near * self.mean) / across)
        by = rest[np.argsort(-expected[rest], kind="stable")]
        left = expected[by][::-1].cumsum()[::-1]
        return by[left > missed]


def tail(z: np.ndarray) -> np.ndarray:
    """The normal distribution's share above z, by a rational approximation."""
    t = 1 / (1 + 0.2316419 * np.abs(z))
    terms = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    above = np.exp(-z * z / 2) / np.sqrt(2 * np.pi) * sum(c * t ** (i + 1) for i, c in enumerate(terms))
    return np.where(z >= 0, above, 1 - above)


class Part:
    """A part of a list: exact vectors, and the rotated ones by blocks of columns."""

    def __init__(self, ids: list, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.first = np.array([of[0]["vec_id"] for of in ids])
        self.turn = rotation(vectors.shape[1])
        rotated = unit(vectors) @ self.turn
        self.blocks = [np.ascontiguousarray(rotated[:, at : at + BLOCK]) for at in range(0, rotated.shape[1], BLOCK)]

    def search(self, query: np.ndarray, k: int, least: float, doubt: float, chunk: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k best, of those that reach ``least``."""
        width = len(query)
        rotated = (unit(query[None, :]) @ self.turn)[0]
        best, scores = np.zeros(0, np.int64), np.zeros(0)
        for start in range(0, len(self.vectors), chunk):
            alive, seen = np.arange(start, min(start + chunk, len(self.vectors))), 0
            far = np.zeros(len(alive))
            for block in self.blocks:
                differ = block[alive] - rotated[seen : seen + block.shape[1]]
                far += np.einsum("ij,ij->i", differ, differ)
                seen += block.shape[1]
                if np.isfinite(least):
                    allowed = (2 - 2 * least) * (seen / width * (1 + doubt / np.sqrt(seen)) ** 2 if seen < width else 1) + 1e-9
                    kept = far <= allowed
                    alive, far = alive[kept], far[kept]
            best, scores = np.append(best, alive), np.append(scores, cosines(query, self.vectors[alive]))
            order = np.lexsort((self.first[best], -scores))[:k]
            best, scores = best[order], scores[order]
            if len(best) == k:
                least = max(least, scores[-1])
        return best, scores


def stacked(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _sampled(frame: pd.DataFrame) -> pd.DataFrame:
    vectors = unit(np.stack(frame["embedding"].to_list()).astype(np.float64))
    lists = int(min(frame["lists"].iloc[0], max(1, len(vectors) // FITTED)))
    return pd.DataFrame({"width": vectors.shape[1], "centre": list(centres(vectors, lists))})


def by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    widths = batch.column("width").to_numpy(zero_copy_only=False)
    for width in np.unique(widths):
        yield int(width), batch.take(pa.array(np.flatnonzero(widths == width)))


def _placed(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """Adds list, near (the cosine with the centre) to rows."""
    for whole in batches:
        for width, batch in by_width(whole):
            lists = model.value.get(width)
            which, near = nearest(unit(stacked(batch.column("embedding"), width)), lists.centres if lists else np.zeros((1, width)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(which), pa.array(near)], [*batch.schema.names, "list", "near"])


def _sent(batches: Iterator[pa.RecordBatch], model, first: int, missed: float, rows: int, later: bool) -> Iterator[pa.RecordBatch]:
    """(width, list, part, class, embedding, least): the parts, of ``rows`` rows about, that each query (class, width, embedding, least) is to scan."""
    names = ["width", "list", "part", "class", "embedding", "least"]
    for whole in batches:
        for width, batch in by_width(whole):
            lists = model.value.get(width) or Lists(np.zeros((1, width)))
            queries, bounds = unit(stacked(batch.column("embedding"), width)), batch.column("least").to_numpy(zero_copy_only=False)
            for i, (query, least) in enumerate(zip(queries, bounds, strict=True)):
                which = lists.others(query, least, first, missed) if later else lists.nearest(query)[:first]
                parts = -(-lists.rows[which] // rows)
                taken = batch.take(pa.array(np.full(parts.sum(), i)))
                part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                columns = [taken.column("width"), pa.array(np.repeat(which, parts).astype(np.int32)), pa.array(part.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, *(taken.column(c) for c in names[3:])], names)


def _scanned(batches: Iterator[pa.RecordBatch], k: int, doubt: float, chunk: int) -> Iterator[pa.RecordBatch]:
    """(class, ids, score) from rows (width, list, part, asks, class, ids, embedding, least) in which each part's rows come before its queries."""
    key, ids, vectors, part = None, [], [], None
    schema = pa.schema([("class", pa.int64()), ("ids", pa.list_(pa.struct([("vec_id", pa.int64()), ("copies", pa.int32())]))), ("score", pa.float64())])
    for batch in batches:
        of = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        new = np.append(True, np.any([c[1:] != c[:-1] for c in of], axis=0))[: batch.num_rows]
        edges = np.flatnonzero(new).tolist()
        classes, answers, scores = [], [], []
        for start, stop in zip(edges, [*edges[1:], batch.num_rows], strict=False):
            if key != (here := tuple(int(c[start]) for c in of[:3])):
                key, ids, vectors, part = here, [], [], None
            some = batch.slice(start, stop - start)
            rows = stacked(some.column("embedding"), key[0])
            if not of[3][start]:
                ids += some.column("ids").to_pylist()
                vectors.append(rows)
            elif vectors:
                part = part or Part(ids, np.concatenate(vectors))
                for asked, query, least in zip(some.column("class").to_pylist(), rows, some.column("least").to_numpy(zero_copy_only=False), strict=True):
                    best, found = part.search(query, k, least, doubt, chunk)
                    classes += [asked] * len(best)
                    answers += [part.ids[i] for i in best]
                    scores += found.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(answers, schema.field("ids").type), pa.array(scores, pa.float64())], schema=schema)


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """(class, width, embedding, ids): one row for each different vector, with its k + 1 smallest ids and how many rows have each, k at most."""
    same = ["width", "h1", "h2"]
    each = rows.groupBy(*same, "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"), F.first("embedding").alias("embedding"))
    rank = F.row_number().over(Window.partitionBy(*same).orderBy("vec_id"))
    found = each.withColumn("rank", rank).filter(F.col("rank") <= k + 1).groupBy(*same)
    found = found.agg(F.first("embedding").alias("embedding"), F.array_sort(F.collect_list(F.struct("vec_id", "copies"))).alias("ids"))
    return found.withColumn("class", F.monotonically_increasing_id())


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding, width, h1, h2) of the rows whose vectors take part."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.expr("vec_id IS NOT NULL AND size(embedding) > 0") & ~odd & F.exists("embedding", lambda x: x != 0)
    positive = F.transform("embedding", lambda x: x + 0.0)  # minus zero is zero
    rows = embeddings.filter(F.coalesce(fit, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), positive.cast("array<double>").alias("embedding"))
    return rows.select("*", F.size("embedding").alias("width"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))


def fitted(classes: DataFrame) -> dict[int, Lists]:
    """The centres of each width, from a sample of about ``SAMPLE`` vectors drawn by hash; a width that the sample lacks has one list."""
    sizes = classes.groupBy("width").agg(F.count("*").alias("rows"))
    total = classes.agg(F.sum("width")).first()[0] or 1
    lists = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.ceil(F.col("rows") / ROWS)))
    drawn = classes.filter(F.pmod("h1", F.lit(1_000_003)) < F.lit(-(-1_000_003 * SAMPLE // max(total, SAMPLE))))
    drawn = drawn.select("width", "embedding").join(F.broadcast(sizes.select("width", lists.alias("lists"))), "width")
    rows = drawn.groupBy("width").applyInPandas(_sampled, "width int, centre array<double>").collect()
    found: dict[int, list] = {}
    for row in rows:
        found.setdefault(row.width, []).append(row.centre)
    return {width: Lists(np.array(of)) for width, of in found.items()}


def search(vectors: DataFrame, queries: DataFrame, scratch: Scratch, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k nearest rows found by cosine among the vectors of equal width, all if fewer.

    ``queries`` are rows of ``vectors`` (vec_id, embedding). Rows with the query's own id are left out; equal scores go to the smaller
    id. The score is the exact cosine of the original vectors. Rows that repeat an id count each as candidates; query rows that repeat an id and
    its vector are one query, with other vectors of that id each is a query of its own. Null ids, and vectors null, empty, zero or with
    null or non-finite components take no part. An empty table gives no rows. A neighbour can be missed where its list was not expected
    to hold one, or where its partial distance was unusually large.
    """
    context = vectors.sparkSession.sparkContext
    same = ["width", "h1", "h2"]
    classes = scratch.write(classes_of(usable(vectors), k), "classes")
    asked = usable(queries).select("vec_id", *same).distinct().withColumnRenamed("vec_id", "query_id")
    asked = scratch.write(asked.join(classes.select("class", *same), same).select("query_id", "class"), "asked")
    most = asked.groupBy("query_id").count().agg(F.max("count")).first()[0] or 1  # of an id's vectors, none is a candidate
    held = k + int(most)

    model = fitted(classes)
    shared = context.broadcast(model)
    fields = "class long, width int, embedding array<double>"
    placed = classes.select("class", "width", "embedding", "ids").mapInArrow(partial(_placed, model=shared), f"{fields}, ids array<struct<vec_id:long,copies:int>>, list int, near double")
    placed = scratch.write(placed, "placed")
    sizes = placed.groupBy("width", "list").agg(F.count("*").alias("rows"), F.avg("near").alias("mean"), F.avg(1 - F.col("near") * F.col("near")).alias("spread"))
    sizes = scratch.write(sizes, "sizes")
    for row in sizes.collect():
        of = model.setdefault(row.width, Lists(np.zeros((1, row.width))))
        of.rows[row.list], of.mean[row.list], of.spread[row.list] = row.rows, row.mean, row.spread
    shared = context.broadcast(model)
    of_list = sizes.select("width", "list", F.ceil(F.col("rows") / PART).alias("parts"))
    part = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int").alias("part")
    none = F.lit(None).cast("array<struct<vec_id:long,copies:int>>").alias("ids")
    stored = placed.join(F.broadcast(of_list), ["width", "list"]).select("width", "list", part, F.lit(False).alias("asks"), "class", "ids", "embedding", F.lit(float("-inf")).alias("least"))

    def answered(rows: DataFrame, later: bool) -> DataFrame:
        sent = rows.select("class", "width", "embedding", "least").mapInArrow(partial(_sent, model=shared, first=FIRST, missed=MISSED * k, rows=PART, later=later), "width int, list int, part int, class long, embedding array<double>, least double")
        sent = sent.select("width", "list", "part", F.lit(True).alias("asks"), "class", none, "embedding", "least")
        met = stored.unionByName(sent).repartition("width", "list", "part").sortWithinPartitions("width", "list", "part", "asks")
        return met.mapInArrow(partial(_scanned, k=held, doubt=DOUBT, chunk=CHUNK), "class long, ids array<struct<vec_id:long,copies:int>>, score double")

    def best(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("score"), F.col("ids")[0]["vec_id"]))
        return found.withColumn("place", rank).filter(F.col("place") <= held).drop("place")

    rows = classes.join(asked.select("class").distinct(), "class").select("class", "width", "embedding")
    first = scratch.write(best(answered(rows.withColumn("least", F.lit(float("-inf"))), False)), "first")
    least = first.groupBy("class").agg(F.when(F.count("*") >= held, F.min("score")).otherwise(float("-inf")).alias("least"))
    second = answered(rows.join(least, "class"), True)
    found = scratch.write(best(first.unionByName(second)), "found")
    each = found.join(asked, "class").select("query_id", "class", "score", F.explode("ids").alias("one")).filter("one.vec_id <> query_id")
    each = each.select("query_id", "class", "score", "one.vec_id", F.explode(F.sequence(F.lit(1), F.col("one.copies"))))
    rank = F.row_number().over(Window.partitionBy("query_id", "class").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

