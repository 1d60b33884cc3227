"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of line hashes, bucketed and sorted by them, in which each line stands once, with the number of documents that held it
and the largest of their ids. A new batch of documents is dealt to the same buckets once and merge-anti-joined with run after run, none
of which moves: its unseen lines become a run of their own, its other lines go to the table of repeats, so runs never share a
line and their merging needs no sums. When a level has ``FAN_IN`` runs, they are merged bucket by bucket into one run of the next level.
Few lines ever repeat; only those are summed at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import Scratch

#: Runs of a level that are merged into one of the next.
FAN_IN = 2
#: Batches into which a whole table is dealt; lines that a bucket is for, and how few and many buckets there may be.
BATCHES, BUCKET, FEWEST, MOST = 4, 4_000_000, 8, 100_000
#: Tasks that the documents of one line are dealt to.
SALTS = 16
KEY = ["h1", "h2"]
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def hashes(key: Column) -> list[Column]:
    """Two independent 64-bit hashes; together they tell any lines apart."""
    return [F.xxhash64(key), F.xxhash64(F.lit(1), key)]


def split_lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def line_hashes(documents: DataFrame, shortest: int) -> DataFrame:
    """(doc_id, h1, h2): each document's distinct line keys of at least ``shortest`` code points. Rows without an id have none."""
    keys = F.array_distinct(F.filter(F.transform(split_lines("text"), line_key), lambda k: F.length(k) >= shortest))
    rows = documents.filter("doc_id IS NOT NULL").select("doc_id", F.explode(keys).alias("key"))
    h1, h2 = hashes(F.col("key"))
    return rows.select("doc_id", h1.alias("h1"), h2.alias("h2"))


class LineRuns:
    """The runs of all batches so far, in ``buckets`` buckets each."""

    def __init__(self, scratch: Scratch, buckets: int = FEWEST):
        self.scratch, self.buckets = scratch, buckets
        self.levels: list[list[tuple[str, DataFrame]]] = []
        self.repeats: list[DataFrame] = []
        self.made = 0

    def _write(self, kind: str, df: DataFrame) -> tuple[str, DataFrame]:
        """Write rows whose partitions are buckets; each becomes one sorted file."""
        self.made += 1
        return f"{kind}-{self.made}", self.scratch.bucketed(df, f"{kind}-{self.made}", self.buckets, KEY)

    def runs(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [t for level in self.levels for _, t in level])

    def add(self, batch: DataFrame) -> None:
        """Take in (h1, h2, docs, last), one row per line of the batch."""
        dealt = batch.repartition(self.buckets, *KEY)
        runs = [t.select(*KEY).hint("merge") for level in self.levels for _, t in level]
        if runs:
            seen = [dealt.join(run, KEY, "left_semi") for run in runs]
            self.repeats.append(self._write("again", reduce(DataFrame.unionByName, seen).repartition(self.buckets, *KEY))[1])
        self._settle(0, self._write("run", reduce(lambda left, run: left.join(run, KEY, "left_anti"), runs, dealt)))

    def _settle(self, level: int, run: tuple[str, DataFrame]) -> None:
        """Put a run on its level; a full level is compacted into one run of the next."""
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= FAN_IN:
            old, self.levels[level] = self.levels[level], []
            merged = self._write("run", reduce(self._merged, [t for _, t in old]))
            for name, _ in old:
                self.scratch.drop(name)
            self._settle(level + 1, merged)

    @staticmethod
    def _merged(left: DataFrame, right: DataFrame) -> DataFrame:
        """Two runs as one. They share no line, so a full join of their buckets only puts them in order."""
        right = right.withColumnsRenamed({"docs": "other_docs", "last": "other_last"})
        both = left.join(right.hint("merge"), KEY, "full_outer")
        return both.select(*KEY, F.coalesce("docs", "other_docs").alias("docs"), F.coalesce("last", "other_last").alias("last"))

    def frequent(self, least: int) -> DataFrame:
        """(h1, h2, docs, last) of the lines that at least ``least`` documents hold."""
        runs = self.runs()
        enough = F.col("docs") >= least
        if not self.repeats:
            return runs.filter(enough)
        again = reduce(DataFrame.unionByName, self.repeats)
        names = again.select(*KEY).distinct().hint("merge")
        first = runs.join(names, KEY, "left_semi")
        total = first.unionByName(again).groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))
        return total.filter(enough).unionByName(runs.filter(enough).join(names, KEY, "left_anti"))


def frequent_lines(documents: DataFrame, shortest: int, least: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The documents' line hashes (doc_id, h1, h2), and the frequent ones among them (h1, h2, docs, last)."""
    held = scratch.write(line_hashes(documents, shortest), "lines")
    deal = F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES)).alias("batch")
    counted = held.groupBy(deal, *KEY).agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"))
    batches = scratch.write(counted, "batches", partition_by=["batch"])
    store = LineRuns(scratch, min(MOST, max(FEWEST, -(-held.count() // BUCKET))))
    for k in range(BATCHES):
        store.add(batches.filter(F.col("batch") == k).drop("batch"))
    return held, scratch.write(store.frequent(least), "frequent")


def dedup_lines(documents: DataFrame, scratch: Scratch, shortest: int = 40, least: int = 5) -> DataFrame:
    """``documents`` with repeated lines removed from ``text``, plus n_lines (before) and n_dropped.

    A line's key is the line without white space at its ends, A-Z lower-cased. A key of at least ``shortest`` code points that at
    least ``least`` documents hold loses its lines in every document but the one with the largest id. Other lines stay as they
    are, joined by line feeds. A null text counts as one empty line. Each row is a document: rows that repeat an id count each
    and keep alike. A row without an id is not counted and loses nothing. Columns already named like the added ones are replaced.
    """
    held, frequent = frequent_lines(documents, shortest, least, scratch)
    copies = frequent.select(*KEY, "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = held.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    lost = salted.join(copies.hint("merge"), [*KEY, "salt"]).filter(F.col("doc_id") != F.col("last"))
    lost = lost.groupBy(F.col("doc_id").alias("lost_id")).agg(F.collect_set(F.struct(*KEY)).alias("lost"))
    lost = scratch.write(lost, "lost")
    scratch.tidy("lost")
    joined = documents.drop("n_lines", "n_dropped", "lost", "lost_id").join(lost.hint("merge"), F.col("doc_id") == F.col("lost_id"), "left")

    def stays(line: Column) -> Column:
        h1, h2 = hashes(line_key(line))
        return ~F.array_contains(F.col("lost"), F.struct(h1.alias("h1"), h2.alias("h2")))

    lines = split_lines("text")
    kept = F.when(F.col("lost").isNull(), lines).otherwise(F.filter(lines, stays))
    told = joined.withColumn("n_lines", F.size(lines).cast("long")).withColumn("kept_lines", kept)
    told = told.withColumn("n_dropped", F.col("n_lines") - F.size("kept_lines"))
    return told.withColumn("text", F.array_join("kept_lines", "\n")).drop("kept_lines", "lost", "lost_id")


def digests(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_sha256."""
    done = dedup_lines(documents.select("doc_id", "text"), scratch)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, line, pos,
         translate(regexp_replace(regexp_replace(line, '^[ 	-
]+', ''), '[ 	-
]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
frequent AS (
  SELECT k, max(doc_id) AS last FROM (SELECT DISTINCT k, doc_id FROM keyed WHERE length(k) >= 40) GROUP BY k HAVING count(*) >= 5),
marked AS (
  SELECT y.doc_id, y.line, y.pos, (f.k IS NOT NULL AND y.doc_id <> f.last) AS gone FROM keyed y LEFT JOIN frequent f ON y.k = f.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
