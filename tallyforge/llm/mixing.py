"""Mixing sources to target weights.

Sizes are summed per source, targets follow from the weights, and a source's rate is its target over its size. Each document is
taken floor(rate) times, and once more if a draw seeded by its id falls below the rate's fraction. Only sums per source are
shuffled, so a source with a third of all rows costs no more than another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import Scratch, numbered

SEED = "mix-1"


def words(text: str = "text") -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: str, seed: str = SEED) -> Column:
    """A number from 0 up to 1 that depends on the id and the seed only."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / float(16**13)


def cycled_weights(totals: DataFrame, weights: list[int], scratch: Scratch) -> DataFrame:
    """Give ``totals`` (one row per source) the weights in turn, sources in order of code points, null last."""
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    return numbered(totals, [F.col("source").asc_nulls_last()], scratch, "lined").withColumn("weight", turn.cast("double")).drop("rank")


def targets(totals: DataFrame, share: float, most: float) -> DataFrame:
    """Add ``target`` and ``rate`` to (source, source_size, weight).

    The targets sum to ``share`` of all sizes, in proportion to the weights; none goes above ``most`` times its source's size, and
    what that cuts off is shared anew by weight among the others. Each round reads one row of sums; ``totals`` should be a table.
    """
    cap = F.col("source_size") * F.lit(most)
    level = 0.0
    while True:
        held = F.col("weight") * F.lit(level) > cap
        sums = totals.agg(
            F.sum(F.col("source_size")).alias("all"),
            F.coalesce(F.sum(F.when(held, cap)), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~held, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        if not sums["open"]:
            break
        higher = (share * (sums["all"] or 0) - sums["held"]) / sums["open"]
        if higher <= level:
            break
        level = higher
    target = F.least(cap, F.col("weight") * F.lit(level))
    return totals.withColumn("target", target).withColumn("rate", F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)))


def plan(sized: DataFrame, weights: list[int], share: float, most: float, scratch: Scratch) -> DataFrame:
    """``sized`` (with doc_id, source, size) plus source_size, target and ``copies``, the times that the mix takes the row.

    A null source is a source; sources of size 0 get nothing; the rows of an id draw alike, so reruns agree. Columns of ``sized``
    named like the added ones are replaced. The targets' table joins by broadcast only if Spark finds it small.
    """
    sized = sized.drop("source_size", "target", "rate", "weight", "copies")
    totals = scratch.write(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "totals")
    aims = scratch.write(targets(scratch.write(cycled_weights(totals, weights, scratch), "weighted"), share, most).withColumnRenamed("source", "aim_source"), "aims")
    joined = sized.join(aims, F.col("source").eqNullSafe(F.col("aim_source")))
    copies = F.floor("rate") + (draw("doc_id") < F.col("rate") - F.floor("rate")).cast("long")
    return joined.withColumn("copies", copies).drop("aim_source", "weight", "rate")


def mix(documents: DataFrame, weights: list[int], share: float, most: float, scratch: Scratch) -> DataFrame:
    """The mixed documents themselves: every row as many times as the plan says, with the columns of ``documents``."""
    named = documents.select(F.struct("*").alias("row"), "doc_id", "source", words().alias("size"))
    taken = plan(named, weights, share, most, scratch).filter("copies > 0")
    return taken.select("row", F.explode(F.expr("sequence(1L, copies)")).alias("copy")).select("row.*")


def report(documents: DataFrame, weights: list[int], share: float, most: float, scratch: Scratch) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    sized = scratch.write(documents.select("doc_id", "source", words().alias("size")), "sized")
    planned = plan(sized, weights, share, most, scratch)
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT source, source_size,
         [3, 1, 2][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM totals),
rounds AS (
  SELECT 0 AS k, 0.0::DOUBLE AS level
  UNION ALL
  SELECT k + 1, (SELECT (1.5 * sum(source_size) - coalesce(sum(CASE WHEN weight * r.level > 2.0 * source_size THEN 2.0 * source_size END), 0))
                        / sum(CASE WHEN weight * r.level > 2.0 * source_size THEN NULL ELSE weight END) FROM weighted)
  FROM rounds r WHERE k < 60),
aims AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * (SELECT max(level) FROM rounds)) AS target FROM weighted),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM aims),
drawn AS (
  SELECT doc_id, source, size, ('0x' || substr(md5('{SEED}:' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE / {float(16**13)} AS u FROM sized)
SELECT d.doc_id, d.size, r.source_size, r.target,
       (d.size * (floor(r.rate) + CASE WHEN d.u < r.rate - floor(r.rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM drawn d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source
"""
