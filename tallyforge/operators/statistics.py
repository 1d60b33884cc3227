"""Order statistics over all partitions, exact and without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.sources.scratch import Store

#: Bits of a row's number within its partition, as ``monotonically_increasing_id`` makes them.
BITS = 33


def medians(df: DataFrame, keys: list[str], value: str, store: Store) -> DataFrame:
    """(keys, n, median) of a number's values that are not null; of an even number the mean of the middle two.

    Rows are sorted by range. A key's rows are consecutive in a partition, so a row's rank is how many of its key stand in earlier
    partitions plus its distance from the key's first row in its own.
    """
    order = [*map(F.col, keys), F.col(value)]
    lined = df.filter(F.col(value).isNotNull()).select(*keys, value).repartitionByRange(*order).sortWithinPartitions(*order)
    lined = store.cut(lined.withColumn("at", F.monotonically_increasing_id()), "ordered").withColumn("part", F.shiftright("at", BITS))
    held = lined.groupBy(*keys, "part").agg(F.count("*").alias("here"), F.min("at").alias("first"))
    of_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    held = held.withColumn("n", F.sum("here").over(of_key)).withColumn("before", F.sum("here").over(of_key.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("here"))
    rank = F.col("before") + F.col("at") - F.col("first")
    middle = (rank == F.floor((F.col("n") - 1) / 2)) | (rank == F.floor(F.col("n") / 2))
    return lined.join(held, [*keys, "part"]).filter(middle).groupBy(*keys).agg(F.max("n").alias("n"), F.avg(value).alias("median"))
