"""The event inbox as a stream: each micro-batch is verified whole, then upserted by key, so redelivery changes nothing twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyforge.sources import ingest


class Forged(ValueError):
    """An event whose signature does not fit its body."""


def split_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bodies (``*.json``) and signatures (``*.json.sig`` or ``*.sig``) from files (path, content)."""
    name = F.regexp_extract("path", r"([^/]+?)(?:\.json)?(?:\.sig)?$", 1)
    bodies = files.filter(F.col("path").endswith(".json")).select(name.alias("name"), F.col("content").alias("body"))
    return bodies, files.filter(F.col("path").endswith(".sig")).select(name.alias("name"), F.decode("content", "UTF-8").alias("signature"))


def latest(df: DataFrame, key: str) -> DataFrame:
    """One row per key, from the last file by name."""
    values = F.struct(*[c for c in df.columns if c != key])
    return df.groupBy(key).agg(F.max_by(values, "name").alias("v")).select(key, "v.*")


def consume(files: DataFrame, secret: str | None, allow_unsigned: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Payments, orders and the count per verdict of a batch of files. A forged event stops the batch before anything is written."""
    told = ingest.events(*split_files(files), secret, allow_unsigned)
    forged = [r.name for r in told.filter("verdict = 'forged'").select("name").limit(5).collect()]
    if forged:
        raise Forged(", ".join(forged))
    taken = told.filter("verdict IN ('consumed', 'unverified')")
    payments = latest(taken.filter("payment IS NOT NULL").select("name", "payment.*"), "id")
    orders = latest(taken.filter("`order` IS NOT NULL").select("name", "order.*"), "id")
    return ingest.payments(payments), ingest.orders(orders), told.groupBy("verdict").count()


def stream(spark: SparkSession, inbox: str, checkpoint: str, secret: str | None, write: Callable[[DataFrame, DataFrame, int], None], allow_unsigned: bool = False) -> StreamingQuery:
    """Follow a folder; ``write`` gets each batch's payments and orders and its number, and should upsert by key."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(inbox)

    def each(batch: DataFrame, number: int) -> None:
        payments, orders, _ = consume(batch, secret, allow_unsigned)
        write(payments, orders, number)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def workflow(actions: DataFrame) -> DataFrame:
    """The workflow of each item from a stream of actions (item_id, seq, action), for update mode."""
    moves = F.when(F.col("action") != "note", F.struct("seq", "action"))
    return actions.groupBy("item_id").agg(F.coalesce(F.max(moves)["action"], F.lit("open")).alias("last_action"), F.count("*").alias("n_actions"))


def windowed(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Beyond the batch work: counts per window and type, with repeats removed and late rows bounded by a watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
