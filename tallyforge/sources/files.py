"""Files of one business: typed CSV tables in, CSV tables, upserts, snapshots and action logs out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import scalars as X

#: Columns of each table, in their order in the files.
COLUMNS = {
    "payments": ["payment_id", "order_id", "method", "amount_paise", "fee_paise", "tax_paise", "status", "created_at", "settlement_id"],
    "settlements": ["settlement_id", "amount_paise", "fees_paise", "tax_paise", "utr", "payment_count", "status", "created_at", "settled_at"],
    "bank_statement": ["txn_id", "txn_date", "value_date", "narration", "ref_no", "debit_amount", "credit_amount", "balance"],
    "order_book": ["order_id", "receipt", "amount_paise", "status", "created_at"],
    "golden": ["record_type", "record_id", "expected_disposition", "counterparty_ids", "scenario_tag", "expected_discrepancy_paise", "notes"],
    "settlement_merchants": ["settlement_id", "merchant_name"],
}
ACTIONS = ("resolve", "assign", "snooze", "note")


def read_csv(spark: SparkSession, path: str, table: str, world_id: int | None = 0) -> DataFrame:
    """All columns as text, with world_id and row_no (the file's order). Each file is one partition, so the order holds. Without a world_id,
    ``path`` holds a folder ``world_id=N`` for each world, as ``write_csv`` makes them."""
    schema = ", ".join(f"{c} string" for c in COLUMNS[table])
    df = spark.read.csv(path, header=True, schema=schema if world_id is not None else f"{schema}, world_id long", quote='"', escape='"', multiLine=True)
    world = F.col("world_id") if world_id is None else F.lit(world_id).cast("long").alias("world_id")
    return df.select(world, F.monotonically_increasing_id().alias("row_no"), *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in COLUMNS[table]))


def settlements(spark: SparkSession, path: str, world_id: int | None = 0) -> DataFrame:
    df = read_csv(spark, path, "settlements", world_id)
    numbers = {c: F.col(c).cast("long") for c in ("amount_paise", "fees_paise", "tax_paise", "payment_count")}
    return df.withColumns(numbers).withColumn("created", X.iso_date(F.col("created_at"))).withColumn("settled", X.iso_date(F.col("settled_at")))


def bank_rows(spark: SparkSession, path: str, world_id: int | None = 0) -> DataFrame:
    df = read_csv(spark, path, "bank_statement", world_id)
    paise = {new: X.optional_paise(F.col(old)) for new, old in (("debit_paise", "debit_amount"), ("credit_paise", "credit_amount"), ("balance_paise", "balance"))}
    return df.withColumns(paise).withColumn("txn_date", X.bank_date(F.col("txn_date"))).withColumn("value_date", X.bank_date(F.col("value_date"))).drop("debit_amount", "credit_amount", "balance")


def payments(spark: SparkSession, path: str, world_id: int | None = 0) -> DataFrame:
    df = read_csv(spark, path, "payments", world_id)
    numbers = {c: F.col(c).cast("long") for c in ("amount_paise", "fee_paise", "tax_paise")}
    return df.withColumns(numbers).withColumn("created_s", F.unix_timestamp(X.iso_timestamp(F.col("created_at")).cast("timestamp")))


def order_book(spark: SparkSession, path: str, world_id: int | None = 0) -> DataFrame:
    return read_csv(spark, path, "order_book", world_id).withColumn("amount_paise", F.col("amount_paise").cast("long"))


def golden(spark: SparkSession, path: str, world_id: int | None = 0) -> DataFrame:
    """Labelled answers; the id list becomes a sorted set."""
    ids = F.array_sort(F.array_distinct(F.filter(F.split("counterparty_ids", ";"), lambda x: x != "")))
    return read_csv(spark, path, "golden", world_id).select("world_id", "record_type", "record_id", F.col("expected_disposition").alias("expected"), ids.alias("counterparties"), F.col("scenario_tag").alias("scenario"))


def optional(spark: SparkSession, path: str, table: str, world_id: int | None = 0) -> DataFrame:
    """A table whose file may be absent: then an empty one."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)
    if there:
        return read_csv(spark, path, table, world_id)
    return spark.createDataFrame([], ", ".join(["world_id long", "row_no long", *(f"{c} string" for c in COLUMNS[table])]))


def write_csv(df: DataFrame, path: str, columns: list[str], order: str = "row_no") -> None:
    """One CSV file per world folder in the stated column order. The rows of one business's file are written by one task, in order."""
    df.repartition("world_id").sortWithinPartitions("world_id", order).select("world_id", *columns).write.partitionBy("world_id").mode("overwrite").csv(path, header=True, lineSep="\n", emptyValue="", quote='"', escape='"')


def upsert(existing: DataFrame, new: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """Rows of both by key: the last value wins, the first position stays. ``new`` is ordered by ``seq``."""
    values = [c for c in existing.columns if c not in (key, "row_no")]
    old = existing.select(key, F.struct(*values).alias("value"), F.col("row_no").alias("place"), F.lit(-1).cast("long").alias("turn"))
    top = existing.agg(F.coalesce(F.max("row_no"), F.lit(-1))).first()[0]
    fresh = new.select(key, F.struct(*values).alias("value"), (F.lit(top + 1) + F.col(seq)).alias("place"), F.col(seq).cast("long").alias("turn"))
    merged = old.unionByName(fresh).groupBy(key).agg(F.max_by("value", "turn").alias("value"), F.min("place").alias("row_no"))
    return merged.select(key, *(F.col("value")[c].alias(c) for c in values), "row_no")


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    """Snapshots by world and close date; a date that is written again is replaced."""
    conf = "spark.sql.sources.partitionOverwriteMode"
    spark = snapshot.sparkSession
    before = spark.conf.get(conf)
    spark.conf.set(conf, "dynamic")
    try:
        snapshot.write.mode("overwrite").partitionBy("world_id", "close_date").parquet(path)
    finally:
        spark.conf.set(conf, before)


def read_actions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The action log, empty where nothing has been written yet."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def append_actions(log: DataFrame, path: str) -> None:
    """Append actions; an unknown action stops the write, and the commit protocol makes it all or nothing."""
    known = F.col("action").isin(*ACTIONS)
    log.withColumn("action", F.when(known, F.col("action")).otherwise(F.raise_error(F.concat(F.lit("unknown action: "), F.coalesce("action", F.lit("null")))).cast("string"))).write.mode("append").parquet(path)


def digest(df: DataFrame) -> str:
    """A digest of a table's rows that does not depend on their order."""
    shown = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    row = df.select(F.xxhash64(shown).alias("h")).agg(F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).first()
    return f"{row.x}:{row.s}:{row.n}"


def numbered(df: DataFrame, prefix: str, order: list, width: int = 6) -> DataFrame:
    """Add txn_id, numbered within each world in the given order."""
    turn = F.row_number().over(Window.partitionBy("world_id").orderBy(*order))
    return df.withColumn("txn_id", F.concat(F.lit(prefix), F.lpad(turn.cast("string"), width, "0")))
