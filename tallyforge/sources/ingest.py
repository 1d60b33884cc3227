"""The payment processor's feeds: JSON collections, the settlement report, and the signed inbox of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import scalars as X

SETTLEMENT = "id string, entity string, amount long, status string, fees long, tax long, utr string, created_at long"
PAYMENT = "id string, entity string, amount long, currency string, status string, order_id string, method string, captured boolean, fee long, tax long, created_at long"
ORDER = "id string, entity string, amount long, amount_paid long, currency string, receipt string, status string, created_at long"
#: Columns of the settlement report.
REPORT = ["entity_id", "type", "debit", "credit", "amount", "currency", "fee", "tax", "on_hold", "settled", "created_at", "settled_at", "settlement_id", "credit_type", "description", "settlement_utr", "order_id", "method"]
#: The processor's order statuses in our words.
ORDER_STATUS = {"paid": "paid", "created": "created", "attempted": "created"}


def collection(spark: SparkSession, path: str, item: str) -> DataFrame:
    """The items of a JSON collection, with their position."""
    df = spark.read.json(path, schema=f"items array<struct<{_fields(item)}>>", multiLine=True)
    return df.select(F.posexplode("items").alias("position", "item")).select("position", "item.*")


def _fields(columns: str) -> str:
    return ", ".join(f"{c.split()[0]}:{c.split()[1]}" for c in columns.split(", "))


def report(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True, schema=", ".join(f"{c} string" for c in REPORT))
    return df.withColumn("row_no", F.monotonically_increasing_id())


def settlements(items: DataFrame, report_rows: DataFrame) -> DataFrame:
    """Settlements with their number of payments and first settled time from the report; refunds are not counted, and without a
    payment row the creation time stands in."""
    paid = report_rows.filter("type = 'payment'").groupBy(F.col("settlement_id").alias("id")).agg(F.count("*").alias("payment_count"), F.min_by("settled_at", "row_no").alias("settled_s"))
    s = items.filter("entity = 'settlement'").join(paid, "id", "left")
    day = F.substring(X.epoch_text(F.coalesce(F.col("settled_s").cast("long"), F.col("created_at"))), 1, 10)
    return s.select(F.col("id").alias("settlement_id"), F.col("amount").alias("amount_paise"), F.col("fees").alias("fees_paise"), F.col("tax").alias("tax_paise"), "utr", F.coalesce("payment_count", F.lit(0)).alias("payment_count"), "status", X.epoch_text(F.col("created_at")).alias("created_at"), day.alias("settled_at"))


def payments_from_report(report_rows: DataFrame) -> DataFrame:
    p = report_rows.filter("type = 'payment'")
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    return p.select(F.col("entity_id").alias("payment_id"), F.coalesce("order_id", F.lit("")).alias("order_id"), F.coalesce("method", F.lit("")).alias("method"), number("amount").alias("amount_paise"), number("fee").alias("fee_paise"), number("tax").alias("tax_paise"), F.lit("captured").alias("status"), X.epoch_text(number("created_at")).alias("created_at"), F.coalesce("settlement_id", F.lit("")).alias("settlement_id"))


def payments(items: DataFrame) -> DataFrame:
    p = items.filter("entity = 'payment'")
    return p.select(F.col("id").alias("payment_id"), F.coalesce("order_id", F.lit("")).alias("order_id"), F.coalesce("method", F.lit("")).alias("method"), F.col("amount").alias("amount_paise"), F.coalesce("fee", F.lit(0)).alias("fee_paise"), F.coalesce("tax", F.lit(0)).alias("tax_paise"), "status", X.epoch_text(F.col("created_at")).alias("created_at"), F.lit("").alias("settlement_id"))


def order_status(status: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in ORDER_STATUS.items() for x in kv))
    return F.coalesce(known[status], F.lit("created"))


def orders(items: DataFrame) -> DataFrame:
    o = items.filter("entity = 'order'")
    return o.select(F.col("id").alias("order_id"), F.coalesce("receipt", F.lit("")).alias("receipt"), F.col("amount").alias("amount_paise"), order_status(F.col("status")).alias("status"), X.epoch_text(F.col("created_at")).alias("created_at"))


EVENT = f"event string, payload struct<payment:struct<entity:struct<{_fields(PAYMENT)}>>, `order`:struct<entity:struct<{_fields(ORDER)}>>>"


def events(bodies: DataFrame, signatures: DataFrame, secret: str | None, allow_unsigned: bool = False) -> DataFrame:
    """(name, verdict, event, payment, order) of delivered files: bodies (name, body binary), signatures (name, signature).

    Without a secret nothing is taken unless unsigned events are allowed. A missing signature skips the file; a wrong one is
    ``forged``, which callers must treat as an error.
    """
    if secret is None and not allow_unsigned:
        raise ValueError("no secret: unsigned events are refused")
    told = bodies.join(signatures, "name", "left")
    if secret is None:
        verdict: Column = F.lit("unverified")
    else:
        right = F.trim(F.col("signature")) == X.hmac_sha256(F.col("body"), secret)
        verdict = F.when(F.col("signature").isNull(), F.lit("unverified" if allow_unsigned else "skipped")).when(right, "consumed").otherwise("forged")
    parsed = F.from_json(F.decode("body", "UTF-8"), EVENT)
    return told.withColumn("verdict", verdict).withColumn("e", parsed).select("name", "verdict", F.col("e.event").alias("event"), F.col("e.payload.payment.entity").alias("payment"), F.col("e.payload.order.entity").alias("order"))
