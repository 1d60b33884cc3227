"""Reconciliation worlds: settlements, bank statements, payments, orders.

``derive`` makes worlds from the tables ``orders`` by integer SQL that Spark and DuckDB evaluate alike, so every operator can be
checked against SQL. A block of eight orders is a settlement; 240 settlements are one business's world. Classes of 24 settlements and of 20
orders carry the scenarios: clean, truncated, damaged or missing references, duplicates, splits, merges, deductions, ties.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources.scratch import Store


FIRST_DAY = "2025-04-01"


def tables_sql(dialect: str, orders: str = "orders") -> dict[str, str]:
    """The derivation as named queries, each over the ones before; dialect is ``spark`` or ``duckdb``."""
    spark = dialect == "spark"
    day = (lambda d, n: f"date_add({d}, cast({n} as int))") if spark else (lambda d, n: f"({d} + cast({n} as integer))")
    sunday = (lambda d: f"weekday({d}) = 6") if spark else (lambda d: f"isodow({d}) = 7")
    text = "string" if spark else "varchar"
    pad = lambda x, n: f"lpad(cast({x} as {text}), {n}, '0')"
    div = lambda a, b: f"cast(floor(({a}) / {b}) as bigint)"
    created = day(f"DATE '{FIRST_DAY}'", div("s % 240", 6))
    settled = day("created", 1)
    clean = "concat('NEFT CR-', utr, '-RAZORPAY PAYMENTS')"
    credit = lambda part, amount, narration, ref, days: f"SELECT world_id, s, {part} AS part, {amount} AS credit, {narration} AS narration, {ref} AS ref_no, {days} AS days FROM settlement_base"
    return {
        "o": f"SELECT cast(o_orderkey as bigint) AS k, cast(o_orderkey % 20 as bigint) AS c, cast(round(o_totalprice * 100) as bigint) AS amt FROM {orders}",
        "order_book": f"""SELECT {div('k', 1920)} AS world_id, k AS row_no, concat('order_', {pad('k', 14)}) AS order_id, concat('rcpt_', {pad('k', 10)}) AS receipt, amt AS amount_paise,
  CASE WHEN c = 3 THEN 'created' WHEN c = 4 THEN 'cancelled' ELSE 'paid' END AS status FROM o""",
        "pay_base": """SELECT k, k * 4 AS p, CASE WHEN c = 7 THEN amt + 100 ELSE amt END AS amt, CASE WHEN c = 8 THEN 'refunded' ELSE 'captured' END AS status, k * 60 AS sec, CASE WHEN c = 9 THEN 1 ELSE 0 END AS orphan
  FROM o WHERE c NOT IN (3, 4)
  UNION ALL SELECT k, k * 4 + 1, amt, 'failed', k * 60 - 30, 0 FROM o WHERE c = 5
  UNION ALL SELECT k, k * 4 + 2, amt, 'captured', k * 60 + 30, 0 FROM o WHERE c = 6""",
        "pay_fee": f"SELECT k, p, amt, status, sec, orphan, {div('amt * 200 + 5000', 10000)} AS fee FROM pay_base",
        "payments": f"""SELECT {div('k', 1920)} AS world_id, p AS row_no, concat('pay_', {pad('p', 14)}) AS payment_id,
  concat(CASE WHEN orphan = 1 THEN 'order_X' ELSE 'order_' END, {pad('k', 14)}) AS order_id, amt AS amount_paise, fee AS fee_paise, {div('fee * 18 + 50', 100)} AS tax_paise, status,
  sec AS created_s, CASE WHEN status = 'captured' THEN concat('setl_', {pad(div('k', 8), 12)}) ELSE '' END AS settlement_id, k FROM pay_fee""",
        "settlement_raw": f"""SELECT {div('k', 8)} AS s, cast(sum(amount_paise - fee_paise - tax_paise) as bigint) AS net, cast(sum(fee_paise) as bigint) AS fees, cast(sum(tax_paise) as bigint) AS taxes, cast(count(*) as bigint) AS n
  FROM payments WHERE status = 'captured' GROUP BY {div('k', 8)}""",
        "settlement_base": f"""SELECT {div('r.s', 240)} AS world_id, r.s, r.s % 24 AS sc, CASE WHEN r.s % 24 = 6 THEN coalesce(p.net, r.net) ELSE r.net END AS net, r.fees, r.taxes, r.n, x.net AS next_net,
  concat(CASE r.s % 7 WHEN 0 THEN 'UTIB' WHEN 1 THEN 'HDFC' WHEN 2 THEN 'ICIC' WHEN 3 THEN 'SBIN' WHEN 4 THEN 'KKBK' WHEN 5 THEN 'YESB' ELSE 'PUNB' END, {pad('((r.s * 7919 + 104729) * 1000003) % 1000000000000', 12)}) AS utr
  FROM settlement_raw r LEFT JOIN settlement_raw p ON p.s = r.s - 1 LEFT JOIN settlement_raw x ON x.s = r.s + 1""",
        "settlement_dated": f"SELECT *, {created} AS created FROM settlement_base",
        "settlements": f"""SELECT world_id, s AS row_no, concat('setl_', {pad('s', 12)}) AS settlement_id, net AS amount_paise, fees AS fees_paise, taxes AS tax_paise, utr, n AS payment_count, created,
  CASE WHEN {sunday(settled)} THEN {day('created', 2)} ELSE {settled} END AS settled FROM settlement_dated""",
        "parts": " UNION ALL ".join([
            credit(0, "net", clean, "utr", 2) + " WHERE sc IN (0, 1, 2, 3, 4, 7, 8, 9, 10, 16)",
            credit(0, "net", "'IMPS RAZORPAY PAYOUT'", "''", 2) + " WHERE sc IN (5, 14)",
            credit(0, "net", "concat('NEFT RZPAY ', substring(utr, 6, 11))", "''", 2) + " WHERE sc = 11",
            credit(0, "net", "concat('RTGS/', substring(utr, 1, 4), '-', substring(utr, 5, 4), ' ', substring(utr, 9, 4), ' ', substring(utr, 13, 4), '/RZP')", "''", 2) + " WHERE sc = 12",
            credit(0, "net", f"concat('NEFT CR-', substring(utr, 1, 15), cast((cast(substring(utr, 16, 1) as int) + 1) % 10 as {text}), '-RAZORPAY')", "''", 2) + " WHERE sc = 13",
            credit(1, "net", clean, "utr", 3) + " WHERE sc = 16",
            credit(0, div("net * 2", 5), clean, "utr", 2) + " WHERE sc = 17",
            credit(1, f"net - {div('net * 2', 5)}", clean, "utr", 2) + " WHERE sc = 17",
            credit(0, "net - 2950", clean, "utr", 2) + " WHERE sc = 18",
            credit(0, f"net - {div('net + 50', 100)}", clean, "utr", 2) + " WHERE sc = 19",
            credit(0, "net - 12345", clean, "utr", 2) + " WHERE sc = 20",
            credit(0, "net", clean, "utr", 12) + " WHERE sc = 21",
            credit(0, "net + coalesce(next_net, 0)", clean, "utr", 2) + " WHERE sc = 22",
            credit(0, "net", "'UPI/CUSTOMER/REFUND 77'", "''", 2) + " WHERE sc = 23",
            credit(2, "0 - net", "'NEFT DR-VENDOR PAYOUT'", "''", 4) + " WHERE sc = 3",
            credit(3, "net + 777", "'NEFT CR-UNKN000000000001-RAZORPAY'", "'UNKN000000000001'", 3) + " WHERE sc = 8",
        ]),
        "bank_rows": f"""SELECT p.world_id, p.s * 4 + p.part AS row_no, concat('BANK', {pad('p.s * 4 + p.part', 12)}) AS txn_id, {day('d.created', 'p.days')} AS value_date, p.narration, p.ref_no,
  CASE WHEN p.credit > 0 THEN p.credit ELSE 0 END AS credit_paise, CASE WHEN p.credit < 0 THEN 0 - p.credit ELSE 0 END AS debit_paise
  FROM parts p JOIN settlement_dated d ON d.s = p.s""",
    }


def with_clause(dialect: str, orders: str = "orders", upto: str | None = None) -> str:
    """``WITH`` and the derivation's queries, up to and with ``upto``."""
    named = tables_sql(dialect, orders)
    last = list(named).index(upto) if upto else len(named)
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for i, (name, sql) in enumerate(named.items()) if i <= last)


@dataclass
class World:
    """The tables of many worlds; every table has world_id and row_no, the order of its source. Orders and payments, the largest, are made when
    first asked for: what compares settlements with bank rows reads neither."""

    make_order_book: Callable[[], DataFrame]
    make_payments: Callable[[], DataFrame]
    settlements: DataFrame
    bank_rows: DataFrame
    store: Store

    @cached_property
    def order_book(self) -> DataFrame:
        return self.make_order_book()

    @cached_property
    def payments(self) -> DataFrame:
        return self.make_payments()


def as_of(w: World, day: str) -> World:
    """The worlds as they stood at the end of a day: every source up to it. Orders and payments count from the day of their settlement."""
    before = F.lit(day).cast("date")

    def known(df: DataFrame, step: int) -> DataFrame:
        settled = F.floor(F.floor(F.col("row_no") / step) % 240 / 6).cast("int")
        return df.filter(F.date_add(F.lit(FIRST_DAY).cast("date"), settled) <= before)

    return World(lambda: known(w.order_book, 8), lambda: known(w.payments, 32), w.settlements.filter(F.col("created") <= before), w.bank_rows.filter(F.col("value_date") <= before), w.store)


def as_of_sql(named: dict[str, str], day: str) -> dict[str, str]:
    """The named tables of ``tables_sql("duckdb")`` up to a day."""
    numbered = lambda step: f"DATE '{FIRST_DAY}' + (row_no // {step} % 240 // 6)::INTEGER"
    days = {"order_book": numbered(8), "payments": numbered(32), "settlements": "created", "bank_rows": "value_date"}
    found = {}
    for name, query in named.items():
        if name in days:
            found |= {f"{name}_all": query, name: f"SELECT * FROM {name}_all WHERE {days[name]} <= DATE '{day}'"}
        else:
            found[name] = query.replace("FROM payments ", "FROM payments_all ")
    return found


#: Bank rows in which some settlements' credits lost their references, by the place of the settlement among 48: two and three of them paid as
#: one, one paid in two parts, and one less a charge that the narration states. One text for both engines.
HARD = """SELECT world_id, row_no, txn_id, value_date, narration, ref_no, credit_paise, debit_paise FROM (SELECT *, cast(floor(row_no / 4) as bigint) % 48 AS c FROM {rows}) WHERE row_no % 4 <> 0 OR c NOT IN (0, 1, 4, 7, 25, 26, 27)
UNION ALL SELECT world_id, row_no, txn_id, value_date, 'RAZORPAY LESS CHARGES 59', '', credit_paise - 5900, debit_paise FROM {rows} WHERE row_no % 4 = 0 AND cast(floor(row_no / 4) as bigint) % 48 = 7
UNION ALL SELECT world_id, row_no, txn_id, value_date, 'RZP PART PAYOUT', '', cast(floor(credit_paise * 2 / 5) as bigint), debit_paise FROM {rows} WHERE row_no % 4 = 0 AND cast(floor(row_no / 4) as bigint) % 48 = 4
UNION ALL SELECT world_id, row_no + 1, concat('BANK', lpad(cast(row_no + 1 as varchar(20)), 12, '0')), value_date, 'RZP PART PAYOUT', '', credit_paise - cast(floor(credit_paise * 2 / 5) as bigint), debit_paise FROM {rows} WHERE row_no % 4 = 0 AND cast(floor(row_no / 4) as bigint) % 48 = 4
UNION ALL SELECT world_id, min(row_no), min(txn_id), max(value_date), concat('RAZORPAY BULK ', substring(min(narration), 13, 8)), '', cast(sum(credit_paise) as bigint), cast(sum(debit_paise) as bigint)
  FROM (SELECT *, cast(floor(row_no / 4) as bigint) AS s, cast(floor(row_no / 4) as bigint) % 48 AS c FROM {rows}) WHERE row_no % 4 = 0 AND c IN (0, 1, 25, 26, 27) GROUP BY world_id, CASE WHEN c < 2 THEN s - c ELSE s - c + 25 END"""


def hard(w: World) -> World:
    """The worlds with bank rows that only a search over sums explains."""
    rows = w.store.cut(w.bank_rows.sparkSession.sql(HARD, rows=w.bank_rows), "hard_rows")
    return World(lambda: w.order_book, lambda: w.payments, w.settlements, rows, w.store)


def hard_sql(named: dict[str, str]) -> dict[str, str]:
    """The named tables of ``tables_sql("duckdb")`` with those bank rows."""
    found = {}
    for name, query in named.items():
        found |= {"bank_rows_all": query, name: HARD.format(rows="bank_rows_all")} if name == "bank_rows" else {name: query}
    return found


def stamp(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files, which change when it is written anew."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(where)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def derive(spark: SparkSession, sf_dir: str) -> World:
    """Worlds from ``orders``; each table is written once at most, as later steps read it several times."""
    store = Store(spark)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    named = tables_sql("spark", "{src}")

    def made(*names: str, **given: DataFrame) -> DataFrame:
        clauses = ",\n".join(f"{n} AS ({named[n]})" for n in names)
        return spark.sql(f"WITH {clauses} SELECT * FROM {names[-1]}", **given)

    paid = ("o", "pay_base", "pay_fee", "payments")
    raw = store.cut(made(*paid, "settlement_raw", src=orders), "raw")
    base = spark.sql(named["settlement_base"].replace("settlement_raw", "{raw}"), raw=raw)
    base = store.cut(spark.sql(named["settlement_dated"].replace("settlement_base", "{base}"), base=base), "base")
    settlements = store.cut(spark.sql(named["settlements"].replace("settlement_dated", "{base}"), base=base), "settlements")
    parts = spark.sql(named["parts"].replace("settlement_base", "{base}"), base=base)
    rows = spark.sql(named["bank_rows"].replace("parts p", "{parts} p").replace("settlement_dated d", "{base} d"), parts=parts, base=base)
    order_book = lambda: store.cut(made("o", "order_book", src=orders), "order_book")
    payments = lambda: store.cut(made(*paid, src=orders).drop("k"), "payments")
    return World(order_book, payments, settlements, store.cut(rows, "bank_rows"), store)


_worlds: dict[tuple, World] = {}


def world(spark: SparkSession, sf_dir: str) -> World:
    """The derived worlds of a folder, made once a session and anew if its orders are."""
    key = (spark.sparkContext.applicationId, sf_dir, stamp(spark, f"{sf_dir}/orders.parquet"))
    if key not in _worlds:
        _worlds[key] = derive(spark, sf_dir)
    return _worlds[key]
