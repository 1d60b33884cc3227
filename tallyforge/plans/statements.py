"""Queries over bank statements: each world's bank rows are written as a raw statement, CSV or workbook, as banks export them, read back as grids,
and taken in by proposed layouts, of which some are wrong. Each query has a DuckDB twin that works from the bank rows alone."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import scalars as X
from tallyforge.operators import intake
from tallyforge.sources import grids

#: First balance of a statement in paise, rows before the first transaction, and pages of a narration that is quoted.
START, HEAD, QUOTED = 10_000_000, 4, 11
BANNERS = ["HDFC BANK LTD", "ICICI BANK LIMITED", "STATE BANK OF INDIA", "Branch IFSC UTIB0000123", "Savings account", "Some other bank"]
HEADINGS = ["Date", "Narration", "Chq/Ref", "Withdrawal", "Deposit", "Balance"]


def file_of() -> Column:
    """A statement's file, its ending odd and even: workbook and CSV."""
    w = F.col("world_id")
    name = F.concat(F.when(w % 6 == 4, "kotak_").otherwise("statement_"), F.lpad(w.cast("string"), 6, "0"))
    return F.concat(F.lit("batch_"), (w % 3).cast("string"), F.lit("/"), name, F.when(w % 2 == 1, ".xlsx").otherwise(".csv"))


def lines_of(bank_rows: DataFrame) -> DataFrame:
    """(world_id, at, kind, value_date, narration, ref_no, debit_paise, credit_paise, balance): the rows of each world's statement below its
    heading, at their place in the grid. Every third world's statement has two periods."""
    order = Window.partitionBy("world_id").orderBy("value_date", "row_no")
    t = bank_rows.withColumn("i", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("world_id")))
    t = t.withColumn("balance", START + F.sum(F.col("credit_paise") - F.col("debit_paise")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("half", F.when((F.col("world_id") % 3 == 2) & (F.col("n") > 1), F.floor(F.col("n") / 2)).otherwise(F.col("n")))
    quoted = F.when(F.col("row_no") % QUOTED == 0, F.concat("narration", F.lit(' "x", y\nz'))).otherwise(F.col("narration"))
    later = F.when(F.col("i") > F.col("half"), 2).otherwise(0)
    rows = t.select("world_id", (HEAD - 1 + F.col("i") + later).alias("at"), F.lit("transaction").alias("kind"), "value_date", quoted.alias("narration"), "ref_no", "debit_paise", "credit_paise", "balance")
    ends = t.groupBy("world_id").agg(F.max("n").alias("n"), F.max("half").alias("half"), F.max_by("balance", F.when(F.col("i") <= F.col("half"), F.col("i"))).alias("middle"), F.max_by("balance", "i").alias("last"))

    def edge(at: Column, kind: str, balance: Column) -> Column:
        return F.struct(at.cast("long").alias("at"), F.lit(kind).alias("kind"), balance.cast("long").alias("balance"))

    n, half, two = F.col("n"), F.col("half"), F.col("half") < F.col("n")
    edges = F.filter(F.array(
        edge(F.lit(HEAD - 1), "opening", F.lit(START)), edge(HEAD + half, "closing", F.col("middle")), F.when(two, edge(HEAD + half + 1, "opening", F.col("middle"))),
        F.when(two, edge(HEAD + n + 2, "closing", F.col("last"))), edge(HEAD + n + F.when(two, 3).otherwise(1), "noise", F.lit(None)),
    ), lambda e: e.isNotNull())
    edges = ends.select("world_id", F.explode(edges).alias("e")).select("world_id", "e.*")
    label = F.when(F.col("kind") == "opening", "OPENING BALANCE").when(F.col("kind") == "closing", "CLOSING BALANCE").otherwise("*** end of statement ***")
    zero = F.lit(0).cast("long")
    edges = edges.select("world_id", "at", "kind", F.lit(None).cast("date").alias("value_date"), label.alias("narration"), F.lit("").alias("ref_no"), zero.alias("debit_paise"), zero.alias("credit_paise"), "balance")
    return rows.unionByName(edges)


def exported(bank_rows: DataFrame) -> DataFrame:
    """The statements as typed cells (file, row_no, cells): workbooks hold numbers and days, CSV files texts; odd worlds show deposits first."""
    w, csv = F.col("world_id"), F.col("world_id") % 2 == 0
    none = {"text": F.lit(None).cast("string"), "number": F.lit(None).cast("double"), "day": F.lit(None).cast("date")}
    cell = lambda **kinds: F.struct(*((kinds.get(k, v)).alias(k) for k, v in none.items()))
    text = lambda value: cell(text=value if isinstance(value, Column) else F.lit(value))
    money = lambda paise, shown: F.when(csv, text(shown)).otherwise(cell(number=paise / 100.0))
    amount = lambda c: F.when(F.col(c) > 0, money(F.col(c), X.rupees(F.col(c)))).otherwise(text(""))
    side = F.when(F.col("balance") < 0, " Dr").otherwise(" Cr")
    balance = F.when(F.col("balance").isNull(), text("")).otherwise(money(F.col("balance"), F.concat(X.rupees(F.abs("balance")), side)))
    day = F.when(F.col("value_date").isNull(), text("")).when(csv, text(F.date_format("value_date", "dd/MM/yyyy"))).otherwise(cell(day=F.col("value_date")))
    sides = lambda a, b: F.when(w % 2 == 1, F.array(b, a)).otherwise(F.array(a, b))
    body = lines_of(bank_rows).select("world_id", F.col("at").alias("row_no"), F.concat(F.array(day, text(F.col("narration")), text(F.col("ref_no"))), sides(amount("debit_paise"), amount("credit_paise")), F.array(balance)).alias("cells"))
    worlds = bank_rows.select("world_id").distinct()
    banner = F.get(F.array(*map(F.lit, BANNERS)), (w % len(BANNERS)).cast("int"))
    holder = F.concat(F.lit('Holder: "A" & <Co>,\nworld '), w.cast("string"))
    heading = F.concat(F.array(*map(text, HEADINGS[:3])), sides(text(HEADINGS[3]), text(HEADINGS[4])), F.array(text(HEADINGS[5])))
    head = worlds.select("world_id", F.posexplode(F.array(F.array(text(banner)), F.array(text(holder)), heading)).alias("row_no", "cells"))
    return body.unionByName(head.withColumn("row_no", F.col("row_no").cast("long"))).select(file_of().alias("file"), "row_no", "cells")


def places(bank_rows: DataFrame) -> DataFrame:
    """(world_id, openings, closings, rows, ends): where each statement's lines stand, by kind."""
    at = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("at").cast("int"))))
    return lines_of(bank_rows).groupBy("world_id").agg(at("opening").alias("openings"), at("closing").alias("closings"), at("transaction").alias("rows"), at("noise").alias("ends"))


def proposed(told: DataFrame, honest: bool = False) -> DataFrame:
    """A layout of each statement by its ``places``. Unless they are to be honest, six worlds in eight have one fault each."""
    fault = F.when(F.lit(honest), 0).otherwise(F.col("world_id") % 8)
    of = told.withColumn("fault", fault)
    hidden = F.when(F.col("fault") == 3, F.array(F.lit(HEAD + 2))).otherwise(F.array().cast("array<int>"))
    period = F.arrays_zip("openings", "closings")
    periods = F.transform(period, lambda p: F.struct(p["openings"].alias("opening_row"), p["closings"].alias("closing_row"), F.array_except(F.filter("rows", lambda r: (r > p["openings"]) & (r < p["closings"])), hidden).alias("transaction_rows")))
    noise = F.concat(F.array(F.lit(0), F.lit(1)), F.when(F.col("fault") != 4, F.col("ends")).otherwise(F.array().cast("array<int>")), F.when(F.col("fault") == 5, F.array(F.lit(2))).otherwise(F.array().cast("array<int>")), hidden)
    first = F.when((F.col("world_id") % 2 == 1) == (F.col("fault") != 2), 4).otherwise(3)
    columns = F.create_map(F.lit("date"), F.lit(0), F.lit("narration"), F.lit(1), F.lit("chq_ref"), F.lit(2), F.lit("debit"), first, F.lit("credit"), 7 - first, F.lit("balance"), F.when(F.col("fault") == 6, 99).otherwise(5))
    pattern = F.when(F.col("world_id") % 2 == 1, "%d-%m-%Y").otherwise("%d/%m/%Y")
    pairs = F.when(F.col("fault") == 7, F.array(F.array(F.lit(HEAD), F.lit(HEAD + 1)))).otherwise(F.array().cast("array<array<int>>"))
    return of.select(
        file_of().alias("file"), F.lit(2).alias("header_row"), columns.alias("columns"), pattern.alias("date_format"), periods.alias("periods"), noise.alias("noise_rows"),
        F.lit("-").alias("delimiter"), F.lit(1).alias("token_index"), F.lit("[A-Z]{4}[0-9]{12}").alias("token_regex"), pairs.alias("reversal_pairs"),
    )


class Statements:
    """The statements of a folder's worlds, written and read once, and the proof of their layouts; each is made when a query asks for it."""

    def __init__(self, bank_rows: DataFrame, store):
        self.bank_rows, self.store = bank_rows, store

    @cached_property
    def cells(self) -> DataFrame:
        folder = self.store.folder("statements")
        grids.write(exported(self.bank_rows), folder)
        read = grids.read(self.bank_rows.sparkSession, folder)
        return self.store.cut(read.withColumn("file", F.regexp_extract("file", "(batch_[^/]*/[^/]*)$", 1)), "grids")

    @cached_property
    def places(self) -> DataFrame:
        return self.store.cut(places(self.bank_rows), "places")

    @cached_property
    def layouts(self) -> DataFrame:
        return self.store.cut(proposed(self.places), "layouts")

    @cached_property
    def proof(self) -> intake.Proof:
        return intake.Proof(self.cells, self.layouts, self.store)


AMOUNT = "CASE WHEN {0} < 0 THEN '-' ELSE '' END || (abs({0}) // 100)::VARCHAR || CASE WHEN {1}abs({0}) % 100 = 0 THEN '' ELSE '.' || lpad((abs({0}) % 100)::VARCHAR, 2, '0') END"


def lakh(paise: str) -> str:
    """SQL for rupees with lakh grouping, of an amount that is not negative."""
    whole = f"({paise} // 100)::VARCHAR"
    pairs = f"list_reverse(list_transform(range(0, (length({whole}) - 2) // 2), lambda i: reverse(substr(reverse({whole}), 4 + 2 * i, 2))))"
    return f"CASE WHEN length({whole}) <= 3 THEN {whole} ELSE array_to_string({pairs}, ',') || ',' || right({whole}, 3) END || '.' || lpad(({paise} % 100)::VARCHAR, 2, '0')"


def twins() -> dict[str, str]:
    """Named queries of the twins: the statements' lines, their cells, what the layouts make of them, and the faults."""
    shown = lambda paise: f"CASE WHEN world_id % 2 = 1 THEN {AMOUNT.format(paise, '')} ELSE {lakh(f'abs({paise})')} END"
    amount = lambda c: f"CASE WHEN {c} > 0 THEN {shown(c)} ELSE '' END"
    banners = ", ".join(f"'{b}'" for b in BANNERS)
    sides = lambda a, b: f"CASE WHEN world_id % 2 = 1 THEN [{b}, {a}] ELSE [{a}, {b}] END"
    file = "'batch_' || world_id % 3 || '/' || CASE WHEN world_id % 6 = 4 THEN 'kotak_' ELSE 'statement_' END || lpad(world_id::VARCHAR, 6, '0') || CASE WHEN world_id % 2 = 1 THEN '.xlsx' ELSE '.csv' END"
    return {
        "st_t": f"""SELECT world_id, i, n, CASE WHEN world_id % 3 = 2 AND n > 1 THEN n // 2 ELSE n END AS half, value_date, ref_no, credit_paise, debit_paise, balance,
  narration || CASE WHEN row_no % {QUOTED} = 0 THEN ' "x", y' || chr(10) || 'z' ELSE '' END AS narration
  FROM (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY world_id) AS n, ({START} + sum(credit_paise - debit_paise) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS balance
        FROM bank_rows WINDOW w AS (PARTITION BY world_id ORDER BY value_date, row_no))""",
        "st_w": "SELECT world_id, max(n) AS n, max(half) AS half, max(half) < max(n) AS two, max_by(balance, i) FILTER (i <= half) AS middle, max_by(balance, i) AS last FROM st_t GROUP BY ALL",
        "st_lines": f"""SELECT world_id, {HEAD - 1} + i + CASE WHEN i > half THEN 2 ELSE 0 END AS pos, 'transaction' AS kind, CASE WHEN i > half THEN 1 ELSE 0 END AS period, value_date, narration, ref_no, debit_paise, credit_paise, balance FROM st_t
  UNION ALL SELECT world_id, {HEAD - 1}, 'opening', 0, NULL, 'OPENING BALANCE', '', 0, 0, {START} FROM st_w
  UNION ALL SELECT world_id, {HEAD} + half, 'closing', 0, NULL, 'CLOSING BALANCE', '', 0, 0, middle FROM st_w
  UNION ALL SELECT world_id, {HEAD + 1} + half, 'opening', 1, NULL, 'OPENING BALANCE', '', 0, 0, middle FROM st_w WHERE two
  UNION ALL SELECT world_id, {HEAD + 2} + n, 'closing', 1, NULL, 'CLOSING BALANCE', '', 0, 0, last FROM st_w WHERE two
  UNION ALL SELECT world_id, {HEAD + 1} + n + CASE WHEN two THEN 2 ELSE 0 END, 'noise', -1, NULL, '*** end of statement ***', '', 0, 0, NULL FROM st_w""",
        "st_cells": f"""SELECT {file} AS file, pos AS row_no, list_concat(list_concat([CASE WHEN value_date IS NULL THEN '' WHEN world_id % 2 = 1 THEN strftime(value_date, '%d-%m-%Y') ELSE strftime(value_date, '%d/%m/%Y') END, narration, ref_no],
    {sides(amount('debit_paise'), amount('credit_paise'))}), [CASE WHEN balance IS NULL THEN '' ELSE {shown('balance')} || CASE WHEN world_id % 2 = 1 THEN '' WHEN balance < 0 THEN ' Dr' ELSE ' Cr' END END]) AS cells FROM st_lines
  UNION ALL SELECT {file}, 0, [[{banners}][world_id % {len(BANNERS)} + 1], '', '', '', '', ''] FROM st_w
  UNION ALL SELECT {file}, 1, ['Holder: "A" & <Co>,' || chr(10) || 'world ' || world_id, '', '', '', '', ''] FROM st_w
  UNION ALL SELECT {file}, 2, list_concat(list_concat(['Date', 'Narration', 'Chq/Ref'], {sides("'Withdrawal'", "'Deposit'")}), ['Balance']) FROM st_w""",
        "st_seen": f"""SELECT {file} AS file, world_id % 8 AS fault, world_id, pos, kind, period, value_date, narration, ref_no, balance,
  CASE WHEN world_id % 8 = 2 THEN credit_paise ELSE debit_paise END AS debit, CASE WHEN world_id % 8 = 2 THEN debit_paise ELSE credit_paise END AS credit
  FROM st_lines WHERE NOT (world_id % 8 = 3 AND pos = {HEAD + 2} AND kind = 'transaction') AND world_id % 8 NOT IN (4, 5, 6)""",
        "st_links": """SELECT *, coalesce(lag(balance) OVER w, 0) + credit - debit AS implied FROM st_seen WHERE kind <> 'noise'
  WINDOW w AS (PARTITION BY file, period ORDER BY pos)""",
        "st_faults": f"""SELECT file, 'E_BALANCE_CHAIN_BREAK' AS code, pos AS row_no FROM st_links WHERE kind = 'transaction' AND implied <> balance
  UNION ALL SELECT file, 'E_CLOSING_MISMATCH', pos FROM st_links WHERE kind = 'closing' AND implied <> balance
  UNION ALL SELECT {file}, 'E_TRANSACTION_LIKE_NOISE', pos FROM st_lines WHERE world_id % 8 = 3 AND pos = {HEAD + 2} AND kind = 'transaction'
  UNION ALL SELECT file, 'E_NO_AMOUNT', pos FROM st_seen WHERE kind = 'transaction' AND debit = 0 AND credit = 0
  UNION ALL SELECT {file}, 'E_ROW_UNCLASSIFIED', pos FROM st_lines WHERE world_id % 8 = 4 AND kind = 'noise'
  UNION ALL SELECT {file}, 'E_ROW_DOUBLE_CLASSIFIED', 2 FROM st_w WHERE world_id % 8 = 5
  UNION ALL SELECT {file}, 'E_COLUMN_RANGE', -1 FROM st_w WHERE world_id % 8 = 6
  UNION ALL SELECT {file}, 'E_REVERSAL_PAIR', {HEAD} FROM st_w WHERE world_id % 8 = 7""",
        "st_periods": """SELECT file, period, max(balance) FILTER (kind = 'opening') AS opening_paise, count(*) FILTER (kind = 'transaction') AS transaction_rows, sum(credit)::BIGINT AS credits_paise, sum(debit)::BIGINT AS debits_paise,
  count(*) FILTER (kind <> 'opening' AND implied <> balance) + count(*) FILTER (kind = 'transaction' AND debit = 0 AND credit = 0) = 0 AS chain_ok, max(balance) FILTER (kind = 'closing') AS closing FROM st_links GROUP BY ALL""",
        "st_rows": """SELECT s.file, s.pos AS row_no, 'REAL' || lpad((row_number() OVER (PARTITION BY s.file ORDER BY s.pos))::VARCHAR, 6, '0') AS txn_id, s.value_date, s.narration,
  CASE WHEN regexp_full_match(trim(split_part(s.narration, '-', 2)), '[A-Z]{4}[0-9]{12}') THEN trim(split_part(s.narration, '-', 2)) ELSE s.ref_no END AS ref_no, s.credit AS credit_paise, s.debit AS debit_paise, s.balance AS balance_paise, s.period
  FROM st_seen s WHERE s.kind = 'transaction' AND s.file NOT IN (SELECT file FROM st_faults)""",
        "st_results": f"""SELECT w.file, CASE w.world_id % 6 WHEN 0 THEN 'HDFC Bank' WHEN 1 THEN 'ICICI Bank' WHEN 2 THEN 'State Bank of India' WHEN 3 THEN 'Axis Bank' WHEN 4 THEN 'Kotak Mahindra Bank' ELSE 'unknown' END AS bank,
  w.n + CASE WHEN w.two THEN {HEAD + 4} ELSE {HEAD + 2} END AS rows, CASE WHEN f.codes IS NULL THEN w.n ELSE 0 END AS transactions, CASE WHEN f.codes IS NULL THEN 'passed' ELSE 'failed' END AS result, coalesce(f.codes, '') AS faults
  FROM (SELECT *, {file} AS file FROM st_w) w LEFT JOIN (SELECT file, array_to_string(list_sort(list(DISTINCT code)), ',') AS codes FROM st_faults GROUP BY ALL) f ON f.file = w.file""",
    }


def queries() -> dict:
    """Queries by name, of a folder's results, and their twins."""
    of = lambda make: (lambda r: make(r.statements()))
    ways = lambda s: intake.role_issues(s.layouts, proposed(s.places, honest=True))
    issues = f"""SELECT {{file}} AS file, role, got, expected FROM st_w, LATERAL (SELECT unnest([
      {{{{'role': 'debit', 'got': 4 - world_id % 2, 'expected': 3 + world_id % 2, 'hit': world_id % 8 = 2}}}}, {{{{'role': 'credit', 'got': 3 + world_id % 2, 'expected': 4 - world_id % 2, 'hit': world_id % 8 = 2}}}},
      {{{{'role': 'balance', 'got': 99, 'expected': 5, 'hit': world_id % 8 = 6}}}}, {{{{'role': 'transactions', 'got': n - 1, 'expected': n, 'hit': world_id % 8 = 3 AND n >= 3}}}}], recursive := true)) WHERE hit"""
    file = "'batch_' || world_id % 3 || '/' || CASE WHEN world_id % 6 = 4 THEN 'kotak_' ELSE 'statement_' END || lpad(world_id::VARCHAR, 6, '0') || CASE WHEN world_id % 2 = 1 THEN '.xlsx' ELSE '.csv' END"
    issues = issues.replace("{file}", file).replace("{{", "{").replace("}}", "}")
    return {
        "statement_grids": (of(lambda s: s.cells.select("file", "row_no", F.array_join("cells", "|").alias("cells"))), "SELECT file, row_no, array_to_string(cells, '|') AS cells FROM st_cells"),
        "statement_faults": (of(lambda s: s.proof.faults), "SELECT file, code, row_no FROM st_faults"),
        "statement_periods": (of(lambda s: s.proof.periods()), "SELECT file, period, opening_paise, transaction_rows, credits_paise, debits_paise, chain_ok, CASE WHEN chain_ok THEN closing END AS closing_paise FROM st_periods"),
        "statement_rows": (of(lambda s: s.proof.canonical()), "SELECT file, row_no, txn_id, value_date, narration, ref_no, credit_paise, debit_paise, balance_paise, period FROM st_rows"),
        "statement_reproof": (of(lambda s: s.proof.reproved(damaged(s.proof.canonical()))), REPROOF),
        "statement_results": (of(lambda s: s.proof.results()), "SELECT file, bank, rows, transactions, result, faults FROM st_results"),
        "statement_summary": (of(lambda s: intake.batch_summary(s.proof.results())), "SELECT result, count(*) AS files, sum(rows)::BIGINT AS rows FROM st_results GROUP BY ALL"),
        "statement_role_issues": (of(ways), issues),
        "statement_warnings": (of(lambda s: s.proof.warnings()), f"SELECT {file} AS file, 'W_PERIOD_GAP' AS code, -1 AS row_no FROM st_w WHERE two UNION ALL SELECT file, 'W_LOW_RECIPE_YIELD', -1 FROM (SELECT file, count(*) AS n, count(*) FILTER (regexp_full_match(trim(split_part(narration, '-', 2)), '[A-Z]{{4}}[0-9]{{12}}')) AS found FROM st_seen WHERE kind = 'transaction' GROUP BY ALL) WHERE found > 0 AND found < n // 2"),
    }


def damaged(rows: DataFrame) -> DataFrame:
    """Canonical rows with a paisa too much in every 50th, so that a silent re-proof fails."""
    return rows.withColumn("credit_paise", F.col("credit_paise") + F.when(F.col("row_no") % 50 == 9, 1).otherwise(0))


REPROOF = f"""SELECT file, txn_id, balance_paise, implied FROM (SELECT file, txn_id, balance_paise,
  (first + sum(credit_paise - debit_paise + CASE WHEN row_no % 50 = 9 THEN 1 ELSE 0 END) OVER (PARTITION BY file, period ORDER BY row_no))::BIGINT AS implied
  FROM (SELECT r.*, CASE WHEN r.period = 0 THEN {START} ELSE w.middle END AS first FROM st_rows r JOIN st_w w ON w.world_id = substr(regexp_extract(r.file, '[0-9]+[.]'), 1, 6)::BIGINT)) WHERE implied <> balance_paise"""
