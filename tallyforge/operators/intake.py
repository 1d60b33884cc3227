"""Statement intake: raw grids of cells and proposed layouts, proved by the running balance before any row is used.

Grids (file, row_no, cells) and layouts are tables keyed by file, and every rule is a join or a window over all files at once, so a folder of
statements is one job. A layout says what each row is and which column holds what (``LAYOUT``).
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import scalars as X
from tallyforge.sources import grids
from tallyforge.sources.scratch import Store

PERIODS = "array<struct<opening_row:int,closing_row:int,transaction_rows:array<int>>>"
#: A layout's columns: numbers of columns by role, the pattern of dates, what each row is, how a reference is found in a narration, and
#: the pairs of a transaction and its reversal.
LAYOUT = f"file string, header_row int, columns map<string,int>, date_format string, periods {PERIODS}, noise_rows array<int>, delimiter string, token_index int, token_regex string, reversal_pairs array<array<int>>"
#: The roles that a layout must name, and those that it may.
ROLES, OPTIONAL = ["date", "narration", "debit", "credit", "balance"], ["drcr_indicator", "chq_ref"]
FAULT = "file string, code string, row_no long"


@dataclass
class Mapping:
    """A proposed layout of one statement."""

    header_row: int
    columns: dict[str, int]
    date_format: str
    periods: list[dict]
    noise_rows: list[int] = field(default_factory=list)
    delimiter: str = ""
    token_index: int = 0
    token_regex: str = ""
    reversal_pairs: list[tuple[int, int]] = field(default_factory=list)


def layouts_of(spark: SparkSession, mappings: dict[str, Mapping]) -> DataFrame:
    """Layouts as a table, by file."""
    return spark.createDataFrame([asdict(m) | {"file": file, "reversal_pairs": [list(p) for p in m.reversal_pairs]} for file, m in mappings.items()], LAYOUT)


def read_layouts(spark: SparkSession, path: str) -> DataFrame:
    """Layouts from JSON documents, one a file, with ``statement`` as the file's name without folder and ending. Documents may lack the
    reference recipe, noise rows and reversal pairs, as labelled layouts do."""
    recipe = "reference_recipe struct<kind:string,delimiter:string,index:int,token_regex:string>"
    read = spark.read.schema(f"header_row int, columns map<string,int>, date_format string, periods {PERIODS}, noise_rows array<int>, {recipe}, reversal_pairs array<array<int>>").json(path, multiLine=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    known = F.col("reference_recipe.kind") == "delimited"
    return read.select(
        name.alias("statement"), "header_row", "columns", "date_format", "periods", F.coalesce("noise_rows", F.array().cast("array<int>")).alias("noise_rows"),
        *(F.coalesce(F.when(known, F.col(f"reference_recipe.{old}")), F.lit(no)).alias(new) for new, old, no in (("delimiter", "delimiter", ""), ("token_index", "index", 0), ("token_regex", "token_regex", ""))),
        F.coalesce("reversal_pairs", F.array().cast("array<array<int>>")).alias("reversal_pairs"),
    )


def grid(spark: SparkSession, path: str) -> DataFrame:
    """(row_no, cells) of one statement."""
    return grids.read(spark, path).select("row_no", "cells")


def roles(layouts: DataFrame) -> DataFrame:
    """(file, row_no, kind, period, turn) as the layouts say it: turn is a transaction's place in its period. A row may be named twice."""
    none = F.lit(-1)
    header = layouts.select("file", F.col("header_row").alias("row_no"), F.lit("header").alias("kind"), none.alias("period"), none.alias("turn"))
    noise = layouts.select("file", F.explode("noise_rows").alias("row_no"), F.lit("noise").alias("kind"), none.alias("period"), none.alias("turn"))
    periods = layouts.select("file", F.posexplode("periods").alias("period", "p"))
    edges = [periods.select("file", F.col(f"p.{kind}_row").alias("row_no"), F.lit(kind).alias("kind"), "period", none.alias("turn")) for kind in ("opening", "closing")]
    rows = periods.select("file", "period", F.posexplode("p.transaction_rows").alias("turn", "row_no"))
    rows = rows.select("file", "row_no", F.lit("transaction").alias("kind"), "period", "turn")
    return reduce(DataFrame.unionByName, [header, noise, *edges, rows]).withColumn("row_no", F.col("row_no").cast("long"))


def _told(df: DataFrame, code: str) -> DataFrame:
    return df.select("file", F.lit(code).alias("code"), F.col("row_no").cast("long").alias("row_no"))


def parsed(cells: DataFrame, layouts: DataFrame) -> DataFrame:
    """The grids with typed cells: day, debit, credit, balance (signed), reference, and which cells were filled."""
    slim = layouts.select("file", "columns", "date_format", "delimiter", "token_index", "token_regex")
    cell = lambda role: F.trim(F.coalesce(F.get("cells", F.col("columns")[role]), F.lit("")))
    raw = cells.join(slim.hint("merge"), "file").select("file", "row_no", "date_format", "delimiter", "token_index", "token_regex", *(cell(role).alias(role) for role in [*ROLES, *OPTIONAL]))
    debit, credit, balance = (X.amount_cell(F.col(r)) for r in ("debit", "credit", "balance"))
    mark = F.upper(F.rtrim(F.regexp_replace("drcr_indicator", r"\.+$", "")))
    owed = (mark == "DR") | (F.coalesce(balance["side"], F.lit("")) == "DR")
    signed = F.when(mark.isin("DR", "CR", ""), F.when(owed, -F.abs(balance["paise"])).otherwise(balance["paise"]))
    found = X.reference_at(F.col("narration"), F.col("delimiter"), F.col("token_index"), F.col("token_regex"))
    return raw.select(
        "file", "row_no", X.date_at(F.col("date"), F.col("date_format")).alias("day"), "narration", (F.col("debit") != "").alias("has_debit"), (F.col("credit") != "").alias("has_credit"),
        debit["paise"].alias("debit"), credit["paise"].alias("credit"), signed.alias("balance"), found.alias("reference"), "chq_ref",
    )


def amount() -> Column:
    """What a row with one filled side moves."""
    return F.when(F.col("has_debit") & ~F.col("has_credit"), -F.col("debit")).when(F.col("has_credit") & ~F.col("has_debit"), F.col("credit"))


def chain(rows: DataFrame) -> DataFrame:
    """Rows of periods (file, kind, period, turn, movement, balance) with the balance that the rows before imply. After a break the stated
    balance counts, so each break shows once; a row without a readable balance moves the running value only."""
    order = Window.partitionBy("file", "period").orderBy(F.when(F.col("kind") == "opening", 0).when(F.col("kind") == "closing", 2).otherwise(1), "turn")
    sofar = rows.withColumn("moved", F.sum(F.coalesce("movement", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    anchor = F.last(F.when(F.col("balance").isNotNull(), F.struct(F.col("balance").alias("b"), F.col("moved").alias("m"))), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return sofar.withColumn("anchor", anchor).withColumn("implied", F.col("anchor.b") + F.col("moved") - F.col("anchor.m")).drop("anchor", "moved")


class Proof:
    """Grids and layouts, joined once, and the faults of the layouts.

    A file's faults of structure are told alone; what stands beside a balance row is told of files without other faults.
    """

    def __init__(self, cells: DataFrame, layouts: DataFrame, store: Store):
        self.cells, self.layouts = cells.join(layouts.select("file"), "file", "left_semi"), layouts
        # A row for each number in the layouts' arrays: the planner takes these for as large as the layouts and would broadcast them.
        self.roles = roles(layouts).hint("merge")
        structure = store.cut(self._structure(), "structure")
        sound = layouts.join(structure.select("file").distinct(), "file", "left_anti")
        self.rows = store.cut(parsed(self.cells, sound).join(self.roles, ["file", "row_no"]), "typed")
        self.links = store.cut(chain(self.rows.filter("period >= 0").withColumn("movement", F.when(F.col("kind") == "transaction", amount()))), "links")
        content = store.cut(self._content(sound), "content")
        edges = self._edges().join(content.select("file").distinct(), "file", "left_anti")
        self.faults = store.cut(structure.unionByName(content).unionByName(edges), "faults")

    def _structure(self) -> DataFrame:
        """Columns out of the grid or named twice, rows out of it, named twice or not at all."""
        wide = self.cells.groupBy("file").agg(F.max(F.size("cells")).alias("width"))
        named = self.layouts.join(wide, "file", "left").select("file", F.coalesce("width", F.lit(0)).alias("width"), "columns")
        number = F.coalesce(F.col("columns")[F.col("role")], F.lit(-1))
        must = named.select("file", "width", "columns", F.explode(F.array(*map(F.lit, ROLES))).alias("role")).withColumn("number", number)
        may = named.select("file", "width", F.explode("columns").alias("role", "number")).filter(F.col("role").isin(OPTIONAL) & F.col("number").isNotNull())
        out = must.drop("columns").unionByName(may).filter("number < 0 OR number >= width")
        twice = must.groupBy("file").agg(F.count_distinct("number").alias("n")).filter(F.col("n") < len(ROLES))
        seen = self.cells.select("file", "row_no").hint("merge")
        return reduce(DataFrame.unionByName, [
            _told(out.withColumn("row_no", F.lit(-1)), "E_COLUMN_RANGE"), _told(twice.withColumn("row_no", F.lit(-1)), "E_COLUMN_COLLISION"),
            _told(self.roles.join(seen, ["file", "row_no"], "left_anti"), "E_ROW_RANGE"),
            _told(self.roles.join(seen, ["file", "row_no"]).groupBy("file", "row_no").count().filter("count > 1"), "E_ROW_DOUBLE_CLASSIFIED"),
            _told(seen.join(self.roles, ["file", "row_no"], "left_anti"), "E_ROW_UNCLASSIFIED"),
        ])

    def _content(self, layouts: DataFrame) -> DataFrame:
        """Cells that cannot be read, dates out of order, broken balances, hidden transactions, references and reversals that do not hold."""
        rows, links = self.rows, self.links
        t = rows.filter("kind = 'transaction'")
        dated = t.filter("day IS NOT NULL").withColumn("last", F.lag("day").over(Window.partitionBy("file", "period").orderBy("turn")))
        side = lambda p: t.select("file", F.col("row_no").alias(p), F.col("reference").alias(f"{p}_ref"), amount().alias(f"{p}_amount"))
        pairs = layouts.select("file", F.explode("reversal_pairs").alias("pair")).select("file", "pair", F.get("pair", F.lit(0)).cast("long").alias("row_no"), F.get("pair", F.lit(1)).cast("long").alias("other"))
        met = pairs.join(side("row_no"), ["file", "row_no"], "left").join(side("other"), ["file", "other"], "left")
        fits = (F.size("pair") == 2) & (F.col("row_no_ref") != "") & (F.col("row_no_ref") == F.col("other_ref")) & (F.col("row_no_amount") == -F.col("other_amount")) & (F.col("row_no_amount") != 0)
        barren = layouts.filter("token_regex <> ''").join(t, "file").groupBy("file").agg(F.max("reference").alias("found")).filter("found = ''")
        hidden = rows.filter("kind = 'noise' AND day IS NOT NULL AND CASE WHEN has_debit THEN debit ELSE credit END IS NOT NULL")
        return reduce(DataFrame.unionByName, [
            _told(t.filter("day IS NULL"), "E_DATE_PARSE"), _told(dated.filter("day < last"), "E_DATE_ORDER"), _told(t.filter("has_debit AND has_credit"), "E_BOTH_SIDES"),
            _told(t.filter("NOT has_debit AND NOT has_credit"), "E_NO_AMOUNT"), _told(t.filter((F.col("has_debit") != F.col("has_credit")) & amount().isNull()), "E_AMOUNT_PARSE"),
            _told(links.filter("balance IS NULL"), "E_BALANCE_PARSE"), _told(links.filter("kind = 'transaction' AND balance <> implied"), "E_BALANCE_CHAIN_BREAK"),
            _told(links.filter("kind = 'closing' AND balance <> implied"), "E_CLOSING_MISMATCH"), _told(hidden, "E_TRANSACTION_LIKE_NOISE"),
            _told(barren.withColumn("row_no", F.lit(-1)), "E_RECIPE_YIELD"), _told(met.filter(~F.coalesce(fits, F.lit(False))), "E_REVERSAL_PAIR"),
        ])

    def _edges(self) -> DataFrame:
        """Balance rows that carry an amount or do not stand around their transactions."""
        limits = self.rows.filter("kind = 'transaction'").groupBy("file", "period").agg(F.min("row_no").alias("low"), F.max("row_no").alias("high"))
        edges = self.rows.filter("kind IN ('opening', 'closing')")
        outside = edges.join(limits, ["file", "period"]).filter("(kind = 'opening' AND row_no >= low) OR (kind = 'closing' AND row_no <= high)")
        return _told(edges.filter("has_debit OR has_credit"), "E_BALANCE_ROW_HAS_AMOUNT").unionByName(_told(outside, "E_PERIOD_ORDER"))

    def periods(self) -> DataFrame:
        """(file, period, opening_paise, closing_paise, transaction_rows, credits_paise, debits_paise, chain_ok) of layouts without faults of
        structure; closing_paise only of a period that closes."""
        broken = F.col("balance").isNull() | F.coalesce(F.col("balance") != F.col("implied"), F.lit(False)) | ((F.col("kind") == "transaction") & F.col("movement").isNull())
        of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("balance")))
        movement = F.coalesce("movement", F.lit(0))
        told = self.links.groupBy("file", "period").agg(
            of("opening").alias("opening_paise"), of("closing").alias("closing"), F.count_if(F.col("kind") == "transaction").alias("transaction_rows"),
            F.sum(F.greatest(movement, F.lit(0))).alias("credits_paise"), F.sum(F.greatest(-movement, F.lit(0))).alias("debits_paise"), (~F.bool_or(broken)).alias("chain_ok"),
        )
        return told.withColumn("closing_paise", F.when(F.col("chain_ok"), F.col("closing"))).drop("closing")

    def warnings(self) -> DataFrame:
        """(file, code, row_no) of what a person should know of a layout: several periods, and a reference recipe that fits few rows."""
        several = self.layouts.filter(F.size("periods") > 1).withColumn("row_no", F.lit(-1))
        t = self.rows.filter("kind = 'transaction'").groupBy("file").agg(F.count_if(F.col("reference") != "").alias("n"), F.count("*").alias("rows"))
        few = t.filter("n > 0 AND n < floor(rows / 2)").withColumn("row_no", F.lit(-1))
        return _told(several, "W_PERIOD_GAP").unionByName(_told(few, "W_LOW_RECIPE_YIELD"))

    def canonical(self) -> DataFrame:
        """Canonical bank rows of the proved layouts, numbered over each statement's periods in their order."""
        t = self.rows.filter("kind = 'transaction'").join(self.faults.select("file").distinct(), "file", "left_anti")
        turn = F.row_number().over(Window.partitionBy("file").orderBy("period", "turn"))
        side = lambda has, value: F.when(F.col(has), F.col(value)).otherwise(0)
        reference = F.when(F.col("reference") != "", F.col("reference")).otherwise(F.col("chq_ref"))
        return t.select(
            "file", "row_no", F.concat(F.lit("REAL"), F.lpad(turn.cast("string"), 6, "0")).alias("txn_id"), F.col("day").alias("value_date"), "narration", reference.alias("ref_no"),
            side("has_credit", "credit").alias("credit_paise"), side("has_debit", "debit").alias("debit_paise"), F.col("balance").alias("balance_paise"), "period",
        )

    def reproved(self, rows: DataFrame) -> DataFrame:
        """Canonical rows whose stated balance is not the period's opening balance plus all movements so far; empty if the rows prove it."""
        opening = self.rows.filter("kind = 'opening'").select("file", "period", F.col("balance").alias("opening"))
        order = Window.partitionBy("file", "period").orderBy("txn_id").rowsBetween(Window.unboundedPreceding, 0)
        told = rows.join(opening, ["file", "period"], "left").withColumn("implied", F.col("opening") + F.sum(F.col("credit_paise") - F.col("debit_paise")).over(order))
        return told.filter(~F.col("implied").eqNullSafe(F.col("balance_paise"))).select("file", "txn_id", "balance_paise", "implied")

    def results(self) -> DataFrame:
        """(file, bank, rows, transactions, result, faults) of each statement that has a layout: passed if the layout is proved and its rows
        prove it again; faults are its codes in order."""
        again = _told(self.reproved(self.canonical()).withColumn("row_no", F.lit(-1)), "E_REPROOF")
        codes = self.faults.unionByName(again).groupBy("file").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("faults"))
        sizes = self.cells.groupBy("file").agg(F.count("*").alias("rows"))
        named = self.layouts.select("file", F.aggregate("periods", F.lit(0), lambda n, p: n + F.size(p["transaction_rows"])).alias("listed"))
        told = named.join(sizes, "file", "left").join(banks(self.cells), "file", "left").join(codes, "file", "left")
        failed = F.col("faults").isNotNull()
        return told.select("file", "bank", F.coalesce("rows", F.lit(0)).alias("rows"), F.when(failed, 0).otherwise(F.col("listed")).alias("transactions"), F.when(failed, "failed").otherwise("passed").alias("result"), F.coalesce("faults", F.lit("")).alias("faults"))


#: Banks with their names, the first letters of their branch codes, and of their files' names.
BANKS = [
    ("HDFC Bank", "HDFC BANK", "HDFC0", "hdfc"),
    ("ICICI Bank", "ICICI BANK", "ICIC0", "icici"),
    ("State Bank of India", "STATE BANK OF INDIA", "SBIN0", "sbi"),
    ("Axis Bank", "AXIS BANK", "UTIB0", "axis"),
    ("Kotak Mahindra Bank", "KOTAK MAHINDRA", "KKBK0", "kotak"),
]
#: Fixed value: rows in which a statement names its bank.
HEAD_ROWS = 40
#: Fixed value: a branch code as a word of its own. A payment's reference may begin with the same five characters, but is longer.
BRANCH_CODE = "(?<![A-Z0-9])[A-Z]{4}0[A-Z0-9]{6}(?![A-Z0-9])"


def banks(cells: DataFrame) -> DataFrame:
    """(file, bank) for grids (file, row_no, cells) of many statements: a bank's name counts more than a branch code and an earlier row
    more than a later one, as counterparties' banks stand further down; with neither, the file's name tells."""
    marks = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("place"), F.lit(b[0]).alias("bank"), F.lit(b[kind]).alias("mark")) for kind in (1, 2) for k, b in enumerate(BANKS)))
    head = cells.filter(F.col("row_no") < HEAD_ROWS).select("file", "row_no", F.upper(F.array_join("cells", " ")).alias("text"))
    head = head.withColumn("codes", F.regexp_extract_all("text", F.lit(BRANCH_CODE), F.lit(0)))
    stands = lambda m: F.when(m["kind"] == 1, F.contains("text", m["mark"])).otherwise(F.exists("codes", lambda c: F.startswith(c, m["mark"])))
    seen = head.select("file", "row_no", F.explode(F.filter(marks, stands)).alias("m"))
    named = seen.groupBy("file").agg(F.min_by("m.bank", F.struct("m.kind", "row_no", "m.place")).alias("bank"))
    name = F.lower(F.element_at(F.split("file", "/"), -1))
    of_name = reduce(lambda made, b: made.when(name.startswith(b[3]), b[0]), BANKS, F.when(F.lit(False), ""))
    return cells.select("file").distinct().join(named, "file", "left").select("file", F.coalesce("bank", of_name, F.lit("unknown")).alias("bank"))


def statement_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file) of all statements under a folder, however deep, but for those under folders of other use."""
    return spark.createDataFrame([(file,) for file in grids.listed(folder)], "file string")


def role_issues(layouts: DataFrame, golden: DataFrame) -> DataFrame:
    """(file, role, got, expected) where accepted layouts depart from the labelled ones: the header's row, a role's column, or the transaction
    rows, told by their number."""
    told = layouts.alias("l").join(golden.alias("g"), "file")
    column = lambda side, role: F.col(f"{side}.columns")[role]
    listed = lambda side: F.array_sort(F.flatten(F.transform(F.col(f"{side}.periods"), lambda p: p["transaction_rows"])))
    entry = lambda name, got, expected, differs: F.struct(F.lit(name).alias("role"), got.alias("got"), expected.alias("expected"), F.coalesce(differs, F.lit(False)).alias("differs"))
    header = (F.col("l.header_row"), F.col("g.header_row"))
    entries = [entry("header", *header, ~header[0].eqNullSafe(header[1]))]
    entries += [entry(role, column("l", role), column("g", role), column("g", role).isNotNull() & ~column("l", role).eqNullSafe(column("g", role))) for role in ROLES]
    entries.append(entry("transactions", F.size(listed("l")), F.size(listed("g")), listed("l") != listed("g")))
    found = told.select("file", F.explode(F.filter(F.array(*entries), lambda e: e["differs"])).alias("e"))
    return found.select("file", "e.role", "e.got", "e.expected")


def layout_limits(golden: DataFrame) -> DataFrame:
    """(file, limit) of what labelled layouts have that a layout cannot say: one amount column, or balances outside the table."""
    def lacks(edge: str) -> Column:
        return F.exists("periods", lambda p: p[f"{edge}_row"].isNull())

    limits = F.array(
        F.when(F.col("columns")["amount"].isNotNull(), "one amount column with a Dr/Cr marker"), F.when(lacks("opening"), "opening balance only in a summary line"),
        F.when(lacks("closing"), "closing balance only in a summary line"),
    )
    return golden.select("file", F.explode(F.filter(limits, lambda x: x.isNotNull())).alias("limit"))


def batch_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("result").agg(F.count("*").alias("files"), F.sum("rows").alias("rows"))


def one(spark: SparkSession, cells: DataFrame, mapping: Mapping) -> Proof:
    """The proof of one statement, a grid (row_no, cells)."""
    return Proof(cells.withColumn("file", F.lit("")), layouts_of(spark, {"": mapping}), Store(spark))


def batch(spark: SparkSession, layouts: dict[str, Mapping]) -> DataFrame:
    """The results of statements with a given layout each."""
    cells = reduce(DataFrame.unionByName, [grids.read(spark, path).withColumn("file", F.lit(path)) for path in layouts])
    return Proof(cells, layouts_of(spark, layouts), Store(spark)).results()
