"""Settlements against bank credits: five passes, each over what the earlier ones left open.

1. A credit that carries a settlement's reference: equal amount, explained shortfall, duplicates, split parts.
2. A damaged reference with an equal amount, if only one credit fits.
3. A credit that carries one reference and the sum of two settlements.
4. Equal amounts within the window, if unique on both sides; ties abstain with their rivals.
5. What is left becomes an exception with its nearest candidates.

All keys include world_id. Amounts meet by hash joins, references by joins on substrings. Claims that collide are served in source order
by rounds (pass 3) or replayed within their amount (pass 2).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import scalars as X
from tallyforge.operators import claims, neighbours
from tallyforge.operators.containment import meets
from tallyforge.sources.scratch import Store

CANDIDATE = "array<struct<record_id:string,amount_paise:bigint,reason:string>>"
BREAKDOWN = "array<struct<label:string,amount_paise:bigint>>"
COLUMNS = ["world_id", "kind", "status", "settlement_ids", "bank_txn_ids", "confidence", "expected_paise", "received_paise", "discrepancy_paise", "discrepancy_breakdown", "rules", "candidates", "pass_name"]
#: Labels of explained shortfalls.
LABELS = {"bank_charge": "bank_neft_rtgs_charge_incl_gst", "commission": "tds_1pct_of_net"}


def decision(df: DataFrame, kind: str, status: str | Column, sids: Column | None, tids: Column | None, rules: Column, pass_name: str, confidence: str | Column = "", expected: Column | None = None, received: Column | None = None, discrepancy: Column | None = None, breakdown: Column | None = None, candidates: Column | None = None) -> DataFrame:
    """Rows of ``df`` as decisions."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    number = lambda x: (F.lit(None) if x is None else x).cast("bigint")
    empty = F.array().cast("array<string>")
    return df.select(
        "world_id", lit(kind).alias("kind"), lit(status).alias("status"),
        (empty if sids is None else sids).alias("settlement_ids"), (empty if tids is None else tids).alias("bank_txn_ids"), lit(confidence).alias("confidence"),
        number(expected).alias("expected_paise"), number(received).alias("received_paise"), number(discrepancy).alias("discrepancy_paise"),
        (F.array() if breakdown is None else breakdown).cast(BREAKDOWN).alias("discrepancy_breakdown"), rules.alias("rules"),
        (F.array() if candidates is None else candidates).cast(CANDIDATE).alias("candidates"), lit(pass_name).alias("pass_name"),
    )


def candidate(record: Column, amount: Column, reason: str) -> Column:
    return F.struct(record.alias("record_id"), amount.cast("bigint").alias("amount_paise"), F.lit(reason).alias("reason"))


def rules(*names: str) -> Column:
    return F.array(*map(F.lit, names))


def prepare(settlements: DataFrame, bank_rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Settlements (sid, s_no, net, utr, created), credits (tid, c_no, amount, value_date, text, found, strip, shaped), and debits.
    Rows with a credit of 0 or less are debits."""
    s = settlements.select("world_id", F.col("settlement_id").alias("sid"), F.col("row_no").alias("s_no"), F.col("amount_paise").alias("net"), "utr", "created")
    texts = (F.col("narration"), F.col("ref_no"))
    c = bank_rows.filter("credit_paise > 0").select("world_id", F.col("txn_id").alias("tid"), F.col("row_no").alias("c_no"), F.col("credit_paise").alias("amount"), "value_date", F.upper(F.concat_ws(" ", *texts)).alias("text"), X.tokens(*texts).alias("found"), *texts)
    c = c.withColumns({"strip": X.full_strip(*texts), "shaped": X.shaped(F.col("found"), *texts)}).drop("narration", "ref_no")
    return s, c, bank_rows.filter("credit_paise <= 0").select("world_id", F.col("txn_id").alias("tid"), F.col("row_no").alias("c_no"))


def references(s: DataFrame, c: DataFrame) -> DataFrame:
    """Pairs whose credit carries the settlement's reference. Settlements without a reference meet nothing."""
    pairs = meets(c.select("world_id", "tid", "strip"), "strip", s.select("world_id", "sid", "utr"), "utr").select("world_id", "sid", "tid")
    return pairs.join(s, ["world_id", "sid"]).join(c, ["world_id", "tid"]).filter(F.contains("strip", F.col("utr")))


def pass_1(refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decisions, and the pairs whose amounts stay unexplained (pending)."""
    per_s = Window.partitionBy("world_id", "sid")
    told = refs.withColumn("n", F.count("*").over(per_s)).withColumn("equal", F.min(F.col("amount") == F.col("net")).over(per_s)).withColumn("total", F.sum("amount").over(per_s))
    told = told.withColumn("turn", F.row_number().over(per_s.orderBy("value_date", "tid"))).withColumn("why", X.decompose(F.col("net"), F.col("amount")))
    told = told.withColumn("late", ~X.in_window(F.col("created"), F.col("value_date")))
    net, amount, gap = F.col("net"), F.col("amount"), F.col("amount") - F.col("net")
    late = lambda *names: F.when(F.col("late"), rules("utr_exact", *names, "late_settlement")).otherwise(rules("utr_exact", *names))
    name, none = "pass1_exact_utr", F.array().cast("array<string>")
    case = F.when((F.col("n") == 1) & (amount == net), "whole").when((F.col("n") == 1) & F.col("why").isNotNull(), "explained").when(F.col("n") == 1, "pending")
    case = case.when(F.col("equal") & (F.col("turn") == 1), "first").when(F.col("equal"), "again").when(F.col("total") == net, "part").otherwise("odd")
    told = told.withColumn("case", case)
    within = lambda *cases: F.col("case").isin(*cases)
    label = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))[F.col("why")]
    repeated = candidate(F.col("sid"), net, "posted once more after the whole amount had arrived")
    unequal = candidate(F.col("sid"), net, "several postings name it, and their amounts do not add up to it")
    is_match = within("whole", "explained", "first")
    alone = decision(
        told.filter(within("whole", "explained", "first", "again", "odd")), F.when(is_match, "match").otherwise("exception"),
        F.when(within("whole", "first"), "matched").when(within("explained"), "matched_with_discrepancy").when(within("again"), "duplicate_credit").otherwise("ambiguous_abstain"),
        F.when(is_match, F.array("sid")).otherwise(none), F.array("tid"),
        F.when(within("whole"), late("amount_exact")).when(within("explained"), late("decomposed_discrepancy")).when(within("first"), rules("utr_exact", "amount_exact", "earliest_value_date")).when(within("again"), rules("utr_exact", "duplicate_posting")).otherwise(rules("utr_exact")),
        name, F.when(within("whole", "first"), "exact").when(within("explained"), "high").otherwise(""), F.when(is_match, net), amount, F.when(is_match, gap),
        F.when(within("explained"), F.array(F.struct(label.alias("label"), gap.alias("amount_paise")))).otherwise(F.array().cast(BREAKDOWN)),
        F.when(within("again"), F.array(repeated)).when(within("odd"), F.array(unequal)).otherwise(F.array().cast(CANDIDATE)),
    )
    parts = told.filter("case = 'part'").groupBy("world_id", "sid", "net").agg(F.transform(F.array_sort(F.collect_list(F.struct("value_date", "tid"))), lambda x: x["tid"]).alias("tids"), F.sum("amount").alias("amount"))
    split = decision(parts, "match", "matched_split", F.array("sid"), F.col("tids"), rules("utr_exact", "sum_exact_parts"), name, "high", net, amount, F.lit(0))
    return alone.unionByName(split), told.filter("case = 'pending'").select("world_id", "sid", "s_no", "net", "tid", "amount", "value_date")


@dataclass
class Open:
    """What no decision has claimed."""

    s: DataFrame
    c: DataFrame

    def after(self, decisions: DataFrame) -> Open:
        """What ``decisions``, a written table, leave open. At most one anti join a pass stands in a plan."""
        sids = decisions.select("world_id", F.explode("settlement_ids").alias("sid"))
        tids = decisions.select("world_id", F.explode("bank_txn_ids").alias("tid"))
        return Open(self.s.join(sids, ["world_id", "sid"], "left_anti"), self.c.join(tids, ["world_id", "tid"], "left_anti"))

    def cut(self, store: Store) -> Open:
        return Open(store.cut(self.s, "open_s"), store.cut(self.c, "open_c"))


def fuzzy(found: Column, utr: Column) -> Column:
    return F.exists(found, lambda t: (t != utr) & (X.fragment_of(t, utr) | X.is_utr_shaped(t) & X.near_utr(t, utr)))


def replay_pass_2(edges: pd.DataFrame) -> pd.DataFrame:
    """In settlement order, a settlement takes its credit if exactly one of its credits is still open."""
    taken, out = set(), []
    for _, mine in edges.sort_values(["s_no", "tid"]).groupby("s_no", sort=True):
        left = mine[~mine["tid"].isin(taken)]
        if len(left) == 1:
            taken.add(left["tid"].iloc[0])
            out.append(left)
    return pd.concat(out) if out else edges.iloc[:0]


def pass_2(left: Open, store: Store) -> DataFrame:
    edges = left.s.join(left.c.filter("shaped"), (left.s["world_id"] == left.c["world_id"]) & (F.col("net") == F.col("amount"))).filter(fuzzy(F.col("found"), F.col("utr")))
    edges = store.cut(edges.select(left.s["world_id"], "sid", "s_no", "net", "tid"), "edges2")
    busy = edges.groupBy("world_id", "tid", "net").count().filter("count > 1").select("world_id", "net").distinct()
    calm = edges.join(busy, ["world_id", "net"], "left_anti")
    alone = calm.withColumn("n", F.count("*").over(Window.partitionBy("world_id", "sid"))).filter("n = 1").drop("n")
    replayed = edges.join(busy, ["world_id", "net"], "left_semi").groupBy("world_id", "net").applyInPandas(replay_pass_2, edges.schema)
    hits = alone.unionByName(replayed)
    return decision(hits, "match", "matched", F.array("sid"), F.array("tid"), rules("utr_fuzzy", "amount_exact"), "pass2_fuzzy_utr", "high", F.col("net"), F.col("net"), F.lit(0))


def pass_3(pending: DataFrame, left: Open, store: Store) -> tuple[DataFrame, DataFrame]:
    """Decisions, and the pairs still pending. Pairs of which a side is taken are dropped."""
    alive = pending.join(left.s.select("world_id", "sid"), ["world_id", "sid"], "left_semi").join(left.c.select("world_id", "tid"), ["world_id", "tid"], "left_semi")
    partner = left.s.select("world_id", F.col("sid").alias("partner"), F.col("s_no").alias("p_no"), F.col("net").alias("rest"), F.col("created").alias("p_created"))
    met = alive.withColumn("rest", F.col("amount") - F.col("net")).filter("rest > 0").join(partner, ["world_id", "rest"])
    met = met.filter((F.col("sid") != F.col("partner")) & X.in_window(F.col("p_created"), F.col("value_date"), X.WINDOW_DAYS + X.MERGE_EXTRA_DAYS))
    kept = claims.merged(met.select("world_id", "sid", "s_no", "net", "tid", "amount", "partner", "p_no", "rest"), store)
    kept = kept.withColumn("n", F.count("*").over(Window.partitionBy("world_id", "s_no")))
    one = kept.filter("n = 1")
    whole = F.col("net") + F.col("rest")
    merged = decision(one, "match", "matched_merged", F.array("sid", "partner"), F.array("tid"), rules("utr_exact", "merge_residual_exact"), "pass3_merge", "high", whole, F.col("amount"), F.lit(0))
    many = kept.filter("n > 1").groupBy("world_id", "sid", "net", "tid", "amount").agg(F.array_sort(F.collect_list(F.struct("p_no", F.col("partner").alias("record_id"), F.col("rest").alias("amount_paise")))).alias("ps"))
    reason = "what the credit holds beyond its named settlement is this amount"
    others = F.transform("ps", lambda x: candidate(x["record_id"], x["amount_paise"], reason))
    tied = decision(many, "exception", "ambiguous_abstain", None, F.array("tid"), rules("utr_exact"), "pass3_merge", received=F.col("amount"), candidates=F.concat(F.array(candidate(F.col("sid"), F.col("net"), reason)), others))
    return merged.unionByName(tied), alive.join(kept.select("world_id", "sid").distinct(), ["world_id", "sid"], "left_anti")


def pass_4(left: Open, store: Store) -> DataFrame:
    edges = left.s.join(left.c.filter("shaped").withColumnRenamed("amount", "net"), ["world_id", "net"]).filter(X.in_window(F.col("created"), F.col("value_date")))
    edges = edges.withColumn("of_s", F.count("*").over(Window.partitionBy("world_id", "sid"))).withColumn("of_c", F.count("*").over(Window.partitionBy("world_id", "tid")))
    edges = store.cut(edges.select("world_id", "sid", "s_no", "tid", "c_no", "net", "value_date", "of_s", "of_c"), "edges4")
    name, net = "pass4_amount_unique", F.col("net")
    unique = decision(edges.filter("of_s = 1 AND of_c = 1"), "match", "matched", F.array("sid"), F.array("tid"), rules("amount_exact_unique", "window"), name, "medium", net, net, F.lit(0))
    tied = edges.filter("of_s > 1 OR of_c > 1")
    rival = tied.select("world_id", "tid", F.col("sid").alias("rival"))
    rivals = tied.join(rival, ["world_id", "tid"]).filter("sid <> rival").groupBy("world_id", "sid").agg(F.array_sort(F.collect_set("rival")).alias("rivals"))
    per_s = tied.groupBy("world_id", "sid", "net").agg(F.array_sort(F.collect_list(F.struct("c_no", "tid"))).alias("cs")).join(rivals, ["world_id", "sid"], "left")
    of_credits = F.transform("cs", lambda x: candidate(x["tid"], net, "same amount, wanted by more than one settlement"))
    of_rivals = F.transform(F.coalesce("rivals", F.array().cast("array<string>")), lambda x: candidate(x, net, "waits for the same amount in the same days"))
    s_side = decision(per_s, "exception", "ambiguous_abstain", F.array("sid"), None, rules("amount_tie"), name, expected=net, candidates=F.concat(of_credits, of_rivals))
    per_c = tied.groupBy("world_id", "tid", "net").agg(F.array_sort(F.collect_list(F.struct("s_no", "sid"))).alias("ss"))
    of_settlements = F.transform("ss", lambda x: candidate(x["sid"], net, "expects this amount in these days"))
    c_side = decision(per_c, "exception", "ambiguous_abstain", None, F.array("tid"), rules("amount_tie"), name, received=net, candidates=of_settlements)
    return unique.unionByName(s_side).unionByName(c_side)


def pass_5(pending: DataFrame, left: Open, debits: DataFrame, store: Store) -> DataFrame:
    name, gap = "pass5_residuals", F.col("amount") - F.col("net")
    alive = pending.join(left.s.select("world_id", "sid"), ["world_id", "sid"], "left_semi").join(left.c.select("world_id", "tid"), ["world_id", "tid"], "left_semi")
    first = store.cut(alive.withColumn("turn", F.row_number().over(Window.partitionBy("world_id", "tid").orderBy("s_no"))).filter("turn = 1"), "pending5")
    review = decision(first, "match", "matched_with_discrepancy", F.array("sid"), F.array("tid"), rules("utr_exact", "unexplained_residual"), name, "needs_review", F.col("net"), F.col("amount"), gap, F.array(F.struct(F.lit("unexplained").alias("label"), gap.alias("amount_paise"))))
    rest = left.after(review)
    days = rest.s.select("world_id", "sid", "net", F.explode(F.transform(F.sequence(F.lit(0), F.lit(X.WINDOW_DAYS)), lambda n: F.date_add("created", n))).alias("value_date"))
    near = days.join(rest.c.filter("shaped").select("world_id", "value_date", "tid", "c_no", "amount"), ["world_id", "value_date"])
    near = near.withColumn("turn", F.row_number().over(Window.partitionBy("world_id", "sid").orderBy(F.abs(gap), "c_no"))).filter("turn <= 3")
    near = near.groupBy("world_id", "sid").agg(F.array_sort(F.collect_list(F.struct("turn", "tid", "amount"))).alias("near"))
    missing = rest.s.join(near, ["world_id", "sid"], "left")
    found = F.transform("near", lambda x: candidate(x["tid"], x["amount"], "among the closest amounts that arrived in its days"))
    nothing = F.array(candidate(F.lit(""), F.lit(0), "nothing open in its days looks like a settlement"))
    no_bank = decision(missing, "exception", "exception_missing_bank", F.array("sid"), None, rules("no_credit_found"), name, expected=F.col("net"), candidates=F.coalesce(found, nothing))
    other = decision(rest.c.filter("NOT shaped"), "exception", "non_settlement_credit", None, F.array("tid"), rules("not_settlement_shaped"), name, received=F.col("amount"))
    asking = rest.c.filter("shaped").select("world_id", F.col("tid").alias("asker"), "amount")
    close = neighbours.nearest(asking, rest.s.select("world_id", F.col("sid").alias("id"), F.col("s_no").alias("no"), F.col("net").alias("amount")), 3, store)
    close = close.groupBy("world_id", F.col("asker").alias("tid")).agg(F.array_sort(F.collect_list(F.struct("turn", F.col("id").alias("sid"), F.col("amount").alias("net")))).alias("near"))
    strangers = rest.c.filter("shaped").join(close, ["world_id", "tid"], "left")
    found = F.transform("near", lambda x: candidate(x["sid"], x["net"], "among the closest amounts still awaited, under another reference"))
    nothing = F.array(candidate(F.lit(""), F.lit(0), "every settlement is accounted for"))
    no_settlement = decision(strangers, "exception", "exception_missing_settlement", None, F.array("tid"), rules("no_settlement_found"), name, received=F.col("amount"), candidates=F.coalesce(found, nothing))
    return reduce(DataFrame.unionByName, [review, no_bank, other, no_settlement, outside(debits)])


def outside(debits: DataFrame) -> DataFrame:
    """Debits, which no pass looks at."""
    return decision(debits, "out_of_scope", "out_of_scope", None, F.array("tid"), rules("debit"), "pass0_scope")


@dataclass
class Start:
    """What the passes start from, and the reference baseline too: all records, and the pairs whose credit carries the reference."""

    everything: Open
    debits: DataFrame
    refs: DataFrame


def start(settlements: DataFrame, bank_rows: DataFrame, store: Store) -> Start:
    s, c, debits = prepare(settlements, bank_rows)
    s, c = store.cut(s, "s"), store.cut(c, "c")
    worded = F.contains("text", F.upper("utr")).alias("worded")
    refs = references(s, c).select("world_id", "sid", "s_no", "net", "utr", "created", "tid", "c_no", "amount", "value_date", worded)
    return Start(Open(s, c.drop("text")), debits, store.cut(refs, "refs"))


def reconcile(settlements: DataFrame, bank_rows: DataFrame, store: Store, begun: Start | None = None) -> DataFrame:
    """All decisions; each settlement and each bank row is in at least one."""
    begun = begun or start(settlements, bank_rows, store)
    everything, debits = begun.everything, begun.debits
    first, pending = pass_1(begun.refs)
    first, pending = store.cut(first, "pass1"), store.cut(pending, "pending")
    left = everything.after(first).cut(store)
    second = store.cut(pass_2(left, store), "pass2")
    left = left.after(second)
    third, pending = pass_3(pending, left, store)
    third, pending = store.cut(third, "pass3"), store.cut(pending, "pending3")
    left = left.after(third)
    fourth = store.cut(pass_4(left, store), "pass4")
    left = left.after(fourth).cut(store)
    return reduce(DataFrame.unionByName, [first, second, third, fourth, pass_5(pending, left, debits, store)])
