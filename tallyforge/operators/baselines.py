"""Two simpler matchers to compare with: tolerance first come first served, and exact reference then exact amount."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import scalars as X
from tallyforge.operators.claims import served
from tallyforge.operators.containment import meets
from tallyforge.operators.leg_a import COLUMNS, candidate, decision, rules, start
from tallyforge.sources.scratch import Store

TOLERANCE, DAYS = 100, 3


def sides(settlements: DataFrame, bank_rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = settlements.select("world_id", F.col("settlement_id").alias("sid"), F.col("row_no").alias("s_no"), F.col("amount_paise").alias("net"), "utr", "created", "settled")
    c = bank_rows.filter("credit_paise > 0").select("world_id", F.col("txn_id").alias("tid"), F.col("row_no").alias("c_no"), F.col("credit_paise").alias("amount"), "value_date", F.upper(F.concat_ws(" ", "narration", "ref_no")).alias("text"))
    return s, c, bank_rows.filter("credit_paise <= 0").select("world_id", F.col("txn_id").alias("tid"))


def left_over(s: DataFrame, c: DataFrame, debits: DataFrame, matched: DataFrame, name: str) -> list[DataFrame]:
    none = F.array(candidate(F.lit(""), F.lit(0), "the baseline keeps no candidates"))
    return [
        decision(c.join(matched.select("world_id", "tid"), ["world_id", "tid"], "left_anti"), "exception", "exception_missing_settlement", None, F.array("tid"), rules("no_candidate"), name, received=F.col("amount"), candidates=none),
        decision(s.join(matched.select("world_id", "sid"), ["world_id", "sid"], "left_anti"), "exception", "exception_missing_bank", F.array("sid"), None, rules("no_candidate"), name, expected=F.col("net"), candidates=none),
        decision(debits, "out_of_scope", "out_of_scope", None, F.array("tid"), F.array().cast("array<string>"), "scope"),
    ]


def naive(settlements: DataFrame, bank_rows: DataFrame, store: Store) -> DataFrame:
    """Amounts within one rupee, value date within three days of the expected one; the smallest gap, then the earlier settlement.
    The band is joined by buckets of its width: a pair within it lies in the same or the next bucket."""
    s, c, debits = sides(settlements, bank_rows)
    width = TOLERANCE + 1
    spread = s.withColumn("bucket", F.explode(F.array(*(F.floor(F.col("net") / width) + k for k in (-1, 0, 1)))))
    met = c.withColumn("bucket", F.floor(F.col("amount") / width)).join(spread, ["world_id", "bucket"])
    met = met.withColumn("rank_1", F.abs(F.col("amount") - F.col("net"))).filter((F.col("rank_1") <= TOLERANCE) & (F.abs(F.datediff("value_date", "settled")) <= DAYS))
    pairs = served(met.select("world_id", "tid", "c_no", "sid", "net", "amount", "rank_1", F.col("s_no").alias("rank_2")), store)
    pairs = store.cut(pairs, "naive")
    hit = decision(pairs, "match", "matched", F.array("sid"), F.array("tid"), rules("amount_within_rs1_and_3_days"), "naive", "medium", F.col("net"), F.col("amount"), F.col("amount") - F.col("net"))
    return reduce(DataFrame.unionByName, [hit, *left_over(s, c, debits, pairs, "naive")]).select(COLUMNS)


def reference_then_amount(settlements: DataFrame, bank_rows: DataFrame, store: Store, refs: DataFrame | None = None) -> DataFrame:
    """A reference in the credit's text first, whatever the amount; then an equal amount within ten days, earliest settlement first.

    ``refs`` are leg A's pairs (see ``leg_a.start``), made here if not given. A text that holds a reference of capitals and digits holds it
    without separators too, so leg A's pairs have all of these, and only other references are looked for again.
    """
    s, c, debits = sides(settlements, bank_rows)
    name = "utr_then_amount"
    refs = start(settlements, bank_rows, store).refs if refs is None else refs
    plain = F.col("utr").rlike("^[A-Z0-9]+$")
    pairs = meets(c.select("world_id", "tid", "text"), "text", s.filter(~plain).select("world_id", "sid", F.upper("utr").alias("needle")), "needle")
    met = pairs.join(c.select("world_id", "tid", "c_no", "amount", "text"), ["world_id", "tid"]).join(s.select("world_id", "sid", "net", "s_no"), ["world_id", "sid"]).filter(F.contains("text", F.col("needle")))
    columns = ["world_id", "tid", "c_no", "sid", "net", "amount", "s_no"]
    met = refs.filter(plain & F.col("worded")).select(columns).unionByName(met.select(columns))
    met = met.select(*columns[:-1], F.col("s_no").alias("rank_1"), F.lit(0).cast("long").alias("rank_2"))
    first = store.cut(served(met, store), "by_reference")
    left_s, left_c = s.join(first.select("world_id", "sid"), ["world_id", "sid"], "left_anti"), c.join(first.select("world_id", "tid"), ["world_id", "tid"], "left_anti")
    met = left_c.join(left_s.withColumn("amount", F.col("net")), ["world_id", "amount"]).filter(X.in_window(F.col("created"), F.col("value_date")))
    met = met.select("world_id", "tid", "c_no", "sid", "net", "amount", F.datediff("created", F.lit("1970-01-01").cast("date")).cast("long").alias("rank_1"), F.col("s_no").alias("rank_2"))
    second = store.cut(served(met, store), "by_amount")
    gap = F.col("amount") - F.col("net")
    exact = decision(first.filter(gap == 0), "match", "matched", F.array("sid"), F.array("tid"), rules("utr_exact"), name, "exact", F.col("net"), F.col("amount"), gap)
    unequal = decision(first.filter(gap != 0), "match", "matched_with_discrepancy", F.array("sid"), F.array("tid"), rules("utr_exact"), name, "needs_review", F.col("net"), F.col("amount"), gap, F.array(F.struct(F.lit("unexplained").alias("label"), gap.alias("amount_paise"))))
    amount = decision(second, "match", "matched", F.array("sid"), F.array("tid"), rules("amount_exact_first_come"), name, "medium", F.col("net"), F.col("amount"), F.lit(0))
    both = first.select("world_id", "sid", "tid").unionByName(second.select("world_id", "sid", "tid"))
    return reduce(DataFrame.unionByName, [exact, unequal, amount, *left_over(s, c, debits, both, name)]).select(COLUMNS)
