"""Queries over the derived reconciliation worlds, each with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import scalars as X
from tallyforge.functions.grammar import money_spans
from tallyforge.operators import audit, baselines, close, explain, grade, graph, journey, leg_a, leg_b, proposals, resolve, search, triage, verify
from tallyforge.plans import feeds, proposal_twins, statements, twins
from tallyforge.sources.world import World, as_of, hard, stamp, world


class Results:
    """What the queries of one folder share: leg A runs once, and so does every step that others read."""

    def __init__(self, spark: SparkSession, sf_dir: str, of: World | None = None):
        self.spark, self.sf_dir, self.world = spark, sf_dir, of or world(spark, sf_dir)
        self.slices: dict[str, Results] = {}
        self.made: dict[str, DataFrame] = {}
        self.begun: leg_a.Start | None = None

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self.made:
            self.made[name] = self.world.store.cut(make(), name)
        return self.made[name]

    def as_of(self, day: str) -> Results:
        """The same over all sources as they stood at the end of a day."""
        if day not in self.slices:
            self.slices[day] = Results(self.spark, self.sf_dir, as_of(self.world, day))
        return self.slices[day]

    def hard(self) -> Results:
        """The same over bank rows that only a search over sums explains."""
        if "hard" not in self.slices:
            self.slices["hard"] = Results(self.spark, self.sf_dir, hard(self.world))
        return self.slices["hard"]

    def solved(self) -> DataFrame:
        return self.once("solved", lambda: proposals.judged(self.open_items()[1], self.explanations(), self.rules(), self.searched()[1]))

    def searched(self) -> tuple[DataFrame, DataFrame]:
        """The proposals that a search finds for the open items, and the items whose search was cut off; searched once."""
        if "explanations" not in self.made:
            found, cut_off = proposals.searched(*self.open_items(), self.world.store)
            self.made["explanations"], self.made["cut_off"] = self.world.store.cut(found, "explanations"), cut_off
        return self.made["explanations"], self.made["cut_off"]

    def explanations(self) -> DataFrame:
        return self.searched()[0]

    def rules(self) -> DataFrame:
        """The rules that the explanations break; told once for the solver, the verdicts and the resolver."""
        if "rules" not in self.made:
            view, _, done = self.open_items()
            self.made["rules"] = proposals.rules(view, self.explanations(), done, self.world.store)
        return self.made["rules"]

    def hard_golden(self) -> DataFrame:
        """The answers for settlements that the hard bank rows imply."""
        df = self.spark.sql(proposal_twins.HARD_GOLDEN.format(golden=twins.GOLDEN.format(settlements="{settlements}")), settlements=self.world.settlements)
        return df.withColumn("counterparties", F.filter(F.split("counterparties", ";"), lambda x: x != ""))

    def golden_b(self) -> DataFrame:
        """The answers that the scenario classes imply for orders and payments."""
        df = self.spark.sql(twins.GOLDEN_B.format(o="{o}", p="{p}"), o=self.world.order_book, p=self.world.payments)
        return df.withColumn("counterparties", F.filter(F.split("counterparties", ";"), lambda x: x != ""))

    def start(self) -> leg_a.Start:
        """Records and references, which leg A and the reference baseline start from; made once."""
        if self.begun is None:
            self.begun = leg_a.start(self.world.settlements, self.world.bank_rows, self.world.store)
        return self.begun

    def leg_a(self) -> DataFrame:
        return self.once("leg_a", lambda: leg_a.reconcile(self.world.settlements, self.world.bank_rows, self.world.store, self.start()))

    def leg_b(self) -> DataFrame:
        return self.once("leg_b", lambda: leg_b.reconcile(self.world.payments, self.world.order_book))

    def journeys(self) -> DataFrame:
        return journey.journeys(self.world.order_book, self.world.payments, self.leg_a(), self.leg_b())

    def dates(self) -> DataFrame:
        return triage.close_dates(self.world.bank_rows)

    def due(self) -> DataFrame:
        w = self.world
        return self.once("due", lambda: verify.due_items(self.leg_a(), self.leg_b(), verify.amounts_of(w.settlements, w.bank_rows, w.order_book, w.payments)))

    def overdue(self) -> DataFrame:
        return triage.overdue(self.world.settlements, self.leg_a(), self.dates())

    def queue(self) -> DataFrame:
        return self.once("queue", lambda: triage.queue(triage.items_from_leg_a(self.leg_a(), self.overdue()), triage.items_from_leg_b(self.leg_b(), self.world.order_book, self.world.payments)))

    def actions(self) -> DataFrame:
        """A log of operators' actions made from ``events``: each names an unpaid order's item."""
        e = self.spark.read.parquet(f"{self.sf_dir}/events.parquet")
        order = F.concat(F.lit("order_"), F.lpad((F.floor(F.col("event_id") / 13) * 20 + 3).cast("string"), 14, "0"))
        action = F.when(F.col("event_type") == "purchase", "resolve").when(F.col("event_type") == "click", "assign").when(F.col("event_type") == "error", "snooze").otherwise("note")
        log = e.select(X.item_id(F.lit("recon_leg_b"), F.array(order)).alias("item_id"), F.col("event_id").alias("seq"), action.alias("action"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("by"), F.concat(F.lit("note "), F.col("event_id").cast("string")).alias("note"))
        log = log.join(self.queue().select("item_id", "status"), "item_id")
        return log.withColumn("status_at_action", F.when(F.col("seq") % 5 == 0, "stale").otherwise(F.col("status"))).drop("status")

    def golden(self) -> DataFrame:
        """The answers that the scenario classes imply, for settlements."""
        df = self.spark.sql(twins.GOLDEN.format(settlements="{settlements}"), settlements=self.world.settlements)
        return df.withColumn("counterparties", F.filter(F.split("counterparties", ";"), lambda x: x != ""))

    def golden_queue(self) -> DataFrame:
        """What the scenario classes imply for the queue: settlements, credits, orders and payments with the money at stake."""
        w = self.world
        return self.spark.sql(twins.GOLDEN_QUEUE.format(s="{s}", b="{b}", o="{o}", p="{p}"), s=w.settlements, b=w.bank_rows, o=w.order_book, p=w.payments)

    def naive_queue(self) -> DataFrame:
        """The same queue over the naive matcher, without overdue settlements."""
        w = self.world
        return triage.queue(triage.items_from_leg_a(self.naive(), self.spark.createDataFrame([], triage.LATE)), triage.items_from_leg_b(self.leg_b(), w.order_book, w.payments))

    def claimed(self) -> DataFrame:
        return self.leg_a().filter("kind = 'match' AND confidence <> 'needs_review'").select("world_id", F.explode(F.concat("settlement_ids", "bank_txn_ids")).alias("record_id"))

    def questions(self, part: str) -> DataFrame:
        return self.spark.sql(twins.QUESTIONS[part], dates=self.dates())

    def graded(self, name: str) -> DataFrame:
        made = {"engine": self.leg_a, "naive": self.naive, "reference": self.reference_baseline}[name]
        return self.once(f"graded_{name}", lambda: grade.graded(self.golden(), made()))

    def naive(self) -> DataFrame:
        return self.once("naive", lambda: baselines.naive(self.world.settlements, self.world.bank_rows, self.world.store))

    def reference_baseline(self) -> DataFrame:
        return self.once("by_reference", lambda: baselines.reference_then_amount(self.world.settlements, self.world.bank_rows, self.world.store, self.start().refs))

    def open_items(self) -> tuple[proposals.View, DataFrame, DataFrame]:
        """What the matcher left to people: items of settlements and credits, and the records that it has claimed."""
        view = proposals.View(self.world.settlements, self.world.bank_rows)
        return view, self.once("open_items", lambda: triage.open_items(self.leg_a())), self.claimed()

    def damaged(self) -> DataFrame:
        return damaged_decisions(self.leg_a())

    def statements(self) -> statements.Statements:
        if "statements" not in self.made:
            self.made["statements"] = statements.Statements(self.world.bank_rows, self.world.store)
        return self.made["statements"]

    def overlay(self) -> DataFrame:
        return close.overlay(self.queue(), close.fold_actions(self.actions()))


_results: dict[tuple, Results] = {}


def results(spark: SparkSession, sf_dir: str) -> Results:
    key = (spark.sparkContext.applicationId, sf_dir, stamp(spark, f"{sf_dir}/orders.parquet"), stamp(spark, f"{sf_dir}/events.parquet"))
    if key not in _results:
        _results[key] = Results(spark, sf_dir)
    return _results[key]


def flat_decisions(d: DataFrame) -> DataFrame:
    label = F.coalesce(F.get("discrepancy_breakdown", F.lit(0))["label"], F.lit(""))
    ids = F.array_join(F.transform("candidates", lambda x: x["record_id"]), ";")
    return d.select("world_id", "kind", "status", F.array_join("settlement_ids", ";").alias("settlement_ids"), F.array_join("bank_txn_ids", ";").alias("bank_txn_ids"), "confidence", "expected_paise", "received_paise", "discrepancy_paise", label.alias("label"), F.array_join("rules", ",").alias("rules"), ids.alias("candidates"), "pass_name")


FLAT = "world_id, kind, status, array_to_string(sids, ';') AS settlement_ids, array_to_string(tids, ';') AS bank_txn_ids, confidence, expected_paise, received_paise, discrepancy_paise, label, rules, candidates, pass_name"


def flat_queue(q: DataFrame) -> DataFrame:
    return q.select("world_id", "source", "status", "severity", "money_at_risk_paise", F.array_join("record_ids", ";").alias("record_ids"), "due_date", "days_overdue", "item_id")


def damaged_decisions(d: DataFrame) -> DataFrame:
    """Decisions with one fault each in a share of them, by the number of their first record."""
    h = F.when(F.col("kind") == "match", F.substring(F.get("settlement_ids", F.lit(0)), -6, 6).cast("int") % 40).otherwise(F.lit(-1))
    bare = (F.col("status") == "duplicate_credit") & (F.substring(F.get("bank_txn_ids", F.lit(0)), -6, 6).cast("int") % 3 == 0)
    off = lambda c, k, n: (F.col(c) + F.when(F.col("h") == k, n).otherwise(0)).alias(c)
    d = d.withColumn("h", h).filter("h <> 3")
    return d.withColumns({
        "settlement_ids": F.when(F.col("h") == 6, F.array(F.lit("setl_unknown"))).otherwise(F.col("settlement_ids")),
        "confidence": F.when(F.col("h") == 4, "sure").otherwise(F.col("confidence")),
        "expected_paise": off("expected_paise", 0, 1), "received_paise": off("received_paise", 1, -1), "discrepancy_paise": off("discrepancy_paise", 2, 5),
        "rules": F.when(F.col("h") == 5, F.array().cast("array<string>")).otherwise(F.col("rules")),
        "candidates": F.when(bare, F.array().cast(leg_a.CANDIDATE)).otherwise(F.col("candidates")),
        "bank_txn_ids": F.when(F.col("h") == 7, F.concat("bank_txn_ids", "bank_txn_ids")).otherwise(F.col("bank_txn_ids")),
    }).drop("h")


def damaged_queue(q: DataFrame) -> DataFrame:
    """A queue with one fault each in a share of its items, by their ids."""
    q = q.withColumn("h", F.conv(F.substring("item_id", 1, 2), 16, 10).cast("int")).filter("h <> 0")
    q = q.withColumns({
        "severity": F.col("severity") + F.when(F.col("h") == 1, 1).otherwise(0), "record_ids": F.when(F.col("h") == 4, F.concat("record_ids", F.array(F.lit("zzz")))).otherwise(F.col("record_ids")),
        "money_at_risk_paise": F.when(F.col("h") == 3, F.floor(F.col("money_at_risk_paise") / 2)).otherwise(F.col("money_at_risk_paise")),
    })
    return q.unionByName(q.filter("h = 2")).drop("h")


def placed_queue(q: DataFrame) -> DataFrame:
    """A queue as shown, each world's items numbered, with every 50th item moved down three places."""
    keys = ["severity", F.desc("money_at_risk_paise"), "source", "status", F.get("record_ids", F.lit(0))]
    place = F.row_number().over(Window.partitionBy("world_id").orderBy(*keys))
    return q.withColumn("place", place * 10 + F.when(place % 50 == 0, 35).otherwise(0))


QUEUE = "world_id, source, status, severity, money_at_risk_paise::BIGINT AS money_at_risk_paise, array_to_string(ids, ';') AS record_ids, due_date, days_overdue, item_id"

Query = tuple[Callable[[Results], DataFrame], str]


def _world() -> dict[str, Query]:
    plain = lambda name: (lambda r: getattr(r.world, name))
    return {
        "world_order_book": (plain("order_book"), "SELECT * FROM order_book"),
        "world_payments": (plain("payments"), "SELECT * EXCLUDE (k) FROM payments"),
        "world_settlements": (plain("settlements"), "SELECT * FROM settlements"),
        "world_bank_rows": (plain("bank_rows"), "SELECT * FROM bank_rows"),
        "scenario_counts": (lambda r: r.world.settlements.groupBy((F.col("row_no") % 24).alias("scenario")).agg(F.count("*").alias("n")), "SELECT row_no % 24 AS scenario, count(*) AS n FROM settlements GROUP BY ALL"),
    }


def _scalars() -> dict[str, Query]:
    def money(r: Results) -> DataFrame:
        text = X.rupees(F.col("amount_paise"))
        return r.world.order_book.select("order_id", text.alias("rupees"), X.paise(text).alias("back"), X.gst_on_fee(F.col("amount_paise")).alias("gst"), X.optional_paise(F.when(F.col("status") == "paid", text)).alias("paid"))

    def dates(r: Results) -> DataFrame:
        text = F.date_format("created", "dd/MM/yyyy")
        return r.world.settlements.select("settlement_id", text.alias("shown"), X.bank_date(text).alias("back"), X.roll_off_sunday(F.col("created")).alias("rolled"), X.epoch_text(F.col("row_no") * 86400).alias("epoch"), X.iso_date(F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss")).alias("iso"))

    def references(r: Results) -> DataFrame:
        texts = (F.col("narration"), F.col("ref_no"))
        found = X.tokens(*texts)
        return r.world.bank_rows.select("txn_id", F.array_join(F.array_sort(found), ";").alias("tokens"), X.full_strip(*texts).alias("strip"), X.shaped(found, *texts).alias("shaped"), F.array_join(F.array_sort(X.grams(X.full_strip(*texts), 16)), ";").alias("grams"))

    def near(r: Results) -> DataFrame:
        s = r.world.settlements
        other = F.concat(F.substring("utr", 1, 15), F.lit("7"))
        return s.select("settlement_id", X.near_utr(other, F.col("utr")).alias("near"), X.fragment_of(F.substring("utr", 4, 11), F.col("utr")).alias("fragment"), X.is_utr_shaped(F.col("utr")).alias("shaped"), F.levenshtein(F.reverse("utr"), F.col("utr")).alias("distance"), X.decompose(F.col("amount_paise"), F.col("amount_paise") - F.when(F.col("row_no") % 2 == 0, 2950).otherwise(X.one_percent(F.col("amount_paise")))).alias("why"))

    def cells(r: Results) -> DataFrame:
        text = F.concat(X.rupees(F.col("amount_paise")), F.when(F.col("row_no") % 3 == 0, " Cr").when(F.col("row_no") % 3 == 1, " Dr").otherwise(""))
        cell = X.amount_cell(F.when(F.col("row_no") % 7 == 0, "INT").otherwise(text))
        return r.world.order_book.select("order_id", cell["paise"].alias("paise"), cell["side"].alias("side"))

    def signatures(r: Results) -> DataFrame:
        return r.world.order_book.select("order_id", F.sha2(F.col("order_id").cast("binary"), 256).alias("digest"), X.item_id(F.lit("recon_leg_b"), F.array("order_id", "receipt")).alias("item_id"))

    lakh = "(SELECT CASE WHEN length(w) <= 3 THEN w ELSE array_to_string(list_reverse(list_transform(range(0, (length(w) - 2) // 2), lambda i: reverse(substr(reverse(w), 4 + 2 * i, 2)))), ',') || ',' || right(w, 3) END FROM (SELECT (amount_paise // 100)::VARCHAR AS w))"
    rupees = f"{lakh} || '.' || lpad((amount_paise % 100)::VARCHAR, 2, '0')"
    return {
        "scalar_money": (money, f"SELECT order_id, {rupees} AS rupees, amount_paise AS back, (amount_paise * 18 + 50) // 100 AS gst, CASE WHEN status = 'paid' THEN amount_paise ELSE 0 END AS paid FROM order_book"),
        "scalar_dates": (dates, "SELECT settlement_id, strftime(created, '%d/%m/%Y') AS shown, created AS back, CASE WHEN isodow(created) = 7 THEN created + 1 ELSE created END AS rolled, strftime(make_timestamp(row_no * 86400 * 1000000), '%Y-%m-%dT%H:%M:%S') AS epoch, created AS iso FROM settlements"),
        "scalar_references": (references, """SELECT b.txn_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_concat(regexp_extract_all(upper(narration), '[A-Z0-9]+'), regexp_extract_all(upper(ref_no), '[A-Z0-9]+')), lambda x: length(x) >= 10))), ';'), '') AS tokens,
  regexp_replace(upper(concat(narration, ref_no)), '[^A-Z0-9]', '', 'g') AS strip, regexp_matches(upper(concat(narration, ' ', ref_no)), 'RAZORPAY|RZPAY|RZP') OR regexp_matches(upper(concat(narration, ' ', ref_no)), '(^|[^A-Z0-9])[A-Z]{4}[0-9]{12}($|[^A-Z0-9])') AS shaped,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(range(1, length(regexp_replace(upper(concat(narration, ref_no)), '[^A-Z0-9]', '', 'g')) - 14), lambda i: substr(regexp_replace(upper(concat(narration, ref_no)), '[^A-Z0-9]', '', 'g'), i, 16)))), ';'), '') AS grams FROM bank_rows b"""),
        "scalar_near_references": (near, """SELECT settlement_id, hamming(substr(utr, 1, 15) || '7', utr) <= 1 AS near, contains(utr, substr(utr, 4, 11)) AS fragment, regexp_full_match(utr, '[A-Z]{4}[0-9]{12}') AS shaped, levenshtein(reverse(utr), utr)::INTEGER AS distance,
  CASE WHEN row_no % 2 = 0 OR (amount_paise + 50) // 100 = 2950 THEN 'bank_charge' ELSE 'commission' END AS why FROM settlements"""),
        "scalar_amount_cells": (cells, "SELECT order_id, CASE WHEN row_no % 7 <> 0 THEN amount_paise END AS paise, CASE WHEN row_no % 7 = 0 THEN NULL WHEN row_no % 3 = 0 THEN 'CR' WHEN row_no % 3 = 1 THEN 'DR' END AS side FROM order_book"),
        "scalar_digests": (signatures, "SELECT order_id, sha256(order_id) AS digest, substr(sha1('recon_leg_b|' || order_id || '|' || receipt), 1, 12) AS item_id FROM order_book"),
    }


def _leg_a() -> dict[str, Query]:
    def one(name: str) -> Query:
        return (lambda r: flat_decisions(r.leg_a().filter(F.col("pass_name") == name))), f"SELECT {FLAT} FROM leg_a WHERE pass_name = '{name}'"

    def outside(r: Results) -> DataFrame:
        """Decisions about debits, which depend on no pass, so that leg A need not run for them."""
        return flat_decisions(leg_a.outside(leg_a.prepare(r.world.settlements, r.world.bank_rows)[2]))

    def references(r: Results) -> DataFrame:
        s, c, _ = leg_a.prepare(r.world.settlements, r.world.bank_rows)
        return leg_a.references(s, c).select("world_id", "sid", "tid", "net", "amount")

    def fuzzy(r: Results) -> DataFrame:
        s, c, _ = leg_a.prepare(r.world.settlements, r.world.bank_rows)
        met = s.join(c.filter("shaped").withColumnRenamed("amount", "net"), ["world_id", "net"])
        return met.filter(leg_a.fuzzy(F.col("found"), F.col("utr"))).select("world_id", "sid", "tid")

    def degrees(r: Results) -> DataFrame:
        s, c, _ = leg_a.prepare(r.world.settlements, r.world.bank_rows)
        met = s.join(c.filter("shaped").withColumnRenamed("amount", "net"), ["world_id", "net"]).filter(X.in_window(F.col("created"), F.col("value_date")))
        return met.groupBy("world_id", "sid").agg(F.count("*").alias("n"))

    def residual(r: Results) -> DataFrame:
        s, c, _ = leg_a.prepare(r.world.settlements, r.world.bank_rows)
        own = leg_a.references(s, c).filter("amount > net").select("world_id", "tid", "sid", (F.col("amount") - F.col("net")).alias("net"), "value_date")
        other = s.select("world_id", F.col("sid").alias("partner"), "net", F.col("created").alias("since"))
        return own.join(other, ["world_id", "net"]).filter((F.col("sid") != F.col("partner")) & X.in_window(F.col("since"), F.col("value_date"), 13)).select("world_id", "tid", "sid", "partner")

    return {
        "leg_a": (lambda r: flat_decisions(r.leg_a()), f"SELECT {FLAT} FROM leg_a"),
        "leg_a_pass1_exact_reference": one("pass1_exact_utr"),
        "leg_a_pass2_damaged_reference": one("pass2_fuzzy_utr"),
        "leg_a_pass3_merged": one("pass3_merge"),
        "leg_a_pass4_unique_amount": one("pass4_amount_unique"),
        "leg_a_pass5_residuals": one("pass5_residuals"),
        "leg_a_out_of_scope": (outside, one("pass0_scope")[1]),
        "leg_a_status_counts": (lambda r: close.counted(r.leg_a(), "pass_name", "kind", "status", "confidence"), "SELECT pass_name, kind, status, confidence, count(*) AS n FROM leg_a GROUP BY ALL"),
        "join_reference_containment": (references, "SELECT world_id, sid, tid, net, amount FROM refs"),
        "join_damaged_reference": (fuzzy, """SELECT s.world_id, s.sid, c.tid FROM s JOIN c ON s.world_id = c.world_id AND s.net = c.amount AND c.shaped
  WHERE len(list_filter(c.found, lambda t: t <> s.utr AND (contains(s.utr, t) OR (regexp_full_match(t, '[A-Z]{4}[0-9]{12}') AND length(t) = length(s.utr) AND levenshtein(t, s.utr) <= 1)))) > 0"""),
        "join_amount_window_degrees": (degrees, "SELECT s.world_id, s.sid, count(*) AS n FROM s JOIN c ON s.world_id = c.world_id AND s.net = c.amount AND c.shaped AND c.value_date - s.created BETWEEN 0 AND 10 GROUP BY ALL"),
        "join_residual": (residual, "SELECT r.world_id, r.tid, r.sid, x.sid AS partner FROM refs r JOIN s x ON r.world_id = x.world_id AND r.amount - r.net = x.net AND x.sid <> r.sid AND r.value_date - x.created BETWEEN 0 AND 13 WHERE r.amount > r.net"),
        "confidence_counts": (lambda r: r.leg_a().groupBy("confidence").agg(F.count("*").alias("n"), F.sum("received_paise").alias("received_paise")), "SELECT confidence, count(*) AS n, sum(received_paise)::BIGINT AS received_paise FROM leg_a GROUP BY ALL"),
        "leg_a_summary": (lambda r: close.leg_a_summary(r.leg_a()), f"SELECT world_id, count(*) FILTER (status NOT IN ('out_of_scope', 'non_settlement_credit')) AS in_scope, count(*) FILTER (status IN {twins.FAMILY}) AS matched, coalesce(sum(received_paise) FILTER (status IN {twins.FAMILY}), 0)::BIGINT AS matched_paise, count(*) FILTER (confidence = 'needs_review') AS needs_review, count(*) FILTER (kind = 'exception') AS exceptions FROM leg_a GROUP BY ALL"),
        "overview": (lambda r: close.overview(r.leg_a()), f"SELECT world_id, coalesce(sum(received_paise) FILTER (status IN {twins.FAMILY}), 0)::BIGINT AS reconciled_paise, coalesce(sum(coalesce(nullif(expected_paise, 0), received_paise, 0)) FILTER (kind = 'exception' AND status <> 'non_settlement_credit'), 0)::BIGINT AS exception_paise FROM leg_a GROUP BY ALL"),
        "verify_leg_a": (lambda r: verify.leg_a(r.world.settlements, r.world.bank_rows, r.leg_a()), twins.broken_decisions("leg_a")),
        "verify_leg_a_damaged": (lambda r: verify.leg_a(r.world.settlements, r.world.bank_rows, damaged_decisions(r.leg_a())), twins.broken_decisions("dd")),
    }


def _leg_b() -> dict[str, Query]:
    def flat(r: Results) -> DataFrame:
        return r.leg_b().select("world_id", "record_type", "record_id", "status", F.array_join("counterparty_ids", ";").alias("counterparty_ids"), F.array_join("candidates", ";").alias("candidates"))

    def first(r: Results) -> DataFrame:
        return r.world.payments.filter("status = 'captured'").groupBy("world_id", "order_id").agg(F.min_by("payment_id", F.struct("created_s", "payment_id")).alias("first"), F.count("*").alias("n"))

    return {
        "leg_b": (flat, "SELECT world_id, record_type, record_id, status, other AS counterparty_ids, candidates FROM leg_b"),
        "leg_b_counts": (lambda r: close.counted(r.leg_b(), "record_type", "status"), "SELECT record_type, status, count(*) AS n FROM leg_b GROUP BY ALL"),
        "first_captures": (first, "SELECT world_id, order_id, min_by(payment_id, (created_s, payment_id)) AS first, count(*) AS n FROM payments WHERE status = 'captured' GROUP BY ALL"),
        "journeys": (lambda r: r.journeys(), "SELECT * FROM journeys"),
        "journey_breaks": (lambda r: close.counted(r.journeys(), "world_id", "first_break", money="order_amount_paise"), "SELECT world_id, first_break, count(*) AS n, sum(order_amount_paise)::BIGINT AS total_paise FROM journeys GROUP BY ALL"),
        "payments_per_status": (lambda r: close.counted(r.world.payments, "world_id", "status", money="amount_paise"), "SELECT world_id, status, count(*) AS n, sum(amount_paise)::BIGINT AS total_paise FROM payments GROUP BY ALL"),
        "net_per_month": (lambda r: r.world.settlements.groupBy(F.trunc("created", "month").alias("month")).agg(F.sum("amount_paise").alias("net_paise"), F.sum("fees_paise").alias("fees_paise"), F.sum("tax_paise").alias("tax_paise")), "SELECT date_trunc('month', created)::DATE AS month, sum(amount_paise)::BIGINT AS net_paise, sum(fees_paise)::BIGINT AS fees_paise, sum(tax_paise)::BIGINT AS tax_paise FROM settlements GROUP BY ALL"),
    }


def _close() -> dict[str, Query]:
    def top(r: Results) -> DataFrame:
        return flat_queue(triage.ordered(r.queue()).limit(25))

    def before(r: Results) -> DataFrame:
        snap = close.snapshot(r.queue(), r.dates())
        earlier = snap.filter(F.conv(F.substring("item_id", 1, 2), 16, 10).cast("int") % 3 != 0).withColumn("money_at_risk_paise", F.col("money_at_risk_paise") + F.col("severity"))
        return close.delta(earlier, snap.filter(F.conv(F.substring("item_id", 1, 2), 16, 10).cast("int") % 5 != 0))

    def balanced(r: Results) -> DataFrame:
        return verify.running_balance(r.world.bank_rows).select("world_id", "txn_id", "balance_paise")

    def broken(r: Results) -> DataFrame:
        rows = verify.running_balance(r.world.bank_rows).withColumn("balance_paise", F.col("balance_paise") + F.when(F.col("row_no") % 97 == 0, 1).otherwise(0))
        return verify.balances(rows)

    def sliced(r: Results) -> DataFrame:
        day = F.lit("2025-04-15").cast("date")
        return close.cash(close.as_of(r.world.bank_rows, "value_date", day))

    snap = f"SELECT q.world_id, d.close_date, q.item_id, q.severity, q.status, q.source, {twins.title('q.status')} AS title, q.money_at_risk_paise FROM queue q JOIN dates d ON q.world_id = d.world_id"
    cash = "SELECT world_id, count(*) AS n_rows, sum(credit_paise - debit_paise)::BIGINT AS movement_paise, min(value_date) AS first_date, max(value_date) AS close_date, (max(value_date) - min(value_date))::INTEGER AS span_days, max_by(txn_id, row_no) AS last_txn FROM bank_rows"
    bits = "('0x' || substr(item_id, 1, 2))::INTEGER"
    return {
        "overdue": (lambda r: r.overdue(), "SELECT world_id, settlement_id, amount_paise, expected_date, (close_date - expected_date)::INTEGER AS days_overdue FROM overdue"),
        "queue": (lambda r: flat_queue(r.queue()), f"SELECT {QUEUE} FROM queue"),
        "queue_leg_a_items": (lambda r: flat_queue(r.queue().filter("source = 'recon_leg_a'")), f"SELECT {QUEUE} FROM queue WHERE source = 'recon_leg_a'"),
        "queue_leg_b_items": (lambda r: flat_queue(r.queue().filter("source = 'recon_leg_b'")), f"SELECT {QUEUE} FROM queue WHERE source = 'recon_leg_b'"),
        "queue_top": (top, f"SELECT {QUEUE} FROM queue ORDER BY severity, money_at_risk_paise DESC, source, status, ids[1] LIMIT 25"),
        "queue_by_status": (lambda r: close.counted(r.queue(), "severity", "status", "source", money="money_at_risk_paise"), "SELECT severity, status, source, count(*) AS n, sum(money_at_risk_paise)::BIGINT AS total_paise FROM queue GROUP BY ALL"),
        "queue_rollup": (lambda r: close.rollup(r.queue()), "SELECT world_id, count(*) AS n_items, min(severity) AS worst, sum(money_at_risk_paise)::BIGINT AS money_at_risk_paise, count(days_overdue) AS n_overdue FROM queue GROUP BY ALL"),
        "cash": (lambda r: close.cash(r.world.bank_rows), f"{cash} GROUP BY ALL"),
        "cash_as_of": (sliced, f"{cash} WHERE value_date <= DATE '2025-04-15' GROUP BY ALL"),
        "running_balance": (balanced, "SELECT world_id, txn_id, (10000000 + sum(credit_paise - debit_paise) OVER (PARTITION BY world_id ORDER BY row_no))::BIGINT AS balance_paise FROM bank_rows"),
        "balance_breaks": (broken, """SELECT world_id, 'balance_break' AS code, txn_id AS record FROM (SELECT *, lag(balance) OVER w AS last, coalesce(value_date - lag(value_date) OVER w, 0) AS gap FROM (SELECT *, 10000000 + sum(credit_paise - debit_paise) OVER (PARTITION BY world_id ORDER BY row_no) + CASE WHEN row_no % 97 = 0 THEN 1 ELSE 0 END AS balance FROM bank_rows)
  WINDOW w AS (PARTITION BY world_id ORDER BY row_no)) WHERE last + credit_paise - debit_paise <> balance AND gap <= 7"""),
        "actions_folded": (lambda r: close.fold_actions(r.actions()), "SELECT item_id, last_action, assignee, last_note, seen_status, n_actions FROM folded"),
        "queue_overlay": (lambda r: r.overlay().select("world_id", "item_id", "status", "workflow", "assignee", "last_note", "reopened"), "SELECT world_id, item_id, status, workflow, assignee, last_note, reopened FROM overlaid"),
        "queue_open_items": (lambda r: close.counted(r.overlay().filter("workflow <> 'resolved'"), "severity", "workflow", money="money_at_risk_paise"), "SELECT severity, workflow, count(*) AS n, sum(money_at_risk_paise)::BIGINT AS total_paise FROM overlaid WHERE workflow <> 'resolved' GROUP BY ALL"),
        "snapshot": (lambda r: close.snapshot(r.queue(), r.dates()), snap.replace("q.money_at_risk_paise FROM", "q.money_at_risk_paise::BIGINT AS money_at_risk_paise FROM")),
        "snapshot_delta": (before, f"""SELECT coalesce(b.world_id, n.world_id) AS world_id, coalesce(b.item_id, n.item_id) AS item_id, b.status AS status_before, b.money AS money_before, n.status AS status_now, n.money AS money_now,
  CASE WHEN b.item_id IS NULL THEN 'new' WHEN n.item_id IS NULL THEN 'gone' ELSE 'carried' END AS change
  FROM (SELECT world_id, item_id, status, (money_at_risk_paise + severity)::BIGINT AS money FROM queue WHERE {bits} % 3 <> 0) b FULL OUTER JOIN (SELECT world_id, item_id, status, money_at_risk_paise::BIGINT AS money FROM queue WHERE {bits} % 5 <> 0) n ON b.item_id = n.item_id AND b.world_id = n.world_id"""),
        "verify_queue": (lambda r: verify.queue(r.queue(), r.due()), twins.broken_queue("queue")),
        "verify_queue_damaged": (lambda r: verify.queue(damaged_queue(r.queue()), r.due()), twins.broken_queue("qd")),
        "verify_queue_order": (lambda r: verify.order(placed_queue(r.queue())), twins.QUEUE_ORDER),
    }


def graded_sql(decisions: str) -> str:
    """Golden rows with what the named decisions make of them."""
    return f"""SELECT g.*, coalesce(a.status, 'unreported') AS got, coalesce(a.status = g.expected AND CASE WHEN g.expected IN {twins.FAMILY} THEN array_to_string(list_sort(a.tids), ';') = g.counterparties
WHEN g.expected = 'ambiguous_abstain' THEN contains(';' || a.candidates || ';', ';' || g.counterparties || ';') ELSE true END, false) AS correct,
coalesce(a.status IN {twins.FAMILY}, false) AS is_match, coalesce(a.status IN {twins.FAMILY} AND a.confidence IN ('exact', 'high', 'medium'), false) AS auto
FROM ({twins.GOLDEN.format(settlements="settlements")}) g LEFT JOIN (SELECT sid, status, tids, candidates, confidence FROM (SELECT unnest(sids) AS sid, status, tids, candidates, confidence, pass_name FROM {decisions})
QUALIFY row_number() OVER (PARTITION BY sid ORDER BY pass_name, status) = 1) a ON g.record_id = a.sid"""


def _evaluation() -> dict[str, Query]:
    graded = graded_sql("leg_a")
    due = f"expected IN {twins.FAMILY}"
    counts = f"""count(*) AS n_rows, count(*) FILTER ({due}) AS matchable, count(*) FILTER ({due} AND correct) AS tp, count(*) FILTER (is_match AND NOT ({due} AND correct)) AS fp, count(*) FILTER ({due} AND NOT correct) AS fn,
  count(*) FILTER (correct) AS n_correct, count(*) FILTER (expected = 'ambiguous_abstain') AS ambiguous, count(*) FILTER (expected = 'ambiguous_abstain' AND correct) AS abstained, count(*) FILTER (auto) AS auto_resolved"""

    def scenario(r: Results) -> DataFrame:
        return grade.summary(r.graded("engine"), "scenario")

    def baseline(name: str, decisions: str) -> Query:
        return (lambda r: grade.summary(r.graded(name), "scenario")), f"SELECT scenario, {counts} FROM ({graded_sql(decisions)}) GROUP BY ALL"

    def linked(r: Results) -> DataFrame:
        d = r.leg_a()
        edges = d.select(F.explode("settlement_ids").alias("a"), "bank_txn_ids", "candidates").select("a", F.explode(F.concat("bank_txn_ids", F.transform("candidates", lambda x: x["record_id"]))).alias("b")).filter("b <> ''")
        return graph.components(edges, r.world.store)

    def solved(r: Results) -> DataFrame:
        return r.solved().withColumns({c: F.array_join(c, ";") for c in ("settlement_ids", "bank_row_ids")})

    def checked(r: Results) -> DataFrame:
        return proposals.verdicts(r.explanations(), r.rules())

    def resolved(r: Results) -> DataFrame:
        """Items in order, what became of them, and of those proposed whether the rules accept and the labels contradict them."""
        view, items, _ = r.open_items()
        told = r.once("outcomes", lambda: resolve.outcomes(resolve.placed(view, items), r.solved(), r.world.store))
        asked = r.solved().join(told.filter("outcome = 'proposed'"), ["world_id", "item_id"])
        asked = asked.join(items, ["world_id", "item_id"]).select("world_id", F.col("item_id").alias("proposal_id"), "item_id", "verdict", "settlement_ids", "bank_row_ids", "deduction_paise", "record_ids")
        same = ["world_id", "item_id", "settlement_ids", "bank_row_ids", "deduction_paise"]
        asked = r.once("asked", lambda: asked.join(r.explanations().select(*same, F.col("proposal_id").alias("known")), same))
        codes = r.rules().select("world_id", F.col("proposal_id").alias("known"), "code").join(asked.select("world_id", "known", "proposal_id"), ["world_id", "known"])
        verdicts = proposals.verdicts(asked, codes.select("world_id", "proposal_id", "code")).select("world_id", F.col("proposal_id").alias("item_id"), "accepted", "codes")
        wrong = audit.wrong_proposals(r.hard_golden(), asked)
        measure = r.explanations().groupBy("world_id", "item_id").agg(F.count("*").alias("measure"))
        key = ["world_id", "item_id"]
        return told.join(verdicts, key, "left").join(wrong, key, "left").join(measure, key, "left").fillna(0, ["measure"])

    in_order = proposal_twins.resolved(twins.GOLDEN.format(settlements="settlements"))
    in_hard = lambda make: (lambda r: make(r.hard()))

    def reordered(r: Results) -> DataFrame:
        """The engine's answers with those of the proposals that the rules accept, over hard bank rows."""
        accepted = resolved(r).filter("accepted").join(r.solved(), ["world_id", "item_id"])
        return audit.boxes({"engine": audit.state(r.leg_a()), "engine_resolver": audit.with_proposals(audit.state(r.leg_a()), accepted)}, r.hard_golden())

    def figures(r: Results) -> DataFrame:
        text = F.concat(F.lit("paid Rs."), X.rupees(F.col("amount_paise")), F.lit("/- fee 5% on 12/05/2025 ref A"), F.col("order_id"))
        return r.world.order_book.select("order_id", F.array_join(F.transform(money_spans(text), lambda x: x["paise"].cast("string")), ";").alias("figures"))

    edges = """SELECT x.a, y.b FROM (SELECT unnest(sids) AS a, list_concat(tids, string_split(candidates, ';')) AS bs FROM leg_a) x, LATERAL (SELECT unnest(x.bs) AS b) y WHERE y.b <> ''"""
    return {
        "golden": (lambda r: r.golden().withColumn("counterparties", F.array_join("counterparties", ";")), twins.GOLDEN.format(settlements="settlements")),
        "grade_leg_a": (lambda r: grade.summary(r.graded("engine")), f"SELECT {counts} FROM ({graded})"),
        "grade_leg_a_by_scenario": (scenario, f"SELECT scenario, {counts} FROM ({graded}) GROUP BY ALL"),
        "grade_scenario_and_exception_sets": (lambda r: grade.scenario_table(r.graded("engine")), f"SELECT 'scenario' AS kind, scenario AS name, count(*) AS n, count(*) FILTER (correct) AS n_correct FROM ({graded}) GROUP BY ALL UNION ALL SELECT 'exception', expected, count(*), count(*) FILTER (correct) FROM ({graded}) WHERE expected NOT IN {twins.FAMILY} GROUP BY ALL"),
        "grade_categories": (lambda r: grade.categories(r.graded("engine")), f"SELECT scenario, count(*) FILTER (auto AND correct) AS auto_correct, count(*) FILTER (auto AND NOT correct) AS auto_wrong, count(*) FILTER (NOT auto AND expected NOT IN {twins.FAMILY}) AS rightly_left, count(*) FILTER (NOT auto AND {due}) AS wrongly_left FROM ({graded}) GROUP BY ALL"),
        "baseline_naive": (lambda r: flat_decisions(r.naive()), f"SELECT {FLAT} FROM naive"),
        "baseline_reference_then_amount": (lambda r: flat_decisions(r.reference_baseline()), f"SELECT {FLAT} FROM by_reference"),
        "grade_baseline_naive": baseline("naive", "naive"),
        "grade_baseline_reference": baseline("reference", "by_reference"),
        "components": (linked, f"WITH RECURSIVE e AS ({edges}), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a AS id, a AS other FROM both_ways UNION SELECT r.id, x.b FROM reach r JOIN both_ways x ON r.other = x.a) SELECT id, min(other) AS component FROM reach GROUP BY ALL"),
        "solver": (solved, proposal_twins.SOLVER),
        "verify_proposals": (checked, proposal_twins.VERIFIED),
        "hard_solver": (in_hard(solved), proposal_twins.SOLVER),
        "hard_verify_proposals": (in_hard(checked), proposal_twins.VERIFIED),
        "hard_resolver": (in_hard(resolved), in_order["items"]),
        "hard_proposal_stats": (in_hard(lambda r: resolve.proposal_stats(resolved(r), r.world.store)), in_order["stats"]),
        "hard_evaluate_resolver": (in_hard(reordered), in_order["boxes"]),
        "money_figures": (figures, "SELECT order_id, amount_paise::VARCHAR AS figures FROM order_book"),
    }


def _search() -> dict[str, Query]:
    """Questions to the records that the matcher left open, and texts for people."""

    def ranged(part: str, rows: Callable[[Results], DataFrame]) -> Callable[[Results], DataFrame]:
        return lambda r: search.ranged(r.questions(part), search.unclaimed(rows(r), r.claimed()))

    def anchored(r: Results) -> DataFrame:
        s, c = search.settlements_of(r.world.settlements), search.credits_of(r.world.bank_rows)
        left = r.leg_a().filter("status = 'exception_missing_bank'").select("world_id", F.get("settlement_ids", F.lit(0)).alias("record_id"))
        items = left.join(s, ["world_id", "record_id"]).select("world_id", F.col("record_id").alias("question"), F.lit("settlement").alias("side"), F.col("day").alias("anchor"))
        return search.item_context(items, search.unclaimed(s, r.claimed()), search.unclaimed(c, r.claimed()))

    def texts(r: Results) -> DataFrame:
        notes = F.array_join(F.filter(F.transform("candidates", lambda x: x["id"]), lambda x: x != ""), ";")
        return r.queue().select("world_id", "item_id", "title", "suggested_action", "detail", F.array_join("evidence", ",").alias("evidence"), notes.alias("candidates"))

    def explained(r: Results) -> DataFrame:
        d = explain.attach(r.leg_a())
        return d.select("world_id", "status", F.array_join("settlement_ids", ";").alias("settlement_ids"), F.array_join("bank_txn_ids", ";").alias("bank_txn_ids"), "explanation")

    def urgent(r: Results) -> DataFrame:
        return flat_queue(triage.ordered(r.queue().filter("severity = 1 AND days_overdue IS NOT NULL")))

    return {
        "search_settlements": (ranged("ranged", lambda r: search.settlements_of(r.world.settlements)), twins.ranged("so")),
        "search_credits": (ranged("ranged", lambda r: search.credits_of(r.world.bank_rows)), twins.ranged("co")),
        "search_narrations": (lambda r: search.looked_up(r.questions("named"), r.world.bank_rows, r.claimed()), twins.LOOKED_UP),
        "search_decisions": (lambda r: search.mentions(r.questions("needles"), r.leg_a(), r.leg_b()), twins.MENTIONS),
        "search_statement_window": (lambda r: search.statement_window(r.questions("windows"), r.world.bank_rows), twins.WINDOWS),
        "item_context": (anchored, twins.CONTEXT),
        "leg_a_explanations": (explained, f"SELECT world_id, status, array_to_string(sids, ';') AS settlement_ids, array_to_string(tids, ';') AS bank_txn_ids, {twins.explanation()} AS explanation FROM leg_a"),
        "queue_texts": (texts, twins.queue_texts()),
        "queue_urgent": (urgent, f"SELECT {QUEUE} FROM queue WHERE severity = 1 AND days_overdue IS NOT NULL"),
    }


def _audit() -> dict[str, Query]:
    """Queues against labels, and systems against each other."""
    def systems(r: Results) -> dict[str, DataFrame]:
        return {"engine": r.leg_a(), "naive": r.naive(), "reference": r.reference_baseline()}

    def solved(r: Results) -> DataFrame:
        told = r.solved().filter("verdict = 'match'")
        return audit.with_proposals(audit.state(r.leg_a()), audit.apart(told.select("world_id", "settlement_ids", "bank_row_ids")))

    amounts = lambda r: r.world.settlements.select("world_id", F.col("settlement_id").alias("record_id"), "amount_paise")
    rates = lambda name: audit.over_worlds(audit.queue_rates(name), ["queue_recall", "money_recall", "queue_precision"])
    return {
        "golden_queue": (lambda r: r.golden_queue(), twins.GOLDEN_QUEUE.format(s="settlements", b="bank_rows", o="order_book", p="payments")),
        "audit_queue": (lambda r: audit.queue(r.queue(), r.golden_queue()), twins.audited("queue")),
        "audit_naive_queue": (lambda r: audit.queue(r.naive_queue(), r.golden_queue()), twins.audited("nqueue")),
        "audit_queue_missed": (lambda r: audit.missed(r.naive_queue(), r.golden_queue()), twins.missed("nqueue")),
        "audit_rates": (lambda r: rates(audit.queue(r.queue(), r.golden_queue())), twins.over_worlds(f"SELECT *, surfaced / worthy::DOUBLE AS queue_recall, surfaced_paise / stake_paise::DOUBLE AS money_recall, justified / gradable::DOUBLE AS queue_precision FROM ({twins.audited('queue')})", ["queue_recall", "money_recall", "queue_precision"])),
        "benchmark_strategies": (lambda r: audit.strategies({n: r.graded(n) for n in ("engine", "naive", "reference")}), twins.benchmark(graded_sql)),
        "evaluate_systems": (lambda r: audit.compared(systems(r), r.golden()), twins.BOXES),
        "evaluate_with_solver": (lambda r: audit.boxes({"engine_solver": solved(r)}, r.golden()), proposal_twins.evaluated(twins.GOLDEN.format(settlements="settlements"))),
        "hard_evaluate_with_solver": (lambda r: audit.boxes({"engine_solver": solved(r.hard())}, r.hard().hard_golden()), proposal_twins.evaluated(proposal_twins.HARD_GOLDEN.format(golden=twins.GOLDEN.format(settlements="settlements")))),
        "worst_failures": (lambda r: audit.worst(r.golden(), audit.state(r.naive()), amounts(r)), twins.WORST),
        "false_matches_by_tier": (lambda r: audit.false_by_tier(r.golden(), audit.state(r.naive())), "SELECT coalesce(tier, 'none') AS tier, count(*) AS n FROM boxed WHERE system = 'naive' AND box = 'auto_wrong' GROUP BY ALL"),
        "gross_captured_per_month": (lambda r: r.world.payments.filter("status = 'captured'").groupBy(F.date_trunc("month", F.timestamp_seconds("created_s")).cast("date").cast("string").alias("month")).agg(F.sum("amount_paise").alias("gross_paise"), F.count("*").alias("n")), "SELECT date_trunc('month', make_timestamp(created_s * 1000000))::DATE::VARCHAR AS month, sum(amount_paise)::BIGINT AS gross_paise, count(*) AS n FROM payments WHERE status = 'captured' GROUP BY ALL"),
    }


#: The day of the as-of close.
DAY = "2025-04-20"


def _as_of() -> dict[str, Query]:
    """A close as it stood on an earlier day, over all sources, and what a person reads of a close."""
    at = lambda make: (lambda r: make(r.as_of(DAY)))
    accuracy = lambda r: grade.leg_b(r.golden_b(), r.leg_b()).groupBy("scenario").agg(F.count("*").alias("n_rows"), F.count_if("correct").alias("n_correct"))
    parts = lambda r: [("orders", r.world.order_book), ("payments", r.world.payments), ("settlements", r.world.settlements), ("bank_rows", r.world.bank_rows)]

    def records(r: Results) -> DataFrame:
        return reduce(DataFrame.unionByName, [df.groupBy("world_id").agg(F.count("*").alias("n")).withColumn("part", F.lit(name)) for name, df in parts(r)])

    def apart(r: Results) -> DataFrame:
        nets = Window.partitionBy("world_id").orderBy("amount_paise", "settlement_id")
        s = r.world.settlements.withColumn("gap", F.lead("amount_paise").over(nets) - F.col("amount_paise"))
        return s.groupBy("world_id").agg(F.count_if(F.col("gap") <= 100).alias("close_pairs"), F.min("gap").alias("least_gap"))

    def stated(r: Results) -> DataFrame:
        return verify.running_balance(r.world.bank_rows).groupBy("world_id").agg(F.max_by("balance_paise", "row_no").alias("balance_paise"), F.max("value_date").alias("close_date"))

    def checked(r: Results) -> DataFrame:
        faults = verify.queue(damaged_queue(r.queue()), r.due()).groupBy("world_id").agg(F.count("*").alias("violations"))
        return close.rollup(r.queue()).join(faults, "world_id", "left").fillna(0, ["violations"])

    def resolver(r: Results) -> DataFrame:
        left = r.leg_a().filter("status IN ('ambiguous_abstain', 'exception_missing_bank', 'exception_missing_settlement')")
        side = F.when(F.size("bank_txn_ids") > 0, "credit").otherwise("settlement")
        anchor = F.coalesce(F.get("bank_txn_ids", F.lit(0)), F.get("settlement_ids", F.lit(0)))
        days = r.world.settlements.select("world_id", F.col("settlement_id").alias("anchor"), F.col("created").alias("day")).unionByName(r.world.bank_rows.select("world_id", F.col("txn_id").alias("anchor"), F.col("value_date").alias("day")))
        items = left.select("world_id", side.alias("side"), anchor.alias("anchor"), "status").join(days, ["world_id", "anchor"])
        place = F.row_number().over(Window.partitionBy("world_id").orderBy(F.when(F.col("side") == "credit", 0).otherwise(1), "day", "anchor", "status"))
        return items.withColumn("place", place)

    ordered = "row_number() OVER (PARTITION BY world_id ORDER BY CASE side WHEN 'credit' THEN 0 ELSE 1 END, day, anchor, status)::INTEGER AS place"
    return {
        "as_of_leg_a": (at(lambda r: close.counted(r.leg_a(), "pass_name", "kind", "status", "confidence")), "SELECT pass_name, kind, status, confidence, count(*) AS n FROM leg_a GROUP BY ALL"),
        "as_of_leg_b": (at(lambda r: close.counted(r.leg_b(), "record_type", "status")), "SELECT record_type, status, count(*) AS n FROM leg_b GROUP BY ALL"),
        "as_of_queue": (at(lambda r: flat_queue(r.queue())), f"SELECT {QUEUE} FROM queue"),
        "as_of_cash": (at(lambda r: close.cash(r.world.bank_rows)), "SELECT world_id, count(*) AS n_rows, sum(credit_paise - debit_paise)::BIGINT AS movement_paise, min(value_date) AS first_date, max(value_date) AS close_date, (max(value_date) - min(value_date))::INTEGER AS span_days, max_by(txn_id, row_no) AS last_txn FROM bank_rows GROUP BY ALL"),
        "as_of_verify": (at(lambda r: verify.leg_a(r.world.settlements, r.world.bank_rows, damaged_decisions(r.leg_a()))), twins.broken_decisions("dd")),
        "golden_leg_b": (lambda r: r.golden_b().withColumn("counterparties", F.array_join("counterparties", ";")), twins.GOLDEN_B.format(o="order_book", p="payments")),
        "grade_leg_b": (accuracy, f"SELECT g.scenario, count(*) AS n_rows, count(*) FILTER (b.status = g.expected AND b.other = g.counterparties) AS n_correct FROM ({twins.GOLDEN_B.format(o='order_book', p='payments')}) g LEFT JOIN leg_b b ON g.world_id = b.world_id AND g.record_id = b.record_id AND g.record_type = b.record_type GROUP BY ALL"),
        "record_counts": (records, " UNION ALL ".join(f"SELECT world_id, count(*) AS n, '{n}' AS part FROM {t} GROUP BY ALL" for n, t in (("orders", "order_book"), ("payments", "payments"), ("settlements", "settlements"), ("bank_rows", "bank_rows")))),
        "net_separation": (apart, "SELECT world_id, count(*) FILTER (gap <= 100) AS close_pairs, min(gap) AS least_gap FROM (SELECT world_id, lead(amount_paise) OVER (PARTITION BY world_id ORDER BY amount_paise, settlement_id) - amount_paise AS gap FROM settlements) GROUP BY ALL"),
        "cash_stated": (stated, "SELECT world_id, (10000000 + sum(credit_paise - debit_paise))::BIGINT AS balance_paise, max(value_date) AS close_date FROM bank_rows GROUP BY ALL"),
        "worlds_rollup": (checked, f"SELECT q.*, coalesce(v.n, 0) AS violations FROM (SELECT world_id, count(*) AS n_items, min(severity) AS worst, sum(money_at_risk_paise)::BIGINT AS money_at_risk_paise, count(days_overdue) AS n_overdue FROM queue GROUP BY ALL) q LEFT JOIN (SELECT world_id, count(*) AS n FROM broken_q GROUP BY ALL) v ON q.world_id = v.world_id"),
        "resolver_items": (resolver, f"SELECT *, {ordered} FROM (SELECT x.*, coalesce(s.created, b.value_date) AS day FROM (SELECT world_id, CASE WHEN len(tids) > 0 THEN 'credit' ELSE 'settlement' END AS side, coalesce(tids[1], sids[1]) AS anchor, status FROM leg_a WHERE status IN ('ambiguous_abstain', 'exception_missing_bank', 'exception_missing_settlement')) x LEFT JOIN settlements s ON x.anchor = s.settlement_id LEFT JOIN bank_rows b ON x.anchor = b.txn_id)"),
    }


def registered() -> dict[str, Query]:
    return feeds.queries(twins.GOLDEN.format(settlements="settlements"), twins.missed("nqueue"), twins.title("status")) | statements.queries() | _as_of() | _search() | _audit() | _world() | _scalars() | _leg_a() | _leg_b() | _close() | _evaluation()


#: Columns of type date; results show them as ISO text, which both engines write alike.
DATES = feeds.DATES | {
    "world_settlements": ["created", "settled"], "world_bank_rows": ["value_date"], "scalar_dates": ["back", "rolled", "iso"], "net_per_month": ["month"],
    "statement_rows": ["value_date"], "as_of_queue": ["due_date"], "as_of_cash": ["first_date", "close_date"], "cash_stated": ["close_date"], "resolver_items": ["day"],
    "search_settlements": ["day"], "search_credits": ["day"], "search_narrations": ["day"], "search_statement_window": ["day"], "item_context": ["day"], "queue_urgent": ["due_date"],
    "overdue": ["expected_date"], "queue": ["due_date"], "queue_leg_a_items": ["due_date"], "queue_leg_b_items": ["due_date"], "queue_top": ["due_date"],
    "cash": ["first_date", "close_date"], "cash_as_of": ["first_date", "close_date"], "snapshot": ["close_date"],
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def run(name: str, make: Callable[[Results], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: make(results(spark, sf_dir)).withColumns({c: F.col(c).cast("string") for c in DATES.get(name, [])})

    return {name: run(name, make) for name, (make, _) in registered().items()}


def oracle_sql() -> dict[str, str]:
    def shown(name: str, query: str) -> str:
        texts = ", ".join(f"{c}::VARCHAR AS {c}" for c in DATES.get(name, []))
        return twins.sql(f"SELECT * REPLACE ({texts}) FROM ({query})" if texts else query, DAY if name.startswith("as_of") else None, name.startswith("hard_"))

    return {name: shown(name, query) for name, (_, query) in registered().items() if query}
