"""Steps that must not be run more often, or hold more, than the input asks for."""

import itertools
import re

import pytest
from pyspark.sql import Row

from tallyforge.operators import audit, baselines, intake, leg_b, proposals, verify
from tallyforge.plans import catalog, statements
from tallyforge.sources import world
from tallyforge.sources.scratch import Store
from tallyforge.streaming import workflow


@pytest.fixture(scope="module")
def shared(spark):
    return catalog.Results(spark, "/root/testdata/sf0.001")


def plan(df):
    return str(df._jdf.queryExecution().optimizedPlan())


def test_a_queue_meets_what_is_due_once(spark):
    items = spark.createDataFrame([(1, "needs_review", 3, 5, ["a", "b"]), (1, "duplicate_credit", 2, 7, ["c"])], "world_id long, status string, severity int, money_at_risk_paise long, record_ids array<string>")
    due = spark.createDataFrame([(1, "needs_review", "a;b", 2, 6), (1, "duplicate_credit", "d", 1, 1)], "world_id long, status string, unit string, due long, due_money long")
    faults = verify.queue(items, due)
    assert plan(faults).count("Join") == 1
    told = {("item_count", "needs_review:a;b"), ("missing_item", "duplicate_credit:d"), ("money", "needs_review:a;b"), ("severity", "duplicate_credit:c"), ("unfounded_item", "duplicate_credit:c")}
    assert {(r["code"], r["record"]) for r in faults.collect()} == told


def test_amounts_are_read_once_for_all_due_items(spark):
    a = spark.createDataFrame([(1, "matched", "needs_review", ["s1"], ["c1"]), (1, "duplicate_credit", "", [], ["c2"])], "world_id long, status string, confidence string, settlement_ids array<string>, bank_txn_ids array<string>")
    b = spark.createDataFrame([(1, "order", "o1", "exception_amount_mismatch", ["p1"]), (1, "payment", "p1", "exception_amount_mismatch", ["o1"]), (1, "order", "o2", "exception_unpaid_order", [])], "world_id long, record_type string, record_id string, status string, counterparty_ids array<string>")
    amounts = spark.createDataFrame([(1, "s1", "s", 10), (1, "c1", "c", 7), (1, "c2", "c", 5), (1, "o1", "o", 20), (1, "p1", "p", 26), (1, "o2", "o", 9)], "world_id long, id string, kind string, amount long")
    due = verify.due_items(a, b, amounts)
    assert sum("LogicalRDD" in line and "kind#" in line for line in plan(due).splitlines()) == 1
    assert sorted(map(tuple, due.collect())) == [(1, "duplicate_credit", "c2", 1, 5), (1, "exception_amount_mismatch", "o1;p1", 1, 6), (1, "exception_unpaid_order", "o2", 1, 9), (1, "needs_review", "c1;s1", 1, 3)]


@pytest.mark.parametrize("name", ["leg_a_out_of_scope", "worst_failures", "false_matches_by_tier", "audit_naive_queue"])
def test_queries_that_need_no_leg_a_do_not_run_it(shared, name):
    catalog.registered()[name][0](shared).collect()
    assert not {"leg_a", "by_reference"} & set(shared.made)


@pytest.mark.parametrize("name", ["evaluate_systems", "benchmark_strategies"])
def test_comparing_systems_writes_no_orders_or_payments(spark, name):
    w = world.derive(spark, "/root/testdata/sf0.001")
    catalog.registered()[name][0](catalog.Results(spark, "/root/testdata/sf0.001", w)).collect()
    assert not {"order_book", "payments"} & set(vars(w))


def test_systems_meet_the_golden_rows_in_one_join(spark):
    columns = "world_id long, status string, confidence string, settlement_ids array<string>, bank_txn_ids array<string>, discrepancy_paise long, discrepancy_breakdown array<struct<label:string,amount_paise:bigint>>, pass_name string"
    made = lambda *rows: spark.createDataFrame([(0, *r[:4], r[4], [], r[5]) for r in rows], columns)
    decisions = {
        "a": made(("matched", "exact", ["s1"], ["t1"], 0, "p1"), ("ambiguous_abstain", "", ["s1", "s2"], [], None, "p4"), ("non_settlement_credit", "", [], ["t3"], None, "p5")),
        "b": made(("matched", "medium", ["s2"], ["t1"], 0, "p1"), ("matched", "medium", ["s1"], ["t1"], 5, "p1"), ("out_of_scope", "", [], ["s3"], None, "p0")),
        "c": made(),
    }
    golden = spark.createDataFrame([(0, "s1", "matched", ["t1"], "x"), (0, "s2", "exception_missing_bank", [], "x"), (0, "s3", "matched", ["t9"], None)], "world_id long, record_id string, expected string, counterparties array<string>, scenario string")
    got = audit.compared(decisions, golden)
    assert plan(got).count("Join") == 2  # the golden rows' groups and the systems
    told = lambda df: sorted(map(str, df.select("system", "scenario", "box", "n").collect()))
    assert told(got) == told(audit.boxes({k: audit.state(d) for k, d in decisions.items()}, golden))


def test_payments_are_not_sorted_again_for_an_orders_first_capture(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    payments = spark.createDataFrame([(0, k, f"p{k}", o, 10, s, t) for k, (o, s, t) in enumerate([("o1", "captured", 9), ("o1", "captured", None), ("o1", "failed", 1), ("o2", "captured", 5), ("o2", "captured", 5), ("o3", "refunded", 1)])], "world_id long, row_no long, payment_id string, order_id string, amount_paise long, status string, created_s long")
    orders = spark.createDataFrame([(0, k, f"o{k}", 10, "paid") for k in (1, 2, 3)], "world_id long, row_no long, order_id string, amount_paise long, status string")
    told = leg_b.reconcile(payments, orders)
    physical = str(told._jdf.queryExecution().executedPlan())
    got = {r["record_id"]: r["status"] for r in told.filter("record_type = 'payment'").collect()}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"Sort \[[^\]]*created_s", physical)
    assert got == {"p0": "exception_duplicate_payment", "p1": "payment_applied", "p2": "payment_failed", "p3": "payment_applied", "p4": "exception_duplicate_payment", "p5": "payment_refunded"}


def test_references_of_any_letters_are_found_beside_leg_as(spark):
    day = "cast('2025-04-01' as date)"
    refs = ["UTIB000000000001", "hdfc000000000002", "IC-9 17", "", None]
    s = spark.createDataFrame([(0, f"s{k}", k, 100 + k, u) for k, u in enumerate(refs)], "world_id long, settlement_id string, row_no long, amount_paise long, utr string").selectExpr("*", f"{day} AS created", f"{day} AS settled")
    texts = [("neft utib000000000001", ""), ("NEFT", "HDFC000000000002"), ("x ic-9 17 y", None), ("UTIB-000000000001", ""), ("none", "")]
    b = spark.createDataFrame([(0, f"t{k}", k, n, r, 900, 0) for k, (n, r) in enumerate(texts)], "world_id long, txn_id string, row_no long, narration string, ref_no string, credit_paise long, debit_paise long").selectExpr("*", f"{day} AS value_date")
    found = baselines.reference_then_amount(s, b, Store(spark)).filter("kind = 'match'")
    assert sorted((*r.settlement_ids, *r.bank_txn_ids) for r in found.collect()) == [("s0", "t0"), ("s1", "t1"), ("s2", "t2")]


class Held:
    """A state that counts how often it is asked."""

    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.value, self.calls = value, self.calls + 1


def test_an_items_state_is_asked_once_a_batch():
    class Handle:
        def getValueState(self, name, schema):
            return Held()

    items = workflow.Items()
    items.init(Handle())
    event = Row(*(c.split()[0] for c in workflow.EVENTS.split(", ")))
    rows = [event("i", k % 40, "assign" if k % 2 else "resolve", "u", None, None, None, "open") for k in range(60)]
    for _ in range(2):
        (told,) = items.handleInputRows(("i",), iter(rows), None)
        assert (told.last_action, told.n_actions, told.seen_status, told.assignee) == ("assign", 40, "open", "u")
    assert items.facts.calls == 4


def test_rows_that_layouts_list_are_not_broadcast(shared, spark):
    """A layout's arrays become a row for each number, many times the size that the planner knows."""
    plans = {}

    class Watched(Store):
        def cut(self, df, name):
            plans[name] = str(df._jdf.queryExecution().executedPlan())
            return super().cut(df, name)

    made = statements.Statements(shared.world.bank_rows, shared.world.store)
    proof = intake.Proof(made.cells, made.layouts, Watched(spark))
    assert not [side for name in ("structure", "typed") for side in re.findall(r"BroadcastHashJoin \[file#\d+, row_no#\d+L?\].*", plans[name])]
    assert proof.reproved(statements.damaged(proof.canonical())).count() > 0


@pytest.mark.parametrize("name", ["hard_solver", "hard_proposal_stats", "hard_resolver", "hard_evaluate_resolver", "hard_evaluate_with_solver"])
def test_searches_over_hard_rows_make_no_queue_and_judge_once(spark, name):
    w = world.derive(spark, "/root/testdata/sf0.001")
    named = []

    class Watched(Store):
        def cut(self, df, name):
            named.append(name)
            return super().cut(df, name)

    w.store = Watched(spark)
    r = catalog.Results(spark, "/root/testdata/sf0.001", w)
    told = catalog.registered()[name][0](r)
    assert told.count() > 0 and not {"queue", "leg_b"} & {*r.made, *r.hard().made} and named.count("passed") == 1
    assert named.count("texts") == 1
    if name == "hard_solver":
        hard = r.hard()
        want = hard.queue().filter("source = 'recon_leg_a' AND status IN ('ambiguous_abstain', 'exception_missing_bank', 'exception_missing_settlement')")
        rows = lambda df: sorted(map(str, df.select("world_id", "item_id", "record_ids").collect()))
        assert rows(hard.open_items()[1]) == rows(want) != []


def test_asks_of_a_day_share_its_pool(spark):
    """A pool is written and shuffled once, whatever asks there are, and no set holds what its ask has already."""
    asks = [(0, f"i{k}", 1, "merged", 1, 30 + k % 3, 5, [f"r{k % 7}"]) for k in range(40)]
    pool = [(0, "merged", 1, f"r{k}", 5 + k) for k in range(12)] + [(0, "split", 1, "x", 30)]
    written = {}

    class Watched(Store):
        def cut(self, df, name):
            written[name] = super().cut(df, name)
            return written[name]

    asks = spark.createDataFrame(asks, "world_id long, item_id string, ask int, kind string, day int, need long, slots int, must array<string>")
    sets, cut_off = proposals.summing(asks, spark.createDataFrame(pool, "world_id long, kind string, day int, id string, amount long"), Watched(spark))
    amounts = {f"r{k}": 5 + k for k in range(12)}
    want = sorted((f"i{k}", *c) for k in range(40) for n in range(1, 6) for c in itertools.combinations(sorted(set(amounts) - {f"r{k % 7}"}), n) if sum(map(amounts.get, c)) == 30 + k % 3)
    assert sorted((r.item_id, *r.ids) for r in sets.collect()) == want != []
    assert written["pool"].count() == 2 and written["sizes"].count() == 40 and cut_off.count() == 0
