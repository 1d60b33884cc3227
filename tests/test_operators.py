import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import audit, baselines, close, graph, intake, leg_b, proposals, search, triage
from tallyforge.sources.scratch import Store

DAY = datetime.date(2025, 6, 10)


def test_leg_b(spark):
    orders = spark.createDataFrame([(0, i, o, a, s, "r") for i, (o, a, s) in enumerate([("o1", 100, "paid"), ("o2", 100, "created"), ("o3", 100, "cancelled"), ("o4", 100, "paid"), ("o5", 100, "paid"), ("o6", 100, "paid")])], "world_id long, row_no long, order_id string, amount_paise long, status string, receipt string")
    pays = [("p2", "o1", 100, "captured", 660), ("p1", "o1", 100, "captured", 605), ("p3", "o4", 90, "captured", 1), ("p4", "o4", 100, "captured", 2), ("p5", "o5", 100, "refunded", 3), ("p6", "o6", 100, "failed", 4), ("p7", "o6", 100, "captured", 5), ("p8", "nope", 100, "captured", 6), ("p9", "nope", 100, "failed", 7)]
    payments = spark.createDataFrame([(0, i, *p) for i, p in enumerate(pays)], "world_id long, row_no long, payment_id string, order_id string, amount_paise long, status string, created_s long")
    got = {r.record_id: (r.status, list(r.counterparty_ids), list(r.candidates)) for r in leg_b.reconcile(payments, orders).collect()}
    assert got["p1"] == ("payment_applied", ["o1"], []) and got["p2"] == ("exception_duplicate_payment", ["o1"], ["p1"])
    assert got["p3"][0] == "exception_amount_mismatch" and got["p4"][0] == "exception_duplicate_payment"  # the wrong capture came first
    assert got["p6"] == ("payment_failed", ["o6"], []) and got["p9"] == ("payment_failed", [], []) and got["p8"][0] == "exception_payment_no_order"
    assert [got[f"o{k}"][0] for k in range(1, 7)] == ["order_paid", "exception_unpaid_order", "order_cancelled", "exception_amount_mismatch", "order_refunded", "order_paid"]


def test_queue_rules(spark):
    schema = "world_id long, status string, confidence string, expected_paise long, received_paise long, discrepancy_paise long, settlement_ids array<string>, bank_txn_ids array<string>"
    rows = [("exception_missing_bank", "", 500, None, None, ["s1"], []), ("ambiguous_abstain", "", None, 7, None, [], ["t1"]), ("ambiguous_abstain", "", 0, 9, None, ["s2"], []), ("matched_with_discrepancy", "needs_review", 5, 2, -3, ["s3"], ["t3"]), ("matched", "exact", 5, 5, 0, ["s4"], ["t4"]), ("duplicate_credit", "", None, 11, None, [], ["t5"])]
    d = spark.createDataFrame([(0, *r) for r in rows], schema).selectExpr("*", "array('rule') AS rules", "CAST(array() AS array<struct<record_id:string,amount_paise:bigint,reason:string>>) AS candidates", "CAST(array() AS array<struct<label:string,amount_paise:bigint>>) AS discrepancy_breakdown")
    late = spark.createDataFrame([(0, "s1", DAY, 8), (0, "s9", DAY, 1)], "world_id long, settlement_id string, expected_date date, days_overdue int")
    got = {tuple(r.record_ids): (r.status, r.severity, r.money_at_risk_paise, r.days_overdue) for r in triage.items_from_leg_a(d, late).collect()}
    assert got == {("s1",): ("exception_missing_bank", 1, 500, 8), ("t1",): ("ambiguous_abstain", 2, 7, None), ("s2",): ("ambiguous_abstain", 2, 0, None), ("s3", "t3"): ("needs_review", 3, 3, None), ("t5",): ("duplicate_credit", 1, 11, None)}


def test_workflow_and_delta(spark):
    log = [("a", 1, "assign", "ann", "n", "x"), ("a", 2, "note", "bob", "hello", "x"), ("a", 3, "resolve", "bob", "n", "x"), ("b", 1, "note", "bob", "n", "x"), ("c", 1, "resolve", "ann", "n", "old")]
    actions = spark.createDataFrame(log, "item_id string, seq long, action string, by string, note string, status_at_action string")
    items = spark.createDataFrame([(k, "x") for k in "abcd"], "item_id string, status string")
    got = {r.item_id: (r.workflow, r.assignee, r.last_note, r.reopened) for r in close.overlay(items, close.fold_actions(actions)).collect()}
    assert got == {"a": ("resolved", "ann", "hello", False), "b": ("open", None, "n", False), "c": ("open", None, None, True), "d": ("open", None, None, False)}
    snap = "world_id long, close_date date, item_id string, status string, money_at_risk_paise long"
    before = spark.createDataFrame([(0, DAY, "a", "x", 1), (0, DAY, "b", "x", 2)], snap)
    now = spark.createDataFrame([(0, DAY, "b", "y", 3), (0, DAY, "c", "x", 4)], snap)
    assert {r.item_id: r.change for r in close.delta(before, now).collect()} == {"a": "gone", "b": "carried", "c": "new"}
    assert close.latest_before(before, F.lit(DAY)).collect() == []


def test_components(spark):
    draw = random.Random(2)
    edges = [(f"v{draw.randrange(80):03}", f"v{draw.randrange(80):03}") for _ in range(60)] + [(f"w{k:03}", f"w{k + 1:03}") for k in range(40)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a string, b string"), Store(spark)).collect()}
    assert got == {x: root(x) for x in list(parent)}


def test_baselines_in_credit_order(spark):
    """Both baselines against a loop over random worlds with many equal amounts."""
    draw = random.Random(3)
    s_rows, b_rows, expected_naive, expected_ref = [], [], set(), set()
    for w in range(60):
        ss = [(w, k, f"s{w}_{k}", draw.choice([1000, 1050, 1100, 5000]), draw.choice([f"UTIB{k:012}", ""]), DAY + datetime.timedelta(draw.randrange(5)), DAY + datetime.timedelta(draw.randrange(5))) for k in range(5)]
        bs = [(w, k, f"t{w}_{k}", DAY + datetime.timedelta(draw.randrange(8)), draw.choice(["x", f"ref UTIB{draw.randrange(5):012} y"]), "", draw.choice([1000, 1080, 5000, 0])) for k in range(6)]
        s_rows, b_rows = s_rows + ss, b_rows + bs
        open_ = {s[2]: s for s in ss}
        for b in bs:
            fits = [s for s in open_.values() if b[6] > 0 and abs(b[6] - s[3]) <= 100 and abs((b[3] - s[6]).days) <= 3]
            if fits:
                best = min(fits, key=lambda s: abs(b[6] - s[3]))
                del open_[best[2]]
                expected_naive.add((best[2], b[2]))
        open_, rest = {s[2]: s for s in ss}, []
        for b in (b for b in bs if b[6] > 0):
            hit = next((s for s in open_.values() if s[4] and s[4] in b[4].upper()), None)
            if hit:
                del open_[hit[2]]
                expected_ref.add((hit[2], b[2]))
            else:
                rest.append(b)
        for b in rest:
            fits = sorted((s for s in open_.values() if s[3] == b[6] and 0 <= (b[3] - s[5]).days <= 10), key=lambda s: (s[5], s[1]))
            if fits:
                del open_[fits[0][2]]
                expected_ref.add((fits[0][2], b[2]))
    s = spark.createDataFrame(s_rows, "world_id long, row_no long, settlement_id string, amount_paise long, utr string, created date, settled date")
    b = spark.createDataFrame(b_rows, "world_id long, row_no long, txn_id string, value_date date, narration string, ref_no string, credit_paise long")
    pairs = lambda d: {(r.settlement_ids[0], r.bank_txn_ids[0]) for r in d.filter("kind = 'match'").collect()}
    assert pairs(baselines.naive(s, b, Store(spark))) == expected_naive
    assert pairs(baselines.reference_then_amount(s, b, Store(spark))) == expected_ref


def test_sums_like_all_sets(spark):
    draw, asks, pool, expected = random.Random(3), [], [], []
    for ask in range(150):
        amounts = {f"r{k}": draw.randrange(1, 9) for k in range(draw.randrange(0, 10))}
        need, slots = draw.randrange(1, 30), draw.randrange(1, 7)
        asks.append((0, "i", ask, need, slots))
        pool += [(0, "i", ask, i, a) for i, a in amounts.items()]
        every = [c for n in range(1, slots + 1) for c in itertools.combinations(sorted(amounts), n)]
        expected += [(ask, *c) for c in every if sum(amounts[i] for i in c) == need]
    asks = spark.createDataFrame(asks, "world_id long, item_id string, ask int, need long, slots int")
    pool = spark.createDataFrame(pool, "world_id long, item_id string, ask int, id string, amount long")
    sets, cut_off = proposals.summing(asks, pool, Store(spark), 10**9)
    assert sorted((r.ask, *r.ids) for r in sets.collect()) == sorted(expected) and cut_off.collect() == []
    sets, cut_off = proposals.summing(asks, pool, Store(spark), 400)
    few = {(r.ask, *r.ids) for r in sets.collect()}
    assert few and few < set(expected) and max(f[0] for f in few) < 75 and [r.item_id for r in cut_off.collect()] == ["i"]


@pytest.fixture(scope="module")
def view(spark):
    s = [("setl_A", 500_311, "UTIB250900000001"), ("setl_B", 500_311, "UTIB250900000002"), ("setl_C", 700_000, "HDFC250900000003"), ("setl_D", 801_212, "HDFC250900000004"), ("setl_E", 450_977, "ICIC250900000005"), ("setl_F", 999_000, "SBIN250900000006")]
    c = [("t1", 500_311, "RZP payout", ""), ("t2", 694_100, "RZP HDFC250900000003 less charges Rs.59.00", ""), ("t3", 1_501_212, "RAZORPAY bulk", ""), ("t4", 200_000, "RZP part", ""), ("t5", 250_977, "RZP part", ""), ("t6", 999_000, "HDFC999999999999", "")]
    settlements = spark.createDataFrame([(0, k, i, a, u, DAY) for k, (i, a, u) in enumerate(s)], "world_id long, row_no long, settlement_id string, amount_paise long, utr string, created date")
    rows = spark.createDataFrame([(0, k, i, DAY + datetime.timedelta(2), n, r, a) for k, (i, a, n, r) in enumerate(c)], "world_id long, row_no long, txn_id string, value_date date, narration string, ref_no string, credit_paise long")
    return proposals.View(settlements, rows)


CLAIMED = "world_id long, record_id string"


def test_proposal_rules(spark, view):
    base = {"verdict": "match", "settlement_ids": ["setl_C"], "bank_row_ids": ["t2"], "deduction_paise": 5900, "deduction_evidence": "less charges Rs.59.00", "item_records": ["t2"]}
    cases = {
        "ok": ({}, ""), "shape": ({"verdict": "maybe"}, "shape"), "double": ({"settlement_ids": ["setl_C", "setl_C"]}, "shape"), "none": ({"verdict": "abstain"}, "no_match_proposed"), "unknown": ({"bank_row_ids": ["t99"]}, "unknown_id"),
        "item": ({"item_records": ["t9"]}, "item"), "claimed": ({"settlement_ids": ["setl_E"], "bank_row_ids": ["t4", "t5"], "deduction_paise": 0, "item_records": ["t4"]}, "claimed"), "sum": ({"deduction_paise": 1}, "arithmetic"),
        "evidence": ({"deduction_evidence": "HDFC250900000003"}, "evidence"), "twins": ({"settlement_ids": ["setl_A"], "bank_row_ids": ["t1"], "deduction_paise": 0, "item_records": ["t1"]}, "rival"),
        "many": ({"settlement_ids": ["setl_C", "setl_D"], "bank_row_ids": ["t3", "t5"], "deduction_paise": -250977, "item_records": ["t3"]}, "arithmetic,many_to_many"),
        "foreign": ({"settlement_ids": ["setl_F"], "bank_row_ids": ["t6"], "deduction_paise": 0, "item_records": ["t6"]}, "contradiction"),
    }
    schema = "world_id long, proposal_id string, verdict string, settlement_ids array<string>, bank_row_ids array<string>, deduction_paise long, deduction_evidence string, item_records array<string>"
    names = [f.split()[0] for f in schema.split(", ")][2:]
    p = spark.createDataFrame([(0, k, *((base | change)[n] for n in names)) for k, (change, _) in cases.items()], schema)
    claimed = spark.createDataFrame([(0, "t4")], CLAIMED)
    got = {r.proposal_id: r for r in proposals.verify(view, p, claimed, Store(spark)).collect()}
    assert {k: r.codes for k, r in got.items()} == {k: codes for k, (_, codes) in cases.items()}
    assert got["ok"].status == "matched_with_discrepancy" and got["ok"].accepted
    twice = p.filter("proposal_id = 'ok'").unionByName(p.filter("proposal_id = 'ok'").withColumn("proposal_id", F.lit("again")))
    assert {r.codes for r in proposals.verify(view, twice, claimed, Store(spark)).collect()} == {"conflict"}


def test_solver(spark, view):
    items = spark.createDataFrame([(0, "stated", ["t2"]), (0, "twins", ["t1"]), (0, "merged", ["t3"]), (0, "split", ["setl_E"]), (0, "nothing", ["t6"])], "world_id long, item_id string, record_ids array<string>")
    got = {r.item_id: (r.verdict, sorted(r.settlement_ids), sorted(r.bank_row_ids), r.deduction_paise) for r in proposals.solve(view, items, spark.createDataFrame([], CLAIMED), Store(spark)).collect()}
    assert got["stated"] == ("match", ["setl_C"], ["t2"], 5900)
    assert got["merged"] == ("match", ["setl_C", "setl_D"], ["t3"], 0)
    assert got["split"] == ("match", ["setl_E"], ["t4", "t5"], 0)
    assert got["twins"][0] in ("abstain", "exception") and got["nothing"][0] == "exception"


def test_solver_abstains_if_cut_off_without_a_hit(spark):
    """Sums of even amounts never make an odd one, and there are too many to look at all."""
    s = [(0, k, f"setl_{k}", 100_000 + 2 * k, f"UTIB25090000{k:04}", DAY) for k in range(100)]
    c = [(0, 0, "t1", DAY + datetime.timedelta(2), "RZP payout", "", 500_301), (0, 1, "t2", DAY + datetime.timedelta(2), "RZP payout", "", 7)]
    settlements = spark.createDataFrame(s, "world_id long, row_no long, settlement_id string, amount_paise long, utr string, created date")
    rows = spark.createDataFrame(c, "world_id long, row_no long, txn_id string, value_date date, narration string, ref_no string, credit_paise long")
    items = spark.createDataFrame([(0, "cut", ["t1"]), (0, "whole", ["t2"])], "world_id long, item_id string, record_ids array<string>")
    view, none = proposals.View(settlements, rows), spark.createDataFrame([], CLAIMED)
    assert {r.item_id: r.verdict for r in proposals.solve(view, items, none, Store(spark)).collect()} == {"cut": "abstain", "whole": "exception"}
    assert proposals.explanations(view, items, none, Store(spark)).count() == 0


GRID = [
    ["Date", "Narration", "Dr", "Cr", "Balance"], ["", "OPENING", "", "", "1,000.00 Cr"], ["01-04-2025", "NEFT/ABC123/x", "", "500.00", "1,500.00 Cr"], ["02-04-2025", "NEFT/ABC124/y", "200.00", "", "1,300.00 Cr"],
    ["02-04-2025", "REV/ABC124/y", "", "200.00", "1,500.00 Cr"], ["", "page 1", "", "", ""], ["03-04-2025", "UPI", "1,600.00", "", "100.00 Dr"], ["", "CLOSING", "", "", "100.00 Dr"],
]


def layout(**change):
    base = {"header_row": 0, "columns": {"date": 0, "narration": 1, "debit": 2, "credit": 3, "balance": 4}, "date_format": "%d-%m-%Y", "periods": [{"opening_row": 1, "closing_row": 7, "transaction_rows": [2, 3, 4, 6]}], "noise_rows": [5], "delimiter": "/", "token_index": 1, "token_regex": "[A-Z]{3}[0-9]+", "reversal_pairs": [(3, 4)]}
    return intake.Mapping(**(base | change))


@pytest.mark.parametrize(
    ("change", "edit", "codes"),
    [
        ({}, {}, set()), ({"columns": {"date": 0, "narration": 1, "debit": 3, "credit": 2, "balance": 4}}, {}, {"E_BALANCE_CHAIN_BREAK"}),
        ({}, {(3, 4): "1,301.00 Cr"}, {"E_BALANCE_CHAIN_BREAK"}), ({"periods": [{"opening_row": 1, "closing_row": 7, "transaction_rows": [2, 4, 6]}], "noise_rows": [5, 3], "reversal_pairs": []}, {}, {"E_BALANCE_CHAIN_BREAK", "E_TRANSACTION_LIKE_NOISE"}),
        ({"noise_rows": [5, 6]}, {}, {"E_ROW_DOUBLE_CLASSIFIED"}), ({"noise_rows": []}, {}, {"E_ROW_UNCLASSIFIED"}), ({"noise_rows": [5, 99]}, {}, {"E_ROW_RANGE"}), ({"columns": {"date": 0, "narration": 1, "debit": 2, "credit": 2, "balance": 9}}, {}, {"E_COLUMN_RANGE", "E_COLUMN_COLLISION"}),
        ({"reversal_pairs": [(2, 3)]}, {}, {"E_REVERSAL_PAIR"}), ({}, {(2, 0): "2025"}, {"E_DATE_PARSE"}), ({}, {(3, 0): "31-03-2025"}, {"E_DATE_ORDER"}), ({}, {(2, 2): "1.00"}, {"E_BOTH_SIDES", "E_BALANCE_CHAIN_BREAK"}),
        ({"token_regex": "ZZZ"}, {}, {"E_RECIPE_YIELD", "E_REVERSAL_PAIR"}),
    ],
)
def test_layouts_are_proved(spark, change, edit, codes):
    rows = [[edit.get((i, k), c) for k, c in enumerate(r)] for i, r in enumerate(GRID)]
    cells = spark.createDataFrame(list(enumerate(rows)), "row_no long, cells array<string>")
    assert {r.code for r in intake.one(spark, cells, layout(**change)).faults.collect()} == codes


def test_intake_rows(spark, tmp_path):
    path = tmp_path / "statement.csv"
    path.write_text("﻿" + "\n".join(",".join(f'"{c}"' if "," in c else c for c in r) for r in GRID) + "\n", encoding="utf-8")
    cells = spark.createDataFrame(list(enumerate(GRID)), "row_no long, cells array<string>")
    proof = intake.one(spark, cells, layout())
    got = proof.canonical().orderBy("txn_id").collect()
    assert [(r.txn_id, r.credit_paise, r.debit_paise, r.balance_paise, r.ref_no) for r in got] == [("REAL000001", 50000, 0, 150000, "ABC123"), ("REAL000002", 0, 20000, 130000, "ABC124"), ("REAL000003", 20000, 0, 150000, "ABC124"), ("REAL000004", 0, 160000, -10000, "")]
    read = [r.cells for r in intake.grid(spark, str(path)).orderBy("row_no").collect()]
    assert read == GRID
    assert proof.reproved(proof.canonical()).collect() == []
    wrong = proof.canonical().withColumn("credit_paise", F.col("credit_paise") + (F.col("row_no") == 4).cast("long"))
    assert [r.txn_id for r in proof.reproved(wrong).orderBy("txn_id").collect()] == ["REAL000003", "REAL000004"]


def test_batch_of_statements(spark, tmp_path):
    lines = [",".join(f'"{c}"' if "," in c else c for c in r) for r in GRID]
    (tmp_path / "deep" / "golden").mkdir(parents=True)
    for name, extra in (("a.csv", "AXIS BANK,HDFC0001234,,,"), ("deep/kotak_b.csv", ",,,,"), ("deep/c.csv", "IFSC ICIC0000012,,,,"), ("deep/golden/d.csv", ""), ("deep/e.txt", "")):
        (tmp_path / name).write_text("\n".join([*lines, extra]) + "\n", encoding="utf-8")
    found = sorted(r.file for r in intake.statement_files(spark, str(tmp_path)).collect())
    assert [f.rsplit("/", 1)[-1] for f in found] == ["a.csv", "c.csv", "kotak_b.csv"]
    layouts = {f: layout(noise_rows=[5, 8]) for f in found} | {found[0]: layout(noise_rows=[8], periods=[{"opening_row": 1, "closing_row": 7, "transaction_rows": [2, 3, 4, 5, 6]}])}
    got = {r.file.rsplit("/", 1)[-1]: (r.bank, r.rows, r.result, r.faults) for r in intake.batch(spark, layouts).collect()}
    assert got["c.csv"] == ("ICICI Bank", 9, "passed", "") and got["kotak_b.csv"] == ("Kotak Mahindra Bank", 9, "passed", "")
    assert got["a.csv"][:3] == ("Axis Bank", 9, "failed") and "E_DATE_PARSE" in got["a.csv"][3]
    assert {(r.result, r.files) for r in intake.batch_summary(intake.batch(spark, layouts)).collect()} == {("passed", 2), ("failed", 1)}
    of = lambda **change: intake.layouts_of(spark, {"f": layout(**change)})
    assert {tuple(r) for r in intake.role_issues(of(), of(header_row=1, noise_rows=[])).collect()} == {("f", "header", 0, 1)}
    cells = intake.grid(spark, found[0])
    assert [r.code for r in intake.one(spark, cells, layout(token_regex="ABC123", noise_rows=[5, 8], reversal_pairs=[])).warnings().collect()] == ["W_LOW_RECIPE_YIELD"]


def test_capped_search_and_grid(spark):
    cells = spark.createDataFrame([(k, [f"Row {k}", "NEFT" if k % 2 else "UPI"]) for k in range(60)], "row_no long, cells array<string>")
    got = search.grid_search(cells, "neft").collect()
    assert [r.row_no for r in got] == list(range(1, 41, 2)) and all(r.truncated for r in got)
    assert [r.row_no for r in search.grid_peek(cells, 10, 3).collect()] == [10, 11, 12]


def test_proposals_take_the_place_of_decisions(spark):
    before = spark.createDataFrame([(0, "s1", "human", ["s1"], "", True), (0, "t1", "human", ["t1"], "", True), (0, "s2", "match", ["s2", "t2"], "exact", True)], "world_id long, record_id string, kind string, members array<string>, tier string, explained boolean")
    accepted = spark.createDataFrame([(0, ["s1"], ["t1"])], "world_id long, settlement_ids array<string>, bank_row_ids array<string>")
    after = audit.with_proposals(before, accepted)
    golden = spark.createDataFrame([(0, "s1", "matched", ["t1"], "x"), (0, "s2", "matched", ["t9"], "x"), (0, "s3", "exception_missing_bank", [], "x")], "world_id long, record_id string, expected string, counterparties array<string>, scenario string")
    assert {r.record_id: r.box for r in audit.categorised(golden, after).collect()} == {"s1": "auto_correct", "s2": "auto_wrong", "s3": "rightly_left"}
    assert {r.record_id: r.box for r in audit.categorised(golden, before).collect()}["s1"] == "wrongly_left"


def test_layouts_from_documents(spark, tmp_path):
    import json

    golden = {"header_row": 5, "columns": {"date": 1, "narration": 2, "debit": 4, "credit": None, "balance": 6, "amount": 5}, "date_format": "%d-%b-%Y", "periods": [{"opening_row": 6, "closing_row": None, "transaction_rows": [7, 8]}]}
    mapping = golden | {"columns": {"date": 1, "narration": 2, "debit": 4, "credit": 3, "balance": 6}, "periods": [{"opening_row": 6, "closing_row": 9, "transaction_rows": [8, 7]}], "noise_rows": [0], "reference_recipe": {"kind": "delimited", "delimiter": "/", "index": 2, "token_regex": "[0-9]+"}, "reversal_pairs": [[7, 8]]}
    (tmp_path / "axis_1.json").write_text(json.dumps(golden))
    (tmp_path / "axis_2.json").write_text(json.dumps(mapping))
    read = {r.statement: r for r in intake.read_layouts(spark, str(tmp_path)).collect()}
    assert read["axis_1"].noise_rows == [] and read["axis_1"].token_regex == "" and read["axis_2"].token_index == 2 and read["axis_2"].reversal_pairs == [[7, 8]]
    of = intake.read_layouts(spark, str(tmp_path)).withColumnRenamed("statement", "file")
    assert {tuple(r) for r in intake.layout_limits(of).collect()} == {("axis_1", "one amount column with a Dr/Cr marker"), ("axis_1", "closing balance only in a summary line")}
    one, two = (of.filter(F.col("file") == f).withColumn("file", F.lit("x")) for f in ("axis_1", "axis_2"))
    assert intake.role_issues(two, one).collect() == []  # what the label does not say is no issue, nor is the order of rows
    assert {(r.role, r.got, r.expected) for r in intake.role_issues(one, two).collect()} == {("credit", None, 3)}


def test_statements_of_a_folder_are_one_job(spark):
    """Faults of one file do not touch another, and a file without a grid fails."""
    good, bad = layout(), layout(columns={"date": 0, "narration": 1, "debit": 3, "credit": 2, "balance": 4})
    cells = spark.createDataFrame([(f, k, row) for f in ("a", "b") for k, row in enumerate(GRID)], "file string, row_no long, cells array<string>")
    proof = intake.Proof(cells, intake.layouts_of(spark, {"a": good, "b": bad, "gone": good}), Store(spark))
    got = {r.file: (r.rows, r.transactions, r.result, r.faults) for r in proof.results().collect()}
    assert got["a"] == (8, 4, "passed", "") and got["b"][2:] == ("failed", "E_BALANCE_CHAIN_BREAK") and got["gone"][:3] == (0, 0, "failed")
    assert {r.file for r in proof.canonical().collect()} == {"a"}
    assert {(r.file, r.chain_ok, r.closing_paise) for r in proof.periods().collect()} == {("a", True, -10000), ("b", False, None)}


def test_a_reference_is_no_branch_code(spark):
    grids = {"kotak_1.csv": ["NEFT CR-HDFC012345678901-RAZORPAY"], "x.csv": ["RTGS SBIN012345678901", "xHDFC0TEST42"], "y.csv": ["UTIB012345678901", "IFSC:HDFC0TEST42,"]}
    cells = spark.createDataFrame([(file, n, ["", text]) for file, texts in grids.items() for n, text in enumerate(texts)], "file string, row_no long, cells array<string>")
    assert {tuple(r) for r in intake.banks(cells).collect()} == {("kotak_1.csv", "Kotak Mahindra Bank"), ("x.csv", "unknown"), ("y.csv", "HDFC Bank")}
