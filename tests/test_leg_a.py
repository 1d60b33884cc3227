import datetime
import random

import pytest

from sequential import reconcile
from tallyforge.operators import leg_a, verify
from tallyforge.sources.scratch import Store

S = "world_id long, row_no long, settlement_id string, amount_paise long, utr string, created date"
B = "world_id long, row_no long, txn_id string, value_date date, narration string, ref_no string, credit_paise long, debit_paise long"
DAY = datetime.date(2025, 4, 1)


def random_world(draw, world_id):
    """A small world with many equal amounts, shared references and sums that collide."""
    amounts = [100_000, 100_000, 250_000, 350_000, 600_000]
    settlements, rows = [], []
    for k in range(draw.randrange(3, 9)):
        utr = f"UTIB{draw.randrange(10**11, 10**12)}" if draw.random() < 0.8 or not settlements else settlements[-1][4]
        settlements.append((world_id, k, f"s{world_id}_{k}", draw.choice(amounts), utr, DAY + datetime.timedelta(draw.randrange(4))))
    for k in range(draw.randrange(3, 12)):
        s = draw.choice(settlements)
        other = draw.choice(settlements)
        amount = draw.choice([s[3], s[3], s[3] + other[3], s[3] - 2950, s[3] - (s[3] + 50) // 100, s[3] // 2, s[3] - 777, 0])
        text = draw.choice([s[4], s[4], f"{s[4][:8]}-{s[4][8:]}", s[4][3:15], s[4][:15] + "0", f"{s[4]} {other[4]}", "", "UPI"])
        mark = draw.choice(["RZP ", "RAZORPAY/", "NEFT "])
        rows.append((world_id, k, f"t{world_id}_{k}", s[5] + datetime.timedelta(draw.choice([0, 2, 2, 5, 12])), mark + text, draw.choice(["", "", s[4]]), max(amount, 0), 5 if amount == 0 else 0))
    return settlements, rows


def as_dicts(rows, schema):
    names = [c.split()[0] for c in schema.split(", ")]
    return [dict(zip(names, r, strict=True)) for r in rows]


def told(decisions):
    return sorted((d.world_id, d.status, tuple(d.settlement_ids), tuple(d.bank_txn_ids), d.confidence, d.pass_name, tuple(c.record_id for c in d.candidates)) for d in decisions.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_like_the_sequential_account(spark, seed):
    draw = random.Random(seed)
    worlds = [random_world(draw, w) for w in range(120)]
    s = spark.createDataFrame([r for w in worlds for r in w[0]], S)
    b = spark.createDataFrame([r for w in worlds for r in w[1]], B)
    got = told(leg_a.reconcile(s, b, Store(spark)))
    expected = sorted((w, *d) for w, (x, y) in enumerate(worlds) for d in reconcile(as_dicts(x, S), as_dicts(y, B)))
    assert {p for _, _, _, _, _, p, _ in got} >= {"pass1_exact_utr", "pass2_fuzzy_utr", "pass3_merge", "pass4_amount_unique", "pass5_residuals", "pass0_scope"}
    assert got == expected


def one(spark, settlements, rows):
    s = spark.createDataFrame([(0, k, *x) for k, x in enumerate(settlements)], S)
    b = spark.createDataFrame([(0, k, *x) for k, x in enumerate(rows)], B)
    return s, b, leg_a.reconcile(s, b, Store(spark))


@pytest.fixture(scope="module")
def plain(spark):
    settlements = [("setl_A", 1_000_000, "UTIB250987654321", DAY), ("setl_B", 700_000, "UTIB250987650000", DAY), ("setl_C", 555_000, "HDFC250987651111", DAY)]
    later = DAY + datetime.timedelta(2)
    rows = [("B1", later, "NEFT UTIB250987654321", "", 1_000_000, 0), ("B2", later, "RZP UTIB250987650000", "", 697_050, 0), ("B3", later, "UPI", "", 555_000, 0)]
    s, b, d = one(spark, settlements, rows)
    return s, b, Store(spark).cut(d, "plain")


def test_micro(plain):
    got = {(tuple(r.settlement_ids), tuple(r.bank_txn_ids)): (r.status, r.confidence, list(r.rules)) for r in plain[2].collect()}
    assert got[("setl_A",), ("B1",)] == ("matched", "exact", ["utr_exact", "amount_exact"])
    assert got[("setl_B",), ("B2",)][:2] == ("matched_with_discrepancy", "high")
    assert got[("setl_C",), ()][0] == "exception_missing_bank"  # an unshaped credit of the same amount is no payout
    assert got[(), ("B3",)][0] == "non_settlement_credit"
    assert verify.leg_a(*plain).collect() == []


@pytest.mark.parametrize(
    ("change", "code"),
    [
        ("expected_paise = expected_paise + 1", "expected_sum"), ("received_paise = received_paise - 1", "received_sum"), ("discrepancy_paise = 5", "discrepancy"), ("rules = array()", "no_evidence"),
        ("confidence = 'sure'", "unknown_confidence"), ("rules = array('window')", "unbacked_confidence"), ("settlement_ids = array('nobody')", "unknown_settlement"), ("bank_txn_ids = array('nobody')", "unknown_credit"),
    ],
)
def test_corrupted_decisions_are_caught(plain, change, code):
    s, b, d = plain
    column, value = change.split(" = ", 1)
    kind = dict(d.dtypes)[column]
    bad = d.withColumn(column, __import__("pyspark").sql.functions.expr(f"CASE WHEN status = 'matched' THEN cast({value} AS {kind}) ELSE {column} END"))
    assert code in {r.code for r in verify.leg_a(s, b, bad).collect()}


def test_dropped_and_doubled_decisions_are_caught(plain):
    s, b, d = plain
    assert {"settlement_uncovered", "credit_uncovered"} <= {r.code for r in verify.leg_a(s, b, d.filter("status <> 'matched'")).collect()}
    twice = d.unionByName(d.filter("status = 'matched'"))
    assert {"settlement_claimed_twice", "credit_claimed_twice"} <= {r.code for r in verify.leg_a(s, b, twice).collect()}
    empty = d.withColumn("candidates", __import__("pyspark").sql.functions.expr("slice(candidates, 1, 0)"))
    assert "no_candidates" in {r.code for r in verify.leg_a(s, b, empty).collect()}
