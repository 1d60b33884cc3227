import datetime
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import grammar
from tallyforge.functions import scalars as X


def column(spark, values, kind, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.orderBy("i").select(make(F.col("v")).alias("x")).collect()]


def test_paise(spark):
    cases = {"1,52,340.50": 15234050, "100": 10000, "-5.5": -550, "+7": 700, "Rs.12": 1200, '"1,000"': 100000, "0.05": 5}
    assert column(spark, list(cases), "string", X.paise) == list(cases.values())
    assert column(spark, ["", None, " ", "3"], "string", X.optional_paise) == [0, 0, 0, 300]
    for bad in ("1.234", "abc", "1.2.3", "", "--1"):
        with pytest.raises(Exception, match="not an amount"):
            column(spark, [bad], "string", X.paise)


def test_rupees_round_trip(spark):
    values = [0, 5, 100, 99999, 12345678, 123456789, 100000000000, -15234050]
    shown = column(spark, values, "long", X.rupees)
    assert shown[4:6] == ["1,23,456.78", "12,34,567.89"] and shown[-1] == "-1,52,340.50"
    assert column(spark, shown, "string", X.paise) == values


def test_fees_dates_ids(spark):
    assert column(spark, [0, 100, 2950, 25], "long", X.gst_on_fee) == [0, 18, 531, 5]
    days = [datetime.date(2025, 6, d) for d in (6, 7, 8, 9)]
    assert column(spark, days, "date", X.roll_off_sunday) == [days[0], days[1], days[3], days[3]]
    assert column(spark, ["03/04/2025 "], "string", X.bank_date) == [datetime.date(2025, 4, 3)]
    assert column(spark, ["2025-04-02T01:15:00", "2025-04-02"], "string", X.iso_date) == [datetime.date(2025, 4, 2)] * 2
    assert column(spark, [0, 1743556500], "long", X.epoch_text) == ["1970-01-01T00:00:00", "2025-04-02T01:15:00"]
    got = column(spark, [["b", "a"]], "array<string>", lambda c: X.item_id(F.lit("src"), c))
    assert got == [hashlib.sha1(b"src|a|b").hexdigest()[:12]]


def test_references(spark):
    assert column(spark, ["NEFT-UTIB250987654321/short AB12345678"], "string", X.tokens) == [["UTIB250987654321", "AB12345678"]]
    assert column(spark, ["ab-12 c"], "string", X.canonical) == ["AB12C"]
    utr = F.lit("UTIB250987654321")
    assert column(spark, ["UTIB250987654321", "UTIB250987654320", "UTIB25098765432", "UTIB250987654300"], "string", lambda c: X.near_utr(c, utr)) == [True, True, False, False]
    assert column(spark, ["50987654321", "987654321", "50987654320"], "string", lambda c: X.fragment_of(c, utr)) == [True, False, False]
    assert column(spark, ["abcd", "ab", ""], "string", lambda c: X.grams(c, 3)) == [["abc", "bcd"], [], []]


def test_cells(spark):
    cells = ["1,23,456.78 Cr", "500.5 Dr", "(500.00)", "INT", "", "₹ 12", "7-"]
    got = column(spark, cells, "string", X.amount_cell)
    assert [g and (g.paise, g.side) for g in got] == [(12345678, "CR"), (50050, "DR"), (-50000, None), None, None, (1200, None), None]
    assert column(spark, ["05 Apr 2025", "xx"], "string", lambda c: X.date_cell(c, "%d %b %Y")) == [datetime.date(2025, 4, 5), None]
    assert column(spark, ["NEFT/ABC123/x", "NEFT", None], "string", lambda c: X.reference_of(c, "/", 1, "[A-Z]{3}[0-9]+")) == ["ABC123", "", ""]


def test_hmac_and_wilson(spark):
    body = b'{"a": 1}'
    for secret in ("s3cret", "k" * 100):
        got = column(spark, [bytearray(body)], "binary", lambda c, s=secret: X.hmac_sha256(c, s))
        assert got == [hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()]
    lo_hi = column(spark, [0, 5], "long", lambda c: X.wilson(c, F.lit(150)))
    assert lo_hi[0].lo < 1e-12 and 0.02 < lo_hi[0].hi < 0.03 and lo_hi[1].lo < 5 / 150 < lo_hi[1].hi


FIGURES = {
    "Rs.59/-": [5900], "CHG 25.00 GST 4.50": [2500, 450], "fee 5%": [], "dated 12/05/2025": [], "INR 1,52,340.50 Cr": [15234050], "UTIB0001234": [], "paid 100Dr": [10000], "at 10:30": [],
    "12 MAY": [], "on May 12": [], "₹99.9": [9990], "1.234": [], "1,2,3": [], "₹1,000": [100000], "ABRs 5": [500], "x5": [], "5x": [], "٣": [], "": [], "12345": [1234500],
}


def test_money_grammar(spark):
    assert {t: [v for v, _, _ in grammar.spans(t)] for t in FIGURES} == FIGURES
    got = column(spark, list(FIGURES), "string", grammar.money_spans)
    assert [[x.paise for x in g] for g in got] == list(FIGURES.values())


def test_quoted_figures():
    assert grammar.quoted("less charges  Rs.59.00 only", "charges Rs.59.00", 5900)
    assert not grammar.quoted("less charges Rs.59.00 only", "charges Rs.59", 5900)
    assert not grammar.quoted("ref UTIB0001234", "0001234", 123400)
    assert not grammar.quoted("less Rs.59", "", 5900) and not grammar.quoted(None, "x", 1)
