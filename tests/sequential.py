"""A plain account of the settlement matcher, record by record, to hold the Spark form against."""

import re
from collections import defaultdict

MARK = re.compile("RAZORPAY|RZPAY|RZP")
UTR = re.compile("[A-Z]{4}[0-9]{12}")


class Credit:
    def __init__(self, row):
        self.tid, self.no, self.amount, self.day = row["txn_id"], row["row_no"], row["credit_paise"], row["value_date"]
        texts = row["narration"].upper(), row["ref_no"].upper()
        self.runs = [t for text in texts for t in re.findall("[A-Z0-9]+", text) if len(t) >= 10]
        self.strip = "".join(re.sub("[^A-Z0-9]", "", t) for t in texts)
        self.shaped = bool(MARK.search(" ".join(texts))) or any(UTR.fullmatch(t) for t in self.runs)


def fits(s, c, extra=0):
    return 0 <= (c.day - s["created"]).days <= 10 + extra


def damaged(utr, c):
    def near(t):
        return UTR.fullmatch(t) and len(t) == len(utr) and sum(a != b for a, b in zip(t, utr, strict=True)) <= 1

    return any(t != utr and (t in utr or near(t)) for t in c.runs)


def reconcile(settlements, bank_rows):
    """(status, settlement ids, credit ids, confidence, pass, candidate ids) of each decision of one world."""
    ss = sorted(settlements, key=lambda s: s["row_no"])
    rows = sorted(bank_rows, key=lambda r: r["row_no"])
    cs = [Credit(r) for r in rows if r["credit_paise"] > 0]
    net, out, s_done, c_done, pending = {s["settlement_id"]: s["amount_paise"] for s in ss}, [], set(), set(), []

    def tell(status, sids, tids, confidence, name, candidates=()):
        out.append((status, tuple(sids), tuple(tids), confidence, name, tuple(candidates)))
        s_done.update(sids)
        c_done.update(tids)

    refs = [(s, [c for c in cs if s["utr"] and s["utr"] in c.strip]) for s in ss]
    for s, mine in refs:
        sid = s["settlement_id"]
        mine = sorted(mine, key=lambda c: (c.day, c.tid))
        if len(mine) == 1:
            gap = mine[0].amount - net[sid]
            if gap == 0:
                tell("matched", [sid], [mine[0].tid], "exact", "pass1_exact_utr")
            elif gap in (-2950, -((net[sid] + 50) // 100)):
                tell("matched_with_discrepancy", [sid], [mine[0].tid], "high", "pass1_exact_utr")
            else:
                pending.append((s, mine[0]))
        elif mine and all(c.amount == net[sid] for c in mine):
            tell("matched", [sid], [mine[0].tid], "exact", "pass1_exact_utr")
            for c in mine[1:]:
                tell("duplicate_credit", [], [c.tid], "", "pass1_exact_utr", [sid])
        elif mine and sum(c.amount for c in mine) == net[sid]:
            tell("matched_split", [sid], [c.tid for c in mine], "high", "pass1_exact_utr")
        else:
            for c in mine:
                tell("ambiguous_abstain", [], [c.tid], "", "pass1_exact_utr", [sid])
    for s in ss:
        sid = s["settlement_id"]
        if sid not in s_done:
            hits = [c for c in cs if c.tid not in c_done and c.shaped and c.amount == net[sid] and damaged(s["utr"], c)]
            if len(hits) == 1:
                tell("matched", [sid], [hits[0].tid], "high", "pass2_fuzzy_utr")
    still = []
    for s, c in pending:
        sid = s["settlement_id"]
        if sid in s_done or c.tid in c_done:
            continue
        rest = c.amount - net[sid]
        partners = [x["settlement_id"] for x in ss if x["settlement_id"] not in s_done and x is not s and x["amount_paise"] == rest and fits(x, c, 3)]
        if rest > 0 and len(partners) == 1:
            tell("matched_merged", [sid, partners[0]], [c.tid], "high", "pass3_merge")
        elif rest > 0 and partners:
            tell("ambiguous_abstain", [], [c.tid], "", "pass3_merge", [sid, *partners])
        else:
            still.append((s, c))
    open_s, open_c = [s for s in ss if s["settlement_id"] not in s_done], [c for c in cs if c.tid not in c_done and c.shaped]
    of_s, of_c = defaultdict(list), defaultdict(list)
    for s in open_s:
        for c in open_c:
            if c.amount == s["amount_paise"] and fits(s, c):
                of_s[s["settlement_id"]].append(c.tid)
                of_c[c.tid].append(s["settlement_id"])
    for sid, tids in of_s.items():
        if len(tids) == 1 and len(of_c[tids[0]]) == 1:
            tell("matched", [sid], tids, "medium", "pass4_amount_unique")
    for sid, tids in of_s.items():
        if sid not in s_done:
            tell("ambiguous_abstain", [sid], [], "", "pass4_amount_unique", [*tids, *sorted({r for t in tids for r in of_c[t]} - {sid})])
    for tid, sids in of_c.items():
        if tid not in c_done:
            tell("ambiguous_abstain", [], [tid], "", "pass4_amount_unique", sids)
    for s, c in still:
        if s["settlement_id"] not in s_done and c.tid not in c_done:
            tell("matched_with_discrepancy", [s["settlement_id"]], [c.tid], "needs_review", "pass5_residuals")
    open_s, open_c = [s for s in ss if s["settlement_id"] not in s_done], [c for c in cs if c.tid not in c_done]
    for s in open_s:
        near = sorted((c for c in open_c if c.shaped and fits(s, c)), key=lambda c: abs(c.amount - s["amount_paise"]))[:3]
        tell("exception_missing_bank", [s["settlement_id"]], [], "", "pass5_residuals", [c.tid for c in near] or [""])
    for c in open_c:
        near = sorted(open_s, key=lambda s: abs(s["amount_paise"] - c.amount))[:3]
        if c.shaped:
            tell("exception_missing_settlement", [], [c.tid], "", "pass5_residuals", [s["settlement_id"] for s in near] or [""])
        else:
            tell("non_settlement_credit", [], [c.tid], "", "pass5_residuals")
    for r in rows:
        if r["credit_paise"] <= 0:
            tell("out_of_scope", [], [r["txn_id"]], "", "pass0_scope")
    return out
