"""DuckDB twins of the reconciliation queries, as named queries over the derived worlds.

They state the rules set by set, without the replay of colliding claims: the derived worlds have none, and the tests check the
replay against a plain sequential account on random small worlds.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from tallyforge.operators import explain
from tallyforge.plans import proposal_twins, statements
from tallyforge.sources.world import as_of_sql, hard_sql, tables_sql

FAMILY = "('matched', 'matched_split', 'matched_merged', 'matched_with_discrepancy')"


def _row(kind, status, sids, tids, rules, name, source, conf="''", exp="NULL", rec="NULL", disc="NULL", label="''", cands="''"):
    return (
        f"SELECT world_id, '{kind}' AS kind, '{status}' AS status, {sids} AS sids, {tids} AS tids, {conf} AS confidence, ({exp})::BIGINT AS expected_paise, ({rec})::BIGINT AS received_paise, "
        f"({disc})::BIGINT AS discrepancy_paise, {label} AS label, {rules} AS rules, {cands} AS candidates, '{name}' AS pass_name FROM {source}"
    )


#: The answers that the scenario classes imply for settlements; Spark and DuckDB evaluate them alike.
GOLDEN = """SELECT world_id, 'settlement' AS record_type, settlement_id AS record_id, CASE WHEN row_no % 24 IN (5, 6) THEN 'ambiguous_abstain' WHEN row_no % 24 = 15 THEN 'exception_missing_bank'
  WHEN row_no % 24 = 17 THEN 'matched_split' WHEN row_no % 24 IN (18, 19, 20) THEN 'matched_with_discrepancy' WHEN row_no % 24 IN (22, 23) THEN 'matched_merged' ELSE 'matched' END AS expected,
  CASE WHEN row_no % 24 = 15 THEN '' WHEN row_no % 24 = 17 THEN concat('BANK', lpad(cast(row_no * 4 as varchar(20)), 12, '0'), ';BANK', lpad(cast(row_no * 4 + 1 as varchar(20)), 12, '0'))
  WHEN row_no % 24 IN (6, 23) THEN concat('BANK', lpad(cast((row_no - 1) * 4 as varchar(20)), 12, '0')) ELSE concat('BANK', lpad(cast(row_no * 4 as varchar(20)), 12, '0')) END AS counterparties,
  concat('class_', lpad(cast(row_no % 24 as varchar(20)), 2, '0')) AS scenario FROM {settlements}"""

NONE = "[]::VARCHAR[]"
LATE = lambda *r: f"'utr_exact,{','.join(r)}' || CASE WHEN late THEN ',late_settlement' ELSE '' END"


def leg_a() -> dict[str, str]:
    named = {
        "s": "SELECT world_id, settlement_id AS sid, row_no AS s_no, amount_paise AS net, utr, created FROM settlements",
        "c0": """SELECT world_id, txn_id AS tid, row_no AS c_no, credit_paise AS amount, value_date, upper(concat(narration, ' ', ref_no)) AS blob,
  regexp_replace(upper(concat(narration, ref_no)), '[^A-Z0-9]', '', 'g') AS strip,
  list_distinct(list_filter(list_concat(regexp_extract_all(upper(narration), '[A-Z0-9]+'), regexp_extract_all(upper(ref_no), '[A-Z0-9]+')), lambda x: length(x) >= 10)) AS found FROM bank_rows WHERE credit_paise > 0""",
        "c": "SELECT *, regexp_matches(blob, 'RAZORPAY|RZPAY|RZP') OR len(list_filter(found, lambda x: regexp_full_match(x, '[A-Z]{4}[0-9]{12}'))) > 0 AS shaped FROM c0",
        "refs": "SELECT s.*, c.tid, c.amount, c.value_date FROM s JOIN c ON s.world_id = c.world_id AND contains(c.strip, s.utr)",
        "r1": """SELECT *, count(*) OVER w AS n, bool_and(amount = net) OVER w AS equal, sum(amount) OVER w AS total, row_number() OVER (PARTITION BY world_id, sid ORDER BY value_date, tid) AS turn,
  CASE WHEN amount - net = -2950 THEN 'bank_neft_rtgs_charge_incl_gst' WHEN amount - net = -((net + 50) // 100) THEN 'tds_1pct_of_net' END AS why,
  NOT (value_date - created BETWEEN 0 AND 10) AS late FROM refs WINDOW w AS (PARTITION BY world_id, sid)""",
        "split1": "SELECT world_id, sid, net, sum(amount) AS amount, list(tid ORDER BY value_date, tid) AS tids FROM r1 WHERE n > 1 AND NOT equal AND total = net GROUP BY ALL",
        "d1": "\n UNION ALL ".join([
            _row("match", "matched", "[sid]", "[tid]", LATE("amount_exact"), "pass1_exact_utr", "r1 WHERE n = 1 AND amount = net", "'exact'", "net", "amount", "0"),
            _row("match", "matched_with_discrepancy", "[sid]", "[tid]", LATE("decomposed_discrepancy"), "pass1_exact_utr", "r1 WHERE n = 1 AND amount <> net AND why IS NOT NULL", "'high'", "net", "amount", "amount - net", "why"),
            _row("match", "matched", "[sid]", "[tid]", "'utr_exact,amount_exact,earliest_value_date'", "pass1_exact_utr", "r1 WHERE n > 1 AND equal AND turn = 1", "'exact'", "net", "amount", "0"),
            _row("exception", "duplicate_credit", NONE, "[tid]", "'utr_exact,duplicate_posting'", "pass1_exact_utr", "r1 WHERE n > 1 AND equal AND turn > 1", rec="amount", cands="sid"),
            _row("match", "matched_split", "[sid]", "tids", "'utr_exact,sum_exact_parts'", "pass1_exact_utr", "split1", "'high'", "net", "amount", "0"),
            _row("exception", "ambiguous_abstain", NONE, "[tid]", "'utr_exact'", "pass1_exact_utr", "r1 WHERE n > 1 AND NOT equal AND total <> net", rec="amount", cands="sid"),
        ]),
        "pend1": "SELECT world_id, sid, s_no, net, tid, amount, value_date FROM r1 WHERE n = 1 AND amount <> net AND why IS NULL",
    }
    for k, before in (("1", ("s", "c")), ("2", ("s1", "c1")), ("3", ("s2", "c2")), ("4", ("s3", "c3"))):
        if k == "2":
            named["e2"] = """SELECT s.world_id, s.sid, s.net, c.tid, count(*) OVER (PARTITION BY s.world_id, s.sid) AS n FROM s1 s JOIN c1 c ON s.world_id = c.world_id AND s.net = c.amount AND c.shaped
  WHERE len(list_filter(c.found, lambda t: t <> s.utr AND ((length(t) >= 10 AND contains(s.utr, t)) OR (regexp_full_match(t, '[A-Z]{4}[0-9]{12}') AND length(t) = length(s.utr) AND levenshtein(t, s.utr) <= 1)))) > 0"""
            named["d2"] = _row("match", "matched", "[sid]", "[tid]", "'utr_fuzzy,amount_exact'", "pass2_fuzzy_utr", "e2 WHERE n = 1", "'high'", "net", "net", "0")
        if k == "3":
            named["alive3"] = "SELECT p.* FROM pend1 p SEMI JOIN s2 ON p.sid = s2.sid SEMI JOIN c2 ON p.tid = c2.tid"
            named["m3"] = """SELECT p.*, x.sid AS partner, x.net AS rest, x.s_no AS p_no, count(*) OVER (PARTITION BY p.world_id, p.sid) AS n FROM alive3 p JOIN s2 x
  ON p.world_id = x.world_id AND p.amount - p.net = x.net AND x.sid <> p.sid AND p.value_date - x.created BETWEEN 0 AND 13 WHERE p.amount > p.net"""
            named["t3"] = "SELECT world_id, sid, net, tid, amount, string_agg(partner, ';' ORDER BY p_no) AS ps FROM m3 WHERE n > 1 GROUP BY ALL"
            named["d3"] = (
                _row("match", "matched_merged", "[sid, partner]", "[tid]", "'utr_exact,merge_residual_exact'", "pass3_merge", "m3 WHERE n = 1", "'high'", "net + rest", "amount", "0")
                + " UNION ALL " + _row("exception", "ambiguous_abstain", NONE, "[tid]", "'utr_exact'", "pass3_merge", "t3", rec="amount", cands="sid || ';' || ps")
            )
            named["pend3"] = "SELECT * FROM alive3 WHERE sid NOT IN (SELECT sid FROM m3)"
        if k == "4":
            named["e4"] = """SELECT s.world_id, s.sid, s.s_no, c.tid, c.c_no, s.net, count(*) OVER (PARTITION BY s.sid) AS of_s, count(*) OVER (PARTITION BY c.tid) AS of_c
  FROM s3 s JOIN c3 c ON s.world_id = c.world_id AND s.net = c.amount AND c.shaped AND c.value_date - s.created BETWEEN 0 AND 10"""
            named["x4"] = "SELECT * FROM e4 WHERE of_s > 1 OR of_c > 1"
            named["v4"] = "SELECT a.sid, string_agg(DISTINCT b.sid, ';' ORDER BY b.sid) AS rivals FROM x4 a JOIN x4 b ON a.tid = b.tid AND a.sid <> b.sid GROUP BY ALL"
            named["s4"] = "SELECT x.world_id, x.sid, x.net, string_agg(x.tid, ';' ORDER BY x.c_no) || coalesce(';' || any_value(v.rivals), '') AS cs FROM x4 x LEFT JOIN v4 v ON x.sid = v.sid GROUP BY ALL"
            named["c4"] = "SELECT world_id, tid, net, string_agg(sid, ';' ORDER BY s_no) AS ss FROM x4 GROUP BY ALL"
            named["d4"] = " UNION ALL ".join([
                _row("match", "matched", "[sid]", "[tid]", "'amount_exact_unique,window'", "pass4_amount_unique", "e4 WHERE of_s = 1 AND of_c = 1", "'medium'", "net", "net", "0"),
                _row("exception", "ambiguous_abstain", "[sid]", NONE, "'amount_tie'", "pass4_amount_unique", "s4", exp="net", cands="cs"),
                _row("exception", "ambiguous_abstain", NONE, "[tid]", "'amount_tie'", "pass4_amount_unique", "c4", rec="net", cands="ss"),
            ])
        name_s, name_c = (f"{x}{k}" if k != "4" else f"{x}5" for x in "sc")
        old_s, old_c = before
        named[name_s] = f"SELECT * FROM {old_s} WHERE sid NOT IN (SELECT unnest(sids) FROM d{k})"
        named[name_c] = f"SELECT * FROM {old_c} WHERE tid NOT IN (SELECT unnest(tids) FROM d{k})"
    named["p5"] = "SELECT *, row_number() OVER (PARTITION BY tid ORDER BY s_no) AS turn FROM pend3 p SEMI JOIN s5 ON p.sid = s5.sid SEMI JOIN c5 ON p.tid = c5.tid"
    named["d5"] = _row("match", "matched_with_discrepancy", "[sid]", "[tid]", "'utr_exact,unexplained_residual'", "pass5_residuals", "p5 WHERE turn = 1", "'needs_review'", "net", "amount", "amount - net", "'unexplained'")
    named["s6"] = "SELECT * FROM s5 WHERE sid NOT IN (SELECT unnest(sids) FROM d5)"
    named["c6"] = "SELECT * FROM c5 WHERE tid NOT IN (SELECT unnest(tids) FROM d5)"
    named["n6"] = """SELECT s.sid, c.tid, row_number() OVER (PARTITION BY s.sid ORDER BY abs(c.amount - s.net), c.c_no) AS turn FROM s6 s JOIN c6 c ON s.world_id = c.world_id AND c.shaped AND c.value_date - s.created BETWEEN 0 AND 10"""
    named["l6"] = "SELECT s.*, coalesce(n.near, '') AS cs FROM s6 s LEFT JOIN (SELECT sid, string_agg(tid, ';' ORDER BY turn) AS near FROM n6 WHERE turn <= 3 GROUP BY ALL) n ON n.sid = s.sid"
    named["n7"] = "SELECT c.tid, s.sid, row_number() OVER (PARTITION BY c.tid ORDER BY abs(c.amount - s.net), s.s_no) AS turn FROM c6 c JOIN s6 s ON s.world_id = c.world_id WHERE c.shaped"
    named["l7"] = "SELECT c.*, coalesce(n.near, '') AS ss FROM c6 c LEFT JOIN (SELECT tid, string_agg(sid, ';' ORDER BY turn) AS near FROM n7 WHERE turn <= 3 GROUP BY ALL) n ON n.tid = c.tid"
    named["leg_a"] = "\n UNION ALL ".join([
        "SELECT * FROM d1", "SELECT * FROM d2", "SELECT * FROM d3", "SELECT * FROM d4", "SELECT * FROM d5",
        _row("exception", "exception_missing_bank", "[sid]", NONE, "'no_credit_found'", "pass5_residuals", "l6", exp="net", cands="cs"),
        _row("exception", "non_settlement_credit", NONE, "[tid]", "'not_settlement_shaped'", "pass5_residuals", "c6 WHERE NOT shaped", rec="amount"),
        _row("exception", "exception_missing_settlement", NONE, "[tid]", "'no_settlement_found'", "pass5_residuals", "l7 WHERE shaped", rec="amount", cands="ss"),
        _row("out_of_scope", "out_of_scope", NONE, "[txn_id]", "'debit'", "pass0_scope", "bank_rows WHERE credit_paise <= 0"),
    ])
    return named


def leg_b() -> dict[str, str]:
    return {
        "pb": """SELECT p.world_id, p.row_no, p.payment_id, p.order_id, p.amount_paise, p.status, o.amount_paise AS order_amount,
  first_value(CASE WHEN p.status = 'captured' THEN p.payment_id END) OVER (PARTITION BY p.world_id, p.order_id ORDER BY CASE WHEN p.status = 'captured' THEN 0 ELSE 1 END, p.created_s, p.payment_id) AS first_capture
  FROM payments p LEFT JOIN order_book o ON p.world_id = o.world_id AND p.order_id = o.order_id""",
        "pt": """SELECT *, CASE WHEN status = 'failed' THEN 'payment_failed' WHEN order_amount IS NULL THEN 'exception_payment_no_order' WHEN status = 'refunded' THEN 'payment_refunded'
  WHEN amount_paise <> order_amount THEN 'exception_amount_mismatch' WHEN first_capture <> payment_id THEN 'exception_duplicate_payment' ELSE 'payment_applied' END AS told FROM pb""",
        "po": """SELECT world_id, order_id, max(CASE WHEN told = 'payment_applied' THEN payment_id END) AS applied, min_by(payment_id, row_no) FILTER (told = 'exception_amount_mismatch') AS mismatched,
  max_by(payment_id, row_no) FILTER (told = 'payment_refunded') AS refunded FROM pt WHERE order_amount IS NOT NULL GROUP BY ALL""",
        "oo": "SELECT o.*, p.applied, p.mismatched, p.refunded FROM order_book o LEFT JOIN po p ON o.world_id = p.world_id AND o.order_id = p.order_id",
        "leg_b": """SELECT world_id, 'payment' AS record_type, payment_id AS record_id, told AS status, CASE WHEN order_amount IS NULL THEN '' ELSE order_id END AS other,
  CASE told WHEN 'exception_duplicate_payment' THEN first_capture ELSE '' END AS candidates FROM pt
  UNION ALL SELECT world_id, 'order', order_id, CASE WHEN status = 'cancelled' THEN 'order_cancelled' WHEN applied IS NOT NULL THEN 'order_paid' WHEN mismatched IS NOT NULL THEN 'exception_amount_mismatch'
  WHEN refunded IS NOT NULL THEN 'order_refunded' ELSE 'exception_unpaid_order' END, CASE WHEN status = 'cancelled' THEN '' ELSE coalesce(applied, mismatched, refunded, '') END, '' FROM oo""",
    }


def journeys() -> dict[str, str]:
    return {
        "last_a": """SELECT world_id, sid, status, array_to_string(tids, ';') AS tids FROM (SELECT world_id, unnest(sids) AS sid, status, tids, pass_name FROM leg_a)
  QUALIFY row_number() OVER (PARTITION BY world_id, sid ORDER BY pass_name DESC, array_to_string(tids, ';')) = 1""",
        "j0": """SELECT o.world_id, o.order_id, o.receipt, o.amount_paise AS order_amount_paise, b.status AS order_status, b.other AS payment_id,
  CASE WHEN b.status = 'order_paid' THEN coalesce(p.settlement_id, '') ELSE '' END AS settlement_id
  FROM order_book o JOIN leg_b b ON b.record_type = 'order' AND o.order_id = b.record_id LEFT JOIN payments p ON p.payment_id = b.other""",
        "journeys": f"""SELECT j.*, CASE WHEN j.settlement_id <> '' THEN coalesce(a.status, 'unassessed') ELSE '' END AS settlement_status, coalesce(a.tids, '') AS bank_txn_ids,
  CASE WHEN order_status IN ('order_cancelled', 'order_refunded') THEN '' WHEN order_status = 'exception_unpaid_order' THEN 'never paid' WHEN order_status = 'exception_amount_mismatch' THEN 'payment amount differs from order'
  WHEN j.settlement_id = '' THEN 'captured but not yet settled' WHEN a.status IS NULL THEN 'settlement not assessed' WHEN a.status IN {FAMILY} THEN '' WHEN a.status = 'exception_missing_bank' THEN 'settlement never hit the bank'
  WHEN a.status = 'ambiguous_abstain' THEN 'bank credit ambiguous - needs review' ELSE 'settlement issue: ' || a.status END AS first_break
  FROM j0 j LEFT JOIN last_a a ON j.world_id = a.world_id AND j.settlement_id = a.sid""",
    }


SEVERITY = "CASE WHEN status IN ('exception_missing_bank', 'duplicate_credit') THEN 1 WHEN status IN ('ambiguous_abstain', 'exception_missing_settlement', 'exception_amount_mismatch', 'exception_duplicate_payment') THEN 2 WHEN status IN ('needs_review', 'exception_unpaid_order', 'exception_payment_no_order') THEN 3 END"


def queue() -> dict[str, str]:
    return {
        "dates": "SELECT world_id, max(value_date) AS close_date FROM bank_rows GROUP BY ALL",
        "overdue": """SELECT s.world_id, s.settlement_id, s.amount_paise, CASE WHEN isodow(s.settled) = 7 THEN s.settled + 1 ELSE s.settled END AS expected_date, d.close_date
  FROM settlements s JOIN dates d ON s.world_id = d.world_id JOIN last_a a ON s.world_id = a.world_id AND s.settlement_id = a.sid
  WHERE a.status IN ('exception_missing_bank', 'ambiguous_abstain') AND s.created <= d.close_date AND CASE WHEN isodow(s.settled) = 7 THEN s.settled + 1 ELSE s.settled END <= d.close_date""",
        "od": "SELECT settlement_id, min(expected_date) AS due, max(close_date - expected_date)::INTEGER AS days FROM overdue GROUP BY ALL",
        "qa0": f"SELECT *, CASE WHEN status IN {FAMILY} AND confidence = 'needs_review' THEN 'needs_review' ELSE status END AS shown FROM leg_a",
        "qa": f"""SELECT q.world_id, 'recon_leg_a' AS source, q.shown AS status, {SEVERITY.replace('status', 'q.shown')} AS severity,
  coalesce(CASE WHEN q.shown = 'exception_missing_bank' THEN expected_paise WHEN q.shown IN ('duplicate_credit', 'exception_missing_settlement') THEN received_paise WHEN q.shown = 'ambiguous_abstain' THEN coalesce(expected_paise, received_paise) ELSE abs(discrepancy_paise) END, 0) AS money_at_risk_paise,
  list_concat(sids, tids) AS ids, least(a.due, b.due) AS due_date, greatest(a.days, b.days) AS days_overdue
  FROM qa0 q LEFT JOIN od a ON a.settlement_id = q.sids[1] LEFT JOIN od b ON b.settlement_id = q.sids[2] WHERE {SEVERITY.replace('status', 'q.shown')} IS NOT NULL""",
        "half": """SELECT b.world_id, b.record_id AS order_id, p.amount_paise AS paid, p.payment_id FROM leg_b b LEFT JOIN (SELECT x.record_id, y.amount_paise, y.payment_id FROM leg_b x JOIN payments y ON x.record_id = y.payment_id WHERE x.status = 'exception_amount_mismatch') p ON b.other = p.payment_id
  WHERE b.status = 'exception_amount_mismatch' AND b.record_type = 'order'""",
        "qb": f"""SELECT h.world_id, 'recon_leg_b' AS source, 'exception_amount_mismatch' AS status, 2 AS severity, abs(coalesce(h.paid, 0) - o.amount_paise) AS money_at_risk_paise, list_filter([h.order_id, h.payment_id], lambda x: x IS NOT NULL) AS ids, NULL::DATE AS due_date, NULL::INTEGER AS days_overdue
  FROM half h JOIN order_book o ON h.order_id = o.order_id
  UNION ALL SELECT b.world_id, 'recon_leg_b', b.status, {SEVERITY.replace('status', 'b.status')}, coalesce(CASE WHEN b.status = 'exception_unpaid_order' THEN o.amount_paise ELSE p.amount_paise END, 0), list_filter([b.record_id, b.other], lambda x: x <> ''), NULL, NULL
  FROM leg_b b LEFT JOIN order_book o ON b.record_id = o.order_id LEFT JOIN payments p ON b.record_id = p.payment_id
  WHERE {SEVERITY.replace('status', 'b.status')} IS NOT NULL AND NOT (b.status = 'exception_amount_mismatch' AND (b.record_type = 'order' OR b.record_id IN (SELECT payment_id FROM half WHERE payment_id IS NOT NULL)))""",
        "queue": "SELECT *, substr(sha1(source || '|' || array_to_string(list_sort(ids), '|')), 1, 12) AS item_id FROM (SELECT * FROM qa UNION ALL SELECT * FROM qb)",
        "actions": """SELECT q.item_id, e.event_id AS seq, CASE e.event_type WHEN 'purchase' THEN 'resolve' WHEN 'click' THEN 'assign' WHEN 'error' THEN 'snooze' ELSE 'note' END AS action, 'user_' || e.user_id::VARCHAR AS actor,
  'note ' || e.event_id::VARCHAR AS note, CASE WHEN e.event_id % 5 = 0 THEN 'stale' ELSE q.status END AS status_at_action FROM events e JOIN queue q ON q.item_id = substr(sha1('recon_leg_b|order_' || lpad((e.event_id // 13 * 20 + 3)::VARCHAR, 14, '0')), 1, 12)""",
        "folded": """SELECT item_id, coalesce(max_by(action, seq) FILTER (action <> 'note'), 'open') AS last_action, max_by(actor, seq) FILTER (action = 'assign') AS assignee, max_by(note, seq) FILTER (action = 'note') AS last_note,
  max_by(status_at_action, seq) AS seen_status, count(*) AS n_actions FROM actions GROUP BY ALL""",
        "overlaid": """SELECT q.*, CASE WHEN f.last_action = 'resolve' AND f.seen_status = q.status THEN 'resolved' WHEN f.last_action = 'assign' THEN 'assigned' WHEN f.last_action = 'snooze' THEN 'snoozed' ELSE 'open' END AS workflow, f.assignee, f.last_note,
  coalesce(f.last_action = 'resolve' AND f.seen_status <> q.status, false) AS reopened FROM queue q LEFT JOIN folded f ON q.item_id = f.item_id""",
    }


def _served(name: str, wants: str) -> dict[str, str]:
    """Credits served in order: each takes the best of its settlements that no earlier one took. ``wants`` has world_id, tid, c_no, sid, r1, r2."""
    return {
        f"{name}_w": f"""SELECT world_id, tid, row_number() OVER (PARTITION BY world_id ORDER BY c_no) AS n, cs FROM
  (SELECT world_id, tid, c_no, list(sid ORDER BY r1, r2) AS cs FROM ({wants}) GROUP BY ALL)""",
        f"{name}_go": f"""SELECT DISTINCT world_id, 0::BIGINT AS n, []::VARCHAR[] AS taken, NULL::VARCHAR AS tid, NULL::VARCHAR AS sid FROM {name}_w
  UNION ALL SELECT world_id, n, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END, tid, pick
  FROM (SELECT g.world_id, w.n, g.taken, w.tid, list_filter(w.cs, lambda x: NOT list_contains(g.taken, x))[1] AS pick FROM {name}_go g JOIN {name}_w w ON w.world_id = g.world_id AND w.n = g.n + 1)""",
        name: f"SELECT g.world_id, c.tid, s.sid, s.net, c.amount FROM {name}_go g JOIN bs s ON g.sid = s.sid JOIN bc c ON g.tid = c.tid",
    }


def _left_over(name: str, matched: str) -> str:
    return " UNION ALL ".join([
        _row("exception", "exception_missing_settlement", NONE, "[tid]", "'no_candidate'", name, f"bc WHERE tid NOT IN (SELECT tid FROM {matched})", rec="amount"),
        _row("exception", "exception_missing_bank", "[sid]", NONE, "'no_candidate'", name, f"bs WHERE sid NOT IN (SELECT sid FROM {matched})", exp="net"),
        _row("out_of_scope", "out_of_scope", NONE, "[txn_id]", "''", "scope", "bank_rows WHERE credit_paise <= 0"),
    ])


def baselines() -> dict[str, str]:
    gap = "amount - net"
    return {
        "bs": "SELECT world_id, settlement_id AS sid, row_no AS s_no, amount_paise AS net, utr, created, settled FROM settlements",
        "bc": "SELECT world_id, txn_id AS tid, row_no AS c_no, credit_paise AS amount, value_date, upper(narration || ' ' || ref_no) AS text FROM bank_rows WHERE credit_paise > 0",
    } | _served("nv", """SELECT c.world_id, tid, c_no, sid, abs(amount - net) AS r1, s_no AS r2 FROM bc c JOIN bs s ON c.world_id = s.world_id
  AND amount BETWEEN net - 100 AND net + 100 AND value_date BETWEEN settled - 3 AND settled + 3""") | {
        "naive": _row("match", "matched", "[sid]", "[tid]", "'amount_within_rs1_and_3_days'", "naive", "nv", "'medium'", "net", "amount", gap) + " UNION ALL " + _left_over("naive", "nv"),
    } | _served("br", "SELECT c.world_id, tid, c_no, sid, s_no AS r1, 0 AS r2 FROM bc c JOIN bs s ON c.world_id = s.world_id AND utr <> '' AND contains(text, upper(utr))") | _served(
        "ba", """SELECT c.world_id, tid, c_no, sid, created - DATE '1970-01-01' AS r1, s_no AS r2 FROM bc c JOIN bs s ON c.world_id = s.world_id AND amount = net AND value_date - created BETWEEN 0 AND 10
  WHERE tid NOT IN (SELECT tid FROM br) AND sid NOT IN (SELECT sid FROM br)"""
    ) | {
        "br_ba": "SELECT sid, tid FROM br UNION ALL SELECT sid, tid FROM ba",
        "by_reference": " UNION ALL ".join([
            _row("match", "matched", "[sid]", "[tid]", "'utr_exact'", "utr_then_amount", f"br WHERE {gap} = 0", "'exact'", "net", "amount", gap),
            _row("match", "matched_with_discrepancy", "[sid]", "[tid]", "'utr_exact'", "utr_then_amount", f"br WHERE {gap} <> 0", "'needs_review'", "net", "amount", gap, "'unexplained'"),
            _row("match", "matched", "[sid]", "[tid]", "'amount_exact_first_come'", "utr_then_amount", "ba", "'medium'", "net", "amount", "0"),
            _left_over("utr_then_amount", "br_ba"),
        ]),
    }


def damaged() -> dict[str, str]:
    """Decisions and a queue with the faults that the catalogue puts into its own, and all records' amounts."""
    h = "CASE WHEN kind = 'match' THEN right(sids[1], 6)::INTEGER % 40 ELSE -1 END"
    return {
        "ks": "SELECT world_id, settlement_id AS id, amount_paise AS amount FROM settlements",
        "kc": "SELECT world_id, txn_id AS id, credit_paise AS amount FROM bank_rows WHERE credit_paise > 0",
        "dd": f"""SELECT world_id, kind, status, CASE WHEN h = 6 THEN ['setl_unknown'] ELSE sids END AS sids, CASE WHEN h = 7 THEN list_concat(tids, tids) ELSE tids END AS tids, CASE WHEN h = 4 THEN 'sure' ELSE confidence END AS confidence,
  expected_paise + CASE WHEN h = 0 THEN 1 ELSE 0 END AS expected_paise, received_paise - CASE WHEN h = 1 THEN 1 ELSE 0 END AS received_paise, discrepancy_paise + CASE WHEN h = 2 THEN 5 ELSE 0 END AS discrepancy_paise,
  discrepancy_paise AS told_paise, label, CASE WHEN h = 5 THEN '' ELSE rules END AS rules, status = 'duplicate_credit' AND right(tids[1], 6)::INTEGER % 3 = 0 AS bare, pass_name FROM (SELECT *, {h} AS h FROM leg_a) WHERE h <> 3""",
        "qd0": "SELECT world_id, source, status, severity + CASE WHEN h = 1 THEN 1 ELSE 0 END AS severity, CASE WHEN h = 3 THEN money_at_risk_paise // 2 ELSE money_at_risk_paise END AS money_at_risk_paise, CASE WHEN h = 4 THEN list_append(ids, 'zzz') ELSE ids END AS ids, h FROM (SELECT *, ('0x' || substr(item_id, 1, 2))::INTEGER AS h FROM queue) WHERE h <> 0",
        "qd": "SELECT * FROM qd0 UNION ALL SELECT * FROM qd0 WHERE h = 2",
        "broken_q": broken_queue("qd").removeprefix("WITH RECURSIVE ").join(("WITH ", "")),
        "broken_dd": broken_decisions("dd").removeprefix("WITH RECURSIVE ").join(("WITH ", "")),
    }


def broken_decisions(decisions: str) -> str:
    """Violated invariants of the named decisions."""
    extra = "*" if decisions == "dd" else "*, discrepancy_paise AS told_paise, false AS bare"
    out = ["""WITH RECURSIVE d AS (SELECT *, concat_ws('|', pass_name, status, array_to_string(sids, ';'), array_to_string(tids, ';')) AS key FROM (SELECT """ + extra + f""" FROM {decisions})),
ns AS (SELECT world_id, key, status, unnest(sids) AS id FROM d), nc AS (SELECT world_id, key, status, unnest(tids) AS id FROM d),
m AS (SELECT d.*, coalesce(x.total, 0) AS es, coalesce(y.total, 0) AS rs, string_split(rules, ',') AS rl FROM d
  LEFT JOIN (SELECT key, sum(amount) AS total FROM ns JOIN ks ON ns.id = ks.id GROUP BY ALL) x ON d.key = x.key LEFT JOIN (SELECT key, sum(amount) AS total FROM nc JOIN kc ON nc.id = kc.id GROUP BY ALL) y ON d.key = y.key WHERE status IN """ + FAMILY + ")"]  # fmt: skip
    told = []
    for known, named, name in (("ks", "ns", "settlement"), ("kc", "nc", "credit")):
        told.append(f"SELECT world_id, 'unknown_{name}' AS code, id AS record FROM {named} WHERE status <> 'out_of_scope' AND id NOT IN (SELECT id FROM {known})")
        told.append(f"SELECT world_id, '{name}_claimed_twice', id FROM {named} WHERE id IN (SELECT id FROM {known}) GROUP BY ALL HAVING count(*) > 1")
        told.append(f"SELECT world_id, '{name}_uncovered', id FROM {known} WHERE id NOT IN (SELECT id FROM {named})")
    backed = " OR ".join(f"(confidence = '{c}' AND NOT list_has_any(rl, {e}))" for c, e in {"exact": ["utr_exact"], "high": ["utr_fuzzy", "decomposed_discrepancy", "sum_exact_parts", "merge_residual_exact"], "medium": ["amount_exact_unique", "amount_within_rs1_and_3_days", "amount_exact_first_come"]}.items())
    for code, wrong in {
        "expected_sum": "expected_paise <> es", "received_sum": "received_paise <> rs", "discrepancy": "discrepancy_paise <> rs - es", "breakdown": "label <> '' AND told_paise <> discrepancy_paise", "no_evidence": "rules = ''",
        "unknown_confidence": "confidence NOT IN ('exact', 'high', 'medium', 'needs_review')", "unbacked_confidence": backed, "exact_with_discrepancy": "confidence = 'exact' AND discrepancy_paise <> 0",
    }.items():
        told.append(f"SELECT world_id, '{code}', key FROM m WHERE {wrong}")
    told.append("SELECT world_id, 'no_candidates', key FROM d WHERE bare")
    return out[0] + "\n" + " UNION ALL ".join(told)


def broken_queue(shown: str) -> str:
    """How the named queue departs from the true one."""
    unit = "status || ':' || array_to_string(list_sort(ids), ';')"
    joined = "array_to_string(list_sort({0}), ';')"
    mismatch = "status = 'exception_amount_mismatch'"
    return f"""WITH RECURSIVE due_a AS (SELECT * FROM (SELECT world_id, CASE WHEN confidence = 'needs_review' THEN 'needs_review' ELSE status END AS status, {joined.format('list_concat(sids, tids)')} AS unit, unnest(list_concat(sids, tids)) AS id FROM leg_a) WHERE {SEVERITY} IS NOT NULL),
sums_a AS (SELECT d.world_id, d.status, d.unit, sum(x.amount) AS s, sum(y.amount) AS c, count(*) // count(DISTINCT d.id) AS n FROM due_a d LEFT JOIN ks x ON x.id = d.id LEFT JOIN kc y ON y.id = d.id GROUP BY ALL),
mixed AS (SELECT world_id, record_id AS o, other AS p FROM leg_b WHERE {mismatch} AND record_type = 'order'),
due_b AS (SELECT m.world_id, '{mismatch.split("'")[1]}' AS status, {joined.format("list_filter([m.o, m.p], lambda x: x <> '')")} AS unit, abs(coalesce(p.amount_paise, 0) - o.amount_paise) AS money FROM mixed m JOIN order_book o ON o.order_id = m.o LEFT JOIN payments p ON p.payment_id = m.p
  UNION ALL SELECT b.world_id, b.status, {joined.format("list_filter([b.record_id, b.other], lambda x: x <> '')")}, coalesce(o.amount_paise, p.amount_paise) FROM leg_b b LEFT JOIN order_book o ON o.order_id = b.record_id AND b.record_type = 'order' LEFT JOIN payments p ON p.payment_id = b.record_id
  WHERE {SEVERITY.replace('status', 'b.status')} IS NOT NULL AND NOT (b.{mismatch} AND b.record_type = 'order') AND b.record_id NOT IN (SELECT p FROM mixed)),
due AS (SELECT world_id, status || ':' || unit AS record, status, n, CASE status WHEN 'needs_review' THEN abs(c - s) WHEN 'exception_missing_bank' THEN s WHEN 'ambiguous_abstain' THEN coalesce(s, c) ELSE c END AS money FROM sums_a
  UNION ALL SELECT world_id, status || ':' || unit, status, count(*), sum(money) FROM due_b GROUP BY ALL),
there AS (SELECT world_id, {unit} AS record, status, count(*) AS n, sum(money_at_risk_paise) AS money, max(severity) AS severity FROM {shown} GROUP BY ALL),
pairs AS (SELECT coalesce(d.world_id, t.world_id) AS world_id, coalesce(d.record, t.record) AS record, d.n AS due, t.n AS shown, d.money AS due_money, t.money, t.severity, coalesce(d.status, t.status) AS status
  FROM due d FULL OUTER JOIN there t ON d.world_id = t.world_id AND d.record = t.record)
SELECT world_id, 'missing_item' AS code, record FROM pairs WHERE shown IS NULL UNION ALL SELECT world_id, 'unfounded_item', record FROM pairs WHERE due IS NULL UNION ALL SELECT world_id, 'item_count', record FROM pairs WHERE shown <> due
UNION ALL SELECT world_id, 'severity', record FROM pairs WHERE severity <> {SEVERITY} UNION ALL SELECT world_id, 'money', record FROM pairs WHERE money <> due_money"""


QUEUE_ORDER = """SELECT world_id, 'order' AS code, place::VARCHAR AS record FROM (SELECT *, lag(rank) OVER (PARTITION BY world_id ORDER BY place) AS above FROM (
  SELECT world_id, place * 10 + CASE WHEN place % 50 = 0 THEN 35 ELSE 0 END AS place, (severity, -money_at_risk_paise, source, status, ids[1]) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY world_id ORDER BY severity, money_at_risk_paise DESC, source, status, ids[1]) AS place FROM queue))) WHERE above > rank"""


#: Labels for the queue by scenario class; Spark and DuckDB evaluate them alike.
GOLDEN_QUEUE = """SELECT world_id, CASE WHEN row_no % 24 = 15 THEN 'exception_missing_bank' ELSE 'ambiguous_abstain' END AS status, settlement_id AS record_id, amount_paise AS stake_paise FROM {s} WHERE row_no % 24 IN (5, 6, 15)
UNION ALL SELECT world_id, CASE WHEN row_no % 4 = 1 THEN 'duplicate_credit' ELSE 'exception_missing_settlement' END, txn_id, credit_paise FROM {b} WHERE (row_no % 96 = 65) OR (row_no % 96 = 35)
UNION ALL SELECT world_id, CASE WHEN row_no % 20 = 7 THEN 'exception_amount_mismatch' ELSE 'exception_unpaid_order' END, order_id, CASE WHEN row_no % 20 = 7 THEN 100 ELSE amount_paise END FROM {o} WHERE row_no % 20 IN (3, 7, 9)
UNION ALL SELECT world_id, CASE WHEN row_no % 80 = 26 THEN 'exception_duplicate_payment' ELSE 'exception_payment_no_order' END, payment_id, amount_paise FROM {p} WHERE row_no % 80 IN (26, 36)"""

#: The answers for orders and payments by scenario class.
GOLDEN_B = """SELECT world_id, 'order' AS record_type, order_id AS record_id, CASE row_no % 20 WHEN 4 THEN 'order_cancelled' WHEN 7 THEN 'exception_amount_mismatch' WHEN 8 THEN 'order_refunded' WHEN 3 THEN 'exception_unpaid_order' WHEN 9 THEN 'exception_unpaid_order' ELSE 'order_paid' END AS expected,
  CASE WHEN row_no % 20 IN (3, 4, 9) THEN '' ELSE concat('pay_', lpad(cast(row_no * 4 as varchar(20)), 14, '0')) END AS counterparties, concat('class_', lpad(cast(row_no % 20 as varchar(20)), 2, '0')) AS scenario FROM {o}
UNION ALL SELECT world_id, 'payment', payment_id, CASE WHEN row_no % 4 = 1 THEN 'payment_failed' WHEN row_no % 4 = 2 THEN 'exception_duplicate_payment' WHEN row_no % 80 = 28 THEN 'exception_amount_mismatch' WHEN row_no % 80 = 32 THEN 'payment_refunded' WHEN row_no % 80 = 36 THEN 'exception_payment_no_order' ELSE 'payment_applied' END,
  CASE WHEN row_no % 80 = 36 THEN '' ELSE order_id END, concat('class_', lpad(cast(cast(floor(row_no / 4) as bigint) % 20 as varchar(20)), 2, '0')) FROM {p}"""

_RANGED = """SELECT world_id, 'wide' AS question, CASE WHEN world_id % 2 = 0 THEN close_date - INTERVAL 60 DAY ELSE close_date END AS date_from, CASE WHEN world_id % 2 = 0 THEN close_date ELSE close_date - INTERVAL 60 DAY END AS date_to, 0 AS least_paise, 0 AS most_paise, '' AS contains FROM {dates}
UNION ALL SELECT world_id, 'named', close_date - INTERVAL 25 DAY, close_date, 50000000, 900000000, ' hdfc ' FROM {dates} UNION ALL SELECT world_id, 'capped', close_date - INTERVAL 20 DAY, close_date - INTERVAL 1 DAY, 0, 100000000000, 'r' FROM {dates}"""
_NUMBER = "concat('{name}', lpad(cast(world_id * {step} + {plus} as varchar(20)), {width}, '0'))"
#: Questions that Spark asks of its worlds; DuckDB asks the same.
QUESTIONS = {
    "ranged": f"SELECT world_id, question, cast(date_from as date) AS date_from, cast(date_to as date) AS date_to, least_paise, most_paise, contains FROM ({_RANGED})",
    "named": " UNION ALL ".join(f"SELECT world_id, 'n{k}' AS question, {_NUMBER.format(name='BANK', step=960, plus=p, width=12)} AS record_id FROM {{dates}}" for k, p in enumerate((0, 21, 57, 3))),
    "needles": f"SELECT world_id, 'settlement' AS question, {_NUMBER.format(name='setl_', step=240, plus=6, width=12)} AS needle FROM {{dates}} UNION ALL SELECT world_id, 'many', 'window' FROM {{dates}} UNION ALL SELECT world_id, 'order', {_NUMBER.format(name='order_', step=1920, plus=6, width=14)} FROM {{dates}}",
    "windows": "SELECT world_id, 'near' AS question, close_date AS around, 3 AS before, -4 AS after FROM {dates} UNION ALL SELECT world_id, 'far', cast(close_date - INTERVAL 40 DAY as date), 25, 25 FROM {dates}",
}


def asked(part: str) -> str:
    return QUESTIONS[part].replace("{dates}", "dates")


def searches() -> dict[str, str]:
    return {
        "claimed": "SELECT world_id, unnest(list_concat(sids, tids)) AS record_id FROM leg_a WHERE kind = 'match' AND confidence <> 'needs_review'",
        "so": "SELECT world_id, settlement_id AS record_id, created AS day, amount_paise, settlement_id || ' ' || utr AS text FROM settlements WHERE settlement_id NOT IN (SELECT record_id FROM claimed)",
        "ca": "SELECT world_id, txn_id AS record_id, value_date AS day, credit_paise AS amount_paise, narration || ' ' || ref_no AS text FROM bank_rows WHERE credit_paise > 0",
        "co": "SELECT * FROM ca WHERE record_id NOT IN (SELECT record_id FROM claimed)",
        "mb": "SELECT world_id, s.settlement_id AS question, s.created AS anchor FROM (SELECT unnest(sids) AS sid FROM leg_a WHERE status = 'exception_missing_bank') x JOIN settlements s ON s.settlement_id = x.sid",
    }


def _capped(order: str, most: int, columns: str, hits: str) -> str:
    return f"SELECT world_id, question, {columns}, place::INTEGER AS place, n > {most} AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY world_id, question ORDER BY {order}) AS place, count(*) OVER (PARTITION BY world_id, question) AS n FROM ({hits})) WHERE place <= {most}"


def ranged(rows: str) -> str:
    return _capped("day, record_id", 40, "record_id, day, amount_paise", f"""SELECT q.world_id, q.question, r.record_id, r.day, r.amount_paise FROM (SELECT *, least(date_from, date_to) AS low, greatest(date_from, date_to) AS high FROM ({asked('ranged')})) q
  JOIN {rows} r ON q.world_id = r.world_id AND r.day BETWEEN low AND least(high, low + 31) WHERE (least_paise = 0 OR amount_paise >= least_paise) AND (most_paise = 0 OR amount_paise <= most_paise) AND contains(upper(text), upper(trim(q.contains)))""")


LOOKED_UP = f"SELECT q.world_id, q.question, q.record_id, c.day, c.amount_paise, c.text, c.record_id IS NOT NULL AS known, q.record_id IN (SELECT record_id FROM claimed) AS claimed FROM ({asked('named')}) q LEFT JOIN ca c ON q.record_id = c.record_id AND q.world_id = c.world_id"
WINDOWS = _capped("row_no", 40, "txn_id, day, narration, debit_paise, credit_paise", f"""SELECT q.world_id, question, txn_id, value_date AS day, narration, debit_paise, credit_paise, row_no FROM ({asked('windows')}) q JOIN bank_rows b ON q.world_id = b.world_id
  AND value_date BETWEEN around - least(greatest(before, 0), 10) AND around + least(greatest(after, 0), 10)""")
MENTIONS = _capped("pool, records, status", 5, "pool, status, records", f"""SELECT q.world_id, question, pool, status, records FROM ({asked('needles')}) q JOIN (
  SELECT world_id, 'leg_a' AS pool, status, array_to_string(list_concat(sids, tids), ';') AS records, array_to_string(list_concat(sids, tids), ' ') || ' ' || rules || ' ' || candidates AS text FROM leg_a
  UNION ALL SELECT world_id, 'leg_b', status, record_id, record_id || ' ' || other || ' ' || candidates FROM leg_b) d ON q.world_id = d.world_id AND contains(text, needle)""")
CONTEXT = " UNION ALL ".join([
    f"SELECT world_id, question, kind, record_id, day, amount_paise, place, truncated FROM ({_capped('day, record_id', 40, 'kind, record_id, day, amount_paise', hits)})"
    for hits in (
        "SELECT i.world_id, i.question, 'settlement' AS kind, record_id, day, amount_paise FROM mb i JOIN so r ON i.world_id = r.world_id AND day BETWEEN anchor - 5 AND anchor + 5",
        "SELECT i.world_id, i.question, 'credit' AS kind, record_id, day, amount_paise FROM mb i JOIN co r ON i.world_id = r.world_id AND day BETWEEN anchor AND anchor + 10",
    )
])


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rupees(n: str) -> str:
    """Rupee text with lakh grouping, digit pairs from the right after the last three."""
    w = f"(abs({n}) // 100)::VARCHAR"
    pairs = f"array_to_string(list_reverse(list_transform(range(0, (length({w}) - 2) // 2), lambda i: reverse(substr(reverse({w}), (4 + 2 * i)::INTEGER, 2)))), ',')"
    return f"coalesce('Rs ' || CASE WHEN {n} < 0 THEN '-' ELSE '' END || CASE WHEN length({w}) <= 3 THEN {w} ELSE {pairs} || ',' || right({w}, 3) END || '.' || lpad((abs({n}) % 100)::VARCHAR, 2, '0'), '?')"


def explanation() -> str:
    known = "list_filter(string_split(candidates, ';'), lambda x: x <> '')"
    first = "CASE WHEN split_part(candidates, ';', 1) <> '' THEN ' Closest: ' || split_part(candidates, ';', 1) || '.' ELSE '' END"
    fields = {
        "settlement": "coalesce(sids[1], '')", "credit": "coalesce(tids[1], '')", "received": _rupees("received_paise"), "expected": _rupees("expected_paise"), "gap": _rupees("discrepancy_paise"), "confidence": "confidence",
        "n_credits": "len(tids)::VARCHAR", "n_settlements": "len(sids)::VARCHAR", "names": f"coalesce(array_to_string({known}, ', '), '')", "label": "label",
        "rules": "array_to_string(string_split(rules, ',')[1:3], '; ')", "nearest": first,
    }
    text = lambda t: " || ".join(fields[p] if is_field else quoted(p) for is_field, p in explain.pieces(t))
    return "CASE status " + " ".join(f"WHEN '{k}' THEN {text(t)}" for k, t in explain.EXPLANATIONS.items()) + " END"


def title(status: str) -> str:
    """An item's title by its status."""
    return f"CASE {status} " + " ".join(f"WHEN '{k}' THEN {quoted(t[0])}" for k, t in explain.TITLES.items()) + " END"


def queue_texts() -> str:
    pick = lambda k: "CASE s " + " ".join(f"WHEN '{status}' THEN {quoted(t[k])}" for status, t in explain.TITLES.items()) + " END"
    rules = {"exception_unpaid_order": "no_capture", "exception_amount_mismatch": "amount_mismatch", "exception_duplicate_payment": "duplicate_capture", "exception_payment_no_order": "unknown_order"}
    rule = "CASE q.status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.items()) + " END"
    known = "coalesce(array_to_string(list_filter(string_split({c}, ';'), lambda x: x <> ''), ';'), '')"
    a = f"SELECT world_id, item_of AS item_id, s, {explanation()} AS detail, rules AS evidence, {known.format(c='candidates')} AS candidates FROM (SELECT *, {SHOWN} AS s, substr(sha1('recon_leg_a|' || array_to_string(list_sort(list_concat(sids, tids)), '|')), 1, 12) AS item_of FROM leg_a) WHERE {SEVERITY.replace('status', 's')} IS NOT NULL"
    b = f"SELECT q.world_id, q.item_id, q.status AS s, {rule} AS detail, {rule} AS evidence, coalesce(b.candidates, '') AS candidates FROM queue q LEFT JOIN leg_b b ON q.ids[1] = b.record_id AND q.world_id = b.world_id WHERE q.source = 'recon_leg_b'"
    return f"SELECT world_id, item_id, {pick(0)} AS title, {pick(1)} AS suggested_action, detail, evidence, candidates FROM ({a} UNION ALL {b})"


SHOWN = f"CASE WHEN status IN {FAMILY} AND confidence = 'needs_review' THEN 'needs_review' ELSE status END"


def audits() -> dict[str, str]:
    """The naive matcher's queue, and the systems' answers to the golden rows."""
    naive = queue()["qa"].replace("qa0 q", "nqa0 q").replace("LEFT JOIN od a ON a.settlement_id = q.sids[1] LEFT JOIN od b ON b.settlement_id = q.sids[2]", "").replace("least(a.due, b.due)", "NULL::DATE").replace("greatest(a.days, b.days)", "NULL::INTEGER")
    system = lambda name, d: f"""SELECT '{name}' AS system, world_id, sid, kind, ms, tier, explained FROM (SELECT world_id, unnest(sids) AS sid, list_sort(list_concat(sids, tids)) AS ms, confidence AS tier, pass_name, status,
  CASE WHEN status IN {FAMILY} AND confidence IN ('exact', 'high', 'medium') THEN 'match' WHEN status = 'non_settlement_credit' THEN 'outside' ELSE 'human' END AS kind, coalesce(discrepancy_paise, 0) = 0 OR label NOT IN ('', 'unexplained') AS explained FROM {d} WHERE status <> 'out_of_scope')
  QUALIFY row_number() OVER (PARTITION BY world_id, sid ORDER BY pass_name, status, ms) = 1"""  # noqa: E731
    return {
        "nqa0": f"SELECT *, {SHOWN} AS shown FROM naive",
        "nqueue": f"SELECT *, substr(sha1(source || '|' || array_to_string(list_sort(ids), '|')), 1, 12) AS item_id FROM ({naive} UNION ALL SELECT * FROM qb)",
        "gq": GOLDEN_QUEUE.format(s="settlements", b="bank_rows", o="order_book", p="payments"),
        "gold": "SELECT *, string_split(counterparties, ';') AS cs FROM (" + GOLDEN.format(settlements="settlements") + ")",
        "dues": f"SELECT world_id, counterparties, list_sort(list_concat(list(record_id), any_value(cs))) AS due FROM gold WHERE expected IN {FAMILY} GROUP BY ALL",
        "systems": " UNION ALL ".join(system(n, d) for n, d in (("engine", "leg_a"), ("naive", "naive"), ("reference", "by_reference"))),
        "boxed": f"""SELECT x.system, g.world_id, g.record_id, g.scenario, g.expected, x.tier, CASE WHEN kind = 'match' AND g.expected IN {FAMILY} AND x.ms = d.due AND explained THEN 'auto_correct' WHEN coalesce(kind, 'human') <> 'human' THEN 'auto_wrong'
  WHEN g.expected IN {FAMILY} THEN 'wrongly_left' ELSE 'rightly_left' END AS box FROM gold g LEFT JOIN dues d ON g.world_id = d.world_id AND g.counterparties = d.counterparties JOIN systems x ON g.world_id = x.world_id AND g.record_id = x.sid""",
    }


BOXES = "SELECT system, scenario, box, count(*) AS n FROM boxed GROUP BY ALL UNION ALL SELECT system, NULL, box, count(*) FROM boxed GROUP BY ALL"
WORST = "SELECT CASE box WHEN 'auto_wrong' THEN 1 ELSE 2 END AS rank, b.world_id, record_id, scenario, expected, box, amount_paise FROM boxed b JOIN settlements s ON b.record_id = s.settlement_id WHERE system = 'naive' AND box IN ('auto_wrong', 'wrongly_left') ORDER BY rank, amount_paise DESC, b.world_id, record_id LIMIT 10"


def audited(name: str) -> str:
    return f"""SELECT g.world_id, g.worthy, g.surfaced, g.stake_paise, g.surfaced_paise, i.items, i.gradable, coalesce(j.justified, 0) AS justified FROM (
  SELECT x.world_id, count(*) AS worthy, count(y.id) AS surfaced, sum(stake_paise)::BIGINT AS stake_paise, coalesce(sum(stake_paise) FILTER (y.id IS NOT NULL), 0)::BIGINT AS surfaced_paise FROM gq x
  LEFT JOIN (SELECT DISTINCT world_id, status, unnest(ids) AS id FROM {name}) y ON x.world_id = y.world_id AND x.status = y.status AND x.record_id = y.id GROUP BY ALL) g
  LEFT JOIN (SELECT world_id, count(*) AS items, count(*) FILTER (status <> 'needs_review') AS gradable FROM {name} GROUP BY ALL) i ON g.world_id = i.world_id
  LEFT JOIN (SELECT world_id, count(*) AS justified FROM (SELECT DISTINCT n.world_id, n.item_id, n.status FROM (SELECT world_id, item_id, status, unnest(ids) AS id FROM {name}) n JOIN gq x ON x.world_id = n.world_id AND x.status = n.status AND x.record_id = n.id) GROUP BY ALL) j ON g.world_id = j.world_id"""


def missed(name: str) -> str:
    return f"SELECT * FROM gq x WHERE NOT EXISTS (SELECT 1 FROM (SELECT world_id, status, unnest(ids) AS id FROM {name}) y WHERE x.world_id = y.world_id AND x.status = y.status AND x.record_id = y.id)"


def over_worlds(rows: str, measures: list[str], keys: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {keys}'{m}' AS measure, round(avg({m}), 4) AS mean, round(min({m}), 4) AS least, round(max({m}), 4) AS most FROM ({rows}) GROUP BY ALL" for m in measures)


def benchmark(graded: Callable[[str], str]) -> str:
    due = f"expected IN {FAMILY}"
    parts = []
    for name, decisions in (("engine", "leg_a"), ("naive", "naive"), ("reference", "by_reference")):
        parts.append(f"""SELECT '{name}' AS strategy, count(*) FILTER ({due} AND correct) / nullif(count(*) FILTER (is_match), 0)::DOUBLE AS precision, count(*) FILTER ({due} AND correct) / nullif(count(*) FILTER ({due}), 0)::DOUBLE AS recall,
  count(*) FILTER (correct) / count(*)::DOUBLE AS accuracy, count(*) FILTER (auto) / count(*)::DOUBLE AS auto_rate FROM ({graded(decisions)}) GROUP BY world_id""")
    return over_worlds(" UNION ALL ".join(parts), ["precision", "recall", "accuracy", "auto_rate"], "strategy, ")


def sql(query: str, day: str | None = None, hard: bool = False) -> str:
    """A query over the derived worlds, as they stood at the end of a day if one is given, or with the hard bank rows, and with the named
    queries that it reaches, each worked out once."""
    tables = tables_sql("duckdb")
    named = (as_of_sql(tables, day) if day else hard_sql(tables) if hard else tables) | leg_a() | leg_b() | journeys() | queue() | baselines() | damaged() | searches() | audits() | statements.twins() | proposal_twins.tables()
    more = "WITH RECURSIVE "
    own = query.startswith(more)
    reached, todo = set(), [query]
    while todo:
        words = set(re.findall(r"\w+", todo.pop())) & set(named) - reached
        reached |= words
        todo += [named[w] for w in words]
    once = lambda n: "" if n.endswith("_go") else "MATERIALIZED "
    clauses = ",\n".join(f"{n} AS {once(n)}({q})" for n, q in named.items() if n in reached)
    if not clauses:
        return query
    return f"{more}{clauses},\n{query[len(more):]}" if own else f"{more}{clauses}\n{query}"
