"""DuckDB twins of the search for explanations, the rules for proposals, and what becomes of items and records by them.

The figures that a text states are taken here as the narrations of the derived worlds have them: digits alone at the end of a
narration, or a reference of digits.
"""

from __future__ import annotations

MARKED = "regexp_matches(text, 'RAZORPAY|RZPAY|RZP') OR len(list_filter(regexp_extract_all(text, '[A-Z0-9]+'), lambda x: regexp_full_match(x, '[A-Z]{4}[0-9]{12}'))) > 0"


def grams(text: str, n: int) -> str:
    return f"list_transform(range(1, length({text}) - {n - 2}), lambda i: substr({text}, i, {n}))"


def names(canon: str, text: str, n: int) -> str:
    """A credit's text names a settlement."""
    return f"(contains({text}, upper(sid)) OR len(list_filter({grams('utr', n)}, lambda g: contains({canon}, g))) > 0)"


def figure(text: str, pattern: str, group: int) -> str:
    return f"TRY_CAST(nullif(regexp_extract({text}, '{pattern}', {group}), '') AS BIGINT) * 100"


def tables() -> dict[str, str]:
    choose = {0: "1", 1: "n", 2: "n * (n - 1) // 2", 3: "n * (n - 1) // 2 * (n - 2) // 3"}
    halves = {1: (1, 0), 2: (1, 1), 3: (2, 1), 4: (2, 2), 5: (3, 2), 6: (3, 3)}
    cost = "CASE size " + " ".join(f"WHEN {k} THEN {choose[a]} + {choose[b]}" for k, (a, b) in halves.items()) + " END"
    longer = """SELECT x.world_id, x.item_id, x.ask, x.a, y.a AS z, x.total + y.total AS total, list_concat(x.ids, y.ids) AS ids, x.need, x.largest FROM {of} x JOIN p_1 y
  ON x.world_id = y.world_id AND x.item_id = y.item_id AND x.ask = y.ask WHERE x.largest >= {least} AND y.a > x.z AND x.total + y.total <= x.need"""
    own = "SELECT world_id, item_id, proposal_id, unnest({0}) AS {1} FROM px"
    return {
        "pi": "SELECT world_id, item_id, ids FROM queue WHERE source = 'recon_leg_a' AND status IN ('ambiguous_abstain', 'exception_missing_bank', 'exception_missing_settlement')",
        "ps": "SELECT world_id, settlement_id AS sid, amount_paise AS net, upper(utr) AS utr, created FROM settlements",
        "pc": """SELECT world_id, txn_id AS tid, credit_paise AS amount, value_date, narration, ref_no, upper(trim(regexp_replace(narration || ' ' || ref_no, '\\s+', ' ', 'g'))) AS text,
  regexp_replace(upper(narration || ' ' || ref_no), '[^A-Z0-9]', '', 'g') AS canon FROM bank_rows WHERE credit_paise > 0""",
        "ps_open": "SELECT * FROM ps WHERE sid NOT IN (SELECT record_id FROM claimed)",
        "pc_open": "SELECT * FROM pc WHERE tid NOT IN (SELECT record_id FROM claimed)",
        "p_s": "SELECT i.world_id, i.item_id, s.sid, s.net, s.created FROM (SELECT world_id, item_id, unnest(ids) AS id FROM pi) i JOIN ps s ON s.world_id = i.world_id AND s.sid = i.id",
        "p_c": "SELECT i.world_id, i.item_id, c.tid FROM (SELECT world_id, item_id, unnest(ids) AS id FROM pi) i JOIN pc c ON c.world_id = i.world_id AND c.tid = i.id",
        "p_must": "SELECT world_id, item_id, list(sid ORDER BY sid) AS must, sum(net)::BIGINT AS paid, min(created) AS since, max(created) AS until FROM p_s GROUP BY ALL",
        "p_lone": "SELECT * FROM p_s WHERE item_id NOT IN (SELECT item_id FROM p_c)",
        "p_merged": """SELECT x.world_id, x.item_id, '' AS anchor, c.tid, c.amount, c.value_date, c.narration, c.ref_no, coalesce(m.must, []) AS must, coalesce(m.paid, 0) AS paid
  FROM p_c x JOIN pc c ON c.world_id = x.world_id AND c.tid = x.tid LEFT JOIN p_must m ON m.world_id = x.world_id AND m.item_id = x.item_id WHERE m.must IS NULL OR (c.value_date - m.since <= 10 AND c.value_date >= m.until)
  UNION ALL SELECT l.world_id, l.item_id, l.sid, c.tid, c.amount, c.value_date, c.narration, c.ref_no, [l.sid], l.net FROM p_lone l JOIN pc_open c ON c.world_id = l.world_id AND c.value_date - l.created BETWEEN 0 AND 10""",
        "p_figures": f"""SELECT world_id, item_id, anchor, tid, figure, min(text) AS text FROM (SELECT *, narration AS text, {figure('narration', '(^| )([0-9]+)$', 2)} AS figure FROM p_merged
  UNION ALL SELECT *, ref_no, {figure('ref_no', '^[0-9]+$', 0)} FROM p_merged) WHERE figure <> 0 GROUP BY ALL UNION ALL SELECT world_id, item_id, anchor, tid, 0, '' FROM p_merged""",
        "p_asks": """SELECT *, row_number() OVER (PARTITION BY world_id, item_id ORDER BY anchor, kind, tid, figure, text) AS ask FROM (
  SELECT m.world_id, m.item_id, m.anchor, 'merged' AS kind, m.tid, f.figure, f.text, m.value_date AS day, m.must, m.amount + f.figure - m.paid AS need, 6 - len(m.must) AS slots
  FROM p_merged m JOIN p_figures f ON f.world_id = m.world_id AND f.item_id = m.item_id AND f.anchor = m.anchor AND f.tid = m.tid
  UNION ALL SELECT world_id, item_id, sid, 'split', '', 0, '', created, [], net, 4 FROM p_lone)""",
        "p_free": """SELECT *, row_number() OVER (PARTITION BY world_id, item_id, ask ORDER BY id) AS place FROM (
  SELECT a.world_id, a.item_id, a.ask, a.need, a.slots, s.sid AS id, s.net AS amount FROM p_asks a JOIN ps_open s ON s.world_id = a.world_id AND a.day - s.created BETWEEN 0 AND 10 WHERE a.kind = 'merged' AND NOT list_contains(a.must, s.sid)
  UNION ALL SELECT a.world_id, a.item_id, a.ask, a.need, a.slots, c.tid, c.amount FROM p_asks a JOIN pc_open c ON c.world_id = a.world_id AND c.value_date - a.day BETWEEN 0 AND 10 WHERE a.kind = 'split') WHERE need > 0 AND slots > 0 AND amount BETWEEN 1 AND need""",
        "p_sizes": f"""SELECT *, sum({cost}) OVER (PARTITION BY world_id, item_id ORDER BY ask, size ROWS UNBOUNDED PRECEDING) AS spent FROM (
  SELECT world_id, item_id, ask, n, unnest(range(1, least(n, slots) + 1)) AS size FROM (SELECT world_id, item_id, ask, slots, count(*) AS n FROM p_free GROUP BY ALL))""",
        "p_1": """SELECT f.world_id, f.item_id, f.ask, place AS a, place AS z, amount AS total, [id] AS ids, need, largest FROM p_free f JOIN (SELECT world_id, item_id, ask, max(size) AS largest FROM p_sizes WHERE spent <= 200000 GROUP BY ALL) z
  ON z.world_id = f.world_id AND z.item_id = f.item_id AND z.ask = f.ask""",
        "p_2": longer.format(of="p_1", least=3),
        "p_3": longer.format(of="p_2", least=5),
        "p_sets": "SELECT world_id, item_id, ask, ids FROM p_1 WHERE total = need" + "".join(
            f" UNION ALL SELECT x.world_id, x.item_id, x.ask, list_concat(x.ids, y.ids) FROM p_{early} x JOIN p_{late} y ON x.world_id = y.world_id AND x.item_id = y.item_id AND x.ask = y.ask AND y.total = x.need - x.total WHERE x.largest >= {k} AND y.a > x.z"
            for k, (early, late) in list(halves.items())[1:]
        ),
        "p_found": """SELECT a.world_id, a.item_id, a.kind, a.anchor, a.tid, a.figure, a.text, a.must, s.ids FROM p_asks a JOIN (SELECT world_id, item_id, ask, ids FROM p_sets UNION ALL SELECT world_id, item_id, ask, [] FROM p_asks WHERE need = 0 AND len(must) > 0) s
  ON s.world_id = a.world_id AND s.item_id = a.item_id AND s.ask = a.ask WHERE a.kind = 'merged' OR len(s.ids) > 1""",
        "px": """SELECT *, item_id || ':' || (row_number() OVER (PARTITION BY world_id, item_id ORDER BY sids, tids, ded) - 1) AS proposal_id FROM (
  SELECT world_id, item_id, CASE WHEN kind = 'split' THEN [anchor] ELSE list_sort(list_concat(must, ids)) END AS sids, CASE WHEN kind = 'split' THEN list_sort(ids) ELSE [tid] END AS tids, figure AS ded, min(text) AS text FROM p_found GROUP BY ALL)""",
        "px_s": f"SELECT x.*, s.net, s.utr, s.created FROM ({own.format('sids', 'sid')}) x JOIN ps s ON s.world_id = x.world_id AND s.sid = x.sid",
        "px_c": f"SELECT x.*, c.amount, c.value_date, c.text, c.canon FROM ({own.format('tids', 'tid')}) x JOIN pc c ON c.world_id = x.world_id AND c.tid = x.tid",
        "px_min": """SELECT DISTINCT x.world_id, x.proposal_id, 'item' AS code FROM px x JOIN pi i ON i.world_id = x.world_id AND i.item_id = x.item_id WHERE len(list_filter(i.ids, lambda r: NOT list_contains(list_concat(x.sids, x.tids), r))) > 0
  UNION SELECT world_id, proposal_id, 'claimed' FROM (SELECT world_id, proposal_id, unnest(list_concat(sids, tids)) AS r FROM px) WHERE r IN (SELECT record_id FROM claimed)""",
        "pm_s": "SELECT * FROM px_s WHERE proposal_id NOT IN (SELECT proposal_id FROM px_min)",
        "pm_c": "SELECT * FROM px_c WHERE proposal_id NOT IN (SELECT proposal_id FROM px_min)",
        "pm_both": "SELECT c.*, s.sid, s.utr, s.net, s.created FROM pm_c c JOIN pm_s s ON s.world_id = c.world_id AND s.proposal_id = c.proposal_id",
        "pm_grams": f"SELECT world_id, proposal_id, unnest({grams('utr', 10)}) AS g FROM pm_s",
        "pm_foreign": f"""SELECT world_id, proposal_id, tid, sid FROM (SELECT c.world_id, c.proposal_id, c.tid, s.sid, unnest(list_filter({grams('s.utr', 10)}, lambda g: contains(c.canon, g))) AS g FROM pm_c c JOIN ps s ON s.world_id = c.world_id AND s.utr <> ''
    WHERE NOT EXISTS (SELECT 1 FROM pm_s o WHERE o.world_id = c.world_id AND o.proposal_id = c.proposal_id AND o.sid = s.sid)) h
  GROUP BY ALL HAVING count(*) FILTER ((h.world_id, h.proposal_id, h.g) IN (SELECT (world_id, proposal_id, g) FROM pm_grams)) = 0""",
        "px_strict": f"""SELECT DISTINCT world_id, proposal_id, 'provenance' AS code FROM (SELECT world_id, proposal_id, tid, bool_or({MARKED} OR {names('canon', 'text', 8)}) AS ok FROM pm_both GROUP BY ALL) WHERE NOT ok
  UNION SELECT world_id, proposal_id, 'contradiction' FROM pm_foreign
  UNION SELECT c.world_id, c.proposal_id, 'contradiction' FROM pm_c c JOIN ps s ON s.world_id = c.world_id AND s.utr <> '' AND contains(c.canon, s.utr)
    WHERE NOT EXISTS (SELECT 1 FROM pm_s o WHERE o.world_id = c.world_id AND o.proposal_id = c.proposal_id AND o.sid = s.sid)
  UNION SELECT world_id, proposal_id, 'contradiction' FROM (SELECT b.world_id, b.proposal_id, t.x, min(levenshtein(t.x, b.utr)) AS edits FROM pm_both b, LATERAL (SELECT unnest(regexp_extract_all(b.text, '[A-Z0-9]+')) AS x) t WHERE regexp_full_match(t.x, '[A-Z]{{4}}[0-9]{{12}}') GROUP BY ALL) WHERE edits >= 3
  UNION SELECT world_id, proposal_id, 'rival' FROM (SELECT b.world_id, b.proposal_id, b.sid, r.sid AS other, bool_and(b.value_date - r.created BETWEEN 0 AND 10) AS fits,
    bool_or(contains(b.text, upper(b.sid)) OR (b.utr <> '' AND contains(b.canon, b.utr)) OR (len(list_filter({grams('b.utr', 10)}, lambda g: contains(b.canon, g))) > 0 AND len(list_filter({grams('b.utr', 10)}, lambda g: contains(b.canon, g) AND contains(r.utr, g))) = 0)) AS apart
    FROM pm_both b JOIN ps_open r ON r.world_id = b.world_id AND r.net = b.net WHERE NOT EXISTS (SELECT 1 FROM pm_s o WHERE o.world_id = b.world_id AND o.proposal_id = b.proposal_id AND o.sid = r.sid) GROUP BY ALL) WHERE fits AND NOT apart
  UNION SELECT world_id, proposal_id, 'rival' FROM (SELECT world_id, proposal_id, tid, other, bool_and(rday - created BETWEEN 0 AND 10) AS fits, bool_or({names('canon', 'text', 10)}) AS mine, bool_or({names('rcanon', 'rtext', 10)}) AS theirs
    FROM (SELECT b.*, r.tid AS other, r.value_date AS rday, r.text AS rtext, r.canon AS rcanon FROM pm_both b JOIN pc_open r ON r.world_id = b.world_id AND r.amount = b.amount
      WHERE NOT EXISTS (SELECT 1 FROM pm_c o WHERE o.world_id = b.world_id AND o.proposal_id = b.proposal_id AND o.tid = r.tid)) GROUP BY ALL) WHERE fits AND (NOT mine OR theirs)""",
        "px_codes": "SELECT * FROM px_min UNION SELECT * FROM px_strict",
        "px_good": "SELECT * FROM px WHERE proposal_id NOT IN (SELECT proposal_id FROM px_codes)",
        "px_clash": """SELECT DISTINCT o.world_id, o.proposal_id, 'conflict' AS code FROM (SELECT world_id, proposal_id, unnest(list_concat(sids, tids)) AS r FROM px_good) o
  JOIN (SELECT world_id, r FROM (SELECT world_id, unnest(list_concat(sids, tids)) AS r FROM px_good) GROUP BY ALL HAVING count(*) > 1) k ON k.world_id = o.world_id AND k.r = o.r""",
        "px_told": f"""SELECT x.world_id, x.proposal_id, c.codes IS NULL AS accepted, coalesce(c.codes, '') AS codes, CASE WHEN c.codes IS NOT NULL THEN '' WHEN len(x.sids) > 1 THEN 'matched_merged' WHEN len(x.tids) > 1 THEN 'matched_split' WHEN x.ded <> 0 THEN 'matched_with_discrepancy' ELSE 'matched' END AS status
  FROM px x LEFT JOIN (SELECT world_id, proposal_id, array_to_string(list_sort(list(DISTINCT code)), ',') AS codes FROM (SELECT * FROM px_codes UNION SELECT * FROM px_clash) GROUP BY ALL) c ON c.world_id = x.world_id AND c.proposal_id = x.proposal_id""",
        "p_cut": "SELECT DISTINCT world_id, item_id FROM p_sizes WHERE spent > 200000",
        "solved": """SELECT i.world_id, i.item_id, v.verdict, CASE WHEN v.verdict = 'match' THEN o.sids ELSE [] END AS sids, CASE WHEN v.verdict = 'match' THEN o.tids ELSE [] END AS tids, CASE WHEN v.verdict = 'match' THEN o.ded ELSE 0 END AS ded
  FROM pi i LEFT JOIN (SELECT world_id, item_id, count(*) AS n, any_value(sids) AS sids, any_value(tids) AS tids, any_value(ded) AS ded FROM px_good GROUP BY ALL) o ON o.world_id = i.world_id AND o.item_id = i.item_id
  LEFT JOIN p_cut t ON t.world_id = i.world_id AND t.item_id = i.item_id, LATERAL (SELECT CASE WHEN t.item_id IS NULL AND coalesce(o.n, 0) = 1 THEN 'match' WHEN t.item_id IS NULL AND coalesce(o.n, 0) = 0 THEN 'exception' ELSE 'abstain' END AS verdict) v""",
    }


SOLVER = "SELECT world_id, item_id, verdict, array_to_string(sids, ';') AS settlement_ids, array_to_string(tids, ';') AS bank_row_ids, ded AS deduction_paise FROM solved"
VERIFIED = "SELECT * FROM px_told"

#: Labels of settlements over hard bank rows, from those over the plain ones. One text for both engines.
HARD_GOLDEN = """SELECT world_id, record_type, record_id, CASE WHEN c IN (0, 1, 25, 26, 27) THEN 'matched_merged' WHEN c = 4 THEN 'matched_split' WHEN c = 7 THEN 'matched_with_discrepancy' ELSE expected END AS expected,
  CASE WHEN c IN (0, 1) THEN concat('BANK', lpad(cast((s - c) * 4 as varchar(20)), 12, '0')) WHEN c IN (25, 26, 27) THEN concat('BANK', lpad(cast((s - c + 25) * 4 as varchar(20)), 12, '0'))
  WHEN c = 4 THEN concat('BANK', lpad(cast(s * 4 as varchar(20)), 12, '0'), ';BANK', lpad(cast(s * 4 + 1 as varchar(20)), 12, '0')) ELSE counterparties END AS counterparties, scenario
  FROM (SELECT *, cast(substring(record_id, 6, 12) as bigint) AS s, cast(substring(record_id, 6, 12) as bigint) % 48 AS c FROM ({golden}))"""

#: Items in order, one after the other, with the records that matches have taken so far.
_PLACED = """placed AS (SELECT world_id, item_id, ids, row_number() OVER (PARTITION BY world_id ORDER BY CASE WHEN tid IS NULL THEN 1 ELSE 0 END, day, coalesce(tid, sid), item_id) AS place FROM (
  SELECT i.*, t.tid, s.sid, coalesce(c.value_date, x.created) AS day FROM (SELECT world_id, item_id, ids, list_filter(ids, lambda r: starts_with(r, 'BANK')) AS ts, list_filter(ids, lambda r: NOT starts_with(r, 'BANK')) AS ss FROM pi) i,
  LATERAL (SELECT i.ts[1] AS tid) t, LATERAL (SELECT i.ss[1] AS sid) s LEFT JOIN pc c ON c.world_id = i.world_id AND c.tid = t.tid LEFT JOIN ps x ON x.world_id = i.world_id AND x.sid = s.sid)),
asked AS (SELECT p.*, v.verdict, v.sids, v.tids, v.ded FROM placed p JOIN solved v ON v.world_id = p.world_id AND v.item_id = p.item_id),
walk AS (SELECT DISTINCT world_id, 0::BIGINT AS place, []::VARCHAR[] AS taken, '' AS item_id, '' AS outcome FROM pi
  UNION ALL SELECT a.world_id, a.place, CASE WHEN NOT list_has_any(w.taken, a.ids) AND a.verdict = 'match' THEN list_concat(w.taken, list_concat(a.sids, a.tids)) ELSE w.taken END, a.item_id,
  CASE WHEN list_has_any(w.taken, a.ids) THEN 'dedupe_skip' WHEN a.verdict = 'exception' THEN 'prefilter_skip' WHEN a.verdict = 'match' THEN 'proposed' ELSE 'abstained' END
  FROM walk w JOIN asked a ON a.world_id = w.world_id AND a.place = w.place + 1),
sent AS (SELECT a.* FROM asked a JOIN walk w ON w.world_id = a.world_id AND w.item_id = a.item_id AND w.outcome = 'proposed'),
crowded AS (SELECT world_id, r FROM (SELECT world_id, unnest(list_concat(sids, tids)) AS r FROM sent) GROUP BY ALL HAVING count(*) > 1),
clash AS (SELECT DISTINCT s.world_id, s.item_id FROM (SELECT world_id, item_id, unnest(list_concat(sids, tids)) AS r FROM sent) s JOIN crowded c ON c.world_id = s.world_id AND c.r = s.r),
hgold AS ({golden}),
hdues AS (SELECT world_id, counterparties, list_sort(list_concat(list(record_id), any_value(list_filter(string_split(counterparties, ';'), lambda x: x <> '')))) AS due FROM hgold WHERE expected IN ('matched', 'matched_with_discrepancy', 'matched_split', 'matched_merged') GROUP BY ALL),
wrongs AS (SELECT s.world_id, s.item_id, NOT bool_and(coalesce(d.due = list_sort(list_concat(s.sids, s.tids)) AND g.expected LIKE 'matched%', false)) AS wrong FROM (SELECT *, unnest(sids) AS sid FROM sent) s
  LEFT JOIN hgold g ON g.world_id = s.world_id AND g.record_id = s.sid LEFT JOIN hdues d ON d.world_id = g.world_id AND d.counterparties = g.counterparties GROUP BY ALL),
numbers AS (SELECT world_id, item_id, count(*) AS measure FROM px GROUP BY ALL),
told AS (SELECT w.world_id, w.item_id, w.place::INTEGER AS place, w.outcome, CASE WHEN w.outcome = 'proposed' THEN c.item_id IS NULL END AS accepted, CASE WHEN w.outcome = 'proposed' THEN CASE WHEN c.item_id IS NULL THEN '' ELSE 'conflict' END END AS codes,
  x.wrong, coalesce(n.measure, 0) AS measure FROM walk w LEFT JOIN clash c ON c.world_id = w.world_id AND c.item_id = w.item_id LEFT JOIN wrongs x ON x.world_id = w.world_id AND x.item_id = w.item_id
  LEFT JOIN numbers n ON n.world_id = w.world_id AND n.item_id = w.item_id WHERE w.place > 0)"""


def _resolved(golden: str, query: str) -> str:
    return f"WITH RECURSIVE {_PLACED.format(golden=HARD_GOLDEN.format(golden=golden))}\n{query}"


def _state(name: str, accepted: str, golden: str) -> str:
    """(system, world_id, record_id, box, scenario): labelled settlements by what the engine, overridden by accepted proposals, makes of them."""
    family = "('matched', 'matched_with_discrepancy', 'matched_split', 'matched_merged')"
    return f"""SELECT '{name}' AS system, g.scenario, CASE WHEN s.kind = 'match' AND g.expected IN {family} AND s.ms = d.due AND s.explained THEN 'auto_correct' WHEN coalesce(s.kind, 'human') <> 'human' THEN 'auto_wrong' WHEN g.expected IN {family} THEN 'wrongly_left' ELSE 'rightly_left' END AS box
  FROM ({golden}) g LEFT JOIN (SELECT world_id, counterparties, list_sort(list_concat(list(record_id), any_value(list_filter(string_split(counterparties, ';'), lambda x: x <> '')))) AS due FROM ({golden}) WHERE expected IN {family} GROUP BY ALL) d ON d.world_id = g.world_id AND d.counterparties = g.counterparties AND g.expected IN {family}
  LEFT JOIN (SELECT coalesce(p.world_id, e.world_id) AS world_id, coalesce(p.sid, e.sid) AS sid, CASE WHEN p.sid IS NOT NULL THEN 'match' ELSE e.kind END AS kind, coalesce(p.ms, e.ms) AS ms, p.sid IS NOT NULL OR e.explained AS explained
    FROM (SELECT * FROM systems WHERE system = 'engine') e FULL OUTER JOIN ({accepted}) p ON p.world_id = e.world_id AND p.sid = e.sid) s ON s.world_id = g.world_id AND s.sid = g.record_id"""


def _counted(rows: str) -> str:
    return f"SELECT system, scenario, box, count(*) AS n FROM ({rows}) GROUP BY ALL UNION ALL SELECT system, NULL, box, count(*) FROM ({rows}) GROUP BY ALL"


def evaluated(golden: str) -> str:
    """The engine with all answers of the solver that share no record with another."""
    alone = """SELECT world_id, unnest(sids) AS sid, list_sort(list_concat(sids, tids)) AS ms FROM (SELECT DISTINCT world_id, sids, tids FROM solved v WHERE verdict = 'match'
      AND NOT EXISTS (SELECT 1 FROM solved o WHERE o.world_id = v.world_id AND o.item_id <> v.item_id AND o.verdict = 'match' AND list_has_any(list_concat(o.sids, o.tids), list_concat(v.sids, v.tids))))"""
    return _counted(_state("engine_solver", alone, golden))



def resolved(golden: str) -> dict[str, str]:
    """The queries over items taken in order: each item, statistics by world, and what becomes of labelled settlements."""
    accepted = "SELECT s.world_id, unnest(s.sids) AS sid, list_sort(list_concat(s.sids, s.tids)) AS ms FROM sent s JOIN told t ON t.world_id = s.world_id AND t.item_id = s.item_id AND t.accepted"
    none = "SELECT 0 AS world_id, '' AS sid, []::VARCHAR[] AS ms WHERE false"
    counted = """SELECT t.world_id, count(*) FILTER (outcome = 'proposed') AS match_proposals, count(*) FILTER (outcome = 'proposed' AND NOT accepted) AS rejected, count(*) FILTER (outcome = 'proposed' AND accepted AND wrong) AS wrong_accepted,
  count(*) FILTER (outcome IN ('proposed', 'abstained')) AS items_asked, median(measure) FILTER (outcome IN ('proposed', 'abstained')) AS median_measure FROM told t GROUP BY ALL"""
    return {
        "items": _resolved(golden, "SELECT * FROM told"),
        "stats": _resolved(golden, counted),
        "boxes": _resolved(golden, _counted(_state("engine", none, "SELECT * FROM hgold") + " UNION ALL " + _state("engine_resolver", accepted, "SELECT * FROM hgold"))),
    }
