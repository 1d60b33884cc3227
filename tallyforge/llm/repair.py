"""Repair of conversations: the cheapest edits that make the roles read as a system turn, if any, and then pairs of user and assistant.

A turn and the insertions before it are one macro edit. Its code, some ``I`` and then what becomes of the turn (``D``, ``K``, ``R``), is
prefix-free and its codes are ordered, so two edit strings over the same turns compare as the first macro edits in which they
differ do. A layer of the dynamic program therefore keeps, for each of four states, only the least cost, the rank of its edit string among
those of the layer, and the parent that it came from; no strings. Costs count from the layer's least, so that layers are few and a step
from one to the next is remembered. Strings and texts are made afterwards, along the parents.

Rows are put into one order over all partitions and dealt by rank into chunks. A conversation may span many: each stretch tells what it
costs to pass it from each state to each other; the stretches of a conversation are put together by these few numbers, which gives
every stretch its two ends; then each is walked again between its own ends. No task holds a conversation's turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import Scratch, numbered

#: Rows of a chunk.
CHUNK = 4096
#: Characters of a text that order rows of one turn and role; a hash of the text orders the rest.
SHOWN = 32
#: Costs of the edits, and of a cut-off turn that stays.
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
#: States: nothing yet, after a system turn, after a user's, after an assistant's; the role that may follow each, and the state after it.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
AFTER = {"u": USER, "a": ASSISTANT}
ROLES = {"u": "user", "a": "assistant"}
#: Faults of a turn.
SOUND, BLANK, REPEATED, TRUNCATED = range(4)
#: White space at the end of a text.
SPACE = " \t\n\x0b\f\r"


def inserted(state: int, times: int) -> tuple[int, list[str]]:
    """The state after so many insertions, and the roles that they have."""
    roles = []
    for _ in range(times):
        roles.append(FOLLOWS[state])
        state = AFTER[roles[-1]]
    return state, roles


@lru_cache(maxsize=None)
def macros(initial: str, fault: int) -> dict[tuple[int, int], tuple[int, str]]:
    """(from, to): the cheapest macro edit of a turn, of equal ones the least code. ``initial`` is s, u, a, or empty for any other."""
    found: dict[tuple[int, int], tuple[int, str]] = {}
    for state in range(4):
        for times in range(3):
            reached, _ = inserted(state, times)
            ways = [(DELETE, "D", reached)]
            if fault not in (BLANK, REPEATED):
                more, role = (CUT_OFF if fault == TRUNCATED else 0), FOLLOWS[reached]
                ways.append((REROLE + more, "R", AFTER[role]))
                if initial == role or (initial == "s" and reached == START):
                    ways.append((KEEP + more, "K", AFTER.get(initial, SYSTEM)))
            for cost, code, to in ways:
                way = (INSERT * times + cost, "I" * times + code)
                found[state, to] = min(way, found.get((state, to), way))
    return found


Layer = tuple[tuple[int, int] | None, ...]


@lru_cache(maxsize=1 << 16)
def step(layer: Layer, initial: str, fault: int) -> tuple[Layer, int, tuple]:
    """The next layer, (cost, rank) of each state reached, what was taken off its costs, and of each state its (parent, code)."""
    best: dict[int, tuple[int, int, int, str]] = {}
    for (state, to), (cost, code) in macros(initial, fault).items():
        if layer[state] is not None:
            way = (layer[state][0] + cost, layer[state][1], state, code)
            best[to] = min(way, best.get(to, way))
    ranks = {to: rank for rank, to in enumerate(sorted(best, key=lambda to: (best[to][1], best[to][3])))}
    least = min(way[0] for way in best.values())
    following = tuple((best[to][0] - least, ranks[to]) if to in best else None for to in range(4))
    return following, least, tuple((best[to][2], best[to][3]) if to in best else None for to in range(4))


def alone(state: int) -> Layer:
    return tuple((0, 0) if at == state else None for at in range(4))


def passed(initials: list[str], faults: list[int], start: int) -> tuple[list[int], list[int]]:
    """From a state over all turns to each state: the cost (-1: none) and the rank of the edits."""
    layer, total = alone(start), 0
    for initial, fault in zip(initials, faults, strict=True):
        layer, less, _ = step(layer, initial, fault)
        total += less
    return [-1 if at is None else at[0] + total for at in layer], [-1 if at is None else at[1] for at in layer]


def walked(initials: list[str], faults: list[int], start: int, end: int) -> list[str]:
    """The macro edits of the best way from one state to another."""
    layer, parents = alone(start), []
    for initial, fault in zip(initials, faults, strict=True):
        layer, _, of = step(layer, initial, fault)
        parents.append(of)
    codes = []
    for of in reversed(parents):
        end, code = of[end]
        codes.append(code)
    return codes[::-1]


def put_together(parts: list[tuple[list[int], list[int]]]) -> tuple[int, list[int], int]:
    """The least cost over all stretches of a conversation, the states at their borders, and the insertions after the last. A stretch is the
    costs and ranks (16 each, by from and to) of passing it."""
    layer: dict[int, tuple[int, int]] = {START: (0, 0)}
    chosen: list[dict[int, int]] = []
    for costs, ranks in parts:
        best: dict[int, tuple[int, int, int]] = {}
        for state, (cost, rank) in layer.items():
            for to in range(4):
                if costs[4 * state + to] >= 0:
                    way = (cost + costs[4 * state + to], rank, state)
                    best[to] = min(way, best.get(to, way))
        chosen.append({to: way[2] for to, way in best.items()})
        order = sorted(best, key=lambda to: (best[to][1], ranks[4 * best[to][2] + to]))
        layer = {to: (best[to][0], rank) for rank, to in enumerate(order)}
    cost, _, times, state = min((cost + INSERT * times, rank, times, state) for state, (cost, rank) in layer.items() for times in range(3) if inserted(state, times)[0] in (START, ASSISTANT))
    states = [state]
    for of in reversed(chosen):
        states.append(of[states[-1]])
    return cost, states[::-1], times


def repaired(codes: list[str], roles: list[str], texts: list[str], start: int, times: int) -> list[str]:
    """The lines ``role:text`` that macro edits and ``times`` insertions at the end leave."""
    lines, state = [], start
    for code, role, text in zip(codes, roles, texts, strict=True):
        state, added = inserted(state, code.count("I"))
        lines += [f"{ROLES[r]}:" for r in added]
        if code[-1] == "R":
            lines.append(f"{ROLES[FOLLOWS[state]]}:{text}")
        elif code[-1] == "K":
            lines.append(f"{role}:{text}")
        if code[-1] != "D":
            state = AFTER[FOLLOWS[state]] if code[-1] == "R" or role[:1] != "s" else SYSTEM
    return lines + [f"{ROLES[r]}:" for r in inserted(state, times)[1]]


class Stretch(NamedTuple):
    """Rows of one conversation in one chunk; ``begins``: another conversation stands before it in the chunk; ``path``: its way, once known."""

    conv_id: object
    rank: int
    begins: bool
    path: tuple | None
    roles: list[str]
    faults: list[int]
    texts: list[str]


#: Kinds of rows that meet in a chunk: a stretch's way, the mark of a row that is the first of its role and text, a turn.
WAY, MARK, TURN = range(3)


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[Stretch]:
    """Of rows (chunk, rank, kind, conv_id, role, fault, text, way) by chunk, rank and kind."""
    here, own, path, mark = None, None, None, None
    for batch in batches:
        for chunk, rank, kind, conv_id, role, fault, text, way in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if kind == WAY:
                path = way
            elif kind == MARK:
                mark = rank
            else:
                if here != (chunk, conv_id):
                    if own:
                        yield own
                    own = Stretch(conv_id, rank, here is not None and here[0] == chunk, path, [], [], [])
                    here = chunk, conv_id
                own.roles.append(role)
                own.faults.append(REPEATED if fault != BLANK and mark != rank else fault)
                own.texts.append(text)
    if own:
        yield own


def initials_of(stretch: Stretch) -> list[str]:
    return [role[:1] if role[:1] in ("s", "u", "a") else "" for role in stretch.roles]


def _told(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Of each stretch: conv_id, rank, counts of rows and faults, its outer roles' initials, and the costs and ranks of passing it."""
    rows = []
    for of in stretches(batches):
        initials = initials_of(of)
        first = [passed(initials, of.faults, state) if state == START or not of.begins else ([-1] * 4, [-1] * 4) for state in range(4)]
        illegal = sum(pair not in ("su", "ua", "au") for pair in map("".join, zip(initials, initials[1:], strict=False)))
        counts = [of.faults.count(fault) for fault in (BLANK, REPEATED, TRUNCATED)]
        rows.append((of.conv_id, of.rank, *counts, illegal, initials[0], initials[-1], sum((c for c, _ in first), []), sum((r for _, r in first), [])))
        if len(rows) == 2000:
            yield batch_of(rows, schema)
            rows = []
    yield batch_of(rows, schema)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], kind) for i, kind in enumerate(schema.types)], schema=schema)


def _linked(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Of each stretch, from what ``_told`` says by conv_id and rank: conv_id, rank, its way, and with the first of a conversation its sums."""

    def conversation(parts: list[tuple]) -> Iterator[tuple]:
        cost, states, times = put_together([part[8:10] for part in parts])
        illegal = sum(part[5] for part in parts) + sum(a[7] + b[6] not in ("su", "ua", "au") for a, b in zip(parts, parts[1:], strict=False))
        sums = [sum(part[i] for part in parts) for i in (2, 3, 4)] + [illegal, cost]
        for i, part in enumerate(parts):
            yield part[0], part[1], [states[i], states[i + 1], times if i == len(parts) - 1 else 0], None if i else sums

    parts: list[tuple] = []
    for batch in batches:
        rows: list[tuple] = []
        for part in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if parts and part[0] != parts[0][0]:
                rows += conversation(parts)
                parts = []
            parts.append(part)
        yield batch_of(rows, schema)
    if parts:
        yield batch_of(list(conversation(parts)), schema)


def _pieces(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(conv_id, rank, audit, repaired) of each stretch; repaired is null where no turn is left."""
    rows, size = [], 0
    for of in stretches(batches):
        start, end, times = of.path
        codes = walked(initials_of(of), of.faults, start, end)
        lines = repaired(codes, of.roles, of.texts, start, times)
        rows.append((of.conv_id, of.rank, "".join(codes) + "I" * times, "\n".join(lines) if lines else None))
        size += sum(map(len, lines)) + 1000
        if size > 1 << 22:
            yield batch_of(rows, schema)
            rows, size = [], 0
    yield batch_of(rows, schema)


def _hashed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(conv_id, audit, repaired_sha256) of pieces by conv_id and rank."""
    here, audits, digest, empty = None, [], None, True
    for batch in batches:
        rows: list[tuple] = []
        for conv_id, audit, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "repaired")), strict=True):
            if here != (conv_id,):
                if here:
                    rows.append((*here, "".join(audits), digest.hexdigest()))
                here, audits, digest, empty = (conv_id,), [], hashlib.sha256(), True
            audits.append(audit)
            if text is not None:
                digest.update((text if empty else f"\n{text}").encode())
                empty = False
        yield batch_of(rows, schema)
    if here:
        yield batch_of([(*here, "".join(audits), digest.hexdigest())], schema)


class Repaired(NamedTuple):
    conversations: DataFrame
    pieces: DataFrame


def repair(rows: DataFrame, scratch: Scratch) -> Repaired:
    """Repair conversations, rows (conv_id, turn, role, text).

    ``conversations`` has (conv_id, gaps, blank, duplicate, truncated, illegal, cost) of each. ``pieces`` has (conv_id, rank, audit, repaired): in
    order of rank, the edits' initials and the lines ``role:text`` that are left, a line feed between them; a conversation has one piece or, if
    it is long, several, and a piece's ``repaired`` is null where no turn is left.

    Turns of a conversation stand in the order of ``turn``, null first; of one turn, by role, the text's first 32 characters, then a
    hash of it. A null role or text is one space. A turn's first fault counts: blank, without a character other than white space;
    duplicate, if its role and text stand earlier; truncated, if the last such character is none of ``.!?``. Rows of a null conv_id are a
    conversation of their own. Other columns do not matter. An empty table gives no rows.
    """
    of = dict(rows.dtypes)["conv_id"]
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[of]
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    chosen = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    chosen = chosen.select("*", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, SHOWN), F.col("h1"), F.col("h2"), F.col("row")]
    lined = numbered(chosen, order, scratch, "lined").withColumn("chunk", F.floor(F.col("rank") / CHUNK))
    marks = lined.groupBy("conv_id", "role", "h1", "h2").agg(F.min("rank").alias("rank"))
    marks = scratch.write(marks.select(F.floor(F.col("rank") / CHUNK).alias("chunk"), "rank"), "marks")

    body = F.rtrim("text", F.lit(SPACE))
    fault = F.when(body == "", BLANK).when(F.right(body, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    none = lambda kind: F.lit(None).cast(kind)

    def met(shown: bool, *others: DataFrame) -> DataFrame:
        turns = lined.select("chunk", "rank", F.lit(TURN).alias("kind"), "conv_id", "role", fault.alias("fault"), (F.col("text") if shown else none("string")).alias("text"), none("array<int>").alias("way"))
        marked = marks.select("chunk", "rank", F.lit(MARK).alias("kind"), none(of).alias("conv_id"), none("string").alias("role"), none("int").alias("fault"), none("string").alias("text"), none("array<int>").alias("way"))
        for other in (marked, *others):
            turns = turns.unionByName(other)
        return turns.repartition("chunk").sortWithinPartitions("chunk", "rank", "kind")

    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    told = pa.schema([("conv_id", kind), ("rank", pa.int64()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")), ("first", pa.string()), ("last", pa.string()), ("costs", longs), ("ranks", ints)])
    found = met(False).mapInArrow(partial(_told, schema=told), f"conv_id {of}, rank long, blank long, duplicate long, truncated long, illegal long, first string, last string, costs array<long>, ranks array<int>")
    found = found.repartition("conv_id").sortWithinPartitions("conv_id", "rank")
    linked = pa.schema([("conv_id", kind), ("rank", pa.int64()), ("way", ints), ("sums", longs)])
    ways = scratch.write(found.mapInArrow(partial(_linked, schema=linked), f"conv_id {of}, rank long, way array<int>, sums array<long>"), "ways")

    way = ways.select(F.floor(F.col("rank") / CHUNK).alias("chunk"), "rank", F.lit(WAY).alias("kind"), "conv_id", none("string").alias("role"), none("int").alias("fault"), none("string").alias("text"), "way")
    pieces = pa.schema([("conv_id", kind), ("rank", pa.int64()), ("audit", pa.string()), ("repaired", pa.string())])
    pieces = met(True, way).mapInArrow(partial(_pieces, schema=pieces), f"conv_id {of}, rank long, audit string, repaired string")
    gaps = lined.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    sums = ways.filter("sums IS NOT NULL").withColumnRenamed("conv_id", "of")
    counts = gaps.join(sums, F.col("conv_id").eqNullSafe(F.col("of")))
    names = ("blank", "duplicate", "truncated", "illegal", "cost")
    return Repaired(counts.select("conv_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), *(F.col("sums")[i].alias(c) for i, c in enumerate(names))), pieces)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it,
    4 makes its role user. A null is one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    marked = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), marked.alias("text"), "kind")
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).select("conv_id", "turn", "role", "text")


def digests(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation, its rows damaged and then
    repaired; zeros, an empty audit and the hash of an empty text where the damage leaves no rows."""
    of = dict(conversations.dtypes)["conv_id"]
    found = repair(damaged(conversations), scratch)
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[of]
    schema = pa.schema([("conv_id", kind), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    pieces = found.pieces.repartition("conv_id").sortWithinPartitions("conv_id", "rank")
    hashes = pieces.mapInArrow(partial(_hashed, schema=schema), f"conv_id {of}, audit string, repaired_sha256 string").withColumnRenamed("conv_id", "id")
    counts = found.conversations.withColumnRenamed("conv_id", "of")
    every = conversations.select("conv_id").distinct()
    every = every.join(counts, F.col("conv_id").eqNullSafe(F.col("of")), "left").join(hashes, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    sums = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *sums, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


ORACLE = """
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
keys AS (SELECT DISTINCT key FROM c),
k AS (
  SELECT key, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, len(key) + 1), lambda j: ascii(key[j])::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda v, w: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END))) % 20 AS kind FROM keys),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM c JOIN k USING (key) WHERE kind <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d),
r AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS initial,
         CASE WHEN body = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(body, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault FROM o),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
         count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) AS n FROM r GROUP BY conv_id),
pairs AS (SELECT conv_id, initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM r),
bad AS (SELECT conv_id, count(*) AS illegal FROM pairs WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au') GROUP BY conv_id),
runs(state, times, reached, added) AS (VALUES
  (0, 0, 0, []::VARCHAR[]), (0, 1, 2, ['user:']), (0, 2, 3, ['user:', 'assistant:']),
  (1, 0, 1, []::VARCHAR[]), (1, 1, 2, ['user:']), (1, 2, 3, ['user:', 'assistant:']),
  (2, 0, 2, []::VARCHAR[]), (2, 1, 3, ['assistant:']), (2, 2, 2, ['assistant:', 'user:']),
  (3, 0, 3, []::VARCHAR[]), (3, 1, 2, ['user:']), (3, 2, 3, ['user:', 'assistant:'])),
edits(reached, edit, needs, becomes, after, price) AS (VALUES
  (0, 'D', '', '', 0, 2), (1, 'D', '', '', 1, 2), (2, 'D', '', '', 2, 2), (3, 'D', '', '', 3, 2),
  (0, 'R', '', 'user', 2, 1), (1, 'R', '', 'user', 2, 1), (2, 'R', '', 'assistant', 3, 1), (3, 'R', '', 'user', 2, 1),
  (0, 'K', 's', '', 1, 0), (0, 'K', 'u', '', 2, 0), (1, 'K', 'u', '', 2, 0), (2, 'K', 'a', '', 3, 0), (3, 'K', 'u', '', 2, 0)),
dp AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS kept FROM counts
  UNION ALL
  SELECT conv_id, i, after, cost, audit, kept FROM (
    SELECT r.conv_id, r.i, e.after,
           (dp.cost + 5 * u.times + e.price + CASE WHEN r.fault = 3 AND e.edit <> 'D' THEN 5 ELSE 0 END)::BIGINT AS cost,
           dp.audit || repeat('I', u.times) || e.edit AS audit,
           dp.kept || u.added || CASE e.edit WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [r.role || ':' || r.text] ELSE [e.becomes || ':' || r.text] END AS kept,
           row_number() OVER (PARTITION BY r.conv_id, e.after ORDER BY
             dp.cost + 5 * u.times + e.price + CASE WHEN r.fault = 3 AND e.edit <> 'D' THEN 5 ELSE 0 END, dp.audit || repeat('I', u.times) || e.edit) AS place
    FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1 JOIN runs u ON u.state = dp.state JOIN edits e ON e.reached = u.reached
    WHERE (e.edit = 'D' OR r.fault NOT IN (1, 2)) AND (e.edit <> 'K' OR e.needs = r.initial)) WHERE place = 1),
ends AS (
  SELECT dp.conv_id, dp.cost + 5 * u.times AS cost, dp.audit || repeat('I', u.times) AS audit, dp.kept || u.added AS kept,
         row_number() OVER (PARTITION BY dp.conv_id ORDER BY dp.cost + 5 * u.times, dp.audit || repeat('I', u.times)) AS place
  FROM dp JOIN counts ON counts.conv_id IS NOT DISTINCT FROM dp.conv_id AND counts.n = dp.i JOIN runs u ON u.state = dp.state WHERE u.reached IN (0, 3))
SELECT a.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate,
       coalesce(c.truncated, 0)::BIGINT AS truncated, coalesce(b.illegal, 0)::BIGINT AS illegal, coalesce(e.cost, 0)::BIGINT AS cost,
       coalesce(e.audit, '') AS audit, sha256(coalesce(array_to_string(e.kept, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN bad b ON b.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM a.conv_id AND e.place = 1
"""
