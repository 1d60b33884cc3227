import hashlib
import itertools
import random
import re
import zlib

import pytest

from tallyforge.llm import repair
from tallyforge.llm.common import Scratch

SPACE = " \t\n\x0b\x0c\r"


def plain(conv_id, rows):
    """Every sequence of edits, with up to two insertions before each turn and at the end, of one damaged conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.rstrip(SPACE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    best = None
    for moves in itertools.product(*([(n, e) for n in range(3) for e in ("D", "K", "Ru", "Ra")] for _ in rows)):
        if any(fault in ("blank", "duplicate") and e != "D" for fault, (_, e) in zip(faults, moves, strict=True)):
            continue
        for last in range(3):
            cost = 5 * (last + sum(n for n, _ in moves)) + sum({"D": 2, "K": 0}.get(e, 1) + 5 * (f == "truncated" and e != "D") for f, (_, e) in zip(faults, moves, strict=True))
            if best and cost > best[0]:
                continue
            audit, lines, text = "", [], ""
            for (_, role, said), (n, e) in zip(rows, moves, strict=True):
                audit += "I" * n + e[0]
                lines += [None] * n + ([] if e == "D" else [(role, said) if e == "K" else ({"u": "user", "a": "assistant"}[e[1]], said)])
            lines += [None] * last
            audit += "I" * last
            for k in range(2 ** lines.count(None)):
                bits = iter(f"{k:09b}"[::-1])
                done = [line or (("user", "") if next(bits) == "0" else ("assistant", "")) for line in lines]
                if re.fullmatch("(s?(ua)+)?", "".join(role[:1] or "-" for role, _ in done)):
                    text = "\n".join(f"{role}:{said}" for role, said in done)
                    best = min(best or (cost, audit, text), (cost, audit, text), key=lambda x: x[:2])
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    first = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
    return (conv_id, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest())


def damage(rows):
    for conv_id, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv_id, turn))
        kind, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        if kind:
            row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            yield from [(conv_id, row)] * (2 if kind == 3 else 1)


def conversations(draw, n, longest):
    for conv_id in [None, *range(n)]:
        for turn in range(draw.randrange(longest + 1)):
            role = draw.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "ute"])
            text = draw.choice(["Yes.", "No!", "cut", "x?\n", " \x0b", "", None, "Yes.", "é."])
            yield conv_id, draw.choice([turn, turn, 2 * turn, 0, None]), role, text


@pytest.mark.parametrize("chunk", [4096, 1, 2])
def test_like_all_edits(spark, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rows = list(conversations(random.Random(13), 60, 3))
    by = {conv_id: [] for conv_id, *_ in rows}
    for conv_id, row in damage(rows):
        by[conv_id].append(row)
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, cost int")
    got = repair.digests(df, Scratch(spark, "repair")).collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted((plain(i, of) for i, of in by.items()), key=key)


def strings(initials, faults):
    """The same dynamic program with whole edit strings."""
    layer = {repair.START: (0, "")}
    for initial, fault in zip(initials, faults, strict=True):
        ways = {}
        for (state, to), (cost, code) in repair.macros(initial, fault).items():
            if state in layer:
                way = (layer[state][0] + cost, layer[state][1] + code)
                ways[to] = min(way, ways.get(to, way))
        layer = ways
    return layer


def test_ranks_and_parents_stand_for_strings():
    draw = random.Random(4)
    for _ in range(200):
        n = draw.randrange(1, 60)
        initials, faults = [draw.choice(["u", "a", "s", ""]) for _ in range(n)], [draw.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        costs, _ = repair.passed(initials, faults, repair.START)
        for state, (cost, audit) in strings(initials, faults).items():
            assert costs[state] == cost and "".join(repair.walked(initials, faults, repair.START, state)) == audit
        cuts = sorted(draw.sample(range(1, n), min(n - 1, 3)))
        parts = []
        for start, stop in zip([0, *cuts], [*cuts, n], strict=True):
            way = [repair.passed(initials[start:stop], faults[start:stop], state) for state in range(4)]
            parts.append((sum((c for c, _ in way), []), sum((r for _, r in way), [])))
        whole = [repair.passed(initials, faults, state) for state in range(4)]
        assert repair.put_together(parts)[0] == repair.put_together([(sum((c for c, _ in whole), []), sum((r for _, r in whole), []))])[0]


def test_long_conversation_over_many_chunks(spark, monkeypatch):
    rows = [(1, t, draw, f"{t % 50} said{'' if t % 7 else '.'}") for t, draw in enumerate(random.Random(3).choices(["user", "assistant", "system"], k=900))] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Hi.")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    told = []
    for chunk in (4096, 37):
        monkeypatch.setattr(repair, "CHUNK", chunk)
        found = repair.repair(df, Scratch(spark, "repair"))
        told.append(sorted(map(tuple, found.conversations.collect())))
        pieces = found.pieces.orderBy("rank").collect()
        told[-1].append("".join(p.audit for p in pieces if p.conv_id == 1))
        told[-1].append("\n".join(p.repaired for p in pieces if p.conv_id == 1 and p.repaired is not None))
    assert told[0] == told[1] and len(told[0][-2].replace("I", "")) == 900
    assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in told[0][-1].split("\n")))


def test_empty(spark):
    assert repair.digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), Scratch(spark, "repair")).collect() == []
