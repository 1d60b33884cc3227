import random

from tallyforge.streaming import workflow


def test_state_of_items_from_late_and_repeated_events(spark, tmp_path):
    draw = random.Random(6)
    events = [(f"i{k % 7}", k, draw.choice(["resolve", "assign", "snooze", "note"]), f"by{k}", f"n{k}", None if k % 3 else f"to{k}", f"2025-06-{k % 28 + 1:02}", draw.choice(["x", "y"])) for k in range(60)]
    events += [(f"i{k}", 100, "status", None, None, None, None, "x") for k in range(6)] + [("i9", 100, "status", None, None, None, None, "y"), ("i0", 50, "status", None, None, None, None, "late")]
    draw.shuffle(events)
    for k in range(3):
        spark.createDataFrame(events[k * 20 : k * 20 + 40], workflow.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")  # halves come twice
    workflow.stream(spark, f"{tmp_path}/in", f"{tmp_path}/check", f"{tmp_path}/out").awaitTermination()
    got = {r.item_id: r for r in workflow.latest(spark, f"{tmp_path}/out").collect()}
    assert set(got) == {f"i{k}" for k in range(7)} | {"i9"}
    for item, r in got.items():
        mine = sorted({e for e in events if e[0] == item}, key=lambda e: e[1])
        acts = [e for e in mine if e[2] != "status"]
        last = lambda kinds, rows=acts: next((e for e in reversed(rows) if e[2] in kinds), None)  # noqa: E731, B023
        move, assign, snooze, note, state = last(("resolve", "assign", "snooze")), last(("assign",)), last(("snooze",)), last(("note",)), last(("status",), mine)
        assert r.n_actions == len(acts) and r.last_action == (move[2] if move else "open")
        assert r.assignee == (assign and (assign[5] or assign[3])) and r.snooze_until == (snooze and snooze[6]) and r.last_note == (note and note[4])
        seen, now = acts[-1][7] if acts else None, state[7] if state else None
        assert (r.seen_status, r.status) == (seen, now)
        assert r.reopened == bool(move and move[2] == "resolve" and now and seen != now)
    spark.createDataFrame([("i0", 200, "resolve", "b", None, None, None, "x")], workflow.EVENTS).write.mode("append").parquet(f"{tmp_path}/in")
    workflow.stream(spark, f"{tmp_path}/in", f"{tmp_path}/check", f"{tmp_path}/out").awaitTermination()  # goes on from its state
    r = {r.item_id: r for r in workflow.latest(spark, f"{tmp_path}/out").collect()}["i0"]
    assert r.workflow == "resolved" and r.n_actions == got["i0"].n_actions + 1
