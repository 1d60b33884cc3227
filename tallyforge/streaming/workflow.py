"""The workflow of queue items as a stream: actions and changes of status go in, in any order and possibly again, and each item's state comes out."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: What goes in: an operator's action, or with action ``status`` an item's status as of a close, both numbered by the source.
EVENTS = "item_id string, seq long, action string, by string, note string, assignee string, snooze_until string, status string"
#: What comes out, for each item that an event has changed.
STATE = "item_id string, last_action string, workflow string, assignee string, snooze_until string, last_note string, seen_status string, status string, reopened boolean, n_actions long"
#: What an action makes of an item.
WORKFLOW = {"resolve": "resolved", "assign": "assigned", "snooze": "snoozed", "open": "open"}
#: The kept facts: of each the number of the event that it comes from, and its value. The event with the greatest number counts.
FACTS = ["move", "assignee", "snooze", "note", "seen", "status"]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def facts_of(event) -> dict[str, str | None]:
    """What an event says about its item."""
    told: dict[str, str | None] = {}
    if event.action == "status":
        told["status"] = event.status
        return told
    told["seen"] = event.status
    if event.action == "note":
        told["note"] = event.note
    else:
        told["move"] = event.action
    if event.action == "assign":
        told["assignee"] = event.assignee if event.assignee is not None else event.by
    if event.action == "snooze":
        told["snooze"] = event.snooze_until
    return told


class Items(StatefulProcessor):
    """A value for each item: its facts, and the numbers of the actions that were counted, so that a repeated one changes nothing and a
    late one only what no later one has said. It is read and written once a batch, however many events its item has there."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = ", ".join(f"{fact}_seq long, {fact} string" for fact in FACTS)
        self.facts = handle.getValueState("facts", f"{fields}, counted array<long>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.facts.get() or (*[-1, None] * len(FACTS), [])
        facts = {fact: (held[2 * i], held[2 * i + 1]) for i, fact in enumerate(FACTS)}
        counted = set(held[-1])
        for event in rows:
            if event.action != "status":
                if event.seq in counted:
                    continue
                counted.add(event.seq)
            for fact, value in facts_of(event).items():
                if event.seq > facts[fact][0]:
                    facts[fact] = (event.seq, value)
        self.facts.update((*(x for fact in FACTS for x in facts[fact]), sorted(counted)))
        value = {fact: facts[fact][1] for fact in FACTS}
        move = value["move"] or "open"
        reopened = move == "resolve" and value["status"] is not None and value["seen"] is not None and value["seen"] != value["status"]
        workflow = "open" if reopened else WORKFLOW[move]
        told = (key[0], move, workflow, value["assignee"], value["snooze"], value["note"], value["seen"], value["status"], reopened, len(counted))
        yield Row(*(c.split()[0] for c in STATE.split(", ")))(*told)

    def close(self) -> None:
        pass


def followed(events: DataFrame) -> DataFrame:
    """Item states (``STATE``) from a stream of events (``EVENTS``), in update mode. The session's state store must be RocksDB."""
    return events.groupBy("item_id").transformWithState(Items(), STATE, outputMode="Update", timeMode="None")


def stream(spark: SparkSession, folder: str, checkpoint: str, out: str, files: int = 1) -> StreamingQuery:
    """Follow Parquet files of events in a folder, ``files`` a batch, oldest first, and write each batch's changed states under ``out`` by batch number. A batch
    that runs again overwrites its own."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(folder)

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return followed(events).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """Each item's last state."""
    states = spark.read.schema(f"{STATE}, batch int").parquet(out)
    columns = [c.split()[0] for c in STATE.split(", ")][1:]
    return states.groupBy("item_id").agg(F.max_by(F.struct(*columns), "batch").alias("s")).select("item_id", "s.*")
