"""Consumer groups on a stream: entries are assigned to consumers and stay pending until acknowledged; those that
idle too long are delivered again, on a timer, whether or not the key is heard of again.

State is kept per (key, group) in maps of the state store, one entry for each pending id, so a batch writes only what it
changes; it survives a restart of the query. The session needs Spark's RocksDB state store (`STORE`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The setting that keyed state with timers asks for.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Entries in, acknowledgements too: kind is "add" or "ack". Times are milliseconds.
INPUT = "key string, group string, kind string, ms long, seq long, now long"
OUTPUT = "key string, group string, ms long, seq long, consumer string, deliveries long, lag long"


class _Group(StatefulProcessor):
    def __init__(self, consumers: list[str], min_idle: int):
        self.consumers, self.min_idle = consumers, min_idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "ms long, seq long", "consumer string, due long, deliveries long")
        self.turn = handle.getValueState("turn", "turn long")

    def next_one(self) -> str:
        turn = self.turn.get()[0] if self.turn.exists() else 0
        self.turn.update((turn + 1,))
        return self.consumers[turn % len(self.consumers)]

    def give(self, key: tuple, place: tuple, now: int, deliveries: int) -> tuple:
        who = self.next_one()
        self.pending.updateValue(place, (who, now + self.min_idle, deliveries))
        self.handle.registerTimer(now + self.min_idle)
        return (*key, *place, who, deliveries)

    def result(self, rows: list[tuple]) -> pd.DataFrame:
        lag = sum(1 for _ in self.pending.keys()) if rows else 0
        return pd.DataFrame([(*r, lag) for r in rows], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, now, batch = [], timerValues.getCurrentProcessingTimeInMs(), pd.concat(list(rows))
        for r in batch[batch["kind"] == "add"].drop_duplicates(["ms", "seq"]).sort_values(["ms", "seq"]).itertuples():
            if not self.pending.containsKey((int(r.ms), int(r.seq))):
                out.append(self.give(key, (int(r.ms), int(r.seq)), now, 1))
        # After the entries, so that one of the same batch can be acknowledged.
        for r in batch[batch["kind"] == "ack"].itertuples():
            if self.pending.containsKey((int(r.ms), int(r.seq))):
                self.pending.removeKey((int(r.ms), int(r.seq)))
        yield self.result(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        late = sorted((tuple(k), v[2]) for k, v in self.pending.iterator() if v[1] <= now)
        yield self.result([self.give(key, place, now, deliveries + 1) for place, deliveries in late])

    def close(self) -> None:
        pass


def deliver(events: DataFrame, consumers: list[str], min_idle: int) -> DataFrame:
    """Deliveries of a stream of entries and acknowledgements (INPUT), consumers of a group taking turns, at least once.

    An entry that is pending for min_idle milliseconds goes to the next consumer, delivered once more. lag: how many
    entries of the group are pending after the batch.
    """
    return events.groupBy("key", "group").transformWithStateInPandas(_Group(consumers, min_idle), OUTPUT, "append", "processingTime")
