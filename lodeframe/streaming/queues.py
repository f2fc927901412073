"""Queues: pops that wait for an element, as a keyed stream of pushes and requests.

Elements and waiting requests of a queue are maps of the state store, numbered in the order they came; a request that is
not served in time is answered with nothing, on a timer. A moved element is an answer whose target is another queue: feed
the answers back as its pushes (`moves`). The session needs Spark's RocksDB state store (`groups.STORE`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: kind: "lpush", "rpush", "blpop" or "brpop". seq orders what one batch brings. A push has a value; a request its name,
#: how many elements it takes at most, how long it waits in milliseconds (0: for ever) and, if they move on, the target.
INPUT = "key string, seq long, kind string, value string, request string, count long, wait long, target string"
OUTPUT = "key string, request string, i long, value string, target string, timed_out boolean"


class _Queue(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.elements = handle.getMapState("elements", "place long", "value string")
        self.waiting = handle.getMapState("waiting", "place long", "request string, left boolean, count long, due long, target string")
        self.ends = handle.getValueState("ends", "first long, next long, asked long, head long")

    def load(self) -> None:
        self.first, self.next, self.asked, self.head = self.ends.get() if self.ends.exists() else (0, 0, 0, 0)

    def save(self) -> None:
        self.ends.update((self.first, self.next, self.asked, self.head))

    def push(self, value: str, left: bool) -> None:
        if left:
            self.first -= 1
        self.elements.updateValue((self.first if left else self.next,), (value,))
        if not left:
            self.next += 1

    def serve(self, key: tuple) -> list[tuple]:
        """Waiting requests in their order, as far as elements go."""
        out = []
        while self.head < self.asked and self.first < self.next:
            if self.waiting.containsKey((self.head,)):
                request, left, count, _, target = self.waiting.getValue((self.head,))
                for i in range(min(count, self.next - self.first)):
                    place = self.first if left else self.next - 1
                    out.append((*key, request, i, self.elements.getValue((place,))[0], target, False))
                    self.elements.removeKey((place,))
                    self.first, self.next = self.first + left, self.next - (not left)
                self.waiting.removeKey((self.head,))
            self.head += 1
        return out

    def result(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.load()
        out, now = [], timerValues.getCurrentProcessingTimeInMs()
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples():
            if r.kind in ("lpush", "rpush"):
                self.push(r.value, r.kind == "lpush")
            else:
                wait, target = int(r.wait or 0), r.target if isinstance(r.target, str) else None
                self.waiting.updateValue((self.asked,), (r.request, r.kind == "blpop", int(r.count or 1), now + wait if wait else 0, target))
                self.asked += 1
                if wait:
                    self.handle.registerTimer(now + wait)
            out += self.serve(key)
        self.save()
        yield self.result(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentProcessingTimeInMs(), []
        for place, (request, _, _, due, target) in list(self.waiting.iterator()):
            if due and due <= now:
                self.waiting.removeKey(place)
                out.append((*key, request, 0, None, target, True))
        yield self.result(out)

    def close(self) -> None:
        pass


def pops(events: DataFrame) -> DataFrame:
    """Answers (OUTPUT) of a stream of pushes and requests (INPUT): an element each, or one row that timed out."""
    return events.groupBy("key").transformWithStateInPandas(_Queue(), OUTPUT, "append", "processingTime")


def moves(answers: DataFrame, left: bool = True) -> DataFrame:
    """Answers that move on, as pushes (INPUT) to their targets."""
    null = lambda t: F.lit(None).cast(t)
    moved = answers.where("target IS NOT NULL AND NOT timed_out")
    return moved.select(F.col("target").alias("key"), F.col("i").alias("seq"), F.lit("lpush" if left else "rpush").alias("kind"), "value", null("string").alias("request"), null("long").alias("count"), null("long").alias("wait"), null("string").alias("target"))
