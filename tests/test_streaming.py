"""Streaming forms over files, run to the end of what is there."""

import datetime as dt
import time

from pyspark.sql import functions as F

from lodeframe.functions.registry import Functions
from lodeframe.sources import tables
from lodeframe.streaming import groups, queues, rollups


def _drain(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_rollup_sessions_and_unique(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    data = [(i, "k", t0 + dt.timedelta(minutes=i), float(i)) for i in range(60)] + [(5, "k", t0 + dt.timedelta(minutes=5), 5.0), (99, "k", t0 + dt.timedelta(hours=9), 1.0)]
    tables.save(spark.createDataFrame(data, "id int, key string, ts timestamp, value double").coalesce(1), str(tmp_path / "in"))
    read = lambda: tables.tail(spark, str(tmp_path / "in"), "id int, key string, ts timestamp, value double")
    got = _drain(rollups.rollup(read(), "ts", "key", "value", "10 minutes", "5 minutes"), tmp_path, "roll").orderBy("start").collect()
    assert [r.n for r in got[:6]] == [11, 10, 10, 10, 10, 10] and got[0]["sum"] == 50.0
    got = _drain(rollups.sessions(read(), "ts", "key", "30 minutes", "5 minutes"), tmp_path, "sess").collect()
    assert [r.n for r in got] == [61]
    assert _drain(rollups.unique(read(), "ts", ["id"], "1 hour"), tmp_path, "uniq").count() == 61


def _resumed(spark, tmp_path, name, make, wait=0):
    """All that a query has put out so far: each run goes on from the checkpoint of the one before, and waits for timers."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set(*groups.STORE)
    try:
        q = make().writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(processingTime="500 milliseconds").start()
        began, seen = time.time(), 0  # a query with timers goes on without end
        while time.time() - began < 60 and not (seen and time.time() - seen > wait + 1):
            time.sleep(0.25)
            seen = seen or (time.time() if any(p["numInputRows"] for p in q.recentProgress) else 0)
        q.stop()
    finally:
        spark.conf.unset(groups.STORE[0])
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    return tables.restore(spark, str(tmp_path / f"{name}-out")).collect()


def test_consumer_group(spark, tmp_path):
    path = str(tmp_path / "log")
    add = lambda rows: tables.save(spark.createDataFrame(rows, groups.INPUT).coalesce(1), path, mode="append")
    out = lambda wait: _resumed(spark, tmp_path, "group", lambda: groups.deliver(tables.tail(spark, path, groups.INPUT), ["a", "b"], 6_000), wait)
    add([("s", "g", "add", 1, 0, 0), ("s", "g", "add", 2, 0, 0), ("s", "g", "add", 3, 0, 0), ("s", "h", "add", 1, 0, 0), ("s", "g", "ack", 3, 0, 0)])
    got = sorted((r.group, r.ms, r.consumer, r.deliveries) for r in out(0))
    assert got == [("g", 1, "a", 1), ("g", 2, "b", 1), ("g", 3, "a", 1), ("h", 1, "a", 1)]
    # Nothing more of h and of entry 2: they come again all the same, and what was acknowledged does not.
    add([("s", "g", "ack", 1, 0, 0), ("other", "g", "add", 9, 0, 0)])
    got = {(r.key, r.group, r.ms) for r in out(9) if r.deliveries >= 2}
    assert {("s", "g", 2), ("s", "h", 1)} <= got and ("s", "g", 3) not in got


def test_queues(spark, tmp_path):
    path, n = str(tmp_path / "queue"), None
    add = lambda rows: tables.save(spark.createDataFrame(rows, queues.INPUT).coalesce(1), path, mode="append")
    out = lambda: _resumed(spark, tmp_path, "queue", lambda: queues.pops(tables.tail(spark, path, queues.INPUT)), 2)
    add([("q", 1, "rpush", "a", n, n, n, n), ("q", 2, "rpush", "b", n, n, n, n), ("q", 3, "lpush", "z", n, n, n, n), ("q", 4, "blpop", n, "r1", 1, 0, n), ("q", 5, "brpop", n, "r2", 5, 0, "t"),
         ("q", 6, "blpop", n, "r3", 1, 0, n), ("q", 7, "blpop", n, "r4", 1, 0, n), ("p", 1, "brpop", n, "r5", 1, 1, n)])
    got = out()
    assert sorted((r.request, r.i, r.value) for r in got if r.key == "q") == [("r1", 0, "z"), ("r2", 0, "b"), ("r2", 1, "a")]
    # Two requests wait, and are served in their order by a later run; the one that waits no longer is told so.
    add([("q", 1, "rpush", "c", n, n, n, n), ("q", 2, "rpush", "d", n, n, n, n), ("q", 3, "rpush", "e", n, n, n, n), ("p", 1, "rpush", "late", n, n, n, n)])
    got = out()
    assert sorted((r.request, r.value) for r in got if r.request in ("r3", "r4")) == [("r3", "c"), ("r4", "d")]
    assert [(r.value, r.timed_out) for r in got if r.key == "p"] in ([(None, True)], [("late", False)])
    moved = queues.moves(spark.createDataFrame(got, queues.OUTPUT)).collect()
    assert sorted((r.key, r.kind, r.value) for r in moved) == [("t", "lpush", "a"), ("t", "lpush", "b")]


def test_publish(spark, tmp_path):
    tables.save(spark.createDataFrame([("news.a", "1"), ("news.b", "2"), ("other", "3")], "channel string, message string").coalesce(1), str(tmp_path / "in"))
    rollups.publish(tables.tail(spark, str(tmp_path / "in"), "channel string, message string"), "channel", "news.*", str(tmp_path / "sink"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.message for r in tables.restore(spark, str(tmp_path / "sink")).collect()) == ["1", "2"]


def test_feed_and_functions(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "key string, v int")
    assert sorted(map(tuple, rollups.changes(old, new, "key").collect())) == [("a", "del"), ("b", "change"), ("c", "set")]
    assert rollups.published(new.withColumnRenamed("key", "channel"), "channel", "[bx]*").count() == 1
    fs = Functions(spark)
    digest = fs.load("twice", lambda x: x * 2, "int")
    assert spark.sql("SELECT twice(21)").first()[0] == 42 and fs.exists(digest, "no") == [True, False]
    fs.delete("twice")
    assert spark.range(1).select(F.lit(1)).count() == 1
