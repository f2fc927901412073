"""Events seen as time series (a key per type or user) and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeframe.operators import streams as xs
from lodeframe.operators import timeseries as ts
from lodeframe.plans.registry import Registry
from lodeframe.session import load

ENTRIES = Registry()
HOUR = 3_600_000


def _q(name, f, sql=None):
    ENTRIES.add(name, sql)(f)


def _ms():
    return F.unix_millis(F.col("ts").cast("timestamp"))


def _samples(k, d):
    return load(k, d, "events").select(F.col("event_type").alias("key"), _ms().alias("ts_ms"), "value")


def _meta(k, d):
    types = load(k, d, "events").select("event_type").distinct()
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "money").otherwise("web")
    return types.select(F.col("event_type").alias("key"), F.create_map(F.lit("kind"), kind, F.lit("type"), F.col("event_type")).alias("labels"))


#: Times floored to the hour, so that many samples share one.
def _coarse(k, d):
    return load(k, d, "events").select(F.col("event_type").alias("key"), (_ms() - F.pmod(_ms(), F.lit(HOUR))).alias("ts_ms"), "value", F.col("event_id").alias("seq"))


E = "e AS (SELECT event_type AS key, epoch_us(ts) // 1000 AS ts_ms, value, event_id AS seq, user_id FROM events)"
C = f"c AS (SELECT key, ts_ms - ts_ms % {HOUR} AS ts_ms, value, seq FROM e)"
M = "m AS (SELECT DISTINCT event_type AS key, CASE WHEN event_type IN ('purchase', 'signup') THEN 'money' ELSE 'web' END AS kind FROM events)"
SQL_AGG = {"avg": "avg(value)", "twa": "avg(value)", "sum": "sum(value)", "min": "min(value)", "max": "max(value)", "count": "count(value)::DOUBLE", "first": "arg_min(value, ts_ms)",
           "last": "arg_max(value, ts_ms)", "range": "max(value) - min(value)", "stdp": "stddev_pop(value)", "stds": "coalesce(stddev_samp(value), 0.0)", "varp": "var_pop(value)", "vars": "coalesce(var_samp(value), 0.0)"}
_r4 = lambda df, c="value": df.withColumn(c, F.round(c, 8))
for _k, _s in SQL_AGG.items():
    _q(f"ts_range_{_k}", lambda k, d, a=_k: _r4(ts.aggregate(_samples(k, d), 24 * HOUR, a)), f"WITH {E} SELECT key, ts_ms - ts_ms % {24 * HOUR} AS ts_ms, round({_s}, 8) AS value FROM e GROUP BY 1, 2")
LOW, HIGH = "(SELECT min(ts_ms) + 1000000000 FROM e)", "(SELECT min(ts_ms) + 5000000000 FROM e)"


def _bounds(k, d):
    a = _samples(k, d).agg(F.min("ts_ms")).first()[0]
    return a + 1_000_000_000, a + 5_000_000_000


_q("ts_range", lambda k, d: ts.range_(_samples(k, d), *_bounds(k, d)), f"WITH {E} SELECT key, ts_ms, value FROM e WHERE ts_ms BETWEEN {LOW} AND {HIGH}")
_q("ts_revrange", lambda k, d: ts.first_per_key(ts.range_(_samples(k, d), *_bounds(k, d)), 5, True),
   f"WITH {E}, r AS (SELECT key, ts_ms, value, row_number() OVER (PARTITION BY key ORDER BY ts_ms DESC) AS i FROM e WHERE ts_ms BETWEEN {LOW} AND {HIGH}) SELECT key, ts_ms, value FROM r WHERE i <= 5")
_q("ts_get", lambda k, d: ts.latest(_samples(k, d)), f"WITH {E} SELECT key, max(ts_ms) AS ts_ms, arg_max(value, ts_ms) AS value FROM e GROUP BY 1")
_q("ts_mget", lambda k, d: ts.latest(ts.of_matching(_samples(k, d), _meta(k, d), {"kind": "money"})), f"WITH {E}, {M} SELECT key, max(ts_ms) AS ts_ms, arg_max(value, ts_ms) AS value FROM e SEMI JOIN (SELECT * FROM m WHERE kind = 'money') USING (key) GROUP BY 1")
_q("ts_mrange", lambda k, d: _r4(ts.aggregate(ts.of_matching(_samples(k, d), _meta(k, d), {"kind": "web"}), HOUR, "max")), f"WITH {E}, {M} SELECT key, ts_ms - ts_ms % {HOUR} AS ts_ms, round(max(value), 8) AS value FROM e SEMI JOIN (SELECT * FROM m WHERE kind = 'web') USING (key) GROUP BY 1, 2")
_q("ts_mrevrange", lambda k, d: ts.first_per_key(ts.of_matching(_samples(k, d), _meta(k, d), {"kind": "web"}), 3, True), f"WITH {E}, {M}, r AS (SELECT key, ts_ms, value, row_number() OVER (PARTITION BY key ORDER BY ts_ms DESC) AS i FROM e SEMI JOIN (SELECT * FROM m WHERE kind = 'web') USING (key)) SELECT key, ts_ms, value FROM r WHERE i <= 3")
_q("ts_queryindex", lambda k, d: ts.matching(_meta(k, d), {"kind": "money", "type": "purchase"}), f"WITH {M} SELECT key FROM m WHERE kind = 'money' AND key = 'purchase'")
for _p, _s in (("first", "arg_min(value, seq)"), ("last", "arg_max(value, seq)"), ("min", "min(value)"), ("max", "max(value)"), ("sum", "round(sum(value), 8)")):
    _q(f"ts_dup_{_p}", lambda k, d, p=_p: _r4(ts.resolve(_coarse(k, d), p)) if p == "sum" else ts.resolve(_coarse(k, d), p), f"WITH {E}, {C} SELECT key, ts_ms, {_s} AS value FROM c GROUP BY 1, 2")
_q("ts_del", lambda k, d: ts.info(ts.delete(_samples(k, d), *_bounds(k, d))), f"WITH {E} SELECT key, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM e WHERE NOT ts_ms BETWEEN {LOW} AND {HIGH} GROUP BY 1")
_q("ts_retention", lambda k, d: ts.retain(_samples(k, d), 72 * HOUR), f"WITH {E}, t AS (SELECT key, max(ts_ms) - {72 * HOUR} AS cut FROM e GROUP BY 1) SELECT e.key, ts_ms, value FROM e JOIN t USING (key) WHERE ts_ms >= cut")
_q("ts_info", lambda k, d: ts.info(_samples(k, d)), f"WITH {E} SELECT key, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM e GROUP BY 1")
_q("ts_incrby", lambda k, d: _r4(ts.increment(_samples(k, d))), f"WITH {E} SELECT key, ts_ms, round(sum(value) OVER (PARTITION BY key ORDER BY ts_ms ROWS UNBOUNDED PRECEDING), 8) AS value FROM e")
_q("ts_madd", lambda k, d: ts.info(_samples(k, d).unionByName(_samples(k, d).withColumn("ts_ms", F.col("ts_ms") + 1))), f"WITH {E} SELECT key, 2 * count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) + 1 AS last_ms FROM e GROUP BY 1")


def _rollup(k, d):
    out = ts.rollup(_samples(k, d), 6 * HOUR, ["avg", "max", "count"])
    return out.withColumn("avg", F.round("avg", 7))


_q("ts_rollup", _rollup, f"WITH {E} SELECT key, ts_ms - ts_ms % {6 * HOUR} AS ts_ms, round(avg(value), 7) AS avg, max(value) AS max, count(*)::DOUBLE AS count FROM e GROUP BY 1, 2")
_q("ts_time_weighted", lambda k, d: _r4(ts.time_weighted(_samples(k, d), 24 * HOUR)),
   f"""WITH {E}, b AS (SELECT *, ts_ms - ts_ms % {24 * HOUR} AS b, lead(ts_ms) OVER (PARTITION BY key ORDER BY ts_ms) AS nx FROM e), w AS (SELECT *, (least(coalesce(nx, b + {24 * HOUR}), b + {24 * HOUR}) - ts_ms)::DOUBLE AS dt FROM b)
   SELECT key, b AS ts_ms, round(sum(value * dt) / sum(dt), 8) AS value FROM w GROUP BY 1, 2""")
_q("ts_reduce_groups", lambda k, d: _r4(ts.reduce_groups(_samples(k, d), _meta(k, d), "kind", 24 * HOUR, "sum")), f'WITH {E}, {M} SELECT kind AS "group", ts_ms - ts_ms % {24 * HOUR} AS ts_ms, round(sum(value), 8) AS value FROM e JOIN m USING (key) GROUP BY 1, 2')


def _stream(k, d):
    return load(k, d, "events").select(F.col("user_id").alias("key"), _ms().alias("ms"), F.col("event_id").alias("seq"), "event_type")


X = "x AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS ms, event_id AS seq, event_type FROM events)"
XR = f"WITH {X}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS i, row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) AS b, count(*) OVER (PARTITION BY key) AS n FROM x)"
NOW = 1_800_000_000_000


def _mid(k, d):
    r = _stream(k, d).agg(F.min("ms"), F.max("ms")).first()
    return r[0] + (r[1] - r[0]) // 4, r[0] + (r[1] - r[0]) * 3 // 4


MID = "lo AS (SELECT min(ms) + (max(ms) - min(ms)) // 4 AS a, min(ms) + (max(ms) - min(ms)) * 3 // 4 AS z FROM x)"
_q("xlen", lambda k, d: xs.length(_stream(k, d)), f"WITH {X} SELECT key, count(*) AS length FROM x GROUP BY 1")
_q("xrange", lambda k, d: (lambda m: xs.range_(_stream(k, d), (m[0], 0), (m[1], 1 << 60), 3))(_mid(k, d)), f"WITH {X}, {MID}, r AS (SELECT x.*, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS i FROM x, lo WHERE ms BETWEEN a AND z) SELECT key, ms, seq, event_type FROM r WHERE i <= 3")
_q("xrevrange", lambda k, d: (lambda m: xs.range_(_stream(k, d), (m[0], 0), (m[1], 1 << 60), 2, True))(_mid(k, d)), f"WITH {X}, {MID}, r AS (SELECT x.*, row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) AS i FROM x, lo WHERE ms BETWEEN a AND z) SELECT key, ms, seq, event_type FROM r WHERE i <= 2")
_q("xdel", lambda k, d: xs.length(xs.delete(_stream(k, d), _stream(k, d).where("seq % 3 = 0"))), f"WITH {X} SELECT key, count(*) AS length FROM x WHERE seq % 3 <> 0 GROUP BY 1")
_q("xtrim_maxlen", lambda k, d: xs.trim_to_length(_stream(k, d), 2), f"{XR} SELECT key, ms, seq, event_type FROM r WHERE b <= 2")
_q("xtrim_minid", lambda k, d: xs.trim_to_id(_stream(k, d), (_mid(k, d)[0], 0)), f"WITH {X}, {MID} SELECT x.* FROM x, lo WHERE ms >= a")
_q("xadd", lambda k, d: xs.length(xs.append(_stream(k, d), _stream(k, d).withColumn("ms", F.col("ms") + F.when(F.col("seq") % 2 == 0, 100_000_000_000).otherwise(-1)))), f"WITH {X} SELECT key, count(*) + count(*) FILTER (seq % 2 = 0) AS length FROM x GROUP BY 1")
_offsets = lambda k, d: _stream(k, d).groupBy("key").agg(F.min("ms").alias("last_ms"), F.lit(1 << 60).alias("last_seq"))
_q("xread_multi", lambda k, d: xs.read(_stream(k, d), _offsets(k, d), 2), f"WITH {X}, o AS (SELECT key, min(ms) AS m FROM x GROUP BY 1), r AS (SELECT x.*, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS i FROM x JOIN o USING (key) WHERE ms > m) SELECT key, ms, seq, event_type FROM r WHERE i <= 2")


def _groups(k, d):
    return _stream(k, d).select("key").distinct().select("key", F.lit("g").alias("group"), F.lit(0).cast("long").alias("ms"), F.lit(0).cast("long").alias("seq"))


def _delivered(k, d):
    return xs.deliver(_stream(k, d), _groups(k, d), F.concat(F.lit("c"), (F.col("seq") % 2).cast("string")), 4, NOW)


PEND = "p AS (SELECT key, 'g' AS \"group\", ms, seq, 'c' || seq % 2 AS consumer FROM r WHERE i <= 4)"
_q("xreadgroup", lambda k, d: _delivered(k, d)[1].select("key", "group", "ms", "seq", "consumer"), f'{XR}, {PEND} SELECT * FROM p')
_q("xgroup_offsets", lambda k, d: _delivered(k, d)[0], f"""{XR} SELECT key, 'g' AS "group", ms, seq FROM r WHERE i = least(4, n)""")
_acks = lambda k, d: _delivered(k, d)[1].where("seq % 3 = 0")
_q("xack", lambda k, d: xs.acknowledge(_delivered(k, d)[1], _acks(k, d)).select("key", "ms", "seq"), f"{XR}, {PEND} SELECT key, ms, seq FROM p WHERE seq % 3 <> 0")
_q("xpending_summary", lambda k, d: xs.pending_summary(_delivered(k, d)[1]), f'{XR}, {PEND} SELECT key, "group", consumer, count(*) AS n, min(ms) AS min_ms, arg_min(seq, (ms, seq)) AS min_seq, max(ms) AS max_ms, arg_max(seq, (ms, seq)) AS max_seq FROM p GROUP BY 1, 2, 3')
_q("xpending_detail", lambda k, d: xs.pending_detail(_delivered(k, d)[1], NOW + 500, 500).select("key", "ms", "seq", "consumer", "idle_ms"), f"{XR}, {PEND} SELECT key, ms, seq, consumer, 500::BIGINT AS idle_ms FROM p")
_q("xclaim", lambda k, d: xs.claim(_delivered(k, d)[1], _acks(k, d), "other", NOW + 10, 5).select("key", "ms", "seq", "consumer", "deliveries"), f"{XR}, {PEND} SELECT key, ms, seq, CASE WHEN seq % 3 = 0 THEN 'other' ELSE consumer END AS consumer, CASE WHEN seq % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS deliveries FROM p")
_q("xautoclaim", lambda k, d: xs.auto_claim(_delivered(k, d)[1], _stream(k, d).where("seq % 5 <> 0"), "auto", NOW + 10, 5), f"{XR}, {PEND} SELECT key, \"group\", ms, seq, 'auto' AS consumer, 2::BIGINT AS deliveries, seq % 5 = 0 AS deleted FROM p")
_q("xinfo_groups", lambda k, d: xs.group_info(_stream(k, d), _delivered(k, d)[0], xs.acknowledge(_delivered(k, d)[1], _acks(k, d))), f"""{XR}, {PEND}, q AS (SELECT key, count(DISTINCT consumer) AS consumers, count(*) AS pending FROM p WHERE seq % 3 <> 0 GROUP BY 1) SELECT r.key, 'g' AS "group", coalesce(any_value(consumers), 0)::BIGINT AS consumers, coalesce(any_value(pending), 0)::BIGINT AS pending, greatest(count(*) - 4, 0)::BIGINT AS lag FROM r LEFT JOIN q USING (key) GROUP BY 1""")
_q("xinfo_stream", lambda k, d: xs.stream_info(_stream(k, d)), f"WITH {X} SELECT key, count(*) AS length, min(ms) AS first_ms, max(ms) AS last_ms FROM x GROUP BY 1")
_heads = lambda k, d: _stream(k, d).groupBy("key").agg(F.max(xs.id_of()).alias("x")).select("key", "x.ms", "x.seq")
_shift = lambda k, d: _heads(k, d).withColumn("ms", F.col("ms") + F.when(F.col("key") % 2 == 0, 1000).otherwise(-1000))
_q("xsetid", lambda k, d: xs.set_last_id(_heads(k, d), _shift(k, d)), f"{XR} SELECT key, ms + CASE WHEN key % 2 = 0 THEN 1000 ELSE 0 END AS ms, seq FROM r WHERE b = 1")
_other = lambda k, d: _groups(k, d).where("key % 3 = 0").withColumn("group", F.when(F.col("key") % 2 == 0, "g").otherwise("h")).withColumn("ms", F.lit(5).cast("long"))
_q("xgroup_create", lambda k, d: xs.create_groups(_groups(k, d), _other(k, d)), f"""WITH {X}, k AS (SELECT DISTINCT key FROM x) SELECT key, 'g' AS "group", 0::BIGINT AS ms, 0::BIGINT AS seq FROM k UNION ALL SELECT key, 'h', 5, 0 FROM k WHERE key % 3 = 0 AND key % 2 = 1""")
_q("xgroup_setid", lambda k, d: xs.set_group_ids(_groups(k, d), _other(k, d)), f"""WITH {X} SELECT DISTINCT key, 'g' AS "group", CASE WHEN key % 6 = 0 THEN 5 ELSE 0 END::BIGINT AS ms, 0::BIGINT AS seq FROM x""")
_q("xgroup_destroy", lambda k, d: xs.destroy_groups(_groups(k, d), _delivered(k, d)[1], _other(k, d))[1].groupBy("key").agg(F.count("*").alias("n")), f"{XR}, {PEND} SELECT key, count(*) AS n FROM p WHERE key % 6 <> 0 GROUP BY 1")
_q("xgroup_delconsumer", lambda k, d: xs.delete_consumer(_delivered(k, d)[1], "c1").select("key", "ms", "seq"), f"{XR}, {PEND} SELECT key, ms, seq FROM p WHERE consumer <> 'c1'")
_q("xinfo_consumers", lambda k, d: xs.consumer_info(_delivered(k, d)[1], NOW + 700), f'{XR}, {PEND} SELECT key, "group", consumer, count(*) AS pending, 700::BIGINT AS idle_ms FROM p GROUP BY ALL')


def _registered(k, d):
    return _meta(k, d).withColumn("retention_ms", F.when(F.col("key") == "click", 0).otherwise(86_400_000).cast("long")).withColumn("duplicates", F.lit("last"))


_named = lambda df: df.select("key", F.col("labels")["kind"].alias("kind"), "retention_ms", "duplicates")
SERIES = "s AS (SELECT DISTINCT event_type AS key, CASE WHEN event_type IN ('purchase', 'signup') THEN 'money' ELSE 'web' END AS kind, CASE WHEN event_type = 'click' THEN 0 ELSE 86400000 END::BIGINT AS retention_ms, 'last' AS duplicates FROM events)"
_q("ts_create", lambda k, d: _named(ts.create(_registered(k, d).where("key <> 'view'"), _registered(k, d).withColumn("duplicates", F.lit("sum")))), f"WITH {SERIES} SELECT key, kind, retention_ms, CASE WHEN key = 'view' THEN 'sum' ELSE duplicates END AS duplicates FROM s")
_q("ts_alter", lambda k, d: _named(ts.alter(_registered(k, d), _registered(k, d).where("key IN ('view', 'error')").withColumn("labels", F.lit(None).cast("map<string,string>")).withColumn("retention_ms", F.lit(60_000).cast("long")).withColumn("duplicates", F.lit(None).cast("string")))),
   f"WITH {SERIES} SELECT key, kind, CASE WHEN key IN ('view', 'error') THEN 60000 ELSE retention_ms END AS retention_ms, duplicates FROM s")
_rules = lambda k, d: _meta(k, d).select(F.col("key").alias("source"), F.explode(F.array(F.lit("avg"), F.lit("max"))).alias("kind")).withColumn("target", F.concat("source", F.lit("_"), "kind")).withColumn("ms", F.lit(HOUR).cast("long"))
_q("ts_deleterule", lambda k, d: ts.delete_rules(_rules(k, d), _rules(k, d).where("kind = 'avg' AND source <> 'view'")).select("source", "target"), "SELECT DISTINCT event_type AS source, event_type || '_' || k AS target FROM events, (SELECT unnest(['avg', 'max']) AS k) WHERE k = 'max' OR event_type = 'view'")
_q("ts_retention_each", lambda k, d: ts.retain_each(_samples(k, d), _registered(k, d)).groupBy("key").agg(F.count("*").alias("n")), f"WITH {SERIES}, e AS (SELECT event_type AS key, epoch_us(ts) // 1000 AS ms, max(epoch_us(ts) // 1000) OVER (PARTITION BY event_type) AS z FROM events) SELECT e.key, count(*) AS n FROM e JOIN s USING (key) WHERE retention_ms = 0 OR ms >= z - retention_ms GROUP BY 1")
