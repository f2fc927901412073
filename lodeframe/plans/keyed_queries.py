"""Strings (customers and event counters), lists (conversations), hashes (parts) and keys with an expiry (orders)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeframe.operators import hashes, keyspace, lists, strings
from lodeframe.plans.registry import Registry
from lodeframe.session import load

ENTRIES = Registry()


def _q(name, f, sql=None):
    ENTRIES.add(name, sql)(f)


NOW = 700_000_000_000


def _names(k, d):
    return load(k, d, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))


def _docs(k, d):
    return load(k, d, "documents").select("doc_id", "text")


def _log(k, d):
    e = load(k, d, "events")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").cast("long").alias("delta"), F.col("event_type").alias("value"))


LOG = "log AS (SELECT user_id AS key, event_id AS seq, CAST(json_extract_string(props, '$.k') AS BIGINT) AS delta, event_type AS value FROM events)"
N = "n AS (SELECT c_name AS key, c_mktsegment AS value FROM customer)"
_keys = lambda k, d: load(k, d, "customer").select(F.col("c_custkey").alias("pos"), F.concat(F.lit("Customer#"), F.lpad((F.col("c_custkey") * 2).cast("string"), 9, "0")).alias("key"))
KEYS = "ks AS (SELECT c_custkey AS pos, 'Customer#' || lpad((c_custkey * 2)::VARCHAR, 9, '0') AS key FROM customer)"

_q("str_get", lambda k, d: _names(k, d).where(F.col("key") == "Customer#000000007"), f"WITH {N} SELECT * FROM n WHERE key = 'Customer#000000007'")
_q("str_mget", lambda k, d: strings.multi_get(_names(k, d), _keys(k, d)), f"WITH {N}, {KEYS} SELECT ks.key, pos, value FROM ks LEFT JOIN n USING (key)")
_q("str_strlen", lambda k, d: _docs(k, d).select("doc_id", strings.byte_length(F.col("text")).alias("length")), "SELECT doc_id, strlen(text) AS length FROM documents")
_q("str_getrange", lambda k, d: _docs(k, d).select("doc_id", F.hex(strings.get_range(F.col("text"), 3, -5)).alias("part")),
   "SELECT doc_id, CASE WHEN strlen(text) < 8 THEN '' ELSE substr(hex(encode(text)), 7, 2 * (strlen(text) - 7)) END AS part FROM documents")
_q("str_setrange", lambda k, d: _names(k, d).select("key", F.decode(strings.set_range(F.col("value"), 3, "xyz"), "utf-8").alias("value")),
   f"WITH {N} SELECT key, substr(value, 1, 3) || 'xyz' || substr(value, 7) AS value FROM n")
_q("str_append", lambda k, d: strings.append(_log(k, d).select("key", "seq", "value")), f"WITH {LOG} SELECT key, string_agg(value, '' ORDER BY seq) AS value, strlen(string_agg(value, '' ORDER BY seq)) AS length FROM log GROUP BY 1")
_q("str_incrby", lambda k, d: strings.counters(_log(k, d)), f"WITH {LOG} SELECT key, CAST(sum(delta) AS BIGINT) AS value FROM log GROUP BY 1")
_q("str_incrby_running", lambda k, d: strings.running(_log(k, d).select("key", "seq", "delta")), f"WITH {LOG} SELECT key, seq, delta, CAST(sum(delta) OVER (PARTITION BY key ORDER BY seq) AS BIGINT) AS value FROM log")
_q("str_incrbyfloat", lambda k, d: load(k, d, "customer").select(F.col("c_name").alias("key"), F.round(strings.float_increment(F.col("c_acctbal"), F.lit(0.25)), 4).alias("value")), "SELECT c_name AS key, round(c_acctbal + 0.25, 4) AS value FROM customer")
_q("str_getset_lag", lambda k, d: strings.previous(_log(k, d).select("key", "seq", "value")), f"WITH {LOG} SELECT key, seq, value, lag(value) OVER (PARTITION BY key ORDER BY seq) AS old FROM log")
_q("str_upsert_last", lambda k, d: strings.last_write(_log(k, d).withColumn("expire_at", F.col("delta") * 1000)), f"WITH {LOG} SELECT key, arg_max(value, seq) AS value, arg_max(delta * 1000, seq) AS expire_at FROM log GROUP BY 1")
_q("str_setnx", lambda k, d: strings.set_if_absent(_names(k, d).where("key < 'Customer#000000500'"), _names(k, d).withColumn("value", F.lit("new"))), f"WITH {N} SELECT key, CASE WHEN key < 'Customer#000000500' THEN value ELSE 'new' END AS value FROM n")
_q("str_msetnx", lambda k, d: strings.set_all_if_none(_names(k, d), _names(k, d).limit(0).unionByName(k.createDataFrame([("a", "1"), ("Customer#000000001", "2")], "key string, value string"))), f"WITH {N} SELECT * FROM n")
_q("str_delex", lambda k, d: strings.compare_and_delete(_names(k, d), F.col("value") == "BUILDING"), f"WITH {N} SELECT * FROM n WHERE value <> 'BUILDING'")
_q("str_digest", lambda k, d: _names(k, d).select("key", strings.digest(F.col("value")).alias("digest")))
_q("str_lcs_length", lambda k, d: load(k, d, "part").select("p_partkey", strings.lcs_length(F.col("p_brand"), F.lit("Brand#99")).alias("length")), "SELECT p_partkey, (6 + CASE WHEN p_brand LIKE '%#99' THEN 2 WHEN p_brand LIKE '%9%' THEN 1 ELSE 0 END)::INTEGER AS length FROM part")
_q("str_lcs", lambda k, d: load(k, d, "part").select("p_partkey", strings.lcs("p_name", "p_type").alias("common"), strings.lcs_runs("p_name", "p_type").alias("runs")))


def _kept(k, d):
    """Customers' names, half of them with an expiry."""
    return _names(k, d).withColumn("expire_at", F.when(F.substring("key", -1, 1).isin("0", "2", "4", "6", "8"), F.lit(NOW)))


def _writes(k, d, given="BUILDING"):
    """Every second name, shifted so that some are new; they expire later."""
    return _keys(k, d).select("key", F.lit("new").alias("value"), F.lit(NOW + 1).alias("expire_at"), F.lit(given).alias("given"))


KEPT = f"{N}, h AS (SELECT *, CASE WHEN substr(key, -1) IN ('0', '2', '4', '6', '8') THEN {NOW} END AS expire_at FROM n), {KEYS}, w AS (SELECT key, 'new' AS value, {NOW + 1} AS expire_at FROM ks)"
_go = {"always": "true", "nx": "h.key IS NULL", "xx": "h.key IS NOT NULL", "ifeq": "h.value = 'BUILDING'", "ifne": "(h.key IS NULL OR h.value <> 'BUILDING')"}
for _c, _t in _go.items():
    _q(f"str_set_{_c}", lambda k, d, c=_c: strings.write(_kept(k, d), _writes(k, d), c),
       f"WITH {KEPT} SELECT coalesce(h.key, w.key) AS key, CASE WHEN w.key IS NOT NULL AND {_t} THEN w.value ELSE h.value END AS value, CASE WHEN w.key IS NOT NULL AND {_t} THEN w.expire_at ELSE h.expire_at END AS expire_at, h.value AS old FROM h FULL JOIN w ON h.key = w.key WHERE h.key IS NOT NULL OR {_t}")
_q("str_set_keepttl", lambda k, d: strings.write(_kept(k, d), _writes(k, d), "xx", True).select("key", "value", "expire_at"), f"WITH {KEPT} SELECT h.key, coalesce(w.value, h.value) AS value, coalesce(h.expire_at, w.expire_at) AS expire_at FROM h LEFT JOIN w ON h.key = w.key")
_q("str_set_digest", lambda k, d: strings.write(_kept(k, d), _writes(k, d).withColumn("given", strings.digest(F.lit("BUILDING"))), "ifdeq").select("key", "value"), f"WITH {KEPT} SELECT h.key, CASE WHEN w.key IS NOT NULL AND h.value = 'BUILDING' THEN w.value ELSE h.value END AS value FROM h LEFT JOIN w ON h.key = w.key")
_q("str_setex", lambda k, d: strings.write(_kept(k, d), _writes(k, d).withColumn("expire_at", F.lit(NOW) + 60 * 1000)).select("key", "expire_at"), f"WITH {KEPT} SELECT coalesce(h.key, w.key) AS key, CASE WHEN w.key IS NOT NULL THEN {NOW + 60000} ELSE h.expire_at END AS expire_at FROM h FULL JOIN w ON h.key = w.key")
_q("str_mset", lambda k, d: strings.write(_kept(k, d), _writes(k, d).withColumn("expire_at", F.lit(None).cast("long"))).select("key", "value", "expire_at"), f"WITH {KEPT} SELECT coalesce(h.key, w.key) AS key, coalesce(w.value, h.value) AS value, CASE WHEN w.key IS NULL THEN h.expire_at END AS expire_at FROM h FULL JOIN w ON h.key = w.key")
_q("str_msetex", lambda k, d: strings.write_all_if(_kept(k, d), _writes(k, d).where("key <= 'Customer#000000100'"), "xx"), f"WITH {KEPT} SELECT h.key, coalesce(w.value, h.value) AS value, CASE WHEN w.key IS NULL THEN h.expire_at ELSE w.expire_at END AS expire_at FROM h LEFT JOIN (SELECT * FROM w WHERE key <= 'Customer#000000100') w ON h.key = w.key")
_q("str_msetex_nx", lambda k, d: strings.write_all_if(_kept(k, d), _writes(k, d), "nx"), f"WITH {KEPT} SELECT * FROM h")
_q("str_msetnx_new", lambda k, d: strings.set_all_if_none(_names(k, d), _names(k, d).select(F.concat(F.lit("new:"), "key").alias("key"), "value")), f"WITH {N} SELECT * FROM n UNION ALL SELECT 'new:' || key, value FROM n")
_q("str_getdel", lambda k, d: strings.get_and_delete(_names(k, d), _keys(k, d))[0], f"WITH {N}, {KEYS} SELECT * FROM n WHERE key IN (SELECT key FROM ks)")
_q("str_getdel_rest", lambda k, d: strings.get_and_delete(_names(k, d), _keys(k, d))[1], f"WITH {N}, {KEYS} SELECT * FROM n WHERE key NOT IN (SELECT key FROM ks)")
_q("str_getex", lambda k, d: strings.get_and_expire(_kept(k, d), _writes(k, d)), f"WITH {KEPT} SELECT h.key, h.value, CASE WHEN w.key IS NULL THEN h.expire_at ELSE w.expire_at END AS expire_at, w.key IS NOT NULL AS read FROM h LEFT JOIN w ON h.key = w.key")
_q("str_getex_persist", lambda k, d: strings.get_and_expire(_kept(k, d), _writes(k, d).withColumn("expire_at", F.lit(None).cast("long"))).where("expire_at IS NULL").select("key"), f"WITH {KEPT} SELECT key FROM h WHERE expire_at IS NULL OR key IN (SELECT key FROM w)")
_q("str_decrby", lambda k, d: strings.counters(_log(k, d).withColumn("delta", -F.col("delta"))), f"WITH {LOG} SELECT key, CAST(-sum(delta) AS BIGINT) AS value FROM log GROUP BY 1")
_q("str_decr", lambda k, d: strings.counters(_log(k, d).withColumn("delta", F.lit(-1).cast("long"))), f"WITH {LOG} SELECT key, -count(*) AS value FROM log GROUP BY 1")


def _lists(k, d):
    return load(k, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("pos"), F.col("role").alias("value"))


LI = "l AS (SELECT conv_id AS key, turn AS pos, role AS value FROM conversations), i AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS idx, count(*) OVER (PARTITION BY key) AS n FROM l)"
_q("list_len", lambda k, d: lists.length(_lists(k, d)), f"WITH {LI} SELECT key, count(*) AS length FROM l GROUP BY 1")
_q("list_range", lambda k, d: lists.slice_(_lists(k, d), 1, -2), f'WITH {LI} SELECT key, pos, value, idx AS "index" FROM i WHERE idx >= 1 AND idx <= n - 2')
_q("list_index", lambda k, d: lists.element(_lists(k, d), -1), f"WITH {LI} SELECT key, value FROM i WHERE idx = n - 1")
_q("list_set", lambda k, d: lists.set_element(_lists(k, d), 0, "first"), f"WITH {LI} SELECT key, pos, CASE WHEN idx = 0 THEN 'first' ELSE value END AS value FROM i")
_q("list_trim", lambda k, d: lists.length(lists.trim(_lists(k, d), -3, -1)), f"WITH {LI} SELECT key, count(*) AS length FROM i WHERE idx >= n - 3 GROUP BY 1")
_q("list_pop", lambda k, d: lists.popped(_lists(k, d), 2), f'WITH {LI} SELECT key, idx AS "index", value FROM i WHERE idx < 2')
_q("list_rpop", lambda k, d: lists.popped(_lists(k, d), 1, True), f'WITH {LI} SELECT key, idx AS "index", value FROM i WHERE idx = n - 1')
_more = lambda k, d: load(k, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("key"), F.lit(1).alias("seq"), F.lit("tail").alias("value"))
_q("list_rpush", lambda k, d: lists.element(lists.push(_lists(k, d), _more(k, d)), -1), "SELECT DISTINCT conv_id AS key, CASE WHEN conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0) THEN 'tail' ELSE arg_max(role, turn) END AS value FROM conversations GROUP BY conv_id")
_q("list_lpush", lambda k, d: lists.element(lists.push_if_there(_lists(k, d), _more(k, d), True), 0), "SELECT conv_id AS key, CASE WHEN min(turn) = 0 THEN 'tail' ELSE arg_min(role, turn) END AS value FROM conversations GROUP BY conv_id")
_q("list_rem", lambda k, d: lists.remove(_lists(k, d), F.lit("user"), 1), f"WITH {LI}, r AS (SELECT *, sum((value = 'user')::INT) OVER (PARTITION BY key ORDER BY pos) AS h FROM l) SELECT key, pos, value FROM r WHERE value <> 'user' OR h > 1")
_q("list_pos", lambda k, d: lists.positions(_lists(k, d), F.col("value") == "assistant", -1, 2).select("key", "index"),
   f"WITH {LI}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx DESC) AS h FROM i WHERE value = 'assistant') SELECT key, idx AS \"index\" FROM r WHERE h <= 2")
_q("list_insert", lambda k, d: lists.insert(_lists(k, d), F.lit("assistant"), "note", True),
   f"WITH {LI}, a AS (SELECT key, min(pos) AS p FROM l WHERE value = 'assistant' GROUP BY 1) SELECT key, pos * 2 AS pos, value FROM l UNION ALL SELECT key, p * 2 + 1, 'note' FROM a")
_q("list_move", lambda k, d: lists.length(lists.move(_lists(k, d), 1, 2)).where("key IN (1, 2)"), f"WITH {LI} SELECT key, count(*) + CASE key WHEN 1 THEN -1 ELSE 1 END AS length FROM l WHERE key IN (1, 2) GROUP BY 1")
_q("list_mpop", lambda k, d: lists.pop_first_there(_lists(k, d), [-5, 3, 4], 2), f'WITH {LI} SELECT key, idx AS "index", value FROM i WHERE key = 3 AND idx < 2')

FIELDS = ["p_name", "p_brand", "p_type", "p_size"]


def _hash(k, d):
    return hashes.from_columns(load(k, d, "part"), "p_partkey", FIELDS)


H = "h AS (" + " UNION ALL ".join(f"SELECT p_partkey AS key, '{f}' AS field, {f}::VARCHAR AS value FROM part" for f in FIELDS) + ")"
_q("hash_getall", lambda k, d: hashes.get_all(_hash(k, d)).select("key", F.to_json("fields").alias("fields")), """SELECT p_partkey AS key, '{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_size":"' || p_size || '","p_type":"' || p_type || '"}' AS fields FROM part""")
_q("hash_get", lambda k, d: hashes.get(_hash(k, d), "p_brand"), "SELECT p_partkey AS key, p_brand AS value FROM part")
_q("hash_mget", lambda k, d: hashes.multi_get(_hash(k, d), ["p_brand", "p_none"]), "SELECT p_partkey AS key, p_brand, NULL::VARCHAR AS p_none FROM part")
_q("hash_keys", lambda k, d: hashes.keys(_hash(k, d)), f"WITH {H} SELECT key, field FROM h")
_q("hash_vals", lambda k, d: hashes.values(_hash(k, d)), f"WITH {H} SELECT key, value FROM h")
_q("hash_len", lambda k, d: hashes.length(_hash(k, d)), f"WITH {H} SELECT key, count(*) AS length FROM h GROUP BY 1")
_q("hash_exists", lambda k, d: hashes.exists(_hash(k, d), "p_size"), "SELECT p_partkey AS key, true AS there FROM part")
_q("hash_set", lambda k, d: hashes.set_(_hash(k, d), _hash(k, d).where("field = 'p_size' AND key % 2 = 0").select("key", "field", F.lit("0").alias("value"), F.lit(1).alias("seq"))), f"WITH {H} SELECT key, field, CASE WHEN field = 'p_size' AND key % 2 = 0 THEN '0' ELSE value END AS value FROM h")
_q("hash_setnx", lambda k, d: hashes.set_if_absent(_hash(k, d).where("key % 3 <> 0"), _hash(k, d).withColumn("value", F.lit("new"))), f"WITH {H} SELECT key, field, CASE WHEN key % 3 <> 0 THEN value ELSE 'new' END AS value FROM h")
_q("hash_del", lambda k, d: hashes.delete(_hash(k, d), F.col("field").isin("p_size", "p_type")), f"WITH {H} SELECT * FROM h WHERE field NOT IN ('p_size', 'p_type')")
_q("hash_getdel", lambda k, d: hashes.get_and_delete(_hash(k, d), ["p_size"])[0], f"WITH {H} SELECT * FROM h WHERE field = 'p_size'")
_q("hash_incrby", lambda k, d: hashes.increment(_hash(k, d).where("field = 'p_size'"), _log(k, d).select("key", F.col("value").alias("field"), F.col("delta").alias("value"))),
   f"WITH {H}, {LOG} SELECT key, field, CAST(sum(v) AS BIGINT) AS value FROM (SELECT key, field, value::BIGINT AS v FROM h WHERE field = 'p_size' UNION ALL SELECT key, value, delta FROM log) GROUP BY 1, 2")
_q("hash_incrbyfloat", lambda k, d: hashes.increment(_hash(k, d).where("field = 'p_size'"), _hash(k, d).where("field = 'p_size'").withColumn("value", F.lit("0.5")), "double"), f"WITH {H} SELECT key, field, value::DOUBLE + 0.5 AS value FROM h WHERE field = 'p_size'")
_q("hash_strlen", lambda k, d: hashes.string_length(_hash(k, d), "p_name"), "SELECT p_partkey AS key, strlen(p_name) AS length FROM part")
_q("hash_scan_match", lambda k, d: hashes.scan(_hash(k, d), "p_[nt]*"), f"WITH {H} SELECT * FROM h WHERE regexp_matches(field, '^p_[nt].*$')")
_q("hash_randfield", lambda k, d: hashes.random_fields(_hash(k, d), 2, "h"), f"WITH {H}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5('h:' || field), field) AS i FROM h) SELECT key, field, value FROM r WHERE i <= 2")
_q("hash_randfield_repeats", lambda k, d: hashes.random_fields(_hash(k, d), 3, "h", True),
   f"""WITH {H}, p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY field) - 1 AS i FROM h),
   s AS (SELECT DISTINCT key, unnest([1, 2, 3]) AS draw FROM h)
   SELECT s.key, s.draw::INTEGER AS draw, p.field, p.value FROM s JOIN p ON p.key = s.key AND p.i = ('0x' || substr(md5('h:' || s.key || ':' || s.draw), 1, 8))::BIGINT % 4""")


def _ks(k, d):
    o = load(k, d, "orders")
    at = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return o.select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("key"), F.col("o_orderstatus").alias("value"), F.when(F.col("o_orderkey") % 4 != 0, at).alias("expire_at"))


KS = "t AS (SELECT 'order:' || o_orderkey AS key, o_orderstatus AS value, CASE WHEN o_orderkey % 4 <> 0 THEN epoch_us(o_orderdate) // 1000 END AS expire_at FROM orders)"
_q("ttl_view", lambda k, d: keyspace.live(_ks(k, d), NOW), f"WITH {KS} SELECT * FROM t WHERE expire_at IS NULL OR expire_at > {NOW}")
_probe = lambda k, d: load(k, d, "orders").select(F.concat(F.lit("order:"), (F.col("o_orderkey") * 2).cast("string")).alias("key"))
_q("ttl_of_keys", lambda k, d: keyspace.ttl_of(_ks(k, d), _probe(k, d), NOW, 1000),
   f"WITH {KS}, p AS (SELECT 'order:' || o_orderkey * 2 AS key FROM orders) SELECT p.key, CASE WHEN t.key IS NULL THEN -2 WHEN expire_at IS NULL THEN -1 ELSE (expire_at - {NOW}) // 1000 END::BIGINT AS ttl FROM p LEFT JOIN (SELECT * FROM t WHERE expire_at IS NULL OR expire_at > {NOW}) t USING (key)")
for _w, _t in (("gt", f"expire_at IS NOT NULL AND {NOW} > expire_at"), ("lt", f"expire_at IS NULL OR {NOW} < expire_at"), ("nx", "expire_at IS NULL"), ("xx", "expire_at IS NOT NULL")):
    _q(f"expire_if_{_w}", lambda k, d, w=_w: keyspace.expire(_ks(k, d), F.lit(NOW), w), f"WITH {KS} SELECT key, value, CASE WHEN {_t} THEN {NOW}::BIGINT ELSE expire_at END AS expire_at FROM t")
_q("persist_keys", lambda k, d: keyspace.persist(_ks(k, d)).where("expire_at IS NULL").select("key"), f"WITH {KS} SELECT key FROM t")
_q("keys_glob", lambda k, d: keyspace.keys(_ks(k, d), "order:?[02468]*7"), f"WITH {KS} SELECT key FROM t WHERE regexp_matches(key, '^order:.[02468].*7$')")
_q("keys_prefix", lambda k, d: keyspace.keys(_ks(k, d), "order:12*"), f"WITH {KS} SELECT key FROM t WHERE key LIKE 'order:12%'")
_q("keys_exists", lambda k, d: keyspace.exists(_ks(k, d), _probe(k, d)), "SELECT count(*) AS n FROM orders a WHERE a.o_orderkey * 2 IN (SELECT o_orderkey FROM orders)")
_q("keys_delete", lambda k, d: keyspace.delete(_ks(k, d), _probe(k, d)).select("key"), "SELECT 'order:' || o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey * 2 FROM orders)")
_q("keys_rename", lambda k, d: keyspace.rename(_ks(k, d), "order:1", "order:2").where("key IN ('order:1', 'order:2')").select("key", "value"), f"WITH {KS} SELECT 'order:2' AS key, value FROM t WHERE key = 'order:1'")
_q("keys_renamenx", lambda k, d: keyspace.rename(_ks(k, d), "order:1", "fresh", True).where("NOT key LIKE 'order:%'").select("key", "value"), f"WITH {KS} SELECT 'fresh' AS key, value FROM t WHERE key = 'order:1'")
_q("keys_copy", lambda k, d: keyspace.copy(_ks(k, d), "order:1", "twin").where("key IN ('order:1', 'twin')").select("key", "value"), f"WITH {KS} SELECT unnest(['order:1', 'twin']) AS key, value FROM t WHERE key = 'order:1'")
_q("keys_random", lambda k, d: keyspace.random_key(_ks(k, d), "r"), f"WITH {KS} SELECT key FROM t ORDER BY md5('r:' || key), key LIMIT 1")
_q("dump_restore", lambda k, d: keyspace.restore(keyspace.dump(_ks(k, d)), "value string, expire_at long"), f"WITH {KS} SELECT * FROM t")
_q("scan_type", lambda k, d: _ks(k, d).select("key", F.lit("string").alias("type")).unionByName(_names(k, d).select("key", F.lit("hash").alias("type"))).where("type = 'hash'"), f"WITH {N} SELECT key, 'hash' AS type FROM n")
_cust = lambda k, d, c: load(k, d, "customer").select(F.concat(F.lit("w_"), F.col("c_custkey").cast("string")).alias("key"), F.col(c).cast("string").alias("value"))
_elem = lambda k, d: load(k, d, "orders").select(F.col("o_custkey").alias("elem")).distinct()
_q("sort_by_get", lambda k, d: keyspace.sort_by(_elem(k, d), _cust(k, d, "c_acctbal"), F.concat(F.lit("w_"), F.col("elem").cast("string")), {"segment": (_cust(k, d, "c_mktsegment"), F.concat(F.lit("w_"), F.col("elem").cast("string")))}, offset=5, count=50),
   "SELECT o_custkey AS elem, c_mktsegment AS segment FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN customer ON c_custkey = o_custkey ORDER BY c_acctbal NULLS FIRST, 1 LIMIT 50 OFFSET 5")
_q("sort_alpha_desc_limit", lambda k, d: keyspace.sort_by(_elem(k, d), None, None, alpha=True, descending=True, count=30), "SELECT o_custkey AS elem FROM (SELECT DISTINCT o_custkey FROM orders) ORDER BY o_custkey::VARCHAR DESC, 1 DESC LIMIT 30")
_strangers = lambda k, d: _more(k, d).unionByName(_more(k, d).withColumn("key", -1 - F.col("key")))
for _l in (False, True):
    _q("list_lpushx" if _l else "list_rpushx", lambda k, d, left=_l: lists.length(lists.push_if_there(_lists(k, d), _strangers(k, d), left)), "SELECT conv_id AS key, count(*) + count(*) FILTER (turn = 0) AS length FROM conversations GROUP BY 1")
