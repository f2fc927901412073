"""Points (customers), bitmaps (days on which users act) and vectors (embeddings)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeframe.operators import bitmaps, geo, vectors
from lodeframe.plans.registry import Registry
from lodeframe.session import load

ENTRIES = Registry()


def _q(name, f, sql=None):
    ENTRIES.add(name, sql)(f)


def _points(k, d):
    c = F.col("c_custkey")
    return load(k, d, "customer").select(c.alias("member"), (F.pmod(c * 7919, F.lit(36000)) / 100.0 - 180.0).alias("lon"), (F.pmod(c * 104729, F.lit(17000)) / 100.0 - 85.0).alias("lat"))


G = "g AS (SELECT c_custkey AS member, (c_custkey * 7919 % 36000) / 100.0 - 180.0 AS lon, (c_custkey * 104729 % 17000) / 100.0 - 85.0 AS lat FROM customer)"


# The interleaving is written out bit by bit for the oracle, so that it is a second way to the same number.
def _inter(lat, lon):
    return " + ".join(f"((({lat}) >> {i}) & 1) * {1 << 2 * i} + ((({lon}) >> {i}) & 1) * {1 << 2 * i + 1}" for i in range(26))


CELLS = f"{G}, u AS (SELECT *, floor((lat + 85.05112878) / 170.10225756 * 67108864)::BIGINT AS y, floor((lon + 180.0) / 360.0 * 67108864)::BIGINT AS x FROM g)"
DEC = f"{CELLS}, c AS (SELECT member, y, x, -180.0 + (x + 0.5) / 67108864 * 360.0 AS lon, -85.05112878 + (y + 0.5) / 67108864 * 170.10225756 AS lat FROM u)"


def _dist(a, b, c, e, unit=1000.0):
    return f"2.0 * 6372797.560856 * asin(sqrt(least(1.0, pow(sin((radians({e}) - radians({b})) / 2), 2) + cos(radians({b})) * cos(radians({e})) * pow(sin((radians({c}) - radians({a})) / 2), 2)))) / {unit}"


_q("geo_encode", lambda k, d: _points(k, d).select("member", geo.encode(F.col("lon"), F.col("lat")).alias("cell")), f"WITH {CELLS} SELECT member, ({_inter('y', 'x')})::BIGINT AS cell FROM u")


def _centres(k, d):
    lon, lat = geo.decode(geo.encode(F.col("lon"), F.col("lat")))
    return _points(k, d).select("member", lon.alias("lon"), lat.alias("lat"))


_q("geo_decode", lambda k, d: _centres(k, d).select("member", F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat")), f"WITH {DEC} SELECT member, round(lon, 8) AS lon, round(lat, 8) AS lat FROM c")
_letters = " || ".join(f"substr('{geo.ALPHABET}', (bits >> {52 - 5 * (i + 1)} & 31)::INTEGER + 1, 1)" for i in range(10)) + " || '0'"
_q("geo_hash_string", lambda k, d: _points(k, d).select("member", geo.hash_string(geo.encode(F.col("lon"), F.col("lat"))).alias("hash")),
   f"WITH {DEC}, b AS (SELECT member, floor((lat + 90.0) / 180.0 * 67108864)::BIGINT AS y, floor((lon + 180.0) / 360.0 * 67108864)::BIGINT AS x FROM c), h AS (SELECT member, ({_inter('y', 'x')})::BIGINT AS bits FROM b) SELECT member, {_letters} AS hash FROM h")
_q("geo_dist", lambda k, d: _centres(k, d).select("member", F.round(geo.distance(F.col("lon"), F.col("lat"), F.lit(13.361389), F.lit(38.115556), "km"), 4).alias("dist")), f"WITH {DEC} SELECT member, round({_dist('lon', 'lat', '13.361389', '38.115556')}, 4) AS dist FROM c")
_r = lambda df: df.select("member", F.round("dist", 4).alias("dist"))
_q("geo_radius", lambda k, d: _r(geo.within_radius(_centres(k, d), 15.0, 37.0, 1500, "km")), f"WITH {DEC}, e AS (SELECT member, {_dist('15.0', '37.0', 'lon', 'lat')} AS dist FROM c) SELECT member, round(dist, 4) AS dist FROM e WHERE dist <= 1500")
_q("geo_box", lambda k, d: _r(geo.within_box(_centres(k, d), 15.0, 37.0, 4000, 2000, "km")),
   f"WITH {DEC} SELECT member, round({_dist('15.0', '37.0', 'lon', 'lat')}, 4) AS dist FROM c WHERE {_dist('lon', '37.0', 'lon', 'lat')} <= 1000 AND {_dist('15.0', 'lat', 'lon', 'lat')} <= 2000")


def _by_member(k, d):
    p = _centres(k, d)
    at = p.where("member = 42").first()
    return _r(geo.within_radius(p, at.lon, at.lat, 1000, "mi"))


_q("geo_by_member", _by_member, f"WITH {DEC}, m AS (SELECT lon AS a, lat AS b FROM c WHERE member = 42), e AS (SELECT member, {_dist('a', 'b', 'lon', 'lat', 1609.34)} AS dist FROM c, m) SELECT member, round(dist, 4) AS dist FROM e WHERE dist <= 1000")
_q("geo_knn", lambda k, d: _r(geo.nearest(_centres(k, d), 15.0, 37.0, 10, "km")), f"WITH {DEC} SELECT member, round({_dist('15.0', '37.0', 'lon', 'lat')}, 4) AS dist FROM c ORDER BY {_dist('15.0', '37.0', 'lon', 'lat')}, member LIMIT 10")
_suppliers = lambda k, d: load(k, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.pmod(F.col("s_suppkey") * 7907, F.lit(36000)) / 100.0 - 180.0).alias("clon"), (F.pmod(F.col("s_suppkey") * 104723, F.lit(17000)) / 100.0 - 85.0).alias("clat"))
_q("geo_radius_join", lambda k, d: geo.radius_join(_points(k, d), _suppliers(k, d), 600, "km").select("id", "member", F.round("dist", 4).alias("dist")),
   f"WITH {G}, s AS (SELECT s_suppkey AS id, (s_suppkey * 7907 % 36000) / 100.0 - 180.0 AS clon, (s_suppkey * 104723 % 17000) / 100.0 - 85.0 AS clat FROM supplier), e AS (SELECT id, member, {_dist('clon', 'clat', 'lon', 'lat')} AS dist FROM g, s) SELECT id, member, round(dist, 4) AS dist FROM e WHERE dist <= 600")


def _bits(k, d):
    """For each kind of event and day of the month, the users who had one."""
    e = load(k, d, "events")
    return e.select(F.concat("event_type", F.lit(":"), F.date_format("ts", "dd")).alias("key"), F.col("user_id").alias("bit")).distinct()


BITS = "b AS (SELECT DISTINCT event_type || ':' || strftime(ts, '%d') AS key, user_id AS bit FROM events)"
KEYS = ["click:01", "view:02", "error:03"]
IN = "key IN ('click:01', 'view:02', 'error:03')"
CNT = f"WITH {BITS}, n AS (SELECT bit, count(*) AS n, count(*) FILTER (key = 'click:01') AS f FROM b WHERE {IN} GROUP BY 1)"
for _op, _t in {"and": "n = 3", "or": "n > 0", "xor": "n % 2 = 1", "one": "n = 1", "diff": "f = 1 AND n = 1", "diff1": "f = 0", "andor": "f = 1 AND n > 1"}.items():
    _q(f"bitop_{_op}", lambda k, d, o=_op: bitmaps.combine(_bits(k, d), KEYS, o), CNT + f" SELECT bit FROM n WHERE {_t}")


def _bit_not(k, d):
    b = _bits(k, d)
    top = b.agg(F.max("bit")).first()[0] or 0
    return bitmaps.combine(b, ["click:01"], "not", (top // 8 + 1) * 8)


_q("bitop_not", _bit_not, f"WITH {BITS} SELECT bit FROM (SELECT unnest(range((max(bit) // 8 + 1) * 8)) AS bit FROM b) WHERE bit NOT IN (SELECT bit FROM b WHERE key = 'click:01')")
_q("bit_count", lambda k, d: bitmaps.count(_bits(k, d), 2, 40), f"WITH {BITS} SELECT key, count(*) AS n FROM b WHERE bit // 8 BETWEEN 2 AND 40 GROUP BY 1")
_q("bit_pos", lambda k, d: bitmaps.first_set(_bits(k, d)), f"WITH {BITS} SELECT key, min(bit) AS bit FROM b GROUP BY 1")
_q("bit_pos_clear", lambda k, d: bitmaps.first_clear(_bits(k, d)), f"WITH {BITS}, r AS (SELECT key, bit, row_number() OVER (PARTITION BY key ORDER BY bit) - 1 AS i FROM b) SELECT key, count(*) FILTER (bit = i) AS bit FROM r GROUP BY 1")
_q("bit_get", lambda k, d: bitmaps.get_bits(_bits(k, d), load(k, d, "events").select(F.lit("click:01").alias("key"), F.col("user_id").alias("bit")).distinct()), f"WITH {BITS}, u AS (SELECT DISTINCT bit FROM b) SELECT 'click:01' AS key, bit, (bit IN (SELECT bit FROM b WHERE key = 'click:01'))::INTEGER AS value FROM u")
_q("bit_set", lambda k, d: bitmaps.count(bitmaps.set_bits(_bits(k, d), k.range(100, 260).select(F.lit("click:01").alias("key"), F.col("id").alias("bit")))), f"WITH {BITS} SELECT key, count(*) AS n FROM (SELECT * FROM b UNION SELECT 'click:01', range FROM range(100, 260)) GROUP BY 1")
_NAME = lambda: F.col("p_name").cast("binary")
_BYTE = lambda i: f"('0x' || substr(hex(encode(p_name)), {2 * i + 1}, 2))::BIGINT"
_q("bitfield_get", lambda k, d: load(k, d, "part").select("p_partkey", bitmaps.field(_NAME(), "u12", 4).alias("a"), bitmaps.field(_NAME(), "i7", 3).alias("b")),
   f"SELECT p_partkey, (({_BYTE(0)} & 15) * 256 + {_BYTE(1)})::BIGINT AS a, (CASE WHEN v >= 64 THEN v - 128 ELSE v END)::BIGINT AS b FROM (SELECT *, (({_BYTE(0)} * 256 + {_BYTE(1)}) >> 6) & 127 AS v FROM part)")
for _how, _t in {"wrap": "(v + 128) % 256 - 128", "sat": "least(v, 127)", "fail": "CASE WHEN v <= 127 THEN v END"}.items():
    _q(f"bitfield_incr_{_how}", lambda k, d, h=_how: load(k, d, "part").select("p_partkey", bitmaps.overflow(F.col("p_size") * 5, "i8", h).alias("v")), f"SELECT p_partkey, ({_t})::BIGINT AS v FROM (SELECT p_partkey, p_size * 5 AS v FROM part)")


def _vec(k, d):
    e = load(k, d, "embeddings")
    return e.select(F.col("vec_id").alias("element"), "embedding", F.concat(F.lit('{"label": '), F.col("label").cast("string"), F.lit(', "tags": ["t'), (F.col("vec_id") % 4).cast("string"), F.lit('", "x"], "name": "v'), F.col("vec_id").cast("string"), F.lit('"}')).alias("attrs"))


V = "v AS (SELECT vec_id AS element, embedding::DOUBLE[] AS e, label FROM embeddings), q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 3)"
_S = "greatest(0.0, least(1.0, 1.0 - greatest(0.0, least(2.0, 1.0 - list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))))) / 2))"


def _vsim(count=10, epsilon=None, where=None):
    def f(k, d):
        v = _vec(k, d)
        return vectors.similar(v, vectors.vector_of(v, 3), count, epsilon, where).select("element", F.round("score", 5).alias("score"))

    return f


def _vsql(where="true", count=10):
    return f"WITH {V} SELECT element, round({_S}, 5) AS score FROM v, q WHERE {where} ORDER BY {_S} DESC, element LIMIT {count}"


_q("vsim_ele", _vsim(), _vsql())
_q("vsim_cosine", lambda k, d: (lambda v, q: v.select("element", F.round(vectors.cosine_distance(F.col("embedding"), vectors.constant(q)), 5).alias("dist")))(_vec(k, d), vectors.vector_of(_vec(k, d), 3)),
   f"WITH {V} SELECT element, round(greatest(0.0, least(2.0, 1.0 - list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))))), 5) AS dist FROM v, q")
_q("vsim_epsilon", _vsim(100, 0.45), _vsql(f"{_S} >= 1 - 0.45", 100))
_q("vsim_filter_cmp", _vsim(10, None, ".label >= 2 and .label != 5"), _vsql("label >= 2 AND label <> 5"))
_q("vsim_filter_in", _vsim(10, None, '"t1" in .tags and .label in [1, 2, 3]'), _vsql("element % 4 = 1 AND label IN (1, 2, 3)"))
_q("vsim_filter_arith", _vsim(10, None, "(.label * 2 + 1) % 3 == 0 || .label ** 2 > 60"), _vsql("(label * 2 + 1) % 3 = 0 OR label * label > 60"))
_q("vsim_filter_bool", _vsim(10, None, 'not (.label < 4) and !(.name == "v7") and .label'), _vsql("NOT label < 4 AND element <> 7 AND label <> 0"))
_COS = "greatest(0.0, least(2.0, 1.0 - list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))))"


def _asked(k, d):
    return _vec(k, d).where("element % 20 = 0").select(F.col("element").alias("query"), F.col("embedding").alias("q"))


for _n, _f, _k, _e in (("vsim_batch_knn", "cosine", 5, _COS), ("knn_l2", "l2", 5, "list_distance(a.e, b.e)"), ("knn_ip", "ip", 5, "-list_dot_product(a.e, b.e)"), ("v_links", "cosine", 16, _COS)):
    _q(_n, lambda k, d, f=_f, n=_k: vectors.batch(_vec(k, d), _asked(k, d), n, f).select("query", "element", "rank", F.round("distance", 5).alias("distance")),
       f"WITH {V}, r AS (SELECT a.element AS query, b.element, {_e} AS d, row_number() OVER (PARTITION BY a.element ORDER BY round({_e}, 10), b.element) AS rank FROM v a, v b WHERE a.element % 20 = 0 AND a.element <> b.element) SELECT query, element, rank, round(d, 5) AS distance FROM r WHERE rank <= {_k}")
_more = lambda k, d: _vec(k, d).where("element < 10").withColumn("element", F.col("element") * 1000).withColumn("attrs", F.lit(None).cast("string"))
_q("v_add", lambda k, d: vectors.upsert(_vec(k, d), _more(k, d)).select("element", F.round(F.element_at("embedding", 1).cast("double"), 5).alias("head"), F.col("attrs").isNull().alias("bare")),
   f"WITH {V}, m AS (SELECT element * 1000 AS element, e[1] AS h FROM v WHERE element < 10) SELECT element, round(e[1], 5) AS head, false AS bare FROM v WHERE element NOT IN (SELECT element FROM m) UNION ALL SELECT element, round(h, 5), true FROM m")
_q("v_ismember", lambda k, d: vectors.is_member(_vec(k, d), load(k, d, "customer").select(F.col("c_custkey").alias("element"))), "SELECT c_custkey AS element, c_custkey IN (SELECT vec_id FROM embeddings) AS is_member FROM customer")
_q("v_info", lambda k, d: vectors.info(_vec(k, d)), "SELECT count(*) AS size, max(len(embedding)) AS dim, count(label) AS with_attrs FROM embeddings")
_q("v_emb_raw", lambda k, d: vectors.raw(_vec(k, d)).select("element", "kind", F.round("norm", 5).alias("norm"), F.round(F.element_at("data", 1), 5).alias("head")), f"WITH {V} SELECT element, 'f32' AS kind, round(sqrt(list_dot_product(e, e)), 5) AS norm, round(e[1] / sqrt(list_dot_product(e, e)), 5) AS head FROM v")
_q("geo_search_store", lambda k, d: geo.store(geo.within_box(_centres(k, d), 15.0, 37.0, 4000, 2000, "km"), "near"), f"WITH {DEC} SELECT 'near' AS key, member, round({_dist('15.0', '37.0', 'lon', 'lat')}, 4) AS score FROM c WHERE {_dist('lon', '37.0', 'lon', 'lat')} <= 1000 AND {_dist('15.0', 'lat', 'lon', 'lat')} <= 2000")
_q("v_range_radius", lambda k, d: (lambda v, q: v.withColumn("dist", vectors.l2(F.col("embedding"), vectors.constant(q))).where("dist <= 1.1").select("element"))(_vec(k, d), vectors.vector_of(_vec(k, d), 3)), f"WITH {V} SELECT element FROM v, q WHERE list_distance(e, q) <= 1.1")
_q("v_dim", lambda k, d: _vec(k, d).select("element", F.size("embedding").cast("long").alias("dim")), f"WITH {V} SELECT element, len(e) AS dim FROM v")
_q("v_card", lambda k, d: _vec(k, d).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM embeddings")
_q("v_getattr", lambda k, d: _vec(k, d).select("element", F.get_json_object("attrs", "$.label").cast("long").alias("label")), "SELECT vec_id AS element, label::BIGINT AS label FROM embeddings")
_q("v_range", lambda k, d: _vec(k, d).where(F.col("element").cast("string").between("10", "20")).select("element"), "SELECT vec_id AS element FROM embeddings WHERE vec_id::VARCHAR BETWEEN '10' AND '20'")
_q("v_randmember", lambda k, d: _vec(k, d).orderBy(F.md5(F.concat(F.lit("v:"), F.col("element").cast("string")).cast("binary"))).limit(5).select("element"), "SELECT vec_id AS element FROM embeddings ORDER BY md5('v:' || vec_id) LIMIT 5")
_q("v_rem", lambda k, d: _vec(k, d).where("element % 10 <> 0").agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM embeddings WHERE vec_id % 10 <> 0")
_q("v_setattr", lambda k, d: _vec(k, d).withColumn("attrs", F.to_json(F.struct((F.col("element") % 3).alias("z")))).select("element", "attrs"), "SELECT vec_id AS element, '{\"z\":' || vec_id % 3 || '}' AS attrs FROM embeddings")
_q("v_quantised_hamming", lambda k, d: (lambda v, q: v.select("element", vectors.hamming(vectors.binary(F.col("embedding")), vectors.binary(vectors.constant(q))).alias("apart")))(_vec(k, d), vectors.vector_of(_vec(k, d), 3)),
   f"WITH {V}, t AS (SELECT element, unnest(e) > 0 AS a, unnest(q) > 0 AS b FROM v, q) SELECT element, count(*) FILTER (a <> b) AS apart FROM t GROUP BY 1")
