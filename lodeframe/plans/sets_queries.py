"""Sets (supplier -> parts, from lineitem) and sorted sets (customer -> orders by price)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeframe.operators import sets, zsets
from lodeframe.plans.registry import Registry
from lodeframe.session import load

ENTRIES = Registry()
S = "s AS (SELECT DISTINCT l_suppkey AS key, l_partkey AS member FROM lineitem)"
Z = "z AS (SELECT o_custkey AS key, o_orderkey AS member, o_totalprice AS score FROM orders)"
#: Returned and open lines as two sorted sets of parts, scored by quantity.
Y = """y AS (SELECT l_returnflag AS key, l_partkey AS member, sum(l_quantity) AS score FROM lineitem GROUP BY 1, 2)"""


def _s(spark, sf):
    return load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("member")).distinct()


def _z(spark, sf):
    return load(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("member"), F.col("o_totalprice").alias("score"))


def _y(spark, sf):
    li = load(spark, sf, "lineitem").groupBy("l_returnflag", "l_partkey").agg(F.sum("l_quantity").alias("score"))
    return li.select(F.col("l_returnflag").alias("key"), F.col("l_partkey").alias("member"), "score")


def _wide(spark, sf):
    return load(spark, sf, "lineitem").select(F.col("l_returnflag").alias("key"), F.col("l_partkey").alias("member")).distinct()


def _simple(name, f, sql):
    ENTRIES.add(name, sql)(f)


_simple("set_members", lambda k, d: sets.members(_s(k, d), 7), f"WITH {S} SELECT member FROM s WHERE key = 7")
_simple("set_card", lambda k, d: sets.cardinality(_s(k, d)), f"WITH {S} SELECT key, count(*) AS cardinality FROM s GROUP BY 1")
_simple("set_union", lambda k, d: sets.union(_s(k, d), [1, 2, 3]), f"WITH {S} SELECT DISTINCT member FROM s WHERE key IN (1, 2, 3)")
_simple("set_inter", lambda k, d: sets.intersection(_s(k, d), [1, 2]), f"WITH {S} SELECT member FROM s WHERE key = 1 INTERSECT SELECT member FROM s WHERE key = 2")
_simple("set_inter_nway", lambda k, d: sets.intersection(load(k, d, "lineitem").select(F.col("l_returnflag").alias("key"), F.col("l_partkey").alias("member")).distinct(), ["A", "N", "R"]),
        "SELECT l_partkey AS member FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3")
_simple("set_intercard_limit", lambda k, d: sets.intersection_cardinality(_s(k, d), [1, 2], 5), f"WITH {S} SELECT least(5, count(*)) AS cardinality FROM (SELECT member FROM s WHERE key = 1 INTERSECT SELECT member FROM s WHERE key = 2)")
_simple("set_diff", lambda k, d: sets.difference(_s(k, d), 1, [2, 3, 4]), f"WITH {S} SELECT member FROM s WHERE key = 1 EXCEPT SELECT member FROM s WHERE key IN (2, 3, 4)")
_simple("set_store_union", lambda k, d: sets.store(sets.union(_s(k, d), [4, 5]), 999), f"WITH {S} SELECT DISTINCT 999 AS key, member FROM s WHERE key IN (4, 5)")
_simple("set_scan", lambda k, d: sets.scan(_s(k, d), "1?[3-5]*"), f"WITH {S} SELECT key, member FROM s WHERE regexp_matches(member::VARCHAR, '^1.[3-5].*$')")


def _probes(k, d):
    return load(k, d, "part").select((F.col("p_partkey") % 100 + 1).alias("key"), F.col("p_partkey").alias("member"))


P = "p AS (SELECT p_partkey % 100 + 1 AS key, p_partkey AS member FROM part)"
_simple("set_ismember", lambda k, d: sets.is_member(_s(k, d), _probes(k, d)), f"WITH {S}, {P} SELECT p.key, p.member FROM p SEMI JOIN s ON p.key = s.key AND p.member = s.member")
_simple("set_mismember", lambda k, d: sets.membership(_s(k, d), _probes(k, d)), f"WITH {S}, {P} SELECT p.key, p.member, s.key IS NOT NULL AS is_member FROM p LEFT JOIN s ON p.key = s.key AND p.member = s.member")
_simple("set_add_new", lambda k, d: sets.added(_s(k, d), _probes(k, d)), f"WITH {S}, {P} SELECT p.key, count(*) AS added FROM p ANTI JOIN s ON p.key = s.key AND p.member = s.member GROUP BY 1")
_simple("set_add", lambda k, d: sets.cardinality(sets.add(_s(k, d), _probes(k, d))), f"WITH {S}, {P} SELECT key, count(*) AS cardinality FROM (SELECT * FROM s UNION SELECT * FROM p) GROUP BY 1")
_simple("set_rem", lambda k, d: sets.cardinality(sets.remove(_s(k, d), _probes(k, d))), f"WITH {S}, {P} SELECT key, count(*) AS cardinality FROM (SELECT * FROM s EXCEPT SELECT * FROM p) GROUP BY 1")
_simple("set_move", lambda k, d: sets.cardinality(sets.move(_s(k, d), 1, 2, F.col("member") % 2 == 0)), f"WITH {S}, m AS (SELECT DISTINCT CASE WHEN key = 1 AND member % 2 = 0 THEN 2 ELSE key END AS key, member FROM s) SELECT key, count(*) AS cardinality FROM m GROUP BY 1")
_RN = f"WITH {S}, r AS (SELECT key, member, row_number() OVER (PARTITION BY key ORDER BY md5('x:' || member), member) AS i FROM s)"
_simple("set_randmember", lambda k, d: sets.sample(_s(k, d), 3, "x"), f"{_RN} SELECT key, member FROM r WHERE i <= 3")
_simple("set_pop", lambda k, d: sets.cardinality(sets.pop(_s(k, d), 3, "x")), f"{_RN} SELECT key, count(*) AS cardinality FROM r WHERE i > 3 GROUP BY 1")

_R = f"WITH {Z}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS back, count(*) OVER (PARTITION BY key) AS n FROM z)"
_simple("z_add_gt", lambda k, d: zsets.upsert(_z(k, d), _z(k, d).select("key", "member", (F.lit(300000.0) - F.col("score")).alias("score"), F.lit(1).alias("seq")), "gt"),
        f"WITH {Z} SELECT key, member, greatest(score, 300000.0 - score) AS score FROM z")
_simple("z_add_last", lambda k, d: zsets.upsert(_z(k, d), _z(k, d).where("member % 3 = 0").select("key", "member", F.lit(1.5).alias("score"), F.lit(1).alias("seq"))),
        f"WITH {Z} SELECT key, member, CASE WHEN member % 3 = 0 THEN 1.5 ELSE score END AS score FROM z")
_simple("z_add_nx", lambda k, d: zsets.upsert(_z(k, d).where("member % 2 = 0"), _z(k, d).withColumn("score", F.lit(9.0)).withColumn("seq", F.lit(1)), "nx"),
        f"WITH {Z} SELECT key, member, CASE WHEN member % 2 = 0 THEN score ELSE 9.0 END AS score FROM z")
_simple("z_card", lambda k, d: _z(k, d).groupBy("key").agg(F.count("*").alias("n")), f"WITH {Z} SELECT key, count(*) AS n FROM z GROUP BY 1")
_simple("z_score", lambda k, d: _z(k, d).where("key = 7").select("member", "score"), f"WITH {Z} SELECT member, score FROM z WHERE key = 7")
_simple("z_rank", lambda k, d: zsets.rank(_z(k, d)), f"{_R} SELECT key, member, score, rank FROM r")
_simple("z_revrank", lambda k, d: zsets.rank(_z(k, d), True), f"{_R} SELECT key, member, score, back AS rank FROM r")
_simple("z_range", lambda k, d: zsets.by_rank(_z(k, d), 1, -2), f"{_R} SELECT key, member, score, rank FROM r WHERE rank >= 1 AND rank <= n - 2")
_simple("z_revrange", lambda k, d: zsets.by_rank(_z(k, d), 0, 2, True), f"{_R} SELECT key, member, score, back AS rank FROM r WHERE back <= 2")
_simple("z_rangebyscore", lambda k, d: zsets.by_score(_z(k, d), zsets.score_between(50000, 200000, True, False), 1, 2),
        f"WITH {Z}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) AS i FROM z WHERE score > 50000 AND score <= 200000) SELECT key, member, score FROM r WHERE i IN (2, 3)")
_simple("z_revrangebyscore", lambda k, d: zsets.by_score(_z(k, d), zsets.score_between(50000, 200000), 0, 2, True),
        f"WITH {Z}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) AS i FROM z WHERE score BETWEEN 50000 AND 200000) SELECT key, member, score FROM r WHERE i <= 2")
_simple("z_rangebylex", lambda k, d: _z(k, d).where(zsets.member_between("[12", "(34")), f"WITH {Z} SELECT * FROM z WHERE member::VARCHAR >= '12' AND member::VARCHAR < '34'")
_simple("z_revrangebylex", lambda k, d: _z(k, d).where(zsets.member_between("(5", "+")).select("key", F.col("member").cast("string").alias("member")).orderBy(F.col("member").desc(), "key").limit(20),
        f"WITH {Z} SELECT key, member::VARCHAR AS member FROM z WHERE member::VARCHAR > '5' ORDER BY 2 DESC, 1 LIMIT 20")
_simple("z_count", lambda k, d: zsets.count(_z(k, d), zsets.score_between(100000, None, True)), f"WITH {Z} SELECT key, count(*) FILTER (score > 100000) AS n FROM z GROUP BY 1")
_simple("z_lexcount", lambda k, d: zsets.count(_z(k, d), zsets.member_between("-", "[2")), f"WITH {Z} SELECT key, count(*) FILTER (member::VARCHAR <= '2') AS n FROM z GROUP BY 1")
_simple("z_mscore", lambda k, d: zsets.scores(_z(k, d), load(k, d, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") * 10).alias("member"))),
        f"WITH {Z} SELECT c_custkey AS key, c_custkey * 10 AS member, score FROM customer LEFT JOIN z ON z.key = c_custkey AND z.member = c_custkey * 10")
_simple("z_popmin", lambda k, d: zsets.pop(_z(k, d), 2), f"{_R} SELECT key, member, score FROM r WHERE rank < 2")
_simple("z_popmax", lambda k, d: zsets.pop(_z(k, d), 2, True), f"{_R} SELECT key, member, score FROM r WHERE back < 2")
_simple("z_scan", lambda k, d: sets.scan(_z(k, d), "*99"), f"WITH {Z} SELECT * FROM z WHERE member::VARCHAR LIKE '%99'")
_simple("z_incrby", lambda k, d: zsets.increment(_z(k, d).withColumn("score", F.floor("score").cast("double")), _z(k, d).where("member % 5 = 0").withColumn("score", F.lit(10.0))),
        f"WITH {Z} SELECT key, member, floor(score) + CASE WHEN member % 5 = 0 THEN 10.0 ELSE 0.0 END AS score FROM z")
for _agg in ("sum", "min", "max"):
    _simple(f"z_union_weights_{_agg}", lambda k, d, a=_agg: zsets.union(_y(k, d), {"R": 2, "A": 3}, a),
            f"WITH {Y} SELECT member, {_agg}(score * CASE key WHEN 'R' THEN 2.0 ELSE 3.0 END) AS score FROM y WHERE key IN ('R', 'A') GROUP BY 1")
    _simple(f"z_inter_weights_{_agg}", lambda k, d, a=_agg: zsets.intersection(_y(k, d), {"R": 2, "A": 3}, a),
            f"WITH {Y} SELECT member, {_agg}(score * CASE key WHEN 'R' THEN 2.0 ELSE 3.0 END) AS score FROM y WHERE key IN ('R', 'A') GROUP BY 1 HAVING count(*) = 2")
_simple("z_intercard", lambda k, d: zsets.intersection(_y(k, d), {"R": 1, "A": 1}).limit(100).agg(F.count("*").alias("n")),
        f"WITH {Y} SELECT least(100, count(*)) AS n FROM (SELECT member FROM y WHERE key = 'R' INTERSECT SELECT member FROM y WHERE key = 'A')")
_simple("z_diff", lambda k, d: zsets.difference(_z(k, d).where("key <= 40").select(F.lit("a").alias("key"), "member", "score").unionByName(_z(k, d).where("score > 100000").select(F.lit("b").alias("key"), "member", "score")), "a", ["b"]),
        f"WITH {Z} SELECT member, score FROM z WHERE key <= 40 AND member NOT IN (SELECT member FROM z WHERE score > 100000)")
_simple("z_rem", lambda k, d: zsets.remove(_z(k, d), F.col("member").isin([1, 2, 3, 32, 33])), f"WITH {Z} SELECT * FROM z WHERE member NOT IN (1, 2, 3, 32, 33)")
_simple("set_store_diff", lambda k, d: sets.store(sets.difference(_s(k, d), 1, [2, 3]), 999), f"WITH {S} SELECT 999 AS key, member FROM (SELECT member FROM s WHERE key = 1 EXCEPT SELECT member FROM s WHERE key IN (2, 3))")
_simple("set_store_inter", lambda k, d: sets.store(sets.intersection(_wide(k, d), ["A", "R"]), 999), "SELECT 999 AS key, l_partkey AS member FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_partkey HAVING count(DISTINCT l_returnflag) = 2")
_simple("set_randmember_repeats", lambda k, d: sets.sample_with_repeats(_s(k, d), 3, "x"),
        f"WITH {S}, r AS (SELECT key, member, row_number() OVER (PARTITION BY key ORDER BY member) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM s), g AS (SELECT DISTINCT key, n, unnest([0, 1, 2]) AS draw FROM r) SELECT g.key, draw, member FROM g JOIN r ON r.key = g.key AND i = ('0x' || substr(md5('x:' || g.key || ':' || draw), 1, 8))::BIGINT % g.n")
_simple("z_remrangebyrank", lambda k, d: zsets.remove_by_rank(_z(k, d), 0, 1), f"{_R} SELECT key, member, score FROM r WHERE rank > 1")
_simple("z_remrangebyscore", lambda k, d: zsets.remove(_z(k, d), zsets.score_between(50000, 150000)), f"WITH {Z} SELECT * FROM z WHERE NOT score BETWEEN 50000 AND 150000")
_simple("z_remrangebylex", lambda k, d: zsets.remove(_z(k, d), zsets.member_between("[1", "[3")), f"WITH {Z} SELECT * FROM z WHERE NOT (member::VARCHAR >= '1' AND member::VARCHAR <= '3')")
