"""Operators on small literals, and query languages against what they should mean."""

import random

import pytest
from pyspark.sql import functions as F

from lodeframe.functions.glob import matches, to_regex
from lodeframe.operators import bitmaps, geo, hashes, jsondocs, keyspace, lists, search, sets, sketches, streams, strings, timeseries, vectors, zsets
from lodeframe.operators.filterexpr import compile_filter


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect())


@pytest.fixture(scope="module")
def z(spark):
    inf = float("inf")
    return spark.createDataFrame([("k", m, s) for m, s in zip("abcdefg", [-inf, 1.0, 2.0, 3.0, 4.0, 5.0, inf], strict=True)], "key string, member string, score double")


def test_score_ranges(z):
    pick = lambda *a: rows(z.where(zsets.score_between(*a)), "member")
    inf = float("inf")
    assert pick(-inf, 2) == ["a", "b", "c"] and pick(0, 3) == ["b", "c", "d"]
    assert pick(0, 3, True, True) == ["b", "c"] and pick(-inf, 2, True, True) == ["b"] and pick(4, inf, True, True) == ["f"]
    assert zsets.count(z, zsets.score_between(0, 3)).first().n == 3


def test_lex_ranges_and_ranks(spark):
    words = "alpha bar cool down elephant foo great hill omega".split()
    z = spark.createDataFrame([("k", w, 0.0) for w in words], "key string, member string, score double")
    assert rows(z.where(zsets.member_between("-", "[cool")), "member") == ["alpha", "bar", "cool"]
    assert rows(z.where(zsets.member_between("(bar", "(down")), "member") == ["cool"]
    assert rows(zsets.by_rank(z, -2, -1), "member") == ["hill", "omega"]


def test_weighted_algebra(spark):
    z = spark.createDataFrame([("A", "a", 1.0), ("A", "b", 2.0), ("A", "c", 3.0), ("B", "b", 1.0), ("B", "c", 2.0), ("B", "d", 3.0)], "key string, member string, score double")
    assert rows(zsets.union(z, {"A": 1, "B": 1}), "member", "score") == [("a", 1.0), ("b", 3.0), ("c", 5.0), ("d", 3.0)]
    assert rows(zsets.union(z, {"A": 2, "B": 3}), "member", "score") == [("a", 2.0), ("b", 7.0), ("c", 12.0), ("d", 9.0)]
    assert rows(zsets.intersection(z, {"A": 2, "B": 3}), "member", "score") == [("b", 7.0), ("c", 12.0)]
    assert rows(zsets.intersection(z, {"A": 1, "none": 1}), "member") == []
    assert rows(zsets.difference(z, "A", ["B"]), "member") == ["a"]


def test_set_algebra_against_a_model(spark):
    rng = random.Random(4)
    model = {k: {rng.randrange(60) for _ in range(rng.randrange(1, 50))} for k in "abcd"}
    s = spark.createDataFrame([(k, m) for k, v in model.items() for m in v], "key string, member int")
    assert rows(sets.difference(s, "a", ["b", "c"]), "member") == sorted(model["a"] - model["b"] - model["c"])
    assert rows(sets.intersection(s, ["a", "b", "d"]), "member") == sorted(model["a"] & model["b"] & model["d"])
    assert rows(sets.union(s, ["a", "d"]), "member") == sorted(model["a"] | model["d"])
    assert rows(sets.intersection(s, ["a", "missing"]), "member") == []
    assert sets.sample(s, 2, "s").count() == sum(min(2, len(v)) for v in model.values())


@pytest.mark.parametrize(("pattern", "yes", "no"), [
    ("h?llo", ["hello", "hallo"], ["hllo"]), ("h*o", ["ho", "hello"], ["hell"]), ("h[ae]llo", ["hello"], ["hillo"]), ("h[^e]llo", ["hallo"], ["hello"]),
    ("h[a-c]llo", ["hbllo"], ["hdllo"]), (r"h\*llo", ["h*llo"], ["hello"]), ("a.b", ["a.b"], ["axb"]), ("ab*", ["ab", "abc"], ["xab"]), ("[z-x]", ["y"], ["a"])])
def test_glob(spark, pattern, yes, no):
    df = spark.createDataFrame([(x,) for x in yes + no], "s string")
    assert rows(df.where(matches(F.col("s"), pattern)), "s") == sorted(yes), to_regex(pattern)


def test_lists(spark):
    li = spark.createDataFrame([("k", i, v) for i, v in enumerate("abcabca")], "key string, pos int, value string")
    assert rows(lists.slice_(li, -2, -1), "value") == ["a", "c"]
    assert rows(lists.positions(li, F.col("value") == "a", -1, 2), "index") == [3, 6]
    assert rows(lists.remove(li, F.lit("a"), -2), "pos") == [0, 1, 2, 4, 5]
    assert [r.value for r in lists.insert(li, F.lit("b"), "x").orderBy("pos").collect()] == list("axbcabca")
    assert [r.value for r in lists.push(li, spark.createDataFrame([("k", 1, "y"), ("k", 2, "z")], "key string, seq int, value string"), True).orderBy("pos").limit(3).collect()] == ["z", "y", "a"]


def test_strings(spark):
    df = spark.createDataFrame([("This is a string",), ("",)], "v string")
    get = lambda a, b: [bytes(r[0]).decode() for r in df.select(strings.get_range(F.col("v"), a, b)).collect()]
    assert get(0, 3) == ["This", ""] and get(-3, -1) == ["ing", ""] and get(10, 100) == ["string", ""] and get(5, 3) == ["", ""]
    put = lambda o, d: [bytes(r[0]) for r in df.select(strings.set_range(F.col("v"), o, d)).collect()]
    assert put(8, "b") == [b"This is b string", b"\0" * 8 + b"b"]
    pair = spark.createDataFrame([("ohmytext", "mynewtext")], "a string, b string")
    r = pair.select(strings.lcs("a", "b").alias("s"), strings.lcs_runs("a", "b").alias("r")).first()
    assert r.s == "mytext" and r.r == [[4, 7, 5, 8, 4], [2, 3, 0, 1, 2]]


def test_sort_by_weights(spark):
    rng = random.Random(2)
    w = {i: rng.random() for i in range(100)}
    elems = spark.createDataFrame([(i,) for i in w], "elem int")
    table = spark.createDataFrame([(f"weight_{i}", str(x)) for i, x in w.items()], "key string, value string")
    got = keyspace.sort_by(elems, table, F.concat(F.lit("weight_"), F.col("elem").cast("string")))
    assert [r.elem for r in got.collect()] == sorted(w, key=w.get)


def test_geo_cells(spark):
    known = {"lic market": (-73.9454966, 40.747533, 1791875804419201), "central park": (-73.9733487, 40.7648057, 1791875761332224), "union square": (-73.9903085, 40.7362513, 1791875485187452),
             "wtc one": (-74.0131604, 40.7126674, 1791873972053020), "q4": (-73.9375699, 40.7498929, 1791875830079666), "4545": (-73.9564142, 40.7480973, 1791875796750882)}
    p = spark.createDataFrame([(k, lon, lat) for k, (lon, lat, _) in known.items()], "member string, lon double, lat double")
    cells = p.withColumn("cell", geo.encode(F.col("lon"), F.col("lat")))
    assert {r.member: r.cell for r in cells.collect()} == {k: v[2] for k, v in known.items()}
    at = geo.decode(F.col("cell"))
    own = cells.select("member", at[0].alias("lon"), at[1].alias("lat"))
    near = geo.within_radius(own, -73.9798091, 40.7598464, 3, "km").orderBy("dist")
    assert [r.member for r in near.collect()] == ["central park", "4545", "union square"]
    box = geo.within_box(own, -73.9798091, 40.7598464, 6, 6, "km").orderBy("dist")
    assert [r.member for r in box.collect()] == ["central park", "4545", "union square", "lic market"]
    sicily = spark.createDataFrame([(13.361389, 38.115556)], "lon double, lat double")
    assert sicily.select(geo.hash_string(geo.encode(F.col("lon"), F.col("lat")))).first()[0] == "sqc8b49rny0"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_radius_join_is_complete(spark, seed):
    rng = random.Random(seed)
    pts = [(i, rng.uniform(-180, 180), rng.choice([rng.uniform(-90, 90), rng.uniform(80, 90), rng.uniform(-3, 3)])) for i in range(300)]
    cs = [(i, rng.choice([rng.uniform(-180, 180), 179.9, -179.95]), rng.choice([rng.uniform(-89, 89), 84.0, -88.0])) for i in range(20)]
    p = spark.createDataFrame(pts, "member int, lon double, lat double")
    c = spark.createDataFrame(cs, "id int, clon double, clat double")
    r = rng.choice([50.0, 900.0, 3000.0])
    want = p.crossJoin(c).where(geo.distance(F.col("clon"), F.col("clat"), F.col("lon"), F.col("lat"), "km") <= r)
    assert rows(geo.radius_join(p, c, r), "id", "member") == rows(want, "id", "member")


def test_bit_operations(spark):
    bits = lambda h: [i for i in range(len(h) * 4) if int(h, 16) >> (len(h) * 4 - 1 - i) & 1]
    b = spark.createDataFrame([(k, i) for k, h in (("a", "0102ffff"), ("b", "0102ff")) for i in bits(h)], "key string, bit int")
    for op, h in {"and": "0102ff00", "or": "0102ffff", "xor": "000000ff", "diff": "000000ff", "diff1": "00000000", "andor": "0102ff00", "one": "000000ff"}.items():
        assert rows(bitmaps.combine(b, ["a", "b"], op), "bit") == bits(h), op
    packed = bitmaps.pack(b, 4)
    assert {r.key: bytes(r.value).hex() for r in packed.collect()} == {"a": "0102ffff", "b": "0102ff00"}
    got = packed.where("key = 'a'").select(bitmaps.field(F.col("value"), "u12", 4), bitmaps.field(F.col("value"), "i8", 16), bitmaps.field(F.col("value"), "i63", 1), bitmaps.field(F.col("value"), "u8", 28)).first()
    assert got[0] == 0x102 and got[1] == -1 and got[2] == (0x0102FFFF << 32) and got[3] == 0xF0


def test_time_series(spark):
    s = spark.createDataFrame([("k", i * 1000, float(i)) for i in range(100)], "key string, ts_ms long, value double")
    b = timeseries.aggregate(s, 10000, "sum").orderBy("ts_ms").collect()
    assert len(b) == 10 and b[0].value == 45
    one = timeseries.aggregate(s.where("ts_ms = 0"), 1000, "stds").first()
    assert one.value == 0.0
    dup = spark.createDataFrame([("k", t, v, i) for i, (t, v) in enumerate([(1000, 10.0), (1000, 5.0), (2000, 20.0), (2000, 10.0), (3000, 100.0)])], "key string, ts_ms long, value double, seq int")
    assert rows(timeseries.resolve(dup, "sum"), "ts_ms", "value") == [(1000, 15.0), (2000, 30.0), (3000, 100.0)]
    assert rows(timeseries.resolve(dup, "first"), "value") == [10.0, 20.0, 100.0]
    with pytest.raises(Exception, match="duplicate"):
        timeseries.resolve(dup, "block").collect()


def test_filters(spark):
    v = spark.createDataFrame([
        ("item:1", '{"age": 25, "name": "Alice", "active": true, "scores": [85, 90, 95], "city": "New York"}'),
        ("item:2", '{"age": 30, "name": "Bob", "active": false, "scores": [70, 75, 80], "city": "Boston"}'),
        ("item:3", '{"age": 35, "name": "Charlie", "scores": [60, 65, 70], "city": "Seattle"}'), ("item:4", None), ("item:5", "[not json")], "element string, attrs string")
    pick = lambda f: [x[-1] for x in rows(v.where(compile_filter(f)), "element")]
    assert pick(".age == 25") == ["1"] and pick(".age > 25") == ["2", "3"] and pick(".age <= 30") == ["1", "2"] and pick('.name != "Alice"') == ["2", "3"]
    assert pick('.age > 20 and (.city == "Boston" or .name == "Alice")') == ["1", "2"]
    assert pick("not .active") == ["2", "3"] and pick(".active") == ["1"]
    assert pick("70 in .scores") == ["2", "3"] and pick('"ton" in .city') == ["2"] and pick(".age in [25, 35]") == ["1", "3"]
    assert pick(".age * 2 - 10 >= 50") == ["2", "3"] and pick(".age % 10 == 5") == ["1", "3"] and pick("2 ** 3 ** 2 == 512 && .age / 0 == 1") == []
    assert pick(".missing > 1") == [] and pick("-.age < -30") == ["3"]
    for bad in (".age >", "(.age", ".age 5", "& 5"):
        with pytest.raises(ValueError):
            compile_filter(bad)


def test_vectors(spark):
    v = spark.createDataFrame([("item:1", [1.0, 0.0, 0.0, 0.0], None), ("item:2", [0.99, 0.01, 0.0, 0.0], None), ("item:3", [0.1, 1.0, -1.0, 0.5], None), ("zero", [0.0] * 4, None)], "element string, embedding array<float>, attrs string")
    s = {r.element: r.score for r in vectors.similar(v, [1, 0, 0, 0]).collect()}
    assert s["item:1"] > 0.99 and s["item:2"] > 0.99 and s["item:3"] < 0.8 and s["zero"] == 0.5
    assert [len(r[0]) for r in v.select(vectors.reduce_dimension(F.col("embedding"), 2, 4)).collect()] == [2] * 4


def test_json_paths():
    assert jsondocs.parse("$.a.b[0]") == ["a", "b", 0] and jsondocs.parse(".a['x y'][-1]") == ["a", "x y", -1] and jsondocs.parse("$.*.a") == [None, "a"] and jsondocs.parse("$") == []


def test_json_edges(spark):
    d = spark.createDataFrame([('{"a":[],"n":null,"b":true,"s":"é"}',), (None,), ("broken",)], "doc string")
    r = d.select(jsondocs.type_of(F.col("doc"), "$.n").alias("n"), jsondocs.array_length(F.col("doc"), "$.a").alias("l"), jsondocs.string_length(F.col("doc"), "$.s").alias("s"), *[x.alias(f"p{i}") for i, x in enumerate(jsondocs.array_pop(F.col("doc"), "$.a"))]).collect()
    assert r[0].n == "null" and r[0].l == 0 and r[0].s == 2 and r[0].p0 is None and r[0].p1 == "[]"
    assert r[1].n is None and r[2].n is None


def test_queries_of_search(spark):
    docs = spark.createDataFrame([(1, "The quick brown fox", "red, Blue", 5.0), (2, "Quick foxes jump", "blue", 10.0), (3, "slow brown bear", "green", 15.0), (4, None, None, None)], "id int, body string, color string, n double")
    f = {"body": "text", "color": "tag", "n": "numeric"}
    pick = lambda q: rows(search.search(docs, q, f), "id")
    assert pick("quick") == [1, 2] and pick("quick brown") == [1] and pick("bear|jump") == [2, 3] and pick("brown -fox") == [3]
    assert pick('"quick brown"') == [1] and pick('"brown quick"') == [] and pick("fox*") == [1, 2] and pick("*ow") == [3] and pick("*ui*") == [1, 2]
    assert pick("fix%1") == [1] and pick("@body:(slow|jump)") == [2, 3] and pick("@color:{BLUE|green}") == [2, 3] and pick("@n:[(5 15]") == [2, 3] and pick("@n:[-inf 10)]") == [1]
    assert pick("*") == [1, 2, 3, 4] and pick("") == [1, 2, 3, 4] and pick("quick (foxes|brown) @n:[0 7]") == [1]
    with pytest.raises(ValueError):
        search.search(docs, "(a", f)
    with pytest.raises(ValueError):
        search.search(docs, "@nope:x", f)
    assert rows(search.aggregate(docs, ["color"], [("count", None, "c")]), "color")[0] == "(nil)"


def test_sketches(spark):
    v = spark.createDataFrame([(float(i),) for i in range(1, 101)], "v double")
    q = sketches.quantiles(v, "v", [0.0, 0.5, 1.0]).first().q
    assert q[0] == 1 and q[2] == 100 and abs(q[1] - 50) <= 5
    assert rows(sketches.cdf(v, "v", [0.0, 50.0, 100.0, 200.0]), "fraction") == [0.0, 0.5, 1.0, 1.0]
    assert sketches.rank(v, "v", 0.0).first()[0] == -1 and sketches.rank(v.limit(0), "v", 1.0).first()[0] == -2
    t = spark.createDataFrame([("k", float(i)) for i in range(1, 11)], "key string, v double")
    assert abs(sketches.trimmed_mean(t, "key", "v", 0.0, 1.0).first().mean - 5.5) < 1e-9
    items = spark.createDataFrame([(f"{a}-{i}",) for a in ("foo", "bar", "zap") for i in range(3000)], "item string")
    n = sketches.hll_count(sketches.hll(items.withColumn("key", F.lit("k")), "key", "item")).first().n
    assert abs(n - 9000) < 450
    b = sketches.bloom(items, "item", 9000, 0.01)
    other = spark.createDataFrame([(f"no-{i}",) for i in range(2000)], "item string")
    assert sketches.bloom_exists(b, items, "item", 9000, 0.01).where("NOT maybe").count() == 0
    assert sketches.bloom_exists(b, other, "item", 9000, 0.01).where("maybe").count() < 60


def test_stream_groups(spark):
    s = spark.createDataFrame([("k", i, 0) for i in range(1, 7)], "key string, ms long, seq long")
    g = spark.createDataFrame([("k", "g", 2, 0)], "key string, group string, ms long, seq long")
    moved, pend = streams.deliver(s, g, F.lit("c"), 3, 100)
    assert rows(pend, "ms") == [3, 4, 5] and moved.first().ms == 5
    left = streams.acknowledge(pend, pend.where("ms = 4"))
    assert streams.pending_summary(left).first().n == 2
    claimed = streams.claim(left, left.where("ms = 3"), "d", 200, 50)
    assert rows(claimed, "ms", "consumer", "deliveries") == [(3, "d", 2), (5, "c", 1)]
    assert streams.group_info(s, moved, left).first().lag == 1
    more = spark.createDataFrame([("k", 6, 0), ("k", 9, 0)], "key string, ms long, seq long")
    assert streams.append(s, more).count() == 7


def test_hash_updates(spark):
    h = spark.createDataFrame([("k", "f", "1"), ("k", "g", "2")], "key string, field string, value string")
    d = spark.createDataFrame([("k", "f", "5"), ("k", "new", "7")], "key string, field string, value string")
    assert rows(hashes.increment(h, d), "field", "value") == [("f", 6), ("g", 2), ("new", 7)]
    assert rows(hashes.set_if_absent(h, d), "field", "value") == [("f", "1"), ("g", "2"), ("new", "7")]
    assert hashes.get_all(h).first().fields == {"f": "1", "g": "2"}


def test_indexes(spark):
    from lodeframe.operators.indexes import Indexes

    spark.createDataFrame([(1, "red fox", "a"), (2, "green frog", "b"), (3, "crimson fix", None)], "id int, body string, kind string").createOrReplaceTempView("things")
    ix = Indexes(spark)
    ix.create("i", "things", {"body": "text"})
    ix.alter("i", "kind", "tag")
    ix.alias("j", "i")
    assert rows(ix.search("j", "fox|frog @kind:{a|b}"), "id") == [1, 2] and ix.names() == ["i"]
    ix.synonyms("i", "g", "red", "crimson")
    assert rows(ix.search("i", "red"), "id") == [1, 3]
    assert rows(ix.info("i"), "field", "rows") == [("body", 3), ("kind", 2)]
    assert ix.add_words("d", "fix", "x") == 2 and ix.delete_words("d", "x") == 1 and ix.words("d") == ["fix"]
    assert rows(ix.spellcheck("i", "body", "fax"), "term") == ["fix", "fox"] and rows(ix.spellcheck("i", "body", "fox", 1, "d"), "term") == []
    assert ix.aggregate("i", "*", ["kind"], [("count", None, "n")]).count() == 3 and "Filter" in ix.explain("i", "fox")
    with pytest.raises(ValueError):
        ix.alter("i", "BODY", "text")
    ix.drop("i")
    with pytest.raises(KeyError):
        ix.search("j", "fox")


def test_lcs_against_a_table():
    """Halving against the whole dynamic program; long texts in bounded memory; nulls; runs of a least length."""
    import random

    from lodeframe.operators import strings

    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcß") for _ in range(rng.randrange(0, 14))) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        common, runs = strings._lcs(a, b)
        assert len(common) == best[-1][-1] == sum(r[4] for r in runs)
        assert "".join(a[r[0] : r[1] + 1] for r in reversed(runs)) == "".join(b[r[2] : r[3] + 1] for r in reversed(runs)) == common
        assert [r for r in runs if r[4] >= 2] == strings._lcs(a, b, 2)[1]
    a = "".join(rng.choice("ab") for _ in range(3000))
    assert strings._lcs(a, a)[1] == [[0, 2999, 0, 2999, 3000]]


def test_json_paths_that_cannot_be_read(spark):
    from pyspark.sql import functions as F

    from lodeframe.operators import jsondocs

    rows = [('{"a":{"b":[1,2]}}', "$.a.b[0]", "7"), ("not json", "$.a", "1"), ('{"a":1}', "$.a", "not json"), (None, "$.a", "1"), ('{"a":1}', "$.x.y", "1"), ("[1,2,3]", "$[-1]", "null")]
    df = spark.createDataFrame(rows, "doc string, path string, value string")
    got = df.select(jsondocs.set_path("doc", "path", "value").alias("s"), jsondocs.delete_path("doc", "path").alias("d")).collect()
    assert [r.s for r in got] == ['{"a":{"b":[7,2]}}', "not json", '{"a":1}', None, '{"a":1}', "[1,2,null]"]
    assert [r.d for r in got] == ['{"a":{"b":[2]}}', "not json", "{}", None, '{"a":1}', "[1,2]"]


def test_batch_search_in_blocks(spark, monkeypatch):
    import numpy as np

    from lodeframe.operators import vectors

    monkeypatch.setattr(vectors, "QUERIES", 7)
    monkeypatch.setattr(vectors, "VECTORS", 16)
    rng = np.random.RandomState(1)
    x = rng.randn(90, 6).astype(np.float32)
    x[40:50], x[60] = x[40], 0
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(95, None)], "element long, embedding array<float>")
    for kind in ("cosine", "l2", "ip"):
        d = np.round(vectors.distances(x.astype(np.float64), x.astype(np.float64), kind), 10)
        got = vectors.batch(df, df.where("element % 3 = 0").selectExpr("element AS query", "embedding AS q"), 4, kind).collect()
        for q in range(0, 90, 3):
            want = sorted((d[q, i], i) for i in range(90) if i != q)[:4]
            assert [(r.distance, r.element) for r in sorted(got, key=lambda r: r["rank"]) if r.query == q] == want


def test_radius_join_is_dealt_by_pairs(spark, monkeypatch):
    monkeypatch.setattr(geo, "BLOCK", 16, raising=False)
    rng = random.Random(5)
    here = [(i, rng.uniform(10, 12), rng.uniform(84, 85)) for i in range(400)] + [(400, 11.0, 84.5), (400, 11.0, 84.5)]
    points = spark.createDataFrame(here, "member long, lon double, lat double").coalesce(1)
    centres = spark.createDataFrame(here[:90], "id long, clon double, clat double").coalesce(1)
    found = geo.radius_join(points, centres, 60, "km").withColumn("task", F.spark_partition_id()).collect()
    d = geo.distance(F.col("clon"), F.col("clat"), F.col("lon"), F.col("lat"), "km")
    want = points.crossJoin(centres).withColumn("dist", d).where("dist <= 60").collect()
    key = lambda r: (r.id, r.member, r.dist)
    assert want and sorted(map(key, found)) == sorted(map(key, want))
    tasks = [r.task for r in found]
    assert max(map(tasks.count, set(tasks))) < len(found) / 4  # one square, but not one task


def test_batch_search_holds_no_pairs_of_blocks(spark, monkeypatch):
    import numpy as np

    for name, size in (("QUERIES", 8), ("VECTORS", 16), ("GROUP", 60), ("PART", 50), ("CELLS", 32)):
        monkeypatch.setattr(vectors, name, size, raising=False)
    x = np.random.RandomState(2).randn(150, 6).astype(np.float32) * 1000
    x[50:100] = x[:50]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "element long, embedding array<float>")
    for kind in ("l2", "cosine", "ip"):
        found = vectors.batch(df, df.where("element < 40").selectExpr("element AS query", "embedding AS q"), 3, kind)
        # A row of two blocks is megabytes, and an Arrow batch takes thousands of rows whatever their size.
        assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()
        got = {(r.query, r["rank"]): (r.distance, r.element) for r in found.collect()}
        for q in range(40):
            a, b = x[q].astype(float), x.astype(float)
            d = {"l2": lambda: np.sqrt(((a - b) ** 2).sum(1)), "ip": lambda: -(b @ a), "cosine": lambda: 1 - b @ a / np.sqrt((b * b).sum(1) * (a @ a))}[kind]()
            want = sorted((max(round(float(d[i]), 10), 0.0) if kind != "ip" else float(d[i]), i) for i in range(150) if i != q)[:3]
            assert [got[q, i + 1][1] for i in range(3)] == [i for _, i in want]
            assert np.allclose([got[q, i + 1][0] for i in range(3)], [e for e, _ in want], rtol=1e-12, atol=2e-10)
        if kind == "l2":
            assert all(got[q, 1] == (0.0, q + 50) for q in range(40))


def test_lcs_works_on_many_pairs_at_once(monkeypatch):
    import pandas as pd

    rng = random.Random(3)
    a, b = ([("".join(rng.choice("abß😀") for _ in range(rng.randrange(0, 14)))) for _ in range(500)] for _ in range(2))
    a, b = pd.Series([*a, None, "ab"] * 4), pd.Series([*b, "ab", None] * 4)
    calls, lengths = [], strings._lengths
    monkeypatch.setattr(strings, "_lengths", lambda x, y: calls.append(1) or lengths(x, y))
    common, n = strings.lcs.func(a, b).tolist(), strings.lcs_length.func(a, b).tolist()
    assert len(calls) < 200
    for p, q, c, k in zip(a, b, common, n, strict=True):
        if p is None or q is None:
            assert c is None and pd.isna(k)
        else:
            assert c == strings._lcs(p, q)[0] and len(c) == k


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_quantiles_bring_few_values_together(spark, monkeypatch, accuracy):
    monkeypatch.setattr(sketches, "ACCURACY", accuracy, raising=False)
    rng, qs = random.Random(4), [0.5, 0.0, 0.013, 0.99, 1.0, 0.5]
    cases = [[rng.gauss(0, 9) for _ in range(3000)] + [None], [rng.choice([1.0, 1.0, -2.0, 1e300]) for _ in range(400)], [7.0], [None], [float("nan"), 1.0, float("inf"), -1.0]]
    for values in cases:
        df = spark.createDataFrame([(x,) for x in values], "x double").repartition(3)
        got = sketches.quantiles(df, "x", qs)
        want = df.agg(F.percentile("x", F.array(*map(F.lit, qs))).alias("q")).first().q
        assert repr(got.first().q) == repr(want)
    plan = sketches.quantiles(spark.range(100_000).selectExpr("id * 1.5D AS x"), "x", [0.25])._jdf.queryExecution().toString()
    assert "percentile(" not in plan  # which holds all distinct values in one task


def test_pop_sorts_no_whole_sets(spark):
    here = [(k, m) for k in range(4) for m in range(k * 3)] + [(1, 1)]
    df, limit = spark.createDataFrame(here, "key long, member long"), "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        left, drawn = sets.pop(df, 2, "x"), sets.sample(df, 2, "x")
        assert sorted(map(tuple, left.collect())) == sorted(set(here) - set(map(tuple, drawn.collect())))
        assert "SortMergeJoin" not in left._jdf.queryExecution().toString()
    finally:
        spark.conf.set(limit, before)


def test_cardinality_makes_distinct_rows_once(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, None), (None, 3)], "key long, member long")
    assert sorted(map(tuple, sets.cardinality(df).collect()), key=repr) == sorted([(1, 2), (2, 0), (None, 1)], key=repr)
    once = lambda x: x._jdf.queryExecution().executedPlan().toString().count("keys=[key")
    assert once(sets.cardinality(df.distinct())) == once(sets.cardinality(df)) == 4  # two steps each for rows and for keys
