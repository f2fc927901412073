"""JSON documents (parts), full-text search (documents) and sketches (lines and events)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeframe.operators import jsondocs as js
from lodeframe.operators import search as ft
from lodeframe.operators import sketches as sk
from lodeframe.operators import vectors
from lodeframe.plans.registry import Registry
from lodeframe.session import load

ENTRIES = Registry()


def _q(name, f, sql=None):
    ENTRIES.add(name, sql)(f)


def _docs(k, d):
    p = load(k, d, "part")
    nest = F.struct(F.col("p_brand").alias("brand"), F.struct(F.col("p_retailprice").alias("price"), (F.col("p_size") > 25).alias("large")).alias("deep"))
    tags = F.array(F.lit("x"), F.col("p_type"), F.col("p_brand"), F.lit("x"))
    nums = F.array(F.col("p_size"), F.lit(7), F.col("p_size") + 1)
    return p.select("p_partkey", F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"), tags.alias("tags"), nums.alias("nums"), nest.alias("nest"))).alias("doc"))


def D():
    return F.col("doc")


def _j(name, make, sql):
    _q(name, lambda k, d: _docs(k, d).select("p_partkey", make().alias("v")), f"SELECT p_partkey, {sql} AS v FROM part")


_j("json_get", lambda: js.get(D(), "$.nest.brand"), "p_brand")
_j("json_get_index", lambda: js.get(D(), ".nums[-1]"), "(p_size + 1)::VARCHAR")
_j("json_get_quoted", lambda: js.get(D(), "$['nest']['deep']['large']"), "(p_size > 25)::VARCHAR")
_j("json_type", lambda: F.concat_ws(",", *[js.type_of(D(), p) for p in ("$", "$.name", "$.size", "$.tags", "$.nest.deep.large")]), "'object,string,number,array,boolean'")
_j("json_numincrby", lambda: js.number(D(), "$.size") + 1.5, "p_size + 1.5::DOUBLE")
_j("json_nummultby", lambda: js.number(D(), "$.nums[1]") * 3, "21.0::DOUBLE")
_j("json_arrlen", lambda: js.array_length(D(), "$.tags"), "4::BIGINT")
_j("json_arrindex", lambda: js.array_index(D(), "$.tags", "x", 1), "(CASE WHEN p_type = 'x' THEN 1 WHEN p_brand = 'x' THEN 2 ELSE 3 END)::BIGINT")
_j("json_arrappend", lambda: js.array_append(D(), "$.nums", F.lit("99")), "'[' || p_size || ',7,' || p_size + 1 || ',99]'")
_j("json_arrinsert", lambda: js.array_insert(D(), "$.nums", 1, F.lit("0")), "'[' || p_size || ',0,7,' || p_size + 1 || ']'")
_j("json_arrtrim", lambda: js.array_trim(D(), "$.nums", 0, -2), "'[' || p_size || ',7]'")
_j("json_arrpop", lambda: F.concat_ws(" ", *js.array_pop(D(), "$.nums", 0)), "p_size || ' [7,' || p_size + 1 || ']'")
_j("json_objkeys", lambda: F.array_join(js.object_keys(D(), "$.nest"), ","), "'brand,deep'")
_j("json_objlen", lambda: F.size(js.object_keys(D())).cast("long"), "5::BIGINT")
_j("json_strlen", lambda: js.string_length(D(), "$.name"), "strlen(p_name)")
_j("json_strappend", lambda: F.concat(js.get(D(), "$.name"), F.lit("!")), "p_name || '!'")
_j("json_toggle", lambda: js.toggle(D(), "$.nest.deep.large"), "NOT p_size > 25")
_j("json_clear", lambda: F.concat_ws(" ", js.cleared(D(), "$.tags"), js.cleared(D(), "$.size"), js.cleared(D(), "$.nest"), js.cleared(D(), "$.name")), "'[] 0 {} ' || p_name")
_j("json_set", lambda: js.get(js.set_field(D(), "size", F.lit('"big"')), "$.size"), "'big'")
_j("json_set_nx", lambda: js.get(js.set_field(D(), "size", F.lit("1"), "nx"), "$.size"), "p_size::VARCHAR")
_j("json_del", lambda: F.array_join(js.object_keys(js.delete_field(D(), "tags")), ","), "'name,size,nums,nest'")
_j("json_merge", lambda: (lambda m: F.concat_ws(" ", js.get(m, "$.size"), F.coalesce(js.get(m, "$.name"), F.lit("-")), js.get(m, "$.nest"), js.get(m, "$.extra")))(js.merge(D(), F.lit('{"name":null,"nest":{"a":1},"extra":true}'))), "p_size || ' - {\"a\":1} true'")
_q("json_set_path", lambda k, d: _docs(k, d).select("p_partkey", js.get(js.set_path("doc", F.lit("$.nest.deep.price"), F.lit("5")), "$.nest.deep.price").alias("v")), "SELECT p_partkey, '5' AS v FROM part")
_q("json_mget", lambda k, d: load(k, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(_docs(k, d), F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", js.get(D(), "$.name").alias("v")),
   "SELECT l_orderkey, l_linenumber, p_name AS v FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
_q("json_mset", lambda k, d: _docs(k, d).unionByName(_docs(k, d).where("p_partkey % 2 = 0").withColumn("doc", F.lit('{"size":-1}'))).groupBy("p_partkey").agg(F.min(js.number(D(), "$.size")).alias("v")), "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN -1.0 ELSE p_size END::DOUBLE AS v FROM part")

FIELDS = {"text": "text", "lang": "tag", "source": "tag", "n_chars": "numeric", "place": "geo"}
STOPS = ", ".join(f"'{w}'" for w in ft.STOP_WORDS)
T = f"t AS (SELECT *, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' AND w NOT IN ({STOPS})) AS ws, doc_id % 360 - 180.0 AS lon, doc_id % 160 - 80.0 AS lat FROM documents)"


def _texts(k, d):
    place = F.struct((F.col("doc_id") % 360 - 180.0).alias("lon"), (F.col("doc_id") % 160 - 80.0).alias("lat"))
    return load(k, d, "documents").withColumn("place", place)


def _ft(name, query, sql):
    _q(name, lambda k, d: ft.search(_texts(k, d), query, FIELDS).select("doc_id"), f"WITH {T} SELECT doc_id FROM t WHERE {sql}")


HAS = lambda w: f"list_contains(ws, '{w}')"
_ft("ft_term", "onti", HAS("onti"))
_ft("ft_and", "onti ea", f"{HAS('onti')} AND {HAS('ea')}")
_ft("ft_or", "idiot|clown (una|der)", f"({HAS('idiot')} OR {HAS('clown')} AND ({HAS('una')} OR {HAS('der')}))")
_ft("ft_not", "una -osque", f"{HAS('una')} AND NOT {HAS('osque')}")
_ft("ft_optional", "una ~osque", HAS("una"))
_ft("ft_phrase", '"que en"', "contains(' ' || array_to_string(ws, ' ') || ' ', ' que en ')")
_ft("ft_prefix", "worth*", "len(list_filter(ws, lambda w: starts_with(w, 'worth'))) > 0")
_ft("ft_suffix", "*eaux -*lles", "len(list_filter(ws, lambda w: suffix(w, 'eaux'))) > 0 AND len(list_filter(ws, lambda w: suffix(w, 'lles'))) = 0")
_ft("ft_contains", "*isgus*", "len(list_filter(ws, lambda w: contains(w, 'isgus'))) > 0")
_ft("ft_fuzzy", "idiots%1", "len(list_filter(ws, lambda w: levenshtein(w, 'idiots') <= 1)) > 0")
_ft("ft_tag", "@lang:{de|FR} @source:{src1|src2}", "lang IN ('de', 'fr') AND source IN ('src1', 'src2')")
_ft("ft_numeric", "@n_chars:[500 (2000]", "n_chars >= 500 AND n_chars < 2000")
_ft("ft_geo", "@place:[10 20 3000 km]", "2.0 * 6372797.560856 * asin(sqrt(least(1.0, pow(sin((radians(20.0) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(20.0)) * pow(sin((radians(10.0) - radians(lon)) / 2), 2)))) / 1000.0 <= 3000")
_ft("ft_field", "@text:(idiot clown) @lang:{en}", f"{HAS('idiot')} AND {HAS('clown')} AND lang = 'en'")
_ft("ft_matchall", "*", "true")
_q("ft_term_or", lambda k, d: ft.ranked_or(_texts(k, d), "doc_id", "text", "idiot clown the", 0, 20),
   f"WITH {T} SELECT doc_id AS doc, len(list_filter(ws, lambda w: w IN ('idiot', 'clown')))::DOUBLE AS score FROM t WHERE score > 0 ORDER BY score DESC, doc LIMIT 20")
_q("ft_postings", lambda k, d: ft.postings(_texts(k, d), "doc_id", "text").groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("n")), f"WITH {T}, p AS (SELECT doc_id, unnest(ws) AS term FROM t) SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS n FROM p GROUP BY 1")
for _k, _s in {"count": "count(*)", "sum": "CAST(sum(n_chars) AS BIGINT)", "avg": "round(avg(n_chars), 4)", "min": "min(n_chars)", "max": "max(n_chars)", "count_distinct": "count(DISTINCT n_chars)"}.items():
    _q(f"ft_aggregate_{_k}", lambda k, d, a=_k: (lambda o: o.withColumn("v", F.round("v", 4)) if a == "avg" else o)(ft.aggregate(_texts(k, d), ["lang"], [(a, "n_chars", "v")])), f"SELECT coalesce(lang, '(nil)') AS lang, {_s} AS v FROM documents GROUP BY 1")
_q("ft_aggregate_multi", lambda k, d: ft.aggregate(ft.search(_texts(k, d), "-idiot", FIELDS), ["lang", "source"], [("count", None, "n"), ("max", "n_chars", "top")], {"half": "top / 2"}, "n > 3", [("n", True)], 2, 10),
   f"WITH {T} SELECT lang, source, count(*) AS n, max(n_chars) AS top, max(n_chars) / 2 AS half FROM t WHERE NOT {HAS('idiot')} GROUP BY 1, 2 HAVING count(*) > 3 ORDER BY n DESC, lang, source LIMIT 10 OFFSET 2")
_q("ft_tagvals", lambda k, d: ft.tag_values(_texts(k, d), "source"), "SELECT DISTINCT lower(source) AS value FROM documents")
_vocab = lambda k, d: ft.postings(_texts(k, d), "doc_id", "text").groupBy("term").agg(F.sum("tf").alias("n"))
_q("ft_spellcheck", lambda k, d: ft.spellcheck(_vocab(k, d), "clowm", 2), f"WITH {T}, p AS (SELECT unnest(ws) AS term FROM t) SELECT term, count(*) AS n, levenshtein(term, 'clowm') AS edits FROM p WHERE levenshtein(term, 'clowm') <= 2 AND term <> 'clowm' GROUP BY 1")
_q("ft_synonyms", lambda k, d: ft.search(_texts(k, d), ft.expand("una que", {"g": ["der", "una", "onti"]}), FIELDS).select("doc_id"), f"WITH {T} SELECT doc_id FROM t WHERE ({HAS('der')} OR {HAS('una')} OR {HAS('onti')}) AND {HAS('que')}")


def _similar(k, d):
    v = load(k, d, "embeddings").select(F.col("vec_id").alias("element"), "embedding")
    return v.select(F.col("element").alias("doc"), F.round(vectors.cosine_distance(F.col("embedding"), vectors.constant(vectors.vector_of(v, 3))), 9).alias("dist"))


_q("ft_hybrid", lambda k, d: ft.hybrid(ft.ranked_or(_texts(k, d), "doc_id", "text", "idiot clown onti", 0, None), _similar(k, d).select("doc", (1 - F.col("dist")).alias("score"))).withColumn("score", F.round("score", 9)),
   f"""WITH {T}, a AS (SELECT doc_id AS doc, len(list_filter(ws, lambda w: w IN ('idiot', 'clown', 'onti')))::DOUBLE AS score FROM t WHERE score > 0),
   q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 3), b AS (SELECT vec_id AS doc, 1 - round(1.0 - list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))), 9) AS score FROM embeddings, q),
   u AS (SELECT doc, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, doc)) AS part FROM a UNION ALL SELECT doc, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, doc)) FROM b)
   SELECT doc, round(sum(part)::DOUBLE, 9) AS score FROM u GROUP BY 1 ORDER BY sum(part) DESC, doc LIMIT 10""")


def _with_vectors(k, d):
    return _texts(k, d).join(load(k, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")), "doc_id", "left")


def _three(k, d):
    return {"v": vectors.vector_of(load(k, d, "embeddings").select(F.col("vec_id").alias("element"), "embedding"), 3)}


VEC = "w AS (SELECT t.*, list_distance(embedding::DOUBLE[], q) AS far FROM t JOIN embeddings ON doc_id = vec_id, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 3))"
_vf = FIELDS | {"vec": "vector"}
_q("ft_knn", lambda k, d: ft.search(_with_vectors(k, d), "[KNN 25 @vec $v] -@lang:{de}", _vf, _three(k, d)).select("doc_id"), f"WITH {T}, {VEC} SELECT doc_id FROM (SELECT * FROM w ORDER BY far, doc_id LIMIT 25) WHERE lang <> 'de'")
_q("ft_vector_range", lambda k, d: ft.search(_with_vectors(k, d), "@lang:{en} [VECTOR_RANGE 1.2 @vec $v]", _vf, _three(k, d)).select("doc_id"), f"WITH {T}, {VEC} SELECT doc_id FROM w WHERE lang = 'en' AND far <= 1.2")
_q("ft_page", lambda k, d: ft.page(ft.search(_texts(k, d), "onti", FIELDS), ["doc_id", "lang"], ("n_chars", True), 3, 7, None, ("n_chars", 100, 5000)),
   f"WITH {T}, h AS (SELECT * FROM t WHERE {HAS('onti')} AND n_chars BETWEEN 100 AND 5000) SELECT doc_id, lang, (SELECT count(*) FROM h) AS total FROM h ORDER BY n_chars DESC, doc_id, lang LIMIT 7 OFFSET 3")
_q("ft_inkeys", lambda k, d: ft.page(ft.search(_texts(k, d), "onti", FIELDS), ["doc_id"], None, 0, 10, ("doc_id", list(range(40)))), f"WITH {T}, h AS (SELECT * FROM t WHERE {HAS('onti')} AND doc_id < 40) SELECT doc_id, (SELECT count(*) FROM h) AS total FROM h ORDER BY doc_id LIMIT 10")
_q("ft_postings_and", lambda k, d: ft.find(ft.postings(_texts(k, d), "doc_id", "text"), ["onti", "ea"]), f"WITH {T} SELECT doc_id AS doc, len(list_filter(ws, lambda w: w IN ('onti', 'ea')))::DOUBLE AS score FROM t WHERE {HAS('onti')} AND {HAS('ea')}")

_li = lambda k, d: load(k, d, "lineitem")
W, H = 2000, 5
HASH = lambda x, s: f"('0x' || substr(md5('{s}:' || {x}), 1, 8))::BIGINT"
CELLS = " UNION ALL ".join(f"SELECT {i} AS d, {HASH('l_partkey', i)} % {W} AS i, count(*) AS n FROM lineitem GROUP BY 2" for i in range(H))
_q("cms_query", lambda k, d: sk.cms_query(sk.cms(_li(k, d), "l_partkey", W, H), load(k, d, "part").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", W, H),
   f"WITH c AS ({CELLS}) SELECT l_partkey, min(coalesce(n, 0)) AS estimate FROM (SELECT p_partkey AS l_partkey, unnest(range({H})) AS d, unnest([{', '.join(f'{HASH("p_partkey", i)} % {W}' for i in range(H))}]) AS i FROM part) LEFT JOIN c USING (d, i) GROUP BY 1")
_q("cms_merge", lambda k, d: sk.cms_merge([(sk.cms(_li(k, d).where("l_returnflag = 'A'"), "l_partkey", W, H), 1), (sk.cms(_li(k, d).where("l_returnflag <> 'A'"), "l_partkey", W, H), 1)]),
   f"WITH c AS ({CELLS}) SELECT d::INTEGER AS d, i, n FROM c")
_q("cms_info", lambda k, d: sk.cms(_li(k, d), "l_partkey", W, H).groupBy("d").agg(F.sum("n").alias("total")), f"SELECT range::INTEGER AS d, (SELECT count(*) FROM lineitem) AS total FROM range({H})")
CAP, ERR = 3000, 0.01
BITS, K = sk.bloom_size(CAP, ERR)
PL = lambda x: "[" + ", ".join(f"({HASH(x, 0)} + {i} * {HASH(x, 1)}) % {BITS}" for i in range(K)) + "]"
_q("bloom_exists", lambda k, d: sk.bloom_exists(sk.bloom(load(k, d, "orders").where("o_orderstatus = 'F'"), "o_custkey", CAP, ERR), load(k, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", CAP, ERR),
   f"WITH b AS (SELECT DISTINCT unnest({PL('o_custkey')}) AS b FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F')), p AS (SELECT c_custkey, unnest({PL('c_custkey')}) AS b FROM customer) SELECT c_custkey AS o_custkey, bool_and(b IN (SELECT b FROM b)) AS maybe FROM p GROUP BY 1")
_q("bag_count", lambda k, d: sk.bag(_li(k, d), "l_suppkey"), "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1")
_q("bag_delete", lambda k, d: sk.bag(sk.bag_delete(_li(k, d).select("l_suppkey"), load(k, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))), "l_suppkey"), "SELECT l_suppkey, count(*) - (l_suppkey IN (SELECT s_suppkey FROM supplier))::INT AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
_q("topk_exact", lambda k, d: sk.top(_li(k, d), "l_partkey", 20), "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20")
_q("topk_weighted", lambda k, d: sk.top(_li(k, d), "l_partkey", 20, F.col("l_quantity")), "SELECT l_partkey, sum(l_quantity) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20")
_q("topk_query", lambda k, d: load(k, d, "part").select(F.col("p_partkey").alias("l_partkey")).join(sk.top(_li(k, d), "l_partkey", 20), "l_partkey", "left_semi"), "SELECT l_partkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, l_partkey LIMIT 20")
_q("topk_approx_contains_exact", lambda k, d: sk.top(load(k, d, "events"), "event_type", 3).join(sk.top_approx(load(k, d, "events"), "event_type", 5).select(F.col("item").alias("event_type")), "event_type", "left_semi").agg((F.count("*") == 3).alias("ok")), "SELECT true AS ok")
_q("td_quantile_exact", lambda k, d: sk.quantiles(_li(k, d), "l_extendedprice", [0.1, 0.5, 0.99]).select(F.posexplode("q").alias("i", "q")).select(F.col("i").cast("long").alias("i"), F.round("q", 4).alias("q")), "SELECT unnest(range(3)) AS i, round(unnest(quantile_cont(l_extendedprice, [0.1, 0.5, 0.99])), 4) AS q FROM lineitem")
_q("td_cdf", lambda k, d: sk.cdf(_li(k, d), "l_quantity", [0.0, 10.0, 25.5, 100.0]), "SELECT x, avg((l_quantity <= x)::INT) AS fraction FROM lineitem, (SELECT unnest([0.0, 10.0, 25.5, 100.0]::DOUBLE[]) AS x) GROUP BY 1")
_q("td_rank", lambda k, d: sk.rank(_li(k, d), "l_quantity", 20.0), "SELECT count(*) FILTER (l_quantity <= 20) AS rank FROM lineitem")
_q("td_revrank", lambda k, d: sk.rank(_li(k, d), "l_quantity", 20.0, True), "SELECT count(*) FILTER (l_quantity > 20) AS rank FROM lineitem")
_q("td_byrank", lambda k, d: sk.by_rank(_li(k, d), "l_extendedprice", 100), "SELECT l_extendedprice FROM lineitem ORDER BY 1 OFFSET 100 LIMIT 1")
_q("td_byrevrank", lambda k, d: sk.by_rank(_li(k, d), "l_extendedprice", 100, True), "SELECT l_extendedprice FROM lineitem ORDER BY 1 DESC OFFSET 100 LIMIT 1")
_q("td_minmax", lambda k, d: _li(k, d).agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi")), "SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem")
_q("td_trimmed_mean", lambda k, d: sk.trimmed_mean(_li(k, d), "l_suppkey", "l_extendedprice", 0.1, 0.9).withColumn("mean", F.round("mean", 4)),
   "WITH r AS (SELECT l_suppkey, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice)::DOUBLE AS i, count(*) OVER (PARTITION BY l_suppkey)::DOUBLE AS n FROM lineitem), w AS (SELECT *, greatest(0.0, least(i, n * 0.9::DOUBLE) - greatest(i - 1, n * 0.1::DOUBLE)) AS w FROM r) SELECT l_suppkey, round(sum(v * w) / sum(w), 4) AS mean FROM w GROUP BY 1")


def _hll(k, d):
    e = load(k, d, "events")
    exact = e.groupBy(F.col("event_type").alias("key")).agg(F.count_distinct("user_id").alias("m"))
    return sk.hll_count(sk.hll(e, "event_type", "user_id")).join(exact, "key").select("key", (F.abs(F.col("n") - F.col("m")) <= F.greatest(F.lit(2.0), 0.025 * F.col("m"))).alias("ok"))


_q("hll_count", _hll, "SELECT event_type AS key, true AS ok FROM events GROUP BY 1")
_q("hll_merge", lambda k, d: (lambda e: sk.hll_count(sk.hll_merge(sk.hll(e, "event_type", "user_id"))).join(e.agg(F.count_distinct("user_id").alias("m"))).select((F.abs(F.col("n") - F.col("m")) <= F.greatest(F.lit(2.0), 0.025 * F.col("m"))).alias("ok")))(load(k, d, "events")), "SELECT true AS ok")
_q("kll_quantile", lambda k, d: (lambda li: li.select("l_quantity").join(sk.quantiles_approx(li, "l_quantity", [0.5]).select(F.element_at("q", 1).alias("x"))).agg((F.abs(F.avg((F.col("l_quantity") < F.col("x")).cast("double")) - 0.5) < 0.05).alias("ok")))(_li(k, d)), "SELECT true AS ok")

ALPHA = 0.01
G = f"(ln(1 + {ALPHA}) - ln(1 - {ALPHA}))"
DD = f"d AS (SELECT l_returnflag AS key, CAST(ceil(round(ln(l_extendedprice::DOUBLE) / {G}, 9)) AS BIGINT) AS bucket, count(*) AS n FROM lineitem GROUP BY 1, 2)"
_dd = lambda k, d: sk.quantile_sketch(_li(k, d), "l_returnflag", "l_extendedprice", ALPHA)
_q("td_sketch", _dd, f"WITH {DD} SELECT * FROM d")
_q("td_merge", lambda k, d: sk.sketch_quantiles(sk.sketch_merge([_dd(k, d).withColumn("key", F.lit("all"))]), [0.1, 0.5, 0.99], ALPHA).withColumn("value", F.round("value", 4)),
   f"WITH {DD}, m AS (SELECT bucket, sum(n) AS n FROM d GROUP BY 1), c AS (SELECT bucket, sum(n) OVER (ORDER BY bucket) AS upto, sum(n) OVER () AS total FROM m) SELECT 'all' AS key, q, round(2 * exp(min(bucket) * {G}) / (exp({G}) + 1), 4) AS value FROM c, (SELECT unnest([0.1, 0.5, 0.99]::DOUBLE[]) AS q) WHERE upto >= ceil(q * total) GROUP BY q")
_q("td_info", lambda k, d: _dd(k, d).groupBy("key").agg(F.sum("n").alias("observations"), F.count("*").alias("buckets")), f"WITH {DD} SELECT key, CAST(sum(n) AS BIGINT) AS observations, count(*) AS buckets FROM d GROUP BY 1")
_q("td_merge_error", lambda k, d: sk.sketch_quantiles(sk.sketch_merge([_dd(k, d)]), [0.5], ALPHA).join(_li(k, d).groupBy(F.col("l_returnflag").alias("key")).agg(F.percentile("l_extendedprice", F.lit(0.5)).alias("m")), "key").select("key", (F.abs(F.col("value") / F.col("m") - 1) <= 2 * ALPHA).alias("ok")),
   "SELECT DISTINCT l_returnflag AS key, true AS ok FROM lineitem")
_bf = lambda k, d: sk.bloom(load(k, d, "orders").where("o_orderstatus = 'F'"), "o_custkey", CAP, ERR)
SET = f"s AS (SELECT DISTINCT unnest({PL('o_custkey')}) AS b FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'))"
_q("bloom_info", lambda k, d: sk.bloom_info(_bf(k, d), CAP, ERR), f"WITH {SET} SELECT {CAP}::BIGINT AS capacity, {BITS}::BIGINT AS bits, {K}::BIGINT AS hashes, count(*) AS set_bits, CAST(round(-{BITS} / {K}::DOUBLE * ln(1 - count(*) / {BITS}::DOUBLE)) AS BIGINT) AS card FROM s")
_q("bloom_dump", lambda k, d: sk.bloom_exists(sk.bloom_load(sk.bloom_dump(_bf(k, d), 16)), load(k, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", CAP, ERR),
   f"WITH {SET}, p AS (SELECT c_custkey, unnest({PL('c_custkey')}) AS b FROM customer) SELECT c_custkey AS o_custkey, bool_and(b IN (SELECT b FROM s)) AS maybe FROM p GROUP BY 1")
_q("bag_addnx", lambda k, d: sk.bag(sk.bag_add_new(_li(k, d).where("l_suppkey <= 40").select("l_suppkey"), load(k, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))), "l_suppkey"),
   "SELECT l_suppkey, count(*) AS n FROM (SELECT l_suppkey FROM lineitem WHERE l_suppkey <= 40 UNION ALL SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_suppkey <= 40)) GROUP BY 1")
_q("bag_exists", lambda k, d: sk.bag_exists(_li(k, d).where("l_suppkey <= 40"), load(k, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey"), "SELECT s_suppkey AS l_suppkey, s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_suppkey <= 40) AS there FROM supplier")
_q("bag_info", lambda k, d: sk.bag(_li(k, d), "l_suppkey").agg(F.sum("n").alias("items"), F.count("*").alias("kinds")), "SELECT count(*) AS items, count(DISTINCT l_suppkey) AS kinds FROM lineitem")
_q("topk_info", lambda k, d: sk.top(_li(k, d), "l_partkey", 20).agg(F.lit(20).cast("long").alias("k"), F.count("*").alias("held"), F.min("n").alias("least")), "SELECT 20::BIGINT AS k, count(*) AS held, min(n) AS least FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 20)")
_j("json_del_path", lambda: F.concat_ws(" ", js.get(js.delete_path("doc", F.lit("$.nest.deep.price")), "$.nest.deep"), js.get(js.delete_path("doc", F.lit("$.nums[1]")), "$.nums")), "'{\"large\":' || (p_size > 25)::VARCHAR || '} [' || p_size || ',' || p_size + 1 || ']'")
_j("json_debug_memory", lambda: F.octet_length(js.get(D(), "$.name")).cast("long"), "strlen(p_name)")
