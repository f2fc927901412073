"""The training-data operators against brute force, on planted cases, and on nulls, empty and very long texts."""

import hashlib
import math
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.llm import graph_ann, language_id, mixing, overlap, packing, quality_rules, simhash, suffix_dedup, suffix_tree_lm, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, word string, rid long"
VOCAB = public_tokenizers.path("word_bpe_49k.json")
#: Texts that every operator must take: null, empty, blank, one word, odd characters, and a very long one.
ODD = [None, "", " \t\n ", "word", "é" * 40, "<|endoftext|> İstanbul ΣΑΣ ½", "\x1c\x00x", "long word " * 30000, "a" * 5000]


def table(spark, texts, langs=None):
    """Extra columns bear names that the operators use inside."""
    rows = [(i, t, (langs or {}).get(i, "en"), f"src{i % 3}", len(t) if t else None, "x", "y", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, words=None):
    words = words or [f"{a}{b}" for a in "ba ke lo mi nu ra se ti".split() for b in "n r s t l m".split()]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    base = [prose(rng, rng.randrange(5, 200)) for _ in range(40)]
    near = [base[0] + " extra", base[0], base[1], base[1]]
    passage = prose(rng, 60)
    return base + near + [prose(rng, 20) + " " + passage + " " + prose(rng, 9) for _ in range(4)] + ODD


def empty(df):
    return df.limit(0)


# 1
def _doubled(texts, length):
    data = [(t or "").encode() for t in texts]
    n = Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    marks = [bytearray(len(t)) for t in data]
    for t, m in zip(data, marks, strict=True):
        for i in range(len(t) - length + 1):
            if n[t[i : i + length]] > 1:
                m[i : i + length] = b"\1" * length
    return data, marks


@pytest.mark.parametrize(("length", "gram"), [(200, 32), (24, 8)])
def test_suffix_dedup(spark, texts, length, gram):
    data, marks = _doubled(texts, length)
    got = {r.doc_id: r for r in suffix_dedup.removed(table(spark, texts), length, gram).collect()}
    assert len(got) == len(texts)
    for i, (t, m) in enumerate(zip(data, marks, strict=True)):
        kept = bytes(c for c, x in zip(t, m, strict=True) if not x)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(t), sum(m), len(re.findall(b"\1+", bytes(m))), hashlib.sha256(kept).hexdigest()), i


def test_suffix_dedup_edges(spark, texts):
    docs = table(spark, texts)
    assert suffix_dedup.removed(empty(docs)).count() == 0
    twice = docs.where("doc_id = 5").unionByName(docs.where("doc_id = 5")).unionByName(docs.where("doc_id = 6"))
    rows = suffix_dedup.removed(twice).collect()
    assert len(rows) == 3 and all(r.n_removed == (r.n_bytes if r.doc_id == 5 and r.n_bytes >= 200 else 0) for r in rows)
    out = suffix_dedup.without_repeats(docs, 24, 8)
    assert out.columns == docs.columns and out.count() == docs.count() and out.where("doc_id = 48").first().text is None


def test_merge_of_runs():
    rng = random.Random(3)
    for _ in range(60):
        runs = [{} for _ in range(rng.randrange(1, 6))]
        for i in range(rng.randrange(1, 40)):
            s = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))).encode()
            rng.choice(runs).setdefault((s, b""), []).append((i, 0))
        out = list(suffix_dedup.merged([suffix_dedup.front_coded(r) for r in runs]))
        assert [e[1] for e in out] == sorted(s for r in runs for s, _ in r)
        assert [e[0] for e in out[1:]] == [suffix_dedup.shared(a[1], b[1]) for a, b in zip(out, out[1:], strict=False)]


# 2
def test_toxicity(spark):
    rng = random.Random(5)
    bad = ["grobian", "lump", "schuft"]
    rows, labels = [], []
    for i in range(400):
        ws = prose(rng, rng.randrange(20, 80)).split()
        if i % 4 == 0:
            for _ in range(rng.randrange(2, 9)):
                ws.insert(rng.randrange(len(ws)), rng.choice(bad).capitalize() + rng.choice(["", ",", "."]))
        rows.append(" ".join(ws))
        labels.append((i, 1, int(i % 4 == 0)))
    docs = table(spark, rows + ODD)
    lab = spark.createDataFrame(labels[:300] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, lab)
    assert model.thetas == sorted(model.thetas)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows) + len(ODD)
    assert sum(got[i].toxic != (i % 4 == 0) for i in range(400)) <= 4
    assert not any(got[400 + k].toxic for k in range(len(ODD)))
    heavy = [got[i].severity for i in range(0, 400, 4) if len(re.findall("|".join(bad), rows[i].lower())) >= 7]
    light = [got[i].severity for i in range(0, 400, 4) if len(re.findall("|".join(bad), rows[i].lower())) <= 2]
    assert np.mean(heavy) > np.mean(light) + 0.5
    assert toxicity.train(docs, lab.where("toxic = 0")) is None and toxicity.score(docs, None).where("toxic").count() == 0
    assert toxicity.score(empty(docs), model).count() == 0 and toxicity.reject(docs, model).columns == docs.columns


def test_ordinal_loss_and_gradient():
    """The loss by hand, the gradient by differences, and a fit that ends where the gradient does."""
    rng = np.random.RandomState(4)
    rows = [{int(k): int(rng.randint(1, 4)) for k in rng.choice(6, rng.randint(0, 5), replace=False)} for _ in range(50)]
    grades, p = rng.randint(0, 4, 50), rng.randn(9) * 0.5
    theta = toxicity.thresholds(p, 6)
    want = 0.0
    for r, g in zip(rows, grades, strict=True):
        x = sum(p[k] * math.log1p(v) for k, v in r.items())
        above = [1.0, *[1 / (1 + math.exp(t - x)) for t in theta], 0.0]
        want -= math.log(above[g] - above[g + 1]) / 50
    got, gradient = toxicity.loss(p, toxicity.sparse(rows), grades, 6, 1e-2)
    assert abs(got - want - 0.005 * (p[:6] @ p[:6])) < 1e-9 and list(theta) == sorted(theta)
    for i in range(9):
        step = np.eye(9)[i] * 1e-6
        slope = (toxicity.loss(p + step, toxicity.sparse(rows), grades, 6, 1e-2)[0] - toxicity.loss(p - step, toxicity.sparse(rows), grades, 6, 1e-2)[0]) / 2e-6
        assert abs(slope - gradient[i]) < 1e-6
    w, cuts = toxicity.fit_ordinal(rows, grades, 6, steps=2000, l2=1e-2)
    end = np.concatenate([w, cuts[:1], np.log(np.diff(cuts))])
    assert np.abs(toxicity.loss(end, toxicity.sparse(rows), grades, 6, 1e-2)[1]).max() < 1e-3


def test_toxicity_of_repeats(spark):
    """Rows that repeat an id and texts with two labels; a null id; clashing columns."""
    rng = random.Random(6)
    rows = [(i % 90 if i % 90 else None, prose(rng, 30) + (" grobian lump" if i % 3 == 0 else ""), "x", i) for i in range(180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, severity string, toxic long")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)] + [(3, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 180 and sum(r.toxic for r in got) >= 55
    assert toxicity.reject(docs, model).count() == sum(not r.toxic for r in got)


# 3
def test_fill_is_the_best_subset():
    rng = random.Random(6)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        cap = rng.randrange(5, 60)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * j for s in sums for j in range(n + 1) if s + k * j <= cap}
        taken = packing.fill(counts, cap)
        assert all(n <= counts[k] for k, n in taken.items()) and sum(k * n for k, n in taken.items()) == max(sums)


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(VOCAB)
    ids = [[*tok.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    rows = packing.pack(table(spark, texts).repartition(2), VOCAB, 256).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(array("I", part).tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for i, x in enumerate(ids):
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(x)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256 and at & (at - 1) == 0
    assert packing.pack(empty(table(spark, texts)), VOCAB).count() == 0


def test_tokens_of_pieces(monkeypatch):
    """Ids are those of the whole chain, however small the cache is."""
    rng = random.Random(8)
    signs = ["", ",", ".", "...", "!?", "'s", "'", "<|", "<|endoftext|>", "\u00e9", "\u00dc", "\u0130", "\u017f", "7", "12x", "\u4e2d", "e\u0301", "\xa0", "\x00", "y" * 70, "-z" * 40]
    texts = [" ".join("".join(rng.choice(["foo", "Bar", "BAZ", *signs]) for _ in range(rng.randrange(1, 5))) for _ in range(40)) for _ in range(60)]
    tok = packing.WordTokenizer(VOCAB)
    for limit in (packing.Cache.LIMIT, 2_000, 0):
        monkeypatch.setattr(packing.Cache, "LIMIT", limit)
        assert [list(array("I", tok(t.encode()))) for t in texts] == [tok.tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert not tok.cache.long


def test_words_are_held_once():
    """The room of the caches is not spent on words that are pieces of their own and parts of others."""
    tok, asked = packing.WordTokenizer(VOCAB), Counter()
    ask = tok.tokenize
    tok.tokenize = lambda s: asked.update([s]) or ask(s)
    letters = "abcdefghijklmnopqrst"
    words = ["".join(letters[i // 20**k % 20] for k in range(5)) for i in range(130_000)]
    for _ in range(2):
        for i in range(0, len(words), 1000):
            tok(" ".join(words[i : i + 1000]).encode())
    assert set(words) == set(asked) and max(asked.values()) == 1


# 4
def _fingerprint(text):
    ws = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    sh = [" ".join(ws[i : i + 4]) for i in range(len(ws) - 3)] if len(ws) >= 4 else [" ".join(ws)] if ws else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _classes(fps, ids, radius):
    label = list(ids)
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_simhash(spark, texts):
    short = texts[:-2] + ["Some Words here again and again", "some words here again and again"]
    fps = [_fingerprint(t) for t in short]
    got = {r.doc_id: r for r in simhash.simhash_groups(table(spark, short)).collect()}
    assert [got[i].fp & (2**64 - 1) for i in range(len(short))] == fps
    assert [got[i].component_id for i in range(len(short))] == _classes(fps, range(len(short)), 4)
    assert simhash.simhash_groups(empty(table(spark, short))).count() == 0


def near_classes(texts):
    """Of each text the first one of its component, by all pairs with a Jaccard similarity of 0.8 of five-word shingles."""

    def cut(t):
        ws = (t or "").lower().split()
        return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}

    sets, low, before = [cut(t) for t in texts], list(range(len(texts))), None
    pairs = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 5 * len(a & b) >= 4 * len(a | b)]
    while low != before:
        before = list(low)
        for i, j in pairs:
            low[i] = low[j] = min(low[i], low[j])
    return low


def test_near_copies(spark, texts):
    """Texts with words replaced at random places, one large group among them, shared passages, odd texts; rows that
    repeat an id, with the same text and with another; clashing extra columns."""
    rng = random.Random(8)
    rows = list(texts)
    for t in [prose(rng, n, [f"w{i}" for i in range(5000)]) for n in (100, 200, 400, 60, 100)]:
        for k in (0, 1, 2, 3, 4, 6, 8, 12, *[1] * 8):
            ws = t.split()
            for at in rng.sample(range(len(ws)), k):
                ws[at] = f"new{rng.randrange(10**9)}"
            rows.append(" ".join(ws))
    passage = prose(rng, 60)
    rows += [passage + " " + prose(rng, n) for n in (3, 9, 12, 20, 200)] + ["one two", "One  two", "one two three four five six"]
    rng.shuffle(rows)
    low = near_classes(rows)
    assert len(set(low)) < len(rows) - 60
    docs = table(spark, rows).withColumn("node", F.lit(1)).withColumn("words", F.lit("w"))
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(low))
    assert simhash.dedup(empty(docs)).count() == 0
    base = [r.asDict() for r in docs.where("doc_id < 2").collect()]
    lone = {**base[0], "text": prose(rng, 50, ["unlike", "any", "other", "of", "them"])}
    twice = spark.createDataFrame([base[0], base[0], lone, base[1], {**base[0], "doc_id": None}, {**base[0], "doc_id": None}], docs.schema)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in simhash.dedup(twice).collect())
    want = {(False, r["doc_id"], r["text"] or "") for r in (base[0], lone, base[1])}
    assert got == sorted(want) + [(True, 0, base[0]["text"] or "")] * 2


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_buckets_of_shared_shingles(seed):
    """Held texts and passing ones, some linked already: the links join exactly what all pairs join."""
    rng = random.Random(seed)
    sets, roots = [], []
    for g in range(6):
        base = [rng.getrandbits(60) for _ in range(40)]
        for _ in range(rng.randrange(1, 8)):
            s = set(base)
            for _ in range(rng.randrange(6)):
                s.remove(rng.choice(sorted(s)))
                s.add(rng.getrandbits(60))
            sets.append(np.array(sorted(s), np.uint64))
            roots.append(len(sets) - 1)
    for i in range(1, len(sets)):  # what is known
        if rng.random() < 0.3 and overlap.close(sets[i], sets[i - 1], (4, 5)):
            roots[i] = roots[i - 1]
    main = Counter(roots).most_common(1)[0][0]
    bucket = overlap.Bucket((4, 5), True)
    for big in (False, True):
        for i, s in enumerate(sets):
            if (roots[i] == main) == big:
                bucket.meet(i, s) if big else bucket.hold(i, roots[i], s)
    links = bucket.end()
    assert all(overlap.close(sets[a], sets[b], (4, 5)) for a, b in links)

    def classes(pairs):
        low = list(range(len(sets)))
        for _ in sets:
            for a, b in pairs:
                low[a] = low[b] = min(low[a], low[b])
        return low

    known = [(i, r) for i, r in enumerate(roots)]
    every = [(i, j) for i in range(len(sets)) for j in range(i) if overlap.close(sets[i], sets[j], (4, 5))]
    assert classes(links + known) == classes(every + known)


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_links_lose_nothing(spark, seed):
    rng = random.Random(seed)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(200):  # chains of small steps, and stars
        fps.append(rng.choice(fps) ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(1, 8))}))
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(simhash._signed(x), i) for i, x in enumerate(fps)], "fp long, id long")
    label = {r.a: r.b for r in simhash.components(simhash.links(nodes)).collect()}
    assert [label.get(i, i) for i in range(len(fps))] == _classes(fps, range(len(fps)), 4)
    bucket = simhash.spanning(fps, list(range(len(fps))), 4)
    assert len(bucket) == len(fps) - len(set(label.get(i, i) for i in range(len(fps))))  # spanning, no more


def test_block_choices_cover_the_radius():
    for n in (10, 10**6, 10**8, 10**12):
        masks = simhash._keys(n, 4)
        rng = random.Random(n)
        for _ in range(300):
            flips = sum({1 << rng.randrange(64) for _ in range(4)})
            assert any(not m & flips for m in masks)


# 5
def test_graph_search(spark):
    rng = np.random.RandomState(2)
    x = rng.randn(600, 16).astype(np.float32)
    x[100:140] = x[100] + 0.01 * rng.randn(40, 16)
    x[200:240] = x[200]  # equal ones
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (603, [1.0] * 3), (None, [1.0] * 16), (620, [None] * 16), rows[5]]
    df = spark.createDataFrame(rows + odd, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]))
    got = defaultdict(list)
    for r in graph_ann.neighbours(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 600, 20))
    y, hit = x.astype(np.float64), 0
    for q, near in got.items():
        s = y @ y[q]
        want = sorted((i for i in range(600) if i != q), key=lambda i: (-s[i], i))[:20]
        hit += len(set(want) & {v for _, v, _ in near})
        assert [n for n, _, _ in near] == list(range(1, 21)) and all(abs(s[v] - z) < 1e-9 for _, v, z in near)
        assert [(-z, v) for _, v, z in near] == sorted((-z, v) for _, v, z in near)
    assert hit / (20 * len(got)) >= 0.95
    assert graph_ann.neighbours(empty(df), F.col("vec_id") % 20 == 0).count() == 0
    assert graph_ann.neighbours(df.where("vec_id < 3"), F.col("vec_id") == 0).count() == 2


def test_graph_search_of_many_shards(spark, monkeypatch):
    """The tasks that search do not grow with shards times blocks, and no shard or block is left out."""
    monkeypatch.setattr(graph_ann, "SHARD", 40)
    monkeypatch.setattr(graph_ann, "BLOCK", 4)
    monkeypatch.setattr(graph_ann, "TASKS", 6)
    x = np.random.RandomState(5).randn(1200, 8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = graph_ann.neighbours(df, F.col("vec_id") % 20 == 0)
    dealt = re.findall(r"(?:Partitioning|partitioning|passthrough)\(.*?, (\d+)\)", found._jdf.queryExecution().executedPlan().toString())
    assert dealt and max(map(int, dealt)) <= max(6, int(spark.conf.get("spark.sql.shuffle.partitions")))  # not 30 shards by 15 blocks
    got = defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert sorted(got) == list(range(0, 1200, 20)) and all(len(v) == len(set(v)) == 20 for v in got.values())
    hit = 0
    for q, near in got.items():
        s = x @ x[q]
        hit += len(set(sorted((i for i in range(1200) if i != q), key=lambda i: (-s[i], i))[:20]) & set(near))
    assert hit / (20 * len(got)) >= 0.95


# 6
def test_language_id(spark):
    rng = random.Random(8)
    kinds = {"en": "the of and ing tion er ly th wh", "de": "der und ung keit sch ein ich tz pf", "fr": "eau que les oux ai ou ez le du", "es": "ción los ado que ar ez el una ñ"}
    rows, langs = [], {}
    for i in range(320):
        lang = list(kinds)[i % 4]
        rows.append(" ".join("".join(rng.choice(kinds[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(60)))
        langs[i] = lang if i % 5 else None
    docs = table(spark, rows + ODD, langs)
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1, F.lit(False))
    model = language_id.train(docs.where("doc_id < 320"), learn)
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"]} and model.table.shape[1] == 4
    got = {r.doc_id: r for r in language_id.identify(docs, model, ("h",)).collect()}
    held = [i for i in range(320) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i].lang_pred == list(kinds)[i % 4] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[320 + k].lang_pred for k in (0, 1, 2, 6)] == ["und", "und", "und", got[326].lang_pred] and got[320].score == 0
    assert language_id.train(empty(docs), learn) is None and {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}


def _plain_margin(m, text, k):
    at, n = language_id.counts(text)
    return m.table[at, k].astype(np.float64) @ n / n.sum() * language_id.SCALE + m.bias[k]


def test_margins_do_not_cross_texts(monkeypatch):
    rng = np.random.RandomState(1)
    table = np.vstack([rng.randn(1 << language_id.BITS, 4), np.zeros((1, 4))]).astype(np.float32)
    m = language_id.Model({"f": ["a", "b"], "g": ["c", "d"]}, [("a", "b"), ("c", "d")], table, rng.randn(4))
    texts = [b"abc def", b"", b"x", "ñandú".encode() * 50, bytes(rng.randint(97, 123, 9000).tolist())]
    monkeypatch.setattr(language_id, "PART", 4 * 4 * 1500)  # long texts are read in parts
    assert np.allclose(m.margins(texts), [[_plain_margin(m, t, k) for k in range(4)] for t in texts], atol=1e-4)
    for t, (lang, score) in zip(texts, m.predict(texts), strict=True):
        f, g, ab, cd = (_plain_margin(m, t, k) for k in range(4))
        assert lang == (("a" if ab > 0 else "b") if f > g else ("c" if cd > 0 else "d")) and 0 <= score <= 1


def test_votes_and_ties():
    m = language_id.Model({"f": ["a", "b", "c"]}, [("a", "b"), ("a", "c"), ("b", "c")], np.zeros((2, 3), np.float32), np.zeros(3))
    margins = np.array([[1.0, 1, 1], [-1, 1, 1], [1, -1, 2], [1, -2, 1], [0, 0, 0]])
    best, least = m.choose(["a", "b", "c"], margins)
    assert best.tolist() == [0, 1, 1, 2, 0] and least[0] == 1 and least[4] == 0  # one vote each: the larger margins


def test_svm_is_optimal():
    """The dual conditions of the hinge loss hold at the end."""
    rng = np.random.RandomState(2)
    rows = [(np.sort(rng.choice(40, 6, replace=False)), rng.rand(6)) for _ in range(60)]
    y = np.where(np.array([v[k < 20].sum() - v[k >= 20].sum() for k, v in rows]) + rng.randn(60) * 0.5 > 0, 1.0, -1.0)
    w = language_id.fit_svm(rows, y, c=1.0, epochs=3000)
    slack = [max(0.0, 1 - s * (w[k] @ v + w[-1])) for (k, v), s in zip(rows, y, strict=True)]
    primal = 0.5 * (w @ w) + sum(slack)
    for _ in range(200):
        near = w + rng.randn(len(w)) * rng.choice([1e-3, 1e-2, 0.1]) * (np.arange(len(w)) < 40)
        assert primal <= 0.5 * (near @ near) + sum(max(0.0, 1 - s * (near[k] @ v + near[-1])) for (k, v), s in zip(rows, y, strict=True)) + 1e-6


def test_many_languages(spark, monkeypatch):
    """More languages than the sample holds at the usual quota: none is left out, and machines grow with their number."""
    monkeypatch.setattr(language_id, "SAMPLE", 40)
    rng = random.Random(9)
    langs = [f"x{k}" for k in range(14)] + ["en", "de"]
    marks = {x: [rng.choice("abcdefgh") + rng.choice("ijklmnop") + rng.choice("qrstuvw") for _ in range(4)] for x in langs}
    rows = [" ".join(rng.choice(marks[langs[i % 16]]) for _ in range(40)) for i in range(1600)]
    docs = table(spark, rows, {i: langs[i % 16] for i in range(1600)}).repartition(5)
    model = language_id.train(docs, F.lit(True))
    assert sorted(x for f in model.families.values() for x in f) == sorted(langs) and model.table.shape[1] == 3 + 28 + 15 + 1
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect()}
    assert np.mean([got[i] == langs[i % 16] for i in got]) > 0.95
    again = language_id.train(docs.repartition(3), F.lit(True))
    assert (again.table == model.table).all()
    twice = docs.where("doc_id < 3").unionByName(docs.where("doc_id < 3")).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    assert language_id.identify(twice, model).count() == 6


# 7
def _plain_tree(texts, learn, depth, divergence):
    """log10 probabilities of texts by a plain suffix tree; all known words are symbols, as in small tables."""
    toks = [(t or "").lower().split() + [None] for t in texts]
    c = Counter(w for t, ok in zip(toks, learn, strict=True) if ok for w in t)
    total, size = sum(c.values()), len(c) + 1  # and the class of unknown words
    root = lambda w: ((c[w] if w in c else 0) + 0.5) / (total + 0.5 * size)
    symbol = lambda w: w if w in c else "?"

    def back(t, i):
        own = [symbol(w) for w in t[:i]][::-1][:depth]
        return tuple(own + [None]) if len(own) < depth else tuple(own)

    seen = defaultdict(Counter)
    for t, ok in zip(toks, learn, strict=True):
        for i, w in enumerate(t) if ok else ():
            for d in range(1, len(back(t, i)) + 1):
                seen[back(t, i)[:d]][w] += 1
    least, states = max(8, suffix_tree_lm.LEAST * total), {}

    def p(ctx, w):
        if not ctx:
            return root(w)
        return state(ctx)[0].get(w, 0) + state(ctx)[1] * p(ctx[:-1], w)

    def state(ctx):
        if ctx not in states:
            f = seen.get(ctx, {})
            n, kinds = sum(f.values()), len(f)
            kept = {w: k for w, k in f.items() if n < least or k >= 2}
            share, weight = {w: k / (n + kinds) for w, k in kept.items()}, (n - sum(kept.values()) + kinds) / max(1, n + kinds)
            below = {w: p(ctx[:-1], w) for w in kept}
            gain = sum(k * math.log((share[w] + weight * below[w]) / below[w]) for w, k in kept.items())
            states[ctx] = (share, weight) if n >= 2 and gain >= divergence else ({}, 1.0)
        return states[ctx]

    return [sum(math.log10(p(back(t, i), symbol(w)) * (1 if w is None or w in c else 0.5)) for i, w in enumerate(t)) for t in toks]


@pytest.mark.parametrize("parts", [1, 7])
def test_suffix_tree_lm(spark, texts, parts):
    """Counts and base against plain ones, score against a plain suffix tree; phrases that are rare and frequent ones."""
    rng = random.Random(4)
    phrases = [prose(rng, 7, [f"p{k}" for k in range(60)]) for _ in range(30)]
    rows = [t for t in texts if len(t or "") < 100_000] + [" ".join(rng.choice(phrases[:10] + phrases * (i % 3)) for _ in range(rng.randrange(1, 9))) for i in range(60)]
    rows += ["once twice thrice", rows[3], rows[3]]
    learn = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(rows))]
    docs = table(spark, rows).withColumn("learn", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2).withColumn("held_out", ~F.col("learn")).repartition(parts)
    got = {r.doc_id: r for r in suffix_tree_lm.score(docs, 20).collect()}
    toks = [[*(t or "").encode().lower().split(), None] for t in rows]
    c = Counter(w for i, t in enumerate(toks) if learn[i] for w in t)
    n, v = sum(c.values()), len(c)
    want = _plain_tree([(t or "").encode().decode("latin-1") for t in rows], learn, suffix_tree_lm.DEPTH, suffix_tree_lm.DIVERGENCE)
    assert len(got) == len(rows)
    for i, t in enumerate(toks):
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not learn[i], len(t), sum(c[w] > 0 for w in t), n) and abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        if (rows[i] or "").isascii():
            assert abs(r.score - want[i]) < 1e-6 * max(1, abs(want[i])), i
    held = [i for i in range(len(rows)) if not learn[i]]
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)


def test_followers_of_frequent_contexts(spark):
    """Followers that are a tiny share of all symbols are not left out."""
    s = np.tile(np.array([2, 3]), 1_500_000)
    s[[20_001, 90_001]] = 4  # after 2, twice of 1.5 million times
    s[-1] = suffix_tree_lm.END
    rows = [(0, [len(s)], [True], bytearray(suffix_tree_lm.pack(s)))]
    texts = spark.createDataFrame(rows, "rid long, size array<int>, learn array<boolean>, symbols binary")
    root = (np.bincount(s, minlength=5) + 0.5) / (len(s) + 2.5)
    tree = suffix_tree_lm.learn_tree(texts, root, len(s))
    none = suffix_tree_lm.NONE
    near = 2 << 3 * suffix_tree_lm.BITS | none << 2 * suffix_tree_lm.BITS | none << suffix_tree_lm.BITS | none
    got = tree.probability(np.array([near]), np.array([none]), np.array([4]))[0][0]
    # After 2 come 3, 4 and once the end, which was not seen often enough for a share of its own.
    assert math.isclose(got, (2 + (3 + 1) * root[4]) / (1_500_000 + 3), rel_tol=1e-9)


def test_contexts_that_are_not_held(spark, texts, monkeypatch):
    """Contexts whose followers have no room in the broadcast part are states like all others."""
    rng = random.Random(5)
    rows = [t for t in texts if len(t or "") < 100_000 and (t or "").isascii()] + [prose(rng, 60, [f"p{k}" for k in range(30)]) for _ in range(40)]
    learn = [i % 5 > 0 for i in range(len(rows))]
    docs = table(spark, rows).withColumn("learn", F.col("doc_id") % 5 > 0).withColumn("held_out", ~F.col("learn")).repartition(3)
    monkeypatch.setattr(suffix_tree_lm, "FOLLOWERS", 0)
    got = {r.doc_id: r.score for r in suffix_tree_lm.score(docs, 20).collect()}
    monkeypatch.setattr(suffix_tree_lm, "LEAST", 10.0)  # none is frequent
    want = _plain_tree(rows, learn, suffix_tree_lm.DEPTH, suffix_tree_lm.DIVERGENCE)
    assert all(abs(got[i] - w) < 1e-6 * max(1, abs(w)) for i, w in enumerate(want))
    monkeypatch.undo()
    monkeypatch.setattr(suffix_tree_lm, "FOLLOWERS", 40)  # some contexts are held
    some = {r.doc_id: r.score for r in suffix_tree_lm.score(docs, 20).collect()}
    assert len(some) == len(rows) and all(x < 0 and math.isfinite(x) for x in some.values())


def test_suffix_tree_edges(spark, texts):
    docs = table(spark, texts).withColumn("learn", F.lit(True)).withColumn("held_out", F.lit(False)).withColumn("size", F.lit(1))
    rows = suffix_tree_lm.score(docs).collect()
    assert len(rows) == len(texts) and all(r.score < 0 and math.isfinite(r.score) for r in rows)
    none = suffix_tree_lm.score(docs.withColumn("learn", F.lit(False)).where("doc_id < 3")).collect()
    assert len(none) == 3 and all(r.base_score == 0 and r.n_known == 0 for r in none)
    assert suffix_tree_lm.score(empty(docs)).count() == 0
    same = docs.where("doc_id < 4")
    twice = suffix_tree_lm.score(same.unionByName(same).unionByName(same.withColumn("doc_id", F.lit(None).cast("long")))).collect()
    by = defaultdict(set)
    for r in twice:
        by[r.n_tokens].add(round(r.score, 9))
    assert len(twice) == 12 and sum(r.doc_id is None for r in twice) == 4 and all(len(x) == 1 for x in by.values())


def test_places_of_a_context():
    """Packed contexts come apart again, and stand for the symbols before a place."""
    rng = np.random.RandomState(3)
    texts = [rng.randint(0, 9, n) for n in (1, 4, 30, 7)]
    s, first = np.concatenate(texts), np.concatenate([np.arange(len(t)) for t in texts])
    near, far = suffix_tree_lm.windows(s, first)
    at = 0
    for t in texts:
        for i in range(len(t)):
            want = [t[i - k] if k <= i else suffix_tree_lm.END if k == i + 1 else suffix_tree_lm.NONE for k in range(1, suffix_tree_lm.DEPTH + 1)]
            assert [int(suffix_tree_lm.last_of(near, far, k)[at]) for k in range(1, suffix_tree_lm.DEPTH + 1)] == want
            at += 1
    x = rng.randint(0, 1 << 15, 1000)
    assert (suffix_tree_lm.unpack(suffix_tree_lm.pack(x), 1000) == x).all()


# 8
def test_mixing(spark):
    rng = random.Random(10)
    rows = [(i, "word " * rng.randrange(1, 400), rng.choice(["en", "en", "de", None]), "hot" if rng.random() < 0.4 else f"s{rng.randrange(4)}") for i in range(2000)] + [(2000, None, "en", "hot"), (2001, "", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix(docs, targets={"source": {"hot": 0.2, "s0": 0.2, "s1": 0.2, "s2": 0.2, "s3": 0.2}}, budget=0.3, rounds=30).cache()
    assert out.count() == 2002
    share = out.groupBy("source").agg(F.sum(F.col("tokens") * F.col("probability")).alias("t")).collect()
    total = sum(r.t for r in share)
    tokens = out.agg(F.sum("tokens")).first()[0]
    assert abs(total / tokens - 0.3) < 1e-6 and all(abs(r.t / total - 0.2) < 0.01 for r in share if r.source != "unknown")
    assert out.where("doc_id >= 2000 AND sampled").count() == 0 and mixing.mix(empty(docs)).count() == 0
    want = mixing.mix(docs).select("doc_id", "sampled").collect()
    again = mixing.mix(docs.repartition(7)).select("doc_id", "sampled").collect()
    assert sorted(want) == sorted(again)


def test_mixing_of_many_cells(spark, monkeypatch):
    """The way for many cells against that for few; margins meet their targets; repeats, null ids, clashing columns."""
    rng = random.Random(11)
    rows = [(i % 900 if i % 100 else None, "word " * rng.randrange(0, 300), rng.choice(["en", "de", None]), f"s{min(rng.randrange(30), rng.randrange(30))}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("weight", F.lit(1)).withColumn("tokens", F.lit(-1))
    for more in ({}, {"budget": 0.9}, {"targets": {"lang": {"en": 0.5, "de": 0.3, "unknown": 0.2}}, "rounds": 40}):
        few = sorted((r.doc_id or -1, r.source, r.lang, r.topic, r.tokens, round(r.probability, 7), r.sampled) for r in mixing.mix(docs, **more).collect())
        monkeypatch.setattr(mixing, "ONE_PARTITION", 0)
        many = sorted((r.doc_id or -1, r.source, r.lang, r.topic, r.tokens, round(r.probability, 7), r.sampled) for r in mixing.mix(docs, **more).collect())
        monkeypatch.undo()
        assert few == many and len(few) == 1500
    cells = mixing.mix(docs).groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    raked = mixing.rake_large(cells, rounds=60).collect()
    total = sum(r.tokens for r in raked)
    for m in mixing.MARGINS:
        want, got = defaultdict(float), defaultdict(float)
        for r in raked:
            want[r[m]] += r.tokens
            got[r[m]] += r.weight
        norm = sum((t / total) ** mixing.TEMPER for t in want.values())
        assert all(abs(got[k] - (t / total) ** mixing.TEMPER / norm) < 1e-6 for k, t in want.items())
    monkeypatch.setattr(mixing, "ONE_PARTITION", -1)
    assert mixing.mix(empty(docs)).count() == 0


# 9
def test_url_rules(spark):
    urls = ["http://A.Example.NET/en/1", "http://example.net/de/1", "http://x.net", "https://foo.com/de/1", "https://www.example.com/de/9?x=/a", "http://b.org/fr/2#t", "http://notorg/fr/1", "http://forg.org?u=http://c.net/", None, "", "no scheme", "http://exampleXnet/en/", "ftp://net/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("path", F.lit("clash"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_filter.judge(pages, labels).collect()}
    assert [got[i].rule for i in range(len(urls))] == ["example.net/en/", "net/", None, None, "example.com/de/", "org/fr/", None, None, None, None, None, None, "net/"]
    assert [got[i].verdict for i in (0, 1, 4, 5, 12)] == ["allow", "block", "block", "allow", "block"]
    assert (got[0].host, got[0].path, got[4].path, got[7].host, got[8].host, got[10].path) == ("a.example.net", "/en/1", "/de/9", "forg.org", "", "")
    assert url_filter.judge(empty(pages), labels).count() == 0


def test_trees_learn_what_they_can(spark):
    rng = random.Random(11)
    rows = [(i, f"http://h{i % 7}.com/{'a/' * (1 + 3 * (i % 2))}{i}") for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0 or rng.random() < 0.02), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = url_filter.judge(pages, labels, rules=[]).collect()
    assert np.mean([(r.verdict == "block") == (r.page_id % 2 == 1) for r in got]) > 0.97


def test_compiled_trees_judge_like_the_model(spark):
    """The expression against the learner's own predictions, and accuracy on rows that were not learned from."""
    rng = random.Random(12)
    rows = [(float(rng.random() < 0.5), rng.random(), rng.random(), float(rng.randrange(5))) for _ in range(900)]
    rows = [(float((a > 0.4) == (c > 1)) if rng.random() < 0.95 else bad, a, b, c) for bad, a, b, c in rows]
    df = spark.createDataFrame(rows, "bad double, a double, b double, c double")
    cols = ["a", "b", "c"]
    model = url_filter.fit(df.limit(600), cols)
    score = url_filter.compile_trees(model.toDebugString, list(model.treeWeights), cols)
    got = model.transform(url_filter.vectors(df, cols)).withColumn("score", score).collect()
    assert all((r.prediction == 1) == (r.score > 0) and abs(2 * r.score - (r.rawPrediction[1] - r.rawPrediction[0])) < 1e-9 for r in got)
    assert np.mean([(r.score > 0) == (r.bad == 1) for r in got[600:]]) > 0.9


def test_url_repeats_and_suffixes(spark):
    """Suffix statistics of all labelled rows, sampled or not; rows that repeat, null ids, a very long URL, clashing columns."""
    rows = [(i, f"http://h{i}.{'bad' if i % 2 else 'good'}/{i}") for i in range(400)]
    more = [(None, rows[1][1]), (1, rows[1][1]), (900, "http://x.bad/" + "a/" * 100_000), (901, "http://x.good/zzz")]
    pages = spark.createDataFrame(rows + more, "page_id long, url string").withColumn("bad", F.lit(0.5)).withColumn("_suffix", F.lit("s")).withColumn("doc_id", F.lit(1))
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = url_filter.judge(pages, labels, rules=[], sample=60).collect()
    assert len(got) == 404 and all(r.verdict == ("block" if r.host.endswith(".bad") else "allow") for r in got)


# 10
def test_quality_rules(spark, texts, tmp_path):
    more = texts + ["a b c " * 30 + "\nx y\nx y\n \n\nx y", "the and of " + "# " * 60, "x" * 30 + " y" * 70]
    docs = table(spark, more)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    res = con.execute(quality_rules.SQL)
    names = [d[0] for d in res.description]
    want = sorted(tuple(r[names.index(c)] for c in sorted(names)) for r in res.fetchall())
    got = quality_rules.op10(spark, str(tmp_path))
    assert sorted(tuple(r[c] for c in sorted(names)) for r in got.collect()) == want
    for r in got.collect():
        ws = [w for w in re.split("[\x20\x09-\x0d]+", more[r.doc_id] or "") if w]
        n = Counter(zip(ws, ws[1:], ws[2:], strict=False))
        again = {i + k for i in range(len(ws) - 2) if n[tuple(ws[i : i + 3])] > 1 for k in range(3)}
        assert (r.n_words, r.n_repeat_words, r.word_chars) == (len(ws), len(again), sum(map(len, ws)))
    assert quality_rules.quality_rules(empty(docs)).count() == 0
