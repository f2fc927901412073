"""String values: byte ranges, logs of changes, last-writer-wins updates. Rows are (key, value, more)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def byte_length(value: Column) -> Column:
    return F.octet_length(value).cast("long")


def get_range(value: Column, start: int, stop: int) -> Column:
    """Bytes start..stop, both included, negative ones counted from the end; as binary."""
    v = value.cast("binary")
    n = F.octet_length(v)
    a = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    b = F.least(F.lit(stop) if stop >= 0 else n + stop, n - 1)
    return F.when(a > b, F.lit(b"")).otherwise(F.substr(v, (a + 1).cast("int"), (b - a + 1).cast("int")))


def set_range(value: Column, offset: int, data: str) -> Column:
    """The bytes of data put over the value from an offset on, zero bytes between if it is shorter; as binary."""
    v, d = F.coalesce(value.cast("binary"), F.lit(b"")), data.encode()
    head = F.rpad(F.substring(v, 1, offset), offset, F.lit(b"\0"))
    return F.concat(head, F.lit(d), F.substr(v, F.lit(offset + len(d) + 1), F.lit(2**31 - 1))) if d else v


def append(log: DataFrame) -> DataFrame:
    """(key, seq, value) appended in order: the text and its byte length per key."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]), "")
    return log.groupBy("key").agg(text.alias("value")).withColumn("length", byte_length(F.col("value")))


def running(log: DataFrame, delta: str = "delta") -> DataFrame:
    """(key, seq, delta): the counter after each change. Integer overflow is an error under ANSI mode."""
    return log.withColumn("value", F.sum(delta).over(Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))


def counters(log: DataFrame, delta: str = "delta") -> DataFrame:
    """The final counter of each key."""
    return log.groupBy("key").agg(F.sum(delta).alias("value"))


def float_increment(value: Column, delta: Column) -> Column:
    """A sum that must be a finite number."""
    s = value + delta
    return F.when(F.isnan(s) | (F.abs(s) == float("inf")), F.raise_error(F.lit("increment would give NaN or Infinity"))).otherwise(s)


def previous(log: DataFrame) -> DataFrame:
    """(key, seq, value): each write with the value it replaced."""
    return log.withColumn("old", F.lag("value").over(Window.partitionBy("key").orderBy("seq")))


def last_write(log: DataFrame) -> DataFrame:
    """(key, seq, value, expire_at): the state after all writes, the last one winning whole."""
    last = F.max_by(F.struct("value", "expire_at"), F.col("seq"))
    return log.groupBy("key").agg(last.alias("_x")).select("key", "_x.value", "_x.expire_at")


def set_if_absent(table: DataFrame, more: DataFrame) -> DataFrame:
    """table with those rows of more whose key it lacks."""
    return table.unionByName(more.join(table.select("key"), "key", "left_anti"))


def set_all_if_none(table: DataFrame, more: DataFrame) -> DataFrame:
    """table with all rows of more, if it has none of their keys; else unchanged. The test is a one-row join."""
    clash = more.join(table.select("key"), "key", "left_semi").agg((F.count("*") > 0).alias("_clash"))
    gate = F.broadcast(clash)  # one row
    return table.unionByName(more.join(gate, ~F.col("_clash")).drop("_clash"))


#: Tests of a conditional write: what the old value (null where there is none) and the given one must be.
CONDITIONS = {
    "always": lambda old, given: F.lit(True),
    "nx": lambda old, given: old.isNull(),
    "xx": lambda old, given: old.isNotNull(),
    "ifeq": lambda old, given: old == given,
    "ifne": lambda old, given: old.isNull() | (old != given),
    "ifdeq": lambda old, given: digest(old) == given,
    "ifdne": lambda old, given: old.isNull() | (digest(old) != given),
}


def write(table: DataFrame, more: DataFrame, when: str = "always", keep_ttl: bool = False) -> DataFrame:
    """(key, value, expire_at, old) after the writes of more (key, value, expire_at, and `given` where the condition compares),
    one for a key. Keys whose condition fails stay as they were; a write replaces the expiry unless it is kept."""
    new = more.select("key", F.col("value").alias("_value"), F.col("expire_at").alias("_expire"), (F.col("given") if "given" in more.columns else F.lit(None).cast("string")).alias("_given"), F.lit(True).alias("_new"))
    both = table.select("key", F.col("value").alias("old"), F.col("expire_at").alias("_old_expire")).join(new, "key", "full")
    go = F.coalesce("_new", F.lit(False)) & F.coalesce(CONDITIONS[when](F.col("old"), F.col("_given")), F.lit(False))
    expire = F.when(go & F.lit(not keep_ttl), F.col("_expire")).otherwise(F.coalesce("_old_expire", F.when(go, F.col("_expire"))))
    return both.select("key", F.when(go, F.col("_value")).otherwise(F.col("old")).alias("value"), expire.alias("expire_at"), "old").where("value IS NOT NULL")


def write_all_if(table: DataFrame, more: DataFrame, when: str = "nx") -> DataFrame:
    """All writes of more (key, value, expire_at), if none of their keys is there ("nx") or all are ("xx"); else none."""
    there = more.join(table.select("key"), "key", "left_semi").agg(F.count("*").alias("_there"))
    gate = F.broadcast(there.crossJoin(more.agg(F.count("*").alias("_all"))).select(((F.col("_there") == 0) if when == "nx" else (F.col("_there") == F.col("_all"))).alias("_go")))  # one row
    return write(table, more.join(gate, F.col("_go")).drop("_go")).drop("old")


def get_and_delete(table: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(values of the keys, the table without them)."""
    return table.join(keys.select("key"), "key", "left_semi"), table.join(keys.select("key"), "key", "left_anti")


def get_and_expire(table: DataFrame, keys: DataFrame) -> DataFrame:
    """The table with new expiries of keys (key, expire_at), null to persist; keys that it lacks are left out."""
    named = keys.select("key", F.col("expire_at").alias("_new"), F.lit(True).alias("_named"))
    both = table.join(named, "key", "left")
    return both.select("key", "value", F.when(F.col("_named"), F.col("_new")).otherwise(F.col("expire_at")).alias("expire_at"), F.coalesce("_named", F.lit(False)).alias("read"))


def multi_get(table: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (pos, key) with their values, null where there is none."""
    return keys.join(table.select("key", "value"), "key", "left")


def compare_and_delete(table: DataFrame, where: Column) -> DataFrame:
    return table.where(~F.coalesce(where, F.lit(False)))


def digest(value: Column) -> Column:
    """A hexadecimal digest of the value's bytes (XXH64, seed 42)."""
    return F.lower(F.lpad(F.hex(F.xxhash64(value)), 16, "0"))


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each row, lengths of a longest common subsequence of x with each beginning of y, by one row of the dynamic
    program. Both are filled up with `_NONE` and `_NONE - 1`, which match nothing."""
    row = np.zeros((len(y), y.shape[1] + 1), np.int32)
    for c in x.T:
        row[:, 1:] = np.maximum.accumulate(np.where(y == c[:, None], row[:, :-1] + 1, row[:, 1:]), axis=1)
    return row


#: A code that no character has, and how many codes of a side are laid out at once.
_NONE, _CELLS = 0xFFFFFFFF, 1 << 18


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of all texts, where each starts, its length)."""
    n = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(n) - n, n


def _laid(codes: np.ndarray, start: np.ndarray, n: np.ndarray, fill: int, back: bool = False) -> np.ndarray:
    """Pieces of the codes as rows of a table, from their ends if `back`."""
    i = np.arange(n.max(initial=0))
    at = (start + n - 1)[:, None] - i if back else start[:, None] + i
    return np.where(i < n[:, None], codes[np.clip(at, 0, max(0, len(codes) - 1))], np.uint32(fill)) if len(codes) else np.zeros((len(n), 0), np.uint32)


def _alike(m: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Numbers of pairs in groups of like lengths, each of which `_CELLS` hold, or one pair."""
    key = np.ceil(np.log2(np.maximum(m, 1))) * 64 + np.ceil(np.log2(np.maximum(n, 1)))
    order, out = np.argsort(key, kind="stable"), []
    for group in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        size = max(1, _CELLS // max(1, int(m[group].max(initial=0)), int(n[group].max(initial=0))))
        out += [group[i : i + size] for i in range(0, len(group), size)]
    return out


def _matches(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, place in a, place in b) of a longest common subsequence of each pair, by halving a: memory grows with b
    alone. Halves of all pairs are worked on together, those of like lengths as one table."""
    (x, i, m), (y, j, n) = _codes(a), _codes(b)
    first, other = i, j
    todo, out = [(np.arange(len(a)), i, m, j, n)], []
    while todo:
        pair, i, m, j, n = (np.concatenate(z) for z in zip(*todo, strict=True))
        todo, some = [], (m > 0) & (n > 0)
        pair, i, m, j, n = (z[some] for z in (pair, i, m, j, n))
        one = m == 1
        for g in _alike(m[one], n[one]) if one.any() else ():
            g = np.flatnonzero(one)[g]
            same = _laid(y, j[g], n[g], _NONE - 1, back=True) == x[i[g]][:, None]
            g, same = g[same.any(1)], same[same.any(1)].argmax(1)
            out.append((pair[g], i[g], j[g] + n[g] - 1 - same))
        for g in _alike(m[~one], n[~one]) if not one.all() else ():
            g = np.flatnonzero(~one)[g]
            p, s, c, t, d = pair[g], i[g], m[g], j[g], n[g]
            half = c // 2
            left = _lengths(_laid(x, s, half, _NONE), _laid(y, t, d, _NONE - 1))
            right = _lengths(_laid(x, s + half, c - half, _NONE, back=True), _laid(y, t, d, _NONE - 1, back=True))
            k = np.arange(left.shape[1])
            both = left + np.take_along_axis(right, np.maximum(d[:, None] - k, 0), 1)
            cut = np.where(k <= d[:, None], both, -1).argmax(1)
            todo += [(p, s, half, t, cut), (p, s + half, c - half, t + cut, d - cut)]
    pair, i, j = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (zip(*out, strict=True) if out else ((), (), ())))
    order = np.lexsort((i, pair))
    pair = pair[order]
    return pair, i[order] - first[pair], j[order] - other[pair]


def _common(a: list[str], b: list[str]) -> list[str]:
    """A longest common subsequence of each pair."""
    (x, start, _), (pair, i, _) = _codes(a), _matches(a, b)
    text = x[start[pair] + i].tobytes().decode("utf-32-le", "surrogatepass")
    ends = np.searchsorted(pair, np.arange(len(a) + 1)).tolist()
    return [text[p:q] for p, q in zip(ends, ends[1:], strict=False)]


def _runs(a: list[str], b: list[str], least: int = 0) -> list[list[list[int]]]:
    """Runs of those of `least` at least as [a from, a to, b from, b to, length], the last first."""
    pair, i, j = _matches(a, b)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(pair) != 0) | (np.diff(i) != 1) | (np.diff(j) != 1)])) if len(pair) else np.zeros(0, np.int64)
    n = np.diff(np.append(new, len(pair)))
    new, n = new[n >= least], n[n >= least]
    out = [[] for _ in a]
    for p, *run in zip(*(z[::-1].tolist() for z in (pair[new], i[new], i[new] + n - 1, j[new], j[new] + n - 1, n)), strict=True):
        out[p].append(run)
    return out


def _lcs(a: str, b: str, least: int = 0) -> tuple[str, list[list[int]]]:
    """A longest common subsequence and its runs."""
    return _common([a], [b])[0], _runs([a], [b], least)[0]


def _each(f, a: pd.Series, b: pd.Series) -> list:
    """f(texts, texts) over the distinct pairs of two columns, null where one is."""
    pairs = list(zip(a, b, strict=True))
    known = list(dict.fromkeys(p for p in pairs if p[0] is not None and p[1] is not None))
    found = dict(zip(known, f([p for p, _ in known], [q for _, q in known]), strict=True)) if known else {}
    return [found.get(p) for p in pairs]


def _longest(a: list[str], b: list[str]) -> list[int]:
    (x, i, m), (y, j, n) = _codes(a), _codes(b)
    out = np.zeros(len(a), np.int64)
    for g in _alike(m, n):
        out[g] = _lengths(_laid(x, i[g], m[g], _NONE), _laid(y, j[g], n[g], _NONE - 1))[:, -1]
    return out.tolist()


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """The length of a longest common subsequence."""
    return pd.Series(_each(_longest, a, b), dtype="Int32")


@F.pandas_udf(T.StringType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    """A longest common subsequence of two strings."""
    return pd.Series(_each(_common, a, b), dtype=object)


def lcs_runs(a: Column | str, b: Column | str, least: int = 0) -> Column:
    """Where the runs of that subsequence lie that have `least` characters at least."""

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def runs(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_each(lambda p, q: _runs(p, q, least), a, b), dtype=object)

    return runs(a, b)
