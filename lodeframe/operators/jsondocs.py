"""JSON documents as text columns. Reads compile a path to built-in functions; writes go through a map of variants
(top-level fields) without user functions. Deeper writes use one Arrow function.

Paths: $ or . for the root, .name, ['name'], [i], [-i] from the end, and * as a segment between dots.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SEGMENT = re.compile(r"\.?\*|\.?([^.\[\]*']+)|\[(-?\d+)\]|\['((?:[^'\\]|\\.)*)'\]")


def parse(path: str) -> list[str | int | None]:
    """Names, indexes, and None for a wildcard."""
    rest, out, i = path.removeprefix("$"), [], 0
    if rest in ("", "."):
        return []
    while i < len(rest):
        m = _SEGMENT.match(rest, i)
        if not m:
            raise ValueError(f"path: cannot read {rest[i:]!r}")
        out.append(m[1] if m[1] is not None else int(m[2]) if m[2] is not None else m[3] if m[3] is not None else None)
        i = m.end()
    return out


def get(doc: Column, path: str) -> Column:
    """The value as JSON text, strings bare; null where there is none. A wildcard gives an array."""
    plain, out = "$", doc
    for seg in parse(path):
        if isinstance(seg, int) and seg < 0:
            items = F.from_json(F.get_json_object(out, plain), "array<variant>")
            out, plain = F.to_json(F.try_element_at(items, F.lit(seg))), "$"
        else:
            plain += f"[{seg}]" if isinstance(seg, int) else "[*]" if seg is None else f"['{seg}']"
    return F.get_json_object(out, plain)


def items(doc: Column, path: str) -> Column:
    """An array at a path, as variants."""
    return F.from_json(get(doc, path), "array<variant>")


def type_of(doc: Column, path: str = "$") -> Column:
    """null, boolean, number, string, array or object; null (of SQL) where there is nothing."""
    v = F.try_variant_get(F.try_parse_json(doc), "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in parse(path)), "variant")
    t = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), None).when(t == "VOID", "null").when(t == "BOOLEAN", "boolean").when(t == "STRING", "string")
        .when(F.startswith(t, F.lit("ARRAY")), "array").when(F.startswith(t, F.lit("OBJECT")), "object").otherwise("number"))


def number(doc: Column, path: str) -> Column:
    return get(doc, path).try_cast("double")


def array_length(doc: Column, path: str) -> Column:
    return F.json_array_length(get(doc, path)).cast("long")


def array_index(doc: Column, path: str, value: str, start: int = 0, stop: int = 0) -> Column:
    """The first index of a value (as text) in [start, stop), stop 0 being the end; -1 if it is not there."""
    texts = F.from_json(get(doc, path), "array<string>")
    n = F.size(texts)
    a = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    b = n if stop == 0 else F.lit(stop) if stop > 0 else n + stop
    window = F.when(b > a, F.slice(texts, a + 1, b - a)).otherwise(F.array().cast("array<string>"))
    at = F.array_position(window, value)
    return F.when(at > 0, at - 1 + a).otherwise(F.lit(-1)).cast("long")


def object_keys(doc: Column, path: str = "$") -> Column:
    return F.json_object_keys(get(doc, path))


def string_length(doc: Column, path: str) -> Column:
    return F.octet_length(get(doc, path)).cast("long")


def _fields(doc: Column) -> Column:
    return F.from_json(doc, "map<string,variant>")


def set_field(doc: Column, name: str, value: Column, only: str = "") -> Column:
    """value (JSON text) put at a top-level field; only "nx" if it is missing, "xx" if it is there."""
    old = _fields(doc)
    rest = F.map_filter(old, lambda k, _: k != name)
    new = F.to_json(F.map_concat(rest, F.create_map(F.lit(name), F.parse_json(value))))
    there = F.map_contains_key(old, name)
    return F.when({"": F.lit(True), "nx": ~there, "xx": there}[only], new).otherwise(doc)


def delete_field(doc: Column, name: str) -> Column:
    return F.to_json(F.map_filter(_fields(doc), lambda k, _: k != name))


def merge(doc: Column, patch: Column) -> Column:
    """Fields of patch over those of doc; nulls delete, and nested objects are replaced whole."""
    new = _fields(patch)
    kept = F.map_filter(_fields(doc), lambda k, _: ~F.map_contains_key(new, k))
    return F.to_json(F.map_concat(kept, F.map_filter(new, lambda _, v: ~F.is_variant_null(v))))


def array_append(doc: Column, path: str, value: Column) -> Column:
    """The array at a path with a value (JSON text) at its end."""
    return F.to_json(F.concat(items(doc, path), F.array(F.parse_json(value))))


def array_insert(doc: Column, path: str, i: int, value: Column) -> Column:
    a = items(doc, path)
    at = F.lit(i) if i >= 0 else F.greatest(F.size(a) + i, F.lit(0))
    return F.to_json(F.concat(F.slice(a, F.lit(1), at), F.array(F.parse_json(value)), F.slice(a, at + 1, F.greatest(F.size(a) - at, F.lit(0)))))


def array_pop(doc: Column, path: str, i: int = -1) -> tuple[Column, Column]:
    """(the element taken, the array left); an index beyond an end takes the one there."""
    a = items(doc, path)
    n = F.size(a)
    at = F.least(F.greatest(F.lit(i) if i >= 0 else n + i, F.lit(0)), n - 1)
    left = F.concat(F.slice(a, F.lit(1), F.greatest(at, F.lit(0))), F.slice(a, at + 2, F.greatest(n - at - 1, F.lit(0))))
    return F.to_json(F.when(n > 0, F.try_element_at(a, F.greatest(at + 1, F.lit(1)).cast("int")))), F.to_json(F.when(n > 0, left).otherwise(a))


def array_trim(doc: Column, path: str, start: int, stop: int) -> Column:
    """Elements start..stop, both included."""
    a = items(doc, path)
    n = F.size(a)
    lo = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    hi = F.least(F.lit(stop) if stop >= 0 else n + stop, n - 1)
    return F.to_json(F.slice(a, lo + 1, F.greatest(hi - lo + 1, F.lit(0))))


def toggle(doc: Column, path: str) -> Column:
    v = get(doc, path)
    return F.when(v == "true", F.lit(False)).when(v == "false", F.lit(True))


def cleared(doc: Column, path: str) -> Column:
    """Containers emptied, numbers zeroed, others as they are; as JSON text."""
    kind = type_of(doc, path)
    return F.when(kind == "array", "[]").when(kind == "object", "{}").when(kind == "number", "0").otherwise(get(doc, path))


def _changed(d: str | None, p: str | None, change) -> str | None:
    """The document after change(container, place) at a path whose parent is there; else, or where the document or the
    path cannot be read, as it was."""
    if d is None or p is None:
        return d
    try:
        root, segments = json.loads(d), parse(p)
        at = root
        for s in segments[:-1]:
            at = at[s]
        last = segments[-1] if segments else None
        if isinstance(at, dict) and isinstance(last, str) or isinstance(at, list) and isinstance(last, int) and -len(at) <= last < len(at):
            change(at, last)
            return json.dumps(root, separators=(",", ":"), ensure_ascii=False)
    except (KeyError, IndexError, TypeError, ValueError):
        pass
    return d


@F.pandas_udf(T.StringType())
def set_path(doc: pd.Series, path: pd.Series, value: pd.Series) -> pd.Series:
    """value (JSON text) put at any path whose parent is there; else, or if one of them is not JSON, the document as it was."""

    def one(d: str | None, p: str | None, v: str | None) -> str | None:
        try:
            new = json.loads(v)
        except (TypeError, ValueError):
            return d
        if d is not None and p is not None and not parse(p):
            return v
        return _changed(d, p, lambda at, last: at.__setitem__(last, new))

    return pd.Series([one(*x) for x in zip(doc, path, value, strict=True)])


@F.pandas_udf(T.StringType())
def delete_path(doc: pd.Series, path: pd.Series) -> pd.Series:
    """The document without what is at any path: a field or an element; as it was if there is nothing."""
    return pd.Series([_changed(d, p, lambda at, last: at.__delitem__(last)) for d, p in zip(doc, path, strict=True)])
