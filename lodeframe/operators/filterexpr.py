"""A filter language over JSON attributes, compiled to a Column: or and not == != < <= > >= in + - * / % ** ( ) [ ] .field

Values are typed as they are compiled only where they are literals; attributes carry their JSON type in a pair of
columns (number, text). Numbers compare within 1e-9, and a string that reads as a number equals it; order is for
numbers alone; `in` looks a string up in a string or a value in an array. A missing attribute is null, which is
false. Rows without a JSON object of attributes never pass.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<field>\.[A-Za-z_][\w.]*)|(?P<op>\*\*|==|!=|<=|>=|&&|\|\||[-+*/%<>!()\[\],])|(?P<word>[A-Za-z_]\w*))""")
#: Binding strengths of the binary operators, the loosest first.
_LEVELS = [{"or": "or", "||": "or"}, {"and": "and", "&&": "and"}, {o: o for o in ("==", "!=", "<", "<=", ">", ">=", "in")}, {"+": "+", "-": "-"}, {"*": "*", "/": "/", "%": "%"}]


@dataclass
class Value:
    """num and text hold the value in either form, null where it has none; items is set for literal arrays."""

    num: Column
    text: Column
    truth: Column
    items: list | None = None
    json: Column | None = None


def _number(c: Column) -> Value:
    return Value(c, F.lit(None).cast("string"), F.coalesce(c != 0, F.lit(False)))


def _boolean(c: Column) -> Value:
    return Value(c.cast("double"), F.lit(None).cast("string"), F.coalesce(c, F.lit(False)))


def _string(c: Column) -> Value:
    return Value(c.try_cast("double"), c, F.coalesce(F.length(c) > 0, F.lit(False)))


class _Compiler:
    def __init__(self, text: str, attrs: Column):
        self.attrs, self.at, self.tokens, i = attrs, 0, [], 0
        text = text.rstrip()
        while i < len(text):
            m = _TOKEN.match(text, i)
            if not m:
                raise ValueError(f"filter: cannot read {text[i:]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            i = m.end()

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "word") else None

    def take(self, *wanted: str) -> str | None:
        if (t := self.peek()) in wanted:
            self.at += 1
            return t
        return None

    def need(self, t: str) -> None:
        if not self.take(t):
            raise ValueError(f"filter: {t} expected")

    def binary(self, level: int = 0) -> Value:
        if level == 2 and self.take("not", "!"):
            return _boolean(~self.binary(2).truth)
        if level == len(_LEVELS):
            return self.power()
        left = self.binary(level + 1)
        while (t := self.take(*_LEVELS[level])) is not None:
            left = self.apply(_LEVELS[level][t], left, self.binary(level + 1))
        return left

    def power(self) -> Value:
        base = self.unary()
        return _number(F.pow(base.num, self.power().num)) if self.take("**") else base

    def unary(self) -> Value:
        if self.take("-"):
            return _number(-self.unary().num)
        if self.take("!", "not"):
            return _boolean(~self.unary().truth)
        return self.primary()

    def primary(self) -> Value:
        if self.at >= len(self.tokens):
            raise ValueError("filter: it ends too early")
        kind, t = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return _number(F.lit(float(t)))
        if kind == "str":
            return _string(F.lit(re.sub(r"\\(.)", r"\1", t[1:-1])))
        if kind == "field":
            raw = F.get_json_object(self.attrs, "$" + t)
            flag = F.when(raw == "true", 1.0).when(raw == "false", 0.0)
            return Value(F.coalesce(raw.try_cast("double"), flag), raw, F.coalesce((raw != "false") & (raw != "") & (F.coalesce(raw.try_cast("double"), F.lit(1.0)) != 0), F.lit(False)), json=raw)
        if t == "(":
            inner = self.binary()
            self.need(")")
            return inner
        if t == "[":
            items = []
            while not self.take("]"):
                items.append(self.binary())
                self.take(",")
            return Value(F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(bool(items)), items)
        if t in ("true", "false"):
            return _boolean(F.lit(t == "true"))
        if t == "null":
            return Value(F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(False))
        raise ValueError(f"filter: {t!r} is out of place")

    def equal(self, a: Value, b: Value) -> Column:
        by_number = F.abs(a.num - b.num) < 1e-9
        return F.coalesce(by_number, a.text == b.text, F.lit(False))

    def apply(self, op: str, a: Value, b: Value) -> Value:
        if op == "or":
            return _boolean(a.truth | b.truth)
        if op == "and":
            return _boolean(a.truth & b.truth)
        if op == "==":
            return _boolean(self.equal(a, b))
        if op == "!=":
            return _boolean(~self.equal(a, b))
        if op == "in":
            if b.items is not None:
                out = F.lit(False)
                for x in b.items:
                    out = out | self.equal(a, x)
                return _boolean(out)
            items = F.from_json(b.json if b.json is not None else b.text, "array<string>")
            wanted = F.coalesce(a.text, F.format_string("%s", a.num))
            listed = F.exists(items, lambda x: (x == wanted) | (F.abs(x.try_cast("double") - a.num) < 1e-9))
            return _boolean(F.coalesce(F.when(F.startswith(b.text, F.lit("[")), listed).otherwise(F.contains(b.text, a.text)), F.lit(False)))
        if op in ("<", "<=", ">", ">="):
            x, y = a.num, b.num
            return _boolean(F.coalesce({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], F.lit(False)))
        if op in ("/", "%"):
            return _number(F.when(b.num != 0, a.num / b.num if op == "/" else a.num % b.num))
        return _number({"+": a.num + b.num, "-": a.num - b.num, "*": a.num * b.num}[op])


def compile_filter(text: str, attrs: str | Column = "attrs") -> Column:
    """The predicate that a filter's text stands for."""
    col = F.col(attrs) if isinstance(attrs, str) else attrs
    c = _Compiler(text, col)
    out = c.binary().truth
    if c.at != len(c.tokens):
        raise ValueError(f"filter: {c.tokens[c.at][1]!r} is left over")
    return out & F.coalesce(F.startswith(F.ltrim(col), F.lit("{")), F.lit(False))
