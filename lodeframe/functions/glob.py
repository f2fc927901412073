"""Glob patterns (* ? [abc] [^abc] [a-z] and backslash) compiled to Column predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column


def to_regex(pattern: str) -> str:
    """An anchored regular expression; an unclosed class runs to the pattern's end."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\" and i < len(pattern):
            out.append(re.escape(pattern[i]))
            i += 1
        elif c == "[":
            negated = i < len(pattern) and pattern[i] == "^"
            i += negated
            body = []
            while i < len(pattern) and pattern[i] != "]":
                if pattern[i] == "\\" and i + 1 < len(pattern):
                    i += 1
                    body.append(re.escape(pattern[i]))
                elif i + 2 < len(pattern) and pattern[i + 1] == "-" and pattern[i + 2] != "]":
                    a, b = sorted((pattern[i], pattern[i + 2]))
                    body.append(f"{re.escape(a)}-{re.escape(b)}")
                    i += 2
                else:
                    body.append(re.escape(pattern[i]))
                i += 1
            i += 1
            out.append(f"[{'^' * negated}{''.join(body)}]" if body else ("." if negated else "(?!)"))
        else:
            out.append(re.escape(c))
    return f"(?s)^{''.join(out)}$"


def matches(column: Column, pattern: str) -> Column:
    """Whether a string matches. Plain prefixes, which Parquet can push down, and plain words are told apart."""
    if not re.search(r"[*?\[\\]", pattern):
        return column == pattern
    if pattern.endswith("*") and not re.search(r"[*?\[\\]", pattern[:-1]):
        return column.startswith(pattern[:-1])
    return column.rlike(to_regex(pattern))
