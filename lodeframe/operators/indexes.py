"""Named search indexes over tables: their schemas, aliases, dictionaries and synonyms, kept with the session.

An index is a name for a table (a path or a view), the kinds of its columns and an optional filter; nothing is
copied. Searches and aggregations by name read the table as it is then.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.operators import search as ft

KINDS = ("text", "tag", "numeric", "geo", "vector")


@dataclass
class Index:
    table: str
    fields: dict[str, str]
    where: str | None = None
    synonyms: dict[str, list[str]] = field(default_factory=dict)


class Indexes:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.own: dict[str, Index] = {}
        self.aliases: dict[str, str] = {}
        self.dictionaries: dict[str, set[str]] = {}

    def _get(self, name: str) -> Index:
        name = self.aliases.get(name, name)
        if name not in self.own:
            raise KeyError(f"no index {name}")
        return self.own[name]

    def create(self, name: str, table: str, fields: dict[str, str], where: str | None = None) -> None:
        if name in self.own or name in self.aliases:
            raise ValueError(f"index {name} is there already")
        if bad := set(fields.values()) - set(KINDS):
            raise ValueError(f"unknown kinds {sorted(bad)}")
        self.own[name] = Index(table, dict(fields), where)

    def alter(self, name: str, column: str, kind: str) -> None:
        index = self._get(name)
        if column.lower() in {c.lower() for c in index.fields}:
            raise ValueError(f"field {column} is there already")
        index.fields[column] = kind

    def drop(self, name: str) -> None:
        del self.own[name]
        self.aliases = {a: n for a, n in self.aliases.items() if n != name}

    def alias(self, alias: str, name: str, update: bool = False) -> None:
        if not update and alias in self.aliases:
            raise ValueError(f"alias {alias} is there already")
        self._get(name)
        self.aliases[alias] = name

    def unalias(self, alias: str) -> None:
        del self.aliases[alias]

    def names(self) -> list[str]:
        return sorted(self.own)

    def rows(self, name: str) -> DataFrame:
        index = self._get(name)
        df = self.spark.read.parquet(index.table) if "/" in index.table else self.spark.table(index.table)
        return df.where(index.where) if index.where else df

    def info(self, name: str) -> DataFrame:
        """One row per field, with how many rows have it."""
        index = self._get(name)
        n = self.rows(name).agg(F.count("*").alias("_all"), *[F.count(c).alias(c) for c in index.fields])
        each = [F.struct(F.lit(c).alias("field"), F.lit(k).alias("kind"), F.col(c).alias("rows"), F.col("_all").alias("of")) for c, k in index.fields.items()]
        return n.select(F.explode(F.array(*each)).alias("x")).select("x.*")

    def search(self, name: str, query: str) -> DataFrame:
        index = self._get(name)
        kinds = {c: k for c, k in index.fields.items() if k != "vector"}
        return ft.search(self.rows(name), ft.expand(query, index.synonyms) if index.synonyms else query, kinds)

    def aggregate(self, name: str, query: str, by: list[str], reducers: list, **more) -> DataFrame:
        return ft.aggregate(self.search(name, query), by, reducers, **more)

    def explain(self, name: str, query: str) -> str:
        return self.search(name, query)._jdf.queryExecution().optimizedPlan().toString()

    def synonyms(self, name: str, group: str, *terms: str) -> None:
        known = self._get(name).synonyms.setdefault(group, [])
        known.extend(t.lower() for t in terms if t.lower() not in known)

    def add_words(self, dictionary: str, *words: str) -> int:
        own = self.dictionaries.setdefault(dictionary, set())
        before = len(own)
        own.update(words)
        return len(own) - before

    def delete_words(self, dictionary: str, *words: str) -> int:
        own = self.dictionaries.get(dictionary, set())
        gone = own & set(words)
        own -= gone
        return len(gone)

    def words(self, dictionary: str) -> list[str]:
        return sorted(self.dictionaries.get(dictionary, ()))

    def spellcheck(self, name: str, column: str, word: str, distance: int = 1, exclude: str | None = None) -> DataFrame:
        words = self.rows(name).select(F.explode(ft.tokens(F.col(column))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
        found = ft.spellcheck(words, word, distance)
        return found.where(~F.col("term").isin(self.words(exclude))) if exclude and self.words(exclude) else found
