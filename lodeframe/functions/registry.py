"""Named functions that can be replaced, as stored scripts are: name -> versions, the last of which is registered."""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable

from pyspark.sql import SparkSession


class Functions:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.versions: dict[str, list[str]] = {}

    def load(self, name: str, function: Callable, returns: str | None = None, replace: bool = False) -> str:
        """Registers a function for SQL; gives its digest."""
        if name in self.versions and not replace:
            raise ValueError(f"{name} is there already")
        digest = hashlib.sha1(inspect.getsource(getattr(function, "func", function)).encode()).hexdigest()
        self.spark.udf.register(name, function, returns) if returns else self.spark.udf.register(name, function)
        self.versions.setdefault(name, []).append(digest)
        return digest

    def exists(self, *digests: str) -> list[bool]:
        known = {d for v in self.versions.values() for d in v}
        return [d in known for d in digests]

    def delete(self, name: str) -> None:
        self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")
        self.versions.pop(name, None)
