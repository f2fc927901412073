"""How modules of queries register what they hold."""

from __future__ import annotations


class Registry(dict):
    """name -> (query, SQL or None)."""

    def add(self, name: str, sql: str | None = None):
        def put(f):
            if name in self:
                raise ValueError(f"{name} is there already")
            self[name] = (f, sql)
            return f

        return put
