"""A dictionary of queries with their SQL, one per catalog module."""

from __future__ import annotations

from lociframe.plans.fixtures import with_views


class Registry:
    def __init__(self, views: dict[str, str] | None = None):
        self.queries, self.sql, self.views = {}, {}, views

    def __call__(self, name: str, sql: str | None = None):
        def keep(fn):
            if name in self.queries:
                raise ValueError(f"{name} is registered twice")
            self.queries[name] = fn
            if sql:
                self.sql[name] = with_views(sql, self.views)
            return fn

        return keep
