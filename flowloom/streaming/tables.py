"""Lookup tables that are loaded again while a job runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


class Tables:
    """Each table has its own loader. A reload tries all of them; one that fails keeps its old table and is counted, and never stops the others."""

    def __init__(self, loaders: dict[str, Callable[[], DataFrame]]):
        self.loaders = loaders
        self.held: dict[str, DataFrame] = {}
        self.rows: dict[str, int] = {}
        self.failures = dict.fromkeys(loaders, 0)
        self.errors: dict[str, str] = {}

    def reload(self) -> dict[str, DataFrame]:
        for name, load in self.loaders.items():
            fresh = None
            try:
                fresh = load().persist()
                n = fresh.count()  # reads the whole source now, not when a batch needs it
            except Exception as e:
                self.failures[name] += 1
                self.errors[name] = str(e)
                if fresh is not None:
                    fresh.unpersist()
                continue
            old = self.held.get(name)
            self.held[name], self.rows[name] = fresh, n
            self.errors.pop(name, None)
            if old is not None:
                old.unpersist()
        return dict(self.held)
