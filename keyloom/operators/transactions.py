"""Transactions: queued transforms over one snapshot of tables, given up if watched keys have changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]


def fingerprint(tables: Tables, keys: list[str]) -> dict[str, tuple]:
    """Of each table's rows of the keys their number and an order-free sum of hashes."""
    found = {}
    for name, rows in tables.items():
        own = rows.where(F.col("key").isin(keys)).select(F.xxhash64(*rows.columns).cast("decimal(38,0)").alias("h"))
        found[name] = tuple(own.agg(F.count(F.lit(1)), F.sum("h")).first())
    return found


class Transaction:
    """MULTI: queue transforms, EXEC: run them in order on the tables as they are, or None if a watched key changed."""

    def __init__(self):
        self.queue: list[Callable[[Tables], Tables]] = []
        self.watched: tuple[list[str], dict[str, tuple]] | None = None

    def watch(self, tables: Tables, keys: list[str]) -> None:
        self.watched = (keys, fingerprint(tables, keys))

    def unwatch(self) -> None:
        self.watched = None

    def add(self, transform: Callable[[Tables], Tables]) -> Transaction:
        self.queue.append(transform)
        return self

    def discard(self) -> None:
        self.queue.clear()
        self.watched = None

    def execute(self, tables: Tables) -> Tables | None:
        if self.watched is not None:
            keys, before = self.watched
            if fingerprint(tables, keys) != before:
                self.discard()
                return None
        out = dict(tables)
        for transform in self.queue:
            out |= transform(out)
        self.discard()
        return out
