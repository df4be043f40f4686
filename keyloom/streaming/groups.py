"""Consumer groups and queues as state: what is delivered, pending and acknowledged, key by key.

A message is (key, kind, consumer, n, ms, seq, ts): ``add`` puts an entry, ``read`` asks for n entries, ``ack`` ends
one. The state of a (key, group) is its waiting and pending entries, in order; state that grows with a backlog is what
consumer groups are. An ask that finds nothing waits, which is what blocking reads and pops do, until it times out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, consumer string, ms long, seq long, delivery_count int"
STATE = "waiting array<struct<ms:long,seq:long>>, pending array<struct<ms:long,seq:long,consumer:string,count:int>>, asks array<struct<consumer:string,n:int,until:long>>"


def _serve(waiting: list, pending: list, asks: list, now: int) -> tuple[list, list]:
    """Entries go to the asks in their order; asks whose time is over are gone. Returns deliveries and the asks left."""
    out, left = [], []
    for consumer, n, until in asks:
        if until <= now:
            continue
        taken = waiting[:n]
        del waiting[: len(taken)]
        out += [(consumer, ms, seq, 1) for ms, seq in taken]
        pending += [(ms, seq, consumer, 1) for ms, seq in taken]
        if not taken:
            left.append((consumer, n, until))
    return out, left


def _step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    waiting, pending, asks = ([tuple(x) for x in part] for part in state.get) if state.exists else ([], [], [])
    rows = sorted((r for part in parts for r in part.itertuples(index=False)), key=lambda r: r.at)
    found = []
    for r in rows:
        if r.kind == "add":
            waiting.append((int(r.ms), int(r.seq)))
        elif r.kind == "ack":
            pending = [p for p in pending if p[:2] != (r.ms, r.seq)]
        else:
            asks.append((r.consumer, int(r.n), int(r.until)))
        got, asks = _serve(waiting, pending, asks, int(r.at))
        found += got
    state.update((waiting, pending, asks))
    yield pd.DataFrame([(key[0], *x) for x in found], columns=["key", "consumer", "ms", "seq", "delivery_count"])


def deliver(messages: DataFrame) -> DataFrame:
    """XREADGROUP, BLPOP and BZPOP-like waits over a stream (key, at, kind, consumer, n, ms, seq, until)."""
    return messages.groupBy("key").applyInPandasWithState(_step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
