"""Publish and subscribe: messages are routed to subscribers of their channel and of patterns that match it."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.values import glob_regex, slot
from keyloom.sources.shared import checkpointed

#: What ends the literal start of a pattern.
SPECIAL = re.compile(r"[*?\[\\]")
#: Patterns that one scan of the channels tries.
BLOCK = 1_000


def compiled(patterns: DataFrame) -> DataFrame:
    """client, pattern, with the pattern's literal start and end and its regular expression."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            starts = [SPECIAL.split(t, maxsplit=1)[0] for t in texts]
            # what follows a bracket may belong to a class that is never closed
            ends = ["" if "[" in t else SPECIAL.split(t)[-1] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(starts, pa.string()), pa.array(ends, pa.string()), pa.array([glob_regex(t, classes=True) for t in texts], pa.string())], names=["client", "pattern", "start", "end", "regex"])

    return patterns.where("pattern IS NOT NULL").select("client", "pattern").mapInArrow(run, "client string, pattern string, start string, end string, regex string")


def _by_part(channels: DataFrame, ready: DataFrame, part: str) -> DataFrame:
    """Matches of patterns by their literal ``start`` or ``end``, of any of its lengths."""
    lengths = [r["n"] for r in ready.select(F.length(part).alias("n")).distinct().orderBy("n").collect()]
    if not lengths:
        return channels.sparkSession.createDataFrame([], "channel string, client string, pattern string")
    cut = channels.select("channel", F.explode(F.array(*(F.lit(n) for n in lengths))).alias("n")).where(F.length("channel") >= F.col("n"))
    own = F.substring(F.col("channel"), F.lit(1), F.col("n")) if part == "start" else F.substring(F.col("channel"), -F.col("n"), F.col("n"))
    return cut.select("channel", own.alias(part)).join(ready, part).where(F.expr("channel RLIKE regex")).select("channel", "client", "pattern")


def _by_scan(channels: DataFrame, ready: DataFrame) -> DataFrame:
    """Matches of patterns that are literal at neither end: blocks of them, of a bounded number, go to every channel."""
    found, block = None, []

    def scanned(block):
        held = channels.sparkSession.sparkContext.broadcast(block)

        def run(batches):
            own = [(c, p, re.compile(x)) for c, p, x in held.value]
            for batch in batches:
                hits = [(t, c, p) for t in batch.column(0).to_pylist() for c, p, x in own if x.search(t)]
                yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in hits], pa.string()) for k in range(3)], names=["channel", "client", "pattern"])

        return channels.mapInArrow(run, "channel string, client string, pattern string")

    for r in ready.toLocalIterator():
        block.append((r["client"], r["pattern"], r["regex"]))
        if len(block) == BLOCK:
            found = scanned(block) if found is None else found.union(scanned(block))
            block = []
    if block:
        found = scanned(block) if found is None else found.union(scanned(block))
    return found


def matches(channels: DataFrame, patterns: DataFrame) -> DataFrame:
    """channel, client, pattern for distinct channels: joined on the pattern's literal start, or end, then matched."""
    ready, own = checkpointed(compiled(patterns.distinct())), channels.where("channel IS NOT NULL").distinct()
    found = _by_part(own, ready.where("start <> ''"), "start").union(_by_part(own, ready.where("start = '' AND end <> ''"), "end"))
    rest = _by_scan(own, ready.where("start = '' AND end = ''"))
    return found if rest is None else found.union(rest)


def pattern_count(patterns: DataFrame) -> DataFrame:
    """PUBSUB NUMPAT: different patterns that anyone is subscribed to."""
    return patterns.where("pattern IS NOT NULL").agg(F.count_distinct("pattern").alias("n"))


def shard_routed(messages: DataFrame, subs: DataFrame) -> DataFrame:
    """SPUBLISH: deliveries to subscribers of the very channel, with the slot that the channel belongs to."""
    return messages.join(subs.select("client", "channel").distinct(), "channel").withColumn("slot", slot(F.col("channel")))


def routed(messages: DataFrame, subs: DataFrame, patterns: DataFrame) -> DataFrame:
    """PUBLISH: a row for each delivery (messages' columns, client, pattern or null). One client may get several."""
    direct = messages.join(subs.select("client", "channel").distinct(), "channel").withColumn("pattern", F.lit(None).cast("string"))
    by_pattern = messages.join(matches(messages.select("channel"), patterns), "channel")
    return direct.unionByName(by_pattern)


def recipients(messages: DataFrame, subs: DataFrame, patterns: DataFrame, id_col: str) -> DataFrame:
    """PUBLISH's reply: deliveries of each message, 0 too. Channels are counted once, then joined."""
    direct = subs.select("client", "channel").distinct().groupBy("channel").agg(F.count(F.lit(1)).alias("n"))
    matched = matches(messages.select("channel"), patterns).groupBy("channel").agg(F.count(F.lit(1)).alias("n"))
    total = direct.union(matched).groupBy("channel").agg(F.sum("n").alias("recipients"))
    return messages.join(total, "channel", "left").select(id_col, "channel", F.coalesce("recipients", F.lit(0)).alias("recipients"))


def subscribers(subs: DataFrame) -> DataFrame:
    """PUBSUB NUMSUB and CHANNELS."""
    return subs.groupBy("channel").agg(F.count_distinct("client").alias("clients"))
