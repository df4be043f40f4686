"""Locks: fair queues, wait-for graphs and their cycles, victims, long waits and quorums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.operators.ordering import firsts, numbered
from keyloom.sources.shared import checkpointed


def fair_queue(queue: DataFrame, cap: int | None = None) -> DataFrame:
    """Places from 0 in each resource's queue: lower priority numbers first, then arrival, then the client."""
    order = [F.asc("priority"), F.asc("enq_ts"), F.asc("client")]
    return numbered(queue, ["resource"], order, "place") if cap is None else firsts(queue, ["resource"], order, cap, "place")


def queue_stats(served: DataFrame) -> DataFrame:
    """Waits of each resource: how many, whole average and longest (ms)."""
    wait = F.col("deq_ts") - F.col("enq_ts")
    return served.groupBy("resource").agg(F.count(F.lit(1)).alias("n"), F.floor(F.sum(wait) / F.count(F.lit(1))).cast("long").alias("avg_wait"), F.max(wait).alias("max_wait"))


def wait_edges(holds: DataFrame, waits: DataFrame) -> DataFrame:
    """waiter, holder: who waits for whom, over all resources."""
    held = holds.select("resource", F.col("client").alias("holder"))
    return waits.select("resource", F.col("client").alias("waiter")).join(held, "resource").where("waiter <> holder").select("waiter", "holder").distinct()


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges without nodes that nothing leads to or that lead nowhere, again and again: they are on no cycle."""
    edges = checkpointed(edges)
    n = edges.count()
    while n:
        outs, ins = edges.select(F.col("waiter").alias("holder")).distinct(), edges.select(F.col("holder").alias("waiter")).distinct()
        edges = checkpointed(edges.join(outs, "holder", "left_semi").join(ins, "waiter", "left_semi"))
        left = edges.count()
        if left == n:
            break
        n = left
    return edges


def deadlocks(edges: DataFrame) -> DataFrame:
    """client, cycle: every client on a cycle of waits, with the least client of its strongly connected class.

    Each round colours what is left with the least client that reaches it, and takes, within each colour, what reaches
    the client back. Colours spread over the graph by joins; clients on no cycle are cut off first and after each round.
    Only true cycles are reported, not the paths that lead into them.
    """
    edges = _trimmed(edges.select("waiter", "holder").distinct())
    found = None
    while not edges.isEmpty():
        nodes = edges.select(F.col("waiter").alias("v")).union(edges.select(F.col("holder").alias("v"))).distinct()
        colours = checkpointed(nodes.withColumn("c", F.col("v")))
        while True:
            told = edges.join(colours, edges["waiter"] == colours["v"]).groupBy(F.col("holder").alias("_h")).agg(F.min("c").alias("_c"))
            new = checkpointed(colours.join(told, colours["v"] == told["_h"], "left").select("v", F.least("c", F.coalesce("_c", "c")).alias("c"), (F.col("_c") < F.col("c")).alias("_new")))
            colours = new.drop("_new")
            if new.where("_new").isEmpty():
                break
        of = lambda side: colours.select(F.col("v").alias(side), F.col("c").alias(f"_{side}"))
        inner = checkpointed(edges.join(of("waiter"), "waiter").join(of("holder"), "holder").where("_waiter = _holder").select("waiter", "holder"))
        own = checkpointed(colours.where("v = c"))
        while True:
            more = inner.join(own, inner["holder"] == own["v"]).select(F.col("waiter").alias("v"), "c").distinct().join(own.select("v"), "v", "left_anti")
            more = checkpointed(more)
            if more.isEmpty():
                break
            own = checkpointed(own.union(more))
        sizes = own.groupBy("c").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("c")
        classes = own.join(sizes, "c").select(F.col("v").alias("client"), F.col("c").alias("cycle"))
        found = classes if found is None else found.union(classes)
        gone = own.select("v")
        rest = edges.join(gone, edges["waiter"] == gone["v"], "left_anti").join(gone, F.col("holder") == gone["v"], "left_anti")
        edges = _trimmed(rest)
    return edges.select(F.col("waiter").alias("client"), F.col("waiter").alias("cycle")).limit(0) if found is None else found


def victims(cycles: DataFrame, holds: DataFrame, policy: str = "youngest") -> DataFrame:
    """The client of each cycle that gives way: with the latest, earliest, or fewest holds (ties: latest, then larger id)."""
    held = holds.groupBy("client").agg(F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    both = cycles.join(held, "client")
    by = {"youngest": F.struct("last", "client"), "oldest": F.struct(-F.col("last"), "client"), "fewest": F.struct(-F.col("n"), "last", "client")}[policy]
    return both.groupBy("cycle").agg(F.max_by("client", by).alias("victim"), F.count(F.lit(1)).alias("clients"))


def merged_snapshots(snapshots: DataFrame) -> DataFrame:
    """Wait edges of several nodes' snapshots (node, taken, waiter, holder): of each node the newest one counts, edges are united."""
    newest = snapshots.groupBy("node").agg(F.max("taken").alias("_newest"))
    return snapshots.join(newest, "node").where(F.col("taken") == F.col("_newest")).select("waiter", "holder").distinct()


def long_waits(waits: DataFrame, now: int, max_wait: int) -> DataFrame:
    """Waits of more than half the longest that is allowed."""
    return waits.withColumn("waited", F.lit(now) - F.col("ts")).where(F.col("waited") > max_wait / 2)


def quorum(votes: DataFrame, nodes: int, ttl: int, drift: float = 0.01) -> DataFrame:
    """Locks (resource, token) that most of the nodes granted and that are valid still after the time taken and drift."""
    granted = votes.where("acquired").groupBy("resource", "token").agg(F.count_distinct("node").alias("granted"), F.max("elapsed").alias("elapsed"))
    validity = F.lit(ttl) - F.col("elapsed") - F.lit(int(ttl * drift) + 2)
    return granted.withColumn("validity", validity).where((F.col("granted") >= nodes // 2 + 1) & (F.col("validity") > 0))
