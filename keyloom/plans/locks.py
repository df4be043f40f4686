"""Locks: orders queue for their customer, customers wait for one another, line items vote."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import locks as ops
from keyloom.plans.registry import register, table

Q = "SELECT o_custkey AS resource, o_orderkey AS client, left(o_orderpriority, 1)::INT AS priority, datediff('day', DATE '1990-01-01', o_orderdate::DATE)::BIGINT AS enq_ts FROM orders"


def queue(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("resource"), F.col("o_orderkey").alias("client"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long").alias("enq_ts"))


@register("fair_queue_order", f"WITH q AS ({Q}) SELECT *, (row_number() OVER (PARTITION BY resource ORDER BY priority, enq_ts, client) - 1)::BIGINT AS place FROM q")
def fair_queue_order(spark, sf_dir):
    return ops.fair_queue(queue(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


@register("fair_queue_cap", f"WITH q AS ({Q}), r AS (SELECT *, (row_number() OVER (PARTITION BY resource ORDER BY priority, enq_ts, client) - 1)::BIGINT AS place FROM q) SELECT * FROM r WHERE place < 3")
def fair_queue_cap(spark, sf_dir):
    return ops.fair_queue(queue(spark, sf_dir), 3).withColumn("place", F.col("place").cast("long"))


@register("queue_stats", f"WITH q AS ({Q}) SELECT resource, count(*)::BIGINT AS n, (sum(enq_ts % 97) // count(*))::BIGINT AS avg_wait, max(enq_ts % 97)::BIGINT AS max_wait FROM q GROUP BY ALL")
def queue_stats(spark, sf_dir):
    return ops.queue_stats(queue(spark, sf_dir).withColumn("deq_ts", F.col("enq_ts") + F.col("enq_ts") % 97))


#: Every customer holds the resource of its own number and waits for the one that its square leads to.
W = "WITH RECURSIVE e AS (SELECT c_custkey AS waiter, (c_custkey * c_custkey + 1) % (SELECT count(*) FROM customer) AS holder FROM customer), f AS (SELECT * FROM e WHERE waiter <> holder), c AS (SELECT waiter, holder AS node FROM f UNION SELECT c.waiter, f.holder FROM c JOIN f ON f.waiter = c.node), k AS (SELECT waiter FROM c WHERE waiter = node), g AS (SELECT k.waiter AS client, min(c.node) AS cycle FROM k JOIN c ON c.waiter = k.waiter GROUP BY k.waiter) "


def graph(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    n = c.count()
    holds = c.select(F.col("c_custkey").alias("resource"), F.col("c_custkey").alias("client"), (F.col("c_custkey") * 31 % 101).alias("ts"))
    waits = c.select(((F.col("c_custkey") * F.col("c_custkey") + 1) % n).alias("resource"), F.col("c_custkey").alias("client"), (F.col("c_custkey") * 17 % 1000).alias("ts"))
    return holds, waits


@register("wait_edges", "WITH e AS (SELECT c_custkey AS waiter, (c_custkey * c_custkey + 1) % (SELECT count(*) FROM customer) AS holder FROM customer) SELECT * FROM e WHERE waiter <> holder")
def wait_edges(spark, sf_dir):
    return ops.wait_edges(*graph(spark, sf_dir))


@register("deadlock_cycles", W + "SELECT * FROM g")
def deadlock_cycles(spark, sf_dir):
    return ops.deadlocks(ops.wait_edges(*graph(spark, sf_dir)))


@register("deadlock_victim", W + "SELECT cycle, arg_max(client, (client * 31 % 101) * 1000000000 + client) AS victim, count(*)::BIGINT AS clients FROM g GROUP BY cycle")
def deadlock_victim(spark, sf_dir):
    holds, waits = graph(spark, sf_dir)
    return ops.victims(ops.deadlocks(ops.wait_edges(holds, waits)), holds)


@register("long_waits", "SELECT (c_custkey * c_custkey + 1) % (SELECT count(*) FROM customer) AS resource, c_custkey AS client, (1000 - c_custkey * 17 % 1000)::BIGINT AS waited FROM customer WHERE 1000 - c_custkey * 17 % 1000 > 400")
def long_waits(spark, sf_dir):
    return ops.long_waits(graph(spark, sf_dir)[1], 1000, 800).select("resource", "client", F.col("waited").cast("long").alias("waited"))


@register("redlock_quorum", "WITH v AS (SELECT l_orderkey AS resource, l_linenumber % 5 AS node, l_quantity::BIGINT * 20 AS elapsed FROM lineitem WHERE l_returnflag <> 'R') SELECT resource, count(DISTINCT node)::BIGINT AS granted, max(elapsed) AS elapsed, (1000 - max(elapsed) - 12)::BIGINT AS validity FROM v GROUP BY resource HAVING count(DISTINCT node) >= 3 AND 1000 - max(elapsed) - 12 > 0")
def redlock_quorum(spark, sf_dir):
    votes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("resource"), F.lit("t").alias("token"), (F.col("l_linenumber") % 5).alias("node"), (F.col("l_quantity").cast("long") * 20).alias("elapsed"), (F.col("l_returnflag") != "R").alias("acquired"))
    return ops.quorum(votes, 5, 1000).select("resource", "granted", "elapsed", F.col("validity").cast("long").alias("validity"))
