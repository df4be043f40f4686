"""Event streams by type, consumer groups that customers read for, and channels."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import pubsub
from keyloom.operators import streams as ops
from keyloom.operators.keyspace import removed
from keyloom.plans.keys import NOW, millis
from keyloom.plans.registry import register, table

#: The last id a group has read, and the moment at which pending entries are looked at.
LAST = NOW - 86_400_000 * 10

X = "WITH t AS (SELECT event_type AS key, event_id, user_id, max(epoch_us(ts) // 1000) OVER (PARTITION BY event_type ORDER BY event_id) AS ms FROM events), x AS (SELECT key, ms, row_number() OVER (PARTITION BY key, ms ORDER BY event_id) - 1 AS seq, event_id, user_id FROM t) "
D = X + ", n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) - 1 AS i FROM x), r AS (SELECT e.key, o_orderkey AS turn, 'c' || (o_custkey % 7) AS consumer, (o_orderkey % 4)::BIGINT AS n, {base} + o_orderkey * 1000 AS delivery_ms FROM orders, (SELECT DISTINCT event_type AS key FROM events) e WHERE o_orderkey % 5 = length(e.key) % 5), w AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY turn) AS hi FROM r), d AS (SELECT n.key, n.ms, n.seq, w.consumer, w.delivery_ms, 1::INT AS delivery_count, n.i FROM n JOIN w ON n.key = w.key AND n.i >= w.hi - w.n AND n.i < w.hi) ".format(base=LAST)


def entries(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), millis(F.col("ts")).alias("clock"), F.col("event_id").alias("arrival"), "user_id")
    return ops.with_ids(log).select("key", "ms", F.col("seq").cast("long").alias("seq"), F.col("arrival").alias("event_id"), "user_id", "number")


def delivered(spark, sf_dir):
    own = entries(spark, sf_dir)
    keys = table(spark, sf_dir, "events").select(F.col("event_type").alias("key")).distinct().select("key", (F.length("key") % 5).alias("_m"))
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 5).alias("_m"), F.col("o_orderkey").alias("at"), F.concat(F.lit("c"), F.col("o_custkey") % 7).alias("consumer"), (F.col("o_orderkey") % 4).cast("int").alias("count"), (F.lit(LAST) + F.col("o_orderkey") * 1000).alias("delivery_ms"))
    return own, ops.deliveries(own, o.join(keys, "_m").drop("_m"))


@register("xadd_ids", X + "SELECT key, ms, seq::BIGINT AS seq, event_id, user_id FROM x")
def xadd_ids(spark, sf_dir):
    return entries(spark, sf_dir).drop("number")


@register("xlen", "SELECT event_type AS key, count(*)::BIGINT AS length FROM events GROUP BY ALL")
def xlen(spark, sf_dir):
    return ops.stream_info(entries(spark, sf_dir)).select("key", "length")


@register("xrange", X + f"SELECT key, ms, seq::BIGINT AS seq FROM x WHERE ms BETWEEN {LAST} AND {NOW}")
def xrange(spark, sf_dir):
    return ops.id_range(entries(spark, sf_dir), (LAST, 0), (NOW, 2**62)).select("key", "ms", "seq")


@register("xrevrange_count", X + f", r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) AS k FROM x WHERE ms <= {NOW}) SELECT key, ms, seq::BIGINT AS seq FROM r WHERE k <= 5")
def xrevrange_count(spark, sf_dir):
    return ops.id_range(entries(spark, sf_dir), (0, 0), (NOW, 2**62), 5, reverse=True).select("key", "ms", "seq")


@register("xread_after", X + f", r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS k FROM x WHERE ms > {LAST} OR (ms = {LAST} AND seq > 0)) SELECT key, ms, seq::BIGINT AS seq FROM r WHERE k <= 10 AND key IN ('click', 'view')")
def xread_after(spark, sf_dir):
    cursors = spark.createDataFrame([("click", LAST, 0), ("view", LAST, 0)], "key string, last_ms long, last_seq long")
    return ops.read_after(entries(spark, sf_dir), cursors, 10).select("key", "ms", "seq")


@register("xtrim_maxlen", X + ", r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) AS k FROM x) SELECT key, ms, seq::BIGINT AS seq FROM r WHERE k <= 100")
def xtrim_maxlen(spark, sf_dir):
    return ops.trimmed(entries(spark, sf_dir), 100).select("key", "ms", "seq")


@register("xtrim_limit", X + ", r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS k, count(*) OVER (PARTITION BY key) AS n FROM x) SELECT key, ms, seq::BIGINT AS seq FROM r WHERE k > least(30, greatest(n - 100, 0))")
def xtrim_limit(spark, sf_dir):
    return ops.trimmed(entries(spark, sf_dir), 100, 30).select("key", "ms", "seq")


@register("xtrim_minid", X + f"SELECT key, ms, seq::BIGINT AS seq FROM x WHERE ms >= {LAST}")
def xtrim_minid(spark, sf_dir):
    return ops.trimmed_before(entries(spark, sf_dir), LAST).select("key", "ms", "seq")


@register("xreadgroup", D + "SELECT key, ms, seq::BIGINT AS seq, consumer, delivery_ms, delivery_count FROM d")
def xreadgroup(spark, sf_dir):
    return delivered(spark, sf_dir)[1]


#: What is pending after every third entry was acknowledged.
PENDING = D + ", g AS (SELECT d.* FROM d LEFT JOIN (SELECT key, ms, seq FROM x WHERE (ms + seq) % 3 = 0) a USING (key, ms, seq) WHERE a.key IS NULL) "


def pending(spark, sf_dir):
    own, found = delivered(spark, sf_dir)
    acks = own.where((F.col("ms") + F.col("seq")) % 3 == 0).select("key", "ms", "seq")
    return own, removed(found, acks, ["key", "ms", "seq"])


@register("xpending_summary", PENDING + ", c AS (SELECT key, consumer, count(*) AS n FROM g GROUP BY ALL) SELECT g.key, count(*)::BIGINT AS total, min(ms) AS first_ms, max(ms) AS last_ms, any_value(k.consumers) AS consumers FROM g JOIN (SELECT key, string_agg(consumer || '=' || n, ',' ORDER BY consumer) AS consumers FROM c GROUP BY key) k USING (key) GROUP BY g.key")
def xpending_summary(spark, sf_dir):
    found = ops.pending_summary(pending(spark, sf_dir)[1])
    told = F.array_join(F.transform(F.map_entries("consumers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return found.select("key", "total", F.col("first.ms").alias("first_ms"), F.col("last.ms").alias("last_ms"), told.alias("consumers"))


IDLE = 8_000_000 + 86_400_000 * 10 - 10_000_000


@register("xclaim", PENDING + f", o AS (SELECT *, (ms % 2 = 0) AND {NOW} - delivery_ms >= {IDLE} AS goes FROM g) SELECT key, ms, seq::BIGINT AS seq, CASE WHEN goes THEN 'thief' ELSE consumer END AS consumer, CASE WHEN goes THEN {NOW} ELSE delivery_ms END::BIGINT AS delivery_ms, (delivery_count + goes::INT)::INT AS delivery_count FROM o")
def xclaim(spark, sf_dir):
    own = pending(spark, sf_dir)[1]
    return ops.claimed(own, own.where("ms % 2 = 0"), "thief", NOW, IDLE)


@register("xautoclaim", PENDING + f", o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS k FROM g WHERE {NOW} - delivery_ms >= {IDLE}), z AS (SELECT key, ms AS next_ms, seq AS next_seq FROM o WHERE k = 21) SELECT o.key, ms, seq::BIGINT AS seq, 'thief' AS consumer, (delivery_count + 1)::INT AS delivery_count, ms % 10 = 0 AS deleted, coalesce(next_ms, 0)::BIGINT AS next_ms, coalesce(next_seq, 0)::BIGINT AS next_seq FROM o LEFT JOIN z USING (key) WHERE k <= 20")
def xautoclaim(spark, sf_dir):
    own, found = pending(spark, sf_dir)
    return ops.auto_claimed(found, own.where("ms % 10 <> 0"), "thief", NOW, IDLE, (0, 0), 20)


@register("xinfo_lag", X + f", g AS (SELECT DISTINCT event_type AS key, unnest(['a', 'b']) AS \"group\", unnest([{LAST}, {NOW}]) AS last_ms FROM events) SELECT g.key, g.\"group\", (SELECT count(*) FROM x WHERE x.key = g.key AND x.ms > g.last_ms)::BIGINT AS lag FROM g")
def xinfo_lag(spark, sf_dir):
    own = entries(spark, sf_dir)
    groups = own.select("key").distinct().select("key", F.explode(F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(LAST), F.lit(NOW)))).alias("group", "last_ms"), F.lit(2**62).cast("long").alias("last_seq"))
    return ops.group_lag(own, groups)


SUBS = [("ann", "click.1"), ("bob", "click.1"), ("bob", "view.2"), ("cy", "error.3"), ("cy", "error.3")]
PATTERNS = [("dan", "click.*"), ("eve", "*.7"), ("fay", "view.[1-3]?"), ("gus", "error.[^5]"), ("hal", "purchase\\.4")]
M = "WITH m AS (SELECT event_id, event_type || '.' || user_id AS channel FROM events), s AS (SELECT * FROM (VALUES ('ann', 'click.1'), ('bob', 'click.1'), ('bob', 'view.2'), ('cy', 'error.3')) s(client, channel)), p AS (SELECT * FROM (VALUES ('dan', 'click.*', 'click\\..*'), ('eve', '*.7', '.*\\.7'), ('fay', 'view.[1-3]?', 'view\\.[1-3].'), ('gus', 'error.[^5]', 'error\\.[^5]'), ('hal', 'purchase\\.4', 'purchase\\.4')) p(client, pattern, regex)), d AS (SELECT event_id, channel, client, NULL::VARCHAR AS pattern FROM m JOIN s USING (channel) UNION ALL SELECT event_id, channel, client, pattern FROM m JOIN p ON regexp_full_match(channel, regex)) "


def messages(spark, sf_dir):
    subs = spark.createDataFrame(SUBS, "client string, channel string")
    patterns = spark.createDataFrame(PATTERNS, "client string, pattern string")
    return table(spark, sf_dir, "events").select("event_id", F.concat_ws(".", "event_type", "user_id").alias("channel")), subs, patterns


@register("pubsub_route", M + "SELECT * FROM d")
def pubsub_route(spark, sf_dir):
    return pubsub.routed(*messages(spark, sf_dir)).select("event_id", "channel", "client", "pattern")


@register("pubsub_recipients", M + "SELECT event_id, channel, (SELECT count(*) FROM d WHERE d.event_id = m.event_id)::BIGINT AS recipients FROM m")
def pubsub_recipients(spark, sf_dir):
    return pubsub.recipients(*messages(spark, sf_dir), "event_id")


@register("pubsub_numsub", M + "SELECT channel, count(DISTINCT client)::BIGINT AS clients FROM s GROUP BY channel")
def pubsub_numsub(spark, sf_dir):
    return pubsub.subscribers(messages(spark, sf_dir)[1])


@register("xack", D + ", a AS (SELECT key, ms, seq FROM d WHERE ms % 7 = 0) SELECT key, ms, seq::BIGINT AS seq, consumer FROM d WHERE ms % 7 <> 0")
def xack(spark, sf_dir):
    found = delivered(spark, sf_dir)[1]
    acks = entries(spark, sf_dir).where("ms % 7 = 0").select("key", "ms", "seq")
    return removed(found, acks, ["key", "ms", "seq"]).select("key", "ms", "seq", "consumer")


@register("xinfo_consumers", D + f"SELECT key, consumer, count(*)::BIGINT AS pending, ({NOW} - max(delivery_ms))::BIGINT AS idle FROM d GROUP BY ALL")
def xinfo_consumers(spark, sf_dir):
    return ops.consumers(delivered(spark, sf_dir)[1], NOW)


@register("xdel", X + "SELECT key, ms, seq::BIGINT AS seq FROM x WHERE ms % 10 <> 3")
def xdel(spark, sf_dir):
    own = entries(spark, sf_dir).select("key", "ms", "seq")
    return removed(own, own.where("ms % 10 = 3"), ["key", "ms", "seq"])


@register("xinfo_stream", X + "SELECT key, count(*)::BIGINT AS length, min(ms) AS first_ms, max(ms) AS last_ms FROM x GROUP BY key")
def xinfo_stream(spark, sf_dir):
    return ops.stream_info(entries(spark, sf_dir)).select("key", "length", F.col("first.ms").alias("first_ms"), F.col("last.ms").alias("last_ms"))


@register("xadd_explicit", X + ", l AS (SELECT key, max(ms) AS last_ms FROM x GROUP BY key), w AS (SELECT event_type AS key, event_id AS arrival, epoch_us(ts) // 1000 + 34560000000 AS ms, (event_id % 3)::BIGINT AS seq FROM events), r AS (SELECT *, max(ms * 1000 + seq) OVER (PARTITION BY key ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM w) SELECT r.key, r.ms, r.seq, r.arrival FROM r JOIN l USING (key) WHERE r.ms > l.last_ms AND (top IS NULL OR r.ms * 1000 + r.seq > top)")
def xadd_explicit(spark, sf_dir):
    new = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), (millis(F.col("ts")) + 86_400_000 * 400).alias("ms"), (F.col("event_id") % 3).cast("long").alias("seq"), F.col("event_id").alias("arrival"))
    return ops.explicit(entries(spark, sf_dir), new)


@register("xpending_range", PENDING + f", o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS k FROM g WHERE consumer = 'c3' AND {NOW} - delivery_ms >= 1000) SELECT key, ms, seq::BIGINT AS seq, consumer, ({NOW} - delivery_ms)::BIGINT AS idle, delivery_count FROM o WHERE k <= 15")
def xpending_range(spark, sf_dir):
    found = ops.pending_range(pending(spark, sf_dir)[1], (0, 0), (2**60, 2**60), 15, NOW, 1000, "c3")
    return found.select("key", "ms", "seq", "consumer", "idle", "delivery_count")


@register("xclaim_options", PENDING + f", o AS (SELECT *, ms % 2 = 0 AS goes FROM g UNION ALL SELECT x.key, x.ms, x.seq, 'thief', {NOW}, 0, 0, true FROM x LEFT JOIN g USING (key, ms, seq) WHERE g.key IS NULL AND x.ms % 2 = 0) SELECT key, ms, seq::BIGINT AS seq, CASE WHEN goes THEN 'thief' ELSE consumer END AS consumer, CASE WHEN goes THEN {NOW} - 5000 ELSE delivery_ms END::BIGINT AS delivery_ms, CASE WHEN goes THEN 9 ELSE delivery_count END::INT AS delivery_count FROM o")
def xclaim_options(spark, sf_dir):
    own, found = pending(spark, sf_dir)
    return ops.claimed(found, own.where("ms % 2 = 0"), "thief", NOW, 0, at=NOW - 5000, retries=9, force=own)


@register("xclaim_justid", PENDING + f", o AS (SELECT *, (ms % 2 = 0) AND {NOW} - delivery_ms >= {IDLE} AS goes FROM g) SELECT key, ms, seq::BIGINT AS seq, CASE WHEN goes THEN 'thief' ELSE consumer END AS consumer, delivery_count FROM o")
def xclaim_justid(spark, sf_dir):
    own = pending(spark, sf_dir)[1]
    return ops.claimed(own, own.where("ms % 2 = 0"), "thief", NOW, IDLE, just_ids=True).select("key", "ms", "seq", "consumer", "delivery_count")


G = X + f", g AS (SELECT DISTINCT event_type AS key, 'a' AS \"group\", {LAST}::BIGINT AS last_ms, 0::BIGINT AS last_seq FROM events WHERE event_type < 'p'), l AS (SELECT key, arg_max(struct_pack(ms := ms, seq := seq), (ms, seq)) AS l FROM x GROUP BY key) "


def groups(spark, sf_dir):
    keys = table(spark, sf_dir, "events").select(F.col("event_type").alias("key")).distinct()
    return keys.where("key < 'p'").select("key", F.lit("a").alias("group"), F.lit(LAST).cast("long").alias("last_ms"), F.lit(0).cast("long").alias("last_seq"))


@register("xgroup_create", G + 'SELECT * FROM g UNION ALL SELECT l.key, \'a\', l.l.ms, l.l.seq FROM l LEFT JOIN g USING (key) WHERE g.key IS NULL')
def xgroup_create(spark, sf_dir):
    new = ops.last_ids(entries(spark, sf_dir)).withColumn("group", F.lit("a"))
    return ops.groups_created(groups(spark, sf_dir), new)


@register("xgroup_setid", G + 'SELECT l.key, \'a\' AS \"group\", l.l.ms AS last_ms, l.l.seq AS last_seq FROM l JOIN g USING (key)')
def xgroup_setid(spark, sf_dir):
    new = ops.last_ids(entries(spark, sf_dir)).withColumn("group", F.lit("a"))
    return ops.groups_set(groups(spark, sf_dir), new)


@register("xgroup_destroy", G + "SELECT * FROM g WHERE key <> 'click'")
def xgroup_destroy(spark, sf_dir):
    return removed(groups(spark, sf_dir), spark.createDataFrame([("click", "a")], "key string, group string"), ["key", "group"])


@register("xgroup_delconsumer", PENDING + "SELECT key, ms, seq::BIGINT AS seq, consumer FROM g WHERE NOT (key = 'view' AND consumer = 'c2')")
def xgroup_delconsumer(spark, sf_dir):
    gone = spark.createDataFrame([("view", "c2")], "key string, consumer string")
    return removed(pending(spark, sf_dir)[1], gone, ["key", "consumer"]).select("key", "ms", "seq", "consumer")


@register("xsetid", G + f"SELECT key, CASE WHEN key = 'view' THEN 9999999999999 ELSE l.ms END AS last_ms, CASE WHEN key = 'view' THEN 5 ELSE l.seq END::BIGINT AS last_seq FROM l")
def xsetid(spark, sf_dir):
    new = spark.createDataFrame([("view", 9_999_999_999_999, 5), ("click", 1, 1)], "key string, ms long, seq long")
    return ops.set_ids(entries(spark, sf_dir), new)
