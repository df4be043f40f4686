"""Hashes, lists, sets: customers as hashes, orders as lists of a customer, users of each event type as sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import collections as ops
from keyloom.operators import keyspace
from keyloom.plans.registry import register, table

#: Members are users with the band that an event's value falls into.
S = "WITH s AS (SELECT DISTINCT event_type AS key, user_id || '.' || floor(value / 20)::INT AS member FROM events) "
H = "WITH h AS (SELECT 'customer:' || c_custkey AS key, field, value FROM (SELECT c_custkey, unnest(['name', 'nation', 'segment']) AS field, unnest([c_name, c_nationkey::VARCHAR, c_mktsegment]) AS value FROM customer)) "
L = "WITH l AS (SELECT o_custkey::VARCHAR AS key, o_orderkey AS pos, o_orderpriority AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) "


def sets(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.concat_ws(".", "user_id", F.floor(F.col("value") / 20).cast("int")).alias("member")).distinct()


def hashes(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    pairs = F.explode(F.map_from_arrays(F.array(F.lit("name"), F.lit("nation"), F.lit("segment")), F.array("c_name", F.col("c_nationkey").cast("string"), "c_mktsegment")))
    return c.select(F.concat(F.lit("customer:"), "c_custkey").alias("key"), pairs.alias("field", "value"))


def lists(spark, sf_dir, value="o_orderpriority"):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderkey").alias("pos"), F.col(value).cast("string").alias("value"))


# Sets


def _sets(name, op, keys, sql):
    register(name, S + sql)(lambda spark, sf_dir: ops.set_algebra(sets(spark, sf_dir), op, keys))


_sets("sinter", "inter", ["signup", "error", "click"], "SELECT member FROM s WHERE key IN ('signup', 'error', 'click') GROUP BY member HAVING count(*) = 3")
_sets("sunion", "union", ["signup", "view"], "SELECT DISTINCT member FROM s WHERE key IN ('signup', 'view')")
_sets("sdiff", "diff", ["signup", "error", "view"], "SELECT member FROM s WHERE key = 'signup' AND member NOT IN (SELECT member FROM s WHERE key IN ('error', 'view'))")
_sets("sinter_missing", "inter", ["signup", "missing"], "SELECT member FROM s WHERE false")


@register("sintercard", S + ", i AS (SELECT member FROM s WHERE key IN ('signup', 'error') GROUP BY member HAVING count(*) = 2) SELECT least(count(*), 40)::BIGINT AS n FROM i")
def sintercard(spark, sf_dir):
    return ops.set_algebra(sets(spark, sf_dir), "inter", ["signup", "error"]).agg(F.least(F.count(F.lit(1)), F.lit(40)).cast("long").alias("n"))


@register("scard", S + "SELECT key, count(*)::BIGINT AS n FROM s GROUP BY key")
def scard(spark, sf_dir):
    return ops.summary(sets(spark, sf_dir))


@register("smismember", S + "SELECT w.pos::INT AS pos, w.member, s.member IS NOT NULL AS found FROM (VALUES (0, '7.1'), (1, 'missing'), (2, '12.0')) w(pos, member) LEFT JOIN s ON s.member = w.member AND s.key = 'view'")
def smismember(spark, sf_dir):
    own = sets(spark, sf_dir).where("key = 'view'").select("member", F.lit(True).alias("_in"))
    return keyspace.ordered_get(own, ["7.1", "missing", "12.0"], "member").select("pos", "member", F.col("_in").isNotNull().alias("found"))


@register("smove", S + "SELECT DISTINCT CASE WHEN key = 'click' AND member = '7.1' THEN 'view' ELSE key END AS key, member FROM s")
def smove(spark, sf_dir):
    return ops.set_moved(sets(spark, sf_dir), "click", "view", "7.1")


@register("sdiffstore", S + "SELECT * FROM s WHERE key <> 'out' UNION ALL SELECT 'out', member FROM s WHERE key = 'signup' AND member NOT IN (SELECT member FROM s WHERE key = 'error')")
def sdiffstore(spark, sf_dir):
    own = sets(spark, sf_dir)
    return ops.stored(ops.set_algebra(own, "diff", ["signup", "error"]), "out", own)


@register("srem", S + "SELECT * FROM s WHERE member NOT IN ('1.0', '2.0', '3.1')")
def srem(spark, sf_dir):
    gone = spark.createDataFrame([("1.0",), ("2.0",), ("3.1",)], "member string")
    return keyspace.removed(sets(spark, sf_dir), gone, ["member"])


@register("srandmember")
def srandmember(spark, sf_dir):
    return ops.sampled(sets(spark, sf_dir), -6, 5, "member")


# Hashes


@register("hgetall_wide", "SELECT 'customer:' || c_custkey AS key, c_name AS name, c_nationkey::VARCHAR AS nation, c_mktsegment AS segment FROM customer")
def hgetall_wide(spark, sf_dir):
    return hashes(spark, sf_dir).groupBy("key").pivot("field", ["name", "nation", "segment"]).agg(F.first("value"))


@register("hgetall_map", H + "SELECT key, string_agg(field || '=' || value, ';' ORDER BY field) AS fields FROM h GROUP BY key")
def hgetall_map(spark, sf_dir):
    maps = ops.as_maps(hashes(spark, sf_dir))
    pairs = F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return maps.select("key", F.array_join(pairs, ";").alias("fields"))


@register("hlen", H + "SELECT key, count(*)::BIGINT AS n FROM h GROUP BY key")
def hlen(spark, sf_dir):
    return ops.summary(hashes(spark, sf_dir))


@register("hmget", H + "SELECT h.key, w.pos::INT AS pos, w.field, x.value FROM (SELECT DISTINCT key FROM h) h CROSS JOIN (VALUES (0, 'segment'), (1, 'missing')) w(pos, field) LEFT JOIN h x ON x.key = h.key AND x.field = w.field")
def hmget(spark, sf_dir):
    maps = ops.as_maps(hashes(spark, sf_dir))
    return maps.select("key", F.posexplode(F.array(F.lit("segment"), F.lit("missing"))).alias("pos", "field"), "fields").select("key", "pos", "field", F.try_element_at("fields", F.col("field")).alias("value"))


@register("hincrby", "SELECT o_custkey::VARCHAR AS key, o_orderstatus AS field, count(*)::BIGINT AS value FROM orders GROUP BY ALL")
def hincrby(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderstatus").alias("field"), F.lit(1).cast("long").alias("delta"))
    return keyspace.counted(log, "delta", ("key", "field"))


@register("hdel", H + "SELECT * FROM h WHERE field <> 'nation'")
def hdel(spark, sf_dir):
    return keyspace.removed(hashes(spark, sf_dir), spark.createDataFrame([("nation",)], "field string"), ["field"])


@register("hsetnx", H + "SELECT * FROM h UNION ALL SELECT DISTINCT 'customer:' || o_custkey, 'orders', 'yes' FROM orders")
def hsetnx(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("customer:"), "o_custkey").alias("key")).distinct()
    new = o.select("key", F.explode(F.map_from_arrays(F.array(F.lit("orders"), F.lit("name")), F.array(F.lit("yes"), F.lit("no")))).alias("field", "value"))
    state = hashes(spark, sf_dir)
    known = state.select("key").distinct()
    return keyspace.upsert(state, new.join(known, "key", "left_semi").unionByName(new.where("field = 'orders'").join(known, "key", "left_anti")), ["key", "field"], "nx")


@register("hstrlen", H + "SELECT key, octet_length(encode(value))::BIGINT AS n FROM h WHERE field = 'name'")
def hstrlen(spark, sf_dir):
    return hashes(spark, sf_dir).where("field = 'name'").select("key", F.octet_length("value").cast("long").alias("n"))


@register("hscan_page", H + "SELECT field, value FROM (SELECT * FROM h WHERE key = 'customer:7' ORDER BY field LIMIT 2 OFFSET 1) WHERE field LIKE 's%'")
def hscan_page(spark, sf_dir):
    return keyspace.page(hashes(spark, sf_dir).where("key = 'customer:7'"), 1, 2, "s*", "field").select("field", "value")


# Lists


def _list(name, sql, run):
    register(name, L + sql)(run)


_list("lrange", "SELECT key, i::BIGINT AS i, value FROM l WHERE i BETWEEN 1 AND n - 2", lambda spark, d: ops.list_range(lists(spark, d), 1, -2).select("key", F.col("i").cast("long").alias("i"), "value"))
_list("ltrim", "SELECT key, pos, value FROM l WHERE i >= n - 3", lambda spark, d: ops.list_range(lists(spark, d), -3, -1).select("key", "pos", "value"))
_list("llen", "SELECT key, count(*)::BIGINT AS n FROM l GROUP BY key", lambda spark, d: ops.summary(lists(spark, d)))
_list("lindex", "SELECT key, value FROM l WHERE i = n - 2", lambda spark, d: ops.list_at(lists(spark, d), -2).select("key", "value"))
_list("lset", "SELECT key, pos, CASE WHEN i = 1 THEN 'new' ELSE value END AS value FROM l", lambda spark, d: ops.list_set(lists(spark, d), 1, F.lit("new")))
_list("lrem", "SELECT key, pos, value FROM (SELECT *, row_number() OVER (PARTITION BY key, value ORDER BY pos) AS k FROM l) WHERE NOT (value = '5-LOW' AND k <= 2)", lambda spark, d: ops.list_removed(lists(spark, d), "5-LOW", 2))
_list("lrem_tail", "SELECT key, pos, value FROM (SELECT *, row_number() OVER (PARTITION BY key, value ORDER BY pos DESC) AS k FROM l) WHERE NOT (value = '5-LOW' AND k <= 1)", lambda spark, d: ops.list_removed(lists(spark, d), "5-LOW", -1))
_list("lpos_rank", "SELECT key, i::BIGINT AS i FROM (SELECT *, row_number() OVER (PARTITION BY key, value ORDER BY pos DESC) AS k FROM l) WHERE value = '5-LOW' AND k BETWEEN 2 AND 3", lambda spark, d: ops.list_positions(lists(spark, d), "5-LOW", -2, 2).select("key", F.col("i").cast("long").alias("i")))
_list("lpop", "SELECT key, value, i::BIGINT AS rank FROM l WHERE i < 2", lambda spark, d: ops.popped(lists(spark, d), 2, [F.asc("pos")]).select("key", "value", F.col("rank").cast("long").alias("rank")))
_list("rpop_rest", "SELECT key, pos, value FROM l WHERE i < n - 2", lambda spark, d: ops.after_pop(lists(spark, d), 2, [F.desc("pos")], ["key", "pos"]))
_list("lmpop", "SELECT key, value FROM l WHERE key = '4' AND i < 3", lambda spark, d: ops.multi_pop(lists(spark, d), ["missing", "4", "5"], 3, [F.asc("pos")]).select("key", "value"))
_list("lpush", "SELECT key, i::BIGINT AS i, value FROM (SELECT key, row_number() OVER (PARTITION BY key ORDER BY o) - 1 AS i, value FROM (SELECT key, pos::DOUBLE AS o, value FROM l UNION ALL SELECT DISTINCT key, -1.0, 'x' FROM l UNION ALL SELECT DISTINCT key, -2.0, 'y' FROM l))", lambda spark, d: _pushed(lists(spark, d)))
_list("linsert", "SELECT key, (row_number() OVER (PARTITION BY key ORDER BY o) - 1)::BIGINT AS pos, value FROM (SELECT key, i::DOUBLE AS o, value FROM l UNION ALL SELECT key, min(i) - 0.5, 'new' FROM l WHERE value = '5-LOW' GROUP BY key)", lambda spark, d: ops.list_inserted(lists(spark, d), "5-LOW", "new"))
_list("sort_alpha_desc", "SELECT key, value, (row_number() OVER (PARTITION BY key ORDER BY value DESC, pos DESC) - 1)::BIGINT AS rank FROM l", lambda spark, d: ops.sorted_elements(lists(spark, d), alpha=True, descending=True).select("key", "value", F.col("rank").cast("long").alias("rank")))


def _pushed(rows):
    keys = rows.select("key").distinct()
    new = keys.select("key", F.posexplode(F.array(F.lit("x"), F.lit("y"))).alias("seq", "value"))
    return ops.indexed(ops.pushed(rows, new, left=True)).select("key", F.col("i").cast("long").alias("i"), "value")


@register("sort_num_limit", "SELECT key, value, rank::BIGINT AS rank FROM (SELECT o_custkey::VARCHAR AS key, o_orderdate::DATE::VARCHAR AS d, o_orderkey::VARCHAR AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS rank FROM orders) WHERE rank BETWEEN 1 AND 2")
def sort_num_limit(spark, sf_dir):
    return ops.sorted_elements(lists(spark, sf_dir, "o_orderkey"), offset=1, count=2).select("key", "value", F.col("rank").cast("long").alias("rank"))


@register("lmove", L + ", t AS (SELECT key, pos, value FROM l WHERE NOT (key = '4' AND i = n - 1) UNION ALL SELECT '5', -1, value FROM l WHERE key = '4' AND i = n - 1) SELECT key, (row_number() OVER (PARTITION BY key ORDER BY pos) - 1)::BIGINT AS i, value FROM t")
def lmove(spark, sf_dir):
    moved = ops.moved_elements(lists(spark, sf_dir), "4", "5", from_left=False, to_left=True)
    return ops.indexed(moved).select("key", F.col("i").cast("long").alias("i"), "value")


@register("hincrbyfloat", "SELECT o_custkey::VARCHAR AS key, o_orderstatus AS field, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS value FROM orders GROUP BY ALL")
def hincrbyfloat(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderstatus").alias("field"), F.col("o_totalprice").cast("decimal(18,2)").alias("delta"))
    return keyspace.counted(log, "delta", ("key", "field")).withColumn("value", F.col("value").cast("double"))


@register("rpushx", L + ", t AS (SELECT key, pos, value FROM l UNION ALL SELECT DISTINCT key, 1000000000000 AS pos, 'x' AS value FROM l) SELECT key, (row_number() OVER (PARTITION BY key ORDER BY pos) - 1)::BIGINT AS i, value FROM t")
def rpushx(spark, sf_dir):
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.lit(0).alias("seq"), F.lit("x").alias("value"))
    grown = ops.pushed(lists(spark, sf_dir), new, only_existing=True)
    return ops.indexed(grown).select("key", F.col("i").cast("long").alias("i"), "value")


@register("conversation_lists", "SELECT conv_id::VARCHAR AS key, count(*)::BIGINT AS n, arg_max(role, turn) AS last_role FROM conversations GROUP BY ALL")
def conversation_lists(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("key"), F.col("turn").alias("pos"), F.col("role").alias("value"))
    tail = ops.popped(rows, 1, [F.desc("pos")]).select("key", F.col("value").alias("last_role"))
    return ops.summary(rows).join(tail, "key")
