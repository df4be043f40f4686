"""Options and near relatives of the operators in the other plans, each over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from keyloom.operators import bitmaps, geo, keyspace, locks, pubsub
from keyloom.operators import collections as ops
from keyloom.plans import containers, keys, places, scored
from keyloom.plans.keys import NOW, C, E
from keyloom.plans.registry import register, table
from keyloom.sources import snapshot
from keyloom.sources.shared import shared_dir

H, L, S, Z, HIGH = containers.H, containers.L, containers.S, scored.Z, scored.HIGH

# Strings and expiry

STATE = E + ", st AS (SELECT key, 'v' || key AS value, expires_at FROM k WHERE expires_at IS NULL OR expires_at > {now}), nw AS (SELECT c_custkey::VARCHAR AS key, c_name AS value, CASE WHEN c_custkey % 3 > 0 THEN c_custkey::BIGINT * 1000 END AS ttl_ms FROM customer) ".format(now=NOW)


def _state(spark, sf_dir):
    return keys.users(spark, sf_dir).select("key", F.concat(F.lit("v"), "key").alias("value"), "expires_at")


def _new(spark, sf_dir):
    k = F.col("c_custkey").cast("long")
    return table(spark, sf_dir, "customer").select(k.cast("string").alias("key"), F.col("c_name").alias("value"), F.when(k % 3 > 0, k * 1000).alias("ttl_ms"))


def _set(name, guard, keep, sql):
    register(name, STATE + sql)(lambda spark, sf_dir: keyspace.set_expiring(_state(spark, sf_dir), _new(spark, sf_dir), NOW, guard, keep))


_set("setex", "", False, f"SELECT key, value, {NOW} + ttl_ms AS expires_at FROM nw UNION ALL SELECT * FROM st WHERE key NOT IN (SELECT key FROM nw)")
_set("set_nx_ex", "nx", False, f"SELECT * FROM st UNION ALL SELECT key, value, {NOW} + ttl_ms FROM nw WHERE key NOT IN (SELECT key FROM st)")
_set("set_xx_ex", "xx", False, f"SELECT st.key, coalesce(nw.value, st.value) AS value, CASE WHEN nw.key IS NULL THEN st.expires_at ELSE {NOW} + nw.ttl_ms END AS expires_at FROM st LEFT JOIN nw USING (key)")
_set("set_keepttl", "", True, "SELECT key, nw.value, st.expires_at FROM nw LEFT JOIN st USING (key) UNION ALL SELECT * FROM st WHERE key NOT IN (SELECT key FROM nw)")


@register("getex", STATE + f"SELECT key, st.value, CASE WHEN nw.key IS NULL THEN st.expires_at ELSE {NOW} + nw.ttl_ms END AS expires_at FROM st LEFT JOIN (SELECT * FROM nw WHERE key::BIGINT % 2 = 0) nw USING (key)")
def getex(spark, sf_dir):
    ttls = _new(spark, sf_dir).where(F.col("key").cast("long") % 2 == 0).select("key", "ttl_ms")
    return keyspace.get_expiring(_state(spark, sf_dir), ttls, NOW)[1]


@register("getdel", C + "SELECT key, value, 'got' AS side FROM c WHERE key IN (SELECT 'customer:' || o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') UNION ALL SELECT key, value, 'left' FROM c WHERE key NOT IN (SELECT 'customer:' || o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def getdel(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("customer:"), "o_custkey").alias("key"))
    got, left = keyspace.taken(keys.strings(spark, sf_dir), wanted, ["key"])
    return got.withColumn("side", F.lit("got")).unionByName(left.withColumn("side", F.lit("left")))


@register("expireat", E + f", t AS (SELECT c_custkey::VARCHAR AS key, {NOW} + (c_nationkey::BIGINT - 5) * 3600000 AS at_ms FROM customer WHERE c_custkey % 2 = 0) SELECT key, coalesce(at_ms, expires_at) AS expires_at FROM k LEFT JOIN t USING (key) WHERE (expires_at IS NULL OR expires_at > {NOW}) AND (at_ms IS NULL OR at_ms > {NOW})")
def expireat(spark, sf_dir):
    times = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("key"), (F.lit(NOW) + (F.col("c_nationkey").cast("long") - 5) * 3_600_000).alias("at_ms"))
    return keyspace.expire_at(keys.users(spark, sf_dir), times, NOW).select("key", "expires_at")


@register("expiretime", E + f", a AS (SELECT key, coalesce(expires_at, -1) AS due FROM k WHERE expires_at IS NULL OR expires_at > {NOW}) SELECT c_custkey::VARCHAR AS key, coalesce(due, -2)::BIGINT AS pexpiretime, (CASE WHEN coalesce(due, -2) < 0 THEN coalesce(due, -2) ELSE due // 1000 END)::BIGINT AS expiretime FROM customer LEFT JOIN a ON a.key = c_custkey::VARCHAR")
def expiretime(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    return keyspace.expire_times(keys.users(spark, sf_dir), wanted, NOW)


@register("expire_cond_xx", E + f"SELECT key, CASE WHEN c.c_custkey IS NOT NULL AND expires_at IS NOT NULL THEN {NOW} + c.c_nationkey::BIGINT * 7200000 ELSE expires_at END::BIGINT AS expires_at FROM k LEFT JOIN customer c ON k.key = c.c_custkey::VARCHAR WHERE expires_at IS NULL OR expires_at > {NOW}")
def expire_cond_xx(spark, sf_dir):
    ttls = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), (F.col("c_nationkey").cast("long") * 7_200_000).alias("ttl_ms"))
    return keyspace.expire(keys.users(spark, sf_dir), ttls, NOW, "xx").select("key", "expires_at")


@register("active_expire", E + f"SELECT key, expires_at FROM k WHERE expires_at IS NULL OR expires_at > {NOW}")
def active_expire(spark, sf_dir):
    state = keys.users(spark, sf_dir)
    for seed in range(4):  # samples of one in one find all that has expired; smaller ones are in the tests
        state = keyspace.swept(state, NOW, 1, seed)
    return state.select("key", "expires_at")


@register("type_of", "SELECT 'customer:' || c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'string' WHEN c_custkey % 3 = 1 THEN 'hash' ELSE 'none' END AS type FROM customer")
def type_of(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("key"), (F.col("c_custkey") % 3).alias("m"))
    return keyspace.types({"string": c.where("m = 0"), "hash": containers.hashes(spark, sf_dir).join(c.where("m = 1"), "key", "left_semi")}, c.select("key"))


@register("renamenx", C + "SELECT CASE WHEN key = 'customer:3' THEN 'moved' ELSE key END AS key, value FROM c")
def renamenx(spark, sf_dir):
    names = spark.createDataFrame([("customer:1", "customer:2"), ("customer:3", "moved"), ("missing", "new")], "key string, new string")
    return keyspace.renamed(keys.strings(spark, sf_dir), names, only_new=True)


@register("msetnx_writes", C + "SELECT * FROM c UNION ALL SELECT 'supplier:' || s_suppkey, s_name FROM supplier")
def msetnx_writes(spark, sf_dir):
    new = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("key"), F.col("s_name").alias("value"))
    return keyspace.upsert_all_or_none(keys.strings(spark, sf_dir), new, ["key"])


@register("touch", "SELECT count(*)::BIGINT AS n FROM (SELECT DISTINCT o_custkey FROM orders) JOIN customer ON o_custkey = c_custkey")
def touch(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").select(F.concat(F.lit("customer:"), "o_custkey").alias("key")).distinct()
    return keyspace.existing(keys.strings(spark, sf_dir), wanted, ["key"]).agg(F.count(F.lit(1)).alias("n"))


@register("incr_overflow", "SELECT c_custkey::VARCHAR AS key, CASE WHEN c_custkey % 2 = 0 THEN 9223372036854775807 - 700 + CASE WHEN c_custkey <= 700 THEN c_custkey ELSE 0 END ELSE c_custkey::BIGINT END AS value FROM customer")
def incr_overflow(spark, sf_dir):
    k = F.col("c_custkey").cast("long")
    c = table(spark, sf_dir, "customer")
    state = c.where("c_custkey % 2 = 0").select(k.cast("string").alias("key"), F.lit(2**63 - 1 - 700).alias("value"))
    return keyspace.incremented(state, c.select(k.cast("string").alias("key"), k.alias("delta")))


@register("object_idle_freq", E + f"SELECT key, (({NOW} + 8640000000 - last_access) // 1000)::BIGINT AS idletime, frequency AS freq FROM k")
def object_idle_freq(spark, sf_dir):
    return keyspace.object_info(keys.users(spark, sf_dir), NOW + 8_640_000_000)


@register("lfu_decay", E + ", d AS (SELECT key, least(frequency, 255)::INT AS n, (last_access // 60000 & 65535)::INT AS m FROM k) SELECT key, greatest(0, n - (CASE WHEN 30000 >= m THEN 30000 - m ELSE 65535 - m + 30000 END) // 500)::INT AS counter FROM d")
def lfu_decay(spark, sf_dir):
    at = F.floor(F.col("last_access") / 60_000).bitwiseAND(F.lit(65535).cast("long")).cast("int")
    counter = keyspace.lfu_decayed(F.least(F.col("frequency"), F.lit(255)).cast("int"), at, F.lit(30_000), 500)
    return keys.users(spark, sf_dir).select("key", counter.cast("int").alias("counter"))


@register("slowlog", "SELECT event_id AS id, event_type AS command, round(value * 1000)::BIGINT AS micros FROM events WHERE round(value * 1000) >= 50000 ORDER BY event_id DESC LIMIT 25")
def slowlog(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("command"), F.round(F.col("value") * 1000).cast("long").alias("micros"))
    return log.where("micros >= 50000").orderBy(F.desc("id")).limit(25)


# Hashes

HL = "hl AS (SELECT event_type AS key, 'f' || user_id AS field, props AS value, event_id AS seq FROM events)"


@register("hset", f"WITH {HL} SELECT key, field, arg_max(value, seq) AS value FROM hl GROUP BY ALL")
def hset(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.concat(F.lit("f"), "user_id").alias("field"), F.col("props").alias("value"), F.col("event_id").alias("seq"))
    return keyspace.latest(log, ["key", "field"])


@register("hexists", "SELECT 'customer:' || c_custkey AS key, f.field, f.field <> 'phone' AS found FROM customer, (SELECT unnest(['name', 'phone']) AS field) f")
def hexists(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("key"), F.explode(F.array(F.lit("name"), F.lit("phone"))).alias("field"))
    here = containers.hashes(spark, sf_dir).select("key", "field", F.lit(True).alias("_in"))
    return wanted.join(here, ["key", "field"], "left").select("key", "field", F.col("_in").isNotNull().alias("found"))


@register("hgetdel", H + "SELECT key, field, value, CASE WHEN field = 'segment' THEN 'got' ELSE 'left' END AS side FROM h")
def hgetdel(spark, sf_dir):
    own = containers.hashes(spark, sf_dir)
    got, left = keyspace.taken(own, own.where("field = 'segment'").select("key", "field"), ["key", "field"])
    return got.withColumn("side", F.lit("got")).unionByName(left.withColumn("side", F.lit("left")))


@register("hkeys", H + "SELECT key, field FROM h")
def hkeys(spark, sf_dir):
    return containers.hashes(spark, sf_dir).select("key", "field")


@register("hvals", H + "SELECT key, value FROM h")
def hvals(spark, sf_dir):
    return containers.hashes(spark, sf_dir).select("key", "value")


# Lists


@register("rpush", L + "SELECT key, pos, value FROM l UNION ALL SELECT c_custkey::VARCHAR, coalesce(p.hi, -1) + 1, c_mktsegment FROM customer LEFT JOIN (SELECT key, max(pos) AS hi FROM l GROUP BY key) p ON p.key = c_custkey::VARCHAR")
def rpush(spark, sf_dir):
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.lit(0).alias("seq"), F.col("c_mktsegment").alias("value"))
    return ops.pushed(containers.lists(spark, sf_dir), new)


@register("lpushx", L + "SELECT key, pos, value FROM l UNION ALL SELECT c_custkey::VARCHAR, p.lo - 1, c_mktsegment FROM customer JOIN (SELECT key, min(pos) AS lo FROM l GROUP BY key) p ON p.key = c_custkey::VARCHAR")
def lpushx(spark, sf_dir):
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.lit(0).alias("seq"), F.col("c_mktsegment").alias("value"))
    return ops.pushed(containers.lists(spark, sf_dir), new, left=True, only_existing=True)


@register("lpos_all_maxlen", L + ", h AS (SELECT key, i FROM l WHERE value = '2-HIGH' AND i < 6) SELECT key, i::BIGINT AS i FROM h")
def lpos_all_maxlen(spark, sf_dir):
    return ops.list_positions(containers.lists(spark, sf_dir), "2-HIGH", 1, 0, 6).select("key", F.col("i").cast("long").alias("i"))


# Sets

MORE = "WITH a AS (SELECT DISTINCT event_type AS key, user_id::VARCHAR AS member FROM events) "


@register("sadd", MORE + "SELECT * FROM a")
def sadd(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("member"), F.col("event_id").alias("seq"), F.lit(1).alias("value"))
    return keyspace.earliest(log, ["key", "member"]).drop("value")


@register("smembers", S + "SELECT member FROM s WHERE key = 'click'")
def smembers(spark, sf_dir):
    return ops.set_algebra(containers.sets(spark, sf_dir), "union", ["click"])


def _stored(name, op, sql):
    def run(spark, sf_dir):
        own = containers.sets(spark, sf_dir)
        return ops.stored(ops.set_algebra(own, op, ["signup", "error"]), "view", own)

    register(name, S + f"SELECT * FROM s WHERE key <> 'view' UNION ALL SELECT 'view', member FROM ({sql})")(run)


_stored("sinterstore", "inter", "SELECT member FROM s WHERE key IN ('signup', 'error') GROUP BY member HAVING count(*) = 2")
_stored("sunionstore", "union", "SELECT DISTINCT member FROM s WHERE key IN ('signup', 'error')")


@register("sscan_page", S + "SELECT member FROM s WHERE key = 'click' ORDER BY member LIMIT 40 OFFSET 20")
def sscan_page(spark, sf_dir):
    return keyspace.page(containers.sets(spark, sf_dir).where("key = 'click'").select("member"), 20, 40, by="member")


# Scored sets

ZL = "WITH z AS (SELECT event_type AS key, user_id::VARCHAR AS member, round(sum(value::DECIMAL(18,4)), 2)::DOUBLE AS score FROM events GROUP BY ALL), o AS (SELECT * FROM z WHERE member::BIGINT % 2 = 0), n AS (SELECT event_type AS key, user_id::VARCHAR AS member, {fold} * 40 AS score FROM events GROUP BY ALL) "


def _zadd(name, guard, compare, fold, sql):
    def run(spark, sf_dir):
        log = scored.zlog(spark, sf_dir).withColumn("score", F.col("score") * 40)
        return ops.zadd_state(scored.zsets(spark, sf_dir).where(F.col("member").cast("long") % 2 == 0), log, guard, compare)

    register(name, ZL.format(fold=fold) + sql)(run)


_zadd("zadd_xx", "xx", "", "arg_max(value, event_id)", "SELECT o.key, o.member, coalesce(n.score, o.score) AS score, false AS added, coalesce(n.score, o.score) <> o.score AS changed FROM o LEFT JOIN n USING (key, member)")
_zadd("zadd_xx_gt", "xx", "gt", "max(value)", "SELECT o.key, o.member, greatest(n.score, o.score) AS score, false AS added, greatest(n.score, o.score) <> o.score AS changed FROM o LEFT JOIN n USING (key, member)")
_zadd("zadd_lt_ch", "", "lt", "min(value)", "SELECT key, member, least(n.score, o.score) AS score, o.key IS NULL AS added, o.key IS NULL OR least(n.score, o.score) <> o.score AS changed FROM n LEFT JOIN o USING (key, member)")
_zadd("zadd_nx_ch", "nx", "", "arg_min(value, event_id)", "SELECT key, member, coalesce(o.score, n.score) AS score, o.key IS NULL AS added, o.key IS NULL AS changed FROM n LEFT JOIN o USING (key, member)")


@register("zrem", Z + "SELECT * FROM z WHERE member::BIGINT % 3 <> 0")
def zrem(spark, sf_dir):
    own = scored.zsets(spark, sf_dir)
    return keyspace.removed(own, own.where(F.col("member").cast("long") % 3 == 0).select("key", "member"), ["key", "member"])


@register("zrangestore", Z + ", r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS i FROM z) SELECT key, member, score FROM z WHERE key <> 'view' UNION ALL SELECT 'view', member, score FROM r WHERE key = 'click' AND i BETWEEN 5 AND 24")
def zrangestore(spark, sf_dir):
    own = scored.zsets(spark, sf_dir)
    return ops.stored(ops.zrange(own.where("key = 'click'"), 5, 24).select("member", "score"), "view", own)


@register("zrevrangebylex", Z + ", r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member DESC) - 1 AS rank FROM z WHERE member >= '12' AND member < '5') SELECT key, member, rank::BIGINT AS rank FROM r WHERE rank BETWEEN 2 AND 11")
def zrevrangebylex(spark, sf_dir):
    own = scored.zsets(spark, sf_dir).where(ops.in_members("[12", "(5"))
    return ops.limited(own, [F.desc("member")], 2, 10).select("key", "member", F.col("rank").cast("long").alias("rank"))


def _zstored(name, op, sql):
    def run(spark, sf_dir):
        own = scored.banded(spark, sf_dir)
        return ops.stored(ops.zalgebra(own, op, ["signup", "error"], None, "max"), "out", own)

    register(name, f"WITH {HIGH} SELECT key, member, score FROM z UNION ALL SELECT 'out', member, score FROM ({sql})")(run)


_zstored("zinterstore", "inter", "SELECT member, max(score) AS score FROM z WHERE key IN ('signup', 'error') GROUP BY member HAVING count(*) = 2")
_zstored("zdiffstore", "diff", "SELECT member, score FROM z WHERE key = 'signup' AND member NOT IN (SELECT member FROM z WHERE key = 'error')")


@register("zscan_page", Z + "SELECT member, score FROM z WHERE key = 'click' ORDER BY member LIMIT 30 OFFSET 10")
def zscan_page(spark, sf_dir):
    return keyspace.page(scored.zsets(spark, sf_dir).where("key = 'click'").select("member", "score"), 10, 30, by="member")


# Places

TO_SEVEN = places.KM.format(a="(SELECT lat FROM p WHERE member = '7')", b="lat", x="(SELECT lon FROM p WHERE member = '7')", y="lon")


@register("geosearch_member", places.P + f"SELECT member, round({TO_SEVEN}, 3) AS dist FROM p WHERE {TO_SEVEN} <= 9000")
def geosearch_member(spark, sf_dir):
    return geo.around_member(places.points(spark, sf_dir), "supplier", "7", 9000, "km").select("member", F.round("dist", 3).alias("dist"))


CUSTOMERS = f"WITH {places._p('p', 'supplier', 's_suppkey')}, {places._p('c', 'customer', 'c_custkey')} "


@register("geoadd_nx", CUSTOMERS + "SELECT 'supplier' AS key, member, lon, lat FROM p UNION ALL SELECT 'supplier', member, lon, lat FROM c WHERE member NOT IN (SELECT member FROM p) AND abs(lat) <= 85.05112878")
def geoadd_nx(spark, sf_dir):
    new = places.points(spark, sf_dir, "customer", "c_custkey").withColumn("key", F.lit("supplier"))
    return geo.geoadd(places.points(spark, sf_dir), new, "nx").select("key", "member", "lon", "lat")


# Bitmaps: the same operator over a whole range in bytes, ends from the back


@register("bitpos_range", "WITH b AS (SELECT event_type AS key, user_id AS off FROM events GROUP BY ALL HAVING arg_max(value, event_id) < 60) SELECT key, min(off) AS pos FROM b WHERE off BETWEEN 64 AND 127 GROUP BY key")
def bitpos_range(spark, sf_dir):
    from keyloom.plans.bits import bits

    return bitmaps.bitpos_set(bits(spark, sf_dir).where("off <= 127"), 64)


# Locks


@register("deadlock_snapshots", "WITH e AS (SELECT c_custkey % 5 AS node, c_custkey % 7 AS taken, c_custkey AS waiter, (c_custkey * c_custkey + 1) % (SELECT count(*) FROM customer) AS holder FROM customer), m AS (SELECT node, max(taken) AS taken FROM e GROUP BY node) SELECT DISTINCT waiter, holder FROM e JOIN m USING (node, taken)")
def deadlock_snapshots(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("waiter"))
    n = c.count()
    return locks.merged_snapshots(c.select((F.col("waiter") % 5).alias("node"), (F.col("waiter") % 7).alias("taken"), "waiter", ((F.col("waiter") * F.col("waiter") + 1) % n).alias("holder")))


# Logs of every type, written to and read back from JSON files


def _read_back(spark, rows):
    folder = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    snapshot.append_log(rows, folder)
    return snapshot.read_log(spark, folder)


def _log(spark, sf_dir, put, other, member=True):
    """The events as a log: every seventh row is ``other``, some delete their key, one clears database 1, all else is ``put``."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    op = F.when(i == 4_321, "FLUSHDB").when(i % 1_500 == 1_499, "DEL").when(i % 7 == 3, other).otherwise(put)
    db = F.when(i == 4_321, 1).otherwise((F.col("user_id") % 2).cast("int"))
    return _read_back(spark, e.select(i.alias("seq"), F.col("ts").cast("timestamp").alias("ts"), db.alias("db"), op.alias("op"), F.col("event_type").alias("key"), F.when(F.lit(member), F.col("user_id").cast("string")).alias("member"), F.floor("value").cast("double").alias("num"), F.col("props").alias("value")))


def _log_sql(put, other):
    return f"WITH l AS (SELECT event_id AS seq, CASE WHEN event_id = 4321 THEN 1 ELSE (user_id % 2)::INT END AS db, CASE WHEN event_id = 4321 THEN 'FLUSHDB' WHEN event_id % 1500 = 1499 THEN 'DEL' WHEN event_id % 7 = 3 THEN '{other}' ELSE '{put}' END AS op, event_type AS key, user_id::VARCHAR AS member, floor(value)::DOUBLE AS num, props AS value FROM events), d AS (SELECT db, key, max(seq) AS seq FROM l WHERE op = 'DEL' GROUP BY ALL), r AS (SELECT l.* FROM l LEFT JOIN d USING (db, key) WHERE op NOT IN ('DEL', 'FLUSHDB') AND l.seq > coalesce(d.seq, -1) AND (l.db <> 1 OR l.seq > 4321)) "


def _members(name, put, remove, columns, sql):
    register(name, _log_sql(put, remove) + f"SELECT db, key, member, {sql} FROM r GROUP BY ALL HAVING arg_max(op, seq) = '{put}'")(lambda spark, sf_dir: snapshot.replay_members(_log(spark, sf_dir, put, remove), put, remove).select("db", "key", "member", *columns))


_members("replay_hashes", "HSET", "HDEL", ["value"], "arg_max(value, seq) AS value")
_members("replay_scored_sets", "ZADD", "ZREM", ["num"], "arg_max(num, seq) AS num")


@register("replay_sets", _log_sql("SADD", "SREM") + "SELECT db, key, member FROM r GROUP BY ALL HAVING arg_max(op, seq) = 'SADD'")
def replay_sets(spark, sf_dir):
    return snapshot.replay_members(_log(spark, sf_dir, "SADD", "SREM"), "SADD", "SREM").select("db", "key", "member")


def _sums(name, put, add):
    sql = ", p AS (SELECT db, key, member, max(seq) AS since, arg_max(num, seq) AS base FROM r WHERE op = '{put}' GROUP BY ALL) SELECT db, key, member, coalesce(any_value(base), 0) + coalesce(sum(num) FILTER (op = '{add}' AND r.seq > coalesce(since, -1)), 0) AS num FROM r LEFT JOIN p USING (db, key, member) GROUP BY db, key, member"
    # puts are the rare ones here, so that there is something to add up
    register(name, _log_sql(add, put) + sql.format(put=put, add=add))(lambda spark, sf_dir: snapshot.replay_sums(_log(spark, sf_dir, add, put), put, add))


_sums("replay_zincrby", "ZADD", "ZINCRBY")
_sums("replay_hincrby", "HSET", "HINCRBY")


@register("replay_counters", _log_sql("INCRBY", "SET") + ", p AS (SELECT db, key, max(seq) AS since, arg_max(num, seq) AS base FROM r WHERE op = 'SET' GROUP BY ALL) SELECT db, key, '' AS member, coalesce(any_value(base), 0) + coalesce(sum(num) FILTER (op = 'INCRBY' AND r.seq > coalesce(since, -1)), 0) AS num FROM r LEFT JOIN p USING (db, key) GROUP BY db, key")
def replay_counters(spark, sf_dir):
    return snapshot.replay_sums(_log(spark, sf_dir, "INCRBY", "SET", member=False), "SET", "INCRBY")


@register("replay_lists", _log_sql("RPUSH", "LPUSH") + "SELECT db, key, (CASE WHEN op = 'RPUSH' THEN row_number() OVER (PARTITION BY db, key, op ORDER BY seq) - 1 ELSE -row_number() OVER (PARTITION BY db, key, op ORDER BY seq) END)::BIGINT AS pos, value FROM r")
def replay_lists(spark, sf_dir):
    return snapshot.replay_lists(_log(spark, sf_dir, "RPUSH", "LPUSH")).withColumn("pos", F.col("pos").cast("long"))


@register("replay_expiries", _log_sql("PEXPIREAT", "PERSIST") + "SELECT db, key, arg_max(num, seq)::BIGINT AS expires_at FROM r GROUP BY ALL HAVING arg_max(op, seq) = 'PEXPIREAT'")
def replay_expiries(spark, sf_dir):
    return snapshot.replay_expiries(_log(spark, sf_dir, "PEXPIREAT", "PERSIST"))


# Snapshots


@register("save_and_load", "SELECT c_custkey::VARCHAR AS key, c_name AS value, (c_nationkey % 4)::INT AS db FROM customer WHERE c_nationkey % 4 = 2")
def save_and_load(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("value"), (F.col("c_nationkey") % 4).cast("int").alias("db"))
    folder = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    snapshot.save({"string": rows}, folder)
    # one database is one folder of the snapshot: only that is read
    return snapshot.load(spark, folder, ["string"])["string"].where("db = 2")


# Paging and channels


@register("scan_after", C + "SELECT key, value FROM c WHERE key > 'customer:2' ORDER BY key LIMIT 50")
def scan_after(spark, sf_dir):
    return keyspace.page_after(keys.strings(spark, sf_dir), "customer:2", 50)


@register("pubsub_any_ends", "SELECT DISTINCT event_type || '.' || user_id AS channel, 'ann' AS client, '*r*.[0-4]*' AS pattern FROM events WHERE regexp_full_match(event_type || '.' || user_id, '.*r.*\\.[0-4].*') UNION ALL SELECT DISTINCT event_type || '.' || user_id, 'bob', '*' FROM events UNION ALL SELECT DISTINCT event_type || '.' || user_id, 'cy', '?????.*7' FROM events WHERE regexp_full_match(event_type || '.' || user_id, '.....\\..*7')")
def pubsub_any_ends(spark, sf_dir):
    patterns = spark.createDataFrame([("ann", "*r*.[0-4]*"), ("bob", "*"), ("cy", "?????.*7")], "client string, pattern string")
    channels = table(spark, sf_dir, "events").select(F.concat_ws(".", "event_type", "user_id").alias("channel"))
    return pubsub.matches(channels, patterns)


@register("pubsub_numpat", "SELECT 3::BIGINT AS n")
def pubsub_numpat(spark, sf_dir):
    return pubsub.pattern_count(spark.createDataFrame([("a", "x.*"), ("b", "x.*"), ("b", "?"), ("c", "*"), ("d", None)], "client string, pattern string"))


@register("spublish", "WITH m AS (SELECT event_id, event_type || '.' || user_id AS channel FROM events), s AS (SELECT * FROM (VALUES ('ann', 'click.1'), ('bob', 'click.1'), ('bob', 'view.2')) s(client, channel)) SELECT event_id, channel, client, (" + keys._crc_sql().replace("c_name", "channel") + " % 16384)::BIGINT AS slot FROM m JOIN s USING (channel)")
def spublish(spark, sf_dir):
    messages = table(spark, sf_dir, "events").select("event_id", F.concat_ws(".", "event_type", "user_id").alias("channel"))
    subs = spark.createDataFrame([("ann", "click.1"), ("bob", "click.1"), ("bob", "view.2")], "client string, channel string")
    return pubsub.shard_routed(messages, subs).select("event_id", "channel", "client", F.col("slot").cast("long").alias("slot"))
