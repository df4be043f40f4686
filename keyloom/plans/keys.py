"""Strings, the keyspace, expiry, eviction, logs, slots: customers as strings, users with an expiry after their last event."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.functions import lcs, values
from keyloom.operators import keyspace as ops
from keyloom.plans.registry import register, table
from keyloom.sources import snapshot

#: The moment (ms) at which the queries on expiry look: 25 January 2024.
NOW = 1_706_140_800_000

E = f"WITH e AS (SELECT user_id::VARCHAR AS key, max(epoch_us(ts) // 1000 + floor(value * 1000)::BIGINT * 600) AS expires_at, max(epoch_us(ts) // 1000) AS last_access, count(*)::BIGINT AS frequency, sum(length(props))::BIGINT AS size FROM events GROUP BY ALL), k AS (SELECT key, CASE WHEN key::BIGINT % 5 = 0 THEN NULL ELSE expires_at END AS expires_at, last_access, frequency, size FROM e) "


def millis(ts):
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    at = F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone())
    return F.floor(F.unix_micros(at) / 1000).cast("long")


def users(spark, sf_dir):
    at = millis(F.col("ts"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), at.alias("at"), "value", F.char_length("props").alias("size"))
    grown = e.groupBy("key").agg(F.max(F.col("at") + F.floor(F.col("value") * 1000).cast("long") * 600).alias("expires_at"), F.max("at").alias("last_access"), F.count(F.lit(1)).alias("frequency"), F.sum("size").cast("long").alias("size"))
    return grown.withColumn("expires_at", F.when(F.col("key").cast("long") % 5 != 0, F.col("expires_at")))


def strings(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("key"), F.col("c_name").alias("value"))


def value_log(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), F.col("value").cast("decimal(18,4)").alias("delta"), F.col("props").alias("value"))


C = "WITH c AS (SELECT 'customer:' || c_custkey AS key, c_name AS value FROM customer) "


@register("mget", C + "SELECT w.pos::INT AS pos, w.key, c.value FROM (VALUES (0, 'customer:3'), (1, 'missing'), (2, 'customer:1')) w(pos, key) LEFT JOIN c USING (key)")
def mget(spark, sf_dir):
    return ops.ordered_get(strings(spark, sf_dir), ["customer:3", "missing", "customer:1"]).select("pos", "key", "value")


@register("getrange", C + "SELECT key, substring(value, greatest(length(value) - 6, 0) + 1, 5) AS part FROM c")
def getrange(spark, sf_dir):
    part = values.byte_range(F.encode("value", "UTF-8"), -6, -2)
    return strings(spark, sf_dir).select("key", F.decode(part, "UTF-8").alias("part"))


@register("setrange", C + "SELECT key, substring(value, 1, 4) || 'XY' || substring(value, 7) AS value FROM c")
def setrange(spark, sf_dir):
    new = ops.set_range(F.encode("value", "UTF-8"), 4, b"XY")
    return strings(spark, sf_dir).select("key", F.decode(new, "UTF-8").alias("value"))


@register("strlen", "SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents")
def strlen(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n"))


@register("append_places", "SELECT event_type AS key, event_id AS seq, (sum(length(props)) OVER w)::BIGINT AS length, (sum(length(props)) OVER w - length(props))::BIGINT AS at FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)")
def append_places(spark, sf_dir):
    return ops.append_places(value_log(spark, sf_dir).select("key", "seq", "value")).select("key", "seq", "length", F.col("at").cast("long").alias("at"))


@register("append_fold", "SELECT o_custkey::VARCHAR AS key, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS value FROM orders GROUP BY ALL")
def append_fold(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("value"))
    return ops.appended(log)


@register("incrby_running", "SELECT event_type AS key, event_id AS seq, (sum(value::DECIMAL(18,4)) OVER (PARTITION BY event_type ORDER BY event_id))::DOUBLE AS value FROM events")
def incrby_running(spark, sf_dir):
    log = value_log(spark, sf_dir).select("key", "seq", "delta")
    return ops.running(log).select("key", "seq", F.col("value").cast("double").alias("value"))


@register("incrbyfloat", "SELECT event_type AS key, (sum(value::DECIMAL(18,4)))::DOUBLE AS value FROM events GROUP BY ALL")
def incrbyfloat(spark, sf_dir):
    return ops.counted(value_log(spark, sf_dir)).select("key", F.col("value").cast("double").alias("value"))


@register("getset_lag", "SELECT event_type AS key, event_id AS seq, props AS value, lag(props) OVER (PARTITION BY event_type ORDER BY event_id) AS old FROM events")
def getset_lag(spark, sf_dir):
    return ops.swap_values(value_log(spark, sf_dir).select("key", "seq", "value"))


@register("set_latest", "SELECT event_type AS key, arg_max(props, event_id) AS value FROM events GROUP BY ALL")
def set_latest(spark, sf_dir):
    return ops.latest(value_log(spark, sf_dir), ["key"])


@register("setnx_first", "SELECT event_type AS key, arg_min(props, event_id) AS value FROM events GROUP BY ALL")
def setnx_first(spark, sf_dir):
    return ops.earliest(value_log(spark, sf_dir), ["key"])


@register("set_xx", C + "SELECT key, CASE WHEN s.s_suppkey IS NULL THEN value ELSE s.s_name END AS value FROM c LEFT JOIN supplier s ON c.key = 'customer:' || s.s_suppkey")
def set_xx(spark, sf_dir):
    new = table(spark, sf_dir, "supplier").select(F.concat(F.lit("customer:"), "s_suppkey").alias("key"), F.col("s_name").alias("value"))
    return ops.upsert(strings(spark, sf_dir), new, ["key"], "xx")


@register("msetnx", C + "SELECT * FROM c")
def msetnx(spark, sf_dir):
    new = spark.createDataFrame([("customer:1", "x"), ("brand new", "y")], "key string, value string")
    return ops.upsert_all_or_none(strings(spark, sf_dir), new, ["key"])


@register("exists_count", "SELECT count(*)::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey")
def exists_count(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").select(F.concat(F.lit("customer:"), "o_custkey").alias("key"))
    return ops.existing(strings(spark, sf_dir), wanted, ["key"]).agg(F.count(F.lit(1)).alias("n"))


@register("del_keys", C + "SELECT c.* FROM c WHERE key NOT IN (SELECT 'customer:' || o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def del_keys(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("customer:"), "o_custkey").alias("key")).distinct()
    return ops.removed(strings(spark, sf_dir), gone, ["key"])


@register("rename_keys", C + "SELECT CASE WHEN key = 'customer:1' THEN 'customer:2' WHEN key = 'customer:3' THEN 'moved' ELSE key END AS key, value FROM c WHERE key <> 'customer:2'")
def rename_keys(spark, sf_dir):
    names = spark.createDataFrame([("customer:1", "customer:2"), ("customer:3", "moved"), ("missing", "customer:4")], "key string, new string")
    return ops.renamed(strings(spark, sf_dir), names)


@register("copy_keys", C + "SELECT * FROM c UNION ALL SELECT 'copy', value FROM c WHERE key = 'customer:1'")
def copy_keys(spark, sf_dir):
    names = spark.createDataFrame([("customer:1", "copy"), ("customer:3", "customer:2")], "key string, new string")
    return ops.copied(strings(spark, sf_dir), names)


@register("swapdb", "SELECT c_custkey AS key, CASE c_nationkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END::INT AS db FROM customer")
def swapdb(spark, sf_dir):
    state = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_nationkey") % 3).cast("int").alias("db"))
    return ops.swapped(state, 0, 1)


@register("move_keys", "SELECT c_custkey::VARCHAR AS key, CASE WHEN c_custkey IN (1, 2, 5) THEN 9 ELSE 0 END::INT AS db FROM customer")
def move_keys(spark, sf_dir):
    state = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.lit(0).alias("db"))
    return ops.moved(state, spark.createDataFrame([("1",), ("2",), ("5",), ("missing",)], "key string"), 9)


@register("keys_glob", C + "SELECT * FROM c WHERE regexp_full_match(key, 'customer:1.*7.')")
def keys_glob(spark, sf_dir):
    return ops.matching(strings(spark, sf_dir), "customer:1*7?")


@register("scan_page", C + "SELECT key FROM c ORDER BY key LIMIT 25 OFFSET 50")
def scan_page(spark, sf_dir):
    return ops.page(strings(spark, sf_dir), 50, 25).select("key")


@register("type_conflicts", "SELECT c_custkey::VARCHAR AS key, 'hash,string' AS types FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier)")
def type_conflicts(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("key"))
    return ops.type_conflicts({"string": a, "hash": b}).select("key", F.array_join("types", ",").alias("types"))


@register("memory_usage", "SELECT o_custkey::VARCHAR AS key, sum(length(o_custkey::VARCHAR) + length(o_orderpriority) + 64)::BIGINT AS bytes FROM orders GROUP BY ALL")
def memory_usage(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderpriority").alias("value"))
    return ops.memory_usage(rows, ["key", "value"])


@register("object_encoding", "SELECT key, type, CASE type WHEN 'zset' THEN 'skiplist' WHEN 'set' THEN 'hashtable' ELSE 'raw' END AS encoding FROM (SELECT DISTINCT event_type AS key, CASE event_type WHEN 'click' THEN 'zset' WHEN 'view' THEN 'set' ELSE 'string' END AS type FROM events)")
def object_encoding(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "zset").when(F.col("event_type") == "view", "set").otherwise("string")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), kind.alias("type")).distinct()
    return rows.withColumn("encoding", ops.encoding(F.col("type")))


@register("lcs")
def longest_common(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return lcs.with_lcs(part, "p_name", "p_type")


# Expiry and eviction


@register("ttl_remaining", E + f"SELECT w.key, CASE WHEN k.key IS NULL THEN -2 WHEN expires_at IS NULL THEN -1 ELSE expires_at - {NOW} END::BIGINT AS pttl, CASE WHEN k.key IS NULL THEN -2 WHEN expires_at IS NULL THEN -1 ELSE (expires_at - {NOW}) // 1000 END::BIGINT AS ttl FROM (SELECT c_custkey::VARCHAR AS key FROM customer) w LEFT JOIN (SELECT * FROM k WHERE expires_at IS NULL OR expires_at > {NOW}) k USING (key)")
def ttl_remaining(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    return ops.remaining(users(spark, sf_dir), wanted, NOW)


@register("live_keys_asof", E + f"SELECT key, expires_at FROM k WHERE expires_at IS NULL OR expires_at > {NOW}")
def live_keys_asof(spark, sf_dir):
    return ops.live(users(spark, sf_dir), NOW).select("key", "expires_at")


def _expire(name, condition, sql):
    def run(spark, sf_dir):
        ttls = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), (F.col("c_nationkey").cast("long") * 7_200_000 - 3_600_000).alias("ttl_ms"))
        return ops.expire(users(spark, sf_dir), ttls, NOW, condition).select("key", "expires_at")

    new = f"{NOW} + c.c_nationkey::BIGINT * 7200000 - 3600000"
    register(name, E + f"SELECT key, CASE WHEN c.c_custkey IS NOT NULL AND c.c_nationkey > 0 AND ({sql.format(new=new)}) THEN {new} ELSE expires_at END::BIGINT AS expires_at FROM k LEFT JOIN customer c ON k.key = c.c_custkey::VARCHAR WHERE expires_at IS NULL OR expires_at > {NOW}")(run)


_expire("expire_always", "", "true")
_expire("expire_cond_nx", "nx", "expires_at IS NULL")
_expire("expire_cond_gt", "gt", "expires_at < {new}")
_expire("expire_cond_lt", "lt", "expires_at > {new}")


@register("persist_keys", E + "SELECT key, CASE WHEN key::BIGINT < 50 THEN NULL ELSE expires_at END AS expires_at FROM k")
def persist_keys(spark, sf_dir):
    state = users(spark, sf_dir)
    return ops.persist(state, state.where("CAST(key AS BIGINT) < 50").select("key")).select("key", "expires_at")


def _evict(name, policy, order):
    register(name, E + f", r AS (SELECT *, (sum(size) OVER (ORDER BY {order}, size DESC, key ROWS UNBOUNDED PRECEDING))::BIGINT AS freed FROM k {'WHERE expires_at IS NOT NULL' if policy == 'ttl' else ''}) SELECT key, freed FROM r WHERE freed - size < 20000")(lambda spark, d: ops.victims(users(spark, d), 20_000, policy).select("key", F.col("freed").cast("long").alias("freed")))


_evict("evict_lru", "lru", "last_access")
_evict("evict_lfu", "lfu", "frequency")
_evict("evict_ttl", "ttl", "expires_at")


@register("keyspace_info", E + f"SELECT (key::BIGINT % 4)::INT AS db, count(*)::BIGINT AS keys, count(expires_at)::BIGINT AS expires, coalesce(floor(avg(expires_at - {NOW})), 0)::BIGINT AS avg_ttl FROM k WHERE expires_at IS NULL OR expires_at > {NOW} GROUP BY ALL")
def keyspace_info(spark, sf_dir):
    state = users(spark, sf_dir).withColumn("db", (F.col("key").cast("long") % 4).cast("int"))
    return snapshot.keyspace_info({"string": state}, NOW)


# Logs


def mutations(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "DEL").when(F.col("event_type") == "signup", "SETNX").otherwise("SET")
    return e.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.lit(0).alias("db"), op.alias("op"), F.col("user_id").cast("string").alias("key"), F.lit(None).cast("string").alias("member"), F.lit(None).cast("double").alias("num"), F.col("props").alias("value"))


LOG = "WITH l AS (SELECT event_id AS seq, user_id::VARCHAR AS key, CASE event_type WHEN 'error' THEN 'DEL' WHEN 'signup' THEN 'SETNX' ELSE 'SET' END AS op, props AS value FROM events), d AS (SELECT l.*, coalesce(max(CASE WHEN op = 'DEL' THEN seq END) OVER (PARTITION BY key), -1) AS gone FROM l), w AS (SELECT * FROM d WHERE op <> 'DEL' AND seq > gone), s AS (SELECT key, coalesce(arg_max(value, seq) FILTER (op = 'SET'), arg_min(value, seq)) AS value, max(seq) AS seq FROM w GROUP BY key) "


@register("replay_log", LOG + "SELECT 0::INT AS db, key, value FROM s")
def replay_log(spark, sf_dir):
    return snapshot.replay_strings(mutations(spark, sf_dir))


@register("compact_log", LOG + "SELECT l.seq, 'SET' AS op, s.key, s.value FROM s JOIN (SELECT key, max(seq) AS seq FROM l WHERE op <> 'DEL' GROUP BY key) l USING (key)")
def compact_log(spark, sf_dir):
    return snapshot.compacted(mutations(spark, sf_dir)).select("seq", "op", "key", "value")


# Slots

CRC = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_name, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: " + "{})"


def _crc_sql() -> str:
    """The checksum as nested bit steps over list_reduce, byte by byte."""
    step = "xor(c, b << 8)"
    for _ in range(8):
        step = f"list_extract(list_transform([{step}], lambda v: CASE WHEN (v & 32768) <> 0 THEN xor((v << 1) & 65535, 4129) ELSE (v << 1) & 65535 END), 1)"
    return CRC.format(step)


@register("keyslot", f"SELECT c_custkey, ({_crc_sql()} % 16384)::BIGINT AS slot FROM customer")
def keyslot(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", values.slot(F.col("c_name")).cast("long").alias("slot"))


@register("slot_stats", f"SELECT slot // 1024 AS node, count(*)::BIGINT AS keys, count(DISTINCT slot)::BIGINT AS slots FROM (SELECT ({_crc_sql()} % 16384)::BIGINT AS slot FROM customer) GROUP BY ALL")
def slot_stats(spark, sf_dir):
    slots = table(spark, sf_dir, "customer").select(values.slot(F.col("c_name")).cast("long").alias("slot"))
    return slots.groupBy(F.floor(F.col("slot") / 1024).cast("long").alias("node")).agg(F.count(F.lit(1)).alias("keys"), F.count_distinct("slot").alias("slots"))


@register("dbsize", E + f"SELECT count(*)::BIGINT AS n FROM k WHERE expires_at IS NULL OR expires_at > {NOW}")
def dbsize(spark, sf_dir):
    return ops.live(users(spark, sf_dir), NOW).agg(F.count(F.lit(1)).alias("n"))


@register("dump_restore", C + "SELECT * FROM c")
def dump_restore(spark, sf_dir):
    return snapshot.restored(snapshot.dumped(strings(spark, sf_dir)), "key string, value string")
