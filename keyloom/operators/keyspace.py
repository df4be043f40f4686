"""Strings and the keyspace: logs folded to the latest state, guarded upserts, counters, renames, paging, expiry.

A log has (key, seq, value); the state has (key, value[, expires_at in ms]). Folds are aggregates with partial sums,
so a hot key costs each task one row. ``now`` is a parameter everywhere: results do not depend on the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.values import glob
from keyloom.operators.ordering import numbered
from keyloom.sources.shared import checkpointed

#: How each type of value is kept.
ENCODINGS = {"string": "raw", "hash": "hashtable", "list": "quicklist", "set": "hashtable", "zset": "skiplist", "geo": "skiplist", "stream": "stream"}


def latest(log: DataFrame, keys: list[str], value: str = "value", seq: str = "seq") -> DataFrame:
    """SET, MSET, HSET: the last value of each key."""
    return log.groupBy(*keys).agg(F.max_by(value, seq).alias(value))


def earliest(log: DataFrame, keys: list[str], value: str = "value", seq: str = "seq") -> DataFrame:
    """SETNX, HSETNX: the first value stays."""
    return log.groupBy(*keys).agg(F.min_by(value, seq).alias(value))


def upsert(state: DataFrame, new: DataFrame, keys: list[str], guard: str = "") -> DataFrame:
    """New rows over old ones; guard ``nx`` writes only absent keys, ``xx`` only present ones."""
    if guard == "nx":
        return state.unionByName(new.join(state, keys, "left_anti"))
    if guard == "xx":
        new = new.join(state, keys, "left_semi")
    return state.join(new, keys, "left_anti").unionByName(new)


def upsert_all_or_none(state: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """MSETNX: nothing is written if any key is there."""
    clash = new.join(state, keys, "left_semi").limit(1).agg(F.count(F.lit(1)).alias("_clash"))
    kept = new.join(F.broadcast(clash), F.col("_clash") == 0).drop("_clash")
    return state.unionByName(kept)


def swap_values(log: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """GETSET: each write with the value it replaced."""
    rows = checkpointed(numbered(log, [key], [seq], "_i"))
    old = rows.select(key, (F.col("_i") + 1).alias("_i"), F.col("value").alias("old"))
    return rows.join(old, [key, "_i"], "left").drop("_i")


def appended(log: DataFrame, seq: str = "seq") -> DataFrame:
    """APPEND: parts joined in order; a value is one cell, so it has to fit a row. ``append_places`` has no such bound."""
    parts = F.array_sort(F.collect_list(F.struct(seq, "value")))
    return log.groupBy("key").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "").alias("value"))


def append_places(log: DataFrame, seq: str = "seq") -> DataFrame:
    """APPEND without building the values: each part with its byte offset, and the reply, the length after it."""
    rows = numbered(log, ["key"], [seq], "_i", {"length": F.octet_length("value").cast("long")})
    return rows.withColumn("at", F.col("length") - F.octet_length("value")).drop("_i")


def running(log: DataFrame, delta: str = "delta", seq: str = "seq", name: str = "value") -> DataFrame:
    """INCRBY and its kin, reply by reply: each step with the counter after it."""
    return numbered(log, ["key"], [seq], "_i", {name: F.col(delta)}).drop("_i")


def counted(log: DataFrame, delta: str = "delta", keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """INCR, DECR, INCRBY, INCRBYFLOAT, HINCRBY: sums of the steps; a key that is absent starts at 0."""
    return log.groupBy(*keys).agg(F.sum(delta).alias("value"))


def set_range(value: Column, offset: int, new: bytes) -> Column:
    """SETRANGE on binary: padded with zero bytes, then overwritten."""
    n, size = F.octet_length(value), len(new)
    head = F.concat(F.substring(value, 1, offset), F.unhex(F.repeat(F.lit("00"), F.greatest(F.lit(offset) - n, F.lit(0)))))
    return F.concat(head, F.lit(new), F.when(n > offset + size, F.substring(value, F.lit(offset + size + 1), n - offset - size)).otherwise(F.lit(b"")))


def ordered_get(state: DataFrame, wanted: list[str], key: str = "key") -> DataFrame:
    """MGET, HMGET, ZMSCORE, GEOPOS: a row for each wanted key in order, nulls where it is absent."""
    rows = state.sparkSession.createDataFrame(list(enumerate(wanted)), f"pos int, {key} string")
    return rows.join(state, key, "left")


def removed(state: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """DEL, UNLINK, HDEL, SREM, ZREM, XDEL, XACK."""
    return state.join(gone, keys, "left_anti")


def existing(state: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """EXISTS, TOUCH: the wanted rows that are there; a key asked for twice counts twice."""
    return wanted.join(state, keys, "left_semi")


def renamed(state: DataFrame, names: DataFrame, only_new: bool = False) -> DataFrame:
    """RENAME, RENAMENX for pairs (key, new): rows move to the new key and replace what was there."""
    if only_new:
        names = names.join(state.select(F.col("key").alias("new")), "new", "left_anti").select("key", "new")
    live = names.join(state.select("key").distinct(), "key", "left_semi")
    rest = state.join(live.select(F.col("new").alias("key")), "key", "left_anti")
    moved = rest.join(live, "key", "left").withColumn("key", F.coalesce("new", "key")).drop("new")
    over = state.join(live.select(F.col("new").alias("key")), "key", "left_semi").join(live, "key")
    return moved.unionByName(over.withColumn("key", F.col("new")).drop("new"))


def copied(state: DataFrame, names: DataFrame, replace: bool = False) -> DataFrame:
    """COPY for pairs (key, new); without ``replace`` only to keys that are absent."""
    copies = state.join(names, "key").withColumn("key", F.col("new")).drop("new")
    if not replace:
        return state.unionByName(copies.join(state.select("key").distinct(), "key", "left_anti"))
    return state.join(copies.select("key").distinct(), "key", "left_anti").unionByName(copies)


def moved(state: DataFrame, keys: DataFrame, db: int) -> DataFrame:
    """MOVE: keys go to another database unless it has them."""
    there = state.where(F.col("db") == db).select("key")
    going = keys.join(there, "key", "left_anti").select("key", F.lit(True).alias("_go"))
    return state.join(going, "key", "left").withColumn("db", F.when(F.col("_go"), F.lit(db)).otherwise(F.col("db"))).drop("_go")


def swapped(state: DataFrame, a: int, b: int) -> DataFrame:
    """SWAPDB."""
    return state.withColumn("db", F.when(F.col("db") == a, b).when(F.col("db") == b, a).otherwise(F.col("db")))


def matching(state: DataFrame, pattern: str) -> DataFrame:
    """KEYS: only ``*`` and ``?`` are special."""
    return state.where(glob(F.col("key"), pattern))


def page(rows: DataFrame, cursor: int, count: int = 10, pattern: str | None = None, by: str = "key") -> DataFrame:
    """SCAN, HSCAN, SSCAN, ZSCAN: rows in order of ``by`` from the cursor on, those of the page that match."""
    found = rows.orderBy(by).offset(cursor).limit(count)
    return found if pattern is None else found.where(glob(F.col(by), pattern))


def page_after(rows: DataFrame, last: str | None, count: int = 10, pattern: str | None = None, by: str = "key") -> DataFrame:
    """SCAN and its kin, going on from the last value seen instead of a number: the condition reaches the scan, and a page costs the same wherever it is."""
    rest = rows if last is None else rows.where(F.col(by) > last)
    found = rest.orderBy(by).limit(count)
    return found if pattern is None else found.where(glob(F.col(by), pattern))


def type_conflicts(parts: dict[str, DataFrame]) -> DataFrame:
    """WRONGTYPE: keys that are held with more than one type."""
    rows = None
    for kind, df in parts.items():
        own = df.select("key").distinct().withColumn("type", F.lit(kind))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("key").agg(F.array_sort(F.collect_set("type")).alias("types")).where(F.size("types") > 1)


def encoding(kind: Column) -> Column:
    """OBJECT ENCODING of a type."""
    out = F.lit(None).cast("string")
    for k, v in ENCODINGS.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def memory_usage(rows: DataFrame, columns: list[str], per_row: int = 64) -> DataFrame:
    """MEMORY USAGE: bytes of the values and an overhead a row, by key."""
    size = sum((F.octet_length(c) for c in columns[1:]), F.octet_length(columns[0])) + per_row
    return rows.groupBy("key").agg(F.sum(size.cast("long")).alias("bytes"))


# Expiry


def live(state: DataFrame, now: int) -> DataFrame:
    """GET, SWEEP, DBSIZE: rows that have not expired at ``now`` (ms)."""
    return state.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def remaining(state: DataFrame, wanted: DataFrame, now: int) -> DataFrame:
    """TTL and PTTL of wanted keys: -2 absent, -1 without expiry, else ms and whole seconds."""
    at = live(state, now).withColumn("_here", F.lit(True))
    left = F.col("expires_at") - F.lit(now)
    ms = F.when(F.col("_here").isNull(), -2).when(F.col("expires_at").isNull(), -1).otherwise(left)
    seconds = F.when(ms < 0, ms).otherwise(F.floor(ms / 1000))
    return wanted.join(at, "key", "left").select("key", ms.cast("long").alias("pttl"), seconds.cast("long").alias("ttl"))


def expire(state: DataFrame, ttls: DataFrame, now: int, condition: str = "") -> DataFrame:
    """EXPIRE family for (key, ttl_ms): ``nx`` without, ``xx`` with an expiry; ``gt`` and ``lt`` need one to compare with.

    A negative time is refused, so the row stays as it is.
    """
    both = live(state, now).join(ttls, "key", "left")
    new, old = F.lit(now) + F.col("ttl_ms"), F.col("expires_at")
    allowed = {"": F.lit(True), "nx": old.isNull(), "xx": old.isNotNull(), "gt": new > old, "lt": new < old}[condition]
    write = F.col("ttl_ms").isNotNull() & (F.col("ttl_ms") >= 0) & F.coalesce(allowed, F.lit(False))
    return both.withColumn("expires_at", F.when(write, new).otherwise(old)).drop("ttl_ms")


def persist(state: DataFrame, keys: DataFrame) -> DataFrame:
    """PERSIST."""
    gone = keys.select("key", F.lit(True).alias("_p"))
    return state.join(gone, "key", "left").withColumn("expires_at", F.when(F.col("_p").isNull(), F.col("expires_at"))).drop("_p")


def set_expiring(state: DataFrame, new: DataFrame, now: int, guard: str = "", keep_ttl: bool = False) -> DataFrame:
    """SET with EX, PX, NX, XX, KEEPTTL; SETEX, PSETEX: ``new`` is (key, value, ttl_ms), null for no expiry.

    What has expired at ``now`` is not there. With ``keep_ttl`` a key keeps the expiry that it has.
    """
    alive = live(state, now)
    own = new.withColumn("expires_at", F.lit(now) + F.col("ttl_ms")).select("key", "value", "expires_at")
    if keep_ttl:
        held = alive.select("key", F.col("expires_at").alias("_old"))
        own = own.join(held, "key", "left").select("key", "value", F.col("_old").alias("expires_at"))
    return upsert(alive.select("key", "value", "expires_at"), own, ["key"], guard)


def get_expiring(state: DataFrame, ttls: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """GETEX for (key, ttl_ms), null for PERSIST: the values read, and the state with the new expiries."""
    alive = live(state, now)
    asked = ttls.select("key", F.col("ttl_ms").alias("_ttl"), F.lit(True).alias("_asked"))
    after = alive.join(asked, "key", "left").withColumn("expires_at", F.when(F.col("_asked"), F.lit(now) + F.col("_ttl")).otherwise(F.col("expires_at"))).drop("_ttl", "_asked")
    return alive.join(ttls.select("key"), "key", "left_semi"), after


def taken(state: DataFrame, wanted: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """GETDEL, HGETDEL: the wanted rows that are there, and the state without them."""
    return state.join(wanted, keys, "left_semi"), state.join(wanted, keys, "left_anti")


def expire_at(state: DataFrame, times: DataFrame, now: int) -> DataFrame:
    """EXPIREAT, PEXPIREAT for (key, at_ms): a time that has passed removes the key."""
    both = live(state, now).join(times, "key", "left")
    return both.where(F.col("at_ms").isNull() | (F.col("at_ms") > now)).withColumn("expires_at", F.coalesce("at_ms", "expires_at")).drop("at_ms")


def expire_times(state: DataFrame, wanted: DataFrame, now: int) -> DataFrame:
    """EXPIRETIME and PEXPIRETIME of wanted keys: -2 absent, -1 without expiry, else ms and whole seconds since 1970."""
    at = live(state, now).select("key", F.coalesce("expires_at", F.lit(-1)).alias("_at"))
    ms = F.coalesce("_at", F.lit(-2)).cast("long")
    return wanted.join(at, "key", "left").select("key", ms.alias("pexpiretime"), F.when(ms < 0, ms).otherwise(F.floor(ms / 1000)).cast("long").alias("expiretime"))


def swept(state: DataFrame, now: int, one_in: int, seed: int = 0) -> DataFrame:
    """Active expiry: of the keys with an expiry a sample (one in so many, by hash) is looked at, and the expired of it go."""
    looked = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(one_in)) == 0
    gone = looked & (F.col("expires_at") <= now)
    return state.where(F.col("expires_at").isNull() | ~gone)


def types(parts: dict[str, DataFrame], wanted: DataFrame) -> DataFrame:
    """TYPE of wanted keys: the type's name, ``none`` for an absent key."""
    held = None
    for kind, rows in parts.items():
        own = rows.select("key").distinct().withColumn("_type", F.lit(kind))
        held = own if held is None else held.unionByName(own)
    return wanted.join(held, "key", "left").select("key", F.coalesce("_type", F.lit("none")).alias("type"))


def random_key(state: DataFrame, seed: int = 0) -> DataFrame:
    """RANDOMKEY: the key with the least seeded hash; every task keeps one."""
    return state.select("key").distinct().orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(1)


def incremented(state: DataFrame, log: DataFrame) -> DataFrame:
    """INCR and DECR with the range of 64 bits: an increment that leaves it is refused, and the key stays as it was.

    ``state`` is (key, value long), ``log`` (key, delta long), one step a key; absent keys start at 0.
    """
    both = state.join(log, "key", "full_outer")
    total = F.coalesce("value", F.lit(0)).cast("decimal(20,0)") + F.coalesce("delta", F.lit(0)).cast("decimal(20,0)")
    return both.select("key", F.when(total.between(F.lit(-(2**63)), F.lit(2**63 - 1)), total.cast("long")).otherwise(F.col("value")).alias("value"))


def object_info(state: DataFrame, now: int) -> DataFrame:
    """OBJECT IDLETIME and FREQ: whole seconds since the last access, and how often a key was asked for."""
    return state.select("key", F.floor((F.lit(now) - F.col("last_access")) / 1000).cast("long").alias("idletime"), F.col("frequency").alias("freq"))


def lfu_decayed(counter: Column, last_minute: Column, now_minute: Column, decay_minutes: int) -> Column:
    """LFU counter now: one less for every ``decay_minutes`` since it was last decreased; minutes are 16 bits and wrap."""
    gap = F.when(now_minute >= last_minute, now_minute - last_minute).otherwise(65535 - last_minute + now_minute)
    return counter if decay_minutes == 0 else F.greatest(F.lit(0), counter - F.floor(gap / decay_minutes).cast("int"))


# Eviction


def victims(state: DataFrame, needed: int, policy: str) -> DataFrame:
    """Keys to evict until ``needed`` bytes are free: lru (ties: larger first), lfu, ttl, or random (by hash); ties by key at last."""
    first = {"lru": "last_access", "lfu": "frequency", "ttl": "expires_at", "random": "_random"}[policy]
    rows = state.where(F.col(first).isNotNull()) if policy == "ttl" else state.withColumn("_random", F.crc32("key")) if policy == "random" else state
    ranked = numbered(rows.withColumn("_all", F.lit(0)), ["_all"], [F.col(first), F.desc("size"), F.col("key")], "rank", {"freed": F.col("size")})
    return ranked.where(F.col("freed") - F.col("size") < needed).drop("_all")
