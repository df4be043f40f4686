"""Snapshots and logs: typed tables as Parquet partitioned by database, mutation logs as JSON lines, and compaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators.ordering import numbered

#: One row of a mutation log.
LOG = "seq long, ts timestamp, db int, op string, key string, member string, num double, value string"


def save(tables: dict[str, DataFrame], folder: str) -> None:
    """SAVE, BGSAVE: a folder for each type, partitioned by db where there is one."""
    for kind, rows in tables.items():
        writer = rows.write.mode("overwrite")
        (writer.partitionBy("db") if "db" in rows.columns else writer).parquet(f"{folder}/{kind}")


def load(spark: SparkSession, folder: str, kinds: list[str]) -> dict[str, DataFrame]:
    """The tables of a snapshot; selecting a db prunes to its partition."""
    return {kind: spark.read.parquet(f"{folder}/{kind}") for kind in kinds}


def append_log(ops: DataFrame, folder: str) -> None:
    """Appends mutations as JSON lines."""
    ops.write.mode("append").json(folder)


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(LOG).json(folder)


def stream_log(spark: SparkSession, folder: str) -> DataFrame:
    """The log as a stream: new files are new mutations, and the query's checkpoint is the offset."""
    return spark.readStream.schema(LOG).json(folder)


def replay_strings(log: DataFrame) -> DataFrame:
    """State (db, key, value) after SET, SETNX, APPEND-free DEL and FLUSHDB in order of seq.

    What counts is the last write after the last removal; SETNX is the first write after it. All by aggregates that
    every task starts on its own rows.
    """
    flush = log.where("op = 'FLUSHDB'").groupBy("db").agg(F.max("seq").alias("_flushed"))
    own = log.where("op IN ('SET', 'SETNX', 'DEL')")
    gone = own.groupBy("db", "key").agg(F.max(F.when(F.col("op") == "DEL", F.col("seq"))).alias("_deleted"))
    # a flush is a row for each database, of which there are few
    reset = gone.join(F.broadcast(flush), "db", "left").select("db", "key", F.greatest("_deleted", "_flushed").alias("_reset"))
    left = own.where("op <> 'DEL'").join(reset, ["db", "key"]).where("_reset IS NULL OR seq > _reset")
    write = F.struct("seq", "value")
    state = left.groupBy("db", "key").agg(F.max(F.when(F.col("op") == "SET", write)).alias("_set"), F.min(write).alias("_first"))
    return state.select("db", "key", F.coalesce("_set", "_first")["value"].alias("value"))


def since_reset(log: DataFrame) -> DataFrame:
    """Rows of a log after the last removal of their key: DEL, FLUSHDB of its database, or FLUSHALL."""
    whole = log.where("op IN ('FLUSHDB', 'FLUSHALL')").groupBy(F.when(F.col("op") == "FLUSHDB", F.col("db")).alias("_db")).agg(F.max("seq").alias("_flushed"))
    gone = log.where("op = 'DEL'").groupBy("db", "key").agg(F.max("seq").alias("_deleted"))
    rows = log.where("op NOT IN ('DEL', 'FLUSHDB', 'FLUSHALL')")
    # a row for each database, and one for all of them
    one = whole.where("_db IS NOT NULL").withColumnRenamed("_db", "db")
    every = whole.where("_db IS NULL").agg(F.max("_flushed").alias("_all"))
    hit = rows.join(F.broadcast(one), "db", "left").join(F.broadcast(every)).join(gone, ["db", "key"], "left")
    reset = F.greatest("_flushed", "_all", "_deleted")
    return hit.where(reset.isNull() | (F.col("seq") > reset)).select(*log.columns)


def replay_members(log: DataFrame, put: str, remove: str) -> DataFrame:
    """State (db, key, member, num, value) after a log of ``put`` and ``remove`` (HSET and HDEL, SADD and SREM, ZADD and ZREM): each member's last row decides."""
    rows = since_reset(log).where(F.col("op").isin(put, remove))
    last = rows.groupBy("db", "key", "member").agg(F.max_by(F.struct("op", "num", "value"), "seq").alias("_l"))
    return last.where(F.col("_l.op") == put).select("db", "key", "member", F.col("_l.num").alias("num"), F.col("_l.value").alias("value"))


def replay_sums(log: DataFrame, put: str, add: str) -> DataFrame:
    """State (db, key, member, num) after ``put`` and ``add`` (SET and INCRBY, ZADD and ZINCRBY, HSET and HINCRBY): the last put and what was added since."""
    by = ["db", "key", "member"]
    rows = since_reset(log).where(F.col("op").isin(put, add)).withColumn("member", F.coalesce("member", F.lit("")))
    base = rows.where(F.col("op") == put).groupBy(*by).agg(F.max("seq").alias("_at"), F.max_by("num", "seq").alias("_base"))
    more = rows.join(base, by, "left").where((F.col("op") == add) & (F.col("_at").isNull() | (F.col("seq") > F.col("_at")))).groupBy(*by).agg(F.sum("num").alias("_more"))
    both = base.join(more, by, "full_outer")
    return both.select(*by, (F.coalesce("_base", F.lit(0.0)) + F.coalesce("_more", F.lit(0.0))).alias("num"))


def replay_lists(log: DataFrame) -> DataFrame:
    """State (db, key, pos, value) after RPUSH and LPUSH: positions grow to the right and fall to the left of 0."""
    rows = since_reset(log).where("op IN ('RPUSH', 'LPUSH')")
    ranked = numbered(rows, ["db", "key", "op"], ["seq"], "_i")
    return ranked.select("db", "key", F.when(F.col("op") == "RPUSH", F.col("_i")).otherwise(-F.col("_i") - 1).alias("pos"), "value")


def replay_expiries(log: DataFrame) -> DataFrame:
    """(db, key, expires_at) after SET, PEXPIREAT and PERSIST: a key's last of them decides, and SET or PERSIST leave none."""
    rows = since_reset(log).where("op IN ('SET', 'PEXPIREAT', 'PERSIST')")
    last = rows.groupBy("db", "key").agg(F.max_by(F.struct("op", "num"), "seq").alias("_l"))
    return last.where("_l.op = 'PEXPIREAT'").select("db", "key", F.col("_l.num").cast("long").alias("expires_at"))


def compacted(log: DataFrame) -> DataFrame:
    """BGREWRITEAOF: one SET for each live key, in the log's form."""
    state = replay_strings(log)
    last = log.where("op IN ('SET', 'SETNX')").groupBy("db", "key").agg(F.max("seq").alias("seq"), F.max_by("ts", "seq").alias("ts"))
    null = F.lit(None)
    return state.join(last, ["db", "key"]).select("seq", "ts", "db", F.lit("SET").alias("op"), "key", null.cast("string").alias("member"), null.cast("double").alias("num"), "value")


def keyspace_info(tables: dict[str, DataFrame], now: int) -> DataFrame:
    """INFO keyspace, DBSIZE: live keys, those that expire, and their mean time left (ms), by db."""
    rows = reduce(DataFrame.unionByName, (t.select("db", "key", "expires_at").distinct() for t in tables.values()))
    alive = rows.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return alive.groupBy("db").agg(F.count(F.lit(1)).alias("keys"), F.count("expires_at").alias("expires"), F.coalesce(F.floor(F.avg(F.col("expires_at") - now)), F.lit(0)).cast("long").alias("avg_ttl"))


def dumped(rows: DataFrame) -> DataFrame:
    """DUMP: key and one JSON text of its row, which RESTORE reads back by the schema."""
    return rows.select("key", F.to_json(F.struct(*rows.columns)).alias("dump"))


def restored(dumps: DataFrame, schema: str) -> DataFrame:
    """RESTORE: rows of the dumps that have the schema's form; a broken dump gives no row."""
    rows = dumps.select(F.from_json("dump", schema).alias("r")).where("r.key IS NOT NULL")
    return rows.select("r.*")
