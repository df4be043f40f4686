"""Bitmaps and cardinality sketches of users by event type."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import bitmaps, sketches
from keyloom.plans.registry import register, table

#: A user's bit is what the last of the user's events wrote: set where its value is below 60.
BITS = "WITH b AS (SELECT event_type AS key, user_id AS off FROM events GROUP BY ALL HAVING arg_max(value, event_id) < 60) "


def bits(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("off"), F.col("event_id").alias("seq"), (F.col("value") < 60).cast("int").alias("bit"))
    return bitmaps.setbit(log)


@register("setbit_fold", "SELECT event_type AS key, user_id AS off FROM events GROUP BY ALL HAVING arg_max(value, event_id) >= 100")
def setbit_fold(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("off"), F.col("event_id").alias("seq"), (F.col("value") >= 100).cast("int").alias("bit"))
    return bitmaps.setbit(log)


@register("getbit", BITS + "SELECT w.key, w.off, (b.off IS NOT NULL)::INT AS bit FROM (SELECT DISTINCT e.event_type AS key, c_custkey AS off FROM customer, (SELECT DISTINCT event_type FROM events) e) w LEFT JOIN b ON b.key = w.key AND b.off = w.off")
def getbit(spark, sf_dir):
    own = bits(spark, sf_dir)
    kinds = F.array(*(F.lit(k) for k in ("click", "view", "purchase", "signup", "error")))
    wanted = table(spark, sf_dir, "customer").select(F.explode(kinds).alias("key"), F.col("c_custkey").alias("off"))
    return bitmaps.getbit(own, wanted)


@register("bitcount", BITS + "SELECT key, count(*)::BIGINT AS n FROM b GROUP BY key")
def bitcount(spark, sf_dir):
    return bitmaps.bitcount(bits(spark, sf_dir))


@register("bitcount_range", BITS + "SELECT key, count(*)::BIGINT AS n FROM b WHERE off BETWEEN 8 AND 63 GROUP BY key")
def bitcount_range(spark, sf_dir):
    return bitmaps.bitcount(bits(spark, sf_dir), 8, 63)


@register("bitpos_set", BITS + "SELECT key, min(off) AS pos FROM b WHERE off >= 20 GROUP BY key")
def bitpos_set(spark, sf_dir):
    return bitmaps.bitpos_set(bits(spark, sf_dir), 20)


@register("bitpos_first0", BITS + ", r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY off) - 1 AS i FROM b) SELECT key, count(*) FILTER (i = off)::BIGINT AS pos FROM r GROUP BY key")
def bitpos_first0(spark, sf_dir):
    return bitmaps.bitpos_clear(bits(spark, sf_dir))


def _bitop(name, op, keys, sql):
    register(name, BITS + sql)(lambda spark, sf_dir: bitmaps.bitop(bits(spark, sf_dir), op, keys))


_bitop("bitop_and", "and", ["click", "view", "error"], "SELECT off FROM b WHERE key IN ('click', 'view', 'error') GROUP BY off HAVING count(*) = 3")
_bitop("bitop_or", "or", ["click", "view"], "SELECT DISTINCT off FROM b WHERE key IN ('click', 'view')")
_bitop("bitop_xor", "xor", ["click", "view", "error"], "SELECT off FROM b WHERE key IN ('click', 'view', 'error') GROUP BY off HAVING count(*) % 2 = 1")
_bitop("bitop_not", "not", ["click"], "SELECT off FROM (SELECT unnest(range(0, (SELECT max(off) // 8 + 1 FROM b WHERE key = 'click') * 8)) AS off) WHERE off NOT IN (SELECT off FROM b WHERE key = 'click')")


@register("bitfield_get", BITS + "SELECT key, sum(1 << (13 - off))::BIGINT AS value FROM b WHERE off BETWEEN 3 AND 13 GROUP BY key UNION ALL SELECT key, 0 FROM b GROUP BY key HAVING count(*) FILTER (off BETWEEN 3 AND 13) = 0")
def bitfield_get(spark, sf_dir):
    return bitmaps.to_binary(bits(spark, sf_dir), 64).select("key", bitmaps.bitfield_get(F.col("value"), 11, 3).alias("value"))


@register("bitfield_overflow", "SELECT l_orderkey, l_linenumber, least(127, l_quantity::BIGINT * 4)::BIGINT AS sat, ((l_quantity::BIGINT * 4 + 128) % 256 - 128)::BIGINT AS wrap, CASE WHEN l_quantity * 4 <= 127 THEN l_quantity::BIGINT * 4 END AS fail FROM lineitem")
def bitfield_overflow(spark, sf_dir):
    one, more = F.col("l_quantity").cast("long"), F.col("l_quantity").cast("long") * 3
    cols = [bitmaps.bitfield_add(one, more, 8, True, mode).cast("long").alias(mode) for mode in ("sat", "wrap", "fail")]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *cols)


@register("bitfield_i64", "SELECT l_orderkey, l_linenumber, least(9223372036854775807::HUGEINT, 9223372036854775800::HUGEINT + l_quantity::HUGEINT)::BIGINT AS sat, (CASE WHEN 9223372036854775800::HUGEINT + l_quantity::HUGEINT > 9223372036854775807 THEN 9223372036854775800::HUGEINT + l_quantity::HUGEINT - 18446744073709551616::HUGEINT ELSE 9223372036854775800::HUGEINT + l_quantity::HUGEINT END)::BIGINT AS wrap, (CASE WHEN l_quantity::HUGEINT <= 7 THEN 9223372036854775800::HUGEINT + l_quantity::HUGEINT END)::BIGINT AS fail FROM lineitem")
def bitfield_i64(spark, sf_dir):
    cols = [bitmaps.bitfield_add(F.lit(2**63 - 8), F.col("l_quantity").cast("long"), 64, True, mode).alias(mode) for mode in ("sat", "wrap", "fail")]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *cols)


@register("bitfield_get_i63", BITS + "SELECT key, (sum(CASE WHEN off = 0 THEN -(1::HUGEINT << 62) ELSE (1::HUGEINT << greatest(62 - off, 0)::INT) END) FILTER (off <= 62))::BIGINT AS value FROM b GROUP BY key")
def bitfield_get_i63(spark, sf_dir):
    return bitmaps.to_binary(bits(spark, sf_dir), 64).select("key", bitmaps.bitfield_get(F.col("value"), 63, 0, signed=True).alias("value"))


@register("bitfield_set", BITS + "SELECT key, off FROM b WHERE off NOT BETWEEN 5 AND 12 OR key NOT IN ('click', 'view') UNION ALL SELECT 'click', unnest([5, 8, 12]) UNION ALL SELECT 'view', unnest([5, 6, 7, 8, 9, 10, 11, 12])")
def bitfield_set(spark, sf_dir):
    values = spark.createDataFrame([("click", 0b10010001), ("view", 300)], "key string, value long")
    return bitmaps.bitfield_set(bits(spark, sf_dir), values, 8, 5, overflow="sat")


@register("bitcount_byte_range", BITS + "SELECT key, count(*)::BIGINT AS n FROM b WHERE off BETWEEN 16 AND 47 GROUP BY key")
def bitcount_byte_range(spark, sf_dir):
    return bitmaps.bitcount(bits(spark, sf_dir), 2 * 8, 5 * 8 + 7)


HLL = "WITH h AS (SELECT {key} AS key, ('0x' || substr(md5(user_id::VARCHAR), 1, 15))::BIGINT AS h FROM events), r AS (SELECT key, (h & 16383)::INT AS idx, max(CASE WHEN h >> 14 = 0 THEN 47 ELSE 46 - length(bin(h >> 14)) + 1 END)::INT AS reg FROM h GROUP BY ALL)"
ESTIMATE = " , s AS (SELECT key, sum(pow(2.0, -reg)) AS s, count(*) AS k FROM r GROUP BY key) SELECT key, round(CASE WHEN 0.7213 / (1 + 1.079 / 16384) * 16384 * 16384 / (s + 16384 - k) <= 2.5 * 16384 AND k < 16384 THEN 16384 * (ln(16384) - ln(16384 - k)) ELSE 0.7213 / (1 + 1.079 / 16384) * 16384 * 16384 / (s + 16384 - k) END)::BIGINT AS estimate FROM s"


def elements(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("element"))


@register("pfadd_registers", HLL.format(key="event_type") + " SELECT * FROM r")
def pfadd_registers(spark, sf_dir):
    return sketches.registers(elements(spark, sf_dir))


@register("pfcount", HLL.format(key="event_type") + ESTIMATE)
def pfcount(spark, sf_dir):
    return sketches.estimate(sketches.registers(elements(spark, sf_dir)))


@register("pfmerge", HLL.format(key="'all'") + ESTIMATE)
def pfmerge(spark, sf_dir):
    return sketches.estimate(sketches.merged(sketches.registers(elements(spark, sf_dir)), "all"))
