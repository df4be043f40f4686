"""HyperLogLog with 2**14 registers as rows (key, idx, reg): add, merge and estimate are groupings.

At most 16,384 rows a key leave a task, whatever the number of elements.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Index bits, registers, bits of the hash that are left for the rank.
P = 14
M = 1 << P
HASH_BITS = 60
ALPHA = 0.7213 / (1 + 1.079 / M)


def element_hash(value: Column) -> Column:
    """60 bits of the MD5 of the element's text, which other engines can state as well."""
    return F.conv(F.substring(F.md5(value.cast("string")), 1, HASH_BITS // 4), 16, 10).cast("long")


def registers(elements: DataFrame, value: str = "element") -> DataFrame:
    """PFADD: for each key and register the largest number of leading zeros plus 1 in the hash's upper bits."""
    rest = F.shiftright("_h", P)
    rank = F.when(rest == 0, HASH_BITS - P + 1).otherwise(HASH_BITS - P - F.length(F.bin(rest)) + 1)
    rows = elements.select("key", element_hash(F.col(value)).alias("_h"))
    return rows.groupBy("key", F.col("_h").bitwiseAND(F.lit(M - 1).cast("long")).cast("int").alias("idx")).agg(F.max(rank).cast("int").alias("reg"))


def merged(regs: DataFrame, target: str) -> DataFrame:
    """PFMERGE: the largest of each register."""
    return regs.groupBy("idx").agg(F.max("reg").alias("reg")).select(F.lit(target).alias("key"), "idx", "reg")


def estimate(regs: DataFrame) -> DataFrame:
    """PFCOUNT: harmonic mean, or linear counting while many registers are empty. Registers' powers sum exactly in doubles."""
    seen = regs.groupBy("key").agg(F.sum(F.pow(F.lit(2.0), -F.col("reg"))).alias("_s"), F.count(F.lit(1)).alias("_k"))
    empty = M - F.col("_k")
    raw = ALPHA * M * M / (F.col("_s") + empty)
    small = M * (math.log(M) - F.log(empty.cast("double")))
    return seen.select("key", F.round(F.when((raw <= 2.5 * M) & (empty > 0), small).otherwise(raw)).cast("long").alias("estimate"))
