"""Bitmaps in long form: bits(key, off) holds the set bits; and integers in binary values, most significant bit first.

Set bits are rows, so a bitmap may be larger than any task; counts, positions and bitwise operations are groupings that
every task pre-aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.operators.ordering import numbered


def setbit(log: DataFrame) -> DataFrame:
    """SETBIT over a log (key, off, seq, bit): bits whose last write set them."""
    last = log.groupBy("key", "off").agg(F.max_by("bit", "seq").alias("_bit"))
    return last.where("_bit = 1").drop("_bit")


def getbit(bits: DataFrame, wanted: DataFrame) -> DataFrame:
    """GETBIT for (key, off): 0 where nothing is set."""
    here = bits.select("key", "off").distinct().withColumn("_one", F.lit(1))
    return wanted.join(here, ["key", "off"], "left").select(*wanted.columns, F.coalesce("_one", F.lit(0)).alias("bit"))


def bitcount(bits: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """BITCOUNT, in bits from ``first`` to ``last`` where they are given."""
    rows = bits.distinct()
    rows = rows if first is None else rows.where(F.col("off") >= first)
    rows = rows if last is None else rows.where(F.col("off") <= last)
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def bitpos_set(bits: DataFrame, start: int = 0) -> DataFrame:
    """BITPOS for 1: the least set bit from ``start`` on."""
    return bits.where(F.col("off") >= start).groupBy("key").agg(F.min("off").alias("pos"))


def bitpos_clear(bits: DataFrame) -> DataFrame:
    """BITPOS for 0: the first gap, or the bit after the last one. Bits below the gap are as many as their number."""
    ranked = numbered(bits.select("key", "off").distinct(), ["key"], ["off"], "_i")
    dense = F.count(F.when(F.col("off") == F.col("_i"), 1))
    return ranked.groupBy("key").agg(dense.cast("long").alias("pos"))


def bitop(bits: DataFrame, op: str, keys: list[str]) -> DataFrame:
    """BITOP AND, OR, XOR, and DIFF-like NOT within the bytes of its single source."""
    own = bits.where(F.col("key").isin(keys)).select("key", "off").distinct()
    if op == "not":
        top = own.agg(F.max("off")).first()[0]
        # numbers up to the bound are made by the tasks themselves, each its own range
        all_bits = own.sparkSession.range(0 if top is None else (top // 8 + 1) * 8).withColumnRenamed("id", "off")
        return all_bits.join(own.select(F.col("off").cast("long").alias("off")), "off", "left_anti")
    n = own.groupBy("off").agg(F.count(F.lit(1)).alias("_n"))
    kept = {"and": F.col("_n") == len(set(keys)), "or": F.lit(True), "xor": F.col("_n") % 2 == 1}[op]
    return n.where(kept).select("off")


def to_binary(bits: DataFrame, width: int) -> DataFrame:
    """The first ``width`` bits (a multiple of 8) of each key as a binary value."""
    byte = bits.where(F.col("off") < width).groupBy("key", F.floor(F.col("off") / 8).alias("_at")).agg(F.sum(F.call_function("shiftleft", F.lit(1).cast("long"), (7 - F.col("off") % 8).cast("int"))).alias("_b"))
    found = byte.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct(F.col("_at").cast("int"), "_b"))).alias("_m"))
    digits = F.transform(F.sequence(F.lit(0), F.lit(width // 8 - 1)), lambda k: F.lpad(F.hex(F.coalesce(F.try_element_at("_m", k), F.lit(0).cast("long"))), 2, "0"))
    return found.select("key", F.unhex(F.array_join(digits, "")).alias("value"))


def bitfield_get(value: Column, width: int, offset: int, signed: bool = False) -> Column:
    """BITFIELD GET at a bit offset: unsigned up to 63 bits, signed up to 64; bytes beyond the end are 0."""
    first, last = offset // 8, (offset + width - 1) // 8
    total = F.lit(0).cast("long")
    for k in range(first, last + 1):
        byte = F.coalesce(F.conv(F.hex(F.substring(value, k + 1, 1)), 16, 10).cast("long"), F.lit(0).cast("long"))
        start, end = max(offset, 8 * k) - 8 * k, min(offset + width, 8 * k + 8) - 8 * k
        part = F.shiftright(byte, 8 - end).bitwiseAND(F.lit((1 << (end - start)) - 1).cast("long"))
        total = F.shiftleft(total, end - start).bitwiseOR(part)
    # the sign bit is moved to the top of the long and back; 64 bits are the long as it is
    return F.shiftright(F.shiftleft(total, 64 - width), 64 - width) if signed else total


def _fitted(total: Column, width: int, signed: bool, overflow: str) -> Column:
    """A decimal brought into the type's range: ``wrap``, ``sat`` at the ends, or ``fail`` with null; as a long."""
    low, high = (-(1 << (width - 1)), (1 << (width - 1)) - 1) if signed else (0, (1 << width) - 1)
    wide = lambda n: F.lit(str(n)).cast("decimal(38,0)")
    if overflow == "sat":
        out = F.greatest(wide(low), F.least(wide(high), total))
    elif overflow == "fail":
        out = F.when((total >= wide(low)) & (total <= wide(high)), total)
    else:
        out = F.pmod(total - wide(low), wide(1 << width)) + wide(low)
    return out.cast("long")


def bitfield_add(current: Column, delta: Column, width: int, signed: bool = False, overflow: str = "wrap") -> Column:
    """BITFIELD INCRBY: the new value. Sums are decimals, so they are exact at any width."""
    return _fitted(current.cast("decimal(20,0)") + delta.cast("decimal(20,0)"), width, signed, overflow)


def bitfield_set(bits: DataFrame, values: DataFrame, width: int, offset: int, signed: bool = False, overflow: str = "wrap") -> DataFrame:
    """BITFIELD SET of (key, value) at a bit offset: the bits afterwards. A value that fails to fit leaves its key as it is."""
    fitted = values.select("key", _fitted(F.col("value").cast("decimal(38,0)"), width, signed, overflow).alias("_v")).where("_v IS NOT NULL")
    places = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.when(F.call_function("shiftright", F.col("_v"), F.lit(width - 1) - k).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(offset).cast("long") + k))
    new = fitted.select("key", F.explode(F.filter(places, lambda x: x.isNotNull())).alias("off"))
    inside = F.col("off").between(offset, offset + width - 1)
    return bits.where(~inside).unionByName(bits.where(inside).join(fitted, "key", "left_anti").select(*bits.columns)).unionByName(new)
