"""Hashes, lists, sets and scored sets as long tables, all keys at once.

hashes(key, field, value), lists(key, pos, value), sets(key, member), zsets(key, member, score). Ranks are taken by
ranges (see ordering), so one key may hold most rows; the first few rows of each key come from a window that every task
prunes first; set algebra is a grouping by member with counts of keys, which pre-aggregates in every task. Scores order
with NaN last, as Spark's doubles do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.values import index_range
from keyloom.operators.ordering import firsts, numbered, with_count

# Hashes


def as_maps(hashes: DataFrame) -> DataFrame:
    """HGETALL, HKEYS, HVALS, HLEN: a map for each key, entries in order of the field."""
    pairs = F.array_sort(F.collect_list(F.struct("field", "value")))
    return hashes.groupBy("key").agg(F.map_from_entries(pairs).alias("fields"))


def summary(rows: DataFrame, name: str = "n") -> DataFrame:
    """HLEN, LLEN, SCARD, ZCARD, XLEN: rows of each key."""
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias(name))


def sampled(rows: DataFrame, n: int, seed: int, by: str) -> DataFrame:
    """HRANDFIELD, SRANDMEMBER, ZRANDMEMBER, SPOP: n rows of each key; with -n, |n| draws with replacement."""
    if n >= 0:
        return firsts(rows, ["key"], [F.xxhash64(by, F.lit(seed)), F.col(by)], n, "_r").drop("_r")
    ranked = numbered(rows, ["key"], [by], "_r")
    draws = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(-n - 1))))
    draws = draws.withColumn("_r", F.pmod(F.xxhash64("key", "draw", F.lit(seed)), F.col("_n")))
    return draws.join(ranked, ["key", "_r"]).drop("_r", "_n")


# Lists


def pushed(lists: DataFrame, new: DataFrame, left: bool = False, only_existing: bool = False) -> DataFrame:
    """RPUSH and LPUSH (the last pushed is first) of rows (key, seq, value); the X forms only where there is a list."""
    ends = lists.groupBy("key").agg(F.min("pos").alias("_lo"), F.max("pos").alias("_hi"))
    rows = numbered(new, ["key"], ["seq"], "_k").join(ends, "key", "inner" if only_existing else "left")
    at = F.coalesce("_lo", F.lit(0)) - F.col("_k") - 1 if left else F.coalesce("_hi", F.lit(-1)) + F.col("_k") + 1
    return lists.unionByName(rows.select("key", at.cast("long").alias("pos"), "value"))


def indexed(lists: DataFrame) -> DataFrame:
    """Rows with ``i``, their position from 0, and ``n``, the list's length."""
    return with_count(numbered(lists, ["key"], ["pos"], "i"), ["key"])


def list_range(lists: DataFrame, start: int, stop: int, keep: bool = True) -> DataFrame:
    """LRANGE and LTRIM (and, with ``keep`` false, what LTRIM drops)."""
    rows = indexed(lists)
    first, last = index_range(F.col("n"), start, stop)
    inside = (F.col("i") >= first) & (F.col("i") <= last)
    return rows.where(inside if keep else ~inside)


def list_at(lists: DataFrame, index: int) -> DataFrame:
    """LINDEX: one row for each key that has the position."""
    rows = indexed(lists)
    return rows.where(F.col("i") == (F.col("n") + index if index < 0 else F.lit(index)))


def list_set(lists: DataFrame, index: int, value: Column) -> DataFrame:
    """LSET: the position replaced in every list that has it."""
    rows = indexed(lists)
    at = F.col("i") == (F.col("n") + index if index < 0 else F.lit(index))
    return rows.withColumn("value", F.when(at, value).otherwise(F.col("value"))).drop("i", "n")


def popped(rows: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """LPOP, RPOP, ZPOPMIN, ZPOPMAX: the first n of each key in an order, with ``rank`` from 0."""
    return firsts(rows, ["key"], order, n)


def after_pop(rows: DataFrame, n: int, order: list[Column], unique: list[str]) -> DataFrame:
    """What is left after a pop of n; rows are told apart by ``unique``."""
    return rows.join(popped(rows, n, order).select(*unique), unique, "left_anti")


def list_removed(lists: DataFrame, value: str, n: int) -> DataFrame:
    """LREM: the first n equal values from the head, -n from the tail, all for 0, are gone."""
    hit = F.col("value") == value
    if n == 0:
        return lists.where(~F.coalesce(hit, F.lit(False)))
    order = F.col("pos").desc() if n < 0 else F.col("pos").asc()
    gone = firsts(lists.where(hit), ["key"], [order], abs(n)).select("key", "pos")
    return lists.join(gone, ["key", "pos"], "left_anti")


def list_inserted(lists: DataFrame, pivot: str, value: str, before: bool = True) -> DataFrame:
    """LINSERT: next to the first pivot; positions become 0, 1, 2 and so on."""
    rows = indexed(lists)
    at = rows.where(F.col("value") == pivot).groupBy("key").agg(F.min("i").alias("_at"))
    new = at.select("key", (F.col("_at") + F.lit(-0.5 if before else 0.5)).alias("_o"), F.lit(value).alias("value"))
    every = rows.select("key", F.col("i").cast("double").alias("_o"), "value").unionByName(new)
    return numbered(every, ["key"], ["_o"], "pos").select("key", "pos", "value")


def list_positions(lists: DataFrame, value: str, rank: int = 1, count: int = 1, maxlen: int = 0) -> DataFrame:
    """LPOS: positions of equal values from the rank-th match on (negative: from the tail); count 0 gives all."""
    rows = indexed(lists)
    if maxlen:
        rows = rows.where(F.col("i") < maxlen if rank > 0 else F.col("i") >= F.col("n") - maxlen)
    order = F.col("i").asc() if rank > 0 else F.col("i").desc()
    hits = rows.where(F.col("value") == value)
    found = firsts(hits, ["key"], [order], abs(rank) - 1 + count, "match") if count else numbered(hits, ["key"], [order], "match")
    return found.where(F.col("match") >= abs(rank) - 1)


def moved_elements(lists: DataFrame, source: str, target: str, from_left: bool, to_left: bool) -> DataFrame:
    """LMOVE and RPOPLPUSH: one element goes from one list to an end of another."""
    own = lists.where(F.col("key") == source)
    one = own.orderBy(F.col("pos").asc() if from_left else F.col("pos").desc()).limit(1)
    rest = lists.join(one.select("key", "pos"), ["key", "pos"], "left_anti")
    return pushed(rest, one.select(F.lit(target).alias("key"), F.lit(0).alias("seq"), "value"), left=to_left)


def multi_pop(rows: DataFrame, keys: list[str], n: int, order: list[Column]) -> DataFrame:
    """LMPOP, ZMPOP: n rows of the first of the keys that has any."""
    wanted = rows.sparkSession.createDataFrame(list(enumerate(keys)), "_at int, key string")
    mine = rows.join(F.broadcast(wanted), "key")
    first = mine.agg(F.min("_at").alias("_at"))
    return popped(mine.join(F.broadcast(first), "_at", "left_semi").drop("_at"), n, order)


def sorted_elements(rows: DataFrame, alpha: bool = False, descending: bool = False, offset: int = 0, count: int | None = None, position: str = "pos") -> DataFrame:
    """SORT by number or text; descending is the ascending order turned round, ties too. Non-numbers raise an error."""
    number = F.expr("try_cast(value AS DOUBLE)")
    by = F.col("value") if alpha else F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), F.raise_error(F.lit("a value is not a number"))).otherwise(number)
    order = [by.desc(), F.col(position).desc()] if descending else [by.asc(), F.col(position).asc()]
    if count is not None:
        return firsts(rows, ["key"], order, offset + count).where(F.col("rank") >= offset)
    return numbered(rows, ["key"], order).where(F.col("rank") >= offset)


# Sets


def set_algebra(sets: DataFrame, op: str, keys: list[str]) -> DataFrame:
    """SINTER, SUNION, SDIFF of named keys: a missing key makes an intersection empty."""
    wanted = sets.sparkSession.createDataFrame([(k, int(i == 0)) for i, k in enumerate(dict.fromkeys(keys))], "key string, _first int")
    found = sets.join(F.broadcast(wanted), "key").groupBy("member").agg(F.count_distinct("key").alias("_n"), F.max("_first").alias("_in"), F.max(1 - F.col("_first")).alias("_out"))
    kept = {"inter": F.col("_n") == len(set(keys)), "union": F.lit(True), "diff": (F.col("_in") == 1) & (F.coalesce("_out", F.lit(0)) == 0)}[op]
    return found.where(kept).select("member")


def set_moved(sets: DataFrame, source: str, target: str, member: str) -> DataFrame:
    """SMOVE: only if the source has the member."""
    here = (F.col("key") == source) & (F.col("member") == member)
    return sets.withColumn("key", F.when(here, target).otherwise(F.col("key"))).dropDuplicates(["key", "member"])


def stored(result: DataFrame, target: str, into: DataFrame) -> DataFrame:
    """The STORE forms: the result replaces the target key; an empty result just deletes it."""
    return into.where(F.col("key") != target).unionByName(result.withColumn("key", F.lit(target)).select(*into.columns))


# Scored sets


def zadd(log: DataFrame, condition: str = "") -> DataFrame:
    """ZADD and ZINCRBY over a log (key, seq, member, score): last, ``nx`` first, ``gt`` highest, ``lt`` lowest, ``incr`` sum."""
    score = {"": F.max_by("score", "seq"), "nx": F.min_by("score", "seq"), "gt": F.max("score"), "lt": F.min("score"), "incr": F.sum("score")}[condition]
    return log.groupBy("key", "member").agg(score.alias("score"))


def zadd_state(zsets: DataFrame, log: DataFrame, guard: str = "", compare: str = "") -> DataFrame:
    """ZADD onto a state, with its options: guard ``nx`` (only new members) or ``xx`` (only old ones), compare ``gt`` or ``lt``.

    One log (key, seq, member, score) is folded by its own rule first, so a hot member costs each task one row. The
    result has ``added`` and ``changed``: the reply without and with CH counts them.
    """
    if guard == "nx" and compare:
        raise ValueError("nx takes no comparison")
    new = zadd(log, compare or guard if guard != "xx" else compare).withColumnRenamed("score", "_new")
    both = zsets.withColumnRenamed("score", "_old").join(new, ["key", "member"], "full_outer")
    better = {"": F.lit(True), "gt": F.col("_new") > F.col("_old"), "lt": F.col("_new") < F.col("_old")}[compare]
    if guard == "xx":
        both = both.where("_old IS NOT NULL")
    keeps = F.col("_old").isNotNull() & (F.lit(guard == "nx") | F.col("_new").isNull() | ~F.coalesce(better, F.lit(False)))
    score = F.when(keeps, F.col("_old")).otherwise(F.col("_new"))
    return both.select("key", "member", score.alias("score"), F.col("_old").isNull().alias("added"), F.coalesce(score != F.col("_old"), F.lit(True)).alias("changed"))


def score_order(reverse: bool = False) -> list[Column]:
    """By score and then member, or the other way round."""
    return [F.desc("score"), F.desc("member")] if reverse else [F.asc("score"), F.asc("member")]


def zrank(zsets: DataFrame, reverse: bool = False) -> DataFrame:
    """ZRANK, ZREVRANK: 0-based, by score and then member."""
    return numbered(zsets, ["key"], score_order(reverse))


def zrange(zsets: DataFrame, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """ZRANGE, ZREVRANGE by rank. A range whose ends both count from the front is cut to its first rows in every task."""
    if start >= 0 and stop >= 0:
        return firsts(zsets, ["key"], score_order(reverse), stop + 1).where(F.col("rank") >= start)
    first, last = index_range(F.col("_n"), start, stop)
    rows = with_count(zrank(zsets, reverse), ["key"], "_n")
    return rows.where((F.col("rank") >= first) & (F.col("rank") <= last)).drop("_n")


def score_bound(text: str) -> tuple[float, bool]:
    """``5``, ``(5``, ``-inf``, ``+inf``: value and whether it is excluded."""
    return float(text.removeprefix("(").replace("+inf", "inf")), text.startswith("(")


def in_scores(low: str, high: str, score: str = "score") -> Column:
    """ZCOUNT and the BYSCORE forms: a plain comparison, which reaches the scan."""
    (a, a_out), (b, b_out) = score_bound(low), score_bound(high)
    s = F.col(score)
    return (s > a if a_out else s >= a) & (s < b if b_out else s <= b)


def in_members(low: str, high: str, member: str = "member") -> Column:
    """The BYLEX forms: ``[m``, ``(m``, ``-`` and ``+``, compared by bytes."""
    m, out = F.col(member), F.lit(True)
    if low != "-":
        out = out & (m >= low[1:] if low[0] == "[" else m > low[1:]) if low != "+" else F.lit(False)
    if high != "+":
        out = out & (m <= high[1:] if high[0] == "[" else m < high[1:]) if high != "-" else F.lit(False)
    return out


def limited(rows: DataFrame, order: list[Column], offset: int, count: int) -> DataFrame:
    """LIMIT offset count within each key."""
    return firsts(rows, ["key"], order, offset + count).where(F.col("rank") >= offset)


def zalgebra(zsets: DataFrame, op: str, keys: list[str], weights: list[float] | None = None, aggregate: str = "sum") -> DataFrame:
    """ZUNION, ZINTER, ZDIFF with weights and sum, min or max; a missing key makes an intersection empty.

    Weights are a broadcast table of the named keys; a NaN from inf - inf raises an error.
    """
    if op == "diff":
        if weights:
            raise ValueError("a difference takes no weights")
        rest = zsets.where(F.col("key").isin(keys[1:])).select("member")
        return zsets.where(F.col("key") == keys[0]).join(rest, "member", "left_anti").select("member", "score")
    weighted = zsets.sparkSession.createDataFrame(list(zip(keys, map(float, weights or [1.0] * len(keys)), strict=True)), "key string, _w double")
    value = F.col("score") * F.col("_w")
    total = {"sum": F.sum, "min": F.min, "max": F.max}[aggregate](value)
    found = zsets.join(F.broadcast(weighted), "key").groupBy("member").agg(total.alias("score"), F.count_distinct("key").alias("_n"))
    found = found.where(F.col("_n") == len(set(keys))) if op == "inter" else found
    return found.select("member", F.when(F.isnan("score"), F.raise_error(F.lit("resulting score is not a number"))).otherwise(F.col("score")).alias("score"))
