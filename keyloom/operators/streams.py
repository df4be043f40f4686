"""Append-only streams and consumer groups in batch: entries(key, ms, seq, ...), pending entries, claims, lags.

Ids are pairs (ms, seq). A group's deliveries are replayed from its reads: the entries of a key are numbered, the reads'
counts are running sums, and each entry falls to the last read that starts at or before its number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.operators.keyspace import upsert
from keyloom.operators.ordering import as_of, firsts, numbered
from keyloom.sources.shared import checkpointed

#: The order of ids.
OLDEST = ["ms", "seq"]
#: Entries of a key that share a join key when reads are dealt to them.
SPAN = 256


def newest() -> list[Column]:
    return [F.desc("ms"), F.desc("seq")]


def with_ids(log: DataFrame, clock: str = "clock", arrival: str = "arrival") -> DataFrame:
    """XADD with ``*``: the clock's ms, or the last id's where the clock has not passed it, and the next number in it.

    One numbering gives ``number``, the entry's place in its stream, and the running ms; seq is the distance from the
    first entry of that ms, so the order of arrival is the order of ids and ``number`` serves what follows.
    """
    timed = numbered(log, ["key"], [arrival], "number", highest={"ms": F.col(clock)})
    opens = timed.groupBy("key", "ms").agg(F.min("number").alias("_first"))
    return timed.join(opens, ["key", "ms"]).withColumn("seq", F.col("number") - F.col("_first")).drop("_first")


def explicit(entries: DataFrame, new: DataFrame) -> DataFrame:
    """XADD with explicit ids (key, ms, seq, arrival, ...): one that is not above every id before it is refused.

    What counts is the running greatest id, of the stream's and of the new ones up to then.
    """
    last = entries.groupBy("key").agg(F.max(F.struct("ms", "seq")).alias("_last"))
    ranked = numbered(new, ["key"], ["arrival"], "_i", highest={"_top": F.struct("ms", "seq")})
    before = checkpointed(ranked).select("key", (F.col("_i") + 1).alias("_i"), F.col("_top").alias("_before"))
    both = ranked.join(before, ["key", "_i"], "left").join(last, "key", "left")
    own, floor = F.struct("ms", "seq"), F.greatest("_before", "_last")
    return both.where(floor.isNull() | (own > floor)).select(*new.columns)


def after(ms: Column | int, seq: Column | int) -> Column:
    """Entries with larger ids."""
    return (F.col("ms") > ms) | ((F.col("ms") == ms) & (F.col("seq") > seq))


def id_range(entries: DataFrame, low: tuple[int, int], high: tuple[int, int], count: int | None = None, reverse: bool = False) -> DataFrame:
    """XRANGE, XREVRANGE: inclusive; ``count`` rows of each key."""
    inside = entries.where((F.col("ms").between(low[0], high[0])) & (after(*low) | ((F.col("ms") == low[0]) & (F.col("seq") == low[1]))) & ~after(*high))
    return inside if count is None else firsts(inside, ["key"], newest() if reverse else OLDEST, count)


def read_after(entries: DataFrame, cursors: DataFrame, count: int) -> DataFrame:
    """XREAD for (key, last_ms, last_seq): the next ``count`` entries of each key."""
    rows = entries.join(cursors, "key").where(after(F.col("last_ms"), F.col("last_seq"))).drop("last_ms", "last_seq")
    return firsts(rows, ["key"], OLDEST, count)


def trimmed(entries: DataFrame, maxlen: int, limit: int | None = None) -> DataFrame:
    """XTRIM MAXLEN: the newest entries of each key; with a limit no more than so many are cut."""
    ranked = numbered(entries, ["key"], newest(), "_new")
    if limit is None:
        return ranked.where(F.col("_new") < maxlen).drop("_new")
    length = entries.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    return ranked.join(length, "key").where(F.col("_new") < F.greatest(F.lit(maxlen), F.col("_n") - limit)).drop("_new", "_n")


def trimmed_before(entries: DataFrame, ms: int, seq: int = 0) -> DataFrame:
    """XTRIM MINID."""
    return entries.where(~((F.col("ms") < ms) | ((F.col("ms") == ms) & (F.col("seq") < seq))))


def deliveries(entries: DataFrame, reads: DataFrame) -> DataFrame:
    """XREADGROUP with ``>`` over a log of reads (key, at, consumer, count, delivery_ms): who got which entry.

    Each read takes the next ``count`` entries after those that earlier reads took. All entries are taken to be there.
    """
    ends = numbered(reads, ["key"], ["at"], "_i", {"_end": F.col("count").cast("long")})
    placed = entries if "number" in entries.columns else numbered(entries, ["key"], OLDEST, "number")
    placed = placed.select("key", "ms", "seq", "number", F.floor(F.col("number") / SPAN).alias("_span"))
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    # a read takes the numbers from one end to the next; it meets the entries of the spans that they fall into
    takes = ends.join(sizes, "key").select("key", "consumer", "delivery_ms", (F.col("_end") - F.col("count")).alias("_from"), F.least("_end", "_n").alias("_to")).where("_from < _to")
    takes = takes.withColumn("_span", F.explode(F.sequence(F.floor(F.col("_from") / SPAN), F.floor((F.col("_to") - 1) / SPAN))))
    found = placed.join(takes, ["key", "_span"]).where((F.col("number") >= F.col("_from")) & (F.col("number") < F.col("_to")))
    return found.select("key", "ms", "seq", "consumer", "delivery_ms", F.lit(1).alias("delivery_count"))


def pending_summary(pending: DataFrame) -> DataFrame:
    """XPENDING: by key how many, the least and the greatest id, and how many each consumer has."""
    by = pending.groupBy("key", "consumer").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ms", "seq")).alias("a"), F.max(F.struct("ms", "seq")).alias("b"))
    told = F.map_from_entries(F.array_sort(F.collect_list(F.struct("consumer", "n"))))
    return by.groupBy("key").agg(F.sum("n").alias("total"), F.min("a").alias("first"), F.max("b").alias("last"), told.alias("consumers"))


def pending_range(pending: DataFrame, low: tuple[int, int], high: tuple[int, int], count: int, now: int, min_idle: int = 0, consumer: str | None = None) -> DataFrame:
    """XPENDING with a range: the first ``count`` pending entries of each key, with their idle time; of one consumer if it is given."""
    rows = pending.withColumn("idle", F.lit(now) - F.col("delivery_ms")).where(F.col("idle") >= min_idle)
    return id_range(rows if consumer is None else rows.where(F.col("consumer") == consumer), low, high, count).drop("rank")


def groups_created(groups: DataFrame, new: DataFrame) -> DataFrame:
    """XGROUP CREATE for (key, group, last_ms, last_seq): groups that are there already stay as they are."""
    return upsert(groups, new, ["key", "group"], "nx")


def groups_set(groups: DataFrame, new: DataFrame) -> DataFrame:
    """XGROUP SETID: cursors of groups that are there."""
    return upsert(groups, new, ["key", "group"], "xx")


def last_ids(entries: DataFrame) -> DataFrame:
    """``$``: (key, last_ms, last_seq) of each stream."""
    return entries.groupBy("key").agg(F.max(F.struct("ms", "seq")).alias("_l")).select("key", F.col("_l.ms").alias("last_ms"), F.col("_l.seq").alias("last_seq"))


def set_ids(entries: DataFrame, new: DataFrame) -> DataFrame:
    """XSETID for (key, ms, seq): the last id that each stream goes on from; one below its greatest entry is refused."""
    both = last_ids(entries).join(new, "key", "left")
    ahead = F.struct("ms", "seq") >= F.struct(F.col("last_ms").alias("ms"), F.col("last_seq").alias("seq"))
    goes = F.col("ms").isNotNull() & ahead
    return both.select("key", F.when(goes, F.col("ms")).otherwise(F.col("last_ms")).alias("last_ms"), F.when(goes, F.col("seq")).otherwise(F.col("last_seq")).alias("last_seq"))


def claimed(pending: DataFrame, ids: DataFrame, consumer: str, now: int, min_idle: int, at: int | None = None, retries: int | None = None, just_ids: bool = False, force: DataFrame | None = None) -> DataFrame:
    """XCLAIM of (key, ms, seq): pending entries idle for long enough change hands and count one more delivery.

    ``at`` is the time of delivery (TIME, or now less IDLE), ``retries`` the count to set (RETRYCOUNT), ``just_ids``
    leaves the count (JUSTID), and ``force``, the stream's entries, adds asked ids that nobody has pending.
    """
    if force is not None:
        absent = ids.select("key", "ms", "seq").distinct().join(force, ["key", "ms", "seq"], "left_semi").join(pending, ["key", "ms", "seq"], "left_anti")
        oldest = F.lit(now - min_idle).cast(pending.schema["delivery_ms"].dataType)
        pending = pending.unionByName(absent.withColumns({"consumer": F.lit(consumer), "delivery_ms": oldest, "delivery_count": F.lit(0)}))
    asked = ids.select("key", "ms", "seq").distinct().withColumn("_asked", F.lit(True))
    goes = F.coalesce("_asked", F.lit(False)) & (F.lit(now) - F.col("delivery_ms") >= min_idle)
    rows = pending.join(asked, ["key", "ms", "seq"], "left").withColumn("_goes", goes)
    return rows.withColumns({
        "consumer": F.when(F.col("_goes"), consumer).otherwise(F.col("consumer")),
        "delivery_count": F.when(F.col("_goes") & F.lit(retries is not None), F.lit(retries)).otherwise(F.col("delivery_count") + (F.col("_goes") & F.lit(not just_ids)).cast("int")),
        "delivery_ms": F.when(F.col("_goes"), F.lit(now if at is None else at)).otherwise(F.col("delivery_ms")),
    }).drop("_asked", "_goes")


def auto_claimed(pending: DataFrame, entries: DataFrame, consumer: str, now: int, min_idle: int, start: tuple[int, int], count: int) -> DataFrame:
    """XAUTOCLAIM: the first idle entries from ``start`` on, with the id to go on from; entries gone from the stream are marked deleted."""
    idle = pending.where(F.lit(now) - F.col("delivery_ms") >= min_idle).where(after(*start) | ((F.col("ms") == start[0]) & (F.col("seq") == start[1])))
    some = firsts(idle, ["key"], OLDEST, count + 1)
    going_on = some.where(F.col("rank") == count).select("key", F.col("ms").alias("next_ms"), F.col("seq").alias("next_seq"))
    here = entries.select("key", "ms", "seq", F.lit(False).alias("_gone"))
    taken = some.where(F.col("rank") < count).join(here, ["key", "ms", "seq"], "left")
    out = taken.select("key", "ms", "seq", F.lit(consumer).alias("consumer"), (F.col("delivery_count") + 1).alias("delivery_count"), F.coalesce("_gone", F.lit(True)).alias("deleted"))
    return out.join(going_on, "key", "left").select("*").withColumns({"next_ms": F.coalesce("next_ms", F.lit(0)), "next_seq": F.coalesce("next_seq", F.lit(0))})


def group_lag(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """XINFO GROUPS for (key, group, last_ms, last_seq): entries that come after each cursor, counted as numbers of entries up to it."""
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("length"))
    placed = entries if "number" in entries.columns else numbered(entries, ["key"], OLDEST, "number")
    marks = placed.select("key", F.struct("ms", "seq").alias("id"), "number")
    asked = groups.withColumn("id", F.struct(F.col("last_ms").alias("ms"), F.col("last_seq").alias("seq")))
    found = as_of(asked, marks, ["key"], "id", "number")
    return found.join(sizes, "key", "left").select("key", "group", F.coalesce(F.col("length") - F.coalesce("number", F.lit(-1)) - 1, F.lit(0)).alias("lag"))


def stream_info(entries: DataFrame) -> DataFrame:
    """XLEN and XINFO STREAM: length, first and last id."""
    own = F.struct("ms", "seq")
    return entries.groupBy("key").agg(F.count(F.lit(1)).alias("length"), F.min(own).alias("first"), F.max(own).alias("last"))


def consumers(pending: DataFrame, now: int) -> DataFrame:
    """XINFO CONSUMERS: what each consumer has pending, and how long ago it was last given an entry."""
    return pending.groupBy("key", "consumer").agg(F.count(F.lit(1)).alias("pending"), (F.lit(now) - F.max("delivery_ms")).alias("idle"))
