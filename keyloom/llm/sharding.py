"""Histogram sort: near-equal shards of whole documents by exact byte counts at probed key boundaries.

The sort key is (hash of the text, id, number of the row), so copies of one text lie side by side, and rows that repeat a
text and an id can still be parted. Each round counts, over all rows and
with partial sums in every task, the bytes and rows between finer key boundaries ("probes"), but only inside intervals
in which a shard boundary still falls and which hold more than the tolerance, or which hold too many rows for one task.
An interval that one text fills is probed further by id, and one that a repeated row fills by the rows' numbers. When every boundary is known, rows are exchanged once, to the
intervals, which give each row its shard and its gapless slot. DataFrame functions only; the driver holds at most a few
hundred thousand interval totals, whatever the input.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.common import checkpointed, fresh

#: Bits of the hash that one round of probes resolves; the hash has 64.
ROUND_BITS = 12
#: Rounds that resolve all 64 bits.
LEVELS = -(-64 // ROUND_BITS)
#: An interval that holds more than this share of the rows is probed further, so that no task gets much more.
TASK_SHARE = 1 / 256
#: A shard boundary may miss its target by this share of a shard's bytes; finer than one document is not possible.
TOLERANCE = 0.001
#: Bytes that a document costs besides its text.
OVERHEAD = 16


def sized(docs: DataFrame, key: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes plus 16), ``text_crc32`` and the three columns of the sort key; a null text counts as empty."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.withColumns({
        "size": (F.octet_length(text) + OVERHEAD).cast("long"),
        "text_crc32": F.crc32(F.encode(text, "UTF-8")),
        key[0]: F.xxhash64(text),
        key[1]: F.coalesce(docs[id_col].cast("long"), F.lit(-(2**63))),
        key[2]: F.xxhash64(F.monotonically_increasing_id()),
    })


def _prefix(key: list[str], level: int) -> Column:
    """What a level of probes compares: 12, 24, ... 64 bits of the hash, then as many of the id, then of the row's number."""
    part, step = divmod(level, LEVELS)
    return F.shiftright(F.col(key[part]), 64 - min(64, (step + 1) * ROUND_BITS))


def _whole(path: tuple, level: int) -> tuple:
    """The parts of the key that are known in full at a level, from its path; None where they aren't yet."""
    return path[LEVELS - 1] if level >= LEVELS else None, path[2 * LEVELS - 1] if level >= 2 * LEVELS else None


def _within(key: list[str], level: int, names: list[str]) -> Column:
    """Rows of an interval of that level, which ``names`` hold as (hash, id, prefix)."""
    on = _prefix(key, level) == F.col(names[2])
    for k in range(level // LEVELS):
        on = on & (F.col(key[k]) == F.col(names[k]))
    return on


def plan(keyed: DataFrame, key: list[str], shards: int, tolerance: float = TOLERANCE) -> list[dict]:
    """Intervals of the key in order, each with its level, path, bytes and rows; ``keyed`` has the key and size."""
    spark = keyed.sparkSession
    first = keyed.groupBy(_prefix(key, 0).alias("p")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    leaves = sorted(((r["p"], r["bytes"], r["rows"]) for r in first.collect()))
    total, rows = sum(b for _, b, _ in leaves), sum(n for _, _, n in leaves)
    targets = [total * i / shards for i in range(1, shards)]
    slack, most_rows = tolerance * total / shards, max(1, rows * TASK_SHARE)
    done: list[tuple] = []
    # an open interval is (path, bytes, rows); its path has the prefixes of hash, id and row number that lead to it
    open_now = [((p,), b, n) for p, b, n in leaves]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("h", "i", "q")])
    for level in range(3 * LEVELS):
        ordered = sorted(done + [(path, b, n, level) for path, b, n in open_now], key=lambda x: x[0])
        before, split = 0, []
        for path, b, n, at in ordered:
            inside = bisect_right(targets, before) < bisect_right(targets, before + b - 1)
            if at == level and n > 1 and level < 3 * LEVELS - 1 and (n > most_rows or inside and b > slack):
                split.append(path)
            before += b
        chosen = set(split)
        done += [(path, b, n, level) for path, b, n in open_now if path not in chosen]
        if not split:
            break
        by_end = {(*_whole(path, level), path[-1]): path for path in split}
        wanted = spark.createDataFrame(list(by_end), schema)
        inner = keyed.join(F.broadcast(wanted), _within(key, level, ["h", "i", "q"])).groupBy("h", "i", "q", _prefix(key, level + 1).alias("p"))
        counts = inner.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
        open_now = [((*by_end[r["h"], r["i"], r["q"]], r["p"]), r["bytes"], r["rows"]) for r in counts]
    return [{"path": path, "bytes": b, "rows": n, "level": at} for path, b, n, at in sorted(done, key=lambda x: x[0])]


def place(intervals: list[dict], shards: int) -> list[dict]:
    """Gives each interval its shard and the slot of its first row: a boundary goes to the nearer side of an interval."""
    total = sum(x["bytes"] for x in intervals)
    before, slot, shard = 0, 0, 0
    for number, x in enumerate(intervals):
        middle = before + x["bytes"] / 2
        now = min(shards - 1, int(middle * shards / total)) if total else 0
        if now != shard:
            shard, slot = now, 0
        x |= {"leaf": number, "shard": shard, "slot0": slot}
        slot += x["rows"]
        before += x["bytes"]
    return intervals


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard).

    Shards' bytes differ from their mean by the tolerance or by one document at most, whatever repeats: rows are told
    apart by their number in ``docs``, which must give the same rows in the same order when it is read again (a table, or
    checkpointed rows). Columns of these four names are replaced; others stay, whatever their names. Null texts count
    as empty, null ids sort first, an empty table gives no rows.
    """
    spark = docs.sparkSession
    key = [fresh(n, docs) for n in ("key_hash", "key_id", "key_row")]
    at, first = fresh("at", docs), [fresh(n, docs) for n in ("h", "i", "q")]
    keyed = sized(docs, key, id_col, text_col)
    intervals = place(plan(checkpointed(keyed.select(*key, "size")), key, shards, tolerance), shards)
    kinds = [(c, T.LongType()) for c in (*first, "leaf")] + [("shard", T.IntegerType()), ("slot0", T.LongType())]
    schema = T.StructType([T.StructField(c, kind) for c, kind in kinds])
    rows = [(x["level"], (*_whole(x["path"], x["level"]), x["path"][-1], x["leaf"], x["shard"], x["slot0"])) for x in intervals]
    found = keyed.drop("shard", "slot")
    levels = sorted({x["level"] for x in intervals})
    for level in levels:
        part = spark.createDataFrame([r for own, r in rows if own == level], schema)
        lookup = part.select(*first, F.struct("leaf", "shard", "slot0").alias(f"{at}{level}"))
        found = found.join(F.broadcast(lookup), _within(key, level, first), "left").drop(*first)
    here = F.coalesce(*(f"{at}{level}" for level in levels)) if levels else F.lit(None).cast("struct<leaf:bigint,shard:int,slot0:bigint>")
    found = found.withColumn(at, here).drop(*(f"{at}{level}" for level in levels))
    within = Window.partitionBy(f"{at}.leaf").orderBy(*key)
    out = found.withColumns({"shard": F.col(f"{at}.shard"), "slot": F.col(f"{at}.slot0") + F.row_number().over(within) - 1})
    return out.drop(at, *key)


def sharded_digest(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns: which document lies where, under the law ``bytes``."""
    placed = shard_by_bytes(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), shards)
    return placed.select(
        "doc_id", "size", F.col("text_crc32").cast("long").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
