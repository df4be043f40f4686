"""Ranks and running sums within keys, by ranges instead of by keys, so that one key may hold any share of the rows.

Rows are dealt out by ranges of (key, order) once. Within a range they are numbered by a window over (key, range); what
the ranges before hold of the same key is added. Only the key at a range's start can reach back, so the table of these
additions has fewer rows than there are ranges, however large the input: it is safe to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.sources.shared import checkpointed


def numbered(rows: DataFrame, by: list[str], order: list[Column | str], rank: str = "rank", sums: dict[str, Column] | None = None, highest: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with ``rank`` (from 0) within the key, and running sums and maxima up to and with the row.

    The order should be total, or ties fall in any order. Null values count for nothing; a null key is a key.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = {s: (F.sum, c) for s, c in (sums or {}).items()} | {s: (F.max, c) for s, c in (highest or {}).items()}
    staged = rows.withColumns({f"_v_{s}": c for s, (_, c) in values.items()})
    dealt = checkpointed(staged.repartitionByRange(ranges, *by, *order).withColumn("_range", F.spark_partition_id()))
    held = dealt.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"), *(f(f"_v_{s}").alias(f"_s_{s}") for s, (f, _) in values.items()))
    ahead = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select(*(F.col(k).alias(f"_k_{k}") for k in by), F.col("_range").alias("_at"), F.sum("_n").over(ahead).alias("_before"), *(f(f"_s_{s}").over(ahead).alias(f"_b_{s}") for s, (f, _) in values.items()))
    before = before.where("_before > 0")
    same = F.col("_range") == F.col("_at")
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    own = Window.partitionBy(*by, "_range").orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.withColumns({"_i": F.row_number().over(own) - 1} | {f"_u_{s}": f(f"_v_{s}").over(upto) for s, (f, _) in values.items()})
    found = found.join(F.broadcast(before), same, "left")
    out = {rank: F.col("_i") + F.coalesce("_before", F.lit(0))}
    for s, (f, _) in values.items():
        both = F.greatest(f"_b_{s}", f"_u_{s}") if f is F.max else F.col(f"_b_{s}") + F.col(f"_u_{s}")
        out[s] = F.coalesce(both, f"_u_{s}", f"_b_{s}")
    return found.select(*rows.columns, *(c.alias(n) for n, c in out.items()))


def as_of(rows: DataFrame, marks: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Each row with the ``value`` of the last mark of its key at or before it (``order`` is a column of both), or null.

    Both sides are one ordered run with a running maximum, so neither a hot key nor many marks multiply rows.
    """
    told = F.struct(F.col(order).alias("o"), F.col(value).alias("v"))
    left = rows.withColumns({"_mark": F.lit(1), "_told": F.lit(None).cast(marks.select(told.alias("t")).schema["t"].dataType)})
    right = marks.select(*by, order, F.lit(0).alias("_mark"), told.alias("_told"))
    both = left.unionByName(right, allowMissingColumns=True)
    found = numbered(both, by, [order, "_mark"], "_i", highest={"_last": F.col("_told")})
    return found.where("_mark = 1").select(*rows.columns, F.col("_last.v").alias(value))


def firsts(rows: DataFrame, by: list[str], order: list[Column | str], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key (n small): every task keeps n of a key at most before anything is exchanged."""
    ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    return ranked.where(F.col(rank) < n)


def with_count(rows: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    """Each row with the number of rows of its key: counted with partial sums in every task, then joined."""
    return rows.join(rows.groupBy(*by).agg(F.count(F.lit(1)).alias(name)), by)
