"""Packing of token sequences: dominance reduction after Martello and Toth, then best fit, on the histogram of lengths.

Lengths are whole numbers up to the capacity, so the instance is a histogram of at most that many counts, and the plan
a list of patterns (which lengths share a sequence, and how many sequences do so). Dominating sets are fixed for good
first: a length that fills a sequence, or that fits with nothing; the largest partner where it fills the sequence to
the brim, or where no three fit; then the rest is placed best-fit, longest first, in runs of equal lengths. The cluster
tokenises, numbers the pieces of each length and looks their places up in the plan; the driver sees only the histogram.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import defaultdict
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.common import checkpointed, slices
from keyloom.llm.tokens import CACHE_BYTES, ids_between, lookups, odd, tokenizer, two_parts

#: Tokens of a sequence.
CAPACITY = 2048
#: Pieces of one length are numbered in groups of about so many, or, beyond that, of a share of all pieces, so that a hot
#: length is never one task's and the groups' counts are GROUPS and a row for each length at most.
GROUP_ROWS, GROUPS = 250, 100_000
#: A comma or full stop before a blank and after another sign, which is one pre-token with it; a dotted I ends in a mark in lower case.
RUN_OF_SIGNS = re.compile(r"[.,](?<=[^\w\s].|_.|\u0130.) ")
#: Share of a worker's cache for what has other signs after its letters.
CORES_SHARE = 1 / 8


def token_ids(path: str):
    """A function texts -> ids as little-endian unsigned 32-bit bytes each; groups between white space are cached."""
    own = tokenizer(path)

    def alone(text: str) -> bytes:
        return np.array(own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encoded(wanted: list[str]) -> list[bytes]:
        return ids_between(path, wanted, "|", " | ")

    def many(groups: list[str]) -> list[bytes]:
        split = two_parts(groups)
        plain = [core for core, tail in split if not tail]
        ids = dict(zip(plain, encoded(plain), strict=True))
        if len(plain) < len(groups):
            parts = cores.learn({x for pair in split if pair[1] for x in pair})
            return [parts[core] + parts[tail] if tail else ids[core] for core, tail in split]
        return [ids[core] for core, _ in split]

    # words with other punctuation after them share their letters
    both = 2 * CACHE_BYTES
    most = [int(both * CORES_SHARE), int(both * (1 - CORES_SHARE))]
    cores, known = lookups({f"cores {path}": (encoded, None), f"ids {path}": (many, None)}, most)

    def run(texts: list[str | None]) -> list[bytes]:
        out: list[bytes | None] = [b"" if not t else alone(t) if odd(t) else None for t in texts]
        groups = [apart(lowered(t)).split() if x is None else () for t, x in zip(texts, out, strict=True)]
        ids = known.learn(set().union(*groups)).__getitem__
        return [b"".join(map(ids, g)) if x is None else x for g, x in zip(groups, out, strict=True)]

    return run


def lowered(text: str) -> str:
    """Lower case where that is sure to be what the tokenizer makes of the text anyway, to have fewer groups; else as it is."""
    if text.isascii() or not ("\u03a3" in text or "\u0130" in text) and is_normalized("NFC", text):
        return text.lower()
    return text


def apart(text: str) -> str:
    """Commas and full stops between a letter or digit and a blank set apart, to have fewer groups; the pattern does so anyway.

    A text in which one follows another sign stays as it is, as signs in a row are one pre-token.
    """
    return text if RUN_OF_SIGNS.search(text) else text.replace(", ", " , ").replace(". ", " . ")


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", terminator: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for every piece; a null text is just the terminator."""
    end = terminator.to_bytes(4, "little")

    def run(batches):
        ids_of = token_ids(path)
        for part in slices(batches, keep=True):
            out = []
            for doc_id, own in zip(part.column(0).to_pylist(), ids_of(part.column(1).to_pylist()), strict=True):
                ids = own + end
                for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    out.append((doc_id, number, at // 4, len(piece) // 4, zlib.crc32(piece)))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return narrow.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths that share a sequence, longest first) with their numbers of sequences."""
    left = {length: n for length, n in histogram.items() if n}
    lengths = sorted(left)
    fixed: list[tuple[tuple[int, ...], int]] = []

    def largest_up_to(room: int, but: int, spare: int) -> int | None:
        """The largest length left that fits into room; ``but`` needs more than ``spare`` left."""
        at = bisect_left(lengths, room + 1) - 1
        while at >= 0 and left[lengths[at]] <= (spare if lengths[at] == but else 0):
            at -= 1
        return lengths[at] if at >= 0 else None

    def trim() -> None:
        lengths[:] = [x for x in lengths if left[x]]

    # Dominance: sets that some best packing is sure to hold.
    for big in sorted(left, reverse=True):
        while left[big]:
            trim()
            partner = largest_up_to(capacity - big, big, 1)
            if partner is None:
                fixed.append(((big,), left[big]))
                left[big] = 0
                break
            smallest = lengths[0]
            second = smallest if left[smallest] > 1 + (smallest == big) else next((x for x in lengths[1:] if left[x] > (x == big)), capacity)
            if big + partner < capacity and big + smallest + second <= capacity:
                break
            n = left[big] // 2 if partner == big else min(left[big], left[partner])
            fixed.append(((big, partner), n))
            left[big] -= n
            left[partner] -= n
    # Best fit, longest first; bins of one pattern and room are counted, not listed.
    rooms: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    open_rooms: list[int] = []
    for length in sorted((x for x in left if left[x]), reverse=True):
        n = left[length]
        while n:
            at = bisect_left(open_rooms, length)
            if at < len(open_rooms):
                room = open_rooms[at]
                pattern, bins = next(iter(rooms[room].items()))
                each = min(room // length, max(1, n // bins)) if n >= bins else 1
                used = min(bins, n // each)
                if used == bins:
                    del rooms[room][pattern]
                else:
                    rooms[room][pattern] = bins - used
                if not rooms[room]:
                    open_rooms.pop(at)
                room, pattern = room - each * length, (*pattern, *[length] * each)
                n -= each * used
            else:
                each = capacity // length if n >= capacity // length else n
                used = n // each
                room, pattern = capacity - each * length, (length,) * each
                n -= each * used
            if room not in rooms or not rooms[room]:
                at = bisect_left(open_rooms, room)
                open_rooms.insert(at, room)
            rooms[room][pattern] = rooms[room].get(pattern, 0) + used
    return fixed + [(p, n) for own in rooms.values() for p, n in own.items()]


def lower_bound(histogram: dict[int, int], capacity: int = CAPACITY) -> int:
    """Martello and Toth's L2: no packing needs fewer sequences."""
    counts = sorted((x, n) for x, n in histogram.items() if n)
    total = sum(x * n for x, n in counts)
    best = -(-total // capacity)
    for a in sorted({0, *(x for x, _ in counts if 2 * x <= capacity)}):
        big = sum(n for x, n in counts if x > capacity - a)
        half = sum(n for x, n in counts if capacity - a >= x > capacity / 2)
        mid = sum(x * n for x, n in counts if capacity - a >= x > capacity / 2)
        small = sum(x * n for x, n in counts if capacity / 2 >= x >= a)
        best = max(best, big + half + max(0, -(-(small - (half * capacity - mid)) // capacity)))
    return best


def runs(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, sequences, first sequence, offset): where the next pieces of a length go, one to a sequence."""
    taken: dict[int, int] = defaultdict(int)
    sequence, out = 0, []
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            out.append((length, taken[length], n, sequence, offset))
            taken[length] += n
            offset += length
        sequence += n
    return out


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``.

    Documents are tokenised and end in id 0; only longer ones are cut. Null and empty texts are pieces of one token.
    Repeated rows are packed each. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    # the number of a row is kept with it, so it stays whatever is computed again
    all_pieces = checkpointed(pieces(docs, path, capacity, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()))
    lengths = [(r["length"], r["n"]) for r in all_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()]
    rows = max(GROUP_ROWS, -(-sum(n for _, n in lengths) // GROUPS))
    long = T.LongType()
    fields = lambda *names: T.StructType([T.StructField(n, long) for n in names])
    salts = F.broadcast(spark.createDataFrame([(x, -(-n // rows)) for x, n in lengths], fields("length", "_salts")))
    salted = all_pieces.join(salts, "length").withColumn("_salt", F.pmod(F.xxhash64("_row"), F.col("_salts")))
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")).collect()
    histogram: dict[int, int] = defaultdict(int)
    firsts = []
    for r in sorted(counts, key=lambda r: (r["length"], r["_salt"])):
        firsts.append((r["length"], r["_salt"], histogram[r["length"]]))
        histogram[r["length"]] += r["n"]
    places = runs(plan(dict(histogram), capacity))
    first_rank = F.broadcast(spark.createDataFrame(firsts, fields("length", "_salt", "_first")))
    order = Window.partitionBy("length", "_salt").orderBy("_row")
    ranked = salted.withColumn("_in_salt", F.row_number().over(order) - 1).join(first_rank, ["length", "_salt"]).withColumn("_rank", F.col("_first") + F.col("_in_salt"))
    by_length: dict[int, list[tuple]] = defaultdict(list)
    for length, *rest in places:
        by_length[length].append(tuple(rest))
    entry = T.StructType([T.StructField("ranks", T.ArrayType(long)), T.StructField("sequences", T.ArrayType(long)), T.StructField("offsets", T.ArrayType(long))])
    table = spark.createDataFrame([(x, ([r[0] for r in own], [r[2] for r in own], [r[3] for r in own])) for x, own in by_length.items()], T.StructType([T.StructField("length", long), T.StructField("_plan", entry)]))
    # the run that a rank falls into: halving over the sorted first ranks
    longest = max((len(own) for own in by_length.values()), default=1)
    steps = F.array(*(F.lit(1 << k) for k in range(longest.bit_length(), -1, -1)))
    placed = ranked.join(F.broadcast(table), "length").withColumn(
        "_run", F.aggregate(steps, F.lit(-1), lambda at, step: F.when(F.get("_plan.ranks", at + step) <= F.col("_rank"), at + step).otherwise(at))
    )
    sequence = F.get("_plan.sequences", F.col("_run")) + F.col("_rank") - F.get("_plan.ranks", F.col("_run"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), F.get("_plan.offsets", F.col("_run")).alias("offset"))
