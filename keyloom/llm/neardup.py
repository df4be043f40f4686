"""Near-duplicate classes: MinHash bands propose, odd sketches sift, full shingle sets decide.

A text's set holds its distinct five-word shingles. Texts with equal sets are one node. 240 MinHash values make 48
bands of five (a pair at similarity 0.75 shares no band once in 400,000), and, folded into a bitmap of 512 parities, an
odd sketch: the number of ones in the XOR of two sketches tells a high similarity closely.

Buckets are never expanded into all pairs. Each node first meets only hubs: of a bucket, the member that meets most
others over all its buckets, which in a family of copies is the text that they were made from. Of its hubs a node takes
the two with which it shares most bands; what the sketches let pass is decided on the full sets, and linked nodes take
the hub's label. Rounds go on, with hubs at random, while a round links a tenth of the pairs it tried at least.

What is left are nodes of buckets that hold several labels. These meet on their rarest shingles (a prefix filter over
the sets, exact for every pair): of two sets of sizes n and m that are linked, at least 3/7 of n + m shingles are common,
so the rarest n - 3/7 (n + m) + 1 of the one and as many of the other have one in common. Shingles that one label alone
holds are met by nobody, so the copies of a family that are linked with nothing fall out with their own edits, whatever
the family's size. The sketches sift these pairs too, the full sets decide, and classes are formed of all links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import WordHash, checkpointed, fresh, slices, spaced_words

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, ROWS = 48, 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: Hubs that a node meets in a round; another round follows while one link is found in so many tries.
HUBS, WORTH = 2, 10
#: Sizes of sets fall into bands, each wider than the one before by this factor; a shingle is met by pairs of bands.
BAND_WIDTH = 1.1
#: Bits of the map that spares most texts without candidates the exchange; its size is fixed, it only sifts.
BITS = 1 << 23
COLUMNS = 4096

_rng = np.random.default_rng(20_240_229)
_MULTIPLY = _rng.integers(0, 1 << 32, SAMPLES, np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, SAMPLES, np.uint64).astype(np.uint32)
_PLACE = _rng.integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SEED = _rng.integers(0, 1 << 63, SAMPLES, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def shingles(text: str | None, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; of fewer words, of their whole sequence; none without words."""
    words = hashes.array(spaced_words(text))
    if not len(words):
        return words
    n = max(1, len(words) - SHINGLE + 1)
    out = np.full(n, np.uint64(min(len(words), SHINGLE)))
    with np.errstate(over="ignore"):
        for k in range(min(SHINGLE, len(words))):
            out = out + mix(words[k : k + n] * _PLACE[k])
    return np.unique(mix(out))


def min_hashes(items: np.ndarray) -> np.ndarray:
    """The least value of the set under each of the samples' functions."""
    low = (items >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), COLUMNS):
        values = np.multiply.outer(_MULTIPLY, low[at : at + COLUMNS])
        values += _ADD[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """A bucket number for each band; the band's place is part of it."""
    with np.errstate(over="ignore"):
        sums = (mix(least.astype(np.uint64).reshape(BANDS, ROWS) + _SEED[:ROWS]) * _BAND).sum(axis=1, dtype=np.uint64)
        return mix(sums + np.arange(BANDS, dtype=np.uint64) * _BAND[0]).view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Parities of the samples that fall on each bit, as 64-bit words."""
    with np.errstate(over="ignore"):
        bit = mix(least.astype(np.uint64) + _SEED) % np.uint64(SKETCH_BITS)
    return np.packbits(np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1).view(np.int64)


def sketch_similarity(ones: float) -> float:
    """The similarity that so many ones in the XOR of two sketches tell."""
    left = max(1e-9, 1 - 2 * ones / SKETCH_BITS)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * math.log(left)


def most_ones(similarity: float = PERCENT / 100, sigmas: float = 5.0) -> int:
    """Ones that a pair of that similarity exceeds with the chance of ``sigmas`` deviations only."""
    toggles = 2 * (1 - similarity) * SAMPLES
    keep = math.exp(-2 * toggles / SKETCH_BITS)
    mean = SKETCH_BITS / 2 * (1 - keep)
    sampled = 2 * math.sqrt(SAMPLES * similarity * (1 - similarity)) * keep
    folded = math.sqrt(SKETCH_BITS / 4 * (1 - keep**2))
    return math.ceil(mean + sigmas * math.hypot(sampled, folded))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= PERCENT * (len(a) + len(b) - both)


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n (shingles), set_key, sketch, bands for rows (doc_id, text)."""

    def run(batches):
        hashes = WordHash()
        for part in slices(batches):
            sizes, keys, sketches, bucket_rows = [], [], [], []
            for text in part.column(1).to_pylist():
                own = shingles(text, hashes)
                sizes.append(len(own))
                keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                least = min_hashes(own) if len(own) else None
                sketches.append([] if least is None else odd_sketch(least))
                bucket_rows.append([] if least is None else bands(least))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, longs), pa.array(bucket_rows, longs)],
                names=["doc_id", "n", "set_key", "sketch", "bands"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, set_key binary, sketch array<long>, bands array<long>")


def with_bit(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id's bit is set by one of ``ids`` (column id): all of them and few others."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    marks = ids.select(place(F.col("id")).alias("_b")).groupBy(F.shiftright("_b", 6).alias("_w")).agg(F.expr("bit_or(shiftleft(1L, int(pmod(_b, 64))))").alias("_m"))
    # BITS / 64 rows at most, so the broadcast is bounded
    at = docs.withColumn("_b", place(F.col(id_col)))
    hit = at.join(F.broadcast(marks), F.shiftright("_b", 6) == F.col("_w")).where(F.expr("(shiftright(_m, int(pmod(_b, 64))) & 1) = 1"))
    return hit.select(*docs.columns)


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, n, sketch, items (sorted 64-bit hashes as bytes) for ``nodes`` (id, n, sketch, set_key); ``docs`` has doc_id and text."""

    def run(batches):
        hashes = WordHash()
        for part in slices(batches):
            sets = [shingles(t, hashes).tobytes() for t in part.column(4).to_pylist()]
            own = pa.array([xxhash.xxh3_128_digest(x) == k for x, k in zip(sets, part.column(3).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(sets, pa.binary())], names=["id", "n", "sketch", "set_key", "items"]).filter(own)

    texts = with_bit(docs, nodes.select("id")).join(nodes, F.col("doc_id") == F.col("id")).select("id", "n", "sketch", "set_key", "text")
    found = checkpointed(texts.mapInArrow(run, "id long, n long, sketch array<long>, set_key binary, items binary"))
    # only where rows repeat an id and its text are there more sets than nodes
    again = found.count() > nodes.count()
    return checkpointed(found.dropDuplicates(["id", "set_key"])) if again else found


def decided(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links by their full sets, which ``sets`` has as (id, items)."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("_a"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("_b"))

    def run(batches):
        for part in slices(batches):
            own = ([np.frombuffer(x, np.uint64) for x in part.column(k).to_pylist()] for k in (2, 3))
            keep = [linked(x, y) for x, y in zip(*own, strict=True)]
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "_a", "_b")
    return both.mapInArrow(run, "a long, b long").distinct()


def classes(edges: DataFrame) -> DataFrame:
    """id, component (the least id reached) for every id in ``edges`` (a, b).

    Each round every node moves to the least of itself and its neighbours, and edges are drawn anew between the places.
    Least is by id in the first round, which ends stars around their least id, and by a new hash in each later one,
    which shrinks any graph, chains too, by a constant share: rounds grow with the logarithm of the nodes.
    """
    e = checkpointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    nodes = e.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("place", F.col("id"))
    number = 0
    while not e.isEmpty():
        order = lambda c, k=number: F.struct((F.xxhash64(F.col(c), F.lit(k)) if k else F.lit(0)).cast("long").alias("h"), F.col(c).alias("v"))
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("_from")).agg(F.min(order("b")).alias("_m"))
        moves = checkpointed(least.select("_from", F.least(F.col("_m"), order("_from"))["v"].alias("_to")))
        nodes = checkpointed(nodes.join(moves, nodes["place"] == moves["_from"], "left").select("id", F.coalesce("_to", "place").alias("place")))
        left = moves.select(F.col("_from").alias("a"), F.col("_to").alias("_a"))
        right = moves.select(F.col("_from").alias("b"), F.col("_to").alias("_b"))
        drawn = e.join(left, "a").join(right, "b").where("_a <> _b")
        e = checkpointed(drawn.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
        number += 1
    heads = nodes.groupBy("place").agg(F.min("id").alias("component"))
    return nodes.join(heads, "place").select("id", "component")


def sketches_close(x: Column, y: Column) -> Column:
    """Whether two sketches allow a link."""
    ones = [F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(SKETCH_BITS // 64)]
    return sum(ones[1:], ones[0]) <= most_ones()


def size_band(n: Column) -> Column:
    """Number of the band that a set's size falls into."""
    return F.floor(F.log(n.cast("double")) / math.log(BAND_WIDTH)).cast("int")


def rare_meetings(sets: DataFrame, classed: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components, among them all that can be linked; ``sets`` has id, n, items, ``classed`` id, component.

    A shingle's place in a set is by (number of sets that hold it, hash), those that one component alone holds first.
    """

    def run(batches):
        for part in slices(batches):
            own = [np.frombuffer(x, np.int64) for x in part.column(3).to_pylist()]
            lengths = np.fromiter(map(len, own), np.int64, count=len(own))
            at = pa.array(np.repeat(np.arange(len(own)), lengths))
            told = [part.column(k).take(at) for k in (0, 1, 2, 4)]
            yield pa.RecordBatch.from_arrays([*told, pa.array(np.concatenate(own) if own else np.zeros(0, np.int64))], names=["id", "component", "n", "which", "item"])

    # an id may stand for several texts; ``which`` tells their sets apart
    rows = sets.join(classed, "id").select("id", "component", "n", "items", F.xxhash64("items").alias("which"))
    rows = rows.mapInArrow(run, "id long, component long, n long, which long, item long")
    across = rows.groupBy("item").agg(F.count(F.lit(1)).alias("f"), F.min("component").alias("_x"), F.max("component").alias("_y")).where("_x <> _y").select("item", "f")
    own = Window.partitionBy("id", "which")
    placed = rows.join(across, "item").withColumns({"m": F.count(F.lit(1)).over(own), "r": F.row_number().over(own.orderBy("f", "item"))})
    # r - 1 + n - m shingles come before this one; a partner of size s needs 3/7 (n + s) from here on
    whole, share = 100 + PERCENT, PERCENT
    after = F.expr("m - r + 1")
    placed = placed.withColumn("most", F.least(F.floor(after * whole / share) - F.col("n"), F.floor(F.col("n") * 100 / share)).cast("long"))
    placed = placed.withColumn("least", F.ceil(F.col("n") * share / 100).cast("long")).where("most >= least")
    bands_met = F.sequence(size_band(F.col("least")), size_band(F.col("most")))
    keyed = placed.withColumn("_own", size_band(F.col("n"))).withColumn("_other", F.explode(bands_met))
    keyed = checkpointed(keyed.select("id", "component", "n", "most", "item", F.least("_own", "_other").alias("lo"), F.greatest("_own", "_other").alias("hi"), "_own"))
    key = ["item", "lo", "hi"]
    counts = keyed.groupBy(*key, "component").agg(F.count(F.lit(1)).alias("k"))
    main = counts.groupBy(*key).agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts")
    open_rows = keyed.join(main, key)
    u, v = open_rows.where("component <> main").alias("u"), open_rows.alias("v")
    same = [F.col(f"u.{k}") == F.col(f"v.{k}") for k in key]
    once = (F.col("v.component") == F.col("v.main")) | (F.col("u.id") < F.col("v.id"))
    bands_fit = F.expr("u._own + v._own = u.lo + u.hi")
    fit = (F.col("u.component") != F.col("v.component")) & once & bands_fit & (F.col("u.n") <= F.col("v.most")) & (F.col("v.n") <= F.col("u.most"))
    met = u.join(v, same[0] & same[1] & same[2] & fit)
    return met.select(F.least("u.id", "v.id").alias("a"), F.greatest("u.id", "v.id").alias("b")).distinct()


def sifted(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and sketches let pass."""
    of = lambda side: sets.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}"))
    sizes = (100 + PERCENT) * F.least("n_a", "n_b") >= PERCENT * (F.col("n_a") + F.col("n_b"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(sizes & sketches_close(F.col("s_a"), F.col("s_b"))).select("a", "b")


def contracted(classed: DataFrame, met: DataFrame) -> DataFrame:
    """(id, component) with classes joined that links ``met`` (x, y) join, each star of them to its least class."""
    both = met.union(met.select("y", "x")).distinct()
    near = both.groupBy("x").agg(F.min("y").alias("_m")).select("x", F.least("x", "_m").alias("_m"))
    over = both.join(near.select(F.col("x").alias("y"), F.col("_m").alias("_far")), "y").groupBy("x").agg(F.min("_far").alias("_far"))
    # kept apart from what follows, so that the rows of a large class can be split in the join with them
    moves = checkpointed(near.join(over, "x").select("x", F.least("_m", "_far").alias("_to")))
    return checkpointed(classed.join(moves, F.col("component") == F.col("x"), "left").select("id", F.coalesce("_to", "component").alias("component")))


def linked_by_hubs(members: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) found through hubs, and (id, component) of the nodes whose buckets hold other classes still.

    ``members`` has bucket, id, degree. Nodes of a class are joined by links, so pairs within it need no test.
    """
    classed, links, number = sets.select("id", F.col("id").alias("component")).distinct(), None, 0
    while True:
        here = members.join(classed, "id") if number else members.withColumn("component", F.col("id"))
        place = F.xxhash64("id", F.lit(number)) if number else F.col("degree")
        hubs = here.groupBy("bucket").agg(F.max_by(F.struct("id", "component"), F.struct(place, "id")).alias("hub"), F.min("component").alias("_a"), F.max("component").alias("_b"))
        hubs = hubs.where("_a < _b").select("bucket", F.col("hub.id").alias("hub"), F.col("hub.component").alias("x"))
        meets = here.join(hubs, "bucket").where("component <> x").groupBy("id", "hub", "x", "component").agg(F.count(F.lit(1)).alias("together"))
        rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("together"), "hub"))
        star = checkpointed(meets.withColumn("_r", rank).where(F.col("_r") <= HUBS).select(F.col("hub").alias("a"), F.col("id").alias("b"), "x", F.col("component").alias("y")))
        held = checkpointed(decided(sifted(star.select("a", "b"), sets), sets).join(star, ["a", "b"]))
        links = held.select("a", "b") if links is None else links.union(held.select("a", "b"))
        classed = contracted(classed, held.select("x", "y"))
        number += 1
        if held.count() * WORTH <= star.count():
            break
    here = members.join(classed, "id")
    parts = here.groupBy("bucket").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a < _b").select("bucket")
    return links, checkpointed(here.join(parts, "bucket", "left_semi").select("id", "component").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    An id is a document: rows that repeat one are in one class, and links of any of their texts count. Null texts and
    texts without words have no shingles and no links. A null id is linked with nothing and kept. Texts of any length
    are taken whole. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    texts = base.where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = checkpointed(profiles(base))
    some = found.where("n > 0 AND doc_id IS NOT NULL")
    # a set is a node, named by its least id
    firsts = checkpointed(some.groupBy("set_key").agg(F.min("doc_id").alias("id")))
    named = checkpointed(some.select("doc_id", "n", "set_key").join(firsts, "set_key").select("doc_id", "n", "id"))
    nodes = some.join(firsts, (F.col("doc_id") == F.col("id")) & (some["set_key"] == firsts["set_key"]), "left_semi")
    nodes = checkpointed(nodes.select(F.col("doc_id").alias("id"), "n", "set_key", "sketch", "bands").dropDuplicates(["id", "set_key"]))
    placed = nodes.select("id", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("id").alias("_first"), F.max("id").alias("_last"), F.count(F.lit(1)).alias("k")).where("_first < _last").select("bucket", "k")
    members = checkpointed(placed.join(shared, "bucket"))
    degrees = checkpointed(members.groupBy("id").agg(F.sum("k").alias("degree")))
    members = members.select("bucket", "id").join(degrees, "id")
    sets = full_sets(texts, checkpointed(nodes.select("id", "n", "sketch", "set_key").join(degrees.select("id"), "id", "left_semi")))
    links, apart = linked_by_hubs(checkpointed(members), sets)
    rest = checkpointed(sifted(rare_meetings(sets, apart), sets))
    several = named.groupBy("doc_id").agg(F.min("id").alias("_a"), F.max("id").alias("_b")).where("_a < _b").select("doc_id")
    repeated = named.join(several, "doc_id", "left_semi").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    final = classes(links.union(decided(rest, sets)).union(repeated))

    rows = named.join(final, "id", "left").select("doc_id", "n", F.coalesce("component", "id").alias("component_id"))
    rows = rows.union(found.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the least id's, and of rows that repeat an id the one with the least text.

    All columns stay, whatever their names. Rows without an id are kept; texts without words are linked with nothing, but
    a repeated id is one document there too. An empty table gives no rows.
    """
    key, gone = docs[id_col].cast("long"), fresh("gone", docs)
    classed = checkpointed(near_duplicates(docs, id_col, text_col).where("doc_id IS NOT NULL").select("doc_id", "kept"))
    kept = docs.join(classed.where("NOT kept").select(F.col("doc_id").alias(gone)), key == F.col(gone), "left_anti")
    again = checkpointed(classed.where("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("doc_id").alias(gone)))
    if again.isEmpty():
        return kept
    repeated = kept.join(again, key == F.col(gone), "left_semi")
    one = repeated.groupBy(key.alias(gone)).agg(F.min_by(F.struct(*(repeated[c] for c in docs.columns)), F.struct(docs[text_col].isNull(), docs[text_col])).alias(f"{gone}_row"))
    return kept.join(again, key == F.col(gone), "left_anti").union(one.select(*(F.col(f"{gone}_row").getField(c).alias(c) for c in docs.columns)))
