"""Benchmark decontamination: a broadcast hash set of normalised n-grams, scanned over every document's word windows.

Words are lower-cased runs of ASCII letters, digits and non-ASCII characters. An item gives one n-gram per window of
ten words; an item of fewer words is one window. Documents' words become numbers (0: in no item), rolling polynomial
hashes of every window are looked up in the set, and hits are verified word by word. Benchmarks are small against the
corpus, but their size is checked: items are read in blocks of a bounded number of n-grams, each block one scan.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import alnum_words, checkpointed, fresh, slices

#: Words of a window.
WINDOW = 10
#: Item words in one broadcast block; beyond it another scan follows.
BLOCK_WORDS = 2_000_000
#: A document of which more than this share of words is hit is dropped whole; otherwise hit spans are cut.
DROP_SHARE = 0.5
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: The words in text form, in either case, for cutting spans: the complement of the ASCII separators.
WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def windows(words: list[bytes], n: int = WINDOW) -> list[tuple[bytes, ...]]:
    """Windows of n words; all words if they are fewer; none of none."""
    return [tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []


class Index:
    """N-grams of items: word numbers, window hashes by length, and the items of each n-gram for verification."""

    def __init__(self, items: list[tuple], n: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        grams: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item_id, text in items:
            words = alnum_words(text)
            for word in words:
                self.numbers.setdefault(word, len(self.numbers) + 1)
            for gram in windows([self.numbers[w] for w in words], n):
                grams[gram].add(str(item_id))
        self.grams = dict(grams)
        by_length: dict[int, list[tuple[int, ...]]] = defaultdict(list)
        for gram in grams:
            by_length[len(gram)].append(gram)
        self.hashes = {length: np.unique([rolling(np.array(g, np.uint64), length)[0] for g in own]) for length, own in by_length.items()}

    def numbered(self, words: list[bytes]) -> np.ndarray:
        known = self.numbers.get
        return np.fromiter((known(w, 0) for w in words), np.uint64, count=len(words))

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """Mask of words inside any occurrence of an n-gram, and the items of those n-grams."""
        mask, items = np.zeros(len(numbers), bool), set()
        known = numbers > 0
        for length, hashes in self.hashes.items():
            if len(numbers) < length:
                continue
            run = np.cumsum(np.concatenate(([0], known)))
            starts = np.flatnonzero(run[length:] - run[:-length] == length)
            if not len(starts):
                continue
            found = rolling(numbers, length)[starts]
            at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
            for start in starts[hashes[at] == found].tolist():
                if own := self.grams.get(tuple(numbers[start : start + length].tolist())):
                    mask[start : start + length] = True
                    items |= own
        return mask, items


def rolling(numbers: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash of each window of ``length`` numbers, modulo 2**64."""
    out = np.zeros(len(numbers) - length + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length):
            out = out * _BASE + numbers[k : k + len(out)]
    return out


def blocks(items: DataFrame, id_col: str, text_col: str, most_words: int = BLOCK_WORDS) -> Iterator[list[tuple]]:
    """Items with words, in blocks of a bounded number of words, streamed from the cluster."""
    held, words, given = [], 0, 0
    rows = items.where(items[text_col].isNotNull() & items[id_col].isNotNull()).select(items[id_col].alias("i"), items[text_col].alias("t"))
    for row in rows.toLocalIterator():
        held.append((row["i"], row["t"]))
        words += len(row["t"]) // 2 + 1
        if words >= most_words:
            yield held
            held, words, given = [], 0, given + 1
    if held or not given:
        yield held


def scan(docs: DataFrame, items: list[tuple], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document of one block of items: doc_id, n_words, the hit words' positions, the items hit."""
    index = docs.sparkSession.sparkContext.broadcast(Index(items))

    def run(batches):
        own = index.value
        for part in slices(batches):
            out = []
            for text in part.column(1).to_pylist():
                words = alnum_words(text)
                mask, found = own.hits(own.numbered(words))
                out.append((len(words), np.flatnonzero(mask).tolist(), sorted(found)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int32())), pa.array([x[2] for x in out], pa.list_(pa.string()))],
                names=["doc_id", "n_words", "hit", "items"],
            )

    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_words long, hit array<int>, items array<string>")


def hits_by_row(rows: DataFrame, parts: Iterator[list[tuple]]) -> DataFrame:
    """row, hit, items of the rows (row, text) that some block hits; a block's index is given up when its scan is kept."""
    union = None
    for block in parts:
        found = checkpointed(scan(rows, block, "row").where(F.size("hit") > 0).select(F.col("doc_id").alias("row"), "hit", "items"))
        union = found if union is None else union.union(found)
    flat = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    return union.groupBy("row").agg(flat("hit"), flat("items"))


def one_or_more(parts: Iterator[list[tuple]]) -> tuple[list[tuple], bool]:
    """The first block, and whether there are others."""
    return next(parts), next(parts, None) is not None


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or empty text has no words and no hits; null items and items without words give no n-gram; repeated items
    count once by their id. Rows are told apart by a key of their own, so repeated and null document ids stay single rows
    whatever the number of blocks.
    """
    first, more = one_or_more(blocks(items, item_id, item_text))
    if not more:
        hit = scan(docs, first, id_col, text_col)
    else:
        rows = checkpointed(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.monotonically_increasing_id().alias("row")))
        words = scan(rows, [], "row").select(F.col("doc_id").alias("row"), "n_words")
        some = hits_by_row(rows, blocks(items, item_id, item_text))
        none = lambda c: F.coalesce(c, F.array().cast(some.schema[c].dataType)).alias(c)
        hit = rows.select("row", "doc_id").join(words, "row").join(some, "row", "left").select("doc_id", "n_words", none("hit"), none("items"))
    return hit.select(
        "doc_id",
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


def cut(text: str, mask: np.ndarray) -> str:
    """The text without the words under the mask and what stands between them."""
    kept, at = [], 0
    places = [m.span() for m in WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    for first, end in edges.reshape(-1, 2).tolist():
        kept.append(text[at : places[first][0]])
        at = places[end - 1][1]
    return "".join([*kept, text[at:]])


def clean_text(text: str, index: Index, drop_share: float = DROP_SHARE) -> str | None:
    """The text without its hit spans, None if too much of it is hit. Cuts go on until no window is left."""
    words = alnum_words(text)
    mask, _ = index.hits(index.numbered(words))
    if not mask.any():
        return text
    if mask.mean() > drop_share:
        return None
    while mask.any():
        text = cut(text, mask)
        mask, _ = index.hits(index.numbered(alnum_words(text)))
    return text


def cleaned_by_blocks(rows: DataFrame, parts, drop_share: float = DROP_SHARE) -> DataFrame:
    """row, cleaned for the rows (row, text) that are hit: null where too much is hit, by all blocks together.

    A round scans what is hit with every block, then cuts once; rounds go on with the rows that were cut until none is hit.
    """
    done, share = None, drop_share
    while True:
        found = hits_by_row(rows, parts()).select("row", "hit")

        def run(batches, share=share):
            for part in slices(batches):
                texts = []
                for text, hit in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    mask = np.zeros(len(alnum_words(text)), bool)
                    mask[hit] = True
                    texts.append(None if mask.mean() > share else cut(text, mask))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["row", "text"])

        once = checkpointed(rows.join(found, "row").select("row", "text", "hit").mapInArrow(run, "row long, text string"))
        last = once.withColumn("_round", F.lit(0 if done is None else 1))
        done = once if done is None else checkpointed(done.join(last.select("row", F.col("text").alias("_text"), "_round"), "row", "left").select("row", F.when(F.col("_round").isNotNull(), F.col("_text")).otherwise(F.col("text")).alias("text")))
        rows, share = once.where("text IS NOT NULL"), 1.0
        if rows.isEmpty():
            return done.withColumnRenamed("text", "cleaned")


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with benchmark spans cut out, and without documents that are mostly benchmark (or nothing else).

    All rows but those stay, and all columns, whatever their names; the length column, where there is one, follows the
    text. Rows with a null or empty text stay as they are; repeated rows are treated alike, whatever their ids. What is
    dropped and cut does not depend on the number of the benchmark's blocks. Empty tables give no rows, and an empty
    benchmark leaves every row as it is.
    """
    first, more = one_or_more(blocks(items, item_id, item_text))
    if not more:
        index = docs.sparkSession.sparkContext.broadcast(Index(first))

        def run(batches):
            own = index.value
            for part in slices(batches):
                place = part.schema.get_field_index(text_col)
                before = part.column(place)
                texts = [t and clean_text(t, own) for t in before.to_pylist()]
                kept = pa.array([t is not None for t in texts], pa.bool_())
                part = part.set_column(place, part.schema.field(place), pa.array(texts, part.schema.field(place).type))
                yield part.filter(pc.or_(kept, before.is_null()))

        out = docs.mapInArrow(run, docs.schema)
    else:
        row, held, new = (fresh(n, docs) for n in ("row", "held", "cleaned"))
        base = checkpointed(docs.withColumn(row, F.monotonically_increasing_id()))
        texts = base.select(F.col(row).alias("row"), F.col(text_col).alias("text")).where("text IS NOT NULL")
        found = cleaned_by_blocks(texts, lambda: blocks(items, item_id, item_text)).select(F.col("row").alias(held), F.col("cleaned").alias(new))
        both = base.join(found, F.col(row) == F.col(held), "left").where(F.col(held).isNull() | F.col(new).isNotNull())
        out = both.select(*(F.when(F.col(held).isNotNull(), F.col(new)).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in docs.columns))
    return out.withColumn(length_col, F.char_length(text_col).cast(out.schema[length_col].dataType)) if length_col in out.columns else out


SQL = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
g AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS gram FROM b WHERE len(w) > 0),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
lens AS (SELECT DISTINCT n FROM g),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n),
q AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM p),
h AS (SELECT DISTINCT q.doc_id, q.n, q.i, g.item_id FROM q JOIN g ON g.n = q.n AND g.gram = q.gram),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
