"""Merkle fingerprints of documents: pieces -> paragraphs -> sections -> root, in DataFrame functions only.

A text is split at empty lines into sections and at line ends into paragraphs, and each paragraph into pieces of
eight blank-separated words; all splits keep every character, so equal roots mean equal texts. A paragraph's node is
the SHA-256 of its text, a section's the SHA-256 of its paragraphs' nodes, the root the SHA-256 of the sections' nodes.
Pieces, the lowest level, carry 64-bit hashes. Two trees are alike by the nodes of all levels that they share; where their
roots differ, paragraph nodes that one tree lacks are the branches that were edited.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Eight words with their blanks, or what is left of the paragraph.
PIECE = r"(?s)(?:[^ ]*+ ){8}|.+"
#: Rows meant for one bucket of the ordered neighbour join, and the smallest and largest number of buckets.
BUCKET_ROWS = 2_000
MIN_BUCKETS = 256
MAX_BUCKETS = 65_536


def paragraph_nodes(text: Column) -> Column:
    """array<array<string>>: for each section the nodes of its paragraphs; null counts as empty."""
    sections = F.split(F.coalesce(text, F.lit("")), "\n\n")
    return F.transform(sections, lambda s: F.transform(F.split(s, "\n"), lambda p: F.sha2(p, 256)))


def root(text: Column) -> Column:
    """Hex root of the tree."""
    sections = F.transform(paragraph_nodes(text), lambda nodes: F.sha2(F.array_join(nodes, ""), 256))
    return F.sha2(F.array_join(sections, ""), 256)


def pieces(text: Column) -> Column:
    """array<bigint>: distinct hashes of the pieces of all paragraphs, empty paragraphs left out."""
    paragraphs = F.split(F.coalesce(text, F.lit("")), "\n")
    hashed = F.transform(paragraphs, lambda p: F.transform(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), lambda x: F.xxhash64(x)))
    return F.array_distinct(F.flatten(hashed))


def tree(text: Column) -> Column:
    """struct: root, nodes of sections and of paragraphs in order, distinct pieces."""
    paragraphs = paragraph_nodes(text)
    sections = F.transform(paragraphs, lambda nodes: F.sha2(F.array_join(nodes, ""), 256))
    return F.struct(F.sha2(F.array_join(sections, ""), 256).alias("root"), sections.alias("sections"), F.flatten(paragraphs).alias("paragraphs"), pieces(text).alias("pieces"))


LEVELS = ("sections", "paragraphs", "pieces")


def likeness(a: Column, b: Column) -> Column:
    """1 for trees of equal roots; else their common nodes, level by level, over the larger tree's, and below 1."""
    nodes = lambda t: sum((F.size(F.array_distinct(t[k])) for k in LEVELS[1:]), F.size(F.array_distinct(t[LEVELS[0]])))
    common = sum((F.size(F.array_intersect(a[k], b[k])) for k in LEVELS[1:]), F.size(F.array_intersect(a[LEVELS[0]], b[LEVELS[0]])))
    most = F.greatest(nodes(a), nodes(b))
    return F.when(a["root"] == b["root"], F.lit(1.0)).otherwise(F.least(common, most - 0.5) / most)


def with_fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint`` (root), ``paragraph_nodes`` and ``pieces``; columns of these names are replaced."""
    text = docs[text_col]
    return docs.withColumns({"fingerprint": root(text), "paragraph_nodes": F.flatten(paragraph_nodes(text)), "pieces": pieces(text)})


def edited_paragraphs(nodes_a: Column, nodes_b: Column) -> Column:
    """array<int>: positions (from 0) of paragraphs of a whose nodes b has nowhere: the edited branches."""
    return F.filter(F.transform(nodes_a, lambda n, i: F.when(~F.array_contains(nodes_b, n), i)), lambda i: i.isNotNull())


def edited_branches(a: Column, b: Column) -> list[Column]:
    """edited_branches, first_edited, last_edited: how many different paragraph nodes of tree a tree b lacks, and where (from 0) the first and the last of them stand."""
    lost = F.array_except(a["paragraphs"], b["paragraphs"])
    place = lambda k: F.when(F.size(lost) > 0, F.array_position(a["paragraphs"], F.element_at(lost, k)) - 1)
    return [F.size(lost).cast("long").alias("edited_branches"), place(1).alias("first_edited"), place(-1).alias("last_edited")]


def _bucket_of(key: Column, bounds: list[int]) -> Column:
    """Number of sorted ``bounds`` not above ``key``, found by halving."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    literal = F.lit(bounds)
    return F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(literal, at + step - 1) <= key, at + step).otherwise(at)
    )


def with_next(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``docs`` with ``next_<column>``: the values in the row with the next larger ``key``, the first row's for the last.

    Rows are dealt once, by ranges of the key. The first row of each range goes to the range before as well, so
    that no range has to see another. A null key sorts first; of rows with one key, the order is by all ``columns``.
    """
    order = F.coalesce(docs[key].cast("long"), F.lit(-(2**63)))
    rows = docs.select(order.alias("_key"), docs[key], *(docs[c] for c in columns))
    stats = docs.select(order.alias("_key"))
    n = stats.count()
    if n == 0:
        bounds: list[int] = []
    else:
        k = max(1, min(MAX_BUCKETS, max(MIN_BUCKETS, n // BUCKET_ROWS), n - 1))
        cuts = [i / (k + 1) for i in range(k + 1)]
        found = stats.agg(F.percentile_approx("_key", cuts, 20 * (k + 1)).alias("cuts"), F.min("_key").alias("least")).first()
        bounds = sorted({found["least"], *found["cuts"]})
    last = len(bounds) - 1
    own = _bucket_of(F.col("_key"), bounds) - 1
    opens = F.array_contains(F.lit(bounds), F.col("_key")) if bounds else F.lit(False)
    before = F.when(own == 0, F.lit(last)).otherwise(own - 1)
    places = F.when(opens, F.array(F.struct(own.alias("bucket"), F.lit(0).alias("guest")), F.struct(before.alias("bucket"), F.lit(1).alias("guest"))))
    places = places.otherwise(F.array(F.struct(own.alias("bucket"), F.lit(0).alias("guest"))))
    dealt = rows.select("*", F.explode(places).alias("_at")).select("*", F.col("_at.bucket").alias("_bucket"), F.col("_at.guest").alias("_guest")).drop("_at")
    dealt = dealt.repartition("_bucket")
    ordered = Window.partitionBy("_bucket").orderBy("_guest", "_key", *(F.xxhash64(c) for c in columns[:1]))
    out = dealt.withColumns({f"next_{c}": F.lead(c).over(ordered) for c in columns})
    return out.where("_guest = 0").drop("_bucket", "_guest", "_key")


def edited_text(text: Column, n: Column, following: Column) -> Column:
    """The last floor(n/4) characters replaced by the first as many, or all, of the text that follows."""
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - cut), F.substr(following, F.lit(1), cut))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its fingerprint, that of its edited text, and its likeness to that text and to the next document.

    Null texts count as empty. Ties of ids are ordered by their texts' hashes. An empty table gives no rows; extra
    columns are ignored, whatever their names.
    """
    base = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    pairs = with_next(base, "doc_id", ["text"])
    n = F.char_length("text")
    pairs = pairs.select("doc_id", "text", "next_text", n.alias("n_chars"), edited_text(F.col("text"), n, F.col("next_text")).alias("edited"))
    trees = pairs.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), *(tree(F.col(c)).alias(t) for c, t in (("text", "own"), ("edited", "other"), ("next_text", "following"))))
    own, other = F.col("own"), F.col("other")
    return trees.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.col("own.root").alias("fingerprint"),
        F.col("other.root").alias("edited_fingerprint"),
        likeness(own, other).alias("near_edited"),
        likeness(own, F.col("following")).alias("near_next"),
        *edited_branches(own, other),
    )


#: The same rows in DuckDB; pieces are compared as text where the query compares hashes.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS cnt FROM d),
p AS (SELECT a.doc_id, a.text, b.text AS next_text FROM o a JOIN o b ON b.rn = CASE WHEN a.rn = a.cnt THEN 1 ELSE a.rn + 1 END),
e AS (SELECT *, length(text) AS n, substring(text, 1, length(text) - length(text) // 4) || substring(next_text, 1, length(text) // 4) AS edited FROM p),
u AS (
  SELECT doc_id, n, sha256(edited) AS edited_sha256, [text, edited, next_text] AS texts,
    list_transform([text, edited, next_text], lambda x: list_transform(string_split(x, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda q: sha256(q)))) AS nodes
  FROM e
),
v AS (
  SELECT doc_id, n, edited_sha256,
    list_transform(nodes, lambda t: list_transform(t, lambda s: sha256(array_to_string(s, '')))) AS sections,
    list_transform(nodes, lambda t: flatten(t)) AS paragraphs,
    list_transform(texts, lambda x: list_distinct(flatten(list_transform(string_split(x, chr(10)), lambda q: regexp_extract_all(q, '(?s)(?:[^ ]* ){8}|.+'))))) AS pieces
  FROM u
),
t AS (
  SELECT *, list_transform(sections, lambda s: sha256(array_to_string(s, ''))) AS roots,
    list_transform([1, 2, 3], lambda k: len(list_distinct(sections[k])) + len(list_distinct(paragraphs[k])) + len(pieces[k])) AS sizes,
    list_transform([1, 2, 3], lambda k: len(list_intersect(sections[1], sections[k])) + len(list_intersect(paragraphs[1], paragraphs[k])) + len(list_intersect(pieces[1], pieces[k]))) AS common,
    list_filter(paragraphs[1], lambda x: NOT list_contains(paragraphs[2], x)) AS lost
  FROM v
)
SELECT doc_id, n AS n_chars, edited_sha256, roots[1] AS fingerprint, roots[2] AS edited_fingerprint,
  CASE WHEN roots[1] = roots[2] THEN 1.0::DOUBLE ELSE least(common[2], greatest(sizes[1], sizes[2]) - 0.5)::DOUBLE / greatest(sizes[1], sizes[2]) END AS near_edited,
  CASE WHEN roots[1] = roots[3] THEN 1.0::DOUBLE ELSE least(common[3], greatest(sizes[1], sizes[3]) - 0.5)::DOUBLE / greatest(sizes[1], sizes[3]) END AS near_next,
  len(list_distinct(lost))::BIGINT AS edited_branches,
  CASE WHEN len(lost) > 0 THEN list_position(paragraphs[1], lost[1])::BIGINT - 1 END AS first_edited,
  CASE WHEN len(lost) > 0 THEN (SELECT max(list_position(paragraphs[1], y)) FROM (SELECT unnest(lost) AS y))::BIGINT - 1 END AS last_edited
FROM t
"""
