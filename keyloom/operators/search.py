"""Text search over documents: BM25 and TF-IDF, tags, numeric ranges, vectors, and compound queries as DataFrames.

An index is a lazy table of token arrays (doc_id, field, weight, words) and the sizes of its fields; no posting is
exchanged before the terms of a query are known. A query is a table (query, [field,] term). ``best_matches`` scores many
queries at once where the documents are: frequencies of the asked terms are summed over the tasks, then every task
multiplies its documents' term weights with the queries' and keeps the best of each, so documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from keyloom.functions.values import tokens
from keyloom.operators import vectors
from keyloom.operators.ordering import firsts
from keyloom.sources.shared import spread

#: Saturation and length weight of BM25.
K1, B = 1.2, 0.75
#: Asked (query, field, term) rows that one broadcast block holds, and documents that a task scores at once.
BLOCK_TERMS, ROWS = 200_000, 256


def from_hashes(hashes: DataFrame, prefixes: list[str], fields: dict[str, str], separator: str = ",") -> DataFrame:
    """FT.CREATE ON HASH: a row for each hash whose key has one of the prefixes, its fields by kind.

    ``text`` stays; ``numeric`` becomes a double, null where it is none; ``tag`` an array of trimmed, non-empty tags;
    ``vector`` an array of floats from numbers between commas or blanks, null where any is none.
    """
    own = hashes.where(reduce(Column.__or__, (F.col("key").startswith(p) for p in prefixes)) if prefixes else F.lit(True))
    wide = own.groupBy(F.col("key").alias("doc_id")).pivot("field", list(fields)).agg(F.first("value"))
    numbers = lambda c: F.transform(F.split(F.trim(c), "[, ]+"), lambda x: x.try_cast("float"))
    made = {
        "text": lambda c: F.col(c),
        "numeric": lambda c: F.col(c).try_cast("double"),
        "tag": lambda c: F.filter(F.transform(F.split(F.col(c), f"[{separator}]"), lambda t: F.trim(t)), lambda t: t != ""),
        "vector": lambda c: F.when(~F.exists(numbers(F.col(c)), lambda x: x.isNull()), numbers(F.col(c))),
    }
    return wide.select("doc_id", *(made[kind](name).alias(name) for name, kind in fields.items()))


@dataclass
class TextIndex:
    """One row a document, with its words in each field (columns w0, w1, ... in order of ``weights``), and the fields' sizes."""

    docs: DataFrame
    weights: dict[str, float]
    fields: DataFrame

    def words(self, field: str) -> Column:
        return F.col(f"w{list(self.weights).index(field)}")

    def postings(self, asked: DataFrame) -> DataFrame:
        """doc_id, field, weight, dl, term, tf for the terms of ``asked`` only; other words stay where they are."""
        own = [F.struct(F.lit(f).alias("field"), F.lit(w).alias("weight"), self.words(f).alias("words")) for f, w in self.weights.items()]
        rows = self.docs.select("doc_id", F.explode(F.array(*own)).alias("p")).select("doc_id", "p.field", "p.weight", F.size("p.words").cast("long").alias("dl"), F.explode("p.words").alias("term"))
        return rows.join(asked.select("term").distinct(), "term").groupBy("field", "term", "doc_id", "weight", "dl").agg(F.count(F.lit(1)).alias("tf"))


def text_index(docs: DataFrame, fields: dict[str, float], id_col: str = "doc_id") -> TextIndex:
    """Index of text columns with weights (0 and below count as 1). A document without words in a field does not count there."""
    narrow = spread(docs.select(docs[id_col].alias("doc_id"), *(docs[name].alias(f"t{k}") for k, name in enumerate(fields))))
    wide = narrow.select("doc_id", *(F.coalesce(tokens(F.col(f"t{k}")), F.array().cast("array<string>")).alias(f"w{k}") for k in range(len(fields))))
    n = [F.count(F.when(F.size(f"w{k}") > 0, 1)) for k in range(len(fields))]
    own = [F.struct(F.lit(f).alias("field"), n[k].alias("n"), F.greatest(F.lit(1.0), F.sum(F.size(f"w{k}")) / n[k]).alias("avgdl")) for k, f in enumerate(fields)]
    sizes = wide.agg(F.array(*own).alias("f")).select(F.explode("f").alias("f")).select("f.*").where("n > 0")
    return TextIndex(wide, {f: float(w) if w > 0 else 1.0 for f, w in fields.items()}, sizes)


def _matched(index: TextIndex, queries: DataFrame) -> DataFrame:
    """Rows of postings for (query, term[, field]), with df and the field's size. The field table has a row per field."""
    on = ["term", "field"] if "field" in queries.columns else ["term"]
    postings = index.postings(queries)
    df = postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    return postings.join(queries.distinct(), on).join(df, ["field", "term"]).join(F.broadcast(index.fields), "field")


def bm25(index: TextIndex, queries: DataFrame) -> DataFrame:
    """query, doc_id, score of every match: sums over terms and fields, each with its field's weight."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return _matched(index, queries).groupBy("query", "doc_id").agg(F.sum(F.col("weight") * idf * tf).alias("score"))


def tf_idf(index: TextIndex, queries: DataFrame) -> DataFrame:
    """query, doc_id, score of every match by (1 + ln tf) * ln(1 + n / df)."""
    one = F.col("weight") * (1 + F.log(F.col("tf"))) * F.log(1 + F.col("n") / F.col("df"))
    return _matched(index, queries).groupBy("query", "doc_id").agg(F.sum(one).alias("score"))


def _blocks(queries: DataFrame, most: int) -> Iterator[list[tuple]]:
    """(query, field or None, term) rows of whole queries, in blocks of about ``most`` rows, streamed from the cluster."""
    field = F.col("field") if "field" in queries.columns else F.lit(None).cast("string")
    held: list[tuple] = []
    for r in queries.select("query", field.alias("field"), "term").distinct().orderBy("query", "field", "term").toLocalIterator():
        if len(held) >= most and r["query"] != held[-1][0]:
            yield held
            held = []
        held.append((r["query"], r["field"], r["term"]))
    if held:
        yield held


def _counts(words: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term number and count of each asked term in rows of words."""
    sizes = np.asarray(words.value_lengths().fill_null(0))
    found = pc.index_in(words.flatten(), value_set=terms)
    known = np.asarray(found.is_valid().to_numpy(zero_copy_only=False))
    rows, ids = np.repeat(np.arange(len(sizes)), sizes)[known], found.drop_null().to_numpy().astype(np.int64)
    both, n = np.unique(rows * len(terms) + ids, return_counts=True)
    return both // len(terms), both % len(terms), n


def _frequencies(index: TextIndex, terms: list[str]) -> tuple[dict[tuple[str, str], int], dict[str, tuple[int, float]]]:
    """(field, term) -> documents that hold it, for the asked terms, and field -> its number of documents and mean length.

    Each task sends one row a field and term at most.
    """
    held, fields = index.docs.sparkSession.sparkContext.broadcast(terms), list(index.weights)

    def run(batches):
        own = pa.array(held.value, pa.string())
        # after the terms' counts stand those of documents with words, and of their words
        seen = np.zeros((len(fields), len(own) + 2), np.int64)
        for batch in batches:
            for k in range(len(fields)):
                sizes = np.asarray(batch.column(k).value_lengths().fill_null(0))
                seen[k] += np.concatenate((np.bincount(_counts(batch.column(k), own)[1], minlength=len(own)), [(sizes > 0).sum(), sizes.sum()]))
        for k, counts in enumerate(seen):
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k)), pa.array(some), pa.array(counts[some])], names=["field", "term", "df"])

    found = index.docs.drop("doc_id").mapInArrow(run, "field long, term long, df long").groupBy("field", "term").agg(F.sum("df").alias("df"))
    told = {(r["field"], r["term"]): r["df"] for r in found.collect()}
    n = len(terms)
    sizes = {f: (told[k, n], max(1.0, told[k, n + 1] / told[k, n])) for k, f in enumerate(fields) if (k, n) in told}
    return {(fields[k], terms[t]): df for (k, t), df in told.items() if t < n}, sizes


def best_matches(index: TextIndex, queries: DataFrame, n: int, offset: int = 0, scoring: str = "bm25", digits: int = 6) -> DataFrame:
    """The page of each query (query, doc_id, score, rank), best ``score`` (rounded) first, ties by doc_id.

    Queries are read in blocks of a bounded number of terms; each block is one scan for the terms' frequencies and one
    that scores, and each task sends offset + n rows a query. A query without a match gives no row.
    """
    spark, fields = index.docs.sparkSession, list(index.weights)
    schema = T.StructType([T.StructField("query", queries.schema["query"].dataType), T.StructField("doc_id", index.docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    found, keep = None, offset + n
    for block in _blocks(queries, BLOCK_TERMS):
        terms = sorted({t for _, _, t in block})
        names = list(dict.fromkeys(q for q, _, _ in block))
        number, place = {t: k for k, t in enumerate(terms)}, {q: k for k, q in enumerate(names)}
        (df, sizes), asked = _frequencies(index, terms), []
        for field in fields:
            total, mean = sizes.get(field, (0, 1.0))
            rows = [(number[t], place[q], df[field, t]) for q, f, t in block if f in (None, field) and (field, t) in df]
            t, q, own = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
            idf = np.log(1 + (total - own + 0.5) / (own + 0.5)) if scoring == "bm25" else np.log(1 + total / np.maximum(own, 1))
            asked.append((t, q, idf, mean, index.weights[field]))
        held = spark.sparkContext.broadcast((terms, names, asked))

        def run(batches, held=held):
            terms, names, asked = held.value
            own, best = pa.array(terms, pa.string()), [[] for _ in names]
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    scores = np.zeros((part.num_rows, len(names)))
                    for k, (t, q, idf, mean, weight) in enumerate(asked):
                        rows, ids, tf = _counts(part.column(k + 1), own)
                        dl = np.asarray(part.column(k + 1).value_lengths())[rows]
                        gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean)) if scoring == "bm25" else 1 + np.log(tf)
                        columns, places = np.unique(ids, return_inverse=True)
                        some = np.isin(t, columns)
                        left, right = np.zeros((part.num_rows, len(columns))), np.zeros((len(columns), len(names)))
                        left[rows, places] = weight * gain
                        right[np.searchsorted(columns, t[some]), q[some]] = idf[some]
                        scores += left @ right
                    doc_ids, scores = part.column(0).to_pylist(), np.round(scores, digits)
                    for k in np.flatnonzero((scores > 0).any(0)).tolist():
                        own_scores = scores[:, k]
                        hits = np.flatnonzero(own_scores > max(0.0, best[k][-1][0] if len(best[k]) == keep else 0.0) - 10.0**-digits)
                        new = [(own_scores[i], doc_ids[i]) for i in hits[own_scores[hits] > 0].tolist() if doc_ids[i] is not None]
                        best[k] = sorted(best[k] + new, key=lambda x: (-x[0], x[1]))[:keep]
            rows = [(names[k], i, x) for k, own_best in enumerate(best) for x, i in own_best]
            yield pa.RecordBatch.from_pylist([dict(zip(("query", "doc_id", "score"), r, strict=True)) for r in rows], schema=arrow)

        part = index.docs.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    found = spark.createDataFrame([], schema) if found is None else found
    return firsts(found, ["query"], [F.desc("score"), F.asc("doc_id")], keep).where(F.col("rank") >= offset)


def query_terms(queries: DataFrame, text_col: str = "text", id_col: str = "query") -> DataFrame:
    """query, term: lower-case words between white space; punctuation stays in them, as in a bare query."""
    return queries.select(F.col(id_col).alias("query"), F.explode(F.split(F.lower(F.trim(text_col)), r"\s+")).alias("term")).where("term <> ''")


def top(scored: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """The page of each query by score and then id."""
    return firsts(scored, ["query"], [F.desc("score"), F.asc("doc_id")], offset + n).where(F.col("rank") >= offset)


def tag_values(docs: DataFrame, field: str, separator: str = ",") -> DataFrame:
    """Distinct tags, trimmed, without empty ones."""
    return docs.select(F.explode(F.split(F.col(field), f"[{separator}]")).alias("tag")).select(F.trim("tag").alias("tag")).where("tag <> ''").distinct()


# Conditions: each gives the doc_ids that it holds for.


def by_terms(index: TextIndex, field: str, terms: list[str], mode: str = "or") -> DataFrame:
    """Documents with all (``and``), any (``or``) or none (``not``) of the terms in a field, decided in the row."""
    words, wanted = index.words(field), F.array(*(F.lit(t) for t in sorted({t.lower() for t in terms})))
    hits = {"and": F.size(F.array_except(wanted, words)) == 0, "or": F.arrays_overlap(words, wanted), "not": ~F.arrays_overlap(words, wanted)}
    return index.docs.where(hits[mode]).select("doc_id")


def by_number(docs: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Inclusive range; reaches the scan."""
    return docs.where(F.col(column).between(low, high)).select("doc_id")


def by_tag(docs: DataFrame, column: str, tag: str, separator: str = ",") -> DataFrame:
    """An exact tag."""
    return docs.where(F.array_contains(F.transform(F.split(F.col(column), f"[{separator}]"), lambda t: F.trim(t)), tag)).select("doc_id")


def compound(op: str, parts: list[DataFrame]) -> DataFrame:
    """``and``: in all; ``or``: in any; ``not``: in the first and in no other. Parts have distinct doc_ids."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part).distinct() if op == "or" else first.join(part, "doc_id", "left_semi" if op == "and" else "left_anti")
    return first


def by_vector(docs: DataFrame, column: str, vector: list[float], k: int, metric: str = "cosine", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, score): the k documents nearest to one vector; ``doc_id`` alone is the condition of a compound query."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[column].alias("vector"))
    asked = docs.sparkSession.createDataFrame([(0, vector)], "doc_id long, vector array<float>")
    return vectors.knn(rows, asked, k, metric, "doc_id", "vector").select(F.col("neighbour").alias("doc_id"), "score")


def scored(found: DataFrame, text: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
    """(doc_id, score) for the documents of a condition: a vector's similarity where there is one, else the text's score, else null.

    ``text`` and ``near`` are (doc_id, score); with ``near`` alone, documents without a similarity are left out.
    """
    out = found.select("doc_id")
    for name, scores in (("near", near), ("text", text)):
        held = None if scores is None else scores.groupBy("doc_id").agg(F.sum("score").alias(name))
        out = out.withColumn(name, F.lit(None).cast("double")) if held is None else out.join(held, "doc_id", "inner" if name == "near" and text is None else "left")
    return out.select("doc_id", F.coalesce("near", "text").alias("score"))


def page(found: DataFrame, docs: DataFrame, fields: list[str], n: int, offset: int = 0, with_scores: bool = True, id_col: str = "doc_id") -> DataFrame:
    """LIMIT, RETURN and WITHSCORES: the page of (doc_id, score) by score, then id, with the documents' ``fields``.

    The page is cut first (top rows in every task, then merged), so fields are read for its documents only.
    """
    cut = found.orderBy(F.col("score").desc_nulls_last(), "doc_id").offset(offset).limit(n)
    own = docs.select(docs[id_col].alias("doc_id"), *fields)
    out = own.join(F.broadcast(cut), "doc_id")
    return out if with_scores else out.drop("score")


def sort_by(docs: DataFrame, column: Column, descending: bool, n: int, offset: int = 0, id_col: str = "doc_id") -> DataFrame:
    """SORTBY with LIMIT: top rows are kept in every task, then merged."""
    return docs.orderBy(column.desc() if descending else column.asc(), id_col).offset(offset).limit(n)
