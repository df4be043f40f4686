"""Text search: benchmark items as queries over documents, tags, ranges and compound conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import search as ops
from keyloom.plans.registry import register, table

TOK = "list_filter(regexp_split_to_array(lower({t}), '[\\s[:punct:]]+'), lambda x: x <> '')"


def _index(*fields):
    """CTEs of an index over (field, table column, weight)."""
    parts = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS field, {weight} AS weight, {TOK.format(t=name)} AS w FROM documents" for name, weight in fields)
    return f"r AS (SELECT * FROM ({parts}) WHERE len(w) > 0), p AS (SELECT doc_id, field, weight, len(w) AS dl, unnest(w) AS term FROM r), t AS (SELECT doc_id, field, weight, dl, term, count(*) AS tf FROM p GROUP BY ALL), f AS (SELECT field, term, count(*) AS df FROM t GROUP BY ALL), n AS (SELECT field, count(*) AS n, greatest(1.0, avg(len(w))) AS avgdl FROM r GROUP BY ALL)"


QUERY = "q AS (SELECT DISTINCT item_id AS query, unnest(list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda x: x <> '')) AS term FROM benchmark)"
BM25 = "round(sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6)"
TFIDF = "round(sum(weight * (1 + ln(tf)) * ln(1 + n / df)), 6)"


def _ranked(score, index, queries=QUERY, on="q.term = t.term", k=10):
    return f"WITH {index}, {queries}, s AS (SELECT query, doc_id, {score} AS score FROM q JOIN t ON {on} JOIN f ON f.field = t.field AND f.term = t.term JOIN n ON n.field = t.field GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) - 1 AS rank FROM s) SELECT query, doc_id, score, rank::BIGINT AS rank FROM o WHERE rank < {k}"


def _best(docs, fields, queries, scoring="bm25"):
    found = ops.best_matches(ops.text_index(docs, fields), queries, 10, scoring=scoring)
    return found.select("query", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _queries(spark, sf_dir):
    return ops.query_terms(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query"))


@register("ft_search_bm25", _ranked(BM25, _index(("text", 1.0))))
def ft_search_bm25(spark, sf_dir):
    return _best(_docs(spark, sf_dir), {"text": 1.0}, _queries(spark, sf_dir))


@register("ft_search_multifield", _ranked(BM25, _index(("text", 1.0), ("source", 5.0)), QUERY.replace("FROM benchmark", "FROM (SELECT item_id, text || ' src' || (item_id % 5) AS text FROM benchmark)")))
def ft_search_multifield(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.concat("text", F.lit(" src"), F.col("item_id") % 5).alias("text"))
    return _best(_docs(spark, sf_dir), {"text": 1.0, "source": 5.0}, ops.query_terms(asked))


@register("ft_search_field", _ranked(BM25, _index(("text", 1.0), ("lang", 2.0)), "q AS (SELECT 1 AS query, 'text' AS field, 'the' AS term)", "q.term = t.term AND q.field = t.field"))
def ft_search_field(spark, sf_dir):
    asked = spark.createDataFrame([(1, "text", "the")], "query int, field string, term string")
    return _best(_docs(spark, sf_dir), {"text": 1.0, "lang": 2.0}, asked)


@register("ft_tfidf", _ranked(TFIDF, _index(("text", 1.0))))
def ft_tfidf(spark, sf_dir):
    return _best(_docs(spark, sf_dir), {"text": 1.0}, _queries(spark, sf_dir), "tf_idf")


@register("ft_tagvals", "SELECT DISTINCT source AS tag FROM documents WHERE source <> ''")
def ft_tagvals(spark, sf_dir):
    return ops.tag_values(_docs(spark, sf_dir), "source")


@register("ft_info", "SELECT 'text' AS field, count(*)::BIGINT AS n, round(greatest(1.0, avg(len(w))), 6) AS avgdl FROM (SELECT " + TOK.format(t="text") + " AS w FROM documents) WHERE len(w) > 0")
def ft_info(spark, sf_dir):
    return ops.text_index(_docs(spark, sf_dir), {"text": 1.0}).fields.select("field", "n", F.round("avgdl", 6).alias("avgdl"))


HAS = "list_contains(" + TOK.format(t="text") + ", '{}')"


@register("ft_terms_and", f"SELECT doc_id FROM documents WHERE {HAS.format('the')} AND {HAS.format('and')}")
def ft_terms_and(spark, sf_dir):
    return ops.by_terms(ops.text_index(_docs(spark, sf_dir), {"text": 1.0}), "text", ["The", "and"], "and")


@register("ft_compound_not", f"SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars BETWEEN 500 AND 4000 AND NOT coalesce({HAS.format('the')}, false)")
def ft_compound_not(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    both = ops.compound("and", [ops.by_tag(docs, "lang", "en"), ops.by_number(docs, "n_chars", 500, 4000)])
    return ops.compound("not", [both, ops.by_terms(ops.text_index(docs, {"text": 1.0}), "text", ["the"])])


@register("ft_compound_or", "SELECT doc_id FROM documents WHERE lang = 'de' OR n_chars <= 200")
def ft_compound_or(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return ops.compound("or", [ops.by_tag(docs, "lang", "de"), ops.by_number(docs, "n_chars", 0, 200)])


@register("ft_sortby", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10 OFFSET 5")
def ft_sortby(spark, sf_dir):
    return ops.sort_by(_docs(spark, sf_dir), F.col("n_chars"), True, 10, 5).select("doc_id", "n_chars")


@register("ft_index_hashes", "SELECT 'customer:' || c_custkey AS doc_id, c_name AS name, c_nationkey::DOUBLE AS nation, c_mktsegment AS segment FROM customer")
def ft_index_hashes(spark, sf_dir):
    from keyloom.plans.containers import hashes

    found = ops.from_hashes(hashes(spark, sf_dir), ["customer:"], {"name": "text", "nation": "numeric", "segment": "tag"})
    return found.withColumn("segment", F.array_join("segment", ","))


@register("ft_terms_or", f"SELECT doc_id FROM documents WHERE {HAS.format('license')} OR {HAS.format('copyright')}")
def ft_terms_or(spark, sf_dir):
    return ops.by_terms(ops.text_index(_docs(spark, sf_dir), {"text": 1.0}), "text", ["License", "copyright"], "or")


@register("ft_terms_not", f"SELECT doc_id FROM documents WHERE NOT coalesce({HAS.format('the')} OR {HAS.format('and')}, false)")
def ft_terms_not(spark, sf_dir):
    return ops.by_terms(ops.text_index(_docs(spark, sf_dir), {"text": 1.0}), "text", ["the", "and"], "not")


ASKED = "q AS (SELECT 1 AS query, unnest(['the', 'license', 'and']) AS term)"
SCORES = f"WITH {_index(('text', 1.0))}, {ASKED}, s AS (SELECT doc_id, {BM25} AS score FROM q JOIN t ON q.term = t.term JOIN f ON f.field = t.field AND f.term = t.term JOIN n ON n.field = t.field GROUP BY ALL)"


def _asked(spark, docs):
    asked = spark.createDataFrame([(1, t) for t in ("the", "license", "and")], "query int, term string")
    return ops.bm25(ops.text_index(docs, {"text": 1.0}), asked).select("doc_id", F.round("score", 6).alias("score"))


@register("ft_search_page", SCORES + ", c AS (SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en' AND n_chars BETWEEN 500 AND 4000) SELECT doc_id, lang, n_chars, score FROM c LEFT JOIN s USING (doc_id) ORDER BY score DESC NULLS LAST, doc_id LIMIT 20 OFFSET 5")
def ft_search_page(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    both = ops.compound("and", [ops.by_tag(docs, "lang", "en"), ops.by_number(docs, "n_chars", 500, 4000)])
    return ops.page(ops.scored(both, _asked(spark, docs)), docs, ["lang", "n_chars"], 20, 5)


NEAR = "v AS (SELECT vec_id AS doc_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)) AS near FROM embeddings), k AS (SELECT * FROM v ORDER BY near DESC, doc_id LIMIT 50)"


def _near(spark, sf_dir):
    base = table(spark, sf_dir, "embeddings")
    vector = base.orderBy("vec_id").select("embedding").first()[0]
    return ops.by_vector(base, "embedding", vector, 50, id_col="vec_id")


@register("ft_vector_and_tag", f"WITH {NEAR} SELECT k.doc_id, round(near, 5) AS score FROM k JOIN documents d ON d.doc_id = k.doc_id WHERE lang = 'en'")
def ft_vector_and_tag(spark, sf_dir):
    near = _near(spark, sf_dir)
    found = ops.compound("and", [near.select("doc_id"), ops.by_tag(_docs(spark, sf_dir), "lang", "en")])
    return ops.scored(found, near=near).select("doc_id", F.round("score", 5).alias("score"))


@register("ft_vector_or_terms", SCORES + f", {NEAR}, c AS (SELECT doc_id FROM k UNION SELECT doc_id FROM documents WHERE {HAS.format('license')}) SELECT c.doc_id, round(coalesce(near, score), 5) AS score FROM c LEFT JOIN k USING (doc_id) LEFT JOIN s USING (doc_id)")
def ft_vector_or_terms(spark, sf_dir):
    docs, near = _docs(spark, sf_dir), _near(spark, sf_dir)
    found = ops.compound("or", [near.select("doc_id"), ops.by_terms(ops.text_index(docs, {"text": 1.0}), "text", ["license"])])
    return ops.scored(found, _asked(spark, docs), near).select("doc_id", F.round("score", 5).alias("score"))
