"""Nearest neighbours of every hundredth embedding among all of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import vectors as ops
from keyloom.plans.registry import register, table

V = "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, {score} AS score FROM v a, v b WHERE a.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, neighbour) - 1 AS rank FROM s) SELECT query, neighbour, round(score, 5) AS score, rank::BIGINT AS rank FROM r WHERE rank < 10"
#: Share of the true neighbours that the inverted file is to find.
RECALL = 0.95


def _knn(name, metric, score):
    def run(spark, sf_dir):
        base = table(spark, sf_dir, "embeddings")
        found = ops.knn(base, base.where("vec_id % 100 = 0"), 10, metric)
        return found.select("query", "neighbour", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))

    register(name, V.format(score=score))(run)


_knn("knn_cosine", "cosine", "list_cosine_similarity(a.e, b.e)")
_knn("knn_l2", "l2", "1 / (1 + list_distance(a.e, b.e))")
_knn("knn_ip", "ip", "list_inner_product(a.e, b.e)")


def ann_parts(spark, sf_dir):
    base = table(spark, sf_dir, "embeddings")
    centroids = ops.train_cells(base, ops.cells_for(base.count()))
    index = ops.cell_index(base, centroids)
    probes = ops.probes_for(base, centroids, 10, RECALL, index=index)
    return ops.ann(index, ops.cells_near(base.where("vec_id % 100 = 0"), centroids, probes), 10)


@register("ann_ivf")
def ann_ivf(spark, sf_dir):
    return ann_parts(spark, sf_dir).select("query", "neighbour", F.round("score", 5).alias("score"), "rank")


@register("ann_recall")
def ann_recall(spark, sf_dir):
    base = table(spark, sf_dir, "embeddings")
    return ops.recall(ann_parts(spark, sf_dir), ops.knn(base, base.where("vec_id % 100 = 0"), 10))
