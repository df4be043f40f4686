"""Scored sets: users' summed values for each type of event."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import collections as ops
from keyloom.plans.registry import register, table

Z = "WITH z AS (SELECT event_type AS key, user_id::VARCHAR AS member, round(sum(value::DECIMAL(18,4)), 2)::DOUBLE AS score FROM events GROUP BY ALL) "


def zsets(spark, sf_dir):
    total = F.round(F.sum(F.col("value").cast("decimal(18,4)")), 2).cast("double")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("member")).agg(total.alias("score"))


def zlog(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("member"), F.col("value").alias("score"))


def _fold(name, condition, aggregate):
    sql = f"SELECT event_type AS key, user_id::VARCHAR AS member, {aggregate} AS score FROM events GROUP BY ALL"
    register(name, sql)(lambda spark, sf_dir: ops.zadd(zlog(spark, sf_dir), condition))


_fold("zadd_fold", "", "arg_max(value, event_id)")
_fold("zadd_nx", "nx", "arg_min(value, event_id)")
_fold("zadd_gt", "gt", "max(value)")
_fold("zadd_lt", "lt", "min(value)")


@register("zincrby", Z + "SELECT * FROM z")
def zincrby(spark, sf_dir):
    log = zlog(spark, sf_dir).withColumn("score", F.col("score").cast("decimal(18,4)"))
    return ops.zadd(log, "incr").withColumn("score", F.round("score", 2).cast("double"))


@register("zcard", Z + "SELECT key, count(*)::BIGINT AS n FROM z GROUP BY key")
def zcard(spark, sf_dir):
    return ops.summary(zsets(spark, sf_dir))


@register("zrank", Z + "SELECT key, member, score, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank FROM z")
def zrank(spark, sf_dir):
    return ops.zrank(zsets(spark, sf_dir))


@register("zrevrank", Z + "SELECT key, member, score, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rank FROM z")
def zrevrank(spark, sf_dir):
    return ops.zrank(zsets(spark, sf_dir), reverse=True)


def _slice(name, start, stop, order, where, reverse):
    sql = Z + f", r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {order}) - 1 AS rank, count(*) OVER (PARTITION BY key) AS n FROM z) SELECT key, member, score, rank::BIGINT AS rank FROM r WHERE {where}"
    register(name, sql)(lambda spark, sf_dir: ops.zrange(zsets(spark, sf_dir), start, stop, reverse).withColumn("rank", F.col("rank").cast("long")))


_slice("zrevrange_topk", 0, 2, "score DESC, member DESC", "rank <= 2", True)
_slice("zrange_middle", 10, 19, "score, member", "rank BETWEEN 10 AND 19", False)
_slice("zrange_from_end", -5, -1, "score, member", "rank >= n - 5", False)
_slice("zrange_far_stop", 0, -10_000_000, "score, member", "rank = 0", False)


def _by_score(name, low, high, where):
    register(name, Z + f"SELECT * FROM z WHERE {where}")(lambda spark, sf_dir: zsets(spark, sf_dir).where(ops.in_scores(low, high)))


_by_score("zrangebyscore", "500", "2000", "score BETWEEN 500 AND 2000")
_by_score("zrangebyscore_excl", "(500", "(2000", "score > 500 AND score < 2000")
_by_score("zrangebyscore_open", "-inf", "(1000", "score < 1000")


@register("zrevrangebyscore_limit", Z + ", r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rank FROM z WHERE score <= 3000) SELECT key, member, score, rank::BIGINT AS rank FROM r WHERE rank BETWEEN 2 AND 6")
def zrevrangebyscore_limit(spark, sf_dir):
    rows = zsets(spark, sf_dir).where(ops.in_scores("-inf", "3000"))
    return ops.limited(rows, ops.score_order(True), 2, 5).withColumn("rank", F.col("rank").cast("long"))


@register("zcount", Z + "SELECT key, count(*)::BIGINT AS n FROM z WHERE score >= 500 AND score < 2000 GROUP BY key")
def zcount(spark, sf_dir):
    return ops.summary(zsets(spark, sf_dir).where(ops.in_scores("500", "(2000")))


@register("zremrangebyscore", Z + "SELECT * FROM z WHERE NOT (score >= 500 AND score < 2000)")
def zremrangebyscore(spark, sf_dir):
    return zsets(spark, sf_dir).where(~ops.in_scores("500", "(2000"))


@register("zrangebylex", Z + "SELECT * FROM z WHERE member >= '12' AND member < '4'")
def zrangebylex(spark, sf_dir):
    return zsets(spark, sf_dir).where(ops.in_members("[12", "(4"))


@register("zlexcount", Z + "SELECT key, count(*)::BIGINT AS n FROM z WHERE member > '12' GROUP BY key")
def zlexcount(spark, sf_dir):
    return ops.summary(zsets(spark, sf_dir).where(ops.in_members("(12", "+")))


@register("zremrangebylex", Z + "SELECT * FROM z WHERE NOT (member <= '5')")
def zremrangebylex(spark, sf_dir):
    return zsets(spark, sf_dir).where(~ops.in_members("-", "[5"))


@register("zremrangebyrank", Z + ", r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank FROM z) SELECT key, member, score FROM r WHERE rank >= 10")
def zremrangebyrank(spark, sf_dir):
    return ops.after_pop(zsets(spark, sf_dir), 10, ops.score_order(), ["key", "member"])


@register("zpopmax", Z + ", r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rank FROM z) SELECT key, member, score, rank::BIGINT AS rank FROM r WHERE rank < 4")
def zpopmax(spark, sf_dir):
    return ops.popped(zsets(spark, sf_dir), 4, ops.score_order(True)).withColumn("rank", F.col("rank").cast("long"))


@register("zpopmin_remainder", Z + ", r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank FROM z) SELECT key, member, score FROM r WHERE rank >= 4")
def zpopmin_remainder(spark, sf_dir):
    return ops.after_pop(zsets(spark, sf_dir), 4, ops.score_order(), ["key", "member"])


@register("zmpop", Z + "SELECT key, member, score FROM z WHERE key = 'click' ORDER BY score, member LIMIT 3")
def zmpop(spark, sf_dir):
    return ops.multi_pop(zsets(spark, sf_dir), ["missing", "click", "view"], 3, ops.score_order()).select("key", "member", "score")


def _algebra(name, op, keys, weights, aggregate, sql):
    def run(spark, sf_dir):
        return ops.zalgebra(zsets(spark, sf_dir), op, keys, weights, aggregate).withColumn("score", F.round("score", 4))

    register(name, Z + sql)(run)


_algebra("zunion_sum_w", "union", ["click", "view", "error"], [2.0, 0.5, 1.0], "sum", "SELECT member, round(sum(score * CASE key WHEN 'click' THEN 2.0 WHEN 'view' THEN 0.5 ELSE 1.0 END), 4) AS score FROM z WHERE key IN ('click', 'view', 'error') GROUP BY member")
_algebra("zunion_max", "union", ["click", "purchase"], None, "max", "SELECT member, max(score) AS score FROM z WHERE key IN ('click', 'purchase') GROUP BY member")
_algebra("zinter_min", "inter", ["signup", "error", "view"], None, "min", "SELECT member, min(score) AS score FROM z WHERE key IN ('signup', 'error', 'view') GROUP BY member HAVING count(*) = 3")
_algebra("zinter_sum_w", "inter", ["signup", "error"], [1.0, 3.0], "sum", "SELECT member, round(sum(score * CASE key WHEN 'error' THEN 3.0 ELSE 1.0 END), 4) AS score FROM z WHERE key IN ('signup', 'error') GROUP BY member HAVING count(*) = 2")
_algebra("zinter_missing", "inter", ["signup", "missing"], None, "sum", "SELECT member, score FROM z WHERE false")


#: Scored sets whose members differ: users with a summed value of 1,500 at least.
#: Members are users with the band of the value, so that sets differ.
HIGH = "z AS (SELECT event_type AS key, user_id || '.' || floor(value / 20)::INT AS member, round(sum(value::DECIMAL(18,4)), 2)::DOUBLE AS score FROM events GROUP BY ALL) "


def banded(spark, sf_dir):
    total = F.round(F.sum(F.col("value").cast("decimal(18,4)")), 2).cast("double")
    member = F.concat_ws(".", "user_id", F.floor(F.col("value") / 20).cast("int"))
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("key"), member.alias("member")).agg(total.alias("score"))


@register("zdiff", f"WITH {HIGH} SELECT member, score FROM z WHERE key = 'signup' AND member NOT IN (SELECT member FROM z WHERE key IN ('error', 'click'))")
def zdiff(spark, sf_dir):
    return ops.zalgebra(banded(spark, sf_dir), "diff", ["signup", "error", "click"])


@register("zintercard_limit", f"WITH {HIGH}, i AS (SELECT member FROM z WHERE key IN ('signup', 'view') GROUP BY member HAVING count(*) = 2) SELECT least(count(*), 20)::BIGINT AS n FROM i")
def zintercard_limit(spark, sf_dir):
    both = ops.zalgebra(banded(spark, sf_dir), "inter", ["signup", "view"])
    return both.agg(F.least(F.count(F.lit(1)), F.lit(20)).cast("long").alias("n"))


@register("zunionstore", Z + "SELECT key, member, score FROM z WHERE key <> 'view' UNION ALL SELECT 'view', member, max(score) FROM z WHERE key IN ('click', 'purchase') GROUP BY member")
def zunionstore(spark, sf_dir):
    z = zsets(spark, sf_dir)
    return ops.stored(ops.zalgebra(z, "union", ["click", "purchase"], None, "max"), "view", z)


@register("zmscore", Z + "SELECT w.pos::INT AS pos, w.member, z.score FROM (VALUES (0, '7'), (1, 'missing'), (2, '12')) w(pos, member) LEFT JOIN z ON z.member = w.member AND z.key = 'click'")
def zmscore(spark, sf_dir):
    from keyloom.operators.keyspace import ordered_get

    own = zsets(spark, sf_dir).where("key = 'click'").select("member", "score")
    return ordered_get(own, ["7", "missing", "12"], "member").select("pos", "member", "score")


@register("zrandmember")
def zrandmember(spark, sf_dir):
    return ops.sampled(zsets(spark, sf_dir), 5, 11, "member")
