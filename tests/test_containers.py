"""Scored sets, sets, lists, hashes and strings on small tables with known results, hot keys and ties."""

import random

import pytest
from pyspark.sql import functions as F

from keyloom.functions import lcs, values
from keyloom.operators import collections as ops
from keyloom.operators import keyspace
from keyloom.operators.ordering import as_of, numbered


def zsets(spark, rows):
    return spark.createDataFrame(rows, "key string, member string, score double")


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_numbered_over_hot_keys_and_null_keys(spark):
    rng = random.Random(1)
    rows = [("hot", rng.randint(0, 50), i, rng.randint(-9, 9)) for i in range(3000)] + [(None, 1, 5000, 2), (None, 0, 5001, None), ("a", 7, 6000, None)]
    df = spark.createDataFrame(rows, "key string, o int, i int, v int").repartition(7)
    found = numbered(df, ["key"], ["o", "i"], sums={"total": F.col("v")}, highest={"top": F.col("v")}).collect()
    assert len(found) == len(rows)
    for key in ("hot", None, "a"):
        total, top = None, None
        own = sorted((r for r in found if r["key"] == key), key=lambda r: (r["o"], r["i"]))
        for rank, r in enumerate(own):
            if r["v"] is not None:
                total, top = (total or 0) + r["v"], r["v"] if top is None else max(top, r["v"])
            assert (r["rank"], r["total"], r["top"]) == (rank, total, top)
    assert numbered(df.limit(0), ["key"], ["o"]).count() == 0


def test_as_of_takes_the_last_mark_at_or_before(spark):
    rows = spark.createDataFrame([("k", t) for t in range(20)] + [("other", 3)], "key string, t int")
    marks = spark.createDataFrame([("k", 3, "a"), ("k", 9, "b"), ("k", 15, "c")], "key string, t int, name string")
    found = {(r["key"], r["t"]): r["name"] for r in as_of(rows, marks, ["key"], "t", "name").collect()}
    assert found == {("k", t): None if t < 3 else "a" if t < 9 else "b" if t < 15 else "c" for t in range(20)} | {("other", 3): None}


def test_scored_set_algebra(spark):
    z = zsets(spark, [("z1", "a", 1.0), ("z1", "b", 2.0), ("z1", "c", 3.0), ("z2", "b", 1.0), ("z2", "c", 2.0), ("z2", "d", 3.0)])
    run = lambda op, keys, *more: pairs(ops.zalgebra(z, op, keys, *more), "score", "member")
    assert run("union", ["z1", "z2"]) == [(1.0, "a"), (3.0, "b"), (3.0, "d"), (5.0, "c")]
    assert run("inter", ["z1", "z2"]) == [(3.0, "b"), (5.0, "c")]
    assert run("diff", ["z1", "z2"]) == [(1.0, "a")] and run("diff", ["z2", "z1"]) == [(3.0, "d")]
    assert run("inter", ["z1", "missing"]) == [] and run("union", ["z1", "missing"]) == [(1.0, "a"), (2.0, "b"), (3.0, "c")]
    m = zsets(spark, [("z1", "m", 1.0), ("z2", "m", 2.0)])
    assert pairs(ops.zalgebra(m, "union", ["z1", "z2"], [2.0, 3.0], "max"), "member", "score") == [("m", 6.0)]
    with pytest.raises(ValueError):
        ops.zalgebra(z, "diff", ["z1"], [1.0])
    bad = zsets(spark, [("z1", "m", float("inf")), ("z2", "m", float("-inf"))])
    with pytest.raises(Exception, match="not a number"):
        ops.zalgebra(bad, "union", ["z1", "z2"]).collect()
    assert sorted(pairs(ops.stored(ops.zalgebra(z, "inter", ["z1", "z2"]), "z1", z), "key", "member")) == [("z1", "b"), ("z1", "c"), ("z2", "b"), ("z2", "c"), ("z2", "d")]


def test_score_and_member_ranges(spark):
    z = zsets(spark, [("lb", m, s) for m, s in zip("abcde", (10.0, 20.0, 30.0, 40.0, 50.0), strict=True)])
    names = lambda df: "".join(sorted(r["member"] for r in df.collect()))
    assert names(z.where(ops.in_scores("20", "40"))) == "bcd" and names(z.where(ops.in_scores("(20", "(40"))) == "c"
    assert names(ops.limited(z.where(ops.in_scores("-inf", "+inf")), ops.score_order(), 1, 2)) == "bc"
    lex = zsets(spark, [("al", m, 0.0) for m in "abcdef"])
    assert names(lex.where(ops.in_members("[b", "[d"))) == "bcd" and names(lex.where(ops.in_members("(b", "(d"))) == "c"
    assert names(lex.where(ops.in_members("-", "+"))) == "abcdef" and names(lex.where(ops.in_members("+", "-"))) == ""
    assert names(ops.zrange(z, 0, -100)) == "a" and names(ops.zrange(z, -2, -1)) == "de" and names(ops.zrange(z, 1, 2, reverse=True)) == "cd"


def test_nan_scores_come_last(spark):
    z = zsets(spark, [("k", "n", float("nan")), ("k", "i", float("inf")), ("k", "a", 1.0)])
    assert [m for _, m in sorted((r["rank"], r["member"]) for r in ops.zrank(z).collect())] == ["a", "i", "n"]


def test_zadd_conditions(spark):
    log = spark.createDataFrame([("k", 1, "m", 5.0), ("k", 2, "m", 9.0), ("k", 3, "m", 7.0)], "key string, seq int, member string, score double")
    assert [ops.zadd(log, c).first()["score"] for c in ("", "nx", "gt", "lt", "incr")] == [7.0, 5.0, 9.0, 5.0, 21.0]


def list_values(df):
    return [r["value"] for r in df.orderBy("key", "pos").collect()]


def test_lists(spark):
    empty = spark.createDataFrame([], "key string, pos long, value string")
    push = lambda rows, value, left: ops.pushed(rows, spark.createDataFrame([("l", 0, value)], "key string, seq int, value string"), left)
    rows = push(push(push(empty, "a", True), "b", True), "c", False)
    assert list_values(rows) == ["b", "a", "c"]
    assert list_values(ops.pushed(empty, spark.createDataFrame([("l", 0, "x")], "key string, seq int, value string"), only_existing=True)) == []
    assert list_values(ops.list_inserted(rows, "a", "n")) == ["b", "n", "a", "c"] and list_values(ops.list_inserted(rows, "a", "n", before=False)) == ["b", "a", "n", "c"]
    many = spark.createDataFrame([("l", k, v) for k, v in enumerate("abcabcab")], "key string, pos long, value string")
    assert "".join(list_values(ops.list_removed(many, "a", 2))) == "bcbcab" and "".join(list_values(ops.list_removed(many, "a", -1))) == "abcabcb"
    assert "".join(list_values(ops.list_removed(many, "b", 0))) == "acaca"
    at = lambda *args: sorted(r["i"] for r in ops.list_positions(many, "a", *args).collect())
    assert (at(), at(2, 1), at(-1, 2), at(1, 0), at(1, 0, 4)) == ([0], [3], [3, 6], [0, 3, 6], [0, 3])
    assert [r["value"] for r in ops.list_at(many, -1).collect()] == ["b"] and ops.list_at(many, 99).count() == 0
    assert "".join(list_values(ops.list_set(many, -1, F.lit("z")))) == "abcabcaz"
    assert "".join(list_values(ops.list_range(many, 1, -100, keep=True))) == "" and "".join(list_values(ops.list_range(many, 0, -100))) == "a"


def test_sort(spark):
    rows = spark.createDataFrame([("n", k, v) for k, v in enumerate(["3", "1", "2", "1"])], "key string, pos long, value string")
    order = lambda df: [(r["value"], r["pos"]) for r in df.orderBy("rank").collect()]
    assert order(ops.sorted_elements(rows)) == [("1", 1), ("1", 3), ("2", 2), ("3", 0)]
    assert order(ops.sorted_elements(rows, descending=True)) == [("3", 0), ("2", 2), ("1", 3), ("1", 1)]
    assert order(ops.sorted_elements(rows, offset=1, count=2)) == [("1", 3), ("2", 2)]
    with pytest.raises(Exception, match="not a number"):
        ops.sorted_elements(rows.withColumn("value", F.lit("x"))).collect()


def test_set_algebra_and_moves(spark):
    s = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "3"), ("b", "2"), ("b", "4")], "key string, member string")
    of = lambda op, *keys: "".join(sorted(r["member"] for r in ops.set_algebra(s, op, list(keys)).collect()))
    assert (of("inter", "a", "b"), of("union", "a", "b"), of("diff", "a", "b"), of("inter", "a", "x"), of("diff", "x", "a")) == ("2", "1234", "13", "", "")
    assert pairs(ops.set_moved(s, "a", "b", "2"), "key", "member") == [("a", "1"), ("a", "3"), ("b", "2"), ("b", "4")]
    assert ops.sampled(s, 2, 1, "member").groupBy("key").count().where("count <> 2").count() == 0
    assert ops.sampled(s, -5, 1, "member").groupBy("key").count().where("count <> 5").count() == 0


def test_byte_ranges_and_setrange(spark):
    df = spark.createDataFrame([(b"hello",), (b"",)], "v binary")
    got = lambda a, b: [bytes(r[0]) for r in df.select(values.byte_range(F.col("v"), a, b)).collect()]
    assert (got(1, 3), got(-3, -1), got(0, -100), got(3, 99), got(4, 2)) == ([b"ell", b""], [b"llo", b""], [b"h", b""], [b"lo", b""], [b"", b""])
    assert [bytes(r[0]) for r in df.select(keyspace.set_range(F.col("v"), 6, b"x")).collect()] == [b"hello\0x", b"\0\0\0\0\0\0x"]
    assert [bytes(r[0]) for r in df.select(keyspace.set_range(F.col("v"), 1, b"EL")).collect()] == [b"hELlo", b"\0EL"]


def test_number_text_and_globs(spark):
    df = spark.createDataFrame([(3.0,), (3.5,), (-0.25,)], "x double")
    assert [r[0] for r in df.select(values.number_text(F.col("x"))).collect()] == ["3", "3.5", "-0.25"]
    keys = spark.createDataFrame([("a.b",), ("axb",), ("a[b",), ("abc",)], "k string")
    hit = lambda p, c=False: sorted(r[0] for r in keys.where(values.glob(F.col("k"), p, c)).collect())
    assert (hit("a.b"), hit("a?b"), hit("a[b"), hit("a*c")) == (["a.b"], ["a.b", "a[b", "axb"], ["a[b"], ["abc"])
    assert (hit("a[.x]b", True), hit("a[^x]b", True), hit("a\\[b", True)) == (["a.b", "axb"], ["a.b", "a[b"], ["a[b"])


def test_slots(spark):
    df = spark.createDataFrame([("123456789",), ("foo",), ("bar",), ("user1000",), ("this{foo}",), ("{}bar",), ("{bar",)], "k string")
    found = {r["k"]: (r["c"], r["s"]) for r in df.select("k", values.crc16(F.col("k")).alias("c"), values.slot(F.col("k")).alias("s")).collect()}
    assert found["123456789"][0] == 0x31C3 and [found[k][1] for k in ("foo", "bar", "user1000", "this{foo}")] == [12182, 5061, 3443, 12182]
    assert found["{}bar"][1] == found["{}bar"][0] % 16384 and found["{bar"][1] == found["{bar"][0] % 16384


def test_longest_common_subsequence(spark):
    def brute(a, b):
        best = {0: {0: ""}}
        rows = [[""] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                rows[i][j] = rows[i - 1][j - 1] + x if x == y else max(rows[i - 1][j], rows[i][j - 1], key=len)
        return len(rows[-1][-1]) if best else 0

    rng = random.Random(2)
    texts = [("".join(rng.choice("abé") for _ in range(rng.randint(0, 12))), "".join(rng.choice("abé") for _ in range(rng.randint(0, 12)))) for _ in range(150)] + [(None, "a")]
    for r in lcs.with_lcs(spark.createDataFrame(texts, "a string, b string"), "a", "b").collect():
        assert r["lcs_len"] == len(r["lcs"]) == brute(r["a"] or "", r["b"] or "")
        for whole in (r["a"] or "", r["b"] or ""):
            left = iter(whole)
            assert all(c in left for c in r["lcs"])
    assert lcs.ranges("ohmytext", "mynewtext") == [(2, 3, 0, 1), (4, 7, 5, 8)]


def test_expiry_rules(spark):
    state = spark.createDataFrame([("a", 2000), ("b", None), ("gone", 50)], "key string, expires_at long")
    ttls = spark.createDataFrame([("a", 500), ("b", 500)], "key string, ttl_ms long")
    after = lambda c, t=ttls: {r["key"]: r["expires_at"] for r in keyspace.expire(state, t, 1000, c).collect()}
    assert after("") == {"a": 1500, "b": 1500} and after("nx") == {"a": 2000, "b": 1500} and after("xx") == {"a": 1500, "b": None}
    assert after("gt") == {"a": 2000, "b": None} and after("lt") == {"a": 1500, "b": None}
    assert after("", ttls.withColumn("ttl_ms", F.lit(-1).cast("long"))) == {"a": 2000, "b": None}
    wanted = spark.createDataFrame([("a",), ("b",), ("gone",)], "key string")
    assert {r["key"]: (r["pttl"], r["ttl"]) for r in keyspace.remaining(state, wanted, 1000).collect()} == {"a": (1000, 1), "b": (-1, -1), "gone": (-2, -2)}


def test_eviction_takes_least_recent_and_larger_first(spark):
    state = spark.createDataFrame([("cold1", 10, 1), ("cold2", 30, 1), ("hot", 10, 9)], "key string, size long, last_access long")
    assert sorted(r["key"] for r in keyspace.victims(state, 31, "lru").collect()) == ["cold1", "cold2"]
    assert sorted(r["key"] for r in keyspace.victims(state, 30, "lru").collect()) == ["cold2"]
    assert keyspace.victims(state.limit(0), 5, "lru").count() == 0
