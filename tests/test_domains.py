"""Bitmaps, sketches, places, search, vectors, streams, routing, locks, logs and transactions on small tables."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.functions.scripts import Functions
from keyloom.functions.values import haversine
from keyloom.operators import bitmaps, geo, keyspace, locks, pubsub, search, sketches, streams, vectors
from keyloom.operators.transactions import Transaction
from keyloom.sources import snapshot


def column(df, name):
    return sorted(r[name] for r in df.collect())


def test_bitmaps(spark):
    bits = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1), ("b", 2), ("p", 10)], "key string, off long")
    op = lambda name, *keys: column(bitmaps.bitop(bits, name, list(keys)), "off")
    assert (op("and", "a", "b"), op("or", "a", "b"), op("xor", "a", "b"), op("not", "a"), op("and", "a", "x")) == ([1], [0, 1, 2], [0, 2], [2, 3, 4, 5, 6, 7], [])
    assert {r["key"]: r["pos"] for r in bitmaps.bitpos_set(bits).collect()} == {"a": 0, "b": 1, "p": 10}
    assert {r["key"]: r["pos"] for r in bitmaps.bitpos_clear(bits).collect()} == {"a": 2, "b": 0, "p": 0}
    value = bitmaps.to_binary(bits, 16)
    assert {r["key"]: bytes(r["value"]) for r in value.collect()} == {"a": b"\xc0\0", "b": b"\x60\0", "p": b"\0\x20"}
    assert value.where("key = 'a'").select(bitmaps.bitfield_get(F.col("value"), 4, 0, signed=True)).first()[0] == -4
    add = lambda start, by, *how: spark.range(1).select(bitmaps.bitfield_add(F.lit(start), F.lit(by), *how)).first()[0]
    assert (add(200, 1, 8), add(15, 1, 4, False, "fail"), add(15, 1, 4, False, "sat"), add(15, 1, 4), add(127, 1, 8, True), add(-128, -1, 8, True, "sat")) == (201, None, 15, 0, -128, -128)


def test_cardinality_sketch(spark):
    rows = [("small", i) for i in range(3)] + [("large", i) for i in range(20_000)]
    regs = sketches.registers(spark.createDataFrame(rows, "key string, element int"))
    found = {r["key"]: r["estimate"] for r in sketches.estimate(regs).collect()}
    assert found["small"] == 3 and abs(found["large"] - 20_000) < 20_000 * 0.03
    assert abs(sketches.estimate(sketches.merged(regs, "all")).first()["estimate"] - 20_000) < 600


CITIES = [("c", "Seoul", 126.9780, 37.5665), ("c", "Busan", 129.0756, 35.1796), ("c", "Incheon", 126.7052, 37.4563), ("c", "Daejeon", 127.3845, 36.3504)]


def test_places(spark):
    g = spark.createDataFrame(CITIES, "key string, member string, lon double, lat double")
    near = lambda km: column(geo.around(g, 126.9780, 37.5665, km, "km"), "member")
    assert (near(50), len(near(200)), len(near(500))) == (["Incheon", "Seoul"], 3, 4)
    pairs = spark.createDataFrame([("c", "Seoul", "Busan"), ("c", "Seoul", "Incheon"), ("c", "Seoul", "x")], "key string, a string, b string")
    found = {r["b"]: r["dist"] for r in geo.geodist(g, pairs, "km").collect()}
    assert abs(float(found["Busan"]) - 325) < 10 and abs(float(found["Incheon"]) - 27) < 5 and found["x"] is None and len(found["Busan"].split(".")[1]) == 4
    bad = spark.createDataFrame([("c", "pole", 0.0, 89.0)], "key string, member string, lon double, lat double")
    assert geo.geoadd(g, bad).count() == 4


def test_radius_join_against_all_pairs(spark):
    rng = random.Random(4)
    points = [(str(i), rng.choice([rng.uniform(-180, 180), 179.99, -179.99]), rng.choice([rng.uniform(-90, 90), 89.5, -89.5, 0.0])) for i in range(250)]
    a = spark.createDataFrame(points, "member string, lon double, lat double")
    b = a.withColumnRenamed("member", "centre")
    every = a.alias("a").crossJoin(b.alias("b")).select("centre", "member", haversine(F.col("b.lon"), F.col("b.lat"), F.col("a.lon"), F.col("a.lat")).alias("d"))
    for km in (50, 1200, 9000):
        want = sorted(map(tuple, every.where(F.col("d") <= km * 1000).select("centre", "member").collect()))
        found = sorted(map(tuple, geo.radius_join(a, b, km, "km").select("centre", "member").collect()))
        assert found == want, km


def test_radius_join_by_places(spark, monkeypatch):
    """Hot places, repeated and incomplete rows: the pairs of all rows, from one distance for two places."""
    monkeypatch.setattr(geo, "LIST", 7)
    rng = random.Random(8)
    places = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(12)] + [(10.0, 20.0)] * 12
    rows = lambda n: [(str(i), *rng.choice(places)) for i in range(n)] + [("3", 10.0, 20.0)] * 9 + [(None, 10.0, 20.0), ("no", None, 1.0), ("no", 1.0, None), ("no", float("nan"), 1.0)]
    a = spark.createDataFrame(rows(200), "member string, lon double, lat double")
    b = spark.createDataFrame(rows(60), "centre string, lon double, lat double")
    lists = geo.at_places(a.where("lon IS NOT NULL AND lat IS NOT NULL"), ["lon", "lat"], "member").collect()
    assert max(len(r["_all_member"]) for r in lists) <= 7 and sum(len(r["_all_member"]) for r in lists) == 211
    every = a.alias("a").crossJoin(b.alias("b")).select("centre", "member", haversine(F.col("b.lon"), F.col("b.lat"), F.col("a.lon"), F.col("a.lat")).alias("d"))
    for km in (50, 3000):
        want = Counter((r["centre"], r["member"], round(r["d"] / 1000, 3)) for r in every.where(F.col("d") <= km * 1000).collect())
        joined = geo.radius_join(a, b, km, "km", 3)
        assert Counter(map(tuple, joined.collect())) == want, km
    plan = joined._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in plan and plan.index("_all_member") < plan.index("SortMergeJoin")


def test_text_search(spark):
    docs = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog"), (2, "A lazy cat sleeps all day"), (3, "The fox is very quick and agile"), (4, None), (5, "!!")], "doc_id int, text string")
    index = search.text_index(docs, {"text": 1.0})
    hits = lambda q: column(search.bm25(index, search.query_terms(spark.createDataFrame([(1, q)], "query int, text string"))), "doc_id")
    assert (hits("lazy"), hits("FOX"), hits("lazy fox"), hits("nothing")) == ([1, 2], [1, 3], [1, 2, 3], [])
    assert column(search.by_terms(index, "text", ["fox", "quick"], "and"), "doc_id") == [1, 3]
    assert column(search.by_terms(index, "text", ["fox"], "not"), "doc_id") == [2, 4, 5]
    score = {r["doc_id"]: r["score"] for r in search.bm25(index, spark.createDataFrame([(1, "fox")], "query int, term string")).collect()}
    idf = math.log(1 + (3 - 2 + 0.5) / 2.5)
    assert abs(score[1] - idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 9 / (22 / 3)))) < 1e-9


def test_ranking_and_weights(spark):
    rows = [(0, "x", "apple apple apple banana"), (1, "x", "apple orange"), *((k, "x", "banana orange kiwi") for k in range(2, 10)), (10, "quantum", "thing"), (11, "thing", "quantum")]
    docs = spark.createDataFrame(rows, "doc_id int, title string, body string")
    index = search.text_index(docs, {"title": 5.0, "body": 1.0})
    best = lambda f, term: [r["doc_id"] for r in search.top(f(index, spark.createDataFrame([(1, term)], "query int, term string")), 2).orderBy("rank").collect()]
    assert best(search.bm25, "apple") == [0, 1] and best(search.tf_idf, "apple") == [0, 1] and best(search.bm25, "quantum") == [10, 11]


def test_pages_of_many_queries_are_those_of_all_scores(spark, monkeypatch):
    rng = np.random.default_rng(8)
    texts = lambda k: " ".join(f"w{x}" for x in rng.zipf(1.6, k) % 60)
    docs = spark.createDataFrame([(i, texts(int(rng.integers(0, 4))), texts(int(rng.integers(0, 30)))) for i in range(200)] + [(None, "w1", "w1"), (900, None, "")], "doc_id int, title string, body string").repartition(3)
    index = search.text_index(docs, {"title": 3.0, "body": 1.0})
    asked = spark.createDataFrame([(q, f"w{t}") for q in range(12) for t in rng.integers(0, 70, 3).tolist()], "query int, term string")
    only = asked.withColumn("field", F.lit("body"))
    monkeypatch.setattr(search, "BLOCK_TERMS", 7)
    for queries in (asked, only):
        for scoring, scores in (("bm25", search.bm25), ("tf_idf", search.tf_idf)):
            full = scores(index, queries).where("doc_id IS NOT NULL").withColumn("score", F.round("score", 6))
            want = sorted((r["query"], r["rank"], r["doc_id"], r["score"]) for r in search.top(full, 4, 1).collect())
            found = sorted((r["query"], r["rank"], r["doc_id"], r["score"]) for r in search.best_matches(index, queries, 4, 1, scoring).collect())
            assert [x[:3] for x in found] == [x[:3] for x in want] and all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(found, want, strict=True))
    assert search.best_matches(index, asked.limit(0), 4).count() == 0 and search.best_matches(search.text_index(docs.limit(0), {"body": 1.0}), asked, 4).count() == 0


def test_wide_bit_fields(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    ones, low = F.lit(b"\xff" * 8), F.lit(bytes([128, 0, 0, 0, 0, 0, 0, 0]))
    assert [one(bitmaps.bitfield_get(ones, w, 0, True)) for w in (1, 8, 63, 64)] == [-1] * 4 and one(bitmaps.bitfield_get(ones, 63, 1)) == 2**63 - 1
    assert one(bitmaps.bitfield_get(low, 64, 0, True)) == -(2**63)
    add = lambda start, by, *how: one(bitmaps.bitfield_add(F.lit(start), F.lit(by), *how))
    assert [add(2**63 - 1, 1, 64, True, how) for how in ("wrap", "sat", "fail")] == [-(2**63), 2**63 - 1, None]
    assert add(2**62 - 1, 1, 63, True) == -(2**62) and add(2**63 - 1, 1, 63, False) == 0
    bits = spark.createDataFrame([("a", 0), ("a", 70), ("b", 3)], "key string, off long")
    put = bitmaps.bitfield_set(bits, spark.createDataFrame([("a", -2), ("b", 9)], "key string, value long"), 4, 0, True, "fail")
    assert sorted((r["key"], r["off"]) for r in put.collect()) == [("a", 0), ("a", 1), ("a", 2), ("a", 70), ("b", 3)]
    assert bitmaps.bitop(bits, "not", ["b"]).count() == 7 and bitmaps.bitop(bits, "not", ["missing"]).count() == 0


def test_cells_and_probes_follow_the_rows(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(900, 8)) + rng.integers(0, 9, (900, 1)) * 3
    base = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    cells = vectors.cells_for(base.count())
    centroids = vectors.train_cells(base, cells, "l2")
    probes = vectors.probes_for(base, centroids, 5, 0.95, "l2")
    asked = base.where("vec_id % 30 = 0")
    got = vectors.recall(vectors.ann(vectors.assign_cells(base, centroids, metric="l2"), vectors.assign_cells(asked, centroids, probes, "l2"), 5, "l2"), vectors.knn(base, asked, 5, "l2")).first()
    assert cells == 30 and probes < cells / 2 and got["recall"] >= 0.9


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_neighbours_against_brute_force(spark, metric, monkeypatch):
    rng = np.random.default_rng(3)
    v = np.vstack([rng.normal(size=(120, 8)), np.zeros((1, 8))])
    base = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(500, [1.0]), (501, None)], "vec_id long, embedding array<double>").repartition(5)
    monkeypatch.setattr(vectors.blocks, "__defaults__", (7,))
    s = vectors.scores(v[:20], v, metric)
    found = vectors.knn(base, base.where("vec_id < 20"), 5, metric).collect()
    for q in range(20):
        own = sorted((r["rank"], round(r["score"], 6)) for r in found if r["query"] == q)
        want = sorted([*s[q].tolist(), 0.0], reverse=True)[:5]
        assert [x for _, x in own] == [round(x, 6) for x in want]


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_copies_tie_by_id_in_every_search(spark, metric, monkeypatch):
    """Copies of a vector score the same wherever they stand; cells are scanned by block, not joined pair by pair."""
    monkeypatch.setattr(vectors, "ROWS", 37)
    rng = np.random.default_rng(11)
    v = rng.normal(size=(700, 24))
    v[rng.permutation(700)[:300]] = v[3]
    v[rng.permutation(700)[:40]] = 0.0
    base = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [1.0, 2.0])], "vec_id long, embedding array<float>").repartition(5)
    asked = base.where("vec_id % 20 = 3")
    found = lambda df: sorted((r["query"], r["rank"], r["neighbour"]) for r in df.collect())
    exact = found(vectors.knn(base, asked.where("size(embedding) = 24"), 12, metric))
    w = np.vstack([v.astype("f4").astype(float), np.full((1, 24), np.nan)])
    want = []
    for q in range(3, 700, 20):
        s = vectors.pair_scores(np.broadcast_to(w[q], w.shape), w, metric)
        s[700] = 0.0
        order = np.lexsort(([*range(700), 901], -s))[:12]
        want += [(q, rank, [*range(700), 901][i]) for rank, i in enumerate(order)]
    assert exact == want
    centroids = vectors.train_cells(base.where("size(embedding) = 24"), 9, metric)
    index = vectors.cell_index(base, centroids, metric)
    assert index.count() == 701
    near = vectors.ann(index, vectors.cells_near(asked, centroids, 9, metric), 12, metric)
    assert found(near) == want and "Join" not in near._jdf.queryExecution().sparkPlan().toString()
    assert found(vectors.ann(index, vectors.assign_cells(asked, centroids, 9, metric), 12, metric)) == want


def test_inverted_file_recall(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(3000, 16)) + rng.integers(0, 4, (3000, 1)) * 2
    base = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    asked = base.where("vec_id % 100 = 0")
    centroids = vectors.train_cells(base, 16, sample=800)
    index = vectors.assign_cells(base, centroids)
    assert index.count() == 3000
    got = vectors.recall(vectors.ann(index, vectors.assign_cells(asked, centroids, 8), 10), vectors.knn(base, asked, 10)).first()
    assert got["wanted"] == 300 and got["recall"] >= 0.9


def test_stream_ids_reads_and_trims(spark):
    log = spark.createDataFrame([("k", 5, 0), ("k", 5, 1), ("k", 3, 2), ("k", 9, 3)], "key string, clock long, arrival long")
    x = streams.with_ids(log).select("key", "ms", F.col("seq").cast("long").alias("seq"))
    ids = lambda df: sorted((r["ms"], r["seq"]) for r in df.collect())
    assert ids(x) == [(5, 0), (5, 1), (5, 2), (9, 0)]
    assert ids(streams.id_range(x, (5, 1), (5, 2))) == [(5, 1), (5, 2)] and ids(streams.id_range(x, (0, 0), (99, 0), 1, reverse=True)) == [(9, 0)]
    assert ids(streams.trimmed(x, 1)) == [(9, 0)] and ids(streams.trimmed(x, 1, limit=2)) == [(5, 2), (9, 0)] and ids(streams.trimmed_before(x, 5, 2)) == [(5, 2), (9, 0)]
    assert ids(streams.read_after(x, spark.createDataFrame([("k", 5, 1)], "key string, last_ms long, last_seq long"), 1)) == [(5, 2)]


def test_consumer_groups(spark):
    x = spark.createDataFrame([("jobs", 1, s) for s in range(5)], "key string, ms long, seq long")
    reads = spark.createDataFrame([("jobs", 1, "a", 2, 100), ("jobs", 2, "b", 0, 150), ("jobs", 3, "b", 2, 200)], "key string, at long, consumer string, count int, delivery_ms long")
    got = streams.deliveries(x, reads)
    assert sorted((r["seq"], r["consumer"]) for r in got.collect()) == [(0, "a"), (1, "a"), (2, "b"), (3, "b")]
    left = keyspace.removed(got, spark.createDataFrame([("jobs", 1, 0)], "key string, ms long, seq long"), ["key", "ms", "seq"])
    summary = streams.pending_summary(left).first()
    assert (summary["total"], summary["first"]["seq"], summary["last"]["seq"], summary["consumers"]) == (3, 1, 3, {"a": 1, "b": 2})
    ids = spark.createDataFrame([("jobs", 1, s) for s in range(3)], "key string, ms long, seq long")
    assert streams.claimed(left, ids, "c", 1000, 999_999).where("consumer = 'c'").count() == 0
    assert column(streams.claimed(left, ids, "c", 1000, 0).where("consumer = 'c' AND delivery_count = 2"), "seq") == [1, 2]
    auto = streams.auto_claimed(left, x.where("seq <> 2"), "c", 1000, 0, (0, 0), 2).collect()
    assert sorted((r["seq"], r["deleted"], r["next_seq"]) for r in auto) == [(1, False, 3), (2, True, 3)]
    groups = spark.createDataFrame([("jobs", "g", 1, 1), ("jobs", "new", 0, 0), ("none", "g", 0, 0)], "key string, group string, last_ms long, last_seq long")
    assert {(r["key"], r["group"]): r["lag"] for r in streams.group_lag(x, groups).collect()} == {("jobs", "g"): 3, ("jobs", "new"): 5, ("none", "g"): 0}


def test_routing(spark):
    m = spark.createDataFrame([(1, "news.art"), (2, "news.tech"), (3, "other")], "id int, channel string")
    subs = spark.createDataFrame([("a", "news.art"), ("a", "news.art")], "client string, channel string")
    patterns = spark.createDataFrame([("a", "news.*"), ("b", "news.[at]??"), ("c", "*"), ("d", "other\\*")], "client string, pattern string")
    got = sorted((r["id"], r["client"], r["pattern"] or "") for r in pubsub.routed(m, subs, patterns).collect())
    assert got == [(1, "a", ""), (1, "a", "news.*"), (1, "b", "news.[at]??"), (1, "c", "*"), (2, "a", "news.*"), (2, "c", "*"), (3, "c", "*")]
    assert {r["id"]: r["recipients"] for r in pubsub.recipients(m, subs, patterns, "id").collect()} == {1: 4, 2: 2, 3: 1}
    assert pubsub.routed(m, subs, patterns.limit(0)).count() == 1


def test_deadlocks(spark):
    edges = lambda *pairs: spark.createDataFrame(list(pairs), "waiter string, holder string")
    of = lambda df: {r["client"]: r["cycle"] for r in locks.deadlocks(df).collect()}
    holds = spark.createDataFrame([("a", "c1"), ("b", "c2")], "resource string, client string")
    waits = spark.createDataFrame([("b", "c1"), ("a", "c2")], "resource string, client string")
    assert of(locks.wait_edges(holds, waits)) == {"c1": "c1", "c2": "c1"}
    assert of(locks.wait_edges(holds.where("client = 'c1'"), waits)) == {}
    assert of(edges(("t", "x"), ("x", "y"), ("y", "z"), ("z", "x"), ("z", "p"), ("p", "q"), ("q", "p"), ("q", "end"))) == {"x": "x", "y": "x", "z": "x", "p": "p", "q": "p"}
    held = spark.createDataFrame([("r", "c1", 5), ("s", "c2", 9), ("u", "c2", 1)], "resource string, client string, ts long")
    cycles = spark.createDataFrame([("c1", "c1"), ("c2", "c1")], "client string, cycle string")
    assert [locks.victims(cycles, held, p).first()["victim"] for p in ("youngest", "oldest", "fewest")] == ["c2", "c1", "c1"]


def test_fair_queue_and_quorum(spark):
    q = spark.createDataFrame([("r", "late", 1, 9), ("r", "first", 1, 2), ("r", "low", 5, 0)], "resource string, client string, priority int, enq_ts long")
    assert [r["client"] for r in locks.fair_queue(q).orderBy("place").collect()] == ["first", "late", "low"] and locks.fair_queue(q, 2).count() == 2
    votes = spark.createDataFrame([("r", "t", n, 10, n < 3) for n in range(5)] + [("s", "t", n, 10, n < 2) for n in range(5)] + [("u", "t", n, 995, True) for n in range(5)], "resource string, token string, node int, elapsed int, acquired boolean")
    assert column(locks.quorum(votes, 5, 1000), "resource") == ["r"]


def test_log_replay_compaction_and_snapshot(spark, tmp_path):
    ops = [(1, "SET", "a", "1"), (2, "SETNX", "a", "2"), (3, "DEL", "a", None), (4, "SETNX", "a", "3"), (5, "SETNX", "a", "4"), (6, "SET", "b", "5"), (7, "SET", "c", "6"), (8, "DEL", "c", None)]
    rows = [(s, None, 0, op, k, None, None, v) for s, op, k, v in ops] + [(9, None, 1, "SET", "x", None, None, "y"), (10, None, 1, "FLUSHDB", None, None, None, None), (11, None, 1, "SET", "z", None, None, "w")]
    snapshot.append_log(spark.createDataFrame(rows, snapshot.LOG), f"{tmp_path}/log")
    log = snapshot.read_log(spark, f"{tmp_path}/log")
    state = lambda df: sorted((r["db"], r["key"], r["value"]) for r in snapshot.replay_strings(df).collect())
    assert state(log) == [(0, "a", "3"), (0, "b", "5"), (1, "z", "w")]
    small = snapshot.compacted(log)
    assert small.count() == 3 and state(small) == state(log)
    snapshot.save({"strings": snapshot.replay_strings(log)}, f"{tmp_path}/snap")
    assert snapshot.load(spark, f"{tmp_path}/snap", ["strings"])["strings"].where("db = 1").count() == 1


def test_dump_and_restore(spark):
    rows = spark.createDataFrame([("a", "x\n\"é", 5), ("b", None, None)], "key string, value string, expires_at long")
    dumps = snapshot.dumped(rows)
    assert sorted(map(tuple, snapshot.restored(dumps, "key string, value string, expires_at long").collect())) == sorted(map(tuple, rows.collect()))
    assert snapshot.restored(dumps.withColumn("dump", F.lit("{broken")), "key string").count() == 0


def test_documents_of_hashes(spark):
    h = spark.createDataFrame([("doc:1", "t", "Hello"), ("doc:1", "n", "4.5"), ("doc:1", "g", " a,,b "), ("doc:1", "v", "1, -2.5,3"), ("doc:2", "n", "x"), ("doc:2", "v", "1 x"), ("other", "t", "no")], "key string, field string, value string")
    found = {r["doc_id"]: r for r in search.from_hashes(h, ["doc:"], {"t": "text", "n": "numeric", "g": "tag", "v": "vector"}).collect()}
    assert set(found) == {"doc:1", "doc:2"}
    assert tuple(found["doc:1"])[1:] == ("Hello", 4.5, ["a", "b"], [1.0, -2.5, 3.0]) and tuple(found["doc:2"])[1:] == (None, None, None, None)


def test_transactions(spark):
    tables = {"strings": spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")}
    put = lambda k, v: lambda t: {"strings": keyspace.upsert(t["strings"], spark.createDataFrame([(k, v)], "key string, value string"), ["key"])}
    t = Transaction()
    t.watch(tables, ["a"])
    done = t.add(put("a", "3")).add(put("c", "4")).execute(tables)
    assert sorted(map(tuple, done["strings"].collect())) == [("a", "3"), ("b", "2"), ("c", "4")]
    t.watch(tables, ["a"])
    assert t.add(put("b", "9")).execute(done) is None
    t.watch(tables, ["b"])
    assert t.add(put("b", "9")).execute(done) is not None


def upper(rows, by="x"):
    return rows.withColumn("value", F.concat(F.upper("value"), F.lit(by)))


def test_named_functions(spark):
    f = Functions(spark)
    shas = f.load("lib", {"upper": upper}, read_only=True)
    df = spark.createDataFrame([("a",)], "value string")
    assert f.call("upper", df, by="!").first()[0] == "A!" and f.call(shas["upper"], df, read_only=True).first()[0] == "Ax"
    with pytest.raises(ValueError):
        f.load("other", {"upper": upper})
    f.register_sql("twice", "x INT", "INT", "x * 2")
    assert spark.sql("SELECT twice(4)").first()[0] == 8
    assert f.names() == [("lib", "upper")]
    f.delete("lib")
    with pytest.raises(KeyError):
        f.call("upper", df)


def test_sampled_expiry_only_takes_what_has_expired(spark):
    state = spark.createDataFrame([(f"k{i}", None if i % 3 == 0 else i) for i in range(300)], "key string, expires_at long")
    left = keyspace.swept(state, 150, 4)
    assert 150 < left.count() < 300 and left.where("expires_at IS NULL OR expires_at > 150").count() == state.where("expires_at IS NULL OR expires_at > 150").count()
    assert keyspace.swept(state, 150, 1).where("expires_at <= 150").count() == 0
    assert keyspace.random_key(state, 3).count() == 1


def test_patterns_without_literal_ends(spark):
    patterns = spark.createDataFrame([("a", "*"), ("b", "*.x"), ("c", "[ab]*[.]?"), ("d", "?q*"), ("e", "*[z")], "client string, pattern string")
    channels = spark.createDataFrame([("a.x",), ("b.y",), ("cq.x",), ("",), (None,)], "channel string")
    found = {(r["channel"], r["client"]) for r in pubsub.matches(channels, patterns).collect()}
    assert {x for x in found if x[1] != "e"} == {("a.x", "a"), ("b.y", "a"), ("cq.x", "a"), ("", "a"), ("a.x", "b"), ("cq.x", "b"), ("a.x", "c"), ("b.y", "c"), ("cq.x", "d")}
