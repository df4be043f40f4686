"""Streaming forms give what the batch forms give."""

from pyspark.sql import functions as F

from keyloom.sources import snapshot
from keyloom.streaming import groups, queries


def run(df, name, mode, tmp_path):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return df.sparkSession.table(name)


def test_latest_values_of_a_log_stream(spark, tmp_path):
    rows = [(i, None, 0, "SET", f"k{i % 3}", None, None, str(i)) for i in range(20)]
    for part in (rows[:12], rows[12:]):
        snapshot.append_log(spark.createDataFrame(part, snapshot.LOG).coalesce(1), f"{tmp_path}/log")
    found = run(queries.latest_values(snapshot.stream_log(spark, f"{tmp_path}/log")), "latest", "complete", tmp_path)
    want = snapshot.replay_strings(snapshot.read_log(spark, f"{tmp_path}/log"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_windows_sessions_and_sink(spark, tmp_path):
    events = spark.createDataFrame([(f"2024-01-01 00:{m:02d}:00", k) for m, k in ((0, "a"), (1, "a"), (9, "b"), (31, "a"), (59, "b"))], "ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    counts = run(queries.windowed_counts(stream, "ts", ["kind"], "30 minutes"), "windows", "append", tmp_path)
    assert sorted((r["kind"], r["start"].minute, r["n"]) for r in counts.collect()) == [("a", 0, 2), ("b", 0, 1)]
    ended = run(queries.sessions(stream, "ts", ["kind"], "5 minutes"), "sessions", "append", tmp_path)
    assert sorted((r["kind"], r["n"]) for r in ended.collect()) == [("a", 1), ("a", 2), ("b", 1)]
    queries.append_to(stream, f"{tmp_path}/out", f"{tmp_path}/out-offsets").awaitTermination(120)
    assert spark.read.json(f"{tmp_path}/out").count() == 5


def test_groups_deliver_in_order_and_wait(spark, tmp_path):
    fields = "key string, at long, kind string, consumer string, n int, ms long, seq long, until long"
    first = [("q", 1, "add", None, None, 1, 0, None), ("q", 2, "add", None, None, 1, 1, None), ("q", 3, "read", "a", 1, None, None, 99), ("q", 4, "ack", None, None, 1, 0, None), ("r", 5, "read", "z", 1, None, None, 99), ("s", 1, "read", "y", 1, None, None, 2)]
    second = [("q", 6, "read", "b", 5, None, None, 99), ("r", 7, "add", None, None, 7, 0, None), ("s", 8, "add", None, None, 8, 0, None)]
    for k, part in enumerate((first, second)):
        spark.createDataFrame(part, fields).coalesce(1).write.mode("append").parquet(f"{tmp_path}/m{k}")
    for k in (0, 1):
        spark.read.parquet(f"{tmp_path}/m{k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        found = run(groups.deliver(spark.readStream.schema(fields).parquet(f"{tmp_path}/in")), f"delivered{k}", "append", f"{tmp_path}/one")
    # the second run starts from its own offsets and replays both parts
    assert sorted((r["key"], r["consumer"], r["ms"], r["seq"]) for r in found.collect()) == [("q", "a", 1, 0), ("q", "b", 1, 1), ("r", "z", 7, 0)]
