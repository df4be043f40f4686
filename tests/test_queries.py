"""The registry is whole, and registered queries give what their SQL gives on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Some of each family; the whole set is compared at a larger scale outside the tests.
CHOSEN = (
    "zadd_gt", "zrank", "zrange_from_end", "zunion_sum_w", "zdiff", "zpopmin_remainder", "sinter", "smove", "hgetall_wide", "hsetnx", "lrange", "lrem_tail", "linsert", "sort_alpha_desc",
    "append_places", "getset_lag", "ttl_remaining", "expire_cond_lt", "evict_lru", "replay_log", "keyslot", "bitop_xor", "bitfield_get", "pfcount", "geohash", "geo_radius_join",
    "ft_search_multifield", "ft_compound_not", "ft_index_hashes", "knn_l2", "xreadgroup", "xautoclaim", "xinfo_lag", "pubsub_route", "deadlock_victim", "redlock_quorum",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else repr(value)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_against_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, FOLDER)
    found = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in df.collect()) == want


def test_registry_and_entry(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)
    assert __spark_entry__.entry(spark).columns == ["key", "member", "score", "rank"]
