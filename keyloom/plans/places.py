"""Points on the earth, derived from the keys of suppliers and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import geo
from keyloom.plans.registry import register, table

LON, LAT = "(-180 + ({k} * 7919 % 3600) / 10.0)", "(-85 + ({k} * 104729 % 1700) / 10.0)"
KM = "2 * 6372.797560856 * asin(sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({y} - {x}) / 2), 2)))"


def points(spark, sf_dir, name="supplier", key="s_suppkey"):
    k = F.col(key).cast("long")
    return table(spark, sf_dir, name).select(F.lit(name).alias("key"), k.cast("string").alias("member"), (-180 + (k * 7919 % 3600) / 10.0).alias("lon"), (-85 + (k * 104729 % 1700) / 10.0).alias("lat"))


def _p(name, table_name, key):
    lon, lat = LON.format(k=f"{key}::BIGINT"), LAT.format(k=f"{key}::BIGINT")
    return f"{name} AS (SELECT {key}::VARCHAR AS member, {lon}::DOUBLE AS lon, {lat}::DOUBLE AS lat FROM {table_name})"


P = f"WITH {_p('p', 'supplier', 's_suppkey')} "
FROM_CENTRE = KM.format(a="20.0", b="lat", x="10.0", y="lon")


@register("geodist", P + f"SELECT x.member AS a, y.member AS b, round(round({KM.format(a='x.lat', b='y.lat', x='x.lon', y='y.lon')}, 4), 3) AS km FROM p x JOIN p y ON y.member::BIGINT = x.member::BIGINT + 1")
def geodist(spark, sf_dir):
    own = points(spark, sf_dir)
    pairs = own.select("key", F.col("member").alias("a"), (F.col("member").cast("long") + 1).cast("string").alias("b"))
    return geo.geodist(own, pairs, "km").where("dist IS NOT NULL").select("a", "b", F.round(F.col("dist").cast("double"), 3).alias("km"))


@register("geosearch_radius", P + f"SELECT member, round({FROM_CENTRE}, 3) AS dist FROM p WHERE {FROM_CENTRE} <= 4000")
def geosearch_radius(spark, sf_dir):
    return geo.around(points(spark, sf_dir), 10.0, 20.0, 4000, "km").select("member", F.round("dist", 3).alias("dist"))


@register("geosearch_count", P + f"SELECT member, round({FROM_CENTRE}, 3) AS dist FROM p ORDER BY {FROM_CENTRE}, member LIMIT 7")
def geosearch_count(spark, sf_dir):
    return geo.around(points(spark, sf_dir), 10.0, 20.0, 30_000, "km").orderBy("dist", "member").limit(7).select("member", F.round("dist", 3).alias("dist"))


@register("geosearch_box", P + f"SELECT member, round({FROM_CENTRE}, 3) AS dist FROM p WHERE abs(lat - 20.0) <= 3000 * 1000 / 111320.0 AND abs(lon - 10.0) <= 4000 * 1000 / (111320.0 * cos(radians(20.0)))")
def geosearch_box(spark, sf_dir):
    return geo.in_box(points(spark, sf_dir), 10.0, 20.0, 8000, 6000, "km").select("member", F.round("dist", 3).alias("dist"))


@register("geo_storedist", P + f"SELECT 'near' AS key, member, round({FROM_CENTRE}, 3) AS score FROM p WHERE {FROM_CENTRE} <= 6000")
def geo_storedist(spark, sf_dir):
    near = geo.store_distances(geo.around(points(spark, sf_dir), 10.0, 20.0, 6000, "km"), "near")
    return near.withColumn("score", F.round("score", 3))


BITS52 = " + ".join(f"((x >> {k}) & 1) * {1 << (2 * k + 1)} + ((y >> {k}) & 1) * {1 << (2 * k)}" for k in range(26))
DIGITS = " || ".join(f"substr('0123456789bcdefghjkmnpqrstuvwxyz', (((h << 3) >> {5 * k}) & 31)::INT + 1, 1)" for k in range(10, -1, -1))


@register("geohash", P + f", q AS (SELECT member, trunc((lon + 180.0) / 360.0 * 67108864)::BIGINT AS x, trunc((lat + 90.0) / 180.0 * 67108864)::BIGINT AS y FROM p), b AS (SELECT member, ({BITS52})::BIGINT AS h FROM q) SELECT member, {DIGITS} AS hash FROM b")
def geohash(spark, sf_dir):
    return geo.geohash(points(spark, sf_dir)).select("member", "hash")


@register("geo_radius_join", f"WITH {_p('s', 'supplier', 's_suppkey')}, {_p('c', 'customer', 'c_custkey')}, d AS (SELECT s.member AS centre, c.member, {KM.format(a='s.lat', b='c.lat', x='s.lon', y='c.lon')} AS dist FROM s, c) SELECT centre, member, round(dist, 3) AS dist FROM d WHERE dist <= 500")
def geo_radius_join(spark, sf_dir):
    centres = points(spark, sf_dir).select(F.col("member").alias("centre"), "lon", "lat")
    return geo.radius_join(points(spark, sf_dir, "customer", "c_custkey"), centres, 500, "km", 3)


@register("geopos", P + "SELECT w.pos::INT AS pos, w.member, p.lon, p.lat FROM (VALUES (0, '3'), (1, 'missing'), (2, '1')) w(pos, member) LEFT JOIN p USING (member)")
def geopos(spark, sf_dir):
    from keyloom.operators.keyspace import ordered_get

    return ordered_get(points(spark, sf_dir).select("member", "lon", "lat"), ["3", "missing", "1"], "member").select("pos", "member", "lon", "lat")


@register("geoadd_xx", P + "SELECT member, CASE WHEN member::BIGINT < 10 THEN 1.5 ELSE lon END AS lon, CASE WHEN member::BIGINT < 10 THEN 2.5 ELSE lat END AS lat FROM p")
def geoadd_xx(spark, sf_dir):
    own = points(spark, sf_dir)
    new = own.where("CAST(member AS BIGINT) < 10").withColumns({"lon": F.lit(1.5), "lat": F.lit(2.5)})
    absent = new.withColumn("member", F.concat(F.lit("new"), "member"))
    return geo.geoadd(own, new.unionByName(absent), "xx").select("member", "lon", "lat")
