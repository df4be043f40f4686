"""Points on the earth: geos(key, member, lon, lat). Searches around points are joins on cells, then exact distances."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.values import EARTH_M, UNITS, geohash_bits, geohash_text, haversine, in_degree_box
from keyloom.operators.keyspace import upsert

#: The range of latitudes and longitudes.
MAX_LAT, MAX_LON = 85.05112878, 180.0
#: Names in one list of those at a place.
LIST = 4096


def geoadd(geos: DataFrame, new: DataFrame, guard: str = "") -> DataFrame:
    """GEOADD: points in range over the old ones; ``nx`` and ``xx`` as for strings."""
    inside = new.where((F.abs("lat") <= MAX_LAT) & (F.abs("lon") <= MAX_LON))
    return upsert(geos, inside, ["key", "member"], guard)


def geodist(geos: DataFrame, pairs: DataFrame, unit: str = "m") -> DataFrame:
    """GEODIST for (key, a, b): the distance with four decimals, as text; null where a member is absent."""
    left = geos.select("key", F.col("member").alias("a"), F.col("lon").alias("_x"), F.col("lat").alias("_y"))
    right = geos.select("key", F.col("member").alias("b"), F.col("lon").alias("_u"), F.col("lat").alias("_v"))
    both = pairs.join(left, ["key", "a"], "left").join(right, ["key", "b"], "left")
    metres = haversine(F.col("_x"), F.col("_y"), F.col("_u"), F.col("_v"))
    return both.select("key", "a", "b", F.format_string("%.4f", metres / UNITS[unit]).alias("dist")).withColumn("dist", F.when(F.col("dist") != "null", F.col("dist")))


def geohash(geos: DataFrame) -> DataFrame:
    """GEOHASH of every point."""
    return geos.select("key", "member", geohash_text(geohash_bits(F.col("lon"), F.col("lat"))).alias("hash"))


def around(geos: DataFrame, lon: float, lat: float, radius: float, unit: str = "m") -> DataFrame:
    """GEOSEARCH BYRADIUS around one point: a latitude band reaches the scan, then the exact distance (in the unit)."""
    metres = radius * UNITS[unit]
    band = math.degrees(metres / EARTH_M) + 1e-9
    dist = haversine(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat"))
    return geos.where(F.col("lat").between(lat - band, lat + band)).withColumn("dist", dist / UNITS[unit]).where(dist <= metres)


def in_box(geos: DataFrame, lon: float, lat: float, width: float, height: float, unit: str = "m") -> DataFrame:
    """GEOSEARCH BYBOX: a box of degrees around one point, with the distance from it."""
    box = in_degree_box(F.col("lon"), F.col("lat"), F.lit(lon), F.lit(lat), width * UNITS[unit], height * UNITS[unit])
    return geos.where(box).withColumn("dist", haversine(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat")) / UNITS[unit])


def around_member(geos: DataFrame, key: str, member: str, radius: float, unit: str = "m") -> DataFrame:
    """GEOSEARCH FROMMEMBER, GEORADIUSBYMEMBER: the points of a key around one of its members; none for an absent one."""
    own = geos.where(F.col("key") == key)
    centre = own.where(F.col("member") == member).select("lon", "lat").first()
    return own.limit(0).withColumn("dist", F.lit(0.0)) if centre is None else around(own, centre["lon"], centre["lat"], radius, unit)


def at_places(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Places (columns ``by``) with lists of the ``name`` values there, LIST at most in each; a place may have many lists.

    Rows are dealt by ranges of place and name, and a list is a run of neighbours, so a hot place is no single task's.
    """
    dealt = rows.repartitionByRange(*by, name).sortWithinPartitions(*by, name)
    runs = dealt.withColumn("_run", F.floor(F.monotonically_increasing_id() / LIST))
    # a list leaves null names out, so names are wrapped
    return runs.groupBy(*by, "_run").agg(F.collect_list(F.struct(name)).alias(f"_all_{name}")).drop("_run")


def radius_join(points: DataFrame, centres: DataFrame, radius: float, unit: str = "m", digits: int | None = None) -> DataFrame:
    """Every centre (centre, lon, lat) with the points (member, lon, lat) within the radius, and their distance.

    Bands of latitude as high as the radius, cut into cells that are as wide at the band's narrow edge: a point can
    only match centres of nine cells. Centres go to their nine cells, points to one; the join is on the cell. Both sides
    come by place, with lists of who is there: a distance is worked out, tested and rounded (to ``digits``) once for two
    places, and lists are only taken apart in the task that found the pair, so no pair is ever exchanged. Rows without
    a longitude or latitude match nothing; repeated rows give repeated pairs.
    """
    metres = radius * UNITS[unit]
    side = max(math.degrees(metres / EARTH_M) * 1.000001, 1e-6)
    band = lambda lat: F.floor((lat + 90.0) / side)

    def columns_of(b: Column) -> Column:
        """Cells around a band: as many as the narrowest edge of it and its neighbours has room for, at least one."""
        edge = F.least(F.lit(90.0), F.greatest(F.abs((b - 1) * side - 90.0), F.abs((b + 2) * side - 90.0)))
        return F.greatest(F.lit(1).cast("long"), F.floor(360.0 * F.cos(F.radians(edge)) / (side * 1.2)))

    def column_at(lon: Column, b: Column) -> Column:
        return F.least(columns_of(b) - 1, F.floor((lon + 180.0) / 360.0 * columns_of(b)))

    placed = points.select("member", F.col("lon").alias("_x"), F.col("lat").alias("_y"), band(F.col("lat")).alias("_b")).withColumn("_c", column_at(F.col("_x"), F.col("_b")))
    placed = at_places(placed.where("_b IS NOT NULL AND _c IS NOT NULL"), ["_b", "_c", "_x", "_y"], "member")
    held = at_places(centres.select("centre", "lon", "lat").where("lon IS NOT NULL AND lat IS NOT NULL"), ["lat", "lon"], "centre")
    spread = held.withColumn("_b", F.explode(F.array(*(band(F.col("lat")) + k for k in (-1, 0, 1)))))
    cells = F.array_distinct(F.array(*(F.pmod(column_at(F.col("lon"), F.col("_b")) + k, columns_of(F.col("_b"))) for k in (-1, 0, 1))))
    spread = spread.withColumn("_c", F.explode(cells))
    dist = haversine(F.col("lon"), F.col("lat"), F.col("_x"), F.col("_y"))
    shown = dist / UNITS[unit] if digits is None else F.round(dist / UNITS[unit], digits)
    # a merge: a side's size is no bound on what it would take as a broadcast
    near = spread.hint("merge").join(placed, ["_b", "_c"]).where(dist <= metres).select("_all_centre", "_all_member", shown.alias("dist"))
    pairs = near.select("_all_member", "dist", F.explode("_all_centre").alias("_one")).select("_all_member", "dist", F.col("_one.centre").alias("centre"))
    return pairs.select("centre", "dist", F.explode("_all_member").alias("_one")).select("centre", F.col("_one.member").alias("member"), "dist")


def store_distances(found: DataFrame, target: str) -> DataFrame:
    """STOREDIST: a scored set of the distances with four decimals."""
    return found.select(F.lit(target).alias("key"), "member", F.round("dist", 4).alias("score"))
