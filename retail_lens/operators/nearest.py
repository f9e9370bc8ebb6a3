"""The nearest point at any distance, and how many lie within a radius: a quadtree of points, searched level by level for all queries at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import RULES, stores, table
from ..functions.geo import EARTH_MILES, haversine_miles
from ..registry import query
from ..scratch import drop, saved
from .customers import _MATCH_SQL, located, matched_customers

#: A node of the tree is cut in SIDE x SIDE, unless it has LEAF spots or fewer; at DEPTH it is about a metre wide.
SIDE, DEPTH, LEAF = 4, 12, 64
#: Miles that are no difference between two distances; of points as near as that, the first by name is nearest.
TIE = 1e-6


def _cell(depth: int) -> Column:
    n = SIDE**depth
    part = lambda c, low, width: F.least(F.floor((F.col(c) + low) / width * n), F.lit(n - 1)).cast("long")
    return part("lat", 90, 180) * n + part("lng", 180, 360)


@dataclass(frozen=True)
class Tree:
    spots: DataFrame  # cell (depth, cell), lat, lng, n, first and second (name, key)
    levels: list[DataFrame]  # nodes by depth, from 1: parent, cell, leaf, n, a circle around the spots, and two of the keys with their places

    def drop(self) -> None:
        drop(self.spots, *self.levels)


def _spots(points: DataFrame) -> DataFrame:
    """One row a place: n points, and the first two keys there by (name, key). A place that very many points share is counted before it is shuffled, and ranked in two steps."""
    keys = points.where("lat is not null and lng is not null").groupBy("lat", "lng", "key").agg(F.count("*").alias("n"), F.min("name").alias("name"))
    order = Window.partitionBy("lat", "lng").orderBy("name", "key")
    two = keys.select("lat", "lng", "name", "key", F.row_number().over(order).alias("k")).where("k <= 2")  # Spark keeps two of each place before the shuffle, too
    named = two.groupBy("lat", "lng").agg(*(F.min(F.when(F.col("k") == k, F.struct("name", "key"))).alias(c) for k, c in ((1, "first"), (2, "second"))))
    return keys.groupBy("lat", "lng").agg(F.sum("n").alias("n")).join(named, ["lat", "lng"])


def quadtree(points: DataFrame) -> Tree:
    """The tree of ``points`` (key, name, lat, lng). Points without a place are not in it."""
    open_ = saved(_spots(points).withColumn("parent", F.lit(0).cast("long")), "spots")
    levels, leaves, used = [], [], [open_]
    for depth in range(1, DEPTH + 1):
        cells = open_.withColumn("cell", _cell(depth))
        low, high = F.least("first.key", "second.key"), F.greatest("first.key", "second.key")
        at = lambda k: F.struct(k.alias("key"), "lat", "lng")
        box = cells.groupBy("parent", "cell").agg(
            F.count("*").alias("spots"), F.sum("n").alias("n"), F.min("lat").alias("s"), F.max("lat").alias("t"), F.min("lng").alias("w"), F.max("lng").alias("e"), F.min(at(low)).alias("a"), F.max(at(high)).alias("b"))
        flat = F.when(F.col("s") * F.col("t") <= 0, 0.0).otherwise(F.least(F.abs("s"), F.abs("t")))  # the latitude where a degree of longitude is widest
        circle = EARTH_MILES * F.radians((F.col("t") - F.col("s")) / 2 + F.cos(F.radians(flat)) * (F.col("e") - F.col("w")) / 2)
        nodes = box.select("parent", "cell", (F.lit(depth == DEPTH) | (F.col("spots") <= LEAF)).alias("leaf"), "n", ((F.col("s") + F.col("t")) / 2).alias("c_lat"), ((F.col("w") + F.col("e")) / 2).alias("c_lng"), circle.alias("radius"), "a", "b")
        levels.append(saved(nodes, "nodes"))
        dealt = saved(cells.join(levels[-1].select("parent", "cell", "leaf"), ["parent", "cell"]).withColumn("depth", F.lit(depth)), "dealt")
        leaves.append(dealt.where("leaf"))
        used.append(dealt)
        open_ = dealt.where("not leaf").select("lat", "lng", "n", "first", "second", F.col("cell").alias("parent"))
        if open_.isEmpty():
            break
    spots = leaves[0]
    for x in leaves[1:]:
        spots = spots.unionByName(x)
    out = saved(spots.select("depth", "cell", "lat", "lng", "n", "first", "second"), "leaves")
    drop(*used)
    return Tree(out, levels)


def nearest(queries: DataFrame, points: DataFrame, miles: float) -> DataFrame:
    """``queries`` (lat, lng, skip) with nearest (the name), nearest_key, nearest_miles and nearby (points at most ``miles`` away), for points (key, name, lat, lng).

    The point whose key is ``skip`` counts for nothing. Of points at one distance (to a millionth of a mile), the first by name is nearest. The search begins at the root
    for all queries at once. At each level a query keeps the nodes that can hold a nearer point than one it knows of, or that the radius cuts; nodes inside the
    radius are counted whole. So a query meets a few nodes a level and the spots of a few leaves, however far its nearest point is and however many
    lie around it. Distances are on the sphere, so poles and the date line are places like others. Each level is written down.

    A query without a place has nulls; with no point to find, nearest is null and nearby 0. Queries of one place and skip are searched once, and points of one
    place are one spot. Repeated queries stay rows of their own; other columns of ``queries`` stay, and those with the names of new ones are replaced.
    """
    tree = quadtree(points)
    asked = queries.where("lat is not null and lng is not null").select("lat", "lng", "skip").distinct()
    asked = saved(asked.select(F.monotonically_increasing_id().alias("q"), F.col("lat").alias("q_lat"), F.col("lng").alias("q_lng"), "skip"), "queries")
    front = asked.withColumns({"parent": F.lit(0).cast("long"), "counted": F.lit(False), "best": F.lit(float("inf"))})
    steps = []
    for depth, nodes in enumerate(tree.levels, 1):
        to = lambda p: haversine_miles(F.col("q_lat"), F.col("q_lng"), F.col(f"{p}lat"), F.col(f"{p}lng"))
        known = F.least(*(F.when(F.col("skip").isNull() | (F.col(f"{k}.key") != F.col("skip")), to(f"{k}.")) for k in ("a", "b")))
        met = front.join(F.broadcast(nodes) if depth == 1 else nodes, "parent").withColumns({"away": to("c_"), "known": known})  # the root has SIDE x SIDE nodes
        met = met.withColumn("best", F.least(F.col("best"), F.min("known").over(Window.partitionBy("q"))))
        least, most = F.col("away") - F.col("radius") - TIE, F.col("away") + F.col("radius") + TIE
        inside = ~F.col("counted") & (most <= miles)
        met = met.withColumns({"near": least <= F.col("best") + 2 * TIE, "inside": inside, "cut": ~F.col("counted") & ~inside & (least <= miles)})
        met = met.where("near or inside or cut").select("q", "q_lat", "q_lng", "skip", "cell", "leaf", "n", "best", "near", "inside", "cut", F.lit(depth).alias("depth"))
        steps.append(saved(met, "met"))
        front = steps[-1].where("not leaf and (near or cut)").select("q", "q_lat", "q_lng", "skip", F.col("cell").alias("parent"), (~F.col("cut")).alias("counted"), "best")
    met = steps[0]
    for x in steps[1:]:
        met = met.unionByName(x)
    best = met.groupBy("q").agg(F.min("best").alias("least"))
    pairs = met.where("leaf and (near or cut)").select("q", "q_lat", "q_lng", "skip", "depth", "cell", "cut").join(tree.spots, ["depth", "cell"])
    pairs = pairs.withColumn("away", haversine_miles(F.col("q_lat"), F.col("q_lng"), F.col("lat"), F.col("lng"))).join(best, "q").where((F.col("away") <= F.col("least") + 2 * TIE) | F.col("cut"))
    other = F.when(F.col("skip").isNull() | (F.col("first.key") != F.col("skip")), F.col("first")).otherwise(F.col("second"))
    found = pairs.groupBy("q").agg(F.min(F.when(other.isNotNull(), F.struct(F.round("away", 6).alias("miles"), other.getField("name").alias("name"), other.getField("key").alias("key")))).alias("at"), F.sum(F.when(F.col("cut") & (F.col("away") <= miles), F.col("n")).otherwise(0)).alias("some"))
    counted = met.groupBy("q").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("all"))
    own = points.where("lat is not null and lng is not null").select(F.col("key").alias("skip"), "lat", "lng").join(asked, "skip")
    own = own.where(haversine_miles(F.col("q_lat"), F.col("q_lng"), F.col("lat"), F.col("lng")) <= miles).groupBy("q").agg(F.count("*").alias("own"))
    nearby = F.coalesce("all", F.lit(0)) + F.coalesce("some", F.lit(0)) - F.coalesce("own", F.lit(0))
    answers = asked.join(counted, "q", "left").join(found, "q", "left").join(own, "q", "left")
    answers = saved(answers.select(F.col("q_lat").alias("lat"), F.col("q_lng").alias("lng"), F.col("skip").alias("skipped"), F.col("at.name").alias("nearest"), F.col("at.key").alias("nearest_key"), F.col("at.miles").alias("nearest_miles"), nearby.alias("nearby")), "answers")
    tree.drop()
    drop(asked, *steps)
    new = ("nearest", "nearest_key", "nearest_miles", "nearby")
    rows = queries.drop(*(c for c in queries.columns if c.lower() in new))
    answers = answers.select(F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), "skipped", *new)
    return rows.join(answers, (F.col("lat") == F.col("_lat")) & (F.col("lng") == F.col("_lng")) & F.col("skip").eqNullSafe(F.col("skipped")), "left").select(*rows.columns, *new)


@query(f"""WITH {_MATCH_SQL},
shops AS (SELECT s_suppkey, 'shop' || CAST(s_suppkey AS VARCHAR) || '.example.com' AS shop, CASE WHEN s_suppkey % 13 <> 0 THEN 30 + (s_suppkey * 37 % 1500) / 100 END AS lat, -110 + (s_suppkey * 61 % 3000) / 100 AS lng FROM supplier),
asked AS (SELECT s_suppkey, lat, lng, seq AS skip FROM shops LEFT JOIN r ON r.domain = shop AND k = 1),
people AS (SELECT c_custkey, c_name AS name, 30 + (c_custkey * 53 % 1500) / 100 AS c_lat, -110 + (c_custkey * 71 % 3000) / 100 AS c_lng FROM customer WHERE c_mktsegment = 'FURNITURE'),
away AS (SELECT s_suppkey, name, 2 * 3958.8 * asin(least(1.0, sqrt(pow(sin((radians(c_lat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(c_lat)) * pow(sin((radians(c_lng) - radians(lng)) / 2), 2)))) AS miles FROM asked JOIN people ON lat IS NOT NULL AND c_custkey IS DISTINCT FROM skip),
n AS (SELECT s_suppkey, min(struct_pack(m := round(miles, 6), name := name)) AS found, count(*) FILTER (WHERE miles <= 15) AS nearby FROM away GROUP BY s_suppkey)
SELECT asked.s_suppkey AS s_suppkey, found.name AS nearest_stockist, round(found.m, 1) AS nearest_miles, nearby AS stockists_nearby FROM asked LEFT JOIN n ON n.s_suppkey = asked.s_suppkey""")
def nearest_stockist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each store's nearest stockist at any distance, and the stockists within the radius, without the customer that the store is. A store without a place has none."""
    key = F.col("s_suppkey")
    shops = located(stores(spark, sf_dir).select("s_suppkey"), key, 37, 61).withColumn("lat", F.when(key % 13 != 0, F.col("lat")))
    asked = shops.join(matched_customers(spark, sf_dir).withColumnRenamed("seq", "skip"), "s_suppkey", "left")
    people = located(table(spark, sf_dir, "customer").where("c_mktsegment = 'FURNITURE'"), F.col("c_custkey"), 53, 71).select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), "lat", "lng")
    return nearest(asked, people, RULES.near_miles).select("s_suppkey", F.col("nearest").alias("nearest_stockist"), F.round("nearest_miles", 1).alias("nearest_miles"), F.col("nearby").alias("stockists_nearby"))
