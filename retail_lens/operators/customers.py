"""Customers against stores: the match cascade, neighbours within a radius, and set joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import LISTINGS_SQL, RULES, STORES_SQL, dealt, listings, stores, table
from ..functions.geo import EARTH_MILES, haversine_miles
from ..registry import query


def located(df: DataFrame, key: Column, a: int, b: int) -> DataFrame:
    """Coordinates that a key stands for, as the tables hold none."""
    return df.withColumns({"lat": 30 + (key * a % 1500) / 100, "lng": -110 + (key * b % 3000) / 100})


def _places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    shops = located(stores(spark, sf_dir), F.col("s_suppkey"), 37, 61).select("domain", "lat", "lng")
    people = located(table(spark, sf_dir, "customer"), F.col("c_custkey"), 53, 71).select("c_custkey", F.col("c_name").alias("name"), F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"))
    return shops, people


def _cells(row: Column, lng: Column, miles: float, high: float) -> tuple[Column, Column]:
    """(column of a longitude, number of columns) in a row of the grid: columns are at least as wide as ``miles`` reach from that row or its neighbours."""
    edge = F.radians(F.least(F.greatest(F.abs(row * high - 90 - high), F.abs(row * high - 90 + 2 * high)), F.lit(90.0)))
    reach = F.lit(math.sin(min(miles / EARTH_MILES, math.pi) / 2)) / F.greatest(F.cos(edge), F.lit(1e-9))
    n = F.when(reach >= 1, 1).otherwise(F.greatest(F.floor(math.pi / F.asin(F.least(reach, F.lit(1.0))) * (1 - 1e-9)), F.lit(1))).cast("long")
    return F.pmod(F.floor((lng + 180) / 360 * n).cast("long"), n), n


def within_radius(left: DataFrame, right: DataFrame, miles: float) -> DataFrame:
    """Pairs of ``left`` (lat, lng) and ``right`` (c_lat, c_lng) at most ``miles`` apart, with the distance.

    A join on the cells of a grid: rows are as high as the radius, and each row's columns as wide as it is there, around the globe.
    The right side stands in its own cell and those around it, so no pair outside them is compared, and none is missed at the
    poles or the date line. Null coordinates are near nothing.
    """
    high = math.degrees(min(miles / EARTH_MILES, math.pi)) * (1 + 1e-9)
    row_of = lambda lat: F.floor((lat + 90) / high).cast("long")
    right = right.withColumn("row", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: row_of(F.col("c_lat")) + i)))
    col, n = _cells(F.col("row"), F.col("c_lng"), miles, high)
    right = right.withColumn("col", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.pmod(col + i, n)))))
    left = left.withColumn("row", row_of(F.col("lat"))).withColumn("col", _cells(F.col("row"), F.col("lng"), miles, high)[0])
    near = left.join(right, ["row", "col"]).drop("row", "col")
    return near.withColumn("miles", haversine_miles(F.col("lat"), F.col("lng"), F.col("c_lat"), F.col("c_lng"))).where(F.col("miles") <= miles)


def nearby(left: DataFrame, right: DataFrame, miles: float) -> DataFrame:
    """``left`` (lat, lng) with within, the points of ``right`` (c_lat, c_lng) at most ``miles`` away, and nearest, the miles to the nearest of them; rows near none are left out.

    Points of one place are one spot with a count, on both sides and before they meet: pairs are of places, however many rows share each.
    """
    asked = left.select("lat", "lng").distinct()
    spots = right.groupBy("c_lat", "c_lng").agg(F.count("*").alias("n"))
    near = within_radius(asked, spots, miles).groupBy("lat", "lng").agg(F.sum("n").alias("within"), F.min("miles").alias("nearest"))
    return left.join(near, ["lat", "lng"])


_GEO_SQL = f"""{STORES_SQL},
shops AS (SELECT domain, 30 + (s_suppkey * 37 % 1500) / 100 AS lat, -110 + (s_suppkey * 61 % 3000) / 100 AS lng FROM stores),
people AS (SELECT c_custkey, c_name AS name, 30 + (c_custkey * 53 % 1500) / 100 AS c_lat, -110 + (c_custkey * 71 % 3000) / 100 AS c_lng FROM customer),
near AS (SELECT domain, c_custkey, name, 2 * 3958.8 * asin(least(1.0, sqrt(pow(sin((radians(c_lat) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(c_lat)) * pow(sin((radians(c_lng) - radians(lng)) / 2), 2)))) AS miles FROM shops CROSS JOIN people)"""


@query(f"WITH {_GEO_SQL} SELECT domain, count(*) AS within, round(min(miles), 1) AS nearest_miles FROM near WHERE miles <= 15 GROUP BY domain")
def nearest_within_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers within the radius of each store, and the distance to the nearest."""
    shops, people = _places(spark, sf_dir)
    return nearby(shops, people, RULES.near_miles).groupBy("domain").agg(F.sum("within").alias("within"), F.round(F.min("nearest"), 1).alias("nearest_miles"))


@query(f"WITH {_GEO_SQL}, n AS (SELECT domain, min(miles) AS miles FROM near WHERE miles <= 15 GROUP BY domain), b AS (SELECT CASE WHEN s_suppkey % 13 = 0 THEN 'unknown' WHEN n.miles IS NOT NULL THEN 'near' ELSE 'open' END AS territory FROM stores LEFT JOIN n ON n.domain = stores.domain) SELECT territory, count(*) AS stores FROM b GROUP BY 1")
def territory_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores with a customer in the radius are near, stores without a place unknown, and the rest open."""
    shops, people = _places(spark, sf_dir)
    near = nearby(shops, people, RULES.near_miles).select("domain").distinct().withColumn("near", F.lit(True))
    bucket = F.when(F.col("s_suppkey") % 13 == 0, "unknown").when(F.col("near"), "near").otherwise("open")
    return stores(spark, sf_dir).join(near, "domain", "left").groupBy(bucket.alias("territory")).agg(F.count("*").alias("stores"))


@query(f"WITH {_GEO_SQL}, m AS (SELECT domain, bool_or(miles <= 1) AS same, bool_or(miles <= 15) AS near FROM near WHERE miles <= 15 GROUP BY domain) SELECT stores.domain AS domain, CASE WHEN same THEN 'same' WHEN s_suppkey % 10 = c_nationkey % 10 AND s_suppkey = c_custkey THEN 'check' WHEN near THEN 'near' ELSE 'open' END AS grp FROM stores LEFT JOIN m ON m.domain = stores.domain LEFT JOIN customer ON c_custkey = s_suppkey")
def locator_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a store stands at a customer's door, is to be checked by name, is near one, or in the open."""
    shops, people = _places(spark, sf_dir)
    m = nearby(shops, people, RULES.near_miles).groupBy("domain").agg((F.min("nearest") <= 1).alias("same"))
    named = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("s_suppkey"), "c_nationkey")
    check = F.col("s_suppkey") % 10 == F.col("c_nationkey") % 10
    return stores(spark, sf_dir).join(m, "domain", "left").join(named, "s_suppkey", "left").select("domain", F.when(F.col("same"), "same").when(check, "check").when(F.col("same").isNotNull(), "near").otherwise("open").alias("grp"))


_MATCH_SQL = """
s AS (SELECT s_suppkey, 'shop' || CAST(s_suppkey AS VARCHAR) || '.example.com' AS domain, right('0000000000' || CAST(s_suppkey * 7 % 1000 AS VARCHAR), 10) AS phone, 'shop' || CAST(s_suppkey % 50 AS VARCHAR) AS core, s_nationkey FROM supplier),
c AS (SELECT c_custkey AS seq, CASE WHEN c_custkey % 11 = 0 THEN 'shop' || CAST(c_custkey // 11 AS VARCHAR) || '.example.com' ELSE '' END AS domain, CASE WHEN c_custkey % 3 = 0 THEN right('0000000000' || CAST(c_custkey AS VARCHAR), 10) ELSE '' END AS phone, 'shop' || CAST(c_custkey % 60 AS VARCHAR) AS core, c_nationkey FROM customer),
m AS (SELECT s.domain AS domain, 1 AS tier, seq FROM s JOIN c ON s.domain = c.domain UNION ALL SELECT s.domain, 2, seq FROM s JOIN c ON s.phone = c.phone UNION ALL SELECT s.domain, 3, seq FROM s JOIN c ON s.core = c.core AND s_nationkey = c_nationkey),
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY tier, seq) AS k FROM m)"""


def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each store (s_suppkey, domain) the best match (m: tier, seq); each tier is a hash join."""
    text = lambda c: c.cast("string")
    key, seq = F.col("s_suppkey"), F.col("c_custkey")
    shop = lambda k: F.concat(F.lit("shop"), text(k), F.lit(".example.com"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", shop(key).alias("domain"), F.lpad(text(key * 7 % 1000), 10, "0").alias("phone"), F.concat(F.lit("shop"), text(key % 50)).alias("core"), F.col("s_nationkey").alias("state"))
    c = table(spark, sf_dir, "customer").select(seq.alias("seq"), F.when(seq % 11 == 0, shop(F.floor(seq / 11))).alias("domain"), F.when(seq % 3 == 0, F.lpad(text(seq), 10, "0")).alias("phone"), F.concat(F.lit("shop"), text(seq % 60)).alias("core"), F.col("c_nationkey").alias("state"))
    own = ["s_suppkey", s["domain"]]
    tiers = [s.join(c.select("seq", *on), on).groupBy(*own).agg(F.min("seq").alias("seq")).select("s_suppkey", "domain", F.lit(tier).alias("tier"), "seq") for tier, on in enumerate((["domain"], ["phone"], ["core", "state"]), 1)]
    return tiers[0].unionAll(tiers[1]).unionAll(tiers[2]).groupBy("s_suppkey", "domain").agg(F.min(F.struct("tier", "seq")).alias("m"))


def matched_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s_suppkey, seq): the customer that a store is."""
    return _tiers(spark, sf_dir).select("s_suppkey", "m.seq")


@query(f"WITH {_MATCH_SQL} SELECT domain, tier, seq FROM r WHERE k = 1")
def match_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer that a store is: by domain, else by phone, else by name in one state; the first in list order. Each tier is a hash join."""
    return _tiers(spark, sf_dir).select("domain", "m.tier", "m.seq")


@query(f"WITH {STORES_SQL} SELECT domain, state FROM stores WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def anti_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores that are no known customer."""
    known = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("s_suppkey"))
    return stores(spark, sf_dir).join(known, "s_suppkey", "left_anti").select("domain", "state")


@query(f"WITH {LISTINGS_SQL}, ref AS (SELECT * FROM (VALUES ('LARGE', 950.0), ('SMALL', 1010.0), ('default', 1000.0)) t(category, retail)), m AS (SELECT product_type, median(price) AS price FROM listings GROUP BY 1) SELECT product_type, round(price / coalesce(retail, (SELECT retail FROM ref WHERE category = 'default')), 2) AS ratio, CASE WHEN round(price / coalesce(retail, 1000.0), 2) < 0.75 THEN 'below' WHEN round(price / coalesce(retail, 1000.0), 2) > 1.35 THEN 'above' ELSE 'fits' END AS fit FROM m LEFT JOIN ref ON category = product_type")
def price_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median price of each type against its reference price, or the default one."""
    ref = spark.createDataFrame([("LARGE", 950.0), ("SMALL", 1010.0)], "product_type string, retail double")
    m = listings(spark, sf_dir).groupBy("product_type").agg(F.percentile("price", F.lit(0.5)).alias("price"))
    r = m.join(F.broadcast(ref), "product_type", "left").withColumn("ratio", F.round(F.col("price") / F.coalesce("retail", F.lit(1000.0)), 2))  # a fixed list
    return r.select("product_type", "ratio", F.when(F.col("ratio") < 0.75, "below").when(F.col("ratio") > 1.35, "above").otherwise("fits").alias("fit"))


@query("WITH i AS (SELECT s_suppkey, unnest([s_suppkey * 3, s_suppkey, s_suppkey * 5]) AS id, unnest([0, 1, 2]) AS pos FROM supplier), j AS (SELECT s_suppkey, first(c_name ORDER BY pos) AS name FROM i JOIN customer ON c_custkey = id WHERE c_mktsegment <> 'MACHINERY' GROUP BY s_suppkey) SELECT s.s_suppkey AS s_suppkey, coalesce(name, '') AS name FROM supplier s LEFT JOIN j ON j.s_suppkey = s.s_suppkey")
def array_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of the first of a store's inputs that has one; a store lists its inputs in an array."""
    key = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    ids = s.select("s_suppkey", F.posexplode(F.array(key * 3, key, key * 5)).alias("pos", "c_custkey"))
    named = ids.join(table(spark, sf_dir, "customer").where("c_mktsegment <> 'MACHINERY'").select("c_custkey", "c_name"), "c_custkey")
    return s.join(named.groupBy("s_suppkey").agg(F.min_by("c_name", "pos").alias("name")), "s_suppkey", "left").select("s_suppkey", F.coalesce("name", F.lit("")).alias("name"))


@query("WITH o AS (SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) SELECT c_custkey, CASE WHEN o_custkey IS NULL THEN 'not visited' ELSE 'processed' END AS status, CAST(coalesce(orders, 0) AS BIGINT) AS orders, total FROM customer LEFT JOIN o ON o_custkey = c_custkey")
def left_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an input, with what was found for it, or the status that says why nothing was. Aggregated before the join."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.when(F.col("n").isNull(), "not visited").otherwise("processed").alias("status"), F.coalesce("n", F.lit(0)).alias("orders"), "total")


@query("SELECT 'common' AS part, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'only_customers', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'all', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the intersection, difference and union of two key sets."""
    c = table(spark, sf_dir, "customer").select("c_nationkey")
    s = table(spark, sf_dir, "supplier").select("s_nationkey")
    size = lambda part, df: df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
    return size("common", c.intersect(s)).unionAll(size("only_customers", c.subtract(s))).unionAll(size("all", c.union(s).distinct()))


@query(f"WITH {LISTINGS_SQL}, d AS (SELECT domain, vendor, title, product_type, listing_id, row_number() OVER (PARTITION BY domain, vendor, lower(title), product_type ORDER BY listing_id) AS k FROM listings) SELECT domain, vendor, title, product_type, listing_id FROM d WHERE k = 1")
def composite_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first listing of each (store, vendor, title, type)."""
    keyed = listings(spark, sf_dir).select("domain", "vendor", "title", F.lower("title").alias("key"), "product_type", "listing_id")
    each = dealt(keyed, table(spark, sf_dir, "lineitem").count(), "domain", "vendor", "key", "product_type")
    d = each.groupBy("domain", "vendor", "key", "product_type").agg(F.min(F.struct("listing_id", "title")).alias("first"))
    return d.select("domain", "vendor", F.col("first.title").alias("title"), "product_type", F.col("first.listing_id").alias("listing_id"))
