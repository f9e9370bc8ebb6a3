"""The retail model over the star-schema tables: stores are suppliers, listings are what they supplied, baskets are orders."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """The domain's vocabulary and thresholds, all configurable."""

    home_brand: str = "brand7"
    peers: tuple[str, ...] = ("brand1", "brand2", "brand3", "brand4")
    competitors: tuple[str, ...] = ("brand20", "brand21")
    garments: str = r"\b(widget|gizmo)\b"
    accessories: str = r"\b(ring|rod)\b"
    sale_discount: float = 0.09
    price_window: tuple[float, float] = (905.0, 985.0)
    near_miles: float = 15.0
    min_support: int = 5
    aliases: dict = field(default_factory=lambda: {"brand25": "brand1"})


RULES = Rules()
#: Rows that one task groups.
TASK_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of about ``rows`` rows, dealt by ``keys`` to tasks of about TASK_ROWS rows each: a task that groups or sorts them needs no more memory when there are more of them."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)


def listings(spark: SparkSession, sf_dir: str, rules: Rules = RULES) -> DataFrame:
    """One row a (store, part): aggregated on the fact table first, so the joins see listings and not order lines."""
    lines = table(spark, sf_dir, "lineitem")
    line = dealt(lines, lines.count(), "l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey").agg(F.max("l_discount").alias("discount"), F.max("l_shipdate").alias("launched"), F.count("*").alias("lines"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("title"), F.col("p_brand").alias("vendor"), F.col("p_type").alias("product_type"), F.col("p_retailprice").alias("price"))
    store = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.lower("s_name").alias("domain"))
    kind = F.when(F.col("title").rlike(rules.garments), "garment").when(F.col("title").rlike(rules.accessories), "accessory").otherwise("")
    return line.join(part, "l_partkey").join(store, "l_suppkey").select("domain", F.col("l_partkey").alias("listing_id"), "title", "vendor", "product_type", "price", (F.col("discount") > rules.sale_discount).alias("on_sale"), "launched", "lines", kind.alias("knit_kind"))


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a store, with the read status and store type that the supplier's key and balance stand for."""
    key, balance = F.col("s_suppkey"), F.col("s_acctbal")
    status = F.when(key % 17 == 0, "blocked").when(key % 19 == 0, "error").otherwise("ok")
    kind = F.when(balance < 0, "own_brand").when(balance < 1000, "unknown").otherwise("multi_brand")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("state"))
    return table(spark, sf_dir, "supplier").join(nation, "s_nationkey", "left").select("s_suppkey", F.lower("s_name").alias("domain"), status.alias("status"), kind.alias("store_type"), "state")


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (store, brand_key) edges of the brand graph, in which orders are the stores."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]+", "").alias("brand_key"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(part, "l_partkey").select(F.col("l_orderkey").alias("store"), "brand_key").distinct()


LISTINGS_SQL = r"""
listings AS (
  SELECT lower(s_name) AS domain, l_partkey AS listing_id, p_name AS title, p_brand AS vendor, p_type AS product_type, p_retailprice AS price, max(l_discount) > 0.09 AS on_sale, max(l_shipdate) AS launched, count(*) AS lines,
         CASE WHEN regexp_matches(p_name, '\b(widget|gizmo)\b') THEN 'garment' WHEN regexp_matches(p_name, '\b(ring|rod)\b') THEN 'accessory' ELSE '' END AS knit_kind
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_suppkey, s_name, l_partkey, p_name, p_brand, p_type, p_retailprice)"""
STORES_SQL = """
stores AS (
  SELECT s_suppkey, lower(s_name) AS domain, CASE WHEN s_suppkey % 17 = 0 THEN 'blocked' WHEN s_suppkey % 19 = 0 THEN 'error' ELSE 'ok' END AS status,
         CASE WHEN s_acctbal < 0 THEN 'own_brand' WHEN s_acctbal < 1000 THEN 'unknown' ELSE 'multi_brand' END AS store_type, n_name AS state
  FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey)"""
BASKETS_SQL = "baskets AS (SELECT DISTINCT l_orderkey AS store, regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g') AS brand_key FROM lineitem JOIN part ON p_partkey = l_partkey)"
