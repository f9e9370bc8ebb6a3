"""Serving views: filters, sorts, matrices, nesting and opportunity lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import LISTINGS_SQL, STORES_SQL, listings, stores, table
from ..registry import query

_CARRY_SQL = f"{LISTINGS_SQL}, {STORES_SQL}, c AS (SELECT domain, string_agg(DISTINCT vendor, ',' ORDER BY vendor) AS vendors, count(DISTINCT vendor) AS brands, round(avg(price), 2) AS mean_price FROM listings GROUP BY domain)"


def carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each store's brands, as a sorted array, with their number and mean price."""
    return listings(spark, sf_dir).groupBy("domain").agg(F.sort_array(F.collect_set("vendor")).alias("vendors"), F.countDistinct("vendor").alias("brands"), F.round(F.avg("price"), 2).alias("mean_price"))


@query(f"WITH {_CARRY_SQL} SELECT s.domain AS domain, state, brands FROM stores s JOIN c ON c.domain = s.domain WHERE (list_contains(string_split(vendors, ','), 'Brand#7') OR list_contains(string_split(vendors, ','), 'Brand#9')) AND store_type <> 'own_brand' AND (contains(lower(state), '1') OR contains(lower(s.domain), '1') OR contains(lower(vendors), 'brand#11'))")
def map_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retailer map's filter: a watched brand, a store type, and a search over scalars and arrays at once."""
    q = F.lit("1")
    watched = F.array_contains("vendors", "Brand#7") | F.array_contains("vendors", "Brand#9")
    found = F.lower("state").contains(q) | F.lower("domain").contains(q) | F.exists("vendors", lambda v: F.lower(v).contains("brand#11"))
    return stores(spark, sf_dir).join(carried(spark, sf_dir), "domain").where(watched & (F.col("store_type") != "own_brand") & found).select("domain", "state", "brands")


@query(f"WITH {_CARRY_SQL}, r AS (SELECT s.domain AS domain, mean_price, row_number() OVER (ORDER BY mean_price DESC NULLS LAST, s.domain) AS place FROM stores s LEFT JOIN c ON c.domain = s.domain) SELECT domain, mean_price, place FROM r WHERE place BETWEEN 11 AND 30")
def nulls_last_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of stores by mean price, those without one last; paging is the feature."""
    page = stores(spark, sf_dir).join(carried(spark, sf_dir), "domain", "left").select("domain", "mean_price").orderBy(F.desc_nulls_last("mean_price"), "domain").offset(10).limit(20)
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("mean_price"), "domain")) + 10  # over the page's twenty rows
    return page.withColumn("place", place)


@query(f"WITH {_CARRY_SQL}, u AS (SELECT domain, unnest(['products', 'garments', 'accessories', 'on_sale']) AS stage, unnest([count(*), count(*) FILTER (WHERE knit_kind = 'garment'), count(*) FILTER (WHERE knit_kind = 'accessory'), count(*) FILTER (WHERE on_sale AND price > 998)]) AS n FROM listings GROUP BY domain) SELECT stage, CAST(count(*) FILTER (WHERE n > 0) AS BIGINT) AS stores, CAST(sum(n) AS BIGINT) AS total FROM u GROUP BY stage")
def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores that reach each stage, and what they have in it: measures unpivoted into rows."""
    kind = F.col("knit_kind")
    wide = listings(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("products"), F.count_if(kind == "garment").alias("garments"), F.count_if(kind == "accessory").alias("accessories"), F.count_if(F.col("on_sale") & (F.col("price") > 998)).alias("on_sale"))
    long = wide.unpivot("domain", ["products", "garments", "accessories", "on_sale"], "stage", "n")
    return long.groupBy("stage").agg(F.count_if(F.col("n") > 0).alias("stores"), F.sum("n").alias("total"))


@query("WITH p AS (SELECT page_id, CASE WHEN url IS NULL THEN 'no_website' WHEN page_id % 9 = 0 THEN 'duplicate' ELSE 'processed' END AS status FROM pages) SELECT count(*) AS links, CAST(count(*) FILTER (WHERE status = 'processed') AS BIGINT) AS processed, CAST(count(*) FILTER (WHERE status <> 'processed') AS BIGINT) AS skipped, count(*) = count(*) FILTER (WHERE status = 'processed') + count(*) FILTER (WHERE status <> 'processed') AS balanced FROM p")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links are those processed and those skipped, and nothing else."""
    status = F.when(F.col("url").isNull(), "no_website").when(F.col("page_id") % 9 == 0, "duplicate").otherwise("processed")
    p = table(spark, sf_dir, "pages").select(status.alias("status"))
    done, skipped = F.count_if(F.col("status") == "processed"), F.count_if(F.col("status") != "processed")
    return p.agg(F.count("*").alias("links"), done.alias("processed"), skipped.alias("skipped"), (F.count("*") == done + skipped).alias("balanced"))


@query("SELECT n_regionkey, CASE WHEN count(DISTINCT c_nationkey % 2) = 1 THEN 'C' || CAST(min(c_nationkey % 2) AS VARCHAR) ELSE 'mixed' END AS currency FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_regionkey")
def single_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one currency of a region's customers, or that there are several."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*"))
    money = F.col("n_nationkey") % 2
    return c.join(table(spark, sf_dir, "nation"), "n_nationkey").groupBy("n_regionkey").agg(F.when(F.min(money) == F.max(money), F.concat(F.lit("C"), F.min(money).cast("string"))).otherwise("mixed").alias("currency"))


@query("SELECT o_custkey, count(*) AS orders, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS order_keys FROM orders GROUP BY o_custkey")
def explode_nest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tidy rows nested under their key, and unnested and nested again."""
    nested = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("orders"))
    tidy = nested.select("o_custkey", F.inline("orders"))
    return tidy.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda k: k.cast("string")), ",").alias("order_keys"))


@query(f"WITH {_CARRY_SQL}, h AS (SELECT domain, bool_or(vendor = 'Brand#7' AND price > 995) AS sells FROM listings GROUP BY domain) SELECT s.domain AS domain, state, coalesce(vendors, '') AS vendors, CAST(coalesce(brands, 0) AS BIGINT) AS brands FROM stores s LEFT JOIN c ON c.domain = s.domain LEFT JOIN h ON h.domain = s.domain WHERE status = 'ok' AND NOT coalesce(sells, false)")
def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores that were read and don't sell the home brand's dear products, with the brands that they do sell."""
    home = (F.col("vendor") == "Brand#7") & (F.col("price") > 995)
    sells = listings(spark, sf_dir).groupBy("domain").agg(F.bool_or(home).alias("sells"))
    s = stores(spark, sf_dir).where("status = 'ok'").join(sells, "domain", "left").where(~F.coalesce("sells", F.lit(False))).join(carried(spark, sf_dir), "domain", "left")
    return s.select("domain", "state", F.coalesce(F.array_join("vendors", ","), F.lit("")).alias("vendors"), F.coalesce("brands", F.lit(0)).alias("brands"))


@query("WITH t AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'home_store' WHEN c_mktsegment = 'HOUSEHOLD' AND c_acctbal > 5000 THEN 'department_store' WHEN c_name LIKE '%7' THEN 'boutique' WHEN c_acctbal < 0 THEN 'closed' ELSE 'other' END AS kind FROM customer) SELECT kind, count(*) AS n FROM t GROUP BY kind")
def business_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by the first rule of their trade that fits."""
    segment, money = F.col("c_mktsegment"), F.col("c_acctbal")
    kind = F.when(segment == "FURNITURE", "home_store").when((segment == "HOUSEHOLD") & (money > 5000), "department_store").when(F.col("c_name").endswith("7"), "boutique").when(money < 0, "closed").otherwise("other")
    return table(spark, sf_dir, "customer").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT doc_id, length(text) AS n, len(regexp_extract_all(text, '[0-9]')) AS d FROM documents), w AS (SELECT doc_id, n, d, d * 100 // greatest(n, 1) AS density FROM p) SELECT CAST(density AS BIGINT) AS density, count(*) AS documents, CAST(max(d) AS BIGINT) AS digits FROM w GROUP BY 1")
def digit_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the share of digits in them."""
    p = table(spark, sf_dir, "documents").select(F.char_length("text").alias("n"), F.regexp_count("text", F.lit("[0-9]")).alias("d"))
    return p.groupBy(F.floor(F.col("d") * 100 / F.greatest("n", F.lit(1))).cast("long").alias("density")).agg(F.count("*").alias("documents"), F.max("d").cast("long").alias("digits"))


@query("WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 AS t FROM events WHERE event_type = 'view'), w AS (SELECT user_id, t, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN CURRENT ROW AND 86400 FOLLOWING) AS n FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, t) AS k FROM w) SELECT user_id, t AS began, n FROM r WHERE k = 1")
def dense_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day-long stretch in which each store was viewed most: a range frame, then a maximum by struct."""
    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    e = table(spark, sf_dir, "events").where("event_type = 'view'").select("user_id", t.alias("t"))
    w = e.withColumn("n", F.count("*").over(Window.partitionBy("user_id").orderBy("t").rangeBetween(0, 86400)))
    best = w.groupBy("user_id").agg(F.max(F.struct("n", (-F.col("t")).alias("t"))).alias("m"))
    return best.select("user_id", (-F.col("m.t")).alias("began"), F.col("m.n").alias("n"))


@query("SELECT o_orderpriority, coalesce(CAST(year(o_orderdate) AS VARCHAR), 'all') AS year, count(*) AS orders, round(sum(o_totalprice), 0) AS total FROM orders GROUP BY ROLLUP (o_orderpriority, year(o_orderdate))")
def order_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by priority and year with subtotals. An extension: the retail rules have no subtotals."""
    o = table(spark, sf_dir, "orders").rollup("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 0).alias("total"))
    return o.select("o_orderpriority", F.coalesce(F.col("y").cast("string"), F.lit("all")).alias("year"), "orders", "total")
