"""Stores: qualification, per-store measures, segments and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import LISTINGS_SQL, RULES, STORES_SQL, listings, stores, table
from ..functions.stats import ratio
from ..ranks import exclusive_quartile, quantile, ranked
from ..registry import query

_COUNTS_SQL = f"{LISTINGS_SQL}, {STORES_SQL}, counts AS (SELECT domain, count(*) AS products, CAST(count(*) FILTER (WHERE knit_kind <> '' AND price > 998) AS BIGINT) AS knit FROM listings GROUP BY domain)"


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    knit = (F.col("knit_kind") != "") & (F.col("price") > 998)
    counts = listings(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("products"), F.count_if(knit).alias("knit"))
    return stores(spark, sf_dir).join(counts, "domain", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("products", "knit")})


def qualifies() -> Column:
    return (F.col("status") == "ok") & (F.col("store_type") == "multi_brand") & (F.coalesce("knit", F.lit(0)) > 0)


def _quartiles(products: DataFrame) -> DataFrame:
    r = ranked(products.select("domain", "price"), ["domain"], "price")
    return r.groupBy("domain").agg(F.max("total").cast("int").alias("products"), *(exclusive_quartile("price", i, 3).alias(f"q{i}") for i in (1, 2, 3)))


def exclusion() -> Column:
    """Why a store is not on the final list; empty if it is."""
    return F.when(F.col("status") != "ok", "not_read").when(F.col("knit") == 0, "no_knitwear").when(F.col("store_type") == "own_brand", "own_brand").when(F.col("store_type") == "unknown", "not_judged").otherwise("")


@query(f"WITH {_COUNTS_SQL} SELECT s.domain AS domain, state, products, knit FROM stores s JOIN counts c ON c.domain = s.domain WHERE status = 'ok' AND store_type = 'multi_brand' AND knit > 0")
def final_list_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores that were read, sell many brands and have knitwear."""
    return _counted(spark, sf_dir).where(qualifies()).select("domain", "state", "products", "knit")


@query(f"WITH {_COUNTS_SQL} SELECT CASE WHEN status <> 'ok' THEN 'not_read' WHEN coalesce(knit, 0) = 0 THEN 'no_knitwear' WHEN store_type = 'own_brand' THEN 'own_brand' WHEN store_type = 'unknown' THEN 'not_judged' ELSE '' END AS reason, count(*) AS stores FROM stores s LEFT JOIN counts c ON c.domain = s.domain GROUP BY 1")
def exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores by the first reason that keeps them off the final list."""
    return _counted(spark, sf_dir).groupBy(exclusion().alias("reason")).agg(F.count("*").alias("stores"))


@query(f"WITH {_COUNTS_SQL} SELECT l.domain AS domain, listing_id, title, price FROM listings l WHERE knit_kind <> '' AND domain IN (SELECT s.domain FROM stores s JOIN counts c ON c.domain = s.domain WHERE status = 'ok' AND store_type = 'multi_brand' AND knit > 0)")
def semi_final_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knit products of the stores on the final list."""
    final = _counted(spark, sf_dir).where(qualifies()).select("domain")
    return listings(spark, sf_dir).where("knit_kind <> ''").join(final, "domain", "left_semi").select("domain", "listing_id", "title", "price")


@query(f"WITH {_COUNTS_SQL} SELECT l.domain AS domain, listing_id, knit_kind, (store_type = 'multi_brand' AND knit > 0) AS on_final_list FROM listings l JOIN stores s ON s.domain = l.domain JOIN counts c ON c.domain = l.domain WHERE status = 'ok' AND knit_kind <> ''")
def knit_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knit products of every store that was read, marked if the store is on the final list."""
    read = _counted(spark, sf_dir).where("status = 'ok'").select("domain", qualifies().alias("on_final_list"))
    return listings(spark, sf_dir).where("knit_kind <> ''").join(read, "domain").select("domain", "listing_id", "knit_kind", "on_final_list")


@query(f"""WITH {LISTINGS_SQL}, v AS (SELECT domain, list_sort(list(price)) AS a FROM listings GROUP BY domain),
n AS (SELECT domain, a, len(a) AS n, unnest([1, 2, 3]) AS i FROM v),
j AS (SELECT *, least(greatest(i * (n + 1) // 4, 1), n - 1) AS j FROM n),
q AS (SELECT domain, n, i, CASE WHEN n < 4 THEN CASE i WHEN 1 THEN a[1] WHEN 3 THEN a[n] ELSE (a[(n - 1) // 2 + 1] + a[n // 2 + 1]) / 2 END ELSE round((a[j] * (4 - (i * (n + 1) - 4 * j)) + a[j + 1] * (i * (n + 1) - 4 * j)) / 4, 3) END AS q FROM j)
SELECT domain, CAST(max(n) AS INT) AS products, max(q) FILTER (WHERE i = 1) AS q1, max(q) FILTER (WHERE i = 2) AS q2, max(q) FILTER (WHERE i = 3) AS q3 FROM q GROUP BY domain""")
def quartiles_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusive price quartiles of all of each store's products."""
    return _quartiles(listings(spark, sf_dir))


@query(f"""WITH {LISTINGS_SQL}, v AS (SELECT domain, list_sort(list(price)) AS a FROM listings WHERE knit_kind <> '' GROUP BY domain),
n AS (SELECT domain, a, len(a) AS n, unnest([1, 2, 3]) AS i FROM v),
j AS (SELECT *, least(greatest(i * (n + 1) // 4, 1), n - 1) AS j FROM n),
q AS (SELECT domain, n, i, CASE WHEN n < 4 THEN CASE i WHEN 1 THEN a[1] WHEN 3 THEN a[n] ELSE (a[(n - 1) // 2 + 1] + a[n // 2 + 1]) / 2 END ELSE round((a[j] * (4 - (i * (n + 1) - 4 * j)) + a[j + 1] * (i * (n + 1) - 4 * j)) / 4, 3) END AS q FROM j)
SELECT domain, CAST(max(n) AS INT) AS products, max(q) FILTER (WHERE i = 1) AS q1, max(q) FILTER (WHERE i = 2) AS q2, max(q) FILTER (WHERE i = 3) AS q3 FROM q GROUP BY domain""")
def knit_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusive price quartiles of each store's knit products."""
    return _quartiles(listings(spark, sf_dir).where("knit_kind <> ''"))


@query(f"WITH {LISTINGS_SQL} SELECT product_type, median(price) AS median_price, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM listings GROUP BY product_type")
def median_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and inclusive quartiles of prices by type."""
    p = lambda x: F.percentile("price", F.lit(x))
    return listings(spark, sf_dir).groupBy("product_type").agg(p(0.5).alias("median_price"), p(0.25).alias("q1"), p(0.75).alias("q3"))


@query(f"WITH {LISTINGS_SQL} SELECT domain, round(avg(CASE WHEN lines > 1 THEN CAST(on_sale AS INT) END), 6) AS on_sale_share FROM listings GROUP BY domain")
def share_tristate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of products on sale among those of which it is known; null if it is of none."""
    return listings(spark, sf_dir).groupBy("domain").agg(F.round(F.avg(F.when(F.col("lines") > 1, F.col("on_sale").cast("int"))), 6).alias("on_sale_share"))


@query(f"""WITH {LISTINGS_SQL}, n AS (SELECT domain, vendor, count(*) AS n, min(listing_id) AS first FROM listings GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, first) AS k FROM n)
SELECT domain, string_agg(vendor, ', ' ORDER BY k) AS top_vendors FROM r WHERE k <= 3 GROUP BY domain""")
def topk_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each store's three most frequent vendors; the first seen wins ties."""
    n = listings(spark, sf_dir).groupBy("domain", "vendor").agg(F.count("*").alias("n"), F.min("listing_id").alias("first"))
    k = n.withColumn("k", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("n"), "first"))).where("k <= 3")
    return k.groupBy("domain").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "vendor"))), lambda x: x["vendor"]), ", ").alias("top_vendors"))


@query(f"WITH {LISTINGS_SQL}, s AS (SELECT domain, min(listing_id) AS first, title FROM listings GROUP BY domain, title), r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY first) AS k FROM s) SELECT domain, string_agg(title, '; ' ORDER BY k) AS titles FROM r WHERE k <= 5 GROUP BY domain")
def bounded_distinct_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five distinct titles of each store, in order of first sight."""
    s = listings(spark, sf_dir).groupBy("domain", "title").agg(F.min("listing_id").alias("first"))
    k = s.withColumn("k", F.row_number().over(Window.partitionBy("domain").orderBy("first"))).where("k <= 5")
    return k.groupBy("domain").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "title"))), lambda x: x["title"]), "; ").alias("titles"))


@query(f"""WITH {LISTINGS_SQL}, {STORES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY listing_id) AS k FROM listings WHERE knit_kind <> ''),
e AS (SELECT domain, string_agg(title, '; ' ORDER BY k) AS examples FROM r WHERE k <= 5 GROUP BY domain), n AS (SELECT domain, count(*) AS products, count(*) FILTER (WHERE knit_kind <> '') AS knit FROM listings GROUP BY domain)
SELECT s.domain AS domain, CASE WHEN products IS NULL THEN '' ELSE CAST(CAST(round_even(100 * knit / products, 0) AS INT) AS VARCHAR) || '%' END AS knit_share, coalesce(examples, '') AS examples FROM stores s LEFT JOIN n ON n.domain = s.domain LEFT JOIN e ON e.domain = s.domain""")
def knit_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each store's share of knitwear as a percentage, halves to the even one, empty without products, and its first five knit products. Only five rows of a store are kept in each task."""
    l = listings(spark, sf_dir)  # noqa: E741
    n = l.groupBy("domain").agg(F.count("*").alias("products"), F.count_if(F.col("knit_kind") != "").alias("knit"))
    first = l.where("knit_kind <> ''").withColumn("k", F.row_number().over(Window.partitionBy("domain").orderBy("listing_id"))).where("k <= 5")
    e = first.groupBy("domain").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "title"))), lambda x: x["title"]), "; ").alias("examples"))
    share = F.concat(F.bround(100 * F.col("knit") / F.col("products")).cast("int").cast("string"), F.lit("%"))
    return stores(spark, sf_dir).select("domain").join(n, "domain", "left").join(e, "domain", "left").select("domain", F.coalesce(share, F.lit("")).alias("knit_share"), F.coalesce("examples", F.lit("")).alias("examples"))


@query(f"WITH {LISTINGS_SQL} SELECT title, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM listings GROUP BY title")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency and share of each title."""
    n = listings(spark, sf_dir).groupBy("title").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # one row a title


@query(f"WITH {LISTINGS_SQL} SELECT count(*) AS products, round(avg(CAST(knit_kind <> '' AS INT)), 6) AS knit_kind, round(avg(CAST(title LIKE '%e%' AS INT)), 6) AS title_e, round(avg(CAST(price > 950 AS INT)), 6) AS price FROM listings")
def fill_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of products with each field filled, in one pass."""
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    return listings(spark, sf_dir).agg(F.count("*").alias("products"), rate(F.col("knit_kind") != "").alias("knit_kind"), rate(F.col("title").contains("e")).alias("title_e"), rate(F.col("price") > 950).alias("price"))


@query(f"WITH {LISTINGS_SQL} SELECT knit_kind, count(*) AS n, round(avg(price), 4) AS mean, round(stddev_samp(price), 4) AS std, min(price) AS least, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS q2, quantile_cont(price, 0.75) AS q3, max(price) AS greatest FROM listings GROUP BY knit_kind")
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, mean, deviation, extremes and inclusive quartiles of prices by kind."""
    l = listings(spark, sf_dir).select("knit_kind", "price")  # noqa: E741
    plain = l.groupBy("knit_kind").agg(F.count("*").alias("n"), F.round(F.avg("price"), 4).alias("mean"), F.round(F.stddev("price"), 4).alias("std"), F.min("price").alias("least"), F.max("price").alias("greatest"))
    places = ranked(l, ["knit_kind"], "price").groupBy("knit_kind").agg(*(quantile("price", i / 4).alias(f"q{i}") for i in (1, 2, 3)))
    return plain.join(places, "knit_kind").select("knit_kind", "n", "mean", "std", "least", "q1", "q2", "q3", "greatest")


@query(f"WITH {LISTINGS_SQL} SELECT CAST(least(floor((price - 900) / 2.5), 39) AS BIGINT) AS bin, count(*) AS n FROM listings GROUP BY 1")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty price bins of equal width, the last one open."""
    return listings(spark, sf_dir).groupBy(F.least(F.floor((F.col("price") - 900) / 2.5), F.lit(39)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query(f"WITH {LISTINGS_SQL} SELECT product_type, CAST(count(*) FILTER (WHERE knit_kind = 'garment') AS BIGINT) AS garment, CAST(count(*) FILTER (WHERE knit_kind = 'accessory') AS BIGINT) AS accessory, CAST(count(*) FILTER (WHERE knit_kind = '') AS BIGINT) AS other FROM listings GROUP BY product_type")
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products by type and kind, with the kinds stated, so that no pass finds them."""
    wide = listings(spark, sf_dir).groupBy("product_type").pivot("knit_kind", ["garment", "accessory", ""]).count().fillna(0)
    return wide.toDF("product_type", "garment", "accessory", "other")


@query(f"WITH {_COUNTS_SQL} SELECT 'found' AS stage, count(*) AS stores, 1 AS step FROM stores UNION ALL SELECT 'read', count(*), 2 FROM stores WHERE status = 'ok' UNION ALL SELECT 'many_brands', count(*), 3 FROM stores WHERE status = 'ok' AND store_type = 'multi_brand' UNION ALL SELECT 'final', count(*), 4 FROM stores s JOIN counts c ON c.domain = s.domain WHERE status = 'ok' AND store_type = 'multi_brand' AND knit > 0")
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores left after each stage, counted in one pass and unpivoted."""
    ok, many = F.col("status") == "ok", F.col("store_type") == "multi_brand"
    one = _counted(spark, sf_dir).agg(F.count("*").alias("found"), F.count_if(ok).alias("read"), F.count_if(ok & many).alias("many_brands"), F.count_if(qualifies()).alias("final"))
    return one.selectExpr("stack(4, 'found', found, 1, 'read', read, 2, 'many_brands', many_brands, 3, 'final', final, 4) AS (stage, stores, step)")


@query(f"WITH {LISTINGS_SQL}, n AS (SELECT domain, count(DISTINCT vendor) AS v FROM listings GROUP BY domain) SELECT CASE WHEN v <= 1 THEN '1' WHEN v <= 2 THEN '2' WHEN v <= 4 THEN '3-4' ELSE '5+' END AS bucket, count(*) AS stores FROM n GROUP BY 1")
def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores by how many vendors they have."""
    v = listings(spark, sf_dir).groupBy("domain").agg(F.countDistinct("vendor").alias("v"))
    return v.groupBy(F.when(F.col("v") <= 1, "1").when(F.col("v") <= 2, "2").when(F.col("v") <= 4, "3-4").otherwise("5+").alias("bucket")).agg(F.count("*").alias("stores"))


@query(f"WITH {LISTINGS_SQL} SELECT domain, listing_id, CASE WHEN price BETWEEN 905 AND 985 THEN price END AS price_usd FROM listings")
def price_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing with its price, where that is in the permitted window."""
    return price_usd(spark, sf_dir)


@query(f"WITH {LISTINGS_SQL} SELECT domain, listing_id, CASE WHEN price BETWEEN 905 AND 985 THEN price END AS price_usd FROM listings")
def price_usd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing's price; prices outside the permitted window are unknown."""
    return listings(spark, sf_dir).select("domain", "listing_id", F.when(F.col("price").between(*RULES.price_window), F.col("price")).alias("price_usd"))


_SCORE_SQL = f"""{LISTINGS_SQL}, {STORES_SQL},
m AS (SELECT domain, count(*) AS products, count(*) FILTER (WHERE knit_kind = 'garment' AND price > 950) AS knit, count(DISTINCT vendor) FILTER (WHERE vendor IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4') AND price > 985) AS peers, count(DISTINCT vendor) FILTER (WHERE vendor IN ('Brand#20', 'Brand#21') AND price > 990) AS rivals, median(price) AS median_price, max(launched) AS launched FROM listings GROUP BY domain),
f AS (SELECT s.domain AS domain, status, store_type, coalesce(products, 0) AS products, coalesce(knit, 0) AS knit, coalesce(peers, 0) AS peers, coalesce(rivals, 0) AS rivals, round(median_price / 945, 2) AS ratio, launched FROM stores s LEFT JOIN m ON m.domain = s.domain),
g AS (SELECT *, CASE WHEN status <> 'ok' THEN 'not_read' WHEN knit = 0 THEN 'not_a_fit' WHEN store_type = 'own_brand' THEN 'competitor' WHEN rivals > 1 THEN 'check' WHEN store_type = 'multi_brand' THEN 'retail_partner' ELSE 'unknown' END AS segment,
  round(least(knit, 50) / 50 * 25) AS k, least(peers * 10, 25) AS p, CASE WHEN ratio IS NULL THEN 15 WHEN ratio < 0.98 OR ratio > 1.05 THEN 0 ELSE 20 END AS f, CASE WHEN products >= 530 THEN 10 WHEN products >= 500 THEN 5 ELSE 0 END AS b, CASE WHEN launched >= TIMESTAMP '2001-10-01' THEN 5 ELSE 0 END AS r FROM f)"""


@query(f"WITH {_SCORE_SQL} SELECT domain, segment, CAST(greatest(0, least(100, k + p + f + b + r - 20 * rivals)) AS BIGINT) AS score, concat_ws('; ', CASE WHEN k > 0 THEN 'knit +' || CAST(CAST(k AS BIGINT) AS VARCHAR) END, CASE WHEN p > 0 THEN 'peers +' || CAST(p AS VARCHAR) END, CASE WHEN f > 0 THEN 'price +' || CAST(f AS VARCHAR) END, CASE WHEN b > 0 THEN 'range +' || CAST(b AS VARCHAR) END, CASE WHEN r > 0 THEN 'recent +5' END, CASE WHEN rivals > 0 THEN 'rivals -' || CAST(20 * rivals AS VARCHAR) END) AS reasons FROM g")
def segments_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each store's segment, its score from 0 to 100, and the reasons in rule order."""
    l = listings(spark, sf_dir)  # noqa: E741
    price, vendor = F.col("price"), F.col("vendor")
    named = lambda keys: ["Brand#" + k.removeprefix("brand") for k in keys]
    m = l.groupBy("domain").agg(
        F.count("*").alias("products"), F.count_if((F.col("knit_kind") == "garment") & (price > 950)).alias("knit"), F.countDistinct(F.when(vendor.isin(named(RULES.peers)) & (price > 985), vendor)).alias("peers"),
        F.countDistinct(F.when(vendor.isin(named(RULES.competitors)) & (price > 990), vendor)).alias("rivals"), F.percentile("price", F.lit(0.5)).alias("median_price"), F.max("launched").alias("launched"))
    f = stores(spark, sf_dir).join(m, "domain", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("products", "knit", "peers", "rivals")}).withColumn("ratio", F.round(F.col("median_price") / 945, 2))
    segment = F.when(F.col("status") != "ok", "not_read").when(F.col("knit") == 0, "not_a_fit").when(F.col("store_type") == "own_brand", "competitor").when(F.col("rivals") > 1, "check").when(F.col("store_type") == "multi_brand", "retail_partner").otherwise("unknown")
    points = {
        "knit": F.round(F.least("knit", F.lit(50)) / 50 * 25).cast("long"), "peers": F.least(F.col("peers") * 10, F.lit(25)), "price": F.when(F.col("ratio").isNull(), 15).when(~F.col("ratio").between(0.98, 1.05), 0).otherwise(20),
        "range": F.when(F.col("products") >= 530, 10).when(F.col("products") >= 500, 5).otherwise(0), "recent": F.when(F.col("launched") >= F.lit("2001-10-01").cast("timestamp"), 5).otherwise(0),
    }
    rivals = 20 * F.col("rivals")
    score = F.greatest(F.lit(0), F.least(F.lit(100), sum(points.values(), F.lit(0)) - rivals)).cast("long")
    why = [F.when(v > 0, F.concat(F.lit(f"{k} +"), v.cast("string"))) for k, v in points.items()] + [F.when(rivals > 0, F.concat(F.lit("rivals -"), rivals.cast("string")))]
    return f.select("domain", segment.alias("segment"), score.alias("score"), F.array_join(F.array_compact(F.array(*why)), "; ").alias("reasons"))


@query("WITH d AS (SELECT doc_id, source, length(text) > 1000 AS yes FROM documents), j AS (SELECT source, yes, quality = 1 AS good FROM d JOIN labels ON labels.doc_id = d.doc_id) SELECT source, count(*) AS judged, round(count(*) FILTER (WHERE yes AND good) / nullif(count(*) FILTER (WHERE yes), 0), 4) AS precision, round(count(*) FILTER (WHERE yes AND good) / nullif(count(*) FILTER (WHERE good), 0), 4) AS recall FROM j GROUP BY source")
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of a length rule against judged documents, by source; null where nothing is counted."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", (F.char_length("text") > 1000).alias("yes"))
    j = d.join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good")), "doc_id")
    hit = F.count_if(F.col("yes") & F.col("good"))
    return j.groupBy("source").agg(F.count("*").alias("judged"), ratio(hit, F.count_if("yes")).alias("precision"), ratio(hit, F.count_if("good")).alias("recall"))
