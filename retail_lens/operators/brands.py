"""The brand-store graph: facts of brands, co-occurrence, lift, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import BASKETS_SQL, LISTINGS_SQL, RULES, STORES_SQL, baskets, listings, stores, table
from ..ranks import percentile_ranks, quantile, ranked
from ..registry import query
from ..scratch import saved
from .similarity import tfidf

# Stores and products from which a brand can be judged.
ENOUGH_STORES, ENOUGH_PRODUCTS = 8, 30
#: Domains that a brand's row lists.
DOMAINS_KEPT = 25

_PAIRS_SQL = f"""{BASKETS_SQL},
sizes AS (SELECT brand_key, count(*) AS n FROM baskets GROUP BY brand_key),
pairs AS (SELECT a.brand_key AS a, b.brand_key AS b, count(*) AS shared FROM baskets a JOIN baskets b ON a.store = b.store AND a.brand_key < b.brand_key GROUP BY ALL)"""


def pair_counts(edges: DataFrame) -> DataFrame:
    """(a, b, shared, n_a, n_b): stores that carry both brands. A store's brands pair up inside its own row, so edges shuffle once."""
    carried = edges.groupBy("store").agg(F.sort_array(F.collect_set("brand_key")).alias("brands"))
    one = carried.select("brands", F.posexplode("brands").alias("i", "a"))
    shared = one.select("a", F.explode(F.slice("brands", F.col("i") + 2, F.size("brands"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("shared"))
    n = edges.groupBy("brand_key").agg(F.count("*").alias("n"))
    return shared.join(n.select(F.col("brand_key").alias("a"), F.col("n").alias("n_a")), "a").join(n.select(F.col("brand_key").alias("b"), F.col("n").alias("n_b")), "b")


@query(f"WITH {_PAIRS_SQL} SELECT a, b, shared FROM pairs")
def brand_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores that two brands share."""
    return pair_counts(baskets(spark, sf_dir)).select("a", "b", "shared")


@query(f"WITH {_PAIRS_SQL} SELECT p.a AS a, p.b AS b, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM pairs p JOIN sizes x ON x.brand_key = p.a JOIN sizes y ON y.brand_key = p.b")
def brand_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared stores over all stores of two brands."""
    p = pair_counts(baskets(spark, sf_dir))
    return p.select("a", "b", F.round(F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")), 6).alias("jaccard"))


@query(f"WITH {_PAIRS_SQL} SELECT p.a AS a, p.b AS b, shared, round(shared * (SELECT count(DISTINCT store) FROM baskets) / (CAST(x.n AS DOUBLE) * y.n), 6) AS lift FROM pairs p JOIN sizes x ON x.brand_key = p.a JOIN sizes y ON y.brand_key = p.b WHERE shared >= 5")
def brand_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lift of brand pairs over the stores of the graph, from the least support on."""
    edges = baskets(spark, sf_dir)
    total = edges.agg(F.countDistinct("store").alias("total"))
    p = pair_counts(edges).where(F.col("shared") >= RULES.min_support).crossJoin(F.broadcast(total))  # one row
    return p.select("a", "b", "shared", F.round(F.col("shared") * F.col("total") / (F.col("n_a").cast("double") * F.col("n_b")), 6).alias("lift"))


def brand_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = listings(spark, sf_dir).withColumn("brand_key", F.regexp_replace(F.lower("vendor"), "[^a-z0-9]+", ""))  # noqa: E741
    per = l.groupBy("brand_key", "domain").agg(F.count("*").alias("n"), F.count_if(F.col("knit_kind") != "").alias("knit"), F.sum("price").alias("total"))
    return per.groupBy("brand_key").agg(F.count("*").alias("stores"), F.sum("n").alias("products"), F.sum("knit").alias("knit_products"), F.round(F.sum("total") / F.sum("n"), 2).alias("mean_price"))


_FACT_SQL = f"{LISTINGS_SQL}, facts AS (SELECT regexp_replace(lower(vendor), '[^a-z0-9]+', '', 'g') AS brand_key, count(DISTINCT domain) AS stores, count(*) AS products, count(*) FILTER (WHERE knit_kind <> '') AS knit_products, round(sum(price) / count(*), 2) AS mean_price FROM listings GROUP BY 1)"


@query(f"WITH {_FACT_SQL} SELECT brand_key, stores, products, CAST(knit_products AS BIGINT) AS knit_products, mean_price FROM facts")
def brand_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores, products, knit products and mean price of each brand, by two levels of aggregation."""
    return brand_facts(spark, sf_dir)


@query(f"WITH {LISTINGS_SQL}, d AS (SELECT DISTINCT regexp_replace(lower(vendor), '[^a-z0-9]+', '', 'g') AS brand_key, domain FROM listings), r AS (SELECT *, row_number() OVER (PARTITION BY brand_key ORDER BY domain) AS k, count(*) OVER (PARTITION BY brand_key) AS stores FROM d) SELECT brand_key, any_value(stores) AS stores, string_agg(domain, ', ' ORDER BY domain) AS store_domains FROM r WHERE k <= 25 GROUP BY brand_key")
def brand_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 domains of each brand, and how many it has. A brand's first ones are kept in each task before they meet, so no task ranks all stores of one."""
    d = listings(spark, sf_dir).select(F.regexp_replace(F.lower("vendor"), "[^a-z0-9]+", "").alias("brand_key"), "domain").distinct()
    first = d.withColumn("k", F.row_number().over(Window.partitionBy("brand_key").orderBy("domain"))).where(F.col("k") <= DOMAINS_KEPT)
    listed = first.groupBy("brand_key").agg(F.array_join(F.sort_array(F.collect_list("domain")), ", ").alias("store_domains"))
    return d.groupBy("brand_key").agg(F.count("*").alias("stores")).join(listed, "brand_key").select("brand_key", "stores", "store_domains")


@query(f"""
WITH {_FACT_SQL}, {_PAIRS_SQL},
home AS (SELECT CASE WHEN p.a = 'brand7' THEN p.b ELSE p.a END AS brand_key, shared / (x.n + y.n - shared) AS jaccard FROM pairs p JOIN sizes x ON x.brand_key = p.a JOIN sizes y ON y.brand_key = p.b WHERE p.a = 'brand7' OR p.b = 'brand7'),
j AS (SELECT f.brand_key AS brand_key, stores, products, jaccard, knit_products / products AS knit_share FROM facts f JOIN home ON home.brand_key = f.brand_key),
r AS (SELECT brand_key, stores, products, jaccard,
  (rank() OVER (ORDER BY jaccard) + (count(*) OVER (PARTITION BY jaccard) - 1) / 2) / count(*) OVER () AS r1,
  (rank() OVER (ORDER BY products) + (count(*) OVER (PARTITION BY products) - 1) / 2) / count(*) OVER () AS r2,
  (rank() OVER (ORDER BY knit_share) + (count(*) OVER (PARTITION BY knit_share) - 1) / 2) / count(*) OVER () AS r3 FROM j)
SELECT brand_key, stores, products, round(jaccard, 6) AS jaccard, round((r1 + r2 + r3) / 3, 6) AS score FROM r ORDER BY (r1 + r2 + r3) DESC, brand_key LIMIT 20""")
def brand_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands that stand nearest to the home brand: the mean of three percentile ranks, best twenty."""
    home = F.lit(RULES.home_brand)
    p = pair_counts(baskets(spark, sf_dir)).where((F.col("a") == home) | (F.col("b") == home))
    near = p.select(F.when(F.col("a") == home, F.col("b")).otherwise(F.col("a")).alias("brand_key"), (F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("jaccard"))
    j = brand_facts(spark, sf_dir).join(near, "brand_key").withColumn("knit_share", F.col("knit_products") / F.col("products"))
    names = ["jaccard", "products", "knit_share"]
    ranks = percentile_ranks(j.select("brand_key", *(F.col(c).cast("double").alias(c) for c in names)), "brand_key", names)
    total = sum((F.col(f"rank_{c}") for c in names), F.lit(0.0))
    ranked = j.join(ranks, "brand_key").orderBy(total.desc(), "brand_key").limit(20)
    return ranked.select("brand_key", "stores", "products", F.round("jaccard", 6).alias("jaccard"), F.round(total / 3, 6).alias("score"))


_SCORE_SQL = f"""{LISTINGS_SQL}, {STORES_SQL},
l AS (SELECT l.*, regexp_replace(lower(vendor), '[^a-z0-9]+', '', 'g') AS brand_key, store_type = 'multi_brand' AND status = 'ok' AS customer FROM listings l JOIN stores s ON s.domain = l.domain),
f AS (SELECT brand_key, count(DISTINCT domain) AS stores, count(*) AS products, count(*) FILTER (WHERE knit_kind <> '') / count(*) AS knit_share, count(DISTINCT domain) FILTER (WHERE customer) / count(DISTINCT domain) AS customer_share, median(price) FILTER (WHERE knit_kind <> '') AS price FROM l GROUP BY brand_key),
d AS (SELECT p_brand, string_agg(p_name || ' ' || lower(p_type), ' ' ORDER BY p_partkey) AS text FROM part GROUP BY p_brand),
w AS (SELECT p_brand, regexp_extract_all(lower(text), '\\b\\w\\w+\\b') AS w FROM d),
t AS (SELECT p_brand, unnest(w) AS term FROM w UNION ALL SELECT p_brand, w[i] || ' ' || w[i + 1] FROM (SELECT p_brand, w, unnest(range(1, len(w))) AS i FROM w)),
tf AS (SELECT p_brand, term, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2),
x AS (SELECT p_brand, tf.term AS term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM d)) / (1 + df)) + 1) AS w FROM tf JOIN df ON df.term = tf.term),
m AS (SELECT p_brand, sqrt(sum(w * w)) AS norm FROM x GROUP BY 1), v AS (SELECT x.p_brand AS p_brand, term, w / norm AS w FROM x JOIN m ON m.p_brand = x.p_brand),
c AS (SELECT regexp_replace(lower(a.p_brand), '[^a-z0-9]+', '', 'g') AS brand_key, round(sum(a.w * b.w), 3) AS text_similarity FROM v a JOIN v b ON b.term = a.term AND b.p_brand = 'Brand#7' WHERE a.p_brand <> 'Brand#7' GROUP BY 1),
j AS (SELECT f.brand_key AS brand_key, stores, products, round(knit_share, 3) AS knit_share, round(customer_share, 3) AS customer_share, round(price / (SELECT price FROM f WHERE brand_key = 'brand7'), 2) AS price_position, text_similarity FROM f LEFT JOIN c ON c.brand_key = f.brand_key WHERE f.brand_key <> 'brand7' AND stores >= 8 AND products >= 30),
k AS (SELECT *, -abs(ln(CASE WHEN price_position > 0 THEN price_position END)) AS closeness FROM j),
r AS (SELECT *, {', '.join(f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (ORDER BY {c} NULLS LAST) + (count({c}) OVER (PARTITION BY {c}) - 1) / 2) / count({c}) OVER () END AS r{i}" for i, c in enumerate(('knit_share', 'stores', 'customer_share', 'closeness', 'text_similarity')))} FROM k)"""


@query(f"WITH {_SCORE_SQL} SELECT brand_key, stores, knit_share, customer_share, price_position, text_similarity, round(list_avg(list_filter([r0, r1, r2, r3, r4], lambda x: x IS NOT NULL)), 3) AS rank_score FROM r")
def brand_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands with enough data by the mean of five percentile ranks: share of knitwear, stores, share of customers among them, closeness of price and of text to the home brand. What is unknown does not count."""
    kept = stores(spark, sf_dir).select("domain", ((F.col("store_type") == "multi_brand") & (F.col("status") == "ok")).alias("customer"))
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "").alias("brand_key")
    l = listings(spark, sf_dir).join(kept, "domain").withColumn("brand_key", key("vendor"))  # noqa: E741
    per = l.groupBy("brand_key", "domain", "customer").agg(F.count("*").alias("n"), F.count_if(F.col("knit_kind") != "").alias("knit"))
    f = per.groupBy("brand_key").agg(F.count("*").alias("stores"), F.sum("n").alias("products"), (F.sum("knit") / F.sum("n")).alias("knit_share"), F.avg(F.col("customer").cast("int")).alias("customer_share"))
    price = ranked(l.where("knit_kind <> ''"), ["brand_key"], "price").groupBy("brand_key").agg(quantile("price", 0.5).alias("price"))
    home = price.where(F.col("brand_key") == RULES.home_brand).select(F.col("price").alias("home"))
    part = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.concat_ws(" ", "p_name", F.lower("p_type")).alias("text"))
    v = tfidf(part, "p_brand", "p_partkey", "text").withColumn("brand_key", key("p_brand"))
    near = v.join(v.where(F.col("brand_key") == RULES.home_brand).select("term", F.col("weight").alias("w")), "term").groupBy("brand_key").agg(F.round(F.sum(F.col("weight") * F.col("w")), 3).alias("text_similarity"))
    j = f.where((F.col("brand_key") != RULES.home_brand) & (F.col("stores") >= ENOUGH_STORES) & (F.col("products") >= ENOUGH_PRODUCTS)).join(price, "brand_key", "left").crossJoin(F.broadcast(home)).join(near, "brand_key", "left")  # one row
    j = j.withColumns({"knit_share": F.round("knit_share", 3), "customer_share": F.round("customer_share", 3), "price_position": F.round(F.col("price") / F.col("home"), 2)})
    j = saved(j.withColumn("closeness", -F.abs(F.log(F.when(F.col("price_position") > 0, F.col("price_position"))))), "brands")
    names = ["knit_share", "stores", "customer_share", "closeness", "text_similarity"]
    ranks = percentile_ranks(j.select("brand_key", *(F.col(c).cast("double").alias(c) for c in names)), "brand_key", names)
    known = F.array_compact(F.array(*(F.col(f"rank_{c}") for c in names)))
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)
    return j.join(ranks, "brand_key").select("brand_key", "stores", "knit_share", "customer_share", "price_position", "text_similarity", F.round(mean, 3).alias("rank_score"))


@query("""
WITH raw AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_brand) WHEN p_partkey % 5 = 0 THEN replace(p_brand, '#', ' ') ELSE p_brand END AS vendor FROM part),
n AS (SELECT regexp_replace(lower(vendor), '[^a-z0-9]+', '', 'g') AS brand_key, vendor, count(*) AS n, min(p_partkey) AS first FROM raw GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY brand_key ORDER BY n DESC, first) AS k, count(*) OVER (PARTITION BY brand_key) AS spellings FROM n)
SELECT brand_key, vendor AS spelling, n, spellings FROM r WHERE k = 1""")
def mode_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent spelling of each brand; the first seen wins ties. Counts are combined before the shuffle."""
    key, brand = F.col("p_partkey"), F.col("p_brand")
    vendor = F.when(key % 3 == 0, F.upper(brand)).when(key % 5 == 0, F.replace(brand, F.lit("#"), F.lit(" "))).otherwise(brand)
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", vendor.alias("vendor"))
    n = part.groupBy(F.regexp_replace(F.lower("vendor"), "[^a-z0-9]+", "").alias("brand_key"), "vendor").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))
    return n.groupBy("brand_key").agg(F.min_by("vendor", F.struct(-F.col("n"), "first")).alias("spelling"), F.max("n").alias("n"), F.count("*").alias("spellings"))


@query(f"""
WITH {LISTINGS_SQL}, k AS (SELECT vendor, product_type = 'LARGE' AS category, CASE WHEN title LIKE 'small%' THEN NULL ELSE title LIKE 'red%' END AS material, CASE WHEN price BETWEEN 905 AND 985 THEN price <= 950 END AS band FROM listings),
y AS (SELECT vendor, CAST(category AS INT) + coalesce(CAST(material AS INT), 0) + coalesce(CAST(band AS INT), 0) AS yes, 1 + CAST(material IS NOT NULL AS INT) + CAST(band IS NOT NULL AS INT) AS known FROM k)
SELECT vendor, count(*) AS products, CAST(sum(CAST(known >= 2 AND yes = known AS INT)) AS BIGINT) AS relevant, round(avg(CASE WHEN known >= 2 THEN CAST(yes = known AS INT) END), 6) AS share FROM y GROUP BY vendor""")
def tri_state_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance by three tests of which any may be unknown: a product counts if at least two are known and all known ones hold."""
    l = listings(spark, sf_dir)  # noqa: E741
    price = F.when(F.col("price").between(*RULES.price_window), F.col("price"))
    tests = [F.col("product_type") == "LARGE", F.when(~F.col("title").startswith("small"), F.col("title").startswith("red")), price <= 950]
    known = sum((t.isNotNull().cast("int") for t in tests), F.lit(0))
    yes = sum((F.coalesce(t.cast("int"), F.lit(0)) for t in tests), F.lit(0))
    t = l.select("vendor", known.alias("known"), (yes == known).alias("all"))
    return t.groupBy("vendor").agg(F.count("*").alias("products"), F.count_if((F.col("known") >= 2) & F.col("all")).alias("relevant"), F.round(F.avg(F.when(F.col("known") >= 2, F.col("all").cast("int"))), 6).alias("share"))


@query(f"""
WITH {STORES_SQL}, c AS (SELECT n_name AS state, count(*) AS stockists FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = 'FURNITURE' GROUP BY 1),
s AS (SELECT state, count(*) AS opportunities, count(*) FILTER (WHERE store_type = 'multi_brand') AS open_territory FROM stores GROUP BY 1)
SELECT s.state AS state, opportunities, CAST(open_territory AS BIGINT) AS open_territory, CAST(coalesce(stockists, 0) AS BIGINT) AS stockists, opportunities - coalesce(stockists, 0) AS gap FROM s LEFT JOIN c ON c.state = s.state""")
def regions_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opportunities and stockists of each state, and the gap between them."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_mktsegment = 'FURNITURE'").groupBy("c_nationkey").agg(F.count("*").alias("stockists"))
    c = nation.join(customer, F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("n_name").alias("state")).agg(F.sum("stockists").alias("stockists"))
    s = stores(spark, sf_dir).groupBy("state").agg(F.count("*").alias("opportunities"), F.count_if(F.col("store_type") == "multi_brand").alias("open_territory"))
    n = F.coalesce("stockists", F.lit(0))
    return s.join(c, "state", "left").select("state", "opportunities", "open_territory", n.alias("stockists"), (F.col("opportunities") - n).alias("gap"))
