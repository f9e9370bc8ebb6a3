"""Runs and their tables: joins of visits, contacts and discoveries, run statistics, detection, batches and serving lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import BASKETS_SQL, LISTINGS_SQL, RULES, STORES_SQL, baskets, listings, stores, table
from ..functions import business, place, text
from ..registry import cases, fixture, query

c = F.col
#: Rows of a batch, and keys that one task numbers at a time.
BATCH, SPAN = 5000, 100_000
PAGE_ORDER = ("contact", "about", "home", "stockist", "other")
_EVENTS = "SELECT event_id, user_id, ts, event_type, CAST(ts AS DATE) AS run, value FROM events"


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as visits: a day is a run, a user a store, an error a refusal."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", F.to_date("ts").alias("run"), "value")


@query("WITH n AS (SELECT user_id, count(*) AS contacts, min_by(event_type, event_id) AS first_kind FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY user_id) SELECT c_custkey, CAST(coalesce(contacts, 0) AS BIGINT) AS contacts, coalesce(first_kind, '') AS first_kind FROM customer LEFT JOIN n ON user_id = c_custkey")
def store_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's contacts, counted, and the first one's kind; filtered and aggregated before the join (J3, PF3, A30)."""
    n = table(spark, sf_dir, "events").where(c("event_type").isin("signup", "purchase")).groupBy(c("user_id").alias("c_custkey")).agg(F.count("*").alias("contacts"), F.min_by("event_type", "event_id").alias("first_kind"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("contacts", F.lit(0)).alias("contacts"), F.coalesce("first_kind", F.lit("")).alias("first_kind"))


@query(f"WITH {LISTINGS_SQL}, v AS (SELECT vendor, regexp_replace(lower(vendor), '[^a-z0-9]+', '', 'g') AS k, count(*) AS products FROM listings GROUP BY vendor) SELECT vendor, products, CASE WHEN k = 'brand7' THEN 'home' WHEN k IN ('brand1', 'brand2', 'brand3', 'brand4') THEN 'peer' WHEN k IN ('brand20', 'brand21') THEN 'competitor' ELSE '' END AS relation FROM v")
def brand_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each vendor is to the home brand, from a list of relations."""
    known = [(RULES.home_brand, "home"), *((b, "peer") for b in RULES.peers), *((b, "competitor") for b in RULES.competitors)]
    dim = spark.createDataFrame(known, "k string, relation string")
    v = listings(spark, sf_dir).groupBy("vendor").agg(F.count("*").alias("products")).withColumn("k", text.compact(c("vendor")))
    return v.join(F.broadcast(dim), "k", "left").select("vendor", "products", F.coalesce("relation", F.lit("")).alias("relation"))  # a fixed list


@query(f"WITH {STORES_SQL}, n AS (SELECT n_name AS state, count(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 9000 GROUP BY n_name) SELECT domain, CAST(coalesce(customers, 0) AS BIGINT) AS customers, customers IS NOT NULL AS served FROM stores LEFT JOIN n ON n.state = stores.state")
def customer_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores with the number of good customers in their state, 0 where there is none."""
    nation = table(spark, sf_dir, "nation").select(c("n_nationkey").alias("c_nationkey"), c("n_name").alias("state"))
    n = table(spark, sf_dir, "customer").where("c_acctbal > 9000").join(nation, "c_nationkey").groupBy("state").agg(F.count("*").alias("customers"))
    return stores(spark, sf_dir).join(n, "state", "left").select("domain", F.coalesce("customers", F.lit(0)).alias("customers"), c("customers").isNotNull().alias("served"))


_FOUND_SQL = """
f AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'shop' || CAST(p_partkey // 7 AS VARCHAR) || '.example.com' ELSE '' END AS domain, 'The Shop' || CAST(p_partkey % 90 AS VARCHAR) || ' Store' AS name, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'NATION_' || CAST(p_partkey % 25 AS VARCHAR) END AS state FROM part),
k AS (SELECT s_suppkey AS seq, 'shop' || CAST(s_suppkey AS VARCHAR) || '.example.com' AS domain, 'shop' || CAST(s_suppkey % 90 AS VARCHAR) AS core, n_name AS state FROM supplier JOIN nation ON n_nationkey = s_nationkey),
m AS (SELECT id, 1 AS tier, seq FROM f JOIN k ON k.domain = f.domain UNION ALL SELECT id, 2, seq FROM f JOIN k ON k.core = 'shop' || CAST(id % 90 AS VARCHAR) AND (f.state = '' OR f.state = k.state))"""


@query(f"WITH {_FOUND_SQL}, r AS (SELECT id, tier, seq, row_number() OVER (PARTITION BY id ORDER BY tier, seq) AS n FROM m) SELECT id, tier, seq FROM r WHERE n = 1")
def discovery_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found stores that are stockists: by domain, else by core name where the states agree or the found one is blank (J16). Each tier is a hash join reduced before the next."""
    key = c("p_partkey")
    f = table(spark, sf_dir, "part").select(key.alias("id"), F.when(key % 7 == 0, F.concat(F.lit("shop"), F.floor(key / 7).cast("string"), F.lit(".example.com"))).alias("domain"), text.core_name(F.concat(F.lit("The Shop"), (key % 90).cast("string"), F.lit(" Store"))).alias("core"), F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("NATION_"), (key % 25).cast("string"))).alias("state"))
    nation = table(spark, sf_dir, "nation").select(c("n_nationkey").alias("s_nationkey"), c("n_name").alias("state"))
    k = table(spark, sf_dir, "supplier").join(nation, "s_nationkey").select(c("s_suppkey").alias("seq"), F.concat(F.lit("shop"), c("s_suppkey").cast("string"), F.lit(".example.com")).alias("domain"), F.concat(F.lit("shop"), (c("s_suppkey") % 90).cast("string")).alias("core"), "state")
    by_name = k.groupBy("core", "state").agg(F.min("seq").alias("seq"))
    anywhere = by_name.groupBy("core").agg(F.min("seq").alias("seq"))
    tiers = [f.join(k.groupBy("domain").agg(F.min("seq").alias("seq")), "domain").select("id", F.lit(1).alias("tier"), "seq"), f.where("state <> ''").join(by_name, ["core", "state"]).select("id", F.lit(2).alias("tier"), "seq"), f.where("state = ''").join(anywhere, "core").select("id", F.lit(2).alias("tier"), "seq")]
    best = tiers[0].union(tiers[1]).union(tiers[2]).groupBy("id").agg(F.min(F.struct("tier", "seq")).alias("m"))
    return best.select("id", "m.tier", "m.seq")


cases("searched_countries", "country string", "kept boolean", [("United States", True), ("us", True), ("CA", True), ("", True), (None, True), ("France", False), ("Österreich", False)],
      lambda: {"kept": (F.coalesce(F.trim("country"), F.lit("")) == "") | place.infer_country(c("country"), F.lit(""), F.lit("")).isin("US", "CA")}, "Stockists of the countries searched; a blank country passes (J17).")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def resume_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that are not done yet."""
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(c("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(done, "p_partkey", "left_anti")


@query("WITH o AS (SELECT o_custkey, count(*) AS orders, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS order_keys FROM orders GROUP BY 1), e AS (SELECT user_id, count(*) AS visits, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY 1) SELECT c_custkey, CAST(coalesce(orders, 0) AS BIGINT) AS orders, coalesce(order_keys, '') AS order_keys, CAST(coalesce(visits, 0) AS BIGINT) AS visits, coalesce(kinds, '') AS kinds FROM customer LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN e ON user_id = c_custkey")
def reloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with what their tables hold of them, each table nested by itself before the join."""
    o = table(spark, sf_dir, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda k: k.cast("string")), ",").alias("order_keys"))
    e = table(spark, sf_dir, "events").groupBy(c("user_id").alias("c_custkey")).agg(F.count("*").alias("visits"), F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"))
    both = table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").join(e, "c_custkey", "left")
    return both.select("c_custkey", *(F.coalesce(n, F.lit(0 if n in ("orders", "visits") else "")).alias(n) for n in ("orders", "order_keys", "visits", "kinds")))


@query(f"WITH e AS ({_EVENTS}), runs AS (SELECT run FROM e GROUP BY run HAVING count(*) >= 2), l AS (SELECT user_id, max(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM e) WHERE k = 1 GROUP BY user_id) SELECT l.user_id AS user_id, l.event_id AS event_id FROM l JOIN e ON e.event_id = l.event_id WHERE run IN (SELECT run FROM runs)")
def latest_of_kept_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each store's latest visit, if its run is still there."""
    v = visits(spark, sf_dir)
    kept = v.groupBy("run").agg(F.count("*").alias("n")).where("n >= 2").select("run")
    last = v.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "run")).alias("m")).select("user_id", "m.event_id", "m.run")
    return last.join(kept, "run", "left_semi").select("user_id", "event_id")


_TABLES = ("customer", "documents", "events", "lineitem", "orders", "pages", "part", "supplier")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, '' AS part, count(*) AS n FROM {t}" for t in _TABLES) + " UNION ALL SELECT 'documents', coalesce(source, ''), count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'events', event_type, count(*) FROM events GROUP BY 2")
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table of a run, and of some by source or kind."""
    out = None
    for t in _TABLES:
        n = table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), F.lit("").alias("part"), "n")
        out = n if out is None else out.union(n)
    for t, by in (("documents", "source"), ("events", "event_type")):
        out = out.union(table(spark, sf_dir, t).groupBy(F.coalesce(by, F.lit("")).alias("part")).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "part", "n"))
    return out


@query(f"WITH e AS ({_EVENTS}), k AS (SELECT run, event_type, count(*) AS n FROM e GROUP BY 1, 2) SELECT CAST(e.run AS VARCHAR) AS run_id, count(*) AS visits, CAST(count(*) FILTER (WHERE event_type <> 'error') AS BIGINT) AS done, count(DISTINCT user_id) AS stores, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 4) AS cost, max(s.states) AS states FROM e JOIN (SELECT run, string_agg(event_type || '=' || CAST(n AS VARCHAR), ',' ORDER BY n DESC, event_type) AS states FROM k GROUP BY run) s ON s.run = e.run GROUP BY e.run")
def run_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a run: visits, those that went well, stores, cost, and the counts of each status, the most frequent first."""
    v = visits(spark, sf_dir)
    k = v.groupBy("run", "event_type").agg(F.count("*").alias("n")).groupBy("run").agg(F.sort_array(F.collect_list(F.struct((-c("n")).alias("o"), "event_type"))).alias("s"))
    states = k.select("run", F.array_join(F.transform("s", lambda x: F.concat(x["event_type"], F.lit("="), (-x["o"]).cast("string"))), ",").alias("states"))
    d = v.groupBy("run").agg(F.count("*").alias("visits"), F.count_if(c("event_type") != "error").alias("done"), F.countDistinct("user_id").alias("stores"), F.round(F.sum(F.when(c("event_type") == "purchase", c("value")).otherwise(0)), 4).alias("cost"))
    return d.join(states, "run").select(c("run").cast("string").alias("run_id"), "visits", "done", "stores", "cost", "states")


_ERROR = "CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'challenge page (cloudflare)' WHEN 1 THEN 'HTTP 403' WHEN 2 THEN 'HTTP 429 in the browser' ELSE 'timed out' END"


@query(f"WITH e AS (SELECT *, {_ERROR} AS error FROM events WHERE event_type = 'error'), m AS (SELECT CASE WHEN regexp_extract(error, 'challenge page \\((\\w+)\\)', 1) <> '' THEN regexp_extract(error, 'challenge page \\((\\w+)\\)', 1) WHEN regexp_extract(error, 'HTTP (\\d{{3}})', 1) <> '' THEN 'http_' || regexp_extract(error, 'HTTP (\\d{{3}})', 1) ELSE 'other' END AS method, user_id FROM e) SELECT method, count(*) AS blocked, count(DISTINCT user_id) AS stores FROM m GROUP BY method".replace("\\\\", "\\"))
def detection_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refused visits by the method that refused them."""
    k = (c("event_id") % 4).cast("int")
    error = F.when(k == 0, "challenge page (cloudflare)").when(k == 1, "HTTP 403").when(k == 2, "HTTP 429 in the browser").otherwise("timed out")
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select(business.block_method(error).alias("method"), "user_id")
    return e.groupBy("method").agg(F.count("*").alias("blocked"), F.countDistinct("user_id").alias("stores"))


@query(f"WITH e AS ({_EVENTS}), r AS (SELECT run, count(*) AS visits, count(*) FILTER (WHERE event_type = 'error') AS blocked FROM e GROUP BY run) SELECT CAST(run AS VARCHAR) AS run_id, visits, CAST(blocked AS BIGINT) AS blocked, round(blocked / visits, 4) AS share FROM r WHERE CAST(run AS VARCHAR) LIKE '%-1%'")
def run_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusals of the runs whose id holds the words searched for (A24, PF11)."""
    r = visits(spark, sf_dir).where(c("run").cast("string").contains("-1")).groupBy("run").agg(F.count("*").alias("visits"), F.count_if(c("event_type") == "error").alias("blocked"))
    return r.select(c("run").cast("string").alias("run_id"), "visits", "blocked", F.round(c("blocked") / c("visits"), 4).alias("share"))


@query("WITH k AS (SELECT o_custkey, o_orderpriority AS code, count(*) AS n, min(o_orderkey) AS first FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2) SELECT o_custkey, arg_min(code, (-n, first)) AS code, CAST(max(n) AS BIGINT) AS n FROM k GROUP BY o_custkey")
def majority_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent known code of each customer's orders, of equals the first seen."""
    k = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").groupBy("o_custkey", c("o_orderpriority").alias("code")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))
    return k.groupBy("o_custkey").agg(F.min_by("code", F.struct(-c("n"), "first")).alias("code"), F.max("n").alias("n"))


@query("SELECT doc_id, left(text, 600) AS text, coalesce(length(text) > 600, false) AS cut FROM documents")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a table shows them: the start of long texts, and whether more follows (PF4)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.left("text", F.lit(600)).alias("text"), F.coalesce(F.char_length("text") > 600, F.lit(False)).alias("cut"))


cases("csv_typed", "carries string, brands string", "carried boolean, n int, first string", [("True", '["Ann","Lee"]', True, 2, "Ann"), ("false", "[]", False, 0, None), ("", "broken", False, None, None), (None, None, False, None, None), ("TRUE", '["x"]', True, 1, "x")],
      lambda: {"carried": F.coalesce(F.lower("carries") == "true", F.lit(False)), "n": F.when(c("brands").startswith("["), F.size(F.from_json("brands", "array<string>"))), "first": F.get(F.from_json("brands", "array<string>"), F.lit(0))}, "Flags and lists of a CSV (PF5).")

cases("brand_kinds", "stores bigint, products bigint, relation string, wanted string", "enough boolean, shown boolean", [(8, 30, "peer", "watched", True, True), (7, 300, "competitor", "rival", False, True), (80, 29, "", "all", False, True), (9, 31, "", "watched", True, False), (9, 31, "competitor", "watched", True, False), (9, 31, "home", "marker", True, True)],
      lambda: {"enough": (c("stores") >= 8) & (c("products") >= 30), "shown": (c("wanted") == "all") | (c("wanted") == "watched") & (c("relation") == "peer") | (c("wanted") == "rival") & (c("relation") == "competitor") | (c("wanted") == "marker") & (c("relation") == "home")}, "Brands with enough data, and those that a filter shows (C16, PF10).")

cases("candidate_filter", "domain string, country string, closed boolean", "kept boolean", [("a.com", "US", False, True), ("a.com", "", None, True), ("a.com", "FR", False, False), ("b.com", "US", False, False), ("", "CA", True, False), ("", "CA", False, True)],
      lambda: {"kept": ~F.coalesce(c("closed"), F.lit(False)) & c("country").isin("", "US", "CA") & ~c("domain").isin("b.com")}, "Candidates that stay: open, in the countries, not excluded (PF13).")


def numbered(df: DataFrame, key: str) -> Column:
    """The position of each row from 0 by an integer ``key``: by the counts of earlier spans of keys, then within the span. Attach with ``with_numbers``."""
    return F.row_number().over(Window.partitionBy("_span").orderBy(key)) - 1 + F.coalesce(c("_before"), F.lit(0))


def with_batches(df: DataFrame, key: str, rows: int = BATCH) -> DataFrame:
    """``df`` with batch: rows in the order of an integer ``key``, so many a batch. No task orders more than a span of keys (T6s)."""
    df = df.withColumn("_span", F.floor(c(key) / SPAN))
    spans = df.groupBy("_span").agg(F.count("*").alias("n"))
    spans = spans.select("_span", F.sum("n").over(Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))  # one row a span
    return df.join(spans, "_span").withColumn("batch", F.floor(numbered(df, key) / rows)).drop("_span", "_before")


@query("WITH b AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 5000 AS batch FROM orders) SELECT CAST(batch AS BIGINT) AS batch, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM b GROUP BY batch")
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in batches as writers take them (T6s)."""
    return with_batches(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").groupBy("batch").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("WITH n AS (SELECT user_id, count(DISTINCT event_type) AS sources FROM events GROUP BY user_id) SELECT user_id, sources, row_number() OVER (ORDER BY sources DESC, user_id) AS place FROM n ORDER BY sources DESC, user_id LIMIT 50")
def stores_to_visit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty stores by how many sources agree on them; the limit is the feature (T7s)."""
    top = table(spark, sf_dir, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("sources")).orderBy(F.desc("sources"), "user_id").limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("sources"), "user_id")))  # over fifty rows


@query(f"WITH {LISTINGS_SQL}, {STORES_SQL}, g AS (SELECT s.state AS state, count(*) AS gap FROM stores s WHERE store_type <> 'own_brand' AND domain NOT IN (SELECT domain FROM listings WHERE vendor = 'Brand#7' AND price > 998) GROUP BY s.state) SELECT state, gap FROM g ORDER BY gap DESC, state LIMIT 10")
def widest_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten states with most stores that don't carry the home brand's dear products; the limit is the feature (T8s)."""
    has = listings(spark, sf_dir).where("vendor = 'Brand#7' and price > 998").select("domain").distinct()
    return stores(spark, sf_dir).where("store_type <> 'own_brand'").join(has, "domain", "left_anti").groupBy("state").agg(F.count("*").alias("gap")).orderBy(F.desc("gap"), "state").limit(10)


@query(f"WITH {BASKETS_SQL}, x AS (SELECT store, brand_key FROM baskets UNION SELECT o_orderkey, 'customer' FROM orders WHERE o_totalprice > 300000), n AS (SELECT count(*) AS n FROM x WHERE brand_key = 'customer'), p AS (SELECT b.brand_key AS brand_key, count(*) AS shared FROM x a JOIN x b ON a.store = b.store WHERE a.brand_key = 'customer' AND b.brand_key <> 'customer' GROUP BY 1), t AS (SELECT brand_key, count(*) AS stores FROM x GROUP BY 1) SELECT t.brand_key AS brand_key, CAST(coalesce(shared, 0) AS BIGINT) AS shared, round(coalesce(shared, 0) / (stores + (SELECT n FROM n) - coalesce(shared, 0)), 6) AS jaccard FROM t LEFT JOIN p ON p.brand_key = t.brand_key WHERE t.brand_key <> 'customer'")
def customer_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of each brand with the customers, who stand in the incidence as a brand of their own (ML5)."""
    who = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(c("o_orderkey").alias("store"))
    x = baskets(spark, sf_dir)
    per = x.join(who.withColumn("hit", F.lit(1)), "store", "left").groupBy("brand_key").agg(F.count("*").alias("stores"), F.count("hit").alias("shared"))
    n = who.agg(F.count("*").alias("n"))
    return per.crossJoin(F.broadcast(n)).select("brand_key", "shared", F.round(c("shared") / (c("stores") + c("n") - c("shared")), 6).alias("jaccard"))  # one row


fixture("site_addresses", "domain string, kind string, t string", [
    ("a.com", "contact", "12 Oak St, Naples, FL 34102"), ("a.com", "contact", "Visit 1 Main St, Naples, FL 34103. 1 Main St, Naples, FL 34103"), ("a.com", "home", "9 Elm Rd, Tampa, FL 33601"), ("b.com", "home", "Toronto, ON M5V 2T6"), ("b.com", "brands", "Miami, FL 33101"), ("c.com", "about", "none"),
], "domain string, street string, city string, state string, postal string, country string", [
    ("a.com", "1 Main St", "Naples", "FL", "34103", "United States"), ("b.com", "", "Toronto", "ON", "M5V 2T6", "Canada"),
], lambda df: _site_address(df), "The address that a store writes most often, contact page first (A33, X23).")


def _site_address(pages: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*(F.lit(k) for k in PAGE_ORDER)), c("kind"))
    found = pages.where(c("kind").isin(*PAGE_ORDER)).select("domain", rank.alias("rank"), F.posexplode(place.addresses(c("t"))).alias("pos", "a"))
    counted = found.groupBy("domain", "rank", "a").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = counted.groupBy("domain").agg(F.min_by("a", F.struct("rank", -c("n"), "first", "a")).alias("a"))
    return best.select("domain", "a.*", F.when(c("a.state").isin(*place.CA_PROVINCES), "Canada").otherwise("United States").alias("country"))


fixture("contacts_of_pages", "domain string, pos int, url string, html string", [
    ("a.com", 0, "https://a.com", '<a href="mailto:hi@a.com">x</a> HI@A.com <a href="https://instagram.com/a">i</a>'), ("a.com", 1, "https://a.com/contact", "hi@a.com sales@a.com (239) 555-0101 " + " ".join(f"m{i}@a.com" for i in range(30))), ("b.com", 0, "https://b.com", "none"),
], "domain string, type string, n bigint, first string, seen_on string", [("a.com", "email", 20, "hi@a.com", "https://a.com"), ("a.com", "phone", 1, "(239) 555-0101", "https://a.com/contact"), ("a.com", "instagram", 1, "https://instagram.com/a", "https://a.com")],
    lambda df: _contacts(df).groupBy("domain", "type").agg(F.count("*").alias("n"), F.min_by("value", "at").alias("first"), F.min_by("url", "at").alias("seen_on")), "Contacts of a store's pages, each on the first page that shows it; 20 addresses and 10 numbers a page are the rule (X19).")


def _contacts(pages: DataFrame) -> DataFrame:
    h = c("html")
    kinds = {"email": F.slice(business.emails(h), 1, 20), "phone": F.slice(business.phones(h, text.clean_html(h)), 1, 10), **{n: business.social_links(h, n) for n in business.SOCIAL_LINKS}}
    typed = lambda kind, values: F.transform(values, lambda x, i: F.struct(F.lit(kind).alias("type"), x.alias("value"), i.alias("i")))
    rows = pages.select("domain", "pos", "url", F.explode(F.concat(*(typed(k, v) for k, v in kinds.items()))).alias("x")).select("domain", "url", "x.type", "x.value", F.struct("pos", "x.i").alias("at"))
    first = rows.groupBy("domain", "type", F.lower("value").alias("k")).agg(F.min(F.struct("at", "value", "url")).alias("m"))
    return first.select("domain", "type", "m.value", "m.url", "m.at")


fixture("store_snippets", "domain string, pos int, url string, t string, html string", [
    ("a.com", 0, "https://a.com", "Home", '<meta name="description" content="Knits &amp; more">'), ("a.com", 1, "https://a.com/pages/about", "We knit.", ""), ("a.com", 2, "https://a.com/trade-account", "x", ""), ("b.com", 0, "https://b.com", "Home", '<meta name="description" content="Knits &amp; more">'), ("c.com", 0, "https://c.com/about", "", ""), ("d.com", 0, "https://d.com/our-story", "a" * 400, ""),
], "domain string, about string, wholesale string", [("a.com", "We knit.", "https://a.com/trade-account"), ("b.com", "Knits & more", ""), ("c.com", "", ""), ("d.com", "a" * 300, "")],
    lambda df: df.groupBy("domain").agg(
        F.coalesce(F.min_by(F.trim(F.left("t", F.lit(300))), F.when(c("url").rlike("(?i)/about|/our-story") & (c("t") != ""), c("pos"))), F.min_by(F.left(_description(), F.lit(300)), F.when(_description() != "", c("pos"))), F.lit("")).alias("about"),
        F.coalesce(F.min_by("url", F.when(c("url").rlike(r"(?i)wholesale|stockist|trade[\-_ ]?account|retailer|become[\-_ ]a"), c("pos"))), F.lit("")).alias("wholesale")), "What a store says of itself, and its wholesale page (X21).")


def _description() -> Column:
    return F.trim(text.unescape(F.regexp_extract("html", r"""(?i)<meta[^>]+name=["']description["'][^>]+content=["']([^"']*)["']""", 1)))
