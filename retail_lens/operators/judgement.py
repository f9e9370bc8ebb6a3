"""Judgements over pages, stores, answers and requests, each over literal rows; and the brand mix of every store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import LISTINGS_SQL, listings, table
from ..functions import business, text
from ..registry import cases, query

c = F.col
LI = "<li>" * 31
#: Least share of products with a vendor, of outside brands among these, and number of outside brands; most share of one brand.
MIN_NAMED, MIN_OUTSIDE, MIN_BRANDS, MAX_TOP = 0.5, 0.1, 3, 0.9

cases("platform_marks", "html string", "platform string", [
    ('<script src="https://CDN.Shopify.com/x.js">', "shopify"), ('<meta name="generator" content="Big Cartel">', "bigcartel"), ('<link href="//static1.squarespace.com/a.css">', "squarespace"), ('<img src="https://static.wixstatic.com/x">', "wix"), ("<script>var BCData = {}</script>", "bigcommerce"),
    ('<script type="text/x-magento-init">', "magento"), ('<div class="woocommerce">', "woocommerce"), ('<link href="/wp-content/themes/x">', "wordpress"), ("https://cdn.webshopapp.com", "lightspeed"), ("<p>ecwid</p>", "ecwid"), ("<p>x</p>", "custom/unknown"), (None, "custom/unknown"),
], lambda: {"platform": business.platform(c("html"))}, "Platforms by ordered marks (X14).")

cases("page_currencies", "html string", "currency string, source string", [
    ('<script>Shopify.currency = {"active":"cad","rate":"1.0"};</script><meta property="og:price:currency" content="USD">', "CAD", "shopify_js"), ('bigcartel.account.currency = window.x || "usd";', "USD", "bigcartel_js"), ('<meta property="product:price:currency" content="eur">', "EUR", "meta"), ('<meta content="GBP" property="og:price:currency">', "GBP", "meta"),
    ('<meta property="og:price:currency" content="dollars"><script type="application/ld+json">{"@type":"Product","offers":{"price":"1","priceCurrency":"aud"}}</script>', "AUD", "jsonld"), ("only $12", "", ""),
], lambda: {k: business.currency(c("html"))[k] for k in ("currency", "source")}, "Declared currencies (X15).")

cases("page_contacts", "html string, visible string", "emails string, phones string, instagram string, facebook string, tiktok string", [
    ('<a href="mailto:hello@tango.com?subject=x">a@b.co</a> logo@2x.png me@example.com', "call (239) 555-0101 or 239-555-0102", "hello@tango.com,a@b.co", "(239) 555-0101,239-555-0102", "", "", ""),
    ('<a href="tel:+1 239 555 0101">239.555.0101</a><a href="https://www.instagram.com/tango/">i</a> https://instagram.com/tango2 <a href="https://facebook.com/sharer?u=1">s</a><a href="https://m.facebook.com/tango">f</a> https://tiktok.com/@tango', "239.555.0101", "", "+1 239 555 0101,239.555.0101", "https://www.instagram.com/tango/,https://instagram.com/tango2", "https://m.facebook.com/tango", "https://tiktok.com/@tango"),
    ("x@sentry.io y@o1.sentry-next.wixpress.com you@yourdomain.com", "1234567890", "", "", "", "", ""),
], lambda: {"emails": F.array_join(business.emails(c("html")), ","), "phones": F.array_join(business.phones(c("html"), c("visible")), ","), **{n: F.array_join(business.social_links(c("html"), n), ",") for n in ("instagram", "facebook", "tiktok")}}, "Contacts of pages (X16-X18).")

cases("challenges", "status int, body string", "vendor string", [
    (403, "<title>Just a moment...</title>", "cloudflare"), (307, "px-captcha", "perimeterx"), (404, "cf-chl-x", ""), (200, "geo.captcha-delivery.com", "datadome"), (429, "incap_ses_1", "incapsula"), (200, "datadome" + " " * 60_000, ""), (None, "datadome", ""), (503, "Sucuri Website Firewall", "sucuri"), (200, "fine", ""), (200, "bm-verify", "akamai"),
], lambda: {"vendor": business.challenge(c("status"), c("body"))}, "Challenge pages by vendor (X25).")

cases("failures", "error string, vendor string, status int, products bigint, chars bigint", "reason string, method string, read_status string, no_site boolean", [
    ("timed out", "", None, 0, 0, "timed out", "other", "js_required", False), ("", "cloudflare", 403, 0, 500, "challenge page (cloudflare)", "cloudflare", "no_products", False), ("", "", 404, 3, 0, "HTTP 404", "http_404", "ok", False), ("", "", 200, 0, 199, "empty page", "other", "js_required", False), ("getaddrinfo failed", "", None, 0, 200, "getaddrinfo failed", "other", "no_products", True),
], lambda: {"reason": (r := business.failure_reason(c("error"), c("vendor"), c("status"))), "method": business.block_method(r), "read_status": F.when(c("products") > 0, "ok").when(c("chars") < 200, "js_required").otherwise("no_products"), "no_site": c("error").rlike(business.NO_SITE)}, "Why pages were not read (F25, F26, C17, C20).")

cases("visit_judgements", "status string, store_type string, llm_on boolean, answered boolean, failed boolean, limited boolean", "unfinished boolean, again boolean", [
    ("no_products", "", False, False, False, False, True, False), ("ok", "unknown", True, False, True, False, True, False), ("ok", "unknown", True, True, True, False, False, False), ("ok", "multi_brand", False, False, False, False, False, False), ("blocked", "", True, False, False, True, False, True), ("blocked", "", True, False, False, False, False, False), ("rate_limited", "", True, False, False, False, False, True), ("ok", "", True, False, False, True, False, False),
], lambda: {"unfinished": ((c("status") == "no_products") | (c("status") == "ok") & c("store_type").isin("", "unknown")) & ~(c("llm_on") & (c("answered") | ~c("failed"))), "again": (c("status") == "rate_limited") | (c("status") == "blocked") & c("limited")}, "Visits that are not finished or are made again (C18, C19).")

cases("rate_limit_waits", "error string", "seconds double", [
    ("429: Please try again in 5.5s", 6.5), ("Please retry in 1m12s", 65.0), ("try again in 250ms", 1.25), ("slow down", 20.0), ("You exceeded your current quota. try again in 2s", None), ("insufficient_quota", None),
], lambda: {"seconds": business.rate_limit_wait(c("error"))}, "Waits after rate limits (C21).")

cases("chain_names", "name string, html string", "chain boolean", [
    ("Macy's", "", True), ("MACYS Downtown", "", False), ("Nordstrom Rack", "", True), ("H&M", "", True), ("Hm Boutique", "", False), ("J. Crew Factory", "", False), ("Tango", "<b>Our Stores</b>" + LI, True), ("Tango", "<b>Our Stores</b>" + LI[4:], False), ("Tango", LI, False), (None, None, False),
], lambda: {"chain": business.is_chain(c("name"), c("html"))}, "National chains (C4).")

cases("business_kinds", "domain string, name string, t string, store_type string, status string, products bigint", "kind string, reason string", [
    ("usa.gov", "USA", "", "", "ok", 0, "non_retail", "domain usa.gov"), ("friends.org", "Friends", "", "", "ok", 0, "non_retail", "domain friends.org"), ("gap.com", "Gap", "", "", "ok", 9, "department_store", "known chain: gap"), ("gapkids.com", "", "", "multi_brand", "ok", 9, "boutique", "sells other brands"), ("nordstromrack.com", "", "", "", "ok", 9, "department_store", "known chain: nordstrom"),
    ("etsy.co.uk", "", "", "", "ok", 9, "marketplace_resale", "marketplace: etsy"), ("tango.com", "Tango", "a consignment boutique", "multi_brand", "ok", 9, "marketplace_resale", "'consignment'"), ("tango.com", "Tango", "consignment", "own_brand", "ok", 9, "own_label", "sells its own label"), ("thecashmeresale.com", "The Cashmere Sale", "", "", "ok", 9, "boutique", "sells products; brands unclear"),
    ("seasideresort.com", "", "", "", "ok", 9, "resort_hotel_club", "domain: 'resort'"), ("tango.com", "Tango Ski & Sport", "", "", "ok", 9, "outdoor_sporting", "name: 'ski'"), ("tango.com", "Tango News", "", "multi_brand", "ok", 9, "boutique", "sells other brands"), ("tango.com", "Tango News", "", "", "ok", 0, "non_retail", "name: 'news'"), ("tango.com", "Tango", "golf shop", "multi_brand", "ok", 9, "boutique", "sells other brands"), ("tango.com", "Tango", "", "", "blocked", 0, "unknown", ""), ("winner-skirts.com", "Winner Skirts", "", "", "blocked", 0, "unknown", ""),
], lambda: {k: business.business_type(c("domain"), c("name"), c("t"), c("store_type"), c("status"), c("products"))[k] for k in ("kind", "reason")}, "Kinds of business, and why (C7).")

cases("article_pages", "path string, title string", "article boolean", [
    ("/blogs/news/x", "Knit", True), ("/2025/10/best", "", True), ("/shop", "Top 25 Boutique stores", True), ("/shop", "11 Small Knitwear Brands", True), ("/shop", "Where to buy", True), ("/shop", "Tango Boutique", False), ("/newsroom", "Guided", False),
], lambda: {"article": c("path").rlike(text.ARTICLE_PATH) | c("title").rlike(text.ARTICLE_TITLE)}, "Pages about stores (PF12).")

cases("search_requests", "items string, terms string, place string, country string, count bigint, prompt string", "items_kept string, terms_kept string, place_kept string, country_kept string, count_kept bigint, refused boolean", [
    ("knitwear,hats,knitwear,fall_winter", "polka  dots|a b c d|x|x|y|z|w|v", " New  York ", "us", 5, "find stores", "knitwear,fall_winter", "polka dots,x,y,z,w", "New York", "US", 5, False), ("", "", "a<b", "USA", 0, "12 34", "", "", "", "", None, True), ("other", "t" * 41, "x", "c1", -1, "", "other", "", "x", "", None, True), ("spring_summer", "ok", "", "", None, "x" * 301, "spring_summer", "ok", "", "", None, True),
], lambda: {
    "items_kept": F.array_join(F.array_distinct(F.filter(F.split("items", ","), lambda i: i.isin("knitwear", "cashmere_wool", "fall_winter", "spring_summer", "other"))), ","),
    "terms_kept": F.array_join(F.slice(F.array_distinct(F.filter(F.transform(F.split("terms", r"\|"), lambda t: text.collapse(t)), lambda t: (t != "") & (F.length(t) <= 40) & (F.size(F.split(t, " ")) <= 3))), 1, 5), ","),
    "place_kept": F.when(~text.collapse(c("place")).contains("<") & (F.length(text.collapse(c("place"))) <= 80), text.collapse(c("place"))).otherwise(""), "country_kept": F.when(F.trim("country").rlike("^[A-Za-z]{2}$"), F.upper(F.trim("country"))).otherwise(""),
    "count_kept": F.when(c("count") > 0, c("count")), "refused": (F.trim("prompt") == "") | (F.length(F.trim("prompt")) > 300) | ~c("prompt").rlike(r"\p{L}{3}"),
}, "Search requests, and those refused without asking (C22, PF14).")

cases("run_caps", "stores bigint, new_only boolean", "agent_runs bigint, places bigint, searches bigint, budget double", [
    (8, False, 2, 10, 5, 0.13), (100, False, 14, 100, 25, 0.88), (100, True, 21, 100, 25, 1.31), (5000, True, 200, 300, 100, 12.5), (1, True, 3, 10, 5, 0.19),
], lambda: (lambda runs: {"agent_runs": runs, "places": F.least(F.lit(300), F.greatest(F.lit(10), c("stores"))), "searches": F.least(F.lit(100), F.greatest(F.lit(5), F.floor(c("stores") / 4))), "budget": F.round(runs.cast("decimal(10,0)") * F.lit("0.0625").cast("decimal(6,4)"), 2)})(
    F.least(F.lit(200), F.when(c("new_only"), F.ceil((F.ceil(c("stores") / 8) + 1) * 1.5)).otherwise(F.ceil(c("stores") / 8) + 1))), "Caps of a search for so many stores (M12).")

cases("store_verdicts", "status string, vendors string, existing string, judged string, confidence double", "store_type string, type_source string", [
    ("blocked", "multi_brand", "", "", None, "", ""), ("ok", "multi_brand", "own_brand", "", None, "multi_brand", "vendors"), ("ok", "unknown", "own_brand", "", None, "own_brand", "llm"), ("ok", "unknown", "unknown", "multi_brand", 0.9, "unknown", ""), ("ok", "unknown", "", "multi_brand", 0.6, "multi_brand", "llm"), ("ok", "unknown", "", "multi_brand", 0.59, "unknown", ""), ("ok", "unknown", "", "", None, "unknown", ""),
], lambda: {
    "store_type": F.when(c("status") != "ok", "").when(c("vendors") == "multi_brand", "multi_brand").when(c("existing") != "", c("existing")).when(c("confidence") >= 0.6, c("judged")).otherwise("unknown"),
    "type_source": F.when(c("status") != "ok", "").when(c("vendors") == "multi_brand", "vendors").when(c("existing") != "", F.when(c("existing") != "unknown", "llm").otherwise("")).when(c("confidence") >= 0.6, "llm").otherwise(""),
}, "Store types: vendors, what is known, then the model's answer (C6).")


@query(f"""
WITH {LISTINGS_SQL}, v AS (SELECT domain, regexp_replace(lower(vendor), '[^a-z0-9]+', '', 'g') AS brand_key, count(*) AS n FROM listings GROUP BY 1, 2),
s AS (SELECT domain, sum(n) AS named, sum(n) FILTER (WHERE brand_key <> 'brand' || CAST(1 + length(domain) % 25 AS VARCHAR)) AS outside_n, max(n) FILTER (WHERE brand_key <> 'brand' || CAST(1 + length(domain) % 25 AS VARCHAR)) AS top, count(*) FILTER (WHERE brand_key <> 'brand' || CAST(1 + length(domain) % 25 AS VARCHAR)) AS outside FROM v GROUP BY 1),
r AS (SELECT domain, outside, top / nullif(outside_n, 0) AS top_share, coalesce(outside_n, 0) / named AS outside_share FROM s)
SELECT domain, CAST(outside AS BIGINT) AS outside_brands, round(top_share, 4) AS top_share, CASE WHEN outside >= 3 AND top_share < 0.9 AND outside_share >= 0.1 THEN 'multi_brand' ELSE 'unknown' END AS store_type,
       CASE WHEN outside = 0 THEN 'vendors are only the store''s own name' WHEN outside >= 3 AND top_share < 0.9 AND outside_share >= 0.1 THEN '' WHEN outside_share < 0.1 THEN 'the store''s own name is on nearly every product' WHEN top_share >= 0.9 THEN 'one brand is nearly the whole catalogue' ELSE 'only ' || CAST(outside AS VARCHAR) || ' outside brand(s)' END AS reason FROM r""")
def brand_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a store's vendors make it a shop of many brands, or why they don't tell (C5, A35). The store's own label is the brand that its name's length stands for."""
    v = listings(spark, sf_dir).groupBy("domain", text.compact(c("vendor")).alias("brand_key")).agg(F.count("*").alias("n"))
    own = c("brand_key") == F.concat(F.lit("brand"), (1 + F.length("domain") % 25).cast("string"))
    s = v.groupBy("domain").agg(F.sum("n").alias("named"), F.sum(F.when(~own, c("n"))).alias("outside_n"), F.max(F.when(~own, c("n"))).alias("top"), F.count_if(~own).alias("outside_brands"))
    top, share = c("top") / c("outside_n"), F.coalesce("outside_n", F.lit(0)) / c("named")
    many = (c("outside_brands") >= MIN_BRANDS) & (top < MAX_TOP) & (share >= MIN_OUTSIDE)
    why = F.when(c("outside_brands") == 0, "vendors are only the store's own name").when(many, "").when(share < MIN_OUTSIDE, "the store's own name is on nearly every product").when(top >= MAX_TOP, "one brand is nearly the whole catalogue").otherwise(F.concat(F.lit("only "), c("outside_brands").cast("string"), F.lit(" outside brand(s)")))
    return s.select("domain", "outside_brands", F.round(top, 4).alias("top_share"), F.when(F.coalesce(many, F.lit(False)), "multi_brand").otherwise("unknown").alias("store_type"), why.alias("reason"))


@query("SELECT CASE WHEN contains(lower(html), 'cdn.shopify.com') OR contains(lower(html), 'shopify.theme') OR contains(lower(html), 'myshopify.com') THEN 'shopify' WHEN contains(lower(html), 'squarespace.com') THEN 'squarespace' WHEN contains(lower(html), 'wp-content') THEN 'wordpress' ELSE 'custom/unknown' END AS platform, count(*) AS pages FROM pages GROUP BY 1")
def platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages by the platform whose marks they bear."""
    return table(spark, sf_dir, "pages").groupBy(business.platform(c("html")).alias("platform")).agg(F.count("*").alias("pages"))
