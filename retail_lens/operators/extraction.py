"""Extraction from page text and payloads: contacts, product feeds, attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import table
from ..functions import price
from ..registry import query

#: Keys of one page of a feed.
PAGE = 5000
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
PHONE = r"\+?1? ?\([0-9]{3}\) [0-9]{3}-[0-9]{4}"
JUNK_MAIL = ("sentry.io", "wixpress.com", "example.org")
FEED_SCHEMA = "products array<struct<id:bigint, title:string, body_html:string, published_at:string, vendor:string, product_type:string, tags:array<string>, variants:array<struct<price:string, compare_at_price:string, available:boolean>>>>"


def emails(text: Column) -> Column:
    """Distinct addresses in order of first sight, without those of services."""
    found = F.transform(F.regexp_extract_all(text, F.lit(EMAIL), 0), F.lower)
    return F.array_distinct(F.filter(found, lambda m: ~F.substring_index(m, "@", -1).isin(*JUNK_MAIL)))


def phones(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PHONE), 0), lambda p: F.right(F.regexp_replace(p, "[^0-9]", ""), F.lit(10))))


def feed_products(payload: Column) -> Column:
    """Products of a shop feed: title, vendor, type, tags, the least variant price as written, on_sale and in_stock (null if unknown)."""
    def product(p: Column) -> Column:
        priced = F.filter(p["variants"], lambda v: price.parse_price(v["price"]).isNotNull())
        cheapest = F.array_min(F.transform(priced, lambda v: F.struct(price.parse_price(v["price"]).alias("n"), v["price"].alias("raw"))))
        sale = F.exists(p["variants"], lambda v: price.parse_price(v["compare_at_price"]) > price.parse_price(v["price"]))
        stock = F.exists(p["variants"], lambda v: v["available"])
        return F.struct(p["id"].alias("id"), p["title"].alias("title"), p["vendor"].alias("vendor"), p["product_type"].alias("product_type"), F.array_join(F.coalesce(p["tags"], F.array().cast("array<string>")), ",").alias("tags"), cheapest["raw"].alias("price_raw"), cheapest["n"].alias("price"), sale.alias("on_sale"), stock.alias("in_stock"))

    return F.transform(F.from_json(payload, FEED_SCHEMA)["products"], product)


def ld_blocks(html: Column) -> Column:
    """The JSON-LD blocks of a page, as text."""
    return F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type\s*=\s*["\']?application/ld\+json["\']?[^>]*>(.*?)</script\s*>'), 1)


@query(r"WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS m FROM documents) SELECT DISTINCT doc_id, lower(m) AS email FROM m")
def contact_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in documents."""
    return table(spark, sf_dir, "documents").where(F.col("text").contains("@")).select("doc_id", F.explode(emails(F.col("text"))).alias("email"))


@query(r"WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '\+?1? ?\([0-9]{3}\) [0-9]{3}-[0-9]{4}')) AS m FROM documents) SELECT DISTINCT doc_id, right(regexp_replace(m, '[^0-9]', '', 'g'), 10) AS phone FROM m")
def contact_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone numbers in documents, by their last ten digits."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(phones(F.col("text"))).alias("phone"))


@query(r"SELECT page_id, regexp_extract(html, '<html[^>]*\blang=\"([a-z]+)\"', 1) AS lang, CAST(len(regexp_extract_all(html, '<a href=')) AS INT) AS links, length(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title_chars FROM pages")
def page_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, links and title of pages."""
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(h, r'<html[^>]*\blang="([a-z]+)"', 1).alias("lang"), F.regexp_count(h, F.lit("<a href=")).alias("links"), F.char_length(F.regexp_extract(h, "(?s)<title>(.*?)</title>", 1)).cast("long").alias("title_chars"))


@query(r"WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages) SELECT href, count(*) AS n, count(DISTINCT page_id) AS pages FROM l GROUP BY href HAVING count(DISTINCT page_id) >= 3")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets that several pages share."""
    l = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("href"))  # noqa: E741
    per = l.groupBy("href", "page_id").agg(F.count("*").alias("n"))
    return per.groupBy("href").agg(F.sum("n").alias("n"), F.count("*").alias("pages")).where("pages >= 3")


@query("WITH n AS (SELECT p_brand, count(*) AS products, round(min(p_retailprice), 2) AS least FROM part GROUP BY p_brand) SELECT p_brand AS vendor, products, least, CAST(products AS BIGINT) AS on_sale FROM n")
def json_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shop feeds in pages of neighbouring products of a brand, written as JSON and read back: products, least price, and how many are on sale."""
    variant = F.struct(F.format_string("$%.2f", F.col("p_retailprice")).alias("price"), F.format_string("$%.2f", F.col("p_retailprice") + 10).alias("compare_at_price"), F.lit(True).alias("available"))
    product = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("vendor"), F.array(variant, variant).alias("variants"))
    feeds = table(spark, sf_dir, "part").groupBy("p_brand", F.floor(F.col("p_partkey") / PAGE).alias("page")).agg(F.to_json(F.struct(F.collect_list(product).alias("products"))).alias("payload"))
    p = feeds.select(F.inline(feed_products(F.col("payload"))))
    return p.groupBy("vendor").agg(F.count("*").alias("products"), F.round(F.min("price"), 2).alias("least"), F.count_if("on_sale").alias("on_sale"))
