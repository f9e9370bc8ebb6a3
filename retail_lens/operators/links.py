"""Links: resolution, first-wins duplicates, and URL and text functions over pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import table
from ..functions import price, text, url
from ..registry import query

_HOST_SQL = r"regexp_replace(lower(regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', '')"
_HOST = _HOST_SQL.format(u="url")
_DOMAIN = "array_to_string(string_split(h, '.')[-2:], '.')"


@query(f"WITH p AS (SELECT page_id, url, {_HOST} AS h FROM pages) SELECT page_id, h AS host, {_DOMAIN} AS domain FROM p")
def registrable_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host and registrable domain of each page."""
    h = url.host(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", h.alias("host"), url.registrable_domain(h).alias("domain"))


@query(r"WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '  ' || url || '/ ' WHEN 1 THEN regexp_replace(url, '^https?:', '') WHEN 2 THEN regexp_replace(url, '^https?://', '') ELSE url END AS u FROM pages), t AS (SELECT page_id, trim(u) AS t FROM p) SELECT page_id, regexp_replace(CASE WHEN t = '' THEN '' WHEN starts_with(t, '//') THEN 'https:' || t WHEN regexp_matches(t, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN t ELSE 'https://' || t END, '/+$', '') AS url FROM t")
def normalize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of all pages, written carelessly, made whole again."""
    u, k = F.col("url"), F.col("page_id") % 4
    careless = F.when(k == 0, F.concat(F.lit("  "), u, F.lit("/ "))).when(k == 1, F.regexp_replace(u, "^https?:", "")).when(k == 2, F.regexp_replace(u, "^https?://", "")).otherwise(u)
    return table(spark, sf_dir, "pages").select("page_id", url.normalize_url(careless).alias("url"))


@query(rf"WITH p AS (SELECT page_id, {_HOST} AS h, url FROM pages) SELECT page_id, regexp_replace(h, '^www\.', '') || regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') || regexp_extract(url, '(\?[^#]*)', 1) AS url_key FROM p")
def url_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key by which two spellings of a page's URL are one."""
    return table(spark, sf_dir, "pages").select("page_id", url.url_key(F.col("url")).alias("url_key"))


_KIND = " ".join(f"WHEN regexp_matches(p, '{pattern}') THEN '{kind}'" for kind, pattern in url.PAGE_KINDS)


@query(rf"WITH p AS (SELECT regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS p FROM pages) SELECT CASE WHEN p = '' OR regexp_matches(p, '{url.LANGUAGE_ROOT}') THEN 'home' {_KIND} ELSE 'other' END AS page_kind, count(*) AS pages FROM p GROUP BY 1")
def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by what their paths say they are."""
    return table(spark, sf_dir, "pages").groupBy(url.page_kind(F.col("url")).alias("page_kind")).agg(F.count("*").alias("pages"))


_LINKS = "CASE page_id % 8 WHEN 0 THEN '' WHEN 1 THEN 'https://instagram.com/shop' || CAST(page_id AS VARCHAR) WHEN 2 THEN 'http://10.0.0.' || CAST(page_id AS VARCHAR) WHEN 3 THEN 'www.amazon.com/x' WHEN 4 THEN 'me@shop.com' ELSE url END"


@query(rf"WITH l AS (SELECT page_id, {_LINKS} AS link FROM pages), n AS (SELECT page_id, link, CASE WHEN regexp_matches(link, '^[a-z]+://') THEN link ELSE 'https://' || link END AS u FROM l), h AS (SELECT page_id, link, {_HOST_SQL.format(u='u')} AS h FROM n), c AS (SELECT page_id, CASE WHEN link = '' THEN 'no_website' WHEN h NOT LIKE '%.%' OR regexp_matches(h, '^[0-9.]+$') OR link LIKE '%@%' THEN 'invalid_url' WHEN {_DOMAIN} = 'instagram.com' THEN 'social_only' WHEN {_DOMAIN} = 'amazon.com' THEN 'marketplace' ELSE 'processed' END AS status FROM h) SELECT status, count(*) AS links FROM c GROUP BY 1")
def classify_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input links by whether, and why not, they can be visited."""
    k, text_id = F.col("page_id") % 8, F.col("page_id").cast("string")
    link = F.when(k == 0, "").when(k == 1, F.concat(F.lit("https://instagram.com/shop"), text_id)).when(k == 2, F.concat(F.lit("http://10.0.0."), text_id)).when(k == 3, "www.amazon.com/x").when(k == 4, "me@shop.com").otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select(link.alias("link")).groupBy(url.classify(F.col("link")).alias("status")).agg(F.count("*").alias("links"))


@query(f"WITH p AS (SELECT page_id, {_HOST} AS h FROM pages), r AS (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS first FROM p) SELECT page_id, h AS host, CASE WHEN page_id = first THEN 'processed' ELSE 'duplicate' END AS status FROM r")
def first_wins_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each host counts, later ones are duplicates. First ids come from map-side minima, so a host with very many pages is no one task's."""
    p = table(spark, sf_dir, "pages").select("page_id", url.host(F.col("url")).alias("host"))
    first = p.groupBy("host").agg(F.min("page_id").alias("page_id")).withColumn("status", F.lit("processed"))
    return p.join(first.select("page_id", "status"), "page_id", "left").select("page_id", "host", F.coalesce("status", F.lit("duplicate")).alias("status"))


@query(f"WITH p AS (SELECT page_id, {_HOST} AS h FROM pages), f AS (SELECT h, row_number() OVER (ORDER BY min(page_id)) AS k FROM p GROUP BY h) SELECT CASE WHEN k <= 10 THEN 'processed' ELSE 'over_limit' END AS status, count(*) AS pages FROM p JOIN f ON f.h = p.h GROUP BY 1")
def limit_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the first ten hosts in input order, and of those over the limit. The limit is the feature."""
    p = table(spark, sf_dir, "pages").select("page_id", url.host(F.col("url")).alias("host")).groupBy("host").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    ten = p.orderBy("first").limit(10).select("host", F.lit("processed").alias("status"))
    return p.join(F.broadcast(ten), "host", "left").groupBy(F.coalesce("status", F.lit("over_limit")).alias("status")).agg(F.sum("n").alias("pages"))


@query("SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS compact, right(regexp_replace('+1 (' || CAST(100 + c_custkey % 900 AS VARCHAR) || ') 555-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0'), '[^0-9]', '', 'g'), 10) AS digits FROM customer")
def compact_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact names and ten-digit phones of customers."""
    k = F.col("c_custkey")
    phone = F.concat(F.lit("+1 ("), (100 + k % 900).cast("string"), F.lit(") 555-"), F.lpad((k % 10000).cast("string"), 4, "0"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.compact(F.col("c_name")).alias("compact"), text.digits(phone).alias("digits"))


@query("WITH w AS (SELECT p_partkey, 'The ' || p_name || ' Shop & Co.' AS name FROM part), t AS (SELECT p_partkey, list_filter(regexp_extract_all(lower(name), '[a-z0-9]+'), lambda x: NOT list_contains(['the', 'shop', 'shoppe', 'boutique', 'boutiques', 'store', 'stores', 'clothing', 'co', 'company', 'collection', 'apparel', 'inc', 'llc', 'ltd', 'online', 'and'], x)) AS w FROM w) SELECT p_partkey, array_to_string(w, '') AS core_name FROM t")
def core_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shop names without the words that all shops share."""
    return table(spark, sf_dir, "part").select("p_partkey", text.core_name(F.concat(F.lit("The "), "p_name", F.lit(" Shop & Co."))).alias("core_name"))


@query("WITH r AS (SELECT p_partkey, p_partkey % 5 AS k, CAST(p_partkey % 1000 AS VARCHAR) AS n FROM part) SELECT p_partkey, CASE k WHEN 0 THEN CAST('1' || lpad(n, 3, '0') || '.50' AS DOUBLE) WHEN 1 THEN CAST(n || '.99' AS DOUBLE) WHEN 2 THEN CAST(n AS DOUBLE) * 1000 + 139000000 WHEN 3 THEN CAST('1' || lpad(n, 3, '0') || '.25' AS DOUBLE) END AS price FROM r")
def parse_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices in five notations, read back."""
    n, k = (F.col("p_partkey") % 1000).cast("string"), F.col("p_partkey") % 5
    three = F.lpad(n, 3, "0")
    raw = F.when(k == 0, F.concat(F.lit("$1,"), three, F.lit(".50"))).when(k == 1, F.concat(n, F.lit(",99 €"))).when(k == 2, F.concat(F.lit("Rp 139."), three, F.lit(".000"))).when(k == 3, F.concat(F.lit("from 1.") , three, F.lit(",25 EUR"))).otherwise("sold out")
    return table(spark, sf_dir, "part").select("p_partkey", price.parse_price(raw).alias("price"))


_MASKED = "text"
for _pattern in text.SECRETS:
    _MASKED = f"regexp_replace({_MASKED}, '{_pattern}', '[redacted]', 'g')"
_NAMED = text.NAMED_SECRET.replace("'", "''")


@query(rf"SELECT doc_id, CAST(len(regexp_extract_all(text, '{text.SECRETS[1]}')) AS INT) AS secrets, sha256(regexp_replace({_MASKED}, '{_NAMED}', '\1\2[redacted]', 'g')) AS redacted_sha256 FROM documents")
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and tokens in documents masked, and those of one provider counted."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count(t, F.lit(text.SECRETS[1])).alias("secrets"), F.sha2(text.redact(t), 256).alias("redacted_sha256"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS s FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(s, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&middot;', '·'), '&copy;', '©'), '&amp;', '&') AS s FROM a)
SELECT page_id, length(trim(regexp_replace(s, '\s+', ' ', 'g'))) AS n_chars, sha256(trim(regexp_replace(s, '\s+', ' ', 'g'))) AS text_sha256 FROM b""")
def clean_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of pages."""
    t = table(spark, sf_dir, "pages").select("page_id", text.clean_html(F.col("html")).alias("t"))
    return t.select("page_id", F.char_length("t").alias("n_chars"), F.sha2("t", 256).alias("text_sha256"))


@query("SELECT count(*) AS total, max(page_id) AS last FROM (SELECT page_id FROM pages ORDER BY page_id LIMIT 25 OFFSET 50)")
def page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of 25 rows; paging is the feature."""
    return table(spark, sf_dir, "pages").select("page_id").orderBy("page_id").offset(50).limit(25).agg(F.count("*").alias("total"), F.max("page_id").alias("last"))
