"""What of a page goes into a prompt: its main content, or the stretch of its text with most prices in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import table
from ..functions.text import clean_html, unescape
from ..registry import query

# What marks a price in a text, characters of a page that a prompt takes, and those kept before the first mark.
PRICE_MARK = r"[€$£¥₹]|\d[.,]\d{2}(?!\d)"
LIMIT, LEAD = 6000, 300
#: Tags that end a block of text, and elements that hold none.
BLOCK = r"(?i)</?(?:p|div|section|article|main|aside|header|footer|nav|ul|ol|li|dl|dt|dd|table|tr|td|th|h[1-6]|br|hr|form|blockquote|pre|title|head|body|html)(?:\s[^>]*)?/?>"
UNREAD = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->"
#: A block is content if it has so many characters, of which so many in a hundred at most are links' texts; a page has a main content if that has so many characters.
BLOCK_CHARS, LINK_SHARE, MAIN_CHARS = 40, 30, 200


def _visible(s: Column) -> Column:
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(s, r"<[^>]*>", " ")), r"(?U)\s+", " "))


def content_blocks(html: Column) -> Column:
    """The texts of a page's blocks that are content: long, and of few links. Blocks are what stands between block tags."""
    def described(block: Column) -> Column:
        links = F.regexp_extract_all(block, F.lit(r"(?is)<a\b[^>]*>(.*?)(?:</a\s*>|\z)"), 1)
        return F.struct(_visible(block).alias("text"), F.aggregate(links, F.lit(0), lambda n, a: n + F.length(_visible(a))).alias("linked"))

    blocks = F.transform(F.split(F.regexp_replace(F.coalesce(html, F.lit("")), UNREAD, " "), BLOCK, -1), described)
    kept = F.filter(blocks, lambda b: (F.length(b["text"]) >= BLOCK_CHARS) & (100 * b["linked"] <= LINK_SHARE * F.length(b["text"])))
    return F.transform(kept, lambda b: b["text"])


def marks(texts: DataFrame, key: str, text: str, mark: str = PRICE_MARK) -> DataFrame:
    """(key, start): where each mark begins, in characters from 0. Starts are running sums of the lengths of what lies between marks, so a text of very many marks is rows and no nested list."""
    sizes = F.zip_with(F.transform(F.split(text, mark, -1), F.length), F.transform(F.regexp_extract_all(text, F.lit(mark), 0), F.length), lambda gap, span: F.struct(gap.alias("gap"), span.alias("span")))
    rows = texts.where(F.col(text).rlike(mark)).select(key, F.posexplode(sizes).alias("_i", "_s")).where("_s.span is not null")
    upto = Window.partitionBy(key).orderBy("_i")
    return rows.select(key, (F.sum(F.col("_s.gap") + F.col("_s.span")).over(upto) - F.col("_s.span")).alias("start"))


def densest_window(texts: DataFrame, key: str, text: str, limit: int = LIMIT, lead: int = LEAD) -> DataFrame:
    """(key, marks, begin, held): of each text its marks, where the window begins that holds most of them, and how many begin within ``limit`` characters of its first mark.

    The windows that begin at each mark are a range frame over the marks' places; of equals the first counts, and the text from ``lead`` characters before it.
    A text of ``limit`` characters or fewer, or without a mark, begins at 0. Keys must be unique; null texts count as empty.
    """
    t = texts.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    m = marks(t, key, "_t").withColumn("_n", F.count("*").over(Window.partitionBy(key).orderBy("start").rangeBetween(0, limit - 1)))
    best = m.groupBy(key).agg(F.count("*").alias("marks"), F.max(F.struct("_n", (-F.col("start")).alias("at"))).alias("_m"))
    out = t.select(key, F.length("_t").alias("_chars")).join(best, key, "left")
    begin = F.when((F.col("_chars") <= limit) | F.col("_m").isNull(), 0).otherwise(F.greatest(F.lit(0), -F.col("_m.at") - lead))
    return out.select(key, F.coalesce("marks", F.lit(0)).alias("marks"), begin.cast("long").alias("begin"), F.coalesce("_m._n", F.lit(0)).alias("held"))


def condensed(pages: DataFrame, key: str = "page_id", html: str = "html", limit: int = LIMIT, lead: int = LEAD) -> DataFrame:
    """(key, blocks, marks, from_main, begin, text): the first ``limit`` characters of a page's main content, if that is long and holds half of the marks of the page's
    visible text at least; else the densest window of the visible text. Null pages are empty ones. Keys must be unique."""
    main = F.col("blocks")
    p = pages.select(F.col(key), content_blocks(F.col(html)).alias("blocks"), clean_html(F.coalesce(html, F.lit(""))).alias("text")).withColumns({"main": F.array_join(main, "\n"), "blocks": F.size(main)})
    window = densest_window(p, key, "text", limit, lead)
    j = p.join(window, key)
    ok = (F.length("main") >= MAIN_CHARS) & (F.regexp_count(F.left("main", F.lit(limit)), F.lit(PRICE_MARK)) * 2 >= F.col("marks"))
    return j.select(key, "blocks", "marks", ok.alias("from_main"), F.when(ok, 0).otherwise(F.col("begin")).cast("long").alias("begin"), F.when(ok, F.left("main", F.lit(limit))).otherwise(F.substr("text", F.col("begin").cast("int") + 1, F.lit(limit))).alias("text"))


_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))


def _sql_visible(s: str) -> str:
    s = f"regexp_replace({s}, '<[^>]*>', ' ', 'g')"
    for a, b in _ENTITIES:
        s = f"replace({s}, '{a}', '{b}')"
    return rf"trim(regexp_replace({s}, '\s+', ' ', 'g'))"


_READ = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')"
#: A mark is told at each character of a text: a sign, or four characters that no digit follows, which is none if they begin in another mark.
_MARKS = r"""c AS (SELECT page_id, text, unnest(range(1, length(text) + 1)) AS i FROM t),
m AS (SELECT page_id, i, substr(text, i, 1) IN ('€', '$', '£', '¥', '₹') AS sign, regexp_matches(substr(text, i, 5), '^[0-9][.,][0-9]{2}([^0-9]|$)') AS number FROM c),
k AS (SELECT page_id, i - 1 AS start FROM m WHERE sign OR number AND NOT EXISTS (SELECT 1 FROM m o WHERE o.page_id = m.page_id AND o.i = m.i - 3 AND o.number)),
n AS (SELECT page_id, start, count(*) OVER (PARTITION BY page_id ORDER BY start RANGE BETWEEN CURRENT ROW AND 499 FOLLOWING) AS n FROM k),
b AS (SELECT page_id, count(*) AS marks, arg_max(start, struct_pack(n := n, s := -start)) AS first, max(n) AS held FROM n GROUP BY page_id),
w AS (SELECT t.page_id AS page_id, text, coalesce(marks, 0) AS marks, coalesce(held, 0) AS held, CAST(CASE WHEN length(text) <= 500 OR first IS NULL THEN 0 ELSE greatest(0, first - 100) END AS BIGINT) AS begin FROM t LEFT JOIN b ON b.page_id = t.page_id)"""


@query(f"WITH t AS (SELECT page_id, {_sql_visible(_READ)} AS text FROM pages), {_MARKS} SELECT page_id, marks, begin, held FROM w")
def price_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 characters of each page's visible text that hold most prices, from a hundred before the first."""
    t = table(spark, sf_dir, "pages").select("page_id", clean_html(F.col("html")).alias("text"))
    return densest_window(t, "page_id", "text", 500, 100)


_BLOCK_SQL = BLOCK.replace("'", "''")


@query(rf"""WITH t AS (SELECT page_id, {_sql_visible(_READ)} AS text FROM pages), {_MARKS},
s AS (SELECT page_id, list_transform(regexp_split_to_array({_READ}, '{_BLOCK_SQL}'), lambda x: struct_pack(text := {_sql_visible('x')}, linked := list_sum(list_transform(regexp_extract_all(x, '(?is)<a\b[^>]*>(.*?)(?:</a\s*>|$)', 1), lambda a: length({_sql_visible('a')}))))) AS s FROM pages),
f AS (SELECT page_id, list_transform(list_filter(s, lambda x: length(x.text) >= 40 AND 100 * coalesce(x.linked, 0) <= 30 * length(x.text)), lambda x: x.text) AS blocks FROM s),
g AS (SELECT page_id, CAST(len(blocks) AS INTEGER) AS blocks, array_to_string(blocks, chr(10)) AS main FROM f),
h AS (SELECT page_id, blocks, left(main, 500) AS main, length(main) >= 200 AS long, (SELECT count(*) FROM (SELECT unnest(range(1, length(left(main, 500)) + 1)) AS i) WHERE substr(main, i, 1) IN ('€', '$', '£', '¥', '₹') OR regexp_matches(substr(left(main, 500), i, 5), '^[0-9][.,][0-9]{{2}}([^0-9]|$)')) AS held FROM g)
SELECT w.page_id AS page_id, blocks, marks, long AND 2 * h.held >= marks AS from_main, CAST(CASE WHEN long AND 2 * h.held >= marks THEN 0 ELSE begin END AS BIGINT) AS begin, sha256(CASE WHEN long AND 2 * h.held >= marks THEN main ELSE substr(text, begin + 1, 500) END) AS text_sha256 FROM w JOIN h ON h.page_id = w.page_id""")
def condensed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each page a prompt of 500 characters takes."""
    return condensed(table(spark, sf_dir, "pages"), limit=500, lead=100).select("page_id", "blocks", "marks", "from_main", "begin", F.sha2("text", 256).alias("text_sha256"))
