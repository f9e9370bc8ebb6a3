import random
import statistics

import pytest
from pyspark.sql import functions as F

from retail_lens.functions import geo, place, price, product, stats, text, url
from retail_lens.operators import customers, extraction, similarity


def values(spark, inputs, f):
    rows = spark.createDataFrame(list(enumerate(inputs)), "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("x"))).collect()]


@pytest.mark.parametrize(("raw", "expect"), [("$1,395.00", 1395.0), ("119,99 €", 119.99), ("Rp 139.000", 139000.0), ("1.234,50 €", 1234.5), ("10 - 20", 10.0), ("free", None), ("0", None), (None, None), ("1'200", 1200.0), ("12.5", 12.5), ("1,234,567", 1234567.0)])
def test_parse_price(spark, raw, expect):
    assert values(spark, [raw], price.parse_price) == [expect]


def test_urls(spark):
    assert values(spark, ["shop.com/", "//a.b/x//", "HTTP://A.b", " ", None], url.normalize_url) == ["https://shop.com", "https://a.b/x", "HTTP://A.b", "", ""]
    assert values(spark, ["https://u:p@WWW.Shop.co.uk:80/x", "http://a.b?x", "mailto:x"], url.host) == ["www.shop.co.uk", "a.b", ""]
    assert values(spark, ["www.shop.co.uk", "my.myshopify.com", "a.b.c.com", "localhost"], url.registrable_domain) == ["shop.co.uk", "my.myshopify.com", "c.com", "localhost"]
    assert values(spark, ["", "http://1.2.3.4", "instagram.com/x", "www.etsy.com/shop", "a@b.com", "fine.shop", "nodot"], url.classify) == ["no_website", "invalid_url", "social_only", "marketplace", "invalid_url", "processed", "invalid_url"]
    assert values(spark, ["http://www.a.com/x/?q=1#f", "https://a.com"], url.url_key) == ["a.com/x?q=1", "a.com"]
    assert values(spark, ["https://a.com/", "https://a.com/pages/Wholesale", "https://a.com/products/x", "https://a.com/z"], url.page_kind) == ["home", "wholesale", "product", "other"]


def test_numbers_with_dots_are_no_names(spark):
    assert values(spark, ["http://10.0.0.255", "http://10.0.0.1234", "10.0.0.99999/x", "http://1.2", "http://1.2.3.4.5", "http://12.shop"], url.classify) == ["invalid_url"] * 5 + ["processed"]
    assert values(spark, ["http://10.0.0.1234", "12.shop"], url.canonical_domain) == ["", "12.shop"]


def test_texts(spark):
    assert values(spark, ["The Knit Shop & Co.", "The Shop", None], text.core_name) == ["knit", "theshop", None]
    assert values(spark, ["+1 (239) 555-0101 ", "12"], text.digits) == ["2395550101", "12"]
    assert values(spark, ["k1a0b6", " 34102 "], place.normalize_postal) == ["K1A 0B6", "34102"]
    assert values(spark, ["Yes", "OutOfStock", "perhaps"], text.flag) == [True, False, None]
    assert values(spark, ["<p>a&amp;b<script>x</script> <b>c</b><!-- d --></p>"], text.clean_html) == ["a&b c"]
    assert values(spark, ['api_key = "abcdefgh12345678"', "plain"], text.redact) == ['api_key = "[redacted]"', "plain"]


def test_extraction(spark):
    assert values(spark, ["70% wool, 30% cotton", "merino wool", "none"], product.materials) == [["wool", "cotton"], ["merino"], []]
    assert values(spark, ["for women and men", "Ladies", "x"], product.gender) == ["unisex", "women", ""]
    assert values(spark, ["Mail A@b.com, a@B.com, z@sentry.io"], extraction.emails) == [["a@b.com"]]
    feed = '{"products":[{"id":1,"title":"T","vendor":"V","tags":["a","b"],"variants":[{"price":"20.00","compare_at_price":"30","available":false},{"price":"9.50","available":true}]},{"id":2,"title":"U","variants":[]}]}'
    got = values(spark, [feed, "broken"], extraction.feed_products)
    assert [(p["id"], p["price_raw"], p["price"], p["on_sale"], p["in_stock"], p["tags"]) for p in got[0]] == [(1, "9.50", 9.5, True, True, "a,b"), (2, None, None, False, False, "")]
    assert got[1] is None
    assert values(spark, ['<script type="application/ld+json">{"a":1}</script>'], extraction.ld_blocks) == [['{"a":1}']]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 7, 12])
def test_exclusive_quartiles(spark, n):
    data = [float((i * 37) % 101) for i in range(n)]
    row = spark.createDataFrame([(sorted(data),)], "a array<double>").select(*(stats.quartile_exclusive(F.col("a"), i) for i in (1, 2, 3))).first()
    expect = [None] * 3 if not n else [min(data), statistics.median(data), max(data)] if n < 4 else [round(q, 2) for q in statistics.quantiles(data, n=4)]
    assert list(row) == expect


@pytest.mark.parametrize("miles", [1.0, 15.0, 100.0, 900.0, 7000.0])
def test_radius_join_finds_every_pair(spark, miles):
    """Against all pairs, with points at the poles, on both sides of the date line, and without coordinates."""
    rng = random.Random(int(miles))
    spots = [(90.0, 0.0), (89.9, 170.0), (-90.0, 5.0), (0.0, 180.0), (0.0, -180.0), (0.1, -179.95), (60.0, 179.99), (60.0, -179.99), (None, 1.0)]
    spots += [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)] + [(26 + rng.uniform(-1, 1), -81 + rng.uniform(-1, 1)) for _ in range(30)]
    left = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "a int, lat double, lng double")
    right = left.select(F.col("a").alias("b"), F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"))
    far = geo.haversine_miles(F.col("lat"), F.col("lng"), F.col("c_lat"), F.col("c_lng"))
    want = sorted((r.a, r.b) for r in left.crossJoin(right).where(far <= miles).collect())
    assert sorted((r.a, r.b) for r in customers.within_radius(left, right, miles).collect()) == want


def test_containment_of_claims_of_any_length(spark):
    docs = ["The quick  brown Fox jumps over the lazy dog today", "quick brown", "unquick brown foxes jump", None, "", "a b c d e f g h i j k"]
    claims = ["quick brown", "own", "brown fox jumps", "ck brown fox jum", "b c d e f g h i", "B C D E F G H", "dog", "", "the lazy cat", "k brown foxes ju"]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(claims)), "item_id long, text string")
    plain = lambda t: " ".join(t.lower().split())
    want = sorted((i, j) for i, t in enumerate(docs) for j, x in enumerate(claims) if t is not None and plain(x) and plain(x) in plain(t))
    assert sorted((r.doc_id, r.item_id) for r in similarity.contained(d, b).collect()) == want


def test_haversine(spark):
    d = spark.range(1).select(geo.haversine_miles(F.lit(26.14), F.lit(-81.79), F.lit(25.76), F.lit(-80.19)), geo.haversine_miles(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0))).first()
    assert round(d[0]) in range(101, 106) and d[1] == 0
