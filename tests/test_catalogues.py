"""Products in JSON and cards, beyond the cases that the registered queries have."""

import json

from pyspark.sql import functions as F

from retail_lens.functions.url import absolute
from retail_lens.operators import catalogues

PAGE = "https://a.com/shop/new?x=1"


def captured(spark, payloads):
    df = spark.createDataFrame(list(enumerate(payloads)), "i int, p string")
    return sorted(tuple(r) for r in catalogues.captured(df, ["i"], F.col("p"), F.lit(PAGE)).collect())


def test_nodes_are_all_values_in_order(spark):
    df = spark.createDataFrame([(0, ' {"a":[1,{"b":null}],"":true} rest'), (1, "no"), (2, None), (3, '"x"'), (4, "[" * 5000)], "i int, t string")
    got = [(r.i, r.at, "".join(r.path), r.kind, r.value) for r in df.select("i", F.inline(catalogues.json_nodes("t"))).orderBy("i", "at").collect()]
    assert got == [(0, 0, "", "object", "2"), (0, 1, ".a", "array", "2"), (0, 2, ".a#0", "number", "1"), (0, 3, ".a#1", "object", "1"), (0, 4, ".a#1.b", "null", ""), (0, 5, ".", "boolean", "True"), (3, 0, "", "string", "x")]


def test_prices_of_captured_products(spark):
    two = lambda **x: json.dumps([{"name": "First one", "price": 1}, {"name": "Other", **x}])
    rows = captured(spark, [
        two(price={"min": {"amount": "", "value": "12.50"}, "currencyCode": "eur"}), two(price=[{"raw": "7"}], currency="usd"), two(price=None, amount=5), two(priceInCents=1999), two(priceInCents=True), two(variants=[{"price": "30"}, {"price": 20, "currency": "gbp"}, {"x": 1}, 5]),
        two(price={"currency": "cad", "final_price": {"value": {"raw": 9}}}), two(price={"value": {"value": {"value": {"value": 3}}}}), two(price="0", priceCents=250), two(price=False), json.dumps([{"name": "x", "price": 1}, {"name": "y" * 301, "price": 1}, {"name": "ok", "price": 2}]),
    ])
    other = {r[0]: r[2:5] for r in rows if r[1] == "Other"}
    assert other == {0: ("12.50", 0, "EUR"), 1: ("7", 0, "USD"), 3: ("1999", 2, ""), 5: ("20", 0, ""), 6: ("9", 0, "CAD"), 8: ("250", 2, "")}


def test_lists_inside_accepted_ones_are_not_looked_at(spark):
    item = lambda n, **x: {"name": n, "price": 1, **x}
    nested = {"l": [item("Aa", related=[item("In"), item("In too")]), item("Bb", link="../b"), {}, 5], "other": [{"sub": [item("Cc", url="/c"), item("Dd", url="?d")]}, {"x": 1}]}
    rows = captured(spark, [json.dumps(nested), "[]", "{}", "[{}, {}]", None])
    assert [(r[0], r[1], r[5]) for r in rows] == [(0, "Aa", ""), (0, "Bb", "https://a.com/b"), (0, "Cc", "https://a.com/c"), (0, "Dd", "https://a.com/shop/new?d")]


def test_state_takes_outermost_objects_in_order_up_to_its_bound(spark, monkeypatch):
    item = lambda n, **x: {"title": n, "sku": n, "price": 3, **x}
    html = "<script>window.__NUXT__ = " + json.dumps({"a": item("Out", more=[item("In")]), "b": [item(f"p{k:02}") for k in range(9)], "c": item("Late"), "d": {"name": {}, "title": "Named", "id": 0, "amount": {"value": "", "price": "4"}, "vendor": {"name": "V"}}, "e": item("", x=1), "f": {**item("Wix"), "urlPart": "wix", "formattedPrice": "$3"}}) + "; x()</script>"
    df = spark.createDataFrame([(1, html), (2, "<p>window.location</p>"), (3, None)], "i int, h string")
    got = [(r.title, r.price_raw, r.vendor, r.url) for r in catalogues.app_state(df, ["i"], F.col("h"), F.lit(PAGE)).collect()]
    page = "https://a.com/shop/new?x=1"
    assert sorted(got) == sorted([("Out", "3", "", page), *((f"p{k:02}", "3", "", page) for k in range(9)), ("Late", "3", "", page), ("Named", "4", "V", page), ("Wix", "3", "", "https://a.com/product-page/wix")])
    monkeypatch.setattr(catalogues, "MOST_STATE", 4)
    assert sorted(r.title for r in catalogues.app_state(df, ["i"], F.col("h"), F.lit(PAGE)).collect()) == ["Out", "p00", "p01", "p02"]


def test_cards(spark):
    html = """<div class="card"><b class="x card-title"><i><a href="t">Knit <em>Tee</em></a></i></b><span data-product-price-with-tax="">$9 <u class="sr-only">now</u></span><span data-product-price-without-tax=""><script>1</script>$ 8</span><p data-test-info-type="brandName">Lee</p></div>
    <div class="card"><a class="card-title" href="/x">Not below</a><span data-product-price-with-tax="">1</span></div><div class="cards"><b class="card-title"><a>No card</a></b></div>"""
    df = spark.createDataFrame([(1, html), (2, "<p>"), (3, None)], "i int, h string")
    assert [tuple(r) for r in catalogues.cards(df, ["i"], F.col("h"), F.lit(PAGE)).collect()] == [(1, "Knit Tee", "$ 8", "Lee", "https://a.com/shop/t")]


def test_absolute_links(spark):
    links = ["b", "./b", "../b", "../../../b", "/b", "//h.com/b", "?q", "#f", "mailto:x", "http://h/b"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(links)], "i int, x string").orderBy("i")
    assert [r[0] for r in df.select(absolute(F.lit(PAGE), F.col("x"))).collect()] == ["https://a.com/shop/b", "https://a.com/shop/b", "https://a.com/b", "https://a.com/b", "https://a.com/b", "https://h.com/b", "https://a.com/shop/new?q", "https://a.com/shop/new?x=1#f", "mailto:x", "http://h/b"]
