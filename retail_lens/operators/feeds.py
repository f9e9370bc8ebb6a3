"""Product feeds of shop platforms: payloads parsed with declared schemas, one row a product.

Payloads are pages of a feed, so one is small; a store's feed is many rows. Every parser gives the columns of PRODUCT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import price, text
from ..registry import cases, fixture

c = F.col
PRODUCT = "title string, price double, price_raw string, minor int, currency string, vendor string, product_type string, tags string, description string, url string"
NAMES = "array<struct<name:string>>"
BIGCARTEL = f"array<struct<name:string, price:string, url:string, description:string, categories:{NAMES}, artists:{NAMES}>>"
_MAGENTO_ITEM = f"struct<name:string, canonical_url:string, url_key:string, categories:{NAMES}, description:struct<html:string>, price_range:struct<minimum_price:struct<final_price:struct<value:string, currency:string>>>>"
MAGENTO = f"data struct<products:struct<items:array<{_MAGENTO_ITEM}>, page_info:struct<total_pages:int>>>"
WOOCOMMERCE = f"array<struct<name:string, permalink:string, short_description:string, description:string, prices:struct<price:string, currency_code:string, currency_minor_unit:string>, categories:{NAMES}, brands:{NAMES}, tags:{NAMES}>>"
_MONEY = "struct<value:string, currency:string>"
_VARIANTS = f"array<struct<priceMoney:{_MONEY}>>"
SQUARESPACE = (
    f"collection struct<typeName:string, type:string>, items array<struct<title:string, excerpt:string, fullUrl:string, categories:array<string>, tags:array<string>, priceMoney:{_MONEY}, variants:{_VARIANTS}, "
    f"structuredContent:struct<variants:{_VARIANTS}, priceMoney:{_MONEY}>>>, pagination struct<nextPage:string, nextPageOffset:string>"
)
_LIGHTSPEED_ITEM = "struct<title:string, fulltitle:string, url:string, description:string, price:string, brand:string>"
LIGHTSPEED = "collection struct<products:string, page_next:string>, shop struct<currency:string, currency2:string>"
SHOPIFY = "products array<struct<title:string, handle:string, body_html:string, vendor:string, product_type:string, tags:string, variants:array<struct<price:string>>>>"

_text = lambda x: F.trim(F.coalesce(x, F.lit("")))
_none = lambda: F.lit(None).cast("int")


def _names(items: Column, clean: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.transform(F.coalesce(items, F.array().cast(NAMES)), lambda x: clean(_text(x["name"])))


def _first(items: Column) -> Column:
    return F.coalesce(F.get(items, F.lit(0)), F.lit(""))


def _code(x: Column) -> Column:
    return F.when(_text(x).rlike("^[A-Za-z]{3}$"), F.upper(_text(x))).otherwise("")


def _product(title, amount, raw, minor, currency, vendor, kind, tags, description, link) -> Column:
    values = (title, amount, _text(raw), minor, currency, vendor, kind, F.array_join(tags, "|"), description, link)
    return F.struct(*(v.cast(f.split(" ")[1]).alias(f.split(" ")[0]) for v, f in zip(values, PRODUCT.split(", "), strict=True)))


def _none_array() -> Column:
    return F.array().cast("array<string>")


def bigcartel(payload: Column, origin: Column) -> Column:
    """Every product of a shop, unpaged; the price is the lowest option's and has no currency."""
    def one(p: Column) -> Column:
        kinds, path = _names(p["categories"]), _text(p["url"])
        return _product(_text(p["name"]), price.parse_price(p["price"]), p["price"], _none(), F.lit(""), F.array_join(_names(p["artists"]), ", "), _first(kinds), kinds, text.clean_html(_text(p["description"])), F.when(path.startswith("/"), F.concat(origin, path)).otherwise(path))

    return F.transform(F.filter(F.from_json(payload, BIGCARTEL), lambda p: _text(p["name"]) != ""), one)


def magento(payload: Column, origin: Column) -> Column:
    """Items of a GraphQL answer, also of one that has errors beside its data; the price is the least final one."""
    def one(p: Column) -> Column:
        money = p["price_range"]["minimum_price"]["final_price"]
        kinds = _names(p["categories"], text.unescape)
        path = F.coalesce(F.nullif(_text(p["canonical_url"]), F.lit("")), F.concat(F.nullif(_text(p["url_key"]), F.lit("")), F.lit(".html")), F.lit(""))
        link = F.when((path == "") | path.startswith("http"), path).otherwise(F.concat(origin, F.lit("/"), F.regexp_replace(path, "^/+", "")))
        return _product(text.unescape(_text(p["name"])), price.parse_price(money["value"]), money["value"], _none(), _code(money["currency"]), F.lit(""), _first(kinds), F.array_distinct(kinds), text.clean_html(_text(p["description"]["html"])), link)

    return F.transform(F.filter(F.from_json(payload, MAGENTO)["data"]["products"]["items"], lambda p: _text(p["name"]) != ""), one)


def woocommerce(payload: Column, origin: Column) -> Column:
    """Products with prices in minor units: price_raw keeps them, price is in major units."""
    def one(p: Column) -> Column:
        minor = F.coalesce(p["prices"]["currency_minor_unit"].try_cast("int"), F.lit(0))
        amount = p["prices"]["price"].try_cast("long") / F.pow(F.lit(10.0), minor)
        kinds = _names(p["categories"], text.unescape)
        said = F.coalesce(F.nullif(_text(p["short_description"]), F.lit("")), p["description"])
        return _product(text.unescape(_text(p["name"])), F.when(amount != 0, amount), p["prices"]["price"], minor, _code(p["prices"]["currency_code"]), F.array_join(_names(p["brands"]), ", "), _first(kinds), _names(p["tags"], text.unescape), text.clean_html(_text(said)), _text(p["permalink"]))

    return F.transform(F.from_json(payload, WOOCOMMERCE), one)


def squarespace(payload: Column, origin: Column) -> Column:
    """Items of a products collection, each at its cheapest priced variant; other collections have none."""
    doc = F.from_json(payload, SQUARESPACE)

    def one(p: Column) -> Column:
        inner = p["structuredContent"]
        variants = F.when(inner.isNotNull(), inner["variants"]).otherwise(p["variants"])
        priced = F.filter(F.transform(variants, lambda v: F.struct(price.parse_price(v["priceMoney"]["value"]).alias("n"), v["priceMoney"].alias("m"))), lambda v: v["n"].isNotNull())
        whole = F.when(inner.isNotNull(), inner["priceMoney"]).otherwise(p["priceMoney"])
        best = F.coalesce(F.array_min(priced), F.when(price.parse_price(whole["value"]).isNotNull(), F.struct(price.parse_price(whole["value"]).alias("n"), whole.alias("m"))))
        link = F.when(_text(p["fullUrl"]) != "", F.concat(origin, _text(p["fullUrl"]))).otherwise("")
        return _product(_text(p["title"]), best["n"], best["m"]["value"], _none(), _code(best["m"]["currency"]), F.lit(""), _text(F.get(p["categories"], F.lit(0))), F.coalesce(F.transform(p["tags"], lambda t: F.trim(t)), _none_array()), text.clean_html(_text(p["excerpt"])), link)

    store = (doc["collection"]["typeName"] == "products") | (doc["collection"]["type"] == "13")
    return F.when(store, F.transform(F.filter(doc["items"], lambda p: _text(p["title"]) != ""), one))


def lightspeed(payload: Column, origin: Column) -> Column:
    """Products of a collection, given as a list or by id, in the shop's currency."""
    doc = F.from_json(payload, LIGHTSPEED)
    raw, shop = doc["collection"]["products"], doc["shop"]
    items = F.when(raw.startswith("{"), F.map_values(F.from_json(raw, f"map<string,{_LIGHTSPEED_ITEM}>"))).otherwise(F.from_json(raw, f"array<{_LIGHTSPEED_ITEM}>"))
    code = F.when(shop["currency2"].startswith("{"), _code(F.get_json_object(shop["currency2"], "$.code"))).otherwise(_code(shop["currency"]))

    def one(p: Column) -> Column:
        amount = F.coalesce(F.get_json_object(p["price"], "$.price_incl"), F.get_json_object(p["price"], "$.price"))
        path = _text(p["url"])
        return _product(F.coalesce(F.nullif(_text(p["fulltitle"]), F.lit("")), _text(p["title"])), price.parse_price(amount), amount, _none(), code, _text(F.get_json_object(p["brand"], "$.title")), F.lit(""), _none_array(), text.clean_html(_text(p["description"])), F.when(path != "", F.concat(origin, F.lit("/"), F.regexp_replace(path, "^/+", ""))).otherwise(""))

    return F.transform(items, one)


def shopify(payload: Column, origin: Column) -> Column:
    """Products of a feed page at their least variant price; tags are a list or text parted by commas."""
    def one(p: Column) -> Column:
        least = F.array_min(F.filter(F.transform(p["variants"], lambda v: F.struct(price.parse_price(v["price"]).alias("n"), v["price"].alias("raw"))), lambda v: v["n"].isNotNull()))
        listed = F.from_json(p["tags"], "array<string>")
        tags = F.when(p["tags"].startswith("["), listed).when(_text(p["tags"]) != "", F.transform(F.split(p["tags"], ","), lambda t: F.trim(t))).otherwise(_none_array())
        link = F.when((_text(p["handle"]) != "") & (origin != ""), F.concat(origin, F.lit("/products/"), p["handle"])).otherwise("")
        return _product(_text(p["title"]), least["n"], least["raw"], _none(), F.lit(""), _text(p["vendor"]), _text(p["product_type"]), F.coalesce(tags, _none_array()), text.clean_html(_text(p["body_html"])), link)

    return F.transform(F.from_json(payload, SHOPIFY)["products"], one)


def _feed(name: str, parse: Callable[[Column, Column], Column], payloads: list[str], expected: list[tuple], doc: str) -> None:
    rows = [(i, "https://a.com", p) for i, p in enumerate(payloads)]
    fixture(name, "page bigint, origin string, payload string", rows, f"page bigint, {PRODUCT}", expected, lambda df: df.select("page", F.inline(parse(c("payload"), c("origin")))), doc)


_feed("shopify_feed", shopify, [
    '{"products":[{"title":"Ava Sweater","handle":"ava","body_html":"<p>Soft &amp; warm</p>","vendor":"Tango","product_type":"Sweaters","tags":["knit","fw25"],"variants":[{"price":"98.00"},{"price":"89.50"}]},{"title":"Bea","handle":"","tags":"a, b","variants":[]}]}', "broken", '{"products":[]}',
], [(0, "Ava Sweater", 89.5, "89.50", None, "", "Tango", "Sweaters", "knit|fw25", "Soft & warm", "https://a.com/products/ava"), (0, "Bea", None, "", None, "", "", "", "a|b", "", "")], "Products of the most used platform's feed (X1).")
_feed("bigcartel_feed", bigcartel, [
    '[{"name":"Moon Hat","price":24.5,"url":"/product/moon-hat","description":"<b>Wool</b>","categories":[{"name":"Hats"},{"name":"New"}],"artists":[{"name":"Ann"},{"name":"Lee"}]},{"name":"","price":1},{"name":"Free Pin","price":0,"url":"https://b.com/pin"}]', "[]", '{"error":1}',
], [(0, "Moon Hat", 24.5, "24.5", None, "", "Ann, Lee", "Hats", "Hats|New", "Wool", "https://a.com/product/moon-hat"), (0, "Free Pin", None, "0", None, "", "", "", "", "", "https://b.com/pin")], "Products of an unpaged shop list (X2).")
_feed("magento_feed", magento, [
    '{"errors":[{"message":"x"}],"data":{"products":{"page_info":{"total_pages":3},"items":[{"name":"Caf&eacute; Coat","url_key":"cafe-coat","categories":[{"name":"Coats &amp; More"},{"name":"New"},{"name":"New"}],"description":{"html":"<p>Long</p>"},"price_range":{"minimum_price":{"final_price":{"value":149.9,"currency":"eur"}}}},{"name":"Bare","canonical_url":"/bare.html"},{"name":null}]}}}', '{"data":{"products":null}}',
], [(0, "Café Coat", 149.9, "149.9", None, "EUR", "", "Coats & More", "Coats & More|New", "Long", "https://a.com/cafe-coat.html"), (0, "Bare", None, "", None, "", "", "", "", "", "https://a.com/bare.html")], "Items of a GraphQL answer (X3).")
_feed("woocommerce_feed", woocommerce, [
    '[{"name":"Fish &amp; Knit","permalink":"https://a.com/p/fish","short_description":"","description":"<p>A</p>","prices":{"price":"22900","currency_code":"USD","currency_minor_unit":2},"categories":[{"name":"Tops &#8211; Knit"}],"brands":[{"name":"Ann"},{"name":"Lee"}],"tags":[{"name":"x &amp; y"}]},{"name":"Yen","prices":{"price":"500","currency_code":"JPY","currency_minor_unit":0}},{"name":"None","prices":{"price":""}}]',
], [(0, "Fish & Knit", 229.0, "22900", 2, "USD", "Ann, Lee", "Tops – Knit", "x & y", "A", "https://a.com/p/fish"), (0, "Yen", 500.0, "500", 0, "JPY", "", "", "", "", ""), (0, "None", None, "", 0, "", "", "", "", "", "")], "Products priced in minor units (X4).")
_feed("squarespace_feed", squarespace, [
    '{"collection":{"typeName":"products"},"items":[{"title":"Cape","fullUrl":"/shop/cape","excerpt":"<p>Wide</p>","categories":["Capes"],"tags":["t1","t2"],"structuredContent":{"variants":[{"priceMoney":{"value":"120.00","currency":"USD"}},{"priceMoney":{"value":"99.00","currency":"USD"}},{"priceMoney":null}]}},{"title":"Wrap","structuredContent":{"variants":[],"priceMoney":{"value":"45.00","currency":"cad"}}},{"title":""}],"pagination":{"nextPage":true,"nextPageOffset":"1700"}}',
    '{"collection":{"type":13},"items":[{"title":"Old","variants":[{"priceMoney":{"value":"10.00","currency":"USD"}}]}]}', '{"collection":{"typeName":"blog"},"items":[{"title":"Post"}]}',
], [(0, "Cape", 99.0, "99.00", None, "USD", "", "Capes", "t1|t2", "Wide", "https://a.com/shop/cape"), (0, "Wrap", 45.0, "45.00", None, "CAD", "", "", "", "", ""), (1, "Old", 10.0, "10.00", None, "USD", "", "", "", "", "")], "Items of a products collection at their cheapest variant (X5).")
_feed("lightspeed_feed", lightspeed, [
    '{"shop":{"currency":"x","currency2":{"code":"eur"}},"collection":{"page_next":2,"products":{"11":{"title":"Vest","fulltitle":"Ann Vest","url":"/vest.html","description":"<i>V</i>","price":{"price":80.5,"price_incl":99.95},"brand":{"title":"Ann"}}}}}', '{"shop":{"currency":"usd"},"collection":{"products":[{"title":"Polo","url":"polo","price":{"price":20},"brand":false}]}}', '{"collection":{}}',
], [(0, "Ann Vest", 99.95, "99.95", None, "EUR", "Ann", "", "", "V", "https://a.com/vest.html"), (1, "Polo", 20.0, "20", None, "USD", "", "", "", "", "https://a.com/polo")], "Products of a collection, listed or by id (X6).")

cases("feed_paging", "kind string, payload string", "next bigint", [
    ("magento", '{"data":{"products":{"page_info":{"total_pages":7}}}}', 7), ("magento", '{"data":null}', 1), ("squarespace", '{"pagination":{"nextPage":true,"nextPageOffset":1700}}', 1700), ("squarespace", '{"pagination":{"nextPage":false,"nextPageOffset":1700}}', None), ("squarespace", '{"pagination":{"nextPage":true,"nextPageOffset":"x"}}', None),
    ("lightspeed", '{"collection":{"page_next":2}}', 2), ("lightspeed", '{"collection":{"page_next":0}}', None), ("lightspeed", '{"collection":{"page_next":false}}', None),
], lambda: {"next": F.when(c("kind") == "magento", F.coalesce(F.get_json_object("payload", "$.data.products.page_info.total_pages").try_cast("long"), F.lit(1)))
            .when(c("kind") == "squarespace", F.when(F.get_json_object("payload", "$.pagination.nextPage") == "true", F.get_json_object("payload", "$.pagination.nextPageOffset").try_cast("long")))
            .otherwise(F.when(F.get_json_object("payload", "$.collection.page_next").try_cast("long") > 0, F.get_json_object("payload", "$.collection.page_next").try_cast("long")))}, "Pages of feeds still to come (X3, X5, X6).")
