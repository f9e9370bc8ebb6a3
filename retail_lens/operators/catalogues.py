"""Products in JSON and in product cards. A document becomes rows of nodes, and what a product is, is joins and aggregates over them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dom
from ..functions.price import parse_price
from ..functions.url import absolute
from ..scratch import saved

c = F.col
# Keys of product-like objects, in the order in which they are tried.
STATE_TITLES = ("name", "title", "productName", "product_name")
STATE_PRICES = ("price", "salePrice", "sale_price", "currentPrice", "priceValue", "amount")
STATE_AMOUNTS = ("amount", "value", "price")
STATE_IDS = ("url", "href", "slug", "handle", "sku", "id", "productId", "product_id")
JSON_TITLES = ("name", "title", "productName", "product_name", "displayName", "display_name")
JSON_PRICES = (
    "price", "salePrice", "sale_price", "finalPrice", "final_price", "currentPrice", "current_price", "minPrice", "min_price", "price_range", "priceRange", "prices", "regularPrice", "regular_price", "amount",
)
JSON_CENTS = ("priceCents", "price_cents", "priceInCents", "price_in_cents", "amountCents", "amount_cents", "salePriceCents", "sale_price_cents")
JSON_LINKS = ("url", "href", "link", "permalink", "productUrl", "product_url", "canonical_url")
JSON_CURRENCIES = ("currency", "currencyCode", "currency_code", "priceCurrency")
JSON_NESTED = ("value", "amount", "price", "final_price", "minimum_price", "min", "raw")
# Where pages keep the state of their application, and the marks of a product card, its price and what is for screen readers alone.
JSON_SCRIPT = r"""(?is)<script[^>]+type=["']application/json["'][^>]*>(.*?)</script>"""
STATE_MARK = r"(?i)window\.(?:__INITIAL_STATE__|__PRELOADED_STATE__|__APOLLO_STATE__|__NUXT__)\s*=\s*"
CARD, CARD_TITLE, CARD_BRANDS, CARD_PRICES, UNSEEN = "card", "card-title", ("card-brand", "product-brand"), ("data-product-price-without-tax", "data-product-price-with-tax"), ("sr-only", "is-srOnly", "price-label")
#: A list is a catalogue if so many of its objects, and so large a share, look like products; how deep lists are looked for; products of one page's state.
LEAST, SHARE, DEPTH, MOST_STATE = 2, 0.6, 8, 200

NODES = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("path", T.ArrayType(T.StringType())), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]))
ELEMENTS = T.ArrayType(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("tag", T.StringType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType())), T.StructField("text", T.StringType())]))


@F.pandas_udf(NODES)
def json_nodes(texts: pd.Series) -> pd.Series:
    """All values of the JSON that a text begins with, in order: path (steps are ``.key`` or ``#place``), kind, and a scalar's text or the size of an object or array. Nothing of what is no JSON."""
    kinds = {dict: "object", list: "array", str: "string", int: "number", float: "number", bool: "boolean", type(None): "null"}

    def one(text: str | None) -> list[tuple]:
        try:
            top = json.JSONDecoder().raw_decode((text or "").lstrip())[0]
        except (ValueError, RecursionError):
            return []
        out, todo = [], [([], top)]
        while todo:
            path, x = todo.pop()
            below = [(f".{k}", v) for k, v in x.items()] if isinstance(x, dict) else [(f"#{i}", v) for i, v in enumerate(x)] if isinstance(x, list) else None
            out.append((len(out), path, kinds[type(x)], str(x if below is None else len(below)).strip() if x is not None else ""))
            todo.extend((path + [step], v) for step, v in reversed(below or []))
        return out

    return texts.map(one)


@F.pandas_udf(ELEMENTS)
def elements(html: pd.Series) -> pd.Series:
    """Elements and texts (of tag "") of pages in order: n, the last n below it, tag, attributes, text. What is below an element is what stands from n + 1 to last."""
    def one(page: str | None) -> list[tuple]:
        out: list[list] = []
        todo: list[tuple] = [(dom.parse(page), None)]
        while todo:
            node, closes = todo.pop()
            if closes is not None:
                out[closes][1] = len(out) - 1
                continue
            n, text = len(out), isinstance(node, str)
            out.append([n, n, "" if text else node.tag, {} if text else node.attrs, node if text else ""])
            if not text:
                todo.append((None, n))
                todo.extend((x, None) for x in reversed(node.children))
        return [tuple(x) for x in out]

    return html.map(one)


def objects(nodes: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """(keys, owner, at, fields): each JSON object by its path, where it stands, and what is up to ``reach`` steps below it as (path from it, kind, value). Grouped by object: a row holds no more than one has."""
    steps = F.sequence(F.when(c("kind") == "object", 0).otherwise(1), F.least(F.size("path"), F.lit(reach)))
    each = nodes.where((F.size("path") > 0) | (c("kind") == "object")).withColumn("r", F.explode(steps))
    cut = F.size("path") - c("r")
    rel = F.slice("path", cut + 1, c("r"))
    each = each.select(*keys, F.slice("path", 1, cut).alias("owner"), c("r"), F.struct(rel.alias("path"), "kind", "value").alias("f"), "at").where((c("r") == 0) | F.get("f.path", F.lit(0)).startswith("."))
    return each.groupBy(*keys, "owner").agg(F.min("at").alias("at"), F.collect_list(F.when(c("r") > 0, c("f"))).alias("fields"), F.bool_or(c("r") == 0).alias("is_object")).where("is_object").drop("is_object")


def _place(names: tuple[str, ...], step: Column) -> Column:
    """Where a step stands among names, from 1; 0 if it is none."""
    return F.array_position(F.array(*(F.lit(f".{n}") for n in names)), step)


def _first(names: tuple[str, ...], test) -> Column:
    """The field of the first of ``names`` that an object has and ``test`` holds for: struct(place, path, kind, value)."""
    own = F.filter("fields", lambda f: (F.size(f["path"]) == 1) & (_place(names, F.get(f["path"], F.lit(0))) > 0) & test(f))
    return F.array_min(F.transform(own, lambda f: F.struct(_place(names, F.get(f["path"], F.lit(0))).alias("place"), f["path"].alias("path"), f["kind"].alias("kind"), f["value"].alias("value"))))


def _code(value: Column) -> Column:
    return F.when(F.trim(value).rlike("^[A-Za-z]{3}$"), F.upper(F.trim(value)))


def _filled(f: Column) -> Column:
    """Whether a field has anything in it."""
    return ~((f["kind"] == "null") | (f["kind"] == "string") & (f["value"] == "") | f["kind"].isin("object", "array") & (f["value"] == "0"))


def _ancestors(df: DataFrame, path: str) -> DataFrame:
    """Rows of ``df`` times the paths above ``path``."""
    return df.withColumn("above", F.explode(F.when(F.size(path) > 0, F.transform(F.sequence(F.lit(0), F.size(path) - 1), lambda n: F.slice(path, 1, n)))))


def captured(df: DataFrame, keys: list[str], payload: Column, page: Column) -> DataFrame:
    """(keys, title, price_raw, minor, currency, url): products in captured JSON: the objects of lists, not too deep, most of which have a title and a price.

    Every object of a list is priced by itself: by the first price key that it has, down the first of the nested keys that lead to a text or number, with
    the currency that stands nearest to it; else by a number in cents. One without a price takes the least of its ``variants``, which are objects of a list too. Lists inside an accepted list are not looked at.
    """
    nodes = df.select(*keys, page.alias("_page"), F.inline(json_nodes(payload)))
    o = objects(nodes, [*keys, "_page"], 4).where(F.startswith(F.try_element_at("owner", F.lit(-1)), F.lit("#")))
    scalar = lambda f: f["kind"].isin("string", "number") & (f["value"] != "")
    key = F.get(_first(JSON_PRICES, lambda f: F.lit(True))["path"], F.lit(0))
    leads = lambda f: (F.get(f["path"], F.lit(0)) == c("key")) & F.forall(F.slice(f["path"], 2, 3), lambda s: (s == "#0") | (_place(JSON_NESTED, s) > 0))
    ways = F.transform(F.filter("fields", lambda f: leads(f) & scalar(f)), lambda f: F.struct(F.transform(F.slice(f["path"], 2, 3), lambda s: _place(JSON_NESTED, s)).alias("rank"), f["value"].alias("value"), f["path"].alias("path")))
    o = o.withColumn("key", key).withColumn("way", F.array_min(ways))
    above = lambda f: F.slice(c("way.path"), 1, F.size(f["path"]) - 1) == F.slice(f["path"], 1, F.size(f["path"]) - 1)
    codes = F.filter("fields", lambda f: (F.size(f["path"]) > 1) & (F.size(f["path"]) <= F.size("way.path")) & (_place(JSON_CURRENCIES, F.try_element_at(f["path"], F.lit(-1))) > 0) & _code(f["value"]).isNotNull() & above(f))
    near = F.array_max(F.transform(codes, lambda f: F.struct(F.size(f["path"]).alias("n"), (-_place(JSON_CURRENCIES, F.try_element_at(f["path"], F.lit(-1)))).alias("place"), _code(f["value"]).alias("code"))))["code"]
    cents = _first(JSON_CENTS, lambda f: f["kind"] == "number")["value"]
    amount = parse_price(c("way.value"))
    own = F.when(amount.isNotNull(), F.struct(amount.alias("price"), c("way.value").alias("raw"), F.lit(0).alias("minor"), F.coalesce(near, F.lit("")).alias("code"))).when(cents.try_cast("double") > 0, F.struct((cents.try_cast("double") / 100).alias("price"), cents.alias("raw"), F.lit(2).alias("minor"), F.lit("").alias("code")))
    title = F.trim(_first(JSON_TITLES, lambda f: f["kind"] == "string")["value"])
    items = o.select(
        *keys, "_page", "owner", F.slice("owner", 1, F.size("owner") - 1).alias("list"), F.when(F.length(title).between(2, 300), title).alias("title"), own.alias("money"),
        F.coalesce(_code(_first(JSON_CURRENCIES, lambda f: _code(f["value"]).isNotNull())["value"]), F.lit("")).alias("code"), F.coalesce(_first(JSON_LINKS, lambda f: (f["kind"] == "string") & (f["value"] != ""))["value"], F.lit("")).alias("link"))
    items = saved(items, "items")
    cheapest = items.where((F.try_element_at("list", F.lit(-1)) == ".variants") & c("money").isNotNull()).groupBy(*keys, F.slice("list", 1, F.size("list") - 1).alias("owner")).agg(F.min("money").alias("variant"))
    items = items.join(cheapest, [*keys, "owner"], "left").withColumn("money", F.coalesce("money", "variant"))
    of_list = Window.partitionBy(*keys, "list")
    found = c("title").isNotNull() & c("money").isNotNull()
    items = items.withColumns({"all": F.count("*").over(of_list), "good": F.count_if(found).over(of_list)})
    products = items.where(found & (c("good") >= LEAST) & (c("good") >= SHARE * c("all")) & (F.size("list") <= DEPTH))
    lists = products.select(*keys, "list").distinct()
    inside = _ancestors(lists, "list").join(lists.withColumnRenamed("list", "above"), [*keys, "above"], "left_semi").select(*keys, "list").distinct()
    products = products.join(inside, [*keys, "list"], "left_anti")
    return products.select(*keys, "title", c("money.raw").alias("price_raw"), c("money.minor").alias("minor"), F.coalesce(F.nullif("money.code", F.lit("")), "code").alias("currency"), F.when(c("link") != "", absolute(c("_page"), c("link"))).otherwise("").alias("url"))


def app_state(df: DataFrame, keys: list[str], html: Column, page: Column) -> DataFrame:
    """(keys, title, price_raw, currency, vendor, url) of the outermost objects in a page's application state that have a title, an id and a price; MOST_STATE of a page at most, in order."""
    texts = F.concat(F.regexp_extract_all(html, F.lit(JSON_SCRIPT), 1), F.slice(F.split(html, STATE_MARK, -1), 2, 1000))
    nodes = df.where(html.rlike(f"{JSON_SCRIPT}|{STATE_MARK}")).select(*keys, page.alias("_page"), F.posexplode(texts).alias("block", "text")).select(*keys, "_page", "block", F.inline(json_nodes("text")))
    o = objects(nodes, [*keys, "_page", "block"], 2)
    under = lambda step, names: F.array_min(F.transform(F.filter("fields", lambda f: (F.size(f["path"]) == 2) & (F.get(f["path"], F.lit(0)) == step) & (_place(names, F.get(f["path"], F.lit(1))) > 0) & _filled(f)), lambda f: F.struct(_place(names, F.get(f["path"], F.lit(1))).alias("place"), f["value"].alias("value"))))["value"]
    own = lambda *names: _first(names, _filled)["value"]
    o = o.withColumns({"name": _first(STATE_TITLES, _filled), "money": _first(STATE_PRICES, _filled), "link": _first(("url", "href"), _filled)})
    amount = F.when(c("money.kind") == "object", under(F.get(c("money.path"), F.lit(0)), STATE_AMOUNTS)).when(c("money.kind").isin("string", "number"), c("money.value"))
    code = F.coalesce(own("currency", "currencyCode"), F.when(c("money.kind") == "object", under(F.get(c("money.path"), F.lit(0)), ("currencyCode", "currency"))))
    brand = _first(("brand", "vendor"), _filled)
    vendor = F.when(brand["kind"] == "object", under(F.get(brand["path"], F.lit(0)), ("name", "@value"))).when(brand["kind"].isin("string", "number"), brand["value"])
    part = _first(("urlPart",), lambda f: f["kind"] == "string")["value"]
    priced = F.exists("fields", lambda f: f["path"] == F.array(F.lit(".formattedPrice")))
    link = F.when(c("link").isNull() & part.isNotNull() & priced, absolute(c("_page"), F.concat(F.lit("/product-page/"), part))).when(c("link.kind") == "string", c("link.value"))
    o = o.select(*keys, "block", "owner", "at", F.when((c("name.kind") == "string"), F.nullif(F.trim("name.value"), F.lit(""))).alias("title"), amount.alias("price_raw"), F.coalesce(_code(code), F.lit("")).alias("currency"), F.coalesce(vendor, F.lit("")).alias("vendor"), F.when(link.startswith("http"), link).otherwise(c("_page")).alias("url"), _first(STATE_IDS, _filled).isNotNull().alias("known"))
    p = saved(o.where(c("title").isNotNull() & c("known") & parse_price(c("price_raw")).isNotNull()), "state")
    inner = _ancestors(p.select(*keys, "block", "owner"), "owner").join(p.select(*keys, "block", c("owner").alias("above")), [*keys, "block", "above"], "left_semi").select(*keys, "block", "owner").distinct()
    outer = p.join(inner, [*keys, "block", "owner"], "left_anti").withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("block", "at"))).where(c("k") <= MOST_STATE)
    return outer.select(*keys, "title", "price_raw", "currency", "vendor", "url")


def cards(df: DataFrame, keys: list[str], html: Column, page: Column) -> DataFrame:
    """(keys, title, price_raw, vendor, url) of product cards: elements of the class of cards with a linked title and a tagged price; the price without what is for screen readers."""
    e = df.where(html.contains("data-product-price-")).select(*keys, page.alias("_page"), elements(html).alias("all"))
    classed = lambda x, *names: F.arrays_overlap(F.split(F.coalesce(F.try_element_at(x["attrs"], F.lit("class")), F.lit("")), r"\s+"), F.array(*map(F.lit, names)))
    below = lambda x: F.slice(c("all"), x["n"] + 2, x["last"] - x["n"])
    within = lambda x, y: (y["n"] < x["n"]) & (x["n"] <= y["last"])

    def words(x: Column) -> Column:
        unread = F.filter(below(x), lambda y: y["tag"].isin("script", "style", "noscript") | classed(y, *UNSEEN))
        texts = F.filter(below(x), lambda y: (y["tag"] == "") & ~F.exists(unread, lambda u: within(y, u)))
        return F.trim(F.regexp_replace(F.array_join(F.transform(texts, lambda y: y["text"]), " "), r"(?U)\s+", " "))

    def described(card: Column) -> Column:
        titles = F.filter(below(card), lambda x: classed(x, CARD_TITLE))
        link = F.get(F.filter(below(card), lambda x: (x["tag"] == "a") & F.exists(titles, lambda t: within(x, t))), F.lit(0))
        marked = lambda a: F.get(F.filter(below(card), lambda x: F.map_contains_key(x["attrs"], a)), F.lit(0))
        brand = F.coalesce(F.get(F.filter(below(card), lambda x: classed(x, *CARD_BRANDS)), F.lit(0)), F.get(F.filter(below(card), lambda x: F.try_element_at(x["attrs"], F.lit("data-test-info-type")) == "brandName"), F.lit(0)))
        return F.struct(link.alias("link"), F.coalesce(*map(marked, CARD_PRICES)).alias("price"), brand.alias("brand"))

    found = e.select(*keys, "_page", "all", F.explode(F.filter("all", lambda x: classed(x, CARD))).alias("card")).withColumn("d", described(c("card"))).where(c("d.link").isNotNull() & c("d.price").isNotNull())
    href = F.coalesce(F.try_element_at("d.link.attrs", F.lit("href")), F.lit(""))
    return found.select(*keys, words(c("d.link")).alias("title"), words(c("d.price")).alias("price_raw"), F.coalesce(words(c("d.brand")), F.lit("")).alias("vendor"), F.when(href != "", absolute(c("_page"), href)).otherwise("").alias("url")).where("title <> ''")
