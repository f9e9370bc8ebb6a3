"""Products by their own words: knit flags and kinds, items, fibres, gender, category, and what their sources declare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import table
from ..functions import price, product, text
from ..registry import cases, query

c = F.col
#: Endings that turn the names of parts into titles of all kinds, in turn by key.
ENDINGS = ("Sweater", "Cable Knit Vest", "Merino Crew", "Wool Coat", "Sweater Candle", "Cashmere Scarf", "Denim Jumper", "Beanie", "Knit Dress", "Yarn", "Turtleneck", "Sweatshirt Cardigan", "Silk Wool Scarf", "Straw Hat", "Tee")
# Families of fibres.
FAMILIES = {
    "cotton": "cotton", "linen": "cotton", "wool": "wool", "merino": "wool", "yak": "wool", "camel": "wool", "cashmere": "fine", "alpaca": "fine", "mohair": "fine", "silk": "fine", "synthetic": "synthetic", "viscose": "synthetic",
}


def _re(pattern: str) -> str:
    return pattern.replace("(?iU)", "(?i)").replace("'", "''")


def _has(pattern: str) -> str:
    return f"regexp_matches(t, '{_re(pattern)}')"


_KIND_SQL = f"""
CASE WHEN {_has(product.NOT_CLOTHING)} OR ({_has(product.SUPPLIES)} AND NOT {_has(product.CORE)} AND NOT {_has(product.JUMPER)}) THEN ''
     WHEN {_has(product.CORE)} AND NOT {_has(product.NOT_A_SWEATER)} THEN 'garment'
     WHEN NOT {_has(product.CORE)} AND {_has(product.JUMPER)} AND NOT {_has(product.NOT_A_SWEATER_JUMPER)} THEN 'garment'
     WHEN {_has(product.NOT_KNITWEAR)} THEN ''
     WHEN NOT {_has(product.CORE)} AND NOT {_has(product.JUMPER)} AND ({_has(product.TURTLENECK)} OR ({_has(product.KNIT)} AND ({_has(product.TOP)} OR {_has(product.JACKET)})) OR (NOT {_has(product.KNIT)} AND {_has(product.FIBRE)} AND {_has(product.TOP)})) THEN 'garment'
     WHEN {_has(product.ACCESSORY)} AND ({_has(product.ALWAYS_KNIT)} OR {_has(product.KNIT)} OR ({_has(product.FIBRE)} AND NOT {_has(product.WOVEN_ACCESSORY)})) THEN 'accessory' ELSE '' END"""


@query(f"WITH p AS (SELECT p_partkey, p_name || ' ' || list_extract({list(ENDINGS)}, CAST(p_partkey % {len(ENDINGS)} AS INT) + 1) AS t FROM part) SELECT p_partkey, {_KIND_SQL} AS kind FROM p")
def knit_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict kind of every part under a title of some kind."""
    title = F.concat_ws(" ", "p_name", F.get(F.array(*(F.lit(e) for e in ENDINGS)), (c("p_partkey") % len(ENDINGS)).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", product.knit_kind(title).alias("kind"))


cases("knit_titles", "title string, type string", "kind string", [
    ("Cable-Knit Sweater", "", "garment"), ("Sweater Dress", "", "garment"), ("Sweatshirt Cardigan", "", ""), ("Snowed In Sweater Crew Socks", "", ""), ("Lambswool Jumper", "", "garment"), ("Denim Jumper", "", ""), ("Mock Neck", "", "garment"),
    ("Knitted Jacket", "", "garment"), ("Wool Jacket", "", ""), ("Merino Polo", "", "garment"), ("Cashmere Scarf", "", "accessory"), ("Silk Wool Scarf", "", ""), ("Pom-Pom Hat", "", "accessory"), ("Straw Hat", "", ""), ("Sweater Comb", "", ""),
    ("Merino Yarn", "", ""), ("Tape Yarn Sweater", "", "garment"), ("The Ava", "Sweaters", "garment"), ("The Ava Scarf", "Knits", "accessory"), ("The Ava Tee", "Sweaters", ""), ("Dog Sweater", "", ""), (None, None, ""),
], lambda: {"kind": product.knit_kind(c("title"), c("type"))}, "Knitted garments and accessories by title and type (C2).")

cases("knit_flags", "title string, blob string", "knit boolean, terms string", [
    ("Coat", "Coat made of wool", False, "wool"), ("Scarf", "Scarf of wool and Wools", True, "wool"), ("Wool Coat", "Wool Coat with Cardigans inside", True, "wool,cardigan"), ("Top", "cotton top", False, ""), ("Pant", "merino pant", True, "merino"), ("Skirt", "skirt, shawl", False, "shawl"),
], lambda: {"knit": product.is_knit(c("title"), c("blob")), "terms": F.array_join(product.knit_terms(c("blob")), ",")}, "The broad knit flag (C1).")

cases("matched_items", "title string, blob string", "items string", [
    ("Hat", "Hat FW25 of alpaca", "cashmere_wool,fall_winter"), ("Sweater", "Sweater SS '26 with polka dots", "knitwear,spring_summer,other"), ("Tee", "tee in aw colours", "fall_winter"), ("Tee", "fallen tee", ""), ("Tee", "c++ polka dot", "other"),
], lambda: {"items": F.array_join(product.matched_items(c("title"), c("blob"), ("knitwear", "cashmere_wool", "fall_winter", "spring_summer", "other"), ("polka dot", " ")), ",")}, "Items that a run looks for (C3).")

cases("search_phrases", "items string, terms string", "phrase string", [
    ("knitwear,cashmere_wool", "", "sweaters and knitwear, cashmere and wool knitwear"), ("other", "ponchos| capes ", "ponchos, capes"), ("unknown", "", "sweaters and knitwear"), ("fall_winter,other", "x", "fall and winter collections, x"),
], lambda: {"phrase": product.search_phrase(F.split("items", ","), F.split("terms", r"\|"))}, "What a run searches for (F17).")

cases("fibre_lists", "t string", "fibres string, family string", [
    ("70% merino, 30% nylon", "merino,synthetic", "wool"), ("merino wool", "merino", "wool"), ("wool 20%, merino 80 %", "merino,wool", "wool"), ("Lamb's Wool and Pima", "wool,cotton", "wool"), ("40% of acrylic 60% baby alpaca", "alpaca,synthetic", "fine"), ("pure silk", "silk", "fine"), ("plain", "", None), ("50% cotton 50% linen", "cotton,linen", "cotton"),
], lambda: {"fibres": F.array_join(product.materials(c("t")), ","), "family": text.lookup(FAMILIES, F.get(product.materials(c("t")), F.lit(0)))}, "Fibres by stated share, and the family of the first (C8, C15).")

cases("genders", "t string, declared string", "gender string", [
    ("women's knit", "", "women"), ("for women and men", "", "unisex"), ("baby alpaca cardigan", "", ""), ("kids and ladies", "", ""), ("knit", "Male", "men"), ("unisex knit", "", "unisex"), ("Girls", "female", "women"), ("", "", ""),
], lambda: {"gender": product.gender(c("t"), c("declared"))}, "Gender as declared or told (C9).")

cases("categories", "title string, type string", "category string", [
    ("Ava Cardigan Sweater", "", "cardigan"), ("Sweater Vest", "", "vest"), ("Ruana", "Sweaters", "poncho_wrap"), ("Ava", "Dresses", "dress_skirt"), ("Ear Warmer", "", "hat"), ("Snood", "", "scarf"), ("Mittens", "", "gloves"), ("Crew Socks", "", "socks"), ("Mock Neck", "", "sweater"), ("Ava", "Candles", ""),
], lambda: {"category": product.category(c("title"), c("type"))}, "Finer kinds of knitwear (C10).")


def declared(source: Column, raw: Column, amount: Column) -> Column:
    """struct(on_sale, in_stock, compare_at, launched) as each source declares them in its own JSON; null or empty where it says nothing."""
    at = lambda p: F.get_json_object(raw, p)
    variants = F.from_json(at("$.variants"), "array<struct<available:string, compare_at_price:string>>")
    stock = F.filter(F.transform(variants, lambda v: text.flag(v["available"])), lambda x: x.isNotNull())
    was = F.array_max(F.transform(variants, lambda v: price.parse_price(v["compare_at_price"])))
    shopify = source == "shopify_feed"
    markup = source.isin("jsonld", "microdata", "opengraph")
    availability = F.coalesce(F.nullif(F.coalesce(at("$.offers[0].availability"), at("$.offers.availability"), F.lit("")), F.lit("")), at("$['og:availability']"), F.lit(""))
    captured = source.isin("app_state", "render_json")
    on_hand = F.coalesce(at("$.onHand"), at("$.in_stock"))
    on_sale = F.when(shopify, F.coalesce(was > amount, F.lit(False))).when(source == "woocommerce_feed", text.flag(at("$.on_sale"))).when(source == "squarespace_feed", text.flag(at("$.onSale"))).when(source == "bigcartel_feed", text.flag(at("$.on_sale"))).when(captured, text.flag(F.coalesce(at("$.onSale"), at("$.on_sale"))))
    in_stock = (
        F.when(shopify, F.when(F.size(stock) > 0, F.exists(stock, lambda x: x))).when(source == "woocommerce_feed", text.flag(at("$.is_in_stock"))).when(source == "lightspeed_feed", text.flag(at("$.available")))
        .when(captured & on_hand.isNotNull(), ~on_hand.isin("false", "0", "")).when(markup & (availability != ""), F.replace(F.lower(availability), F.lit(" "), F.lit("")).contains("instock"))
    )
    added = at("$.addedOn").try_cast("long")
    launched = F.when(shopify, F.coalesce(F.nullif(at("$.published_at"), F.lit("")), at("$.created_at"))).when(source == "bigcartel_feed", at("$.created_at")).when((source == "squarespace_feed") & (added > 0), F.timestamp_millis(added).cast("date").cast("string"))
    return F.struct(on_sale.alias("on_sale"), in_stock.alias("in_stock"), F.when(shopify, was).alias("compare_at"), F.coalesce(F.left(launched, F.lit(10)), F.lit("")).alias("launched"))


cases("declared_attributes", "source string, raw string, amount double", "on_sale boolean, in_stock boolean, compare_at double, launched string", [
    ("shopify_feed", '{"published_at":"2026-01-02T00:00:00Z","variants":[{"available":false,"compare_at_price":"120.00"},{"available":true}]}', 98.0, True, True, 120.0, "2026-01-02"), ("shopify_feed", '{"created_at":"2025-05-06","variants":[{"available":false,"compare_at_price":null}]}', 98.0, False, False, None, "2025-05-06"), ("shopify_feed", '{"variants":[]}', 98.0, False, None, None, ""),
    ("woocommerce_feed", '{"is_in_stock":true,"on_sale":false}', 1.0, False, True, None, ""), ("squarespace_feed", '{"onSale":true,"addedOn":1760918400000}', 1.0, True, None, None, "2025-10-20"), ("lightspeed_feed", '{"available":"soldout"}', 1.0, None, False, None, ""), ("bigcartel_feed", '{"on_sale":true,"created_at":"2026-02-03T09:00:00"}', 1.0, True, None, None, "2026-02-03"),
    ("app_state", '{"onSale":false,"onHand":0}', 1.0, False, False, None, ""), ("render_json", '{"on_sale":"yes","in_stock":3}', 1.0, True, True, None, ""), ("jsonld", '{"offers":[{"availability":"https://schema.org/InStock"}]}', 1.0, None, True, None, ""), ("microdata", '{"offers":{"availability":"Out Of Stock"}}', 1.0, None, False, None, ""), ("opengraph", '{"og:availability":"in stock"}', 1.0, None, True, None, ""), ("other", "{}", 1.0, None, None, None, ""),
], lambda: {k: declared(c("source"), c("raw"), c("amount"))[k] for k in ("on_sale", "in_stock", "compare_at", "launched")}, "Sale, stock and launch by source (C11, X27).")


@query(f"""
WITH p AS (SELECT p_partkey, list_extract({list(ENDINGS)}, CAST(p_partkey % {len(ENDINGS)} AS INT) + 1) AS t, p_partkey % 3 AS g FROM part),
k AS (SELECT p_partkey, g, {_KIND_SQL} AS kind, CASE WHEN regexp_matches(t, '(?i)\\bmerino\\b') THEN 'merino' WHEN regexp_matches(t, '(?i)\\bcashmere\\b') THEN 'cashmere' WHEN regexp_matches(t, '(?i)\\bsilk wool\\b') THEN 'silk' WHEN regexp_matches(t, '(?i)\\bwool\\b') THEN 'wool' WHEN regexp_matches(t, '(?i)\\bdenim|candle') THEN '' ELSE '' END AS main FROM p)
SELECT kind, main AS main_material, CASE g WHEN 0 THEN 'women' WHEN 1 THEN 'unisex' ELSE 'men' END AS gender, count(*) AS products FROM k GROUP BY 1, 2, 3""")
def product_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts, under titles and descriptions of many kinds, by kind, main material and gender."""
    title = F.get(F.array(*(F.lit(e) for e in ENDINGS)), (c("p_partkey") % len(ENDINGS)).cast("int"))
    who = F.get(F.array(F.lit("for ladies"), F.lit("women and men"), F.lit("men's")), (c("p_partkey") % 3).cast("int"))
    p = table(spark, sf_dir, "part").select(product.knit_kind(title).alias("kind"), F.coalesce(F.get(product.materials(title), F.lit(0)), F.lit("")).alias("main_material"), product.gender(F.concat_ws(" ", title, who)).alias("gender"))
    return p.groupBy("kind", "main_material", "gender").agg(F.count("*").alias("products"))
