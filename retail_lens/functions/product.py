"""What a product is, by its own words: knitwear, fibres, gender, category."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lookup


def words(*alternatives: str) -> str:
    """A pattern of whole words in any case."""
    return r"(?iU)\b(?:" + "|".join(alternatives) + r")\b"


# Words of the broad knit flag; weak ones also stand on woven goods.
KNIT_TERMS = ("knit", "knitwear", "sweater", "cardigan", "pullover", "jumper", "cashmere", "merino", "wool", "crewneck", "turtleneck", "sweatshirt", "poncho", "shawl")
WEAK_TERMS = ("wool", "shawl")
WOVEN = words("coat", "jacket", "blazer", "trouser", "trousers", "pant", "pants", "bag", "blanket", "rug", "skirt", "short", "shorts", "jean", "jeans", "denim", "vest")
# Words of the strict knit kind.
CORE = words(r"sweaters?", r"cardigans?", r"cardis?", r"pullovers?", r"knitwear", r"ponchos?", r"shrugs?")
JUMPER = words(r"jumpers?")
NOT_A_SWEATER_JUMPER = words(r"overalls?", r"denim", r"jumpsuits?", r"rompers?", r"pinafores?", r"smock", r"dungarees?", r"jeans?")
TURTLENECK = words(r"turtle[\s-]?necks?", r"mock[\s-]?necks?", r"roll[\s-]?necks?", r"polo[\s-]?necks?")
KNIT = words(r"knit", r"knits", r"knitted", r"hand[\s-]?knit", r"cable[\s-]?knit", r"crochet(?:ed)?")
FIBRE = words(r"cashmere", r"merino", r"alpaca", r"mohair", r"lambswool", r"wool", r"angora", r"yak", r"cashwool", r"camel hair")
TOP = words(
    r"tops?", r"vests?", r"polos?", r"hood(?:ie|y)s?", r"crew(?:[\s-]?neck)?s?", r"v[\s-]?necks?", r"henleys?", r"tunics?", r"wraps?", r"dusters?", r"capes?", r"kimonos?",
    r"(?:quarter|half|full)[\s-]?zips?", r"zip[\s-]?ups?", r"sleeveless",
)
JACKET = words(r"jackets?", r"shackets?")
ACCESSORY = words(
    r"beanies?", r"toques?", r"tuques?", r"scar(?:f|ves)", r"snoods?", r"cowls?", r"mittens?", r"gloves?", r"hats?", r"headbands?", r"ear[\s-]?warmers?", r"balaclavas?", r"shawls?",
    r"wraps?", r"leg[\s-]?warmers?", r"arm[\s-]?warmers?",
)
ALWAYS_KNIT = words(r"beanies?", r"toques?", r"tuques?", r"pom[\s-]?pom")
WOVEN_ACCESSORY = words(r"silk", r"satin", r"linen", r"leather", r"felt", r"straw", r"suede")
NOT_KNITWEAR = words(
    r"tees?", r"t[\s-]?shirts?", r"tshirts?", r"tanks?", r"camis?", r"camisoles?", r"bodysuits?", r"leggings?", r"pants?", r"trousers?", r"joggers?", r"sweatpants?", r"shorts?", r"skirts?",
    r"skorts?", r"jeans?", r"denim", r"blazers?", r"coats?", r"overcoats?", r"peacoats?", r"parkas?", r"shirts?", r"overshirts?", r"shackets?", r"dress(?:es)?", r"jumpsuits?",
    r"rompers?", r"socks?", r"bras?", r"bralettes?", r"briefs?", r"underwear", r"boxers?", r"swim\w*", r"bikinis?", r"pajamas?", r"pyjamas?", r"sleep\w*", r"robes?", r"sweatshirts?",
    r"slippers?", r"boots?", r"shoes?", r"sneakers?",
)
NOT_CLOTHING = words(
    r"combs?", r"shavers?", r"defuzzers?", r"candles?", r"ornaments?", r"mugs?", r"books?", r"gift\s?cards?", r"stickers?", r"keychains?", r"blankets?", r"throws?", r"pillows?",
    r"cushions?", r"rugs?", r"coasters?", r"toys?", r"dolls?", r"storage", r"needles?", r"skeins?", r"soap", r"detergent", r"pets?", r"totes?", r"bags?", r"dog\s(?:sweaters?|jumpers?)",
)
SUPPLIES = words(r"yarns?", r"patterns?", r"kits?", r"knitting", r"wash")
NOT_A_SWEATER = words(r"sweatshirts?", r"socks?", r"t[\s-]?shirt\s+cardigans?")
CORE_TYPE = words(r"sweaters?", r"cardigans?", r"pullovers?", r"knitwear", r"knits", r"jumpers?", r"knit tops?")
# Items that a run may look for, with their search phrases and words.
ITEMS = {
    "knitwear": ("sweaters and knitwear", ()),
    "cashmere_wool": ("cashmere and wool knitwear", ("cashmere", "merino", "alpaca", "mohair", "lambswool", "wool", "yak", "angora")),
    "fall_winter": ("fall and winter collections", ("fall", "autumn", "winter", "holiday", "fw", "aw")),
    "spring_summer": ("spring and summer collections", ("spring", "summer", "resort", "ss")),
}
SEASON_CODE = r"(?:\s?'?\d{2,4})?"
# Fibres and the words that name them, and their families.
FIBRES = {
    "cashmere": ("cashmere",), "merino": ("merino",), "wool": ("wool", "lambswool", "lamb's wool", "shetland", "shetland wool"), "alpaca": ("alpaca", "baby alpaca"), "mohair": ("mohair",),
    "yak": ("yak",), "camel": ("camel hair", "camelhair"), "silk": ("silk",), "cotton": ("cotton", "pima", "supima"), "linen": ("linen",),
    "viscose": ("viscose", "rayon", "modal", "lyocell", "tencel"), "synthetic": ("acrylic", "polyester", "nylon", "polyamide", "spandex", "elastane"),
}
# Words of genders, and of the finer kinds of knitwear, of which the first that fits counts.
GENDERS = (
    ("kids", r"kids?|child(ren)?|girls?|boys?|baby|babies|toddler|infant|youth"), ("women", r"women'?s?|womens|ladies|lady|female"), ("men", r"men'?s?|mens|male|gentlemen"), ("unisex", r"unisex"),
)
CATEGORIES = (
    ("cardigan", r"cardigans?|cardis?"), ("vest", r"(sweater|knit)\s?vests?|vests?|tanks?"), ("poncho_wrap", r"ponchos?|capes?|shawls?|wraps?|shrugs?|ruanas?"), ("dress_skirt", r"dress(es)?|skirts?"),
    ("hat", r"beanies?|toques?|tuques?|hats?|caps?|headbands?|ear\s?warmers?"), ("scarf", r"scar(f|ves)|snoods?|cowls?"), ("gloves", r"gloves?|mittens?"), ("socks", r"socks?"),
    ("sweater", r"sweaters?|pullovers?|jumpers?|crew(neck)?s?|turtlenecks?|mock\s?necks?|hood(ie|y)s?|tops?"),
)
_FIBRE_OF = {w: f for f, ws in FIBRES.items() for w in ws}
_FIBRE_WORDS = "|".join(sorted(_FIBRE_OF, key=len, reverse=True))


def knit_terms(text: Column) -> Column:
    """Distinct knit terms of a text, in order of first sight."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?iU)\b(" + "|".join(KNIT_TERMS) + r")s?\b"), 1), F.lower))


def is_knit(title: Column, blob: Column) -> Column:
    """Whether a product's text has a knit term: a strong one, or a weak one and no woven garment in the title."""
    terms = knit_terms(blob)
    return (F.size(terms) > 0) & ~(F.forall(terms, lambda t: t.isin(*WEAK_TERMS)) & title.rlike(WOVEN))


def knit_kind(title: Column, product_type: Column | None = None) -> Column:
    """garment, accessory or empty: whether name and category make a product a knitted garment or accessory."""
    t = F.coalesce(title, F.lit(""))
    kind = F.coalesce(product_type, F.lit("")) if product_type is not None else F.lit("")
    core, jumper, knit, fibre = t.rlike(CORE), t.rlike(JUMPER), t.rlike(KNIT), t.rlike(FIBRE)
    garment = (
        F.when(core, ~t.rlike(NOT_A_SWEATER)).when(jumper, ~t.rlike(NOT_A_SWEATER_JUMPER)).when(t.rlike(NOT_KNITWEAR), False)
        .when(t.rlike(TURTLENECK), True).when(knit, t.rlike(TOP) | t.rlike(JACKET)).otherwise(fibre & t.rlike(TOP))
    )
    accessory = ~t.rlike(NOT_KNITWEAR) & t.rlike(ACCESSORY) & (t.rlike(ALWAYS_KNIT) | knit | fibre & ~t.rlike(WOVEN_ACCESSORY))
    by_type = F.when(kind.rlike(CORE_TYPE) & ~t.rlike(NOT_KNITWEAR), F.when(t.rlike(ACCESSORY), "accessory").otherwise("garment")).otherwise("")
    return F.when(t.rlike(NOT_CLOTHING) | t.rlike(SUPPLIES) & ~(core | jumper), "").when(garment, "garment").when(accessory, "accessory").otherwise(by_type)


def _quoted(word: str) -> str:
    return r"\Q" + word.strip() + r"\E" + SEASON_CODE


def matched_items(title: Column, blob: Column, items: tuple[str, ...], terms: tuple[str, ...] = ()) -> Column:
    """The chosen items that a product is, in the order in which they were chosen; ``other`` stands for the operator's own ``terms``."""
    found = []
    for item in items:
        own = [w for w in (terms if item == "other" else ITEMS.get(item, ("", ()))[1]) if w.strip()]
        hit = is_knit(title, blob) if item == "knitwear" else blob.rlike(r"(?iU)\b(?:" + "|".join(_quoted(w) for w in own) + r")s?\b") if own else F.lit(False)
        found.append(F.when(hit, F.lit(item)))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def search_phrase(items: Column, terms: Column) -> Column:
    """What to search for: the phrases of the items, and the operator's own terms if asked for."""
    phrases = F.array_compact(F.transform(items, lambda i: lookup({k: v[0] for k, v in ITEMS.items()}, i)))
    own = F.when(F.array_contains(items, "other"), F.filter(F.transform(terms, lambda x: F.trim(x)), lambda t: t != "")).otherwise(F.array().cast("array<string>"))
    return F.coalesce(F.nullif(F.array_join(F.concat(phrases, own), ", "), F.lit("")), F.lit(ITEMS["knitwear"][0]))


def materials(text: Column) -> Column:
    """Fibres of a text, those with the largest stated share first, then in order of mention; merino wool is one fibre."""
    share_of = rf"(?i)([0-9]{{1,3}})\s?%\s*(?:of\s+)?({_FIBRE_WORDS})|({_FIBRE_WORDS})\s*([0-9]{{1,3}})\s?%"
    part = [F.regexp_extract_all(text, F.lit(share_of), i) for i in (1, 2, 3, 4)]
    either = lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(F.nullif(x, F.lit("")), y))
    shares = F.zip_with(either(part[1], part[2]), either(part[0], part[3]), lambda w, n: F.struct(lookup(_FIBRE_OF, F.lower(w)).alias("f"), n.cast("int").alias("n")))
    named = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)\b({_FIBRE_WORDS})\b"), 1), lambda w: lookup(_FIBRE_OF, F.lower(w))))
    of = lambda f: F.coalesce(F.array_max(F.transform(F.filter(shares, lambda s: s["f"] == f), lambda s: s["n"])), F.lit(0))
    named = F.when(F.array_contains(named, "merino") & ~F.exists(shares, lambda s: s["f"] == "wool"), F.array_remove(named, "wool")).otherwise(named)
    ordered = F.sort_array(F.transform(named, lambda f, i: F.struct((-of(f)).alias("share"), i.alias("i"), f.alias("f"))))
    return F.transform(ordered, lambda x: x["f"])


def gender(text: Column, declared: Column | None = None) -> Column:
    """women, men, kids, unisex or empty: as declared, else as the text says alone, unisex for women and men."""
    t = F.regexp_replace(text, r"(?i)baby\s+(alpaca|cashmere|camel)", "$1")  # a fibre, not a baby
    found = F.array_compact(F.array(*(F.when(t.rlike(words(p)), F.lit(g)) for g, p in GENDERS)))
    out = F.when(F.size(found) == 1, F.get(found, F.lit(0))).when(F.array_contains(found, "women") & F.array_contains(found, "men"), "unisex").otherwise("")
    if declared is not None:
        for g, p in reversed(GENDERS):
            out = F.when(F.coalesce(declared, F.lit("")).rlike(words(p)), g).otherwise(out)
    return out


def category(title: Column, product_type: Column) -> Column:
    """The finer kind of knitwear: the first that the title names, else the first that the type names."""
    out = F.lit("")
    for text in (product_type, title):
        for name, pattern in reversed(CATEGORIES):
            out = F.when(text.rlike(words(pattern)), name).otherwise(out)
    return out
