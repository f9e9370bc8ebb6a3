"""What a page, a store or an answer is: platforms, contacts, challenges, chains, kinds of business."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compact, spaced_key

# Marks of shop platforms, the first that fits.
PLATFORMS = (
    ("shopify", ("cdn.shopify.com", "shopify.theme", "myshopify.com")), ("bigcartel", ('content="big cartel"', "bigcartel.account")), ("squarespace", ("squarespace.com", "static1.squarespace", "data-squarespace")),
    ("wix", ("wixstatic.com", "wix.com", "_wixcssimportrule")), ("bigcommerce", ("bigcommerce.com", "bcdata", "var bcdata")), ("magento", ("/static/frontend/", "x-magento-init", "mage/cookies", "scandipwa")),
    ("woocommerce", ("woocommerce", "wp-content/plugins/woocommerce")), ("lightspeed", ("shoplightspeed", "lightspeedhq", "webshopapp")), ("ecwid", ("ecwid",)), ("wordpress", ("wp-content", "wp-includes")),
)
SHOPIFY_CURRENCY = r'Shopify\.currency\s*=\s*\{[^}]*"active"\s*:\s*"([A-Za-z]{3})"'
BIGCARTEL_CURRENCY = r'bigcartel\.account\.currency\s*=[^;\n]*?"([A-Za-z]{3})"'
META_CURRENCY = (
    r"""(?i)<meta[^>]+property=["'](?:og|product):price:currency["'][^>]+content=["']([^"']+)""", r"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]+property=["'](?:og|product):price:currency""",
)
LD_CURRENCY = r'(?is)<script[^>]*application/ld\+json[^>]*>(?:(?!</script).)*?"priceCurrency"\s*:\s*"([A-Za-z]{3})"'
# Contacts on pages, and what is none.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
ASSET = r"(?i)\.(png|jpe?g|gif|svg|webp|css|js)$"
NOT_A_CONTACT = r"(?i)@(example\.(com|org|net)|(your)?domain\.com|sentry[\w.-]*|[\w.-]*\.wixpress\.com)$"
TEL = r"(?i)tel:([+\d][\d\-().\s]{6,})"
PHONE_TEXT = r"\(?\b\d{3}\)?[\s.\-]\d{3}[\s.\-]\d{4}\b"
SOCIAL_LINKS = {
    "instagram": r"""(?i)https?://(?:www\.)?instagram\.com/[^"'\s>]+""", "facebook": r"""(?i)https?://(?:www\.|m\.)?facebook\.com/[^"'\s>]+""", "tiktok": r"""(?i)https?://(?:www\.)?tiktok\.com/@[^"'\s>]+""",
    "linkedin": r"""(?i)https?://(?:[a-z]{2,3}\.)?linkedin\.com/(?:company|in)/[^"'\s>]+""", "pinterest": r"""(?i)https?://(?:[a-z]{2,3}\.)?pinterest\.[a-z.]+/[^"'\s>]+""",
}
SOCIAL_JUNK = ("sharer", "/share", "intent", "plugins/", "/tr?", "dialog/", "pin/create")
# Marks of challenge pages by vendor, and the statuses and size that they come with.
CHALLENGES = {
    "cloudflare": ("<title>just a moment", "_cf_chl_opt", "cf-chl-", "/cdn-cgi/challenge-platform/h/", "attention required! | cloudflare"), "datadome": ("captcha-delivery.com", "datadome"), "perimeterx": ("px-captcha", "_pxappid"),
    "incapsula": ("_incapsula_resource", "incap_ses"), "sucuri": ("sucuri website firewall", "sucuri_cloudproxy"), "akamai": ("_abck", "bm-verify", "sec-if-cpt"),
}
CHALLENGE_STATUSES, CHALLENGE_CHARS = (200, 301, 302, 303, 307, 308, 403, 429, 503), 60_000
# Chains by the start of their names, and words of a store locator.
KNOWN_CHAINS = ("h m", "macys", "charlotte russe", "windsor", "bealls", "brandy melville", "four seasons", "nordstrom", "dillards", "talbots", "chicos", "anthropologie", "j crew")
LOCATOR = r"(?i)find a store|store locator|all locations|our stores"
CHAINS = (
    "nordstrom", "macys", "dillards", "bloomingdales", "saks", "neiman", "neimanmarcus", "anthropologie", "jcrew", "madewell", "bananarepublic", "gap", "gapfactory", "oldnavy",
    "uniqlo", "zara", "hm", "mango", "revolve", "shopbop", "farfetch", "netaporter", "theoutnet", "ssense", "llbean", "landsend", "talbots", "chicos", "freepeople", "urbanoutfitters",
    "abercrombie", "holtrenfrew", "thebay", "simons", "walmart", "target", "marshalls", "tjmaxx", "kohls", "belk", "vonmaur", "bealls", "dillards", "jcpenney", "lululemon",
    "allsaints", "theory", "ralphlauren", "tommy", "luckybrand", "roots", "reitmans", "penningtons", "suzyshier", "laura", "rw-co", "northernreflections", "aritzia",
    "brooksbrothers", "vineyardvines", "lillypulitzer", "tommybahama", "jmclaughlin", "stjohnknits", "eileenfisher", "isabelmarant", "thewhitecompany", "mrporter",
)
MARKETPLACES = (
    "ebay", "etsy", "poshmark", "mercari", "depop", "thredup", "therealreal", "tise", "garmentory", "lyst", "stylight", "shop.app", "editorialist", "trustpilot", "amazon",
    "wolfandbadger", "shoptiques", "renttherunway", "steals", "thingtesting",
)
# Words of a store's name, pieces of its domain, and phrases of its pages that tell its kind, in order.
NAME_RULES = (
    ("showroom_agency", (r"showroom", r"rep group", r"agency", r"distributors?")), ("promo_corporate", (r"promo(tional)?", r"corporate", r"embroidery", r"screen ?print")),
    ("resort_hotel_club", (r"hotels?", r"resorts?", r"inn", r"lodge", r"golf", r"club", r"marina", r"yacht", r"keeneland", r"racecourse", r"pro ?shop")),
    ("gift_museum", (r"museum", r"gifts?", r"souvenirs?", r"gallery", r"aquarium")),
    ("outdoor_sporting", (r"outfitters?", r"outdoors?", r"ski", r"sports?", r"running", r"surf", r"tackle", r"fly ?shop", r"climbing")),
    ("marketplace_resale", (r"consign(ment|or)?", r"resale", r"thrift", r"exchange", r"pre-?owned", r"second ?hand", r"closet ?exchange")),
    ("non_retail", (
        r"news", r"magazine", r"realty", r"law", r"attorneys?", r"salons?", r"staffing", r"ministr(y|ies)", r"foundation", r"church", r"schools?", r"hospital", r"healthcare", r"tourism", r"visit", r"chamber",
        r"directory", r"podcast", r"capital", r"realestate",
    )),
)
DOMAIN_RULES = (
    ("showroom_agency", ("showroom", "repgroup", "distributor")), ("promo_corporate", ("promotional", "embroidery", "screenprint", "corporategift")),
    ("resort_hotel_club", ("hotel", "resort", "lodge", "golf", "marina", "keeneland", "racecourse", "proshop")), ("gift_museum", ("museum", "giftshop", "souvenir", "aquarium")),
    ("outdoor_sporting", ("outfitter", "outdoor", "skishop", "sportinggoods", "surfshop", "flyshop", "tackle")), ("marketplace_resale", ("consign", "resale", "thrift", "closetexchange", "preowned")),
)
TEXT_RULES = (
    ("showroom_agency", (r"(our|a) showroom", r"rep group", r"sales agency", r"wholesale only", r"trade only", r"we represent")),
    ("promo_corporate", (r"promotional products", r"corporate (gifts|apparel|wear)", r"custom (apparel|embroidery|logo)", r"branded merchandise")),
    ("resort_hotel_club", (r"(our|the) (hotel|resort|inn|lodge|club)'?s? (shop|store|boutique)", r"guests? of (the|our) (hotel|resort|inn)", r"pro shop", r"golf (shop|club|course)", r"country club", r"yacht club")),
    ("gift_museum", (r"museum (shop|store)", r"gift shop", r"souvenirs?", r"visitor cent(er|re)")), ("outdoor_sporting", (r"sporting goods", r"ski (shop|rental)", r"fly fishing", r"outdoor (gear|equipment)")),
    ("marketplace_resale", (r"consignment", r"resale shop", r"thrift (store|shop)", r"gently used", r"pre-?owned designer")),
)
NO_SITE = r"NameResolution|getaddrinfo|nodename nor servname|Name or service not known"
SPENT = r"(?i)insufficient_quota|exceeded your current quota|check your plan and billing"


def first_of(rules, otherwise: Column) -> Column:
    """The value of the first (condition, value) that holds."""
    out = otherwise
    for condition, value in reversed(list(rules)):
        out = F.when(condition, value).otherwise(out)
    return out


def platform(html: Column) -> Column:
    h = F.lower(F.coalesce(html, F.lit("")))
    return first_of(((F.exists(F.array(*(F.lit(m) for m in marks)), lambda m: h.contains(m)), F.lit(name)) for name, marks in PLATFORMS), F.lit("custom/unknown"))


def currency(html: Column) -> Column:
    """struct(currency, source): declared by a shop's script, a price tag or JSON-LD; a symbol never tells."""
    got = lambda p: F.upper(F.regexp_extract(html, p, 1))
    meta = F.coalesce(F.get(F.filter(F.array(*(got(p) for p in META_CURRENCY)), lambda m: m.rlike("^[A-Z]{3}$")), F.lit(0)), F.lit(""))
    found = ((got(SHOPIFY_CURRENCY), "shopify_js"), (got(BIGCARTEL_CURRENCY), "bigcartel_js"), (meta, "meta"), (got(LD_CURRENCY), "jsonld"))
    made = lambda c, s: F.struct(c.alias("currency"), F.lit(s).alias("source"))
    return first_of(((c != "", made(c, s)) for c, s in found), made(F.lit(""), ""))


def emails(html: Column) -> Column:
    """Distinct addresses, those of mail links first, without assets, placeholders and error trackers."""
    h = F.coalesce(html, F.lit(""))
    linked = F.transform(F.regexp_extract_all(h, F.lit(r"""(?i)mailto:([^"'?>\s]+)"""), 1), lambda m: F.trim(m))
    return F.array_distinct(F.filter(F.concat(linked, F.regexp_extract_all(h, F.lit(EMAIL), 0)), lambda e: (e != "") & ~e.rlike(ASSET) & ~e.rlike(NOT_A_CONTACT)))


def phones(html: Column, visible: Column) -> Column:
    """Distinct numbers as written: those of phone links, then those of the visible text."""
    found = F.concat(F.regexp_extract_all(html, F.lit(TEL), 1), F.regexp_extract_all(visible, F.lit(PHONE_TEXT), 0))
    return F.array_distinct(F.transform(found, lambda p: F.trim(p)))


def social_links(html: Column, network: str) -> Column:
    """Distinct profile links of a network; share, intent and tracking links are none."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(SOCIAL_LINKS[network]), 0)
    return F.array_distinct(F.filter(found, lambda u: ~F.exists(F.array(*(F.lit(j) for j in SOCIAL_JUNK)), lambda j: F.lower(u).contains(j))))


def challenge(status: Column, body: Column) -> Column:
    """The vendor of an anti-bot challenge page; empty for any other."""
    b = F.lower(body)
    vendor = first_of(((F.exists(F.array(*(F.lit(m) for m in marks)), lambda m: b.contains(m)), F.lit(name)) for name, marks in CHALLENGES.items()), F.lit(""))
    return F.when(F.coalesce(status.isin(*CHALLENGE_STATUSES), F.lit(False)) & (F.length(body) <= CHALLENGE_CHARS), vendor).otherwise("")


def is_chain(name: Column, html: Column) -> Column:
    """A known chain, by its whole name or by the start of a name of six letters or more; or a page that lists many stores."""
    n = compact(F.coalesce(name, F.lit("")))
    h = F.coalesce(html, F.lit(""))
    known = [c.replace(" ", "") for c in KNOWN_CHAINS]
    return n.isin(*known) | n.rlike("^(?:" + "|".join(k for k in known if len(k) >= 6) + ")") | h.rlike(LOCATOR) & (F.regexp_count(F.lower(h), F.lit("<li")) > 30)


def business_type(domain: Column, name: Column, text: Column, store_type: Column, status: Column, products: Column) -> Column:
    """struct(kind, reason): by domain, known chains and marketplaces, resale phrases, pieces of the domain, words of the name, then what the store sells."""
    label = compact(F.substring_index(domain, ".", 1))
    made = lambda kind, reason: F.struct(kind.alias("kind"), reason.alias("reason"))
    which = lambda values, fits: F.get(F.filter(F.array(*(F.lit(v) for v in dict.fromkeys(values))), fits), F.lit(0))
    chain = which(CHAINS, lambda c: (label == c) | (F.length(c) >= 6) & F.startswith(label, c))
    market = which(MARKETPLACES, lambda m: (domain == m) | F.startswith(domain, F.concat(m, F.lit("."))) | (label == F.replace(m, F.lit("."), F.lit(""))))
    said = {kind: F.lower(F.regexp_extract(F.left(text, F.lit(4000)), rf"(?iU)\b(?:{'|'.join(p)})\b", 0)) for kind, p in TEXT_RULES}
    hint = first_of(((s != "", s) for s in said.values()), F.lit(""))
    bare = F.regexp_replace(label, "cashmere|merino|alpaca|mohair", "-")
    pieces = [(which(ps, lambda p: bare.contains(p)), kind) for kind, ps in DOMAIN_RULES]
    own = F.concat_ws(" ", name, F.regexp_replace(F.regexp_replace(domain, r"\.[^.]*$", ""), r"[.\-]", " "))
    named = [(F.lower(F.regexp_extract(own, rf"(?iU)\b(?:{'|'.join(p)})\b", 0)), kind) for kind, p in NAME_RULES]
    rules = [
        (domain.rlike(r"\.(gov|edu|mil)$") | domain.endswith(".org") & (products == 0), made(F.lit("non_retail"), F.concat(F.lit("domain "), domain))),
        (chain.isNotNull(), made(F.lit("department_store"), F.concat(F.lit("known chain: "), chain))),
        (market.isNotNull(), made(F.lit("marketplace_resale"), F.concat(F.lit("marketplace: "), market))),
        ((store_type != "own_brand") & (said["marketplace_resale"] != ""), made(F.lit("marketplace_resale"), F.concat(F.lit("'"), hint, F.lit("'")))),
        *((p.isNotNull(), made(F.lit(kind), F.concat(F.lit("domain: '"), p, F.lit("'")))) for p, kind in pieces),
        *(((w != "") & ~((products > 0) if kind == "non_retail" else F.lit(False)), made(F.lit(kind), F.concat(F.lit("name: '"), w, F.lit("'")))) for w, kind in named),
        ((status == "ok") & (store_type == "own_brand"), made(F.lit("own_label"), F.lit("sells its own label"))),
        ((status == "ok") & (store_type == "multi_brand"), made(F.lit("boutique"), F.lit("sells other brands"))),
        ((status == "ok") & (products > 0), made(F.lit("boutique"), F.lit("sells products; brands unclear"))),
    ]
    return first_of(rules, made(F.lit("unknown"), F.lit("")))


def block_method(error: Column) -> Column:
    """The challenge's vendor, else ``http_`` and the status, else other."""
    vendor, http = F.regexp_extract(error, r"challenge page \((\w+)\)", 1), F.regexp_extract(error, r"HTTP (\d{3})", 1)
    return F.when(vendor != "", vendor).when(http != "", F.concat(F.lit("http_"), http)).otherwise("other")


def failure_reason(error: Column, vendor: Column, status: Column) -> Column:
    return F.when(error != "", error).when(vendor != "", F.format_string("challenge page (%s)", vendor)).when(~status.eqNullSafe(F.lit(200)), F.concat(F.lit("HTTP "), F.coalesce(status.cast("string"), F.lit("None")))).otherwise("empty page")


def rate_limit_wait(error: Column) -> Column:
    """Seconds to wait after a rate limit: the provider's own figure and one more, 65 at most; 20 if it names none, null if the quota is spent."""
    p = r"(?i)(?:try again|retry) in\s+(?:(\d+)\s*m\s*)?([\d.]+)\s*(ms|s)"
    part = lambda i: F.regexp_extract(error, p, i)
    own = F.coalesce(F.nullif(part(1), F.lit("")).cast("int"), F.lit(0)) * 60 + part(2).try_cast("double") / F.when(F.lower(part(3)) == "ms", 1000).otherwise(1)
    return F.when(error.rlike(SPENT), None).when(part(2) == "", 20.0).otherwise(F.least(own + 1, F.lit(65.0)))


def is_placeholder(vendor: Column, placeholders: tuple[str, ...]) -> Column:
    return spaced_key(vendor).isin(*placeholders)
