"""Names, links, places and numbers as sources write them: each rule over literal rows, with the values that it has to give."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import place, price, text, url
from ..registry import cases

# Words that a store adds to its own name among its vendors.
OWN_NAME_WORDS = (
    "the", "boutique", "boutiques", "shop", "shoppe", "store", "stores", "co", "company", "clothing", "clothiers", "apparel", "collection", "collections", "collective", "designs",
    "by", "and", "inc", "llc", "ltd", "online", "official",
)
# Vendors that are none.
PLACEHOLDER_VENDORS = (
    "", "default", "default vendor", "vendor", "unknown", "none", "n a", "na", "other", "others", "various", "misc", "miscellaneous", "wholesale", "gift card", "gift cards",
    "giftcard", "e gift card", "shopify", "sample", "test", "my store", "store", "shop", "sale", "clearance", "brand", "no brand", "unbranded",
)
DOMAIN_IN_TEXT = r"(?i)(?<![\w@/.])(?:https?://)?(?:www\.)?((?:[a-z0-9-]+\.)+(?:com|net|co|shop|store|us|ca|org|boutique|clothing|style))(?![\w-])"
PLACE_IN_TEXT = r"\b([A-Z][A-Za-z.'’-]+(?: [A-Z][A-Za-z.'’-]+){0,2}),\s*([A-Z]{2})\b"
c = F.col


def website_in(t):
    """The first website of a store's own that a text shows."""
    found = F.filter(F.regexp_extract_all(t, F.lit(DOMAIN_IN_TEXT), 1), lambda d: url.store_website(d) != "")
    return F.coalesce(F.concat(F.lit("https://"), F.lower(F.get(found, F.lit(0)))), F.lit(""))


def place_in(t):
    """struct(city, state) of the first place in a text whose state is one."""
    both = F.arrays_zip(F.regexp_extract_all(t, F.lit(PLACE_IN_TEXT), 1).alias("city"), F.regexp_extract_all(t, F.lit(PLACE_IN_TEXT), 2).alias("state"))
    return F.get(F.filter(both, lambda p: place.state_code(p["state"]) != ""), F.lit(0))


def looks_like(name, instagram, facebook, link):
    """Whether a link is to the store's own site: its domain carries the store's name, with or without store words, or a handle."""
    site = url.store_website(link)
    domain = text.plain_key(F.substring_index(site, ".", 1))
    handles = F.filter(F.array(url.social_profile(instagram, F.lit(""))["key"], url.social_profile(facebook, F.lit(""))["key"]), lambda k: k.isNotNull() & ~k.startswith("id:"))
    forms = F.concat(text.name_forms(name, OWN_NAME_WORDS), F.transform(handles, text.plain_key))
    return (site != "") & F.exists(forms, lambda f: (F.length(f) >= 4) & (domain.contains(f) | (F.length(domain) >= 5) & f.contains(domain)))


cases("domain_cores", "domain string", "core string", [
    ("shoptango.com", "tango"), ("thetangoboutique.com", "tango"), ("tango-online.co.uk", "tango"), ("theshop.com", "shop"), ("storeco.com", "storeco"), ("boutiques.net", "boutiques"), ("bluenvy.ca", "bluenvy"), ("collectionboutique.com", "boutique"), ("", ""),
], lambda: {"core": text.domain_core(c("domain"))}, "The name in a domain without store words around it (F3).")

cases("own_names", "vendor string, name string", "own boolean", [
    ("Bluenvy Boutique", "bluenvy", True), ("The Lyla Shop", "lyla", True), ("Lyla", "shoplyla", True), ("Free People", "lyla", False), ("Co", "co", False), ("JB", "jbclothing", False), ("The Shop", "theshop", True), ("Éclat", "clat", True),
], lambda: {"own": text.is_own_name(c("vendor"), c("name"), OWN_NAME_WORDS)}, "Whether a vendor is the store's own name (F6).")

cases("vendor_placeholders", "vendor string", "vendor_key string, placeholder boolean", [
    ("Default Vendor", "default vendor", True), ("N/A", "n a", True), ("e-Gift Card", "e gift card", True), ("--", "", True), ("Free People", "free people", False), ("Shop 12", "shop 12", False),
], lambda: {"vendor_key": text.spaced_key(c("vendor")), "placeholder": text.spaced_key(c("vendor")).isin(*PLACEHOLDER_VENDORS)}, "Vendors that stand for none (F5, PF8).")

cases("plain_keys", "s string", "plain string, name string", [
    ("Café Élan & Co.", "cafeelanandco", "cafeelanand"), ("The Knit Company", "theknitcompany", "knit"), ("THE Ltd", "theltd", "ltd"), ("Straße 9", "strasse9", "strasse9"), ("Ｆｕｌｌ ½", "full", "full"), ("İstanbul", "istanbul", "istanbul"), ("Málaga Inc", "malagainc", "malaga"), ("!!", "", ""), (None, "", ""),
], lambda: {"plain": text.plain_key(c("s")), "name": text.name_key(F.coalesce(c("s"), F.lit("")))}, "Keys of names without accents, case and company words (F8, F9).")

cases("name_forms", "s string", "forms string", [
    ("STORM Clothing Boutique", "stormclothingboutique,storm"), ("Moon + Arrow", "moonandarrow,moonarrow"), ("Cedar", "cedar"), ("The Shop", "shop,"),
], lambda: {"forms": F.array_join(text.name_forms(c("s")), ",")}, "The keys that a store's own domain may carry (F10).")

cases("looks_like", "name string, instagram string, facebook string, link string", "own boolean", [
    ("Cedar & Hyde Mercantile", "https://www.instagram.com/cedarandhyde/", "", "https://cedarandhyde.com/pages/x", True), ("STORM Clothing Boutique", "", "", "stormboutique.com", True), ("Bee", "", "", "bee.com", False),
    ("Rose Garden", "", "", "https://pasadenamag.com/rose-garden", False), ("Rose Garden", "", "", "https://www.yelp.com/biz/rose-garden", False), ("Rose Garden", "", "https://facebook.com/shoprosie", "shoprosie.ca", True), ("Rose Garden", "", "https://facebook.com/profile.php?id=12345", "12345.com", False), ("Park", "", "", "nps.gov", False),
], lambda: {"own": looks_like(c("name"), c("instagram"), c("facebook"), c("link"))}, "Whether a search result is the store's own site (F11).")

cases("titles", "title string, handle string", "site string, profile string", [
    ("Sweaters | Cedar & Hyde Mercantile", "cedar", "Cedar & Hyde Mercantile", "Sweaters"), ("Cedar & Hyde (@cedarandhyde) • Instagram photos and videos", "cedarandhyde", "Instagram photos and videos", "Cedar & Hyde"),
    ("<b>Moon</b> – Home", "moon", "Home", "Moon"), ("A - " + "b" * 41, "a", "A", "A - " + "b" * 41), ("Instagram", "x", "Instagram", "x"), ("Plain", "x", "Plain", "Plain"), ("@handle", "h", "@handle", "h"),
], lambda: {"site": text.site_name(c("title")), "profile": text.profile_name(c("title"), c("handle"))}, "Stores in page and profile titles (F12).")

cases("found_in_text", "t string", "website string, city string, state string", [
    ("Naples, FL. Shop at www.Tango.com or instagram.com/tango", "https://tango.com", "Naples", "FL"), ("mail a@tango.com only, Paris, FR then Eau Claire, WI", "", "Eau Claire", "WI"), ("https://tango.boutique!", "https://tango.boutique", None, None), ("", "", None, None),
], lambda: {"website": website_in(c("t")), "city": place_in(c("t"))["city"], "state": place_in(c("t"))["state"]}, "The first website and place that a profile shows (F13).")

cases("social_profiles", "value string, network string", "network_found string, profile_key string, profile string", [
    ("https://www.instagram.com/Cedar.Hyde/?hl=en", "", "instagram", "cedar.hyde", "https://www.instagram.com/cedar.hyde/"), ("@cedar.hyde", "instagram", "instagram", "cedar.hyde", "https://www.instagram.com/cedar.hyde/"), ("Cedar", "facebook", "facebook", "cedar", "https://www.facebook.com/Cedar"),
    ("https://www.instagram.com/p/Cx1", "", None, None, None), ("facebook.com/profile.php?id=99&x=1", "", "facebook", "id:99", "https://www.facebook.com/profile.php?id=99"), ("https://m.facebook.com/pages/Cedar/123", "", "facebook", "id:123", "https://www.facebook.com/pages/Cedar/123"),
    ("https://facebook.com/groups/9", "", None, None, None), ("https://fb.me/CedarHyde", "", "facebook", "cedarhyde", "https://www.facebook.com/CedarHyde"), ("https://example.com/cedar", "", None, None, None), ("cedar.com", "instagram", None, None, None), ("", "", None, None, None), ("https://facebook.com/", "", None, None, None),
], lambda: {"network_found": url.social_profile(c("value"), c("network"))["network"], "profile_key": url.social_profile(c("value"), c("network"))["key"], "profile": url.social_profile(c("value"), c("network"))["url"]}, "Profiles behind social links (F14).")

cases("places", "state string, country string, postal string, location string", "state_code string, country_code string, postal_code string, region string", [
    ("California", "", "", "Boulder, CO", "CA", "US", "", "US"), ("ca.", "", "90210", "Toronto, ON", "CA", "US", "90210", "CA"), ("québec", "", "h2x1y4", "Paris, France", "QC", "CA", "H2X 1Y4", "FR"), ("", "", "K1A-0B6", "Nowhere", "", "CA", "K1A 0B6", "XX"),
    ("Texas", "United Kingdom", "", "UK", "TX", "GB", "", "GB"), (None, "germany", " 10115 ", "Bali, Indonesia", "", "DE", "10115", "XX"), ("Bavaria", "Österreich", None, "PEI", "", "ÖS", "", "CA"), ("d.c.", None, None, "Washington DC", "", "", "", "US"),
], lambda: {"state_code": place.state_code(c("state")), "country_code": place.infer_country(c("country"), c("state"), c("postal")), "postal_code": place.normalize_postal(c("postal")), "region": place.region_of(c("location"), F.lit("XX"))}, "States, countries and postal codes (F15, F16).")

cases("json_texts", "v string", "as_text string, currency string", [
    (" plain ", "plain", ""), ('["usd","x"]', "usd", "USD"), ('{"name":"Eur"}', "Eur", "EUR"), ('{"@value":"cad"}', "cad", "CAD"), ('[{"name":["gbp"]}]', "gbp", "GBP"), ("[]", "", ""), ("12.5", "12.5", ""), (None, "", ""), ("US$", "US$", ""),
], lambda: {"as_text": text.as_text(c("v")), "currency": text.currency_code(c("v"))}, "JSON values as text and currency codes (F21, F22).")

cases("tri_state_flags", "v string", "flag boolean", [
    ("TRUE", True), ("In_Stock", True), ("available", True), (" y ", True), ("soldout", False), ("OutOfStock", False), ("0", False), ("", None), ("maybe", None), (None, None),
], lambda: {"flag": text.flag(c("v"))}, "Yes, no or unknown (F23).")

cases("redacted_secrets", "t string", "redacted string", [
    ("key sk-ant-" + "a1B2" * 5, "key [redacted]"), ("sk-proj-" + "x" * 20 + " end", "[redacted] end"), ("AIza" + "Q" * 35, "[redacted]"), ("gsk_" + "z" * 24, "[redacted]"), ("tvly-" + "k" * 18, "[redacted]"), ("shpat_" + "f0" * 10, "[redacted]"),
    ('{"api_key": "abcdefgh1234"}', '{"api_key": "[redacted]"}'), ("Authorization: Bearer abcdefghij", "Authorization: [redacted]"), ("X-API-Key=12345678;", "X-API-Key=[redacted]"), ("the hush-hush value", "the [redacted] value"), ("sk-short", "sk-short"),
], lambda: {"redacted": text.redact(c("t"), ("hush-hush", "tiny"))}, "Keys and known secrets masked (F24).")

cases("same_names", "a string, b string", "same boolean", [
    ("Tango Boutique", "TANGO boutique", True), ("Tango Boutique", "Tango", True), ("The Tan", "Tan", False), ("Moon", "Arrow", False), ("", "Arrow", False),
], lambda: {"same": text.same_name(c("a"), c("b"))}, "Names that are one or hold each other (F28).")

cases("loose_numbers", "s string", "n double", [("$ 12.50 each", 12.5), ("-81.79°", -81.79), ("about", None), ("", None), ("1,200", 1200.0), ("1-2", None)], lambda: {"n": text.loose_number(c("s"))}, "Numbers without what stands around them (F29).")

cases("entity_texts", "s string", "t string", [
    ("<p>Fish &amp; Chips&nbsp;&#8211; caf&eacute;</p>", "Fish & Chips – café"), ("&lt;b&gt; &#x27;q&#39; &unknown; AT&T", "<b> 'q' &unknown; AT&T"), ("<script>x<y</script>a<style>b</style> c", "a c"), ("&amp;lt;", "&lt;"), ("plain", "plain"),
], lambda: {"t": text.clean_html(c("s"))}, "Text of HTML fragments (F18).")

cases("domains", "link string", "domain string, site string, own_site string, status string", [
    ("https://shop.example.co.uk/x", "example.co.uk", "example.co.uk", "example.co.uk", "processed"), ("brand.bigcartel.com", "brand.bigcartel.com", "brand.bigcartel.com", "brand.bigcartel.com", "processed"), ("www.bigcartel.com", "bigcartel.com", "bigcartel.com", "bigcartel.com", "processed"), ("my.myshopify.com", "my.myshopify.com", "my.myshopify.com", "my.myshopify.com", "processed"),
    ("amazon.co.uk/x", "amazon.co.uk", "amazon.co.uk", "", "marketplace"), ("https://www.facebook.com/tango", "facebook.com", "", "", "social_only"), ("linktr.ee/tango", "linktr.ee", "", "", "social_only"), ("https://www.yelp.ca/biz/x", "yelp.ca", "yelp.ca", "", "processed"), ("nps.gov", "nps.gov", "nps.gov", "", "processed"),
    ("http://10.0.0.1/x", "", "", "", "invalid_url"), ("ftp://files.example.com", "example.com", "example.com", "", "invalid_url"), ("", "", "", "", "no_website"), ("instagram-shop.com", "instagram-shop.com", "instagram-shop.com", "instagram-shop.com", "processed"), ("myetsy.com", "myetsy.com", "myetsy.com", "myetsy.com", "processed"),
], lambda: {"domain": url.canonical_domain(c("link")), "site": url.site_domain(c("link")), "own_site": url.store_website(c("link")), "status": url.classify(c("link"))}, "Domains of links, and whose they are (U2-U4, U10, U11).")

cases("origins", "u string", "origin string, ip boolean, deep boolean", [
    ("HTTPS://Shop.Example.com:8080/a?b", "https://shop.example.com:8080", False, True), ("shop.example.com", "https://shop.example.com", False, False), ("http://user:pw@10.0.0.1/", "http://10.0.0.1", True, False), ("https://a.com?x=1", "https://a.com", False, True), ("https://a.com/#top", "https://a.com", False, False), ("http://999.1.1.1/x", "http://999.1.1.1", False, True),
], lambda: {"origin": url.origin(c("u")), "ip": url.is_ip(url.host(c("u"))), "deep": url.is_deep_link(url.normalize_url(c("u")))}, "Origins, addresses and deep links (U5, U12).")

cases("server_networks", "ip string", "network string", [("23.227.38.65", "23.227.38.0/24"), ("2606:4700:0010:0:0:0:ac43:1", "2606:4700:10::/48")], lambda: {"network": url.server_network(c("ip"))}, "The network of a server (U12).")

cases("page_rules", "u string, home string", "kind string", [
    ("https://a.com", "https://a.com/", "home"), ("https://a.com/en-gb/", "", "home"), ("https://a.com/shop/us", "https://a.com/shop/us/", "home"), ("https://a.com/pages/Trade-Account", "", "wholesale"), ("https://a.com/become-a-partner", "", "wholesale"), ("https://a.com/where-to-buy", "", "stockist"), ("https://a.com/contact-us", "", "contact"),
    ("https://a.com/our_story", "", "about"), ("https://a.com/designers/", "", "brands"), ("https://a.com/collections/knit/products/x", "", "product"), ("https://a.com/blue-hat-p12345", "", "product"), ("https://a.com/collections/sale", "", "collection"), ("https://a.com/womens", "", "collection"), ("https://a.com/blog/x", "", "other"),
], lambda: {"kind": url.page_kind(c("u"), c("home"))}, "What pages are by their paths (U7).")

cases("link_roles", "u string, t string", "role string", [
    ("https://a.com/cart", "Contact", "skip"), ("https://a.com/logo.PNG", "", "skip"), ("https://a.com/pages/about-us", "", "priority"), ("https://a.com/x", "Our story", "priority"), ("https://a.com/products/hat", "", "product"), ("https://a.com/collections", "", "collection"), ("https://a.com/x", "hat", "other"),
], lambda: {"role": url.link_role(c("u"), c("t"))}, "What links are for (U8).")

cases("on_domains", "h string, d string", "within boolean", [("shop.a.com", "a.com", True), ("A.com", "a.com", True), ("nota.com", "a.com", False), ("a.com.evil.org", "a.com", False)], lambda: {"within": url.on_domain(c("h"), c("d"))}, "Hosts of a domain or under it (U13).")

cases("price_texts", "raw string", "price double", [
    ("$1,395.00", 1395.0), ("119,99 €", 119.99), ("Rp 139.000", 139000.0), ("1.299,00 - 1.499,00", 1299.0), ("36 38", 36.0), ("1 395 kr", 1395.0), ("1'200.50", 1200.5), ("free", None), ("0", None), ("", None), (None, None), ("1.234.567,8", 1234567.8), ("12,345", 12345.0), ("12,3", 12.3), ("from 5", 5.0),
], lambda: {"price": price.parse_price(c("raw"))}, "Prices as shops write them (M1, M2).")

cases("prices_of_sources", "raw string, minor int, source string", "price double", [
    ("22900", 2, "woocommerce_feed", 229.0), ("4600", 2, "render_json", 46.0), ("4600", None, "render_json", None), ("460", None, "render_json", 460.0), ("4600", None, "shopify_feed", 4600.0), ("46.00", None, "app_state", 46.0), ("x", 2, "woocommerce_feed", None), (None, None, "jsonld", None), ("4600", 0, "app_state", 4600.0),
], lambda: {"price": price.price_of(c("raw"), c("minor"), c("source"))}, "Prices in major units, unknown where the unit is (M3).")

cases("closeness", "x double", "closeness double", [(1.0, 0.0), (2.0, -0.6931471805599453), (0.5, -0.6931471805599453), (0.0, None), (-1.0, None), (None, None)], lambda: {"closeness": F.abs(price.log_closeness(c("x"))) * -1 + 0.0}, "Nearness of a ratio to one, on a log scale (M7).")

cases("number_sets", "t string", "numbers string", [("was 45.00, now 39,90 or 45", "45.0,39.9"), ("none", ""), ("1 200 and 1200", "1200.0")], lambda: {"numbers": F.array_join(F.transform(price.prices_in(c("t")), lambda x: x.cast("string")), ",")}, "All numbers of a text (M4).")

cases("dates", "today string, launched string, millis bigint", "recent boolean, day string, prefix string", [
    ("2026-10-20", "2026-07-22", 1760918400000, True, "2025-10-20", "2026-07-22"), ("2026-10-20", "2026-07-21T10:00:00Z", 0, False, "1970-01-01", "2026-07-21"), ("2026-10-20", "soon", None, None, None, "soon"), ("2026-10-20", "", 86399999, None, "1970-01-01", ""),
], lambda: {"recent": F.datediff(F.to_date("today"), F.left("launched", F.lit(10)).try_cast("date")) <= 90, "day": F.timestamp_millis("millis").cast("date").cast("string"), "prefix": F.left("launched", F.lit(10))}, "Launches within 90 days, dates of epoch milliseconds, ISO prefixes (D1-D3).")

cases("addresses", "t string", "street string, city string, state string, postal string, n int", [
    ("Visit us: 1 Main St, Naples, FL 34102 today", "1 Main St", "Naples", "FL", "34102", 1), ("Toronto, ON M5V 2T6", "", "Toronto", "ON", "M5V 2T6", 1), ("at 12 Water Street Eau Claire, WI 54701-1234", "", "Eau Claire", "WI", "54701-1234", 1), ("no address", None, None, None, None, 0),
], lambda: {**{k: F.get(place.addresses(c("t")), F.lit(0))[k] for k in ("street", "city", "state", "postal")}, "n": F.size(place.addresses(c("t")))}, "North American addresses in text (X23).")
