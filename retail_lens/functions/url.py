"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# A part of the public suffix list, as that writes its rules: suffixes of two labels, wildcards and exceptions. Other last labels are suffixes by themselves.
PUBLIC_SUFFIXES = (
    "com.ar", "edu.ar", "gob.ar", "net.ar", "org.ar", "com.au", "edu.au", "gov.au", "id.au", "net.au", "org.au", "com.br", "edu.br", "gov.br", "net.br", "org.br", "*.ck", "!www.ck", "ac.cn", "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn",
    "com.hk", "edu.hk", "gov.hk", "net.hk", "org.hk", "ac.id", "co.id", "go.id", "net.id", "or.id", "sch.id", "web.id", "ac.il", "co.il", "gov.il", "net.il", "org.il", "ac.in", "co.in", "edu.in", "gov.in", "net.in", "org.in",
    "ac.jp", "ad.jp", "co.jp", "ed.jp", "go.jp", "gr.jp", "lg.jp", "ne.jp", "or.jp", "*.kawasaki.jp", "!city.kawasaki.jp", "*.kitakyushu.jp", "!city.kitakyushu.jp", "*.kobe.jp", "!city.kobe.jp", "*.nagoya.jp", "!city.nagoya.jp", "*.sapporo.jp", "!city.sapporo.jp", "*.sendai.jp", "!city.sendai.jp",
    "*.yokohama.jp", "!city.yokohama.jp", "*.kh", "ac.kr", "co.kr", "go.kr", "ne.kr", "or.kr", "re.kr", "*.mm", "com.mx", "edu.mx", "gob.mx", "net.mx", "org.mx", "com.my", "edu.my", "gov.my", "net.my", "org.my", "*.np", "ac.nz", "co.nz", "govt.nz", "net.nz", "org.nz", "school.nz",
    "*.pg", "com.ph", "edu.ph", "gov.ph", "net.ph", "org.ph", "com.sg", "edu.sg", "gov.sg", "net.sg", "org.sg", "ac.th", "co.th", "go.th", "in.th", "net.th", "or.th", "com.tr", "edu.tr", "gov.tr", "net.tr", "org.tr", "web.tr", "com.tw", "edu.tw", "gov.tw", "net.tw", "org.tw",
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "nhs.uk", "org.uk", "plc.uk", "*.sch.uk", "ac.za", "co.za", "gov.za", "net.za", "org.za", "web.za",
)
# Suffixes under which each subdomain is an owner of its own, and hosts whose subdomains are stores.
PRIVATE_SUFFIXES = ("myshopify.com", "wixsite.com", "square.site", "blogspot.com", "github.io", "netlify.app", "vercel.app", "gc.ca")
HOSTED = (
    "bigcartel.com", "squarespace.com", "mybigcommerce.com", "shoplightspeed.com", "webshopapp.com", "storenvy.com", "myshopline.com", "weebly.com", "godaddysites.com",
    "jimdosite.com", "company.site", "business.site", "wordpress.com", "ueniweb.com", "mystrikingly.com", "ecwid.com", "shopsettings.com",
)
# Social networks and marketplaces, by the name before any suffix or by domain.
SOCIAL = ("instagram", "facebook", "twitter", "tiktok", "linkedin", "pinterest", "youtube", "threads", "snapchat", "whatsapp")
SOCIAL_DOMAINS = ("x.com", "fb.com", "linktr.ee", "wa.me", "youtu.be")
MARKETS = ("amazon", "etsy", "ebay", "walmart", "poshmark", "depop", "faire", "mercari", "grailed", "vinted", "aliexpress", "alibaba", "shopee", "lazada", "tokopedia")
# Pages about many businesses, sites that are no store's own, and suffixes that no store has.
DIRECTORIES = (
    "yelp.com", "yelp.ca", "tripadvisor.com", "mapquest.com", "yellowpages.com", "yellowpages.ca", "bbb.org", "nextdoor.com", "foursquare.com", "manta.com", "google.com",
    "goo.gl", "reddit.com", "wikipedia.org", "beacons.ai", "linkin.bio", "taplink.cc", "shopmy.us", "ltk.app", "shop.app", "bit.ly", "chamberofcommerce.com", "zoominfo.com",
    "loc8nearme.com", "wanderlog.com", "birdeye.com", "alignable.com", "shopify.com", "apple.com", "yahoo.com", "shoptiques.com",
)
NOT_A_SITE = (
    "facebook.com", "instagram.com", "linktr.ee", "yelp.com", "google.com", "goo.gl", "tiktok.com", "pinterest.com", "etsy.com", "squareup.com", "square.site", "wixsite.com",
    "mapquest.com", "yellowpages.com", "yp.com", "bing.com", "apple.com", "foursquare.com", "tripadvisor.com", "nextdoor.com", "bbb.org", "manta.com", "chamberofcommerce.com",
)
PUBLIC_BODIES = (".gov", ".mil", ".edu", ".gc.ca")
# Kinds of pages by path, the first that fits, and the roles of links.
PRODUCT = r"(?i)/(products?|p|item|items|dp)/[^/?#]+|-p\d{3,}(\.html)?$|\.html$"
COLLECTION = r"(?i)/(collections?|shop|store|catalog|category|categories|products|womens?|mens?|new|sale|clothing|knitwear|sweaters?|accessories)(/|$)"
LANGUAGE_ROOT = r"(?i)^/[a-z]{2}([\-_][a-z]{2})?$"
PAGE_KINDS = (
    ("wholesale", r"(?i)wholesale|trade[\-_ ]?account|become[\-_ ]a"), ("stockist", r"(?i)stockist|retailer|where[\-_ ]to[\-_ ]buy"), ("contact", r"(?i)contact"),
    ("about", r"(?i)about|our[\-_ ]story"), ("brands", r"(?i)/(brands?|designers?)(/|$)"), ("product", PRODUCT), ("collection", COLLECTION),
)
PRIORITY = r"(?i)/(pages?/)?(about|our-story|contact|wholesale|stockist|retailers?|brands?|designers?|trade)"
PRIORITY_TEXT = r"(?i)\b(contact|about|our story|wholesale|stockists?|retailers?|trade|brands|designers)\b"
IRRELEVANT = (
    r"(?i)/(blogs?|news|journal|policies|privacy|terms|refund|returns|shipping|cart|checkout|account|login|register|search|wishlist|tags?|author|feed|wp-admin|wp-login|cdn-cgi)(/|$)"
    r"|\.(jpe?g|png|gif|webp|svg|pdf|zip|mp4)$"
)
# First parts of social paths that are no profile.
NOT_A_PROFILE = {
    "instagram": ("p", "reel", "reels", "explore", "tags", "stories", "tv", "accounts", "about", "developer", "directory", "legal", "web", "challenge", "share"),
    "facebook": (
        "groups", "events", "watch", "marketplace", "sharer", "sharer.php", "share", "login", "help", "policies", "hashtag", "photo", "photo.php", "photos", "videos", "story.php",
        "permalink.php", "plugins", "dialog", "l.php", "tr", "business", "gaming", "reel", "public", "search", "home.php",
    ),
}
SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*://"


def normalize_url(s: Column) -> Column:
    """With a scheme and without a closing slash or space around it; empty for null and blank."""
    t = F.trim(F.coalesce(s, F.lit("")))
    full = F.when(t == "", "").when(t.startswith("//"), F.concat(F.lit("https:"), t)).when(t.rlike(SCHEME), t).otherwise(F.concat(F.lit("https://"), t))
    return F.regexp_replace(full, "/+$", "")


def host(url: Column) -> Column:
    """Lower-case host without user, port and closing dot."""
    h = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(h, r"\.$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def is_ip(h: Column) -> Column:
    return h.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$") | h.rlike(r"^\[?[0-9a-f]*:[0-9a-f:]+\]?$")


def is_number(h: Column) -> Column:
    """Digits and dots alone: an address, or what was meant as one and is none, like 10.0.0.1234; in no case a name."""
    return h.rlike(r"^[0-9.]+$")


def registrable_domain(h: Column) -> Column:
    """The label before the public suffix, with it; under a shared store host or private suffix the subdomain too. A name without a dot stays.

    By the built-in rules alone; ``suffixes.owned_domains`` takes any list.
    """
    return let(h, lambda name: let(F.split(name, r"\."), lambda labels: _registrable(name, labels)))


def _registrable(h: Column, labels: Column) -> Column:
    tail = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    at_least = lambda n: F.size(labels) >= n
    named = lambda mark: [r.removeprefix(mark) for r in PUBLIC_SUFFIXES if r.startswith(mark)]
    plain, wild, spared = [r for r in PUBLIC_SUFFIXES if r[0] not in "*!"], named("*."), named("!")
    of = lambda values, n: [v for v in values if v.count(".") == n - 1]
    under = lambda n: at_least(n) & tail(n).isin(*spared) if of(spared, n) else F.lit(False)
    third = F.get(labels, F.size(labels) - 3)
    two = tail(2).isin(*plain) | tail(2).isin(*PRIVATE_SUFFIXES) | F.element_at(labels, -1).isin(*of(wild, 1)) | tail(2).isin(*HOSTED) & ~third.isin("", "www")
    return (
        F.when(under(2), tail(2)).when(under(3), tail(3)).when(at_least(4) & tail(2).isin(*of(wild, 2)), tail(4)).when(at_least(3) & two, tail(3)).when(at_least(2), tail(2)).otherwise(h)
    )


def canonical_domain(link: Column) -> Column:
    """The registrable domain of a link; empty if it has none."""
    return let(host(normalize_url(link)), lambda h: F.when(h.contains(".") & ~is_ip(h) & ~is_number(h), registrable_domain(h)).otherwise(""))


def classify(link: Column) -> Column:
    """no_website, invalid_url, social_only, marketplace or processed."""
    return let(normalize_url(link), lambda u: let(host(u), lambda h: let(registrable_domain(h), lambda d: _classified(link, u, h, d))))


def _classified(link: Column, u: Column, h: Column, d: Column) -> Column:
    name = F.substring_index(d, ".", 1)
    bad = ~F.lower(u).rlike("^https?://") | ~h.contains(".") | is_ip(h) | is_number(h) | link.contains("@") | h.rlike(r"[^a-z0-9.-]")
    return F.when(u == "", "no_website").when(bad, "invalid_url").when(d.isin(*SOCIAL_DOMAINS) | name.isin(*SOCIAL), "social_only").when(name.isin(*MARKETS), "marketplace").otherwise("processed")


def origin(url: Column) -> Column:
    """Scheme, host and port in lower case, with https where there is no scheme."""
    full = F.when(url.contains("//"), url).otherwise(F.concat(F.lit("https://"), url))
    return F.lower(F.regexp_replace(F.regexp_extract(full, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1), r"//[^@/]*@", "//"))


def is_deep_link(url: Column) -> Column:
    return ~path(url).isin("", "/") | url.rlike(r"^[^#]*\?[^#]")


def absolute(page: Column, link: Column) -> Column:
    """A link as it is meant on a page: with its own scheme, or the page's scheme, host or folder before it; ``..`` steps at its front are taken."""
    scheme, site = F.regexp_extract(page, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1), F.regexp_extract(page, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path(page), r"^(.*/)", 1), F.lit("")), F.lit("/"))
    ups = F.size(F.regexp_extract_all(F.regexp_extract(link, r"^((?:\.\./)*)", 1), F.lit(r"\.\./"), 0))
    steps = F.split(F.rtrim(folder, F.lit("/")), "/")
    up = F.concat(F.array_join(F.slice(steps, 1, F.greatest(F.size(steps) - ups, F.lit(1))), "/"), F.lit("/"))
    rest = F.regexp_replace(link, r"^(\.\.?/)+", "")
    return (
        F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(site, path(page), link)).when(link.startswith("#"), F.concat(F.regexp_extract(page, "^([^#]*)", 1), link)).otherwise(F.concat(site, up, rest))
    )


def url_key(url: Column) -> Column:
    """Host without www., path without closing slash, and query."""
    h = F.regexp_replace(host(url), r"^www\.", "")
    query = F.regexp_extract(url, r"(\?[^#]*)", 1)
    return F.concat(h, F.regexp_replace(path(url), "/+$", ""), query)


def page_kind(url: Column, home: Column | None = None) -> Column:
    """What a page is by its path: home, or the first kind whose rule fits, or other."""
    p = F.regexp_replace(path(url), "/+$", "")
    out = F.lit("other")
    for name, pattern in reversed(PAGE_KINDS):
        out = F.when(p.rlike(pattern), name).otherwise(out)
    at_home = (p == "") | p.rlike(LANGUAGE_ROOT)
    if home is not None:
        at_home = at_home | (F.regexp_replace(url, "/+$", "") == F.regexp_replace(home, "/+$", ""))
    return F.when(at_home, "home").otherwise(out)


def link_role(url: Column, text: Column) -> Column:
    """skip, priority, product, collection or other, by path and link text."""
    p = path(url)
    return F.when(p.rlike(IRRELEVANT), "skip").when(p.rlike(PRIORITY) | text.rlike(PRIORITY_TEXT), "priority").when(p.rlike(PRODUCT), "product").when(p.rlike(COLLECTION), "collection").otherwise("other")


def on_domain(h: Column, domain: Column) -> Column:
    return (F.lower(h) == domain) | F.endswith(F.lower(h), F.concat(F.lit("."), domain))


def store_website(url: Column, exclude: tuple[str, ...] = ()) -> Column:
    """The domain of a store's own website; empty for profiles, marketplaces, directories, public bodies and excluded domains."""
    def own(d: Column) -> Column:
        body = F.regexp_replace(d, r"^[^.]*", "").isin(*PUBLIC_BODIES) | d.rlike("|".join(b.replace(".", r"\.") + "$" for b in PUBLIC_BODIES))
        return F.when((classify(url) == "processed") & ~d.isin(*DIRECTORIES, *exclude) & ~body, d).otherwise("")

    return let(canonical_domain(url), own)


def site_domain(website: Column) -> Column:
    """The domain of a website, unless it is a listing or profile."""
    return let(canonical_domain(website), lambda d: F.when(d.isin(*NOT_A_SITE), "").otherwise(d))


def server_network(ip: Column) -> Column:
    """The /24 of an IPv4 address, the /48 of an IPv6 one written in full."""
    four = F.concat(F.substring_index(ip, ".", 3), F.lit(".0/24"))
    six = F.concat(F.array_join(F.transform(F.slice(F.split(F.lower(ip), ":"), 1, 3), lambda g: F.coalesce(F.nullif(F.regexp_replace(g, "^0+", ""), F.lit("")), F.lit("0"))), ":"), F.lit("::/48"))
    return F.when(ip.contains(":"), six).otherwise(four)


def social_profile(value: Column, network: Column) -> Column:
    """struct(network, key, url) of a profile link, or of a bare handle on a known ``network``; null for posts, groups, share links and all else."""
    whole = lambda t: F.when(t.contains("//"), t).otherwise(F.concat(F.lit("https://"), t))
    parts = lambda full: F.filter(F.split(path(full), "/"), lambda x: x != "")
    return let(F.trim(value), lambda t: let(whole(t), lambda full: let(parts(full), lambda seg: let(F.lower(F.get(seg, F.lit(0))), lambda first: _profile(t, network, full, seg, first)))))


def _profile(t: Column, network: Column, full: Column, seg: Column, first: Column) -> Column:
    made = lambda n, key, url: F.struct(n.alias("network"), key.alias("key"), url.alias("url"))
    handle = F.regexp_replace(t, "^@+", "")
    bare = (network != "") & t.rlike(r"^@?[\w.\-]{2,60}$") & ~F.lower(t).rlike(r"\.(com|net|org|co|me)$")
    from_handle = F.when(network == "instagram", made(network, F.lower(handle), F.concat(F.lit("https://www.instagram.com/"), F.lower(handle), F.lit("/")))).otherwise(made(network, F.lower(handle), F.concat(F.lit("https://www.facebook.com/"), handle)))
    h = F.regexp_replace(host(full), r"^(www|m|web|l|business)\.", "")
    raw = F.get(seg, F.lit(0))
    insta = F.when(raw.rlike(r"^[\w.]{1,40}$") & ~first.isin(*NOT_A_PROFILE["instagram"]), made(F.lit("instagram"), first, F.concat(F.lit("https://www.instagram.com/"), first, F.lit("/"))))
    ident = F.regexp_extract(full, r"[?&]id=([^&#]+)", 1)
    paged = F.slice(seg, 1, F.when(first == "p", 2).otherwise(3))
    face = (
        F.when(raw.isNull(), None)
        .when(first == "profile.php", F.when(ident != "", made(F.lit("facebook"), F.concat(F.lit("id:"), ident), F.concat(F.lit("https://www.facebook.com/profile.php?id="), ident))))
        .when(first.isin("people", "pages", "p") & (F.size(seg) >= 2), made(F.lit("facebook"), F.concat(F.lit("id:"), F.lower(F.element_at(seg, -1))), F.concat(F.lit("https://www.facebook.com/"), F.array_join(paged, "/"))))
        .when(~first.isin(*NOT_A_PROFILE["facebook"]), made(F.lit("facebook"), first, F.concat(F.lit("https://www.facebook.com/"), raw)))
    )
    return F.when(t == "", None).when(bare, from_handle).when(h.isin("instagram.com", "instagr.am"), insta).when(h.isin("facebook.com", "fb.com", "fb.me"), face)
