"""Text and identity functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a store adds around its name.
STORE_WORDS = ("the", "shop", "shoppe", "boutique", "boutiques", "store", "stores", "clothing", "co", "company", "collection", "apparel", "inc", "llc", "ltd", "online", "and")
COMPANY_SUFFIX = "(inc|llc|ltd|co|corp|company)$"
# Shapes of keys and tokens, in the order in which they are masked.
SECRETS = (
    r"sk-ant-[A-Za-z0-9_\-]{16,}", r"sk-(?:proj-)?[A-Za-z0-9_\-]{16,}", r"AIza[0-9A-Za-z_\-]{30,}", r"gsk_[A-Za-z0-9]{20,}", r"tvly-[A-Za-z0-9_\-]{16,}", r"shp(?:at|ss|ca|pa)_[A-Za-z0-9]{16,}",
)
NAMED_SECRET = r"""(?i)\b(api[_-]?key|authorization|x-api-key)("?\s*[:=]\s*"?)(?:Bearer\s+)?[^\s"',}]{8,}"""
MASK = "[redacted]"
# Named entities that product and page texts use; numeric ones are decoded by rule.
ENTITIES = {
    "nbsp": "\u00a0", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "middot": "·", "copy": "©", "reg": "®", "trade": "™", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "bull": "•", "hellip": "…",
    "eacute": "é", "egrave": "è", "ecirc": "ê", "agrave": "à", "acirc": "â", "ccedil": "ç", "ouml": "ö", "uuml": "ü", "auml": "ä", "szlig": "ß", "ntilde": "ñ", "pound": "£", "euro": "€", "yen": "¥", "cent": "¢", "deg": "°", "times": "×", "frac12": "½",
}


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once: a lambda's variable, unlike an alias, is never put in by copy."""
    return F.transform(F.array(value), body)[0]


def lookup(values: dict[str, str], key: Column) -> Column:
    """The value that a dictionary of fixed values has for a key; null if none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def unescape(s: Column) -> Column:
    """Character references decoded: numeric ones up to U+FFFF, and the named ones in ENTITIES."""
    def one(part: Column) -> Column:
        name = F.regexp_extract(part, r"^(#[xX][0-9a-fA-F]{1,4}|#[0-9]{1,5}|[A-Za-z][A-Za-z0-9]*);", 1)
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 8), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 8)).cast("int")
        wide = F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 4, "0")), "UTF-16BE")
        char = F.when(code.isNotNull(), wide).when(name == "amp", "&").otherwise(lookup(ENTITIES, name))
        return F.when((name == "") | char.isNull(), F.concat(F.lit("&"), part)).otherwise(F.concat(char, F.substr(part, F.length(name) + 2)))

    parts = F.split(s, "&", -1)
    return F.when(s.contains("&"), F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), one), ""))).otherwise(s)


def compact(s: Column) -> Column:
    """Lower-case ASCII letters and digits alone."""
    return F.regexp_replace(F.lower(s), "[^a-z0-9]+", "")


def spaced_key(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))


def core_name(s: Column) -> Column:
    """The compact name without shop words; the whole compact name if nothing else is in it."""
    words = F.filter(F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9]+"), 0), lambda w: ~w.isin(*STORE_WORDS))
    return F.coalesce(F.nullif(F.array_join(words, ""), F.lit("")), compact(s))


def digits(s: Column) -> Column:
    """The last ten digits of a phone number."""
    return F.right(F.regexp_replace(s, "[^0-9]", ""), F.lit(10))


def collapse(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def clean_html(s: Column) -> Column:
    """Visible text: without scripts, styles, comments and tags, entities decoded, spaces collapsed."""
    s = F.regexp_replace(s, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    s = F.regexp_replace(F.regexp_replace(s, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(unescape(s), r"(?U)\s+", " "))


def redact(s: Column, known: tuple[str, ...] = ()) -> Column:
    """Keys and tokens replaced by a mark: the ``known`` values of six characters or more, longest first, then what has the shape of one."""
    for secret in sorted((k for k in known if len(k) >= 6), key=len, reverse=True):
        s = F.replace(s, F.lit(secret), F.lit(MASK))
    for pattern in SECRETS:
        s = F.regexp_replace(s, pattern, MASK)
    return F.regexp_replace(s, NAMED_SECRET, "$1$2" + MASK.replace("$", ""))


def flag(s: Column) -> Column:
    """Yes, no or unknown, from the spellings that sources use."""
    v = F.lower(F.trim(s))
    return F.when(v.isin("true", "yes", "y", "1", "instock", "in_stock", "available"), True).when(v.isin("false", "no", "n", "0", "outofstock", "out_of_stock", "soldout", "sold_out"), False)


def domain_core(domain: Column) -> Column:
    """The name in a domain without store words around it: the longest words first, from either end, while over three letters stay."""
    def step(label: Column, word: Column) -> Column:
        n = F.length(word)
        head = F.when(label.startswith(word) & (F.length(label) > n + 3), F.substr(label, n + 1)).otherwise(label)
        return F.when(head.endswith(word) & (F.length(head) > n + 3), F.left(head, F.length(head) - n)).otherwise(head)

    words = sorted((w for w in STORE_WORDS if len(w) > 2), key=lambda w: (-len(w), w))
    return F.aggregate(F.array(*(F.lit(w) for w in words)), compact(F.substring_index(domain, ".", 1)), step)


def is_own_name(vendor: Column, name: Column, words: tuple[str, ...]) -> Column:
    """Whether a vendor is the store's own compact ``name``, with or without store ``words``; names under four letters never are."""
    key = spaced_key(vendor)
    whole, core = F.replace(key, F.lit(" "), F.lit("")), F.array_join(F.filter(F.split(key, " "), lambda w: ~w.isin(*words)), "")
    return (F.length(name) >= 4) & (whole.contains(name) | (F.length(core) >= 4) & (name.contains(core) | core.contains(name)))


def _plain_letters() -> tuple[str, str]:
    """Letters whose compatibility decomposition, without marks and in lower case, is one ASCII letter or digit, and that one."""
    pairs = [(chr(c), base) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and len(base := "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)).casefold()) == 1 and base.isascii() and base.isalnum()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def plain_key(s: Column) -> Column:
    """The key by which two spellings of a name are one: without accents, case and punctuation, ``&`` as and; empty for null."""
    t = F.replace(F.coalesce(s, F.lit("")), F.lit("&"), F.lit(" and "))
    for many, letters in (("ß", "ss"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff")):
        t = F.replace(t, F.lit(many), F.lit(letters))
    return F.regexp_replace(F.lower(F.translate(t, *_plain_letters())), "[^a-z0-9]", "")


def name_key(s: Column) -> Column:
    """``plain_key`` without a leading "the" and a company's suffix, unless nothing else is in it."""
    base = plain_key(F.regexp_replace(s, r"(?i)^\s*the\s+", ""))
    return F.coalesce(F.nullif(F.regexp_replace(base, COMPANY_SUFFIX, ""), F.lit("")), base)


def name_forms(s: Column, words: tuple[str, ...] = STORE_WORDS) -> Column:
    """The distinct keys that a store's own domain may carry: its name's key, and its words without store words."""
    t = F.replace(s, F.lit("+"), F.lit(" and "))
    bare = F.array_join(F.filter(F.transform(F.split(F.trim(t), r"\s+"), plain_key), lambda w: (w != "") & ~w.isin(*words)), "")
    return F.array_distinct(F.array(name_key(t), bare))


def same_name(a: Column, b: Column) -> Column:
    """Equal compact names, or one in the other if both have five letters or more."""
    a, b = compact(a), compact(b)
    return (a != "") & (b != "") & ((a == b) | (F.least(F.length(a), F.length(b)) >= 5) & (a.contains(b) | b.contains(a)))


# How search results write titles and profiles, and what their pages are when they are about many stores.
TITLE_SPLIT = r"\s+[|\-–—:·•]\s+"
PROFILE_NOISE = r"(?i)\s*[•·|\-–—]\s*(instagram|facebook|home|about|photos?|videos?|reels?|log ?in|posts?)\b.*$"
ARTICLE_PATH = r"(?i)/(blogs?|articles?|news|magazine|stories|editorial)(/|$)|/\d{4}/\d{2}/"
ARTICLE_TITLE = r"(?i)\b(top|best)\s+\d+\b|\b\d+\s+(?:[\w'-]+\s+){0,3}(brands|boutiques|stores|shops|suppliers|places)\b|\blist of\b|\bwhere to\b|\bto shop for\b|\bguide\b|\bbrand edit\b"


def site_name(title: Column) -> Column:
    """The store in a page title: what follows the last separator, or what precedes the first one if that is over 40 letters long."""
    t = F.trim(F.regexp_replace(title, "<[^>]+>", ""))
    parts = F.filter(F.transform(F.split(t, TITLE_SPLIT), lambda x: F.trim(x)), lambda p: p != "")
    last = F.element_at(parts, -1)
    return F.when(F.size(parts) >= 2, F.when(F.length(last) <= 40, last).otherwise(F.get(parts, F.lit(0)))).otherwise(t)


def profile_name(title: Column, handle: Column) -> Column:
    """The store in a profile's title; the handle if there is none."""
    t = F.get(F.split(F.trim(F.regexp_replace(title, "<[^>]+>", "")), r"\s*\(@"), F.lit(0))
    t = F.get(F.split(F.regexp_replace(t, PROFILE_NOISE, ""), r"\s+\|\s+"), F.lit(0))
    t = F.regexp_replace(t, r"^[ \-–—|•·]+|[ \-–—|•·]+$", "")
    return F.when((t == "") | t.startswith("@") | F.lower(t).isin("instagram", "facebook"), handle).otherwise(t)


def as_text(v: Column) -> Column:
    """A JSON value as text: of a list the first value, of an object its name or @value; empty for null."""
    def step(x: Column) -> Column:
        first = F.when(x.rlike(r"^\s*\["), F.get_json_object(x, "$[0]")).otherwise(x)
        return F.when(first.rlike(r"^\s*\{"), F.coalesce(F.nullif(F.get_json_object(first, "$.name"), F.lit("")), F.get_json_object(first, "$.@value"))).otherwise(first)

    once = lambda x: F.get(F.transform(F.array(x), step), F.lit(0))  # noqa: E731  a lambda's variable is not put in by copy
    return F.trim(F.coalesce(once(once(once(v))), F.lit("")))


def currency_code(v: Column) -> Column:
    """Three letters in upper case; empty for anything else."""
    t = as_text(v)
    return F.when(t.rlike("^[A-Za-z]{3}$"), F.upper(t)).otherwise("")


def loose_number(s: Column) -> Column:
    """A number without what stands around it; null if none is left."""
    return F.regexp_replace(s, r"[^0-9.\-]", "").try_cast("double")
