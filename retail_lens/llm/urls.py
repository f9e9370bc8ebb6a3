"""URL filter rules, with decisions shared by redirect-equivalent URLs; built-in functions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import connected_components

#: (verdict, host and path prefix).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Rules are compiled into one expression, so their number is bounded.
MAX_RULES = 1000


def host(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(common.ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(h: Column, p: Column, rules=RULES) -> Column:
    """struct(action, rule) of the longest rule that fits: its host or a subdomain of it, and its path as a prefix. Null if none does; of rules of one length, allow goes first."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    out = F.lit(None).cast("struct<action:string,rule:string>")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "allow", r[1])):
        domain, slash, prefix = rule.partition("/")
        fits = ((h == domain) | h.endswith("." + domain)) & p.startswith(slash + prefix)
        out = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def _unescaped(c: Column) -> Column:
    """An attribute's value without white space around it and with & and quotes in the place of their entities."""
    for pattern, char in ((r"(?i)&(?:quot|#34|#x22);", '"'), (r"(?i)&(?:apos|#39|#x27);", "'"), (r"(?i)&(?:amp|#38|#x26);", "&")):
        c = F.regexp_replace(c, pattern, char)
    return F.regexp_replace(c, r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")


def _without_dots(p: Column) -> Column:
    """A path with its ``.`` and ``..`` segments resolved."""
    none = F.array().cast("array<string>")

    def step(acc: Column, s: Column) -> Column:
        return F.when(s == ".", acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(s)))

    ends = F.when(p.rlike(r"/\.{1,2}\z"), F.concat(p, F.lit("/"))).otherwise(p)
    return F.when(p.rlike(r"/\.{1,2}(?:/|\z)"), F.array_join(F.aggregate(F.split(ends, "/", -1), none, step), "/")).otherwise(p)


def _plain_escapes(c: Column) -> Column:
    """Percent escapes of letters, digits and ``-._~`` taken back, and others in upper case: two spellings of one character are one."""
    def one(part: Column) -> Column:
        code = F.regexp_extract(part, r"\A([0-9A-Fa-f]{2})", 1)
        char, rest = F.char(F.conv(code, 16, 10).cast("long")), F.substr(part, F.lit(3))
        return F.when(code == "", F.concat(F.lit("%"), part)).when(char.rlike(r"\A[A-Za-z0-9._~-]\z"), F.concat(char, rest)).otherwise(F.concat(F.lit("%"), F.upper(code), rest))

    parts = F.split(c, "%", -1)
    return F.when(c.contains("%"), F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), one), ""))).otherwise(c)


def canonical(url: Column) -> Column:
    """The spelling under which equal URLs meet: scheme and host in lower case, no port that the scheme implies, no escapes but those that a path needs, no dot segments, ``/`` for an empty path, no fragment. Null without ``://``."""
    scheme = common.ascii_lower(F.regexp_extract(url, r"(?s)\A(.*?)://", 1))
    site = F.when(scheme == "http", F.regexp_replace(host(url), r":80\z", "")).when(scheme == "https", F.regexp_replace(host(url), r":443\z", "")).otherwise(host(url))
    query = F.regexp_extract(url, r"(?s)\A.*?://[^?#]*(\?[^#]*)", 1)
    resolved = _without_dots(_plain_escapes(path(url)))
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), site, F.when(resolved == "", "/").otherwise(resolved), _plain_escapes(query)))


#: Comments, and elements whose text is no markup: up to their ends, or that of the page.
UNREAD = r"(?is)<!--.*?(?:-->|\z)|<(script|style|title|textarea)\b.*?(?:</\1\s*>|\z)"


def _absolute(base: Column, link: Column) -> Column:
    """A link as it is meant on a page at ``base``."""
    scheme, site = F.regexp_extract(base, r"(?s)\A(.*?)://", 1), F.regexp_extract(base, r"(?s)\A(.*?://[^/?#]*)", 1)
    folder = F.concat(site, F.coalesce(F.nullif(F.regexp_extract(path(base), r"(?s)\A(.*/)", 1), F.lit("")), F.lit("/")))
    return F.when(link.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).when(link.startswith("/"), F.concat(site, link)).when(link.startswith("?"), F.concat(site, path(base), link)).otherwise(F.concat(folder, link))


def page_links(url: Column, html: Column) -> Column:
    """URLs that a page names as itself: canonical links and meta refreshes, made absolute by the page's first ``base`` or its own address. Comments and scripts hold none."""
    def attribute(tag: Column, name: str) -> Column:
        got = [F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*{q}", 1) for q in (r'"([^"]*)"', r"'([^']*)'", r"([^\s\"'>]+)")]
        return _unescaped(F.coalesce(*(F.nullif(g, F.lit("")) for g in got)))

    read = F.regexp_replace(html, UNREAD, " ")
    links = F.filter(F.regexp_extract_all(read, F.lit(r"(?is)<link\b[^>]*>"), 0), lambda t: t.rlike(r"(?is)\srel\s*=\s*[\"']?\s*canonical\b"))
    metas = F.filter(F.regexp_extract_all(read, F.lit(r"(?is)<meta\b[^>]*>"), 0), lambda t: t.rlike(r"(?is)\shttp-equiv\s*=\s*[\"']?\s*refresh\b"))
    targets = F.concat(F.transform(links, lambda t: attribute(t, "href")), F.transform(metas, lambda t: _unescaped(F.nullif(F.regexp_extract(t, r"(?is)url\s*=\s*['\"]?([^'\">\s]+)", 1), F.lit("")))))
    own_base = F.get(F.filter(F.transform(F.regexp_extract_all(read, F.lit(r"(?is)<base\b[^>]*>"), 0), lambda t: attribute(t, "href")), lambda t: t.isNotNull()), F.lit(0))
    bases = F.transform(F.array(F.coalesce(own_base, F.lit(""))), lambda b: F.when(b == "", url).otherwise(_absolute(url, b)))  # read once, as a lambda's variable
    found = F.flatten(F.transform(bases, lambda base: F.transform(F.filter(targets, lambda t: t.isNotNull() & (t != "") & ~t.startswith("#")), lambda t: _absolute(base, t))))
    return F.when(html.rlike("(?i)canonical|http-equiv") & url.contains("://"), found)


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES, key: str = "page_id", url: str = "url", html: str | None = "html") -> DataFrame:
    """One row a row of ``pages``: key, host, path, rule, verdict.

    A rule that fits an URL decides it. Any other URL takes the decision of its equivalents, which are those that redirects
    (a, b) and canonical links join it to, in any number of steps and under any spelling with one ``canonical`` form: allow if a rule allows one of them, else block if a rule
    blocks one, else allow. Null URLs, and URLs without ``://``, have an empty host and path, and only a rule could block them.
    Rows that are repeated are judged alike. URLs that stand only in links count with their rules, by their canonical form.
    Of ``pages`` only the three columns named are read; an empty table gives an empty one.
    """
    u = F.col(url)
    seen = pages.select(F.col(key), canonical(u).alias("_url"), host(u).alias("host"), path(u).alias("path")).withColumn("_rule", matched_rule(F.col("host"), F.col("path"), rules))
    links = [redirects.select("a", "b")] if redirects is not None else []
    if html is not None:
        links.append(pages.select(u.alias("a"), F.explode(page_links(u, F.col(html))).alias("b")))
    edges = common.materialize(reduce(DataFrame.union, links).select(canonical(F.col("a")).alias("a"), canonical(F.col("b")).alias("b")).where("a is not null and b is not null"), "url-edges") if links else None
    if edges is None or edges.isEmpty():
        return seen.select(key, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.action", F.lit("allow")).alias("verdict"))
    nodes = common.materialize(connected_components(edges), "url-components")
    rule = matched_rule(host(F.col("node")), path(F.col("node")), rules)["action"]
    ruled = nodes.select("component", rule.alias("action"))
    says = common.materialize(ruled.groupBy("component").agg(F.when(F.coalesce(F.bool_or(F.col("action") == "allow"), F.lit(False)), "allow").when(F.coalesce(F.bool_or(F.col("action") == "block"), F.lit(False)), "block").otherwise("allow").alias("shared")), "url-verdicts")
    shared = common.materialize(nodes.join(says, "component").where("shared = 'block'").select(F.col("node").alias("_url"), "shared"), "url-blocked")
    return seen.join(shared, "_url", "left").select(key, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.action", "shared", F.lit("allow")).alias("verdict"))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts for every URL of ``pages``."""
    return judge(common.table(spark, sf_dir, "pages"))


#: Hosts, paths and rules, and verdicts by rules alone: the tables at hand have no page that names another address as its own.
ORACLE = r"""
WITH u AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) t(verdict, domain, prefix)),
m AS (SELECT page_id, arg_max(domain || prefix, length(domain || prefix)) AS rule, arg_max(verdict, length(domain || prefix)) AS verdict FROM u JOIN r ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, prefix) GROUP BY page_id)
SELECT u.page_id AS page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m ON m.page_id = u.page_id
"""
