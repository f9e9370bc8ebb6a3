"""Who owns a host: public suffix rules joined on the suffixes of all hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import table
from ..functions.url import HOSTED, PRIVATE_SUFFIXES, PUBLIC_SUFFIXES, host, is_ip
from ..registry import query
from .links import _HOST


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """(rule): rules as the public list writes them: ``co.uk``, ``*.ck`` or ``!www.ck``. Lines that are empty or begin with // are none; of others the first word counts."""
    lines = rules if isinstance(rules, DataFrame) else spark.createDataFrame([(r,) for r in rules], "rule string")
    first = F.lower(F.regexp_extract("rule", r"^\s*(\S+)", 1))
    return lines.select(first.alias("rule")).where("rule <> '' and not startswith(rule, '//')").distinct()


def owned_domains(hosts: DataFrame, rules: DataFrame, column: str = "host", hosted: tuple[str, ...] = HOSTED) -> DataFrame:
    """(host, suffix, domain) of the distinct hosts: the public suffix by the rules, and the label before it with it.

    Each host's suffixes meet the rules by hash join, as the exact rule, as what a wildcard stands for and as an exception; hosts are made distinct before, so one that
    a third of all rows have is one. An exception goes before all, else the rule of most labels; by no rule the last label is public. Under a ``hosted`` domain the
    subdomain is the owner, unless it is www. A host that is itself a suffix, an IP address, an empty one or one without a dot has no domain: empty. Null hosts are left out.
    """
    h = hosts.select(F.col(column).alias("host")).where("host is not null").distinct()
    labels = F.split("host", r"\.")
    n = F.size(labels)
    tail = lambda k: F.array_join(F.slice(labels, n - k + 1, k), ".")
    forms = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda k: F.array(
        F.struct(tail(k).alias("rule"), k.alias("n"), F.lit(0).alias("over")), F.struct(F.concat(F.lit("!"), tail(k)).alias("rule"), (k - 1).alias("n"), F.lit(1).alias("over")),
        F.struct(F.when(k > 1, F.concat(F.lit("*."), tail(F.greatest(k - 1, F.lit(1))))).alias("rule"), k.alias("n"), F.lit(0).alias("over")))))
    found = h.select("host", F.explode(forms).alias("f")).select("host", "f.*").join(rules, "rule").groupBy("host").agg(F.max(F.struct("over", "n")).alias("m"))
    k = F.coalesce(F.col("m.n"), F.lit(1))
    own = F.when((n > k) & F.col("host").contains(".") & ~is_ip(F.col("host")), tail(k + 1)).otherwise("")
    out = h.join(found, "host", "left").select("host", F.when(is_ip(F.col("host")), "").otherwise(tail(k)).alias("suffix"), own.alias("domain"))
    before = F.element_at(F.split(F.left("host", F.greatest(F.length("host") - F.length("domain") - 1, F.lit(0))), r"\."), -1)
    return out.withColumn("domain", F.when(F.col("domain").isin(*hosted) & ~before.isin("", "www"), F.concat(before, F.lit("."), "domain")).otherwise(F.col("domain")))


#: Rules for the hosts at hand besides the built-in ones: a suffix of its own, one whose every subdomain is one, and an exception.
EXTRA = ("example.net", "*.example.org", "!spam-farm.example.org")
_RULES = ", ".join(f"('{r}')" for r in dict.fromkeys((*PUBLIC_SUFFIXES, *PRIVATE_SUFFIXES, *EXTRA)))


@query(rf"""WITH h AS (SELECT DISTINCT {_HOST} AS host FROM pages WHERE url IS NOT NULL), r AS (SELECT * FROM (VALUES {_RULES}) t(rule)),
s AS (SELECT host, rule, CASE WHEN rule LIKE '!%' THEN len(string_split(rule, '.')) - 1 ELSE len(string_split(rule, '.')) END AS n, rule LIKE '!%' AS over
  FROM h JOIN r ON CASE WHEN rule LIKE '!%' THEN host = substr(rule, 2) OR ends_with(host, '.' || substr(rule, 2)) WHEN rule LIKE '*.%' THEN regexp_matches(host, '(^|[.])[^.]+[.]' || replace(substr(rule, 3), '.', '[.]') || '$') ELSE host = rule OR ends_with(host, '.' || rule) END),
m AS (SELECT host, arg_max(n, struct_pack(over := over, n := n)) AS k FROM s GROUP BY host),
o AS (SELECT h.host AS host, string_split(h.host, '.') AS l, coalesce(k, 1) AS k FROM h LEFT JOIN m ON m.host = h.host)
SELECT page_id, p.host AS host, array_to_string(l[-k:], '.') AS suffix, CASE WHEN len(l) > k THEN array_to_string(l[-k - 1:], '.') ELSE '' END AS domain FROM (SELECT page_id, {_HOST} AS host FROM pages) p JOIN o ON o.host = p.host""")
def public_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's host with its public suffix and the domain that is owned under it."""
    pages = table(spark, sf_dir, "pages").select("page_id", host(F.col("url")).alias("host"))
    return pages.join(owned_domains(pages, rule_table(spark, (*PUBLIC_SUFFIXES, *PRIVATE_SUFFIXES, *EXTRA))), "host").select("page_id", "host", "suffix", "domain")
