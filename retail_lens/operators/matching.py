"""Which customer a store is: by domain, else by phone, else by a name that is equal or contained, where nothing contradicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import table
from ..functions import text
from ..registry import query

#: Letters of the shortest name that says anything, and of the shortest that is looked for inside another.
LEAST, INSIDE = 4, 6


def _grams(s: Column, q: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - (q - 1)), lambda i: F.substr(s, i, F.lit(q))))


def contained(needles: DataFrame, haystacks: DataFrame, keys: list[str], q: int) -> DataFrame:
    """Distinct (keys, needle, haystack) where the haystack has the needle in it and both have the same ``keys``; needles have ``q`` letters or more.

    A needle is sought through the one of its q-grams that is in the fewest haystacks of its keys; one with a q-gram that none has is in none, and goes at
    once. The gram of a join is thus as rare as can be, a gram that many have is split by Spark like any skewed key, and no two sides meet without one.
    All sides grow with the tables, so all are merged: a broadcast of one, however small it looks packed, goes through the driver.
    """
    hay = haystacks.where(F.length("haystack") >= q).select(*keys, "haystack").distinct().select(*keys, "haystack", F.explode(_grams(F.col("haystack"), q)).alias("gram"))
    need = needles.where(F.length("needle") >= q).select(*keys, "needle").distinct().withColumn("grams", _grams(F.col("needle"), q))
    counts = hay.groupBy(*keys, "gram").agg(F.count("*").alias("n"))
    each = need.select(*keys, "needle", F.size("grams").alias("all"), F.explode("grams").alias("gram")).join(counts.hint("merge"), [*keys, "gram"])
    rare = each.groupBy(*keys, "needle", "all").agg(F.count("*").alias("found"), F.min(F.struct("n", "gram")).alias("rarest")).where("found = all")
    sought = rare.select(*keys, "needle", F.col("rarest.gram").alias("gram"))
    return sought.hint("merge").join(hay, [*keys, "gram"]).where(F.contains("haystack", "needle")).select(*keys, "needle", "haystack")


def _by_place(customers: DataFrame) -> DataFrame:
    """The first customer of each (name, state, postal), and of each name under any state, any postal code or both: a row a name and place, however many share it."""
    sets = customers.select("other", "seq", F.explode(F.array(*(F.struct(F.lit(s).alias("any_state"), F.lit(p).alias("any_postal")) for s in (False, True) for p in (False, True)))).alias("any"), "c_state", "c_postal")
    wide = sets.select("other", "seq", "any.*", F.when(~F.col("any.any_state"), F.col("c_state")).alias("c_state"), F.when(~F.col("any.any_postal"), F.col("c_postal")).alias("c_postal"))
    return wide.groupBy("other", "any_state", "c_state", "any_postal", "c_postal").agg(F.min("seq").alias("seq"))


def _permitted(value: str, known: str, other: str) -> Column:
    """The places that a store with ``value`` may look in: any if it knows none; its own, and that of customers who know none, if it does."""
    own = lambda v: F.struct(F.lit(False).alias(f"any_{known}"), v.alias(other))
    return F.when(F.col(value).isNull(), F.array(F.struct(F.lit(True).alias(f"any_{known}"), F.lit(None).cast("string").alias(other)))).otherwise(F.array(own(F.col(value)), own(F.lit(None).cast("string"))))


def by_name(stores: DataFrame, customers: DataFrame) -> DataFrame:
    """(label, state, postal, seq, how): of each distinct (label, state, postal) the first customer by equal name (``name``), or by a name inside the other where
    the states are known and equal (``name+state``). States or postal codes that are both known and differ rule a customer out.

    stores: label, state, postal. customers: seq, other, c_state, c_postal. Unknown is null. Names under LEAST letters match nothing; the customer's
    has INSIDE letters at least where names are contained. Customers meet stores as the first of their name and place, so a name that a third of all have is one row a place.
    """
    asked = stores.where(F.length("label") >= LEAST).select("label", "state", "postal").distinct()
    places = _by_place(customers.where(F.length("other") >= LEAST))
    same = asked.withColumn("other", F.col("label")).withColumn("how", F.lit("name"))
    labels = asked.where("state is not null").select("state", "label").distinct()
    others = customers.where((F.length("other") >= INSIDE) & F.col("c_state").isNotNull()).select(F.col("c_state").alias("state"), "other").distinct()
    inside = contained(others.withColumnRenamed("other", "needle"), labels.withColumnRenamed("label", "haystack"), ["state"], INSIDE).select("state", F.col("haystack").alias("label"), F.col("needle").alias("other"))
    around = contained(labels.withColumnRenamed("label", "needle"), others.withColumnRenamed("other", "haystack"), ["state"], LEAST).select("state", F.col("needle").alias("label"), F.col("haystack").alias("other"))
    pairs = asked.join(inside.unionByName(around).where("label <> other").distinct().hint("merge"), ["state", "label"]).withColumn("how", F.lit("name+state"))
    sought = same.withColumn("in_state", F.explode(_permitted("state", "state", "c_state"))).unionByName(pairs.withColumn("in_state", F.struct(F.lit(False).alias("any_state"), F.col("state").alias("c_state"))))
    sought = sought.withColumn("in_postal", F.explode(_permitted("postal", "postal", "c_postal"))).select("label", "state", "postal", "how", "other", "in_state.*", "in_postal.*")
    on = reduce(lambda a, b: a & b, [sought[c].eqNullSafe(places[c]) for c in ("other", "any_state", "c_state", "any_postal", "c_postal")])
    best = sought.join(places.hint("merge"), on).groupBy(sought["label"], sought["state"], sought["postal"]).agg(F.min(F.struct(places["seq"].alias("seq"), sought["how"].alias("how"))).alias("m"))
    return best.select("label", "state", "postal", "m.seq", "m.how")


def match(stores: DataFrame, customers: DataFrame) -> DataFrame:
    """(store_id, seq, how): the customer that each store is; no row if it is none.

    stores: store_id, domain, name, phones (array), state, postal. customers: seq (place in the list), domain, phone, name, state, postal. Empty and null mean unknown;
    postal codes count by their first five characters, phones by ten digits. A customer of the same domain comes first, then one of the same phone, then ``by_name``; of several, the first in the list.
    A store without a name goes by its domain's. Each tier joins on keys, against one customer a key. Rows that repeat a store_id are one store, with all that they know.
    """
    known = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    name = known(F.col("name"))
    s = stores.select("store_id", known(F.col("domain")).alias("domain"), F.coalesce(text.core_name(name), text.domain_core(known(F.col("domain")))).alias("label"), "phones", known(F.col("state")).alias("state"), known(F.left("postal", F.lit(5))).alias("postal"))
    c = customers.select("seq", known(F.col("domain")).alias("domain"), text.digits(F.col("phone")).alias("phone"), text.core_name(F.col("name")).alias("other"), known(F.col("state")).alias("c_state"), known(F.left("postal", F.lit(5))).alias("c_postal"))
    domains = s.select("store_id", "domain").join(c.groupBy("domain").agg(F.min("seq").alias("seq")).hint("merge"), "domain")
    phones = s.select("store_id", F.explode("phones").alias("phone")).select("store_id", text.digits(F.col("phone")).alias("phone")).where(F.length("phone") == 10).join(c.groupBy("phone").agg(F.min("seq").alias("seq")).hint("merge"), "phone")
    names = by_name(s, c)
    on = reduce(lambda a, b: a & b, [s[k].eqNullSafe(names[k]) for k in ("label", "state", "postal")])
    named = s.join(names.hint("merge"), on).select("store_id", "seq", "how")
    tier = lambda df, n, how: df.select("store_id", F.struct(F.lit(n).alias("tier"), "seq", how.alias("how")).alias("m"))
    tiers = tier(domains, 1, F.lit("domain")).unionAll(tier(phones, 2, F.lit("phone"))).unionAll(tier(named, 3, F.col("how")))
    return tiers.groupBy("store_id").agg(F.min("m").alias("m")).select("store_id", "m.seq", "m.how")


_WORDS = "'the', 'shop', 'shoppe', 'boutique', 'boutiques', 'store', 'stores', 'clothing', 'co', 'company', 'collection', 'apparel', 'inc', 'llc', 'ltd', 'online', 'and'"


@query(rf"""WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS name, nullif(regexp_extract(url, '://[^/?#]*/([a-z][a-z])/', 1), '') AS state, nullif(regexp_extract(url, '://[^/?#]*/[a-z][a-z]/([0-9]+)', 1), '') AS postal FROM pages),
l AS (SELECT page_id, state, left(postal, 5) AS postal, coalesce(nullif(array_to_string(list_filter(regexp_extract_all(lower(name), '[a-z0-9]+'), lambda x: NOT list_contains([{_WORDS}], x)), ''), ''), regexp_replace(lower(name), '[^a-z0-9]+', '', 'g')) AS label FROM t),
w AS (SELECT DISTINCT doc_id, lang AS c_state, CASE WHEN n_chars < 100 THEN CAST(n_chars AS VARCHAR) END AS c_postal, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS other FROM documents),
c AS (SELECT other, c_state, c_postal, min(doc_id) AS seq FROM w WHERE length(other) >= 4 GROUP BY ALL),
m AS (SELECT page_id, seq, 'name' AS how FROM l JOIN c ON label = other WHERE length(label) >= 4 AND (state IS NULL OR c_state IS NULL OR state = c_state) AND (postal IS NULL OR c_postal IS NULL OR postal = c_postal)
 UNION ALL SELECT page_id, seq, 'name+state' FROM l JOIN c ON state = c_state AND (contains(label, other) OR contains(other, label)) WHERE length(label) >= 4 AND length(other) >= 6 AND label <> other AND (postal IS NULL OR c_postal IS NULL OR postal = c_postal))
SELECT page_id, min(struct_pack(seq := seq, how := how)).seq AS seq, min(struct_pack(seq := seq, how := how)).how AS how FROM m GROUP BY page_id""")
def name_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by their titles, in the language and under the number of their address, against all words of all documents as names, in theirs: equal, or one inside the other."""
    part = lambda p: F.nullif(F.regexp_extract("url", p, 1), F.lit(""))
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    stores = table(spark, sf_dir, "pages").select(F.col("page_id").alias("store_id"), text.core_name(title).alias("label"), part("://[^/?#]*/([a-z][a-z])/").alias("state"), F.left(part("://[^/?#]*/[a-z][a-z]/([0-9]+)"), F.lit(5)).alias("postal"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0))
    customers = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("lang").alias("c_state"), F.when(F.col("n_chars") < 100, F.col("n_chars").cast("string")).alias("c_postal"), F.explode(words).alias("other"))
    customers = customers.where(F.length("other") >= LEAST).groupBy("other", "c_state", "c_postal").agg(F.min("seq").alias("seq"))  # one row a word and place
    names = by_name(stores, customers)
    on = reduce(lambda a, b: a & b, [stores[k].eqNullSafe(names[k]) for k in ("label", "state", "postal")])
    return stores.join(names.hint("merge"), on).select(F.col("store_id").alias("page_id"), "seq", "how")
