"""Sightings merged to stores: one row a business and one a building, by folds in the sightings' order that never hold a business in one list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import dealt, table
from ..functions.place import infer_country, state_code
from ..functions.text import name_key, plain_key
from ..functions.url import canonical_domain, origin, social_profile, store_website
from ..registry import query
from ..scratch import drop, saved
from .identity import resolve

COLUMNS = ("name", "source", "website", "instagram", "facebook", "address", "city", "state", "postal_code", "country", "phone", "place_id", "business_status", "note", "query")
#: Sources whose names are cleaner than others', by rank; all others have the last.
NAME_RANK, LAST_RANK = {"google_places": 0}, 9
#: Searches and notes that a store keeps, and characters of a note.
QUERIES, NOTES, NOTE_CHARS = 8, 4, 400
DETAILS = ("phone", "place_id", "postal_code")


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def identified(sightings: DataFrame, countries: tuple[str, ...], exclude: tuple[str, ...]) -> DataFrame:
    """The sightings that count, with site, the profiles' urls, country, rank and the keys that they are known by.

    Left out: blank names, places closed for good, places of a known country that is not among ``countries``, excluded domains, and those without a key.
    """
    t = sightings.select("seq", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in COLUMNS))
    t = t.where((F.trim("name") != "") & (F.col("business_status") != "CLOSED_PERMANENTLY"))
    linked = social_profile(F.col("website"), F.lit(""))  # a website that is really a profile
    given = lambda network: F.when((F.col(network) == "") & (F.col("linked.network") == network), F.col("linked.url")).otherwise(F.col(network))
    t = t.withColumn("linked", linked).withColumns({"country": infer_country(F.col("country"), F.col("state"), F.col("postal_code")), **{f"{n}_at": social_profile(given(n), F.lit(n)) for n in ("instagram", "facebook")}})
    abroad = (F.col("country") != "") & ~F.col("country").isin(*countries)
    barred = (F.col("website") != "") & F.col("linked").isNull() & canonical_domain(F.col("website")).isin(*exclude)
    region = F.coalesce(_filled(state_code(F.col("state"))), _filled(F.col("state")), F.col("country"))
    t = t.withColumns({"counts": ~abroad & ~barred, "site": store_website(F.col("website"), exclude), "region": region, "called": name_key(F.col("name"))})
    place = lambda what: F.concat(F.lit("place:"), "called", F.lit("|"), what, F.lit("|"), "region")
    keys = F.array_compact(F.array(
        F.when(F.col("site") != "", F.concat(F.lit("site:"), "site")), F.concat(F.lit("in:"), "instagram_at.key"), F.concat(F.lit("fa:"), "facebook_at.key"),
        F.when(F.col("postal_code") != "", place(F.left("postal_code", F.lit(5)))), F.when(F.col("city") != "", place(plain_key(F.col("city"))))))
    rank = F.coalesce(*(F.when(F.col("source") == s, r) for s, r in NAME_RANK.items()), F.lit(LAST_RANK))
    kept = t.withColumns({"keys": keys, "rank": rank, "name": F.trim("name"), "note": F.left(F.trim("note"), F.lit(NOTE_CHARS)), "instagram": F.col("instagram_at.url"), "facebook": F.col("facebook_at.url")})
    # written down before it is asked whether they count: Spark moves a filter below the columns that it reads, with all that they are made of put in by copy
    known = saved(kept.drop("linked", "instagram_at", "facebook_at", "business_status", "region", "called"), "sightings")
    return known.where(F.col("counts") & (F.size("keys") > 0)).drop("counts")


def first_seen(rows: DataFrame, value: str, most: int | None) -> DataFrame:
    """(store, value): an array of a store's distinct non-empty values in order of first sight, at most ``most``. Values are one row each before they are ranked,
    and the first ``most`` of a store are kept in each task before they meet, so a store that a tenth of all rows are of is no list. Without ``most``, for values of which there are few."""
    once = rows.where((F.col(value).isNotNull()) & (F.col(value) != "")).groupBy("store", value).agg(F.min("seq").alias("seq"))
    if most is not None:
        once = once.withColumn("k", F.row_number().over(Window.partitionBy("store").orderBy("seq", value))).where(F.col("k") <= most)
    return once.groupBy("store").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", value))), lambda x: x[value]).alias(value))


def _towns(known: str, find: bool) -> Column:
    """The keys under which a place is registered, or (``find``) sought, so that two places meet exactly if they are near: by postal code if both have
    one, else by town in states that do not contradict. ``known`` is the column that holds its postal code."""
    key = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    zip5, town, state, none = F.col(known), F.col("town"), F.col("state"), F.lit("")
    by_zip = F.when(zip5 != "", key("zip", zip5, none))
    out = [by_zip]
    for has in ("with", "without"):  # a postal code
        open_ = F.lit(True) if find and has == "without" else (zip5 == "") if find or has == "without" else (zip5 != "")
        here = (town != "") & open_
        if find:
            out += [F.when(here & (state == ""), key(f"any {has}", town, none)), F.when(here & (state != ""), key(f"in {has}", town, state)), F.when(here & (state != ""), key(f"in {has}", town, none))]
        else:
            out += [F.when(here, key(f"any {has}", town, none)), F.when(here, key(f"in {has}", town, state))]
    return F.array_compact(F.array(*out))


def locations(rows: DataFrame) -> DataFrame:
    """(store, building, address, city, state, postal_code, country, phone, place_id, at): one row a building of each store. building is the seq
    that first gave it; at, the first seq that has to do with it, orders a store's buildings.

    Full addresses are one building if they share the postal code (or town), the street number (or street) and the state. A sighting with a town alone goes
    into the earliest building near it, before or after it; else into an earlier town-only sighting near it; else it is a place of its own. Near is the same postal
    code, or, where one has none, the same town and no other state. Details that the first sighting lacks come from later ones. A store's places meet through keys, never all with all.
    Where nearness goes in chains (a near b near c, but a not c), a town-only sighting counts as seen if any earlier one is near, kept or not.
    """
    p = rows.where((F.col("address") != "") | (F.col("city") != ""))
    number = F.regexp_extract("address", r"^\s*(\d+)", 1)
    p = p.select("store", "seq", "address", "city", "state", "postal_code", "country", "phone", "place_id", F.left("postal_code", F.lit(5)).alias("zip5"), plain_key(F.col("city")).alias("town"), F.coalesce(_filled(number), plain_key(F.col("address"))).alias("street"))
    p = p.withColumn("area", F.coalesce(_filled(F.col("zip5")), F.col("town")))
    what = F.struct("seq", "address", "city", "state", "postal_code", "country", "zip5", "town")
    full, vague = p.where("address <> ''"), p.where("address = ''")
    first = saved(full.groupBy("store", "area", "street", "state").agg(F.min(what).alias("first")), "buildings")
    seen = full.join(first.select("store", "area", "street", "state", F.col("first.seq").alias("building")), ["store", "area", "street", "state"]).select("store", "building", "seq", *DETAILS)

    # every full address is registered, not a building's first alone: any of them may be the one that is near
    known = full.join(first.select("store", "area", "street", "state", F.col("first.seq").alias("building")), ["store", "area", "street", "state"])
    known = known.select("store", "building", F.explode(_towns("zip5", find=False)).alias("key")).groupBy("store", "key").agg(F.min("building").alias("near"))
    asked = vague.select("store", "seq", F.explode(_towns("zip5", find=True)).alias("key"))
    hits = asked.join(known, ["store", "key"]).groupBy("store", "seq").agg(F.min("near").alias("building"))
    vague = saved(vague.join(hits, ["store", "seq"], "left"), "vague")
    loose = vague.where("building is null").drop("building")
    others = loose.select("store", "seq", F.explode(_towns("zip5", find=False)).alias("key")).groupBy("store", "key").agg(F.min("seq").alias("near"))
    owners = loose.select("store", "seq", F.explode(_towns("zip5", find=True)).alias("key")).join(others, ["store", "key"]).groupBy("store", "seq").agg(F.min("near").alias("near"))
    loose = loose.join(owners, ["store", "seq"], "left").withColumn("building", F.least("seq", F.coalesce("near", "seq")))
    placed = vague.where("building is not null").select("store", "building", "seq", *DETAILS).unionByName(loose.select("store", "building", "seq", *DETAILS)).unionByName(seen)
    later = F.col("seq") >= F.col("building")
    detail = lambda c: F.min(F.when(later & (F.col(c) != ""), F.struct("seq", c)))[c].alias(c)
    gathered = placed.groupBy("store", "building").agg(F.min("seq").alias("at"), *(detail(c) for c in DETAILS))
    kept = first.select("store", "first.*").select("store", F.col("seq").alias("building"), "address", "city", "state", "country").unionByName(loose.where("seq = building").select("store", "building", "address", "city", "state", "country"))
    empty = {c: F.coalesce(c, F.lit("")) for c in DETAILS}
    return kept.join(gathered, ["store", "building"]).withColumns(empty).select("store", "building", "address", "city", "state", "postal_code", "country", "phone", "place_id", "at")


def merge(sightings: DataFrame, countries: tuple[str, ...], exclude: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(stores, locations) of sightings: seq and COLUMNS. Sightings that share a website's domain, a profile, or a name with a postal code or town are one store.

    The order is that of seq, which tells sightings apart; null texts are empty. A store is known by its least seq (``store``) and by store_id: its website's domain, else its
    first place key, else its first profile. Its name is that of the best source, the earliest of those; website and profiles are the first that it has; sources are all, queries the
    first 8, notes the first 4, each once in order of sight. What a store has is folded with minima that combine before rows meet, so a store that very many sightings are of is
    no one task's; its buildings are rows of ``locations``, as there may be any number. Empty sightings give empty tables.
    """
    kept = identified(sightings, countries, exclude)
    rows = saved(kept.join(resolve(kept, "seq", "keys"), "seq"), "labelled")
    drop(kept)
    first = lambda c, when=None: F.min(F.when(F.col(c) != "" if when is None else when, F.struct("seq", F.col(c).alias("v"))))["v"]
    starting = lambda p: F.get(F.filter("keys", lambda k: k.startswith(p)), F.lit(0))
    by = {p: starting(p) for p in ("place:", "in:", "fa:")}
    folded = rows.withColumns({f"key_{p[:2]}": v for p, v in by.items()}).groupBy("store").agg(
        F.count("*").alias("sightings"), F.min(F.struct("rank", "seq", "name"))["name"].alias("name"), first("website", F.col("site") != "").alias("site_url"), first("site").alias("site"), first("instagram").alias("instagram"), first("facebook").alias("facebook"),
        *(first(f"key_{p[:2]}").alias(f"key_{p[:2]}") for p in by))
    store_id = F.coalesce("site", F.regexp_replace("key_pl", "^place:", ""), "key_in", "key_fa", name_key(F.col("name")))
    places = saved(locations(rows), "locations")
    primary = places.groupBy("store").agg(F.count("*").alias("location_count"), F.min(F.struct("at", "building", "address", "city", "state", "postal_code", "country", "phone", "place_id")).alias("p"))
    lists = reduce(lambda a, b: a.join(b, "store", "left"), (first_seen(rows, c, n) for c, n in (("source", None), ("query", QUERIES), ("note", NOTES))), folded)
    text = lambda c, sep: F.coalesce(F.array_join(c, sep), F.lit("")).alias({"source": "sources", "query": "found_by", "note": "notes"}[c])
    whole = lists.join(primary, "store", "left")
    plain = lambda c, name=None: F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")).alias(name or c)
    stores = whole.select(
        "store", store_id.alias("store_id"), "name", plain(origin(F.col("site_url")), "website"), F.when(F.col("site").isNotNull(), "source").otherwise("").alias("website_source"), plain("instagram"), plain("facebook"), text("source", "; "), text("query", " | "), text("note", " | "), "sightings",
        F.coalesce("location_count", F.lit(0)).alias("location_count"), *(plain(F.col(f"p.{c}"), c) for c in ("address", "city", "state", "postal_code", "country", "phone", "place_id")))
    return stores, places


#: What a customer's key stands for as a sighting, in SQL that Spark and DuckDB read alike. A tenth of all are of one chain.
_SIGHTING = {
    "name": "CASE WHEN k % 10 = 0 THEN concat('Big Chain ', k % 3) WHEN k % 7 < 3 THEN concat('The Corner Shop ', k % 400) WHEN k % 97 = 5 THEN ' ' ELSE concat(' Café ', k % 400, ' Co') END",
    "source": "CASE k % 4 WHEN 0 THEN 'web_search' WHEN 1 THEN 'google_places' WHEN 2 THEN 'social_search' ELSE 'ai_agent' END",
    "website": "CASE WHEN k % 10 = 0 THEN concat('https://www.bigchain.com/stores/', k) WHEN k % 31 = 1 THEN concat('https://www.instagram.com/Handle', k % 60, '/') WHEN k % 37 = 2 THEN 'http://barred.com/x' WHEN k % 3 = 1 THEN concat('http://store', k % 250, '.com/') WHEN k % 41 = 3 THEN 'https://www.yelp.com/biz/x' ELSE '' END",
    "instagram": "CASE WHEN k % 11 = 0 THEN concat('@handle', k % 60) ELSE '' END",
    "facebook": "CASE WHEN k % 23 = 0 THEN concat('https://facebook.com/Page', k % 90) ELSE '' END",
    "address": "CASE WHEN k % 6 = 0 THEN concat(k % 50, ' Main St') WHEN k % 6 = 1 THEN 'Harbour Road' ELSE '' END",
    "city": "CASE WHEN k % 5 < 3 THEN concat('Town ', k % 8) ELSE '' END",
    "state": "CASE WHEN k % 19 = 4 THEN 'ON' WHEN k % 3 = 0 THEN 'NY' WHEN k % 3 = 1 THEN 'CA' ELSE '' END",
    "postal_code": "CASE WHEN k % 7 < 2 THEN concat('100', 10 + k % 6, '-1') ELSE '' END",
    "country": "''",
    "phone": "CASE WHEN k % 8 = 0 THEN concat('555-', k) ELSE '' END",
    "place_id": "CASE WHEN k % 4 = 1 THEN concat('p', k) ELSE '' END",
    "business_status": "CASE WHEN k % 29 = 0 THEN 'CLOSED_PERMANENTLY' ELSE '' END",
    "note": "concat('note ', k % 9)",
    "query": "concat('q', k % 13)",
}
_MERGED_SQL = f"""
WITH RECURSIVE g AS (SELECT c_custkey AS k, * FROM customer),
c AS (SELECT k AS seq, {', '.join(f'{v} AS {c}' for c, v in _SIGHTING.items())} FROM g),
d AS (SELECT *, CASE WHEN state = 'ON' THEN 'CA' WHEN state <> '' THEN 'US' ELSE '' END AS land, regexp_extract(website, '^https?://(www[.])?([^/]+)', 2) AS host, strip_accents(lower(regexp_replace(name, '^ *[Tt]he ', ''))) AS low FROM c WHERE trim(name) <> '' AND business_status <> 'CLOSED_PERMANENTLY'),
e AS (SELECT *, CASE WHEN host NOT IN ('', 'instagram.com', 'yelp.com') THEN host ELSE '' END AS site, CASE WHEN instagram <> '' THEN substr(instagram, 2) WHEN host = 'instagram.com' THEN lower(regexp_extract(website, 'com/([^/]+)', 1)) ELSE '' END AS ig, lower(regexp_extract(facebook, 'com/(.+)', 1)) AS fb,
  regexp_replace(regexp_replace(low, '[^a-z0-9]', '', 'g'), '(inc|llc|ltd|co|corp|company)$', '') AS nk, regexp_replace(lower(city), '[^a-z0-9]', '', 'g') AS town, left(postal_code, 5) AS zip5 FROM d WHERE land IN ('', 'US') AND host <> 'barred.com'),
f AS (SELECT *, list_filter([CASE WHEN site <> '' THEN 'site:' || site END, CASE WHEN ig <> '' THEN 'in:' || ig END, CASE WHEN fb <> '' THEN 'fa:' || fb END, CASE WHEN zip5 <> '' THEN 'place:' || nk || '|' || zip5 || '|' || state END, CASE WHEN city <> '' THEN 'place:' || nk || '|' || town || '|' || state END], lambda x: x IS NOT NULL) AS keys FROM e),
l AS (SELECT DISTINCT seq, unnest(keys) AS key FROM f),
h AS (SELECT key, min(seq) AS hub FROM l GROUP BY key),
n AS (SELECT DISTINCT seq AS a, hub AS b FROM l JOIN h ON h.key = l.key UNION SELECT hub, seq FROM l JOIN h ON h.key = l.key),
r AS (SELECT DISTINCT seq, seq AS other FROM l UNION SELECT r.seq, n.b FROM r JOIN n ON n.a = r.other),
s AS (SELECT seq, min(other) AS store FROM r GROUP BY seq),
m AS (SELECT store, f.* FROM f JOIN s ON s.seq = f.seq),
p AS (SELECT *, CASE WHEN zip5 <> '' THEN zip5 ELSE town END AS area, CASE WHEN regexp_matches(address, '^[0-9]') THEN regexp_extract(address, '^([0-9]+)', 1) ELSE regexp_replace(lower(address), '[^a-z0-9]', '', 'g') END AS street FROM m WHERE address <> '' OR city <> ''),
b AS (SELECT *, min(seq) OVER (PARTITION BY store, area, street, state) AS building FROM p WHERE address <> ''),
v AS (SELECT p.*, (SELECT min(b.building) FROM b WHERE b.store = p.store AND CASE WHEN b.zip5 <> '' AND p.zip5 <> '' THEN b.zip5 = p.zip5 ELSE p.town <> '' AND b.town = p.town AND (b.state = '' OR p.state = '' OR b.state = p.state) END) AS building FROM p WHERE address = ''),
w AS (SELECT v.* EXCLUDE (building), (SELECT min(o.seq) FROM v o WHERE o.building IS NULL AND o.store = v.store AND o.seq <= v.seq AND CASE WHEN o.zip5 <> '' AND v.zip5 <> '' THEN o.zip5 = v.zip5 ELSE v.town <> '' AND o.town = v.town AND (o.state = '' OR v.state = '' OR o.state = v.state) END) AS building FROM v WHERE building IS NULL),
t AS (SELECT * FROM b UNION ALL BY NAME SELECT * FROM v WHERE building IS NOT NULL UNION ALL BY NAME SELECT * FROM w),
o AS (SELECT store, building, max(address) FILTER (WHERE seq = building) AS address, max(city) FILTER (WHERE seq = building) AS city, max(state) FILTER (WHERE seq = building) AS state, max(land) FILTER (WHERE seq = building) AS country,
  coalesce(arg_min(phone, seq) FILTER (WHERE seq >= building AND phone <> ''), '') AS phone, coalesce(arg_min(place_id, seq) FILTER (WHERE seq >= building AND place_id <> ''), '') AS place_id, coalesce(arg_min(postal_code, seq) FILTER (WHERE seq >= building AND postal_code <> ''), '') AS postal_code, min(seq) AS at
  FROM t GROUP BY store, building HAVING count(*) FILTER (WHERE seq = building) > 0),
q AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY "at", building) AS i, count(*) OVER (PARTITION BY store) AS n FROM o)"""


def _sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    k = dealt(k, k.count(), "k")  # a file that is small may be one task's, and what is asked of a sighting is much
    return k.select(F.col("k").alias("seq"), *(F.expr(v).alias(c) for c, v in _SIGHTING.items()))


def _list(c: str, name: str, most: int, sep: str) -> str:
    return f"{name} AS (SELECT store, string_agg({c}, '{sep}' ORDER BY i) AS {name} FROM (SELECT store, {c}, row_number() OVER (PARTITION BY store ORDER BY min(seq)) AS i FROM m GROUP BY store, {c}) WHERE i <= {most} GROUP BY store)"


@query(f"""{_MERGED_SQL}, {_list('source', 'sources', 99, '; ')}, {_list('query', 'found_by', 8, ' | ')}, {_list('note', 'notes', 4, ' | ')},
x AS (SELECT store, count(*) AS sightings, trim(first(name ORDER BY CASE source WHEN 'google_places' THEN 0 ELSE 9 END, seq)) AS name, arg_min(site, seq) FILTER (WHERE site <> '') AS site, arg_min(website, seq) FILTER (WHERE site <> '') AS url, arg_min(ig, seq) FILTER (WHERE ig <> '') AS ig, arg_min(regexp_extract(facebook, 'com/(.+)', 1), seq) FILTER (WHERE fb <> '') AS fb, arg_min(fb, seq) FILTER (WHERE fb <> '') AS fa,
  arg_min(CASE WHEN zip5 <> '' THEN nk || '|' || zip5 || '|' || state ELSE nk || '|' || town || '|' || state END, seq) FILTER (WHERE zip5 <> '' OR city <> '') AS pl FROM m GROUP BY store)
SELECT x.store AS store, coalesce(site, pl, 'in:' || ig, 'fa:' || fa) AS store_id, name, coalesce(regexp_extract(url, '^https?://[^/]+'), '') AS website, CASE WHEN site IS NULL THEN '' ELSE 'source' END AS website_source, coalesce('https://www.instagram.com/' || ig || '/', '') AS instagram, coalesce('https://www.facebook.com/' || fb, '') AS facebook, sources, found_by, notes, sightings,
  coalesce(n, 0) AS location_count, coalesce(address, '') AS address, coalesce(city, '') AS city, coalesce(state, '') AS state, coalesce(postal_code, '') AS postal_code, coalesce(country, '') AS country, coalesce(phone, '') AS phone, coalesce(place_id, '') AS place_id
FROM x JOIN sources ON sources.store = x.store JOIN found_by ON found_by.store = x.store JOIN notes ON notes.store = x.store LEFT JOIN q ON q.store = x.store AND i = 1""")
def merged_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sightings of stores, merged: one row a store. The sightings of one chain are a tenth of all."""
    return merge(_sightings(spark, sf_dir), ("US",), ("barred.com",))[0]


@query(f'{_MERGED_SQL} SELECT store, building, address, city, state, postal_code, country, phone, place_id, "at" FROM o')
def store_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buildings of the merged stores."""
    return merge(_sightings(spark, sf_dir), ("US",), ("barred.com",))[1]
