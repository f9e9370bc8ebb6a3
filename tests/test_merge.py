"""Merged sightings, case by case, and one store that has very many."""

import random

from pyspark.sql import functions as F

from retail_lens.functions import url
from retail_lens.operators import identity
from retail_lens.operators import merge as op

SCHEMA = "seq long, " + ", ".join(f"{c} string" for c in op.COLUMNS)


def sighting(seq, name="Shop", **given):
    return (seq, *(given.get(c, name if c == "name" else "web_search" if c == "source" else None) for c in op.COLUMNS))


def merged(spark, rows, exclude=()):
    stores, places = op.merge(spark.createDataFrame(rows, SCHEMA).repartition(3), ("US", "CA"), exclude)
    return {r.store: r for r in stores.collect()}, sorted((r.store, r["at"], r.address, r.city, r.phone, r.postal_code) for r in places.collect())


def test_identities_names_and_lists(spark):
    rows = [
        sighting(1, "Cedar page title | Home", website="https://www.cedar.com/about?x", query="q1", note=" n " + "x" * 500), sighting(2, "Cedar & Hyde", source="google_places", website="http://cedar.com", query="q2"), sighting(3, "Cedar Hyde", source="google_places", website="cedar.com", query="q1"),
        sighting(4, "Linked", website="https://instagram.com/Ced.Ar/"), sighting(5, "Both", website="cedar.com", instagram="@ced.ar", facebook="https://facebook.com/CedarHyde"),
        sighting(10, "The Knit Company", city="Nashville", state="Tennessee"), sighting(11, "Knit", city="NASHVILLE", state="TN", postal_code="37203"), sighting(12, "KNIT inc", postal_code="37203-99", state="tn"),
        sighting(20, "  ", website="blank.com"), sighting(21, "Closed", website="closed.com", business_status="CLOSED_PERMANENTLY"), sighting(22, "Abroad", website="abroad.com", country="France"), sighting(23, "No key", website="https://www.yelp.com/biz/x"), sighting(24, "Barred", website="barred.com"),
        sighting(30, "Only a profile", facebook="https://www.facebook.com/p/only"),
    ]
    rows += [sighting(100 + i, "Many", website="many.com", query=f"q{99 - i}", note=f"n{i}", source=f"s{i % 3}") for i in range(30)]
    stores, _ = merged(spark, rows, exclude=("barred.com",))
    assert sorted(stores) == [1, 10, 30, 100]
    cedar = stores[1]
    assert (cedar.store_id, cedar.name, cedar.website, cedar.sources, cedar.found_by, cedar.sightings) == ("cedar.com", "Cedar & Hyde", "https://www.cedar.com", "web_search; google_places", "q1 | q2", 5)
    assert (cedar.instagram, cedar.facebook, len(cedar.notes)) == ("https://www.instagram.com/ced.ar/", "https://www.facebook.com/CedarHyde", 400)
    assert (stores[10].store_id, stores[10].name, stores[10].website, stores[10].website_source) == ("knit|nashville|TN", "The Knit Company", "", "")
    assert stores[30].store_id.startswith("fa:")
    assert stores[100].found_by == " | ".join(f"q{99 - i}" for i in range(8)) and stores[100].notes == "n0 | n1 | n2 | n3" and stores[100].sources == "s0; s1; s2"


def test_one_location_a_building(spark):
    at = lambda seq, **given: sighting(seq, website="a.com", **given)
    rows = [
        at(1, city="Nashville", state="TN", phone="lost"), at(2, address="12 Main St", city="Nashville", state="TN", postal_code="37203"), at(3, address="12 main street", postal_code="37203-1", state="TN", phone="555"), at(4, address="14 Main St", city="Nashville", state="TN", postal_code="37203"),
        at(5, city="Nashville", phone="ignored", place_id="later"), at(6, city="Nashville", state="KY"), at(7, city="Memphis", state="TN"), at(8, city="MEMPHIS", phone="901"), at(9, postal_code="37203", phone="no place"), at(10, city="Elsewhere", postal_code="37203", state="TN"),
        at(11, address="Harbour Road", city="Paducah"), at(12, address="Harbour  road!", city="Paducah", phone="270"),
    ]
    stores, places = merged(spark, rows)
    # 1 and 5 go into the building of 2 (5 gives it no phone, as 3 did before); 6 is in another state; 10 is near by postal code
    assert places == [(1, 1, "12 Main St", "Nashville", "555", "37203"), (1, 4, "14 Main St", "Nashville", "", "37203"), (1, 6, "", "Nashville", "", ""), (1, 7, "", "Memphis", "901", ""), (1, 11, "Harbour Road", "Paducah", "270", "")]
    assert (stores[1].location_count, stores[1].address, stores[1].phone) == (5, "12 Main St", "555")


def test_no_sightings_and_one_store_of_very_many(spark):
    assert merged(spark, []) == ({}, [])
    many = spark.range(6000).select(F.col("id").alias("seq"), *(F.expr(v).alias(c) for c, v in {
        **dict.fromkeys(op.COLUMNS, "''"), "name": "concat('Shop ', id)", "website": "CASE WHEN id % 2 = 0 THEN 'https://chain.com' ELSE concat('s', id, '.com') END", "address": "concat(id % 1500, ' Main St')", "city": "'Town'", "state": "'TN'", "query": "concat('q', id)"}.items()))
    stores, places = op.merge(many, ("US",))
    top = stores.orderBy(F.desc("sightings")).first()
    assert (top.store, top.sightings, top.location_count, top.found_by) == (0, 3000, 750, "q0 | q2 | q4 | q6 | q8 | q10 | q12 | q14")
    assert stores.count() == 3001 and places.count() == 3750
    rows = many.select("seq", (F.col("seq") % 3).alias("store"), "query")
    assert op.first_seen(rows, "query", 8)._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2


def test_urls_are_read_once_however_functions_are_nested(spark):
    """What a function makes of a url is bound, not put in by copy, so one inside another adds to it and doesn't multiply it."""
    df = spark.createDataFrame([("https://www.Instagram.com/Handle/",), ("shop.co.uk/x",), (None,)], "u string")
    plan = lambda c: df.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    once = url.social_profile(F.col("u"), F.lit(""))
    twice = url.social_profile(F.coalesce(once["url"], F.col("u")), F.lit(""))
    assert plan(twice).count("regexp_") <= 3 * plan(once).count("regexp_")
    assert plan(url.store_website(F.col("u"))).count("regexp_") <= 20
    assert [r[0] for r in df.select(twice["key"]).collect()] == ["handle", None, None]
    assert [r[0] for r in df.select(url.store_website(F.col("u"))).collect()] == ["", "shop.co.uk", ""]


def test_stores_equal_a_union_of_keys_and_rounds_see_different_ties_alone(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.randrange(300), [rng.choice([None, "", *(f"k{j}" for j in range(220))]) for _ in range(rng.randrange(4))]) for _ in range(260)] + [(1000, None), (1001, [])]
    rows += [(2000 + i, ["chain", f"town{i % 3}"]) for i in range(3000)] + [(9000 - i, [f"link{i}", f"link{i + 1}"]) for i in range(40)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for seq, keys in rows:
        root(seq)
        for k in keys or ():
            if k:
                up[root(k)] = root(seq)
    least = {}
    for seq, _ in rows:
        least[root(seq)] = min(seq, least.get(root(seq), seq))
    written, save = [], identity._saved

    def counted(df, name):
        out = save(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(identity, "_saved", counted)
    got = identity.resolve(spark.createDataFrame(rows, "seq long, keys array<string>").repartition(3), "seq", "keys").collect()
    assert sorted((r.seq, r.store) for r in got) == sorted({(seq, least[root(seq)]) for seq, _ in rows})
    rounds = [n for name, n in written[:-1] if name == "labels"]
    assert max(rounds) < 300, "3,000 sightings with the same keys are no more work in a round than one"
