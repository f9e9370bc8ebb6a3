"""Queries do the whole job: no part of the rows is left out."""

from retail_lens import catalog, registry

SF = "/root/testdata/sf0.001"


def test_every_listing_has_a_price_row_and_every_knit_product_counts(spark):
    queries, listings = registry.queries(), catalog.listings(spark, SF)
    assert queries["price_usd"](spark, SF).count() == listings.count()
    products = {r.domain: r.products for r in queries["knit_quartiles"](spark, SF).collect()}
    assert products == {r["domain"]: r["count"] for r in listings.where("knit_kind <> ''").groupBy("domain").count().collect()}
