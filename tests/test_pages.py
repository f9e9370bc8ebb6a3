"""Public suffixes, main content and the densest window, case by case and against plain versions."""

import random
import re

from pyspark.sql import functions as F

from retail_lens.functions import url
from retail_lens.operators import condense, suffixes
from retail_lens.plans.facts import facts


def test_exact_wildcard_and_exception_rules(spark):
    rules = suffixes.rule_table(spark, spark.createDataFrame([(x,) for x in ("// a comment", "", "com", "co.uk ", "uk", "*.ck", "!www.ck", "*.kobe.jp", "!city.kobe.jp", "jp", "myshopify.com", "CO.UK", "a.b.c.deep")], "rule string"))
    want = {
        "shop.example.co.uk": ("co.uk", "example.co.uk"), "co.uk": ("co.uk", ""), "x.y.z.ck": ("z.ck", "y.z.ck"), "z.ck": ("z.ck", ""), "www.ck": ("ck", "www.ck"), "a.www.ck": ("ck", "www.ck"), "a.b.kobe.jp": ("b.kobe.jp", "a.b.kobe.jp"), "b.kobe.jp": ("b.kobe.jp", ""),
        "x.city.kobe.jp": ("kobe.jp", "city.kobe.jp"), "my.store.myshopify.com": ("myshopify.com", "store.myshopify.com"), "unknown.example": ("example", "unknown.example"), "localhost": ("localhost", ""), "10.0.0.1": ("", ""), "": ("", ""), "q.a.b.c.deep": ("a.b.c.deep", "q.a.b.c.deep"),
        "brand.bigcartel.com": ("com", "brand.bigcartel.com"), "www.bigcartel.com": ("com", "bigcartel.com"), "bigcartel.com": ("com", "bigcartel.com"), "x.brand.bigcartel.com": ("com", "brand.bigcartel.com"),
    }
    hosts = spark.createDataFrame([(h,) for h in want] * 3 + [(None,)], "host string")
    out = suffixes.owned_domains(hosts, rules)
    assert {r["host"]: (r.suffix, r.domain) for r in out.collect()} == want and out.count() == len(want)
    assert facts(out).products == 0 and facts(out).python == 0
    assert suffixes.owned_domains(hosts, rules.limit(0)).where("host = 'shop.example.co.uk'").first().domain == "co.uk"


def test_the_column_function_follows_the_built_in_rules(spark):
    hosts = ["a.b.co.uk", "a.b.web.uk", "x.y.z.ck", "a.www.ck", "q.a.b.kobe.jp", "q.city.kobe.jp", "a.b.com.jp", "a.gob.mx", "x.myshopify.com", "a.b.c.example.org", "localhost"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "i int, h string").orderBy("i")
    assert [r[0] for r in df.select(url.registrable_domain(F.col("h"))).collect()] == ["b.co.uk", "web.uk", "y.z.ck", "www.ck", "a.b.kobe.jp", "city.kobe.jp", "com.jp", "a.gob.mx", "x.myshopify.com", "example.org", "localhost"]


def plain_window(text, limit, lead):
    starts = [m.start() for m in re.finditer(condense.PRICE_MARK, text)]
    if len(text) <= limit or not starts:
        return len(starts), 0
    best = max(range(len(starts)), key=lambda i: (sum(starts[i] <= s < starts[i] + limit for s in starts), -i))
    return len(starts), max(0, starts[best] - lead)


def test_densest_window_equals_a_plain_version(spark):
    rng = random.Random(8)
    piece = lambda: rng.choice(["$", "€ ", "1.50", "12,99 ", "3.141", "word ", "1.50.12", " ", "£5 ", "Ünï ", "9.99$"])
    texts = ["".join(piece() for _ in range(rng.randint(0, 120))) for _ in range(60)] + ["", None, "no mark " * 50, "$" * 700, "x" * 300 + "$" + "y" * 300 + "$$", "1.50" * 200]
    got = {r.i: (r.marks, r.begin) for r in condense.densest_window(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "i", "t", 100, 10).collect()}
    assert got == {i: plain_window(t or "", 100, 10) for i, t in enumerate(texts)}


def test_main_content_leaves_menus_and_footers_out(spark):
    menu = "<nav>" + "".join(f"<li><a href='/{i}'>A link of the long menu, number {i}</a></li>" for i in range(20)) + "</nav>"
    story = "".join(f"<p>Paragraph {i} tells at some length &amp; in whole sentences what the shop is about.</p>" for i in range(4))
    shop = "<div>" + "".join(f"<span>Knit {i} $ {i}.50</span>" for i in range(9)) + "</div>"
    pages = [(1, f"<html><script>var a = '<p>{'x' * 90}</p>'</script>{menu}{story}<p>short</p>"), (2, f"{menu}{story}" + "<p>$1.50 </p>" * 30), (3, menu + shop), (4, None), (5, ""), (6, f"<!-- {story} -->{menu}")]
    got = {r.page_id: r for r in condense.condensed(spark.createDataFrame(pages, "page_id long, html string"), limit=1000, lead=5).collect()}
    assert got[1].from_main and got[1].blocks == 4 and got[1].text.startswith("Paragraph 0 tells at some length & in") and "menu" not in got[1].text and "xxx" not in got[1].text
    assert not got[2].from_main and got[2].marks == 60 and got[2].text.count("$1.50") == 30  # its prices are not in the story
    assert got[3].marks == 18 and "$ 8.50" in got[3].text
    assert [got[i].text for i in (4, 5)] == ["", ""] and got[6].blocks == 0
