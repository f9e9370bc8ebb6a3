"""Cases of the contracts that small tables don't have: links that are none, spellings that are one, letters that are none, and equal rows by the thousand."""

from pyspark.sql import functions as F

from retail_lens.llm import decontamination, language, packing, pii, urls
from tests.llm import helpers


def test_links_in_comments_and_scripts_are_none_and_base_counts(spark):
    link = '<link rel="canonical" href="{}">'
    pages = [
        (1, "http://a.org/1", "<!-- " + link.format("http://bad.net/1") + " --><p>"), (2, "http://a.org/2", "<script>var x = '" + link.format("http://bad.net/2") + "'</script>"), (3, "http://a.org/3", "<p><!-- never closed " + link.format("http://bad.net/3")),
        (4, "http://b.org/x", '<base href="http://bad.net/"><link rel=canonical href="x">'), (5, "http://c.org/d/x", "<base href='../e/'>" + link.format("y")), (6, "http://c.org/d/../e/y", ""), (7, "http://bad.net/ru", link.format("http://c.org/e/y")),
        (8, "http://d.org/~a", ""), (9, "http://d.org/%7ea", ""), (10, "http://bad.net/z", link.format("http://d.org/%7Ea")), (11, "http://d.org/%2f", ""), (12, "http://bad.net/w", link.format("http://d.org/%2F")), (13, "http://d.org//", ""), (14, "http://d.org/100%", ""),
        (15, "http://e.org/1", "<base>" + "<BASE HREF='http://bad.net/'>" + "<title>" + link.format("/no") + "</title>" + link.format("/yes")),
    ]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {k for k, v in got.items() if v == "block"} == {4, 5, 6, 7, 8, 9, 10, 11, 12, 15}


def test_escapes_have_one_spelling(spark):
    given = ["http://a/%41%7E%2f%zz%", "http://a/%2E%2e/b?q=%61%3d", "http://a/é%C3%A9%"]
    got = [r[0] for r in spark.createDataFrame([(i, u) for i, u in enumerate(given)], "i int, u string").orderBy("i").select(urls.canonical(F.col("u"))).collect()]
    assert got == ["http://a/A~%2F%zz%", "http://a/b?q=a%3D", "http://a/é%C3%A9%"]


def test_numbers_are_no_letters(spark):
    assert language.letters("½ ² ① Ⅷ ١٢ _") == [] and language.letters("a½b② Ünï_x1y 漢字٣ß") == ["a", "b", "ünï", "x", "y", "漢字", "ß"]
    rows = [(i, t, x) for i, (t, x) in enumerate([("the house and the tree", "en"), ("la maison et un arbre", "fr")] * 30)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = spark.createDataFrame([(0, "½ ² ①"), (1, "123 ... _"), (2, None), (3, ""), (4, "la½maison"), (None, "the tree"), (None, "the tree")], "doc_id long, text string")
    got = [(r.doc_id, r.lang_pred) for r in language.identify(odd, model).collect()]
    assert sorted(got, key=repr) == sorted([(0, "und"), (1, "und"), (2, "und"), (3, "und"), (4, "fr"), (None, "en"), (None, "en")], key=repr)
    assert all(r.score == 0 for r in language.identify(odd, model).where("lang_pred = 'und'").collect())


def test_equal_rows_go_to_many_packs(spark):
    docs = spark.range(20_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "700L AS n")
    placed = packing.best_fit(docs, "n")
    assert placed.count() == 20_000 and placed.where("doc_id is not null").count() == 0
    packs = {r[0]: r[1] for r in placed.groupBy((F.col("bin_id") % 4).alias("pack")).count().collect()}
    assert len(packs) == 4 and max(packs.values()) < 6000


def test_addresses_and_numbers_in_other_forms_are_found(spark):
    found = {
        "reach me at ann at shop dot com please": "ann at shop dot com", "my mobile (239)555-0101 is on": "(239)555-0101", "call 020 7946 0018 now": "020 7946 0018", "phone: 0161-496 0123 today": "0161-496 0123", "server 2001:db8::1 again": "2001:db8::1", "from address fe80::1ff:fe23:4567:890a here": "fe80::1ff:fe23:4567:890a",
    }
    none = ["std::vector and a::b", "score 3::2 at the end", "we meet at noon dot", "at 12 dot 30", "version 012 345 678", "order 020 7946 0018 shipped", "times 10::20", "part (123)4567890"]
    df = spark.createDataFrame(list(enumerate([*found, *none])), "doc_id long, text string")
    trees = pii.fit(df)
    assert set(trees.report) == set(pii.KINDS) and all(p >= pii.PRECISION and r > 0.6 for p, r, _ in trees.report.values()), trees.report
    got = {r.doc_id: [r.text[s.start : s.stop] for s in r.spans] for r in df.withColumn("spans", pii.find_spans(F.col("text"), trees)).collect()}
    assert got == {i: [t] if t else [] for i, t in enumerate([*found.values(), *[""] * len(none)])}


def test_a_large_benchmark_is_scanned_in_bounded_tasks(spark):
    rows = helpers.documents()
    items = [(f"i{k}", r[1]) for k, r in enumerate(rows) if r[1] and len(r[1]) < 1200][:20]
    docs, test = helpers.frame(spark, rows), spark.createDataFrame(items, "item_id string, text string")
    out = decontamination.scan_benchmark(docs, test, block_words=1000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("MapInArrow") <= decontamination.SETS_AT_ONCE
    want = helpers.benchmark_hits(rows, items)
    assert {r.doc_id: (r.n_words, sum(r.hit), sorted(r["items"])) for r in out.collect()} == want
