import hashlib
import re

from retail_lens.llm import common, urls, warc
from retail_lens.llm.components import connected_components

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\n"
PAGES = [
    (1, "http://a", "x" * 150, 0), (2, "http://b", None, 0), (3, None, "x" * 150, 0), (4, "http://c", "pre" + FAKE + "post" * 300 + FAKE, 0), (5, "u", FAKE, 0), (6, "u", "ü" * 99, 0), (7, "u", "WARC/1.", 0),
    (8, "u\r\nX: y", "a\r\n\r\n", 0), (9, "u", "short", 0), (10, "u", "short", 0), (11, "u", "y" * 200000, 0), (12, "u", "ü" * 99, 0), (13, "v", "x" * 150, 0),
]
SCHEMA = "page_id long, url string, html string, digest long"


def test_warc_round_trip_rejects_magic_inside_payloads(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        df = spark.createDataFrame(PAGES, SCHEMA).coalesce(2)
        path = common.scratch_dir(spark, "archives")
        warc.write_warc(warc.payload_records(df), path)
        got = {int(r.record_id): r for r in warc.read_warc(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    first: dict = {}
    assert sorted(got) == [p[0] for p in PAGES]
    for i, _, html, _ in PAGES:
        payload = (html or "").encode()
        ref = first.setdefault(payload, i) if len(payload) >= 100 else i
        assert (got[i].digest, got[i].size) == (hashlib.sha256(payload).hexdigest(), len(payload))
        assert (got[i].type, got[i].refers_to) == (("revisit", str(ref)) if ref != i else ("response", None)) or got[i].refers_to in ("", None)
        assert bytes(got[i].payload) == (payload if ref == i else b"")


def test_warc_keeps_records_with_magic_in_their_headers(spark):
    """At the start, in the middle, at the end, twice, and where look-alikes name lengths of their own; in splits of any size."""
    sites = ["http://a.org/{}WARC/1.0", "WARC/1.0", "WARC/1.", "http://b/WARC/1.0/WARC/1.1/x", "\u2028Content-Length: 3 WARC/1.0\r\nContent-Length: 9", "WARC/1.0\r\n\r\nWARC/1.0\r\n", "plain"]
    pages = [(i, sites[i % 7].format(i), f"{i} " * 40 + (FAKE if i % 2 else ""), 0) for i in range(28)]
    path, splits = common.scratch_dir(spark, "archives"), "spark.sql.files.maxPartitionBytes"
    warc.write_warc(warc.payload_records(spark.createDataFrame(pages, SCHEMA).coalesce(1)), path)
    try:
        for size in ("150", "700", "100000"):
            spark.conf.set(splits, size)
            got = warc.read_warc(spark, path).collect()
            assert sorted((int(r.record_id), bytes(r.payload).decode()) for r in got) == [(p[0], p[2]) for p in pages]
            assert all(f"WARC-Target-URI: {re.sub('[\r\n]+', ' ', sites[int(r.record_id) % 7].format(r.record_id))}\r\n" in r.header for r in got)
    finally:
        spark.conf.unset(splits)


def test_registered_warc_query_returns_a_row_a_page(spark, tmp_path):
    pages = [(1, "http://a.org/", "x" * 150), (2, "http://a.org/WARC/1.0", None), (3, None, "x" * 150), (4, "u", FAKE), (4, "u", FAKE)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.op1_warc(spark, str(tmp_path)).collect())
    assert got == [(1, 150, "response", None), (2, 0, "response", None), (3, 150, "revisit", 1), (4, len(FAKE), "response", None), (4, len(FAKE), "response", None)]


def test_warc_of_no_pages(spark):
    path = common.scratch_dir(spark, "archives")
    warc.write_warc(warc.payload_records(spark.createDataFrame([], SCHEMA)), path)
    assert warc.read_warc(spark, path).count() == 0


def test_warc_of_a_row_without_key(spark):
    path = common.scratch_dir(spark, "archives")
    warc.write_warc(warc.payload_records(spark.createDataFrame([(None, None, "x" * 200, None), (3, "u", "x" * 200, None)], SCHEMA)), path)
    assert {(r.type, r.record_id, r.size) for r in warc.read_warc(spark, path).collect()} == {("response", None, 200), ("response", "3", 200)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (200, 200), (300, 301), (301, 300), (None, 5)] + [(500, 500 + i) for i in range(1, 40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100, 300: 300, 301: 300} | {500 + i: 500 for i in range(40)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


URLS = [
    ("HTTP://WWW.Example.NET/en/x?q", "www.example.net", "/en/x", "example.net/en/", "allow"), ("http://x.net", "x.net", "", None, "allow"), ("http://x.net/", "x.net", "/", "net/", "block"),
    ("http://badnet/", "badnet", "/", None, "allow"), ("a://b://c.net/p#f", "b:", "//c.net/p", None, "allow"), ("no scheme.net/", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
    ("http://a.example.com/de/1", "a.example.com", "/de/1", "example.com/de/", "block"), ("http://É.org/fr/", "É.org", "/fr/", "org/fr/", "allow"), ("http://x.org/y", "x.org", "/y", None, "allow"),
]


def test_rules(spark):
    df = spark.createDataFrame([(i, u[0], None, "r") for i, u in enumerate(URLS)], "page_id long, url string, html string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect()}
    assert got == {i: u[1:] for i, u in enumerate(URLS)}
    assert urls.judge(df.limit(0)).count() == 0


def test_decisions_reach_aliases_and_allow_goes_first(spark):
    pages = [
        (1, "http://alias.org/1", '<link rel="canonical" href="http://bad.net/1">'), (2, "http://alias.org/2", '<META http-equiv=refresh content="0; url=/3">'), (3, "http://alias.org/3", "<link href='http://x.net/z' rel='canonical'>"),
        (4, "http://saved.org/4", '<link rel="canonical" href="//bad.net/4">'), (5, "http://saved.org/5", '<link rel=canonical href="http://ok.example.net/en/5">'), (6, "http://alone.org/6", "<p>canonical</p>"), (7, "http://bad.net/4", None),
        (8, "http://far.org/a/b/c?x=1&y=2", "<link rel='canonical' href='../d'>"), (9, "http://x.org/z", '<link rel=canonical href="HTTP://Far.org:80/a/./d#top">'), (10, "http://Y.org", '<link rel="canonical" href="http://far.org/a/b/c?x=1&amp;y=2">'),
        (11, "http://y.org/", "<link rel=canonical href='http://bad.net/../q'>"), (12, None, "<link rel=canonical href='http://bad.net/q'>"), (13, "http://lone.org/", "<link rel=canonical href='#'>"),
    ]
    redirects = spark.createDataFrame([("http://saved.org/4", "http://saved.org/5"), (None, "x")], "a string, b string")
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), redirects).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "block", 9: "block", 10: "block", 11: "block", 12: "allow", 13: "allow"}


def test_registered_url_query_against_a_plain_version(spark):
    """Hosts, paths, rules and ruled verdicts of all pages; without links that meet, others are allowed."""
    sf = "/root/testdata/sf0.001"

    def plain(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        h, p = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = [(len(r), a, r) for a, r in urls.RULES for d, s, t in [r.partition("/")] if (h == d or h.endswith("." + d)) and p.startswith(s + t)]
        return (h, p, max(fit)[2], max(fit)[1]) if fit else (h, p, None, "allow")

    want = {r.page_id: plain(r.url) for r in common.table(spark, sf, "pages").collect()}
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.op2_urls(spark, sf).collect()} == want
