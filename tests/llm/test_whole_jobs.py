"""Operators do the whole job in cases that small tables don't have."""

from retail_lens.llm import common, jaccard, substrings, warc
from tests.llm import helpers


def _kept(rows, window=20):
    """Of each row the words that stay, by comparing all windows."""
    texts = [(i, helpers.spaced(t)) for i, t in rows]
    least = {}
    for i, w in texts:
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            least[g] = min(least.get(g, i), i)
    out = []
    for i, w in texts:
        gone, own = set(), set()
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if least[g] < i or g in own:
                gone |= set(range(k, k + window))
            own.add(g)
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def test_rows_of_one_doc_id_take_nothing_from_each_other(spark):
    words = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    shared = words("s", 30)
    rows = [
        (1, words("a", 25)), (1, words("a", 25)), (2, shared + " " + words("b", 10)), (3, words("c", 5) + " " + shared), (3, words("d", 60)), (3, words("e", 3)), (3, words("c", 5) + " " + shared),
        (4, words("f", 30)), (4, words("g", 7) + " " + words("f", 30) + " " + words("f", 30)), (5, words("f", 25)), (5, words("h", 40)),
    ]
    for parts in (1, 3):
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert sorted((r.doc_id, r.kept) for r in substrings.remove_repeats(frame).collect()) == _kept(rows)


def test_warc_is_read_whole_though_splits_change_meanwhile(spark):
    look_alike = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    pages = [(i, f"http://{i}", f"{i} " * 200 + (look_alike if i % 3 == 0 else ""), 0) for i in range(30)]
    path, splits = common.scratch_dir(spark, "archives"), "spark.sql.files.maxPartitionBytes"
    warc.write_warc(warc.payload_records(spark.createDataFrame(pages, "page_id long, url string, html string, digest long").coalesce(1)), path)
    try:
        spark.conf.set(splits, "700")
        back = warc.read_warc(spark, path)
        for size in ("5000", "1900"):
            spark.conf.set(splits, size)
            assert sorted((int(r.record_id), bytes(r.payload).decode()) for r in back.collect()) == [(p[0], p[2]) for p in pages]
    finally:
        spark.conf.unset(splits)


def test_a_short_and_a_long_text_of_one_doc_id_both_keep_their_links(spark):
    words = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    rows = [(1, words("a", 40)), (1, words("b", 3000)), (2, words("a", 41)), (3, words("b", 3000) + " end"), (4, words("c", 30)), (5, words("c", 30)), (5, words("d", 50)), (6, words("d", 51)), (7, words("e", 30))]
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        got = sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_classes(frame).collect())
        assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4), (6, 4), (7, 7)]
