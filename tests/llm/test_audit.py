"""The filter audit against a run of every order over every document."""

import re
from itertools import permutations

import pytest

from retail_lens.llm import audit
from tests.llm import helpers


def plain(docs, labels):
    """(part, order, step) -> counts, by applying the filters one by one. docs: (doc_id, text, source)."""
    rows = []
    for doc_id, text, source in docs:
        text, w = text or "", helpers.spaced(text)
        fails = set()
        if len(w) < 200:
            fails.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
            fails.add("C")
        if re.search("[#$%&*|]", text):
            fails.add("D")
        if doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in docs):
            fails.add("E")
        mine = [x for x in labels if doc_id is not None and x[0] == doc_id]
        rows.append((source or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = {}
    for part in {r[0] for r in rows}:
        own, removed = [r for r in rows if r[0] == part], {}
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                redundant = sum(f in r[1] for r in own) - len(gone)
                out[part, order, k + 1] = [len(left), len(gone), redundant, sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                removed[f] = removed.get(f, 0) + len(gone)
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(removed[order[step - 1]])
    return out


def counts(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in audit.COUNTS] for r in df.collect()}


DOCS = [(i, t, ("a", "b", None, "")[i % 4]) for i, t in enumerate(r[1] for r in helpers.documents())]
DOCS += [(200 + i, " ".join(f"w{(k * 7) % 260}" for k in range(250)) + ("" if i % 2 else f" {i}$"), "a") for i in range(8)]
DOCS += [(300, "SHOUT " * 210, "only"), (5, DOCS[5][1], "a"), (5, DOCS[5][1], "b"), (5, "another text", "b"), (None, DOCS[5][1], "a"), (None, None, None), (None, None, None), (-1, DOCS[6][1], "b")]
LABELS = [(0, 1, 0), (1, 0, 1), (1, 1, 0), (2, 1, 1), (5, 1, 0), (200, 1, 0), (203, 1, 1), (204, 0, 1), (300, 1, 1), (None, 1, 1), (9999, 1, 1), (7, None, None)]


def test_all_orders_equal_a_plain_version(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string").repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = audit.interactions(audit.judged(docs, labels), "ABCDE")
    assert got.columns == ["part", "filter_order", "step", *audit.COUNTS]
    assert counts(got) == plain(DOCS, LABELS)


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame(DOCS[:9], "doc_id long, text string, source string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert audit.interactions(audit.judged(docs.limit(0), labels), "ABCDE").count() == 0
    clashing = docs.selectExpr("*", "1 AS part", "2 AS digest", "3 AS good", "4 AS toxic", "5 AS fails", "6 AS n")
    assert counts(audit.interactions(audit.judged(clashing, labels.limit(0)), "ABCDE")) == plain(DOCS[:9], [])


def test_edges_and_paths_have_a_fixed_number_of_rows(spark):
    kinds = spark.createDataFrame([("p", 5, True, False, 3)], "part string, fails int, good boolean, toxic boolean, n long")
    assert audit.lattice_edges(kinds, "ABCDE").count() == 80
    assert audit.paths(spark, "ABCDE").count() == 600
    three = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in audit.interactions(kinds, "ABC").collect()}
    assert len(three) == 18 and three["ABC", 1] == (0, 3, 0, 9) and three["ABC", 3] == (0, 0, 3, 9) and three["BAC", 1] == (3, 0, 0, 0)


def test_texts_are_read_without_python(spark):
    from retail_lens.plans.facts import facts

    docs = spark.createDataFrame(DOCS[:9], "doc_id long, text string, source string")
    found = facts(audit.interactions(audit.judged(docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")), "ABCDE"))
    assert found.python == 0 and found.products == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_registered_query(spark, sf):
    from retail_lens.llm.queries import queries

    d = f"/root/testdata/{sf}"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert counts(queries()["op13_audit"](spark, d)) == plain(docs, labels)
