"""Fill-in-the-middle against a plain version, and exact round trips."""

import hashlib
import re

from retail_lens.llm import fim
from tests.llm import helpers

EXTRA = [
    (900, "ends with < and <S", "en", "s", 0, "h", "r", "sc"), (901, "has <S> in it", "en", "s", 0, "h", "r", "sc"), (902, "<P>", "en", "s", 0, "h", "r", "sc"), (903, "<M", "en", "s", 0, "h", "r", "sc"), (904, "P>x<", "en", "s", 0, "h", "r", "sc"),
    (905, "a\x00b\r\nc é 漢字 🎈́", "en", "s", 0, "h", "r", "sc"), (906, "wörter " * 3000, "en", "s", 0, "h", "r", "sc"), (None, "without a key", "en", "s", 0, "h", "r", "sc"), (None, "without a key", "en", "s", 0, "h", "r", "sc"), (0, "another text of doc_id 0", "en", "s", 0, "h", "r", "sc"), (-7, "below zero", "en", "s", 0, "h", "r", "sc"),
]


def plain(doc_id, text, rate=90, suffix_first=20):
    text = text or ""
    t = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(t), "plain", None, None, text, text
    i, j = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    p, m, s = ("".join(x) for x in (t[:i], t[i:j], t[j:]))
    spm = h[3] % 100 < suffix_first
    return len(t), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}", text


def test_rearranged_texts_equal_a_plain_version_and_give_the_text_back(spark):
    rows = helpers.documents() + EXTRA
    for rate, parts in ((90, 1), (100, 3)):
        made = fim.rearrange(helpers.frame(spark, rows).repartition(parts), rate=rate)
        got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made.withColumn("back", fim.restored(made["output"], made["form"])).collect()]
        want = [(r[0], *plain(r[0], r[1], rate)) for r in rows]
        assert sorted(got, key=repr) == sorted(want, key=repr)
        assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_columns_with_clashing_names_and_empty_tables(spark):
    df = spark.sql("SELECT 1L AS doc_id, 'some text here' AS text, 'x' AS N, 5 AS output, 'kept' AS i, 'kept' AS batch")
    out = fim.rearrange(df)
    assert out.columns == ["doc_id", "text", "i", "batch", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert out.first().i == "kept" and out.first().n == 5
    assert fim.rearrange(df.limit(0)).count() == 0


def test_statements_take_bounded_text(spark, monkeypatch):
    monkeypatch.setattr(fim, "STATEMENT", 50)
    rows = helpers.documents()[:20]
    import pyarrow as pa

    assert fim._pieces(pa.array(["a" * 30, "b" * 30, "c" * 90, "", "d"], pa.large_string()), 50) == [(0, 1), (1, 1), (2, 1), (3, 2)]
    got = {(r.doc_id, r.output) for r in fim.rearrange(helpers.frame(spark, rows).coalesce(1)).collect()}
    assert got == {(r[0], plain(r[0], r[1])[4]) for r in rows}


def test_registered_query(spark):
    from retail_lens.llm.queries import queries

    sf = "/root/testdata/sf0.001"
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n, form, p, m, out, back = plain(r.doc_id, r.text)
        want[r.doc_id] = (n, form, p, m, sha(out), sha(back))
    assert {r[0]: tuple(r[1:]) for r in queries()["op11_fim"](spark, sf).collect()} == want
