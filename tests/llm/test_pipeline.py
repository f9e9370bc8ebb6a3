"""The pipeline's stages against plain versions, each on what the stage before it kept."""

import re

import pytest

import __spark_entry__
import corpus_pipeline
from retail_lens.llm import packing, pii
from tests.llm import helpers
from tests.llm.test_text_operators import pii_by_hand

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = helpers.documents()
    passage = " ".join(rows[0][1].split()[:12])
    rows += [(900, "Write to ann.lee@shop.example or +1 (239) 555-0101, card 4111 1111 1111 1111, from 10.1.2.3 please", "en", "s", 0, "", "", ""), (901, passage, "en", "s", 0, "", "", ""), (902, " ".join(reversed(rows[11][1].split())) + " " + passage, "en", "s", 0, "", "", "")]
    helpers.frame(spark, rows).select(*COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(7, passage), (8, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "packing"]
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(f"{sf_dir}/{name}")
        docs = spark.read.parquet(f"{sf_dir}/{name}")
        rows = docs.collect()
        kept.append(len(rows))
        if name != "packing":
            assert docs.columns == COLUMNS
        got = {r.doc_id: r for r in rows}
        if name == "language":
            assert set(got) == {r.doc_id for r in before if re.search(r"[^\W\d_]", r.text or "")}, "clean documents stay"
        elif name == "near_duplicates":
            assert set(got) == {i for i, (_, c) in helpers.classes([(r.doc_id, r.text) for r in before], 5, 80).items() if i == c}
        elif name == "decontamination":
            hits = helpers.benchmark_hits([(r.doc_id, r.text) for r in before], [(7, spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("item_id = 7").first().text)])
            assert set(got) == {i for i, (n, hit, _) in hits.items() if hit <= n / 2} and 901 not in got
            assert {i for i, r in got.items() if r.text != {b.doc_id: b.text for b in before}[i]} == {i for i in got if hits[i][1]}
            assert all(len(helpers.alnum(r.text)) == hits[i][0] - hits[i][1] for i, r in got.items())
        elif name == "personal_data":
            assert set(got) == {r.doc_id for r in before}
            assert all(not pii_by_hand(r.text) and r.n_chars == len(r.text) for r in rows)
            assert got[900].text.startswith("Write to [EMAIL] or [PHONE], card [CARD], from [IP] please")
        else:
            assert sum(r.length for r in rows) == sum(len(r.text.encode()) + 1 for r in before)
            assert all(r.at + r.length <= r.bin_length in packing.LENGTHS for r in rows)
    assert kept[0] > kept[1] > kept[2] - 1 and kept[2] == kept[3]


def test_run_gives_what_the_stages_give(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/packing").count()
    assert "pipeline" in __spark_entry__.queries() and "pipeline" not in __spark_entry__.oracle_sql()
    assert pii.KINDS == ("email", "ip", "card", "phone")


def test_every_operator_is_registered():
    names = [m[1] for n in __spark_entry__.queries() if (m := re.match(r"op([0-9]+)_", n))]
    assert sorted(map(int, names)) == list(range(1, 14))
