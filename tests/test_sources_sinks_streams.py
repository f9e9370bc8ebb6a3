import sqlite3

import pytest
from pyspark.sql import functions as F

from retail_lens.operators.identity import resolve
from retail_lens.operators.visits import buckets
from retail_lens.sinks import writers
from retail_lens.sources import readers
from retail_lens.streaming import traffic

ROWS = [("é.com", '=1+1\t"x"\ny', 1.5, [1, 2]), ("b.com", None, None, None), ("c.com", "x" * 40000, 0.75, [])]
SCHEMA = "domain string, text string, n double, list array<int>"


def test_text_and_tables(spark, tmp_path):
    (tmp_path / "a.txt").write_text("see https://a.com/x, and www.b.com.\nnothing\nc.shop!\n")
    assert [r.url for r in readers.read_file(spark, str(tmp_path / "a.txt")).orderBy("input_id").collect()] == ["https://a.com/x", "www.b.com", "c.shop"]
    (tmp_path / "a.csv").write_text('﻿Name,Web Site,Phone\n"A, Inc",a.com,1\nB,,2\n', encoding="utf-8")
    df = readers.read_file(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["Name", "Web Site", "Phone"] and readers.url_column(df) == "Web Site"
    got = readers.read_accounts(spark, str(tmp_path / "a.csv")).collect()
    assert [(r["name"], r.website, r.phone, r.city) for r in got] == [("A, Inc", "a.com", "1", ""), ("B", "", "2", "")]
    with pytest.raises(ValueError, match="cannot read"):
        readers.read_file(spark, "x.doc")
    with pytest.raises(ValueError, match="no column"):
        readers.url_column(df.select("Phone"))


def test_tolerant_reader_and_clean_values(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"domain":"a","n":1.0}\n{broken\n')
    schema = spark.createDataFrame([], "domain string, n double").schema
    assert readers.read_table(spark, schema, str(tmp_path / "t.jsonl"), tolerant=True).count() == 1
    row = readers.clean_values(spark.sql("SELECT double('NaN') a, 1.5BD b, X'6162' c, DATE'2024-01-02' d")).first()
    assert tuple(row) == (None, 1.5, "ab", "2024-01-02")


def test_writers_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert writers.export({"t": df, "empty": df.limit(0)}, ["jsonl", "csv", "tsv", "parquet", "orc"], str(tmp_path)) == {}
    for fmt in ("parquet", "orc"):
        assert sorted(spark.read.format(fmt).load(f"{tmp_path}/t.{fmt}").collect(), key=str) == sorted(df.collect(), key=str)
        assert spark.read.format(fmt).load(f"{tmp_path}/empty.{fmt}").schema == df.schema
    back = spark.read.csv(f"{tmp_path}/t.csv", header=True, multiLine=True, escape='"').orderBy("domain").collect()
    assert [r.text for r in back][2] == ROWS[0][1] and [r.list for r in back][2] == "[1,2]"
    assert spark.read.schema(df.schema).json(f"{tmp_path}/t.jsonl").orderBy("domain").collect() == df.orderBy("domain").collect()
    with pytest.raises(ValueError, match="unknown"):
        writers.export({}, ["doc"], str(tmp_path))
    writers.write_sqlite(df, str(tmp_path / "r.db"), "t")
    with sqlite3.connect(tmp_path / "r.db") as db:
        assert db.execute("SELECT count(*), max(list) FROM t").fetchone() == (3, "[]")
    writers.write_duckdb(df, str(tmp_path / "r.duckdb"), "t")
    sheet = {r.domain: r.text for r in writers.sheet_text(df).collect()}
    assert sheet["é.com"].startswith("'=") and len(sheet["c.com"]) == writers.CELL_LIMIT
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, writers.upsert(old, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_identity_chain(spark):
    rows = [(i, [f"k{i}", f"k{i + 1}"]) for i in range(50)] + [(100, ["hot"]), (101, ["hot", None, ""]), (102, []), (103, None)]
    got = {r.seq: r.store for r in resolve(spark.createDataFrame(rows, "seq long, keys array<string>"), "seq", "keys").collect()}
    assert got == {i: 0 for i in range(50)} | {100: 100, 101: 100, 102: 102, 103: 103}


@pytest.fixture(scope="module")
def landing(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.mode("overwrite").parquet(path)
    return path


def test_stream_buckets_equal_the_batch(spark, landing):
    q = buckets(traffic.event_stream(spark, landing), "1 hour").writeStream.outputMode("complete").format("memory").queryName("hours").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("hours").collect()) == sorted(buckets(spark.read.parquet(landing), "1 hour").collect())


def test_stream_refusals_and_latest(spark, landing, tmp_path):
    q = traffic.refusals(traffic.event_stream(spark, landing, 100), seconds=36000).writeStream.outputMode("append").format("memory").queryName("refused").start()
    q.processAllAvailable()
    q.stop()
    events = spark.read.parquet(landing)
    assert spark.table("refused").count() == events.where("event_type = 'error'").count()
    q = traffic.event_stream(spark, landing, 1).writeStream.foreachBatch(traffic.latest_visits_sink(str(tmp_path / "last"))).start()
    q.processAllAvailable()
    q.stop()
    last = spark.read.parquet(str(tmp_path / "last" / "2"))
    assert last.count() == events.select("user_id").distinct().count()
    assert last.agg(F.sum("event_id")).first() == events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m")).agg(F.sum("m.event_id")).first()


def test_workbooks_round_trip(spark, tmp_path):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "=1+1", 0.5, True, ["a"]), (2, "ü <x> & \x07y", None, False, []), (3, None, 2.0, None, None)], "n long, t string, d double, b boolean, l array<string>").coalesce(1)
    writers.write_xlsx({"stores": df, "empty": df.limit(0)}, f"{tmp_path}/w.xlsx", sheet_rows=2)
    got = readers.read_file(spark, f"{tmp_path}/w.xlsx")
    assert got.columns == ["n", "t", "d", "b", "l"]
    assert [tuple(r) for r in got.collect()] == [("1", "'=1+1", "0.5", "1", '["a"]'), ("2", "ü <x> & y", None, "0", "[]")], "the third row is on the next sheet"
    writers.write_json(df, f"{tmp_path}/t.json")
    assert [r["n"] for r in spark.read.json(f"{tmp_path}/t.json", multiLine=True).orderBy("n").collect()] == [1, 2, 3]
    assert writers.write_manifest({"t": df}, f"{tmp_path}/m") == {"t": 3}
    assert readers.largest_run(spark, str(tmp_path), named="x") == "x"
    assert {r["b"]: r["n"] for r in writers.map_records(df.select(F.coalesce("b", F.lit(False)).alias("b"), "n"), "b").collect()} == {True: 1, False: 2}


def test_operator_files(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"stores":[{"Store Name":"Tango","URL":"https://www.tango.com/x","Phone":"+1 (239) 555-0101","Prov/State":"florida","Zip":"34102","Latitude":"26.14°","lon":-81.79},{"name":"Insta","website":"instagram.com/x","Prov/State":"?"}]}')
    got = [tuple(r) for r in readers.read_stockists(spark, f"{tmp_path}/s.json").collect()]
    assert got == [("Tango", "tango.com", "2395550101", "", "FL", "34102", "", 26.14, -81.79), ("Insta", "", "", "", "", "", "", None, None)]
    (tmp_path / "p.csv").write_text("Category,Wholesale USD,Retail\nSweater,$45.00,98\n,1,2\nHat,,x\n")
    assert [tuple(r) for r in readers.read_price_points(spark, f"{tmp_path}/p.csv").collect()] == [("sweater", 45.0, 98.0), ("hat", None, None)]
    (tmp_path / "locators").mkdir()
    for brand in ("ann", "lee"):
        (tmp_path / "locators" / f"{brand}.json").write_text('[{"name":"S","city":"C","latitude":1.5}]')
    assert sorted((r["brand"], r["name"], r["latitude"]) for r in readers.read_locators(spark, f"{tmp_path}/locators").collect()) == [("ann", "S", 1.5), ("lee", "S", 1.5)]
    df, where = readers.optional(spark, readers.read_price_points, "category string, wholesale double, retail double", f"{tmp_path}/none.csv", f"{tmp_path}/p.csv")
    assert where.endswith("p.csv") and df.count() == 2
    assert readers.optional(spark, readers.read_price_points, "category string", f"{tmp_path}/none.csv")[0].count() == 0
    cells = spark.createDataFrame([("see https://a.com/x, ok",), ("a.com",), ("no link here",)], "c string")
    assert [r[0] for r in cells.select(readers.link_in_cell(cells["c"])).collect()] == ["https://a.com/x", "a.com", "no link here"]
    (tmp_path / "t.txt").write_text(" ".join(f"https://a{i}.com" for i in range(1500)) + "\nhttps://b.com\n")
    ids = [r["input_id"] for r in readers.read_text(spark, f"{tmp_path}/t.txt").collect()]
    assert len(set(ids)) == 1501 and ids == sorted(ids)
    for run, size in (("2026-01-01", 5), ("2026-02-01", 50), ("2026-03-01", 5)):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "products.jsonl").write_text("x" * size)
    assert readers.largest_run(spark, f"{tmp_path}/runs") == "2026-02-01"
    inputs, summary = spark.createDataFrame([(2, "b"), (1, "a")], "input_id long, url string"), spark.createDataFrame([(1, "ok")], "input_id long, status string")
    writers.write_summary(inputs, summary, f"{tmp_path}/summary")
    assert [tuple(r) for r in spark.read.csv(f"{tmp_path}/summary", header=True).collect()] == [("1", "a", "ok"), ("2", "b", None)]


def test_links_of_many_splits_are_numbered_in_order(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.txt").write_text("\n".join(f"see https://a{k}-{i:03}.com and b{k}-{i:03}.org" if i % 3 else "nothing" for i in range(200)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        rows = readers.read_text(spark, str(tmp_path / "f*.txt")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [u for k in range(3) for i in range(200) if i % 3 for u in (f"https://a{k}-{i:03}.com", f"b{k}-{i:03}.org")]
    assert [r.url for r in sorted(rows, key=lambda r: r.input_id)] == want and sorted(r.input_id for r in rows) == list(range(len(want)))
