"""Streams give what their batch twins give, whatever the order of arrival and wherever they are stopped."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from retail_lens.operators.visits import limits
from retail_lens.streaming import limits as streamed
from retail_lens.streaming.upserts import LastRows, run, unfinished

REFUSALS = "net bigint, event_id bigint, ts timestamp, host bigint, status int"


@pytest.fixture
def rocks(spark):
    spark.conf.set(*streamed.STORE)
    yield spark
    spark.conf.unset(streamed.STORE[0])


def test_network_limits_equal_the_batch_in_any_order_and_after_a_restart(rocks, tmp_path):
    spark, rng, t0 = rocks, random.Random(2), dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s, microseconds=rng.choice([0, 1, 999_999]))
    rows = [(i % 3, i, at(rng.randint(0, 20_000)), rng.randint(0, 6), 429 if rng.random() < 0.05 else 403) for i in range(150)]
    rows += [(0, 500 + i, t0 + dt.timedelta(seconds=100), 40 + i, 403) for i in range(3)]  # of one moment
    batch = spark.createDataFrame(rows, REFUSALS)
    want = sorted(limits(batch).collect())
    order = sorted(rows, key=lambda r: (r[2] + dt.timedelta(seconds=rng.randint(0, 3000))))  # late by up to 50 minutes
    landing, out, checkpoint = (str(tmp_path / x) for x in ("landing", "out", "checkpoint"))

    def land(name, part):
        spark.createDataFrame(part, REFUSALS).coalesce(1).write.parquet(f"{landing}/{name}")

    def go():
        s = spark.readStream.schema(REFUSALS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(landing)
        q = streamed.network_limits(s).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()

    for k in range(2):
        land(k, order[k * 40 : k * 40 + 40])
    go()
    land("rest", order[80:])
    land("zend", [(99, 9999, t0 + dt.timedelta(days=30), 0, 403)])  # moves the watermark past all others
    go()
    assert sorted(spark.read.parquet(out).where("net < 99").collect()) == want


def test_last_rows_are_kept_once_wherever_a_batch_breaks_off(spark, tmp_path):
    schema = "user_id bigint, ts bigint, note string"
    rng = random.Random(3)
    parts = [[(rng.randint(0, 40), 1000 * k + i, f"{k}-{i}") for i in range(60)] for k in range(4)]
    parts[2] = [(7, 2500, "one key alone"), (None, 2501, "no key")]
    table = LastRows(str(tmp_path / "table"), "user_id", ("ts",), spark.createDataFrame([], schema).schema, buckets=8)
    for k, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.parquet(str(tmp_path / "landing" / str(k)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "landing"))
    written, breaks = [], {1: "before the manifest", 3: "after the manifest"}

    class Half(LastRows):
        def _clean(self, s, done):
            super()._clean(s, done)
            if breaks.get(done[-1]) == "after the manifest":
                del breaks[done[-1]]
                raise RuntimeError("killed")

    def write(batch, number):
        half = Half(table.path, table.key, table.order, table.schema, table.buckets)
        if breaks.get(number) == "before the manifest":
            del breaks[number]
            rows = batch.where("user_id is not null").withColumn("bucket", half._bucket())
            rows.write.partitionBy("bucket").parquet(f"{table.path}/data/{number}")  # a half of its work, and not what it would write
            raise RuntimeError("killed")
        written.append(number)
        half.write(batch, number)

    for _ in range(3):
        q = run(stream, table, str(tmp_path / "checkpoint"), write)
        try:
            q.processAllAvailable()
        except Exception:
            pass
        q.stop()
    assert not breaks and written == [0, 1, 2, 3, 3]
    last = {}
    for p in parts:
        for key, ts, note in p:
            if key is not None and ts >= last.get(key, (-1,))[0]:
                last[key] = (ts, note)
    rows = table.read(spark).collect()
    assert len(rows) == len(last) and {r.user_id: (r.ts, r.note) for r in rows} == last
    assert table.committed(spark) == [2, 3]
    assert sorted(r.user_id for r in unfinished(spark.range(50).withColumnRenamed("id", "user_id"), table).collect()) == [k for k in range(50) if k not in last]


def test_a_batch_rewrites_the_buckets_that_it_changes(spark, tmp_path):
    schema = spark.createDataFrame([], "user_id bigint, ts bigint").schema
    table = LastRows(str(tmp_path / "t"), "user_id", ("ts",), schema, buckets=16)
    assert table.read(spark).count() == 0
    table.write(spark.range(200).select(F.col("id").alias("user_id"), F.lit(1).cast("long").alias("ts")), 0)
    table.write(spark.range(1).select(F.lit(7).cast("long").alias("user_id"), F.lit(2).cast("long").alias("ts")), 1)
    now = table._manifest(spark, 1)
    assert len(now) == 16 and list(now.values()).count(1) == 1
    table.write(spark.createDataFrame([], schema), 2)  # an empty batch
    table.write(spark.createDataFrame([(9, 0)], schema), 2)  # and one that is run again
    assert table.read(spark).count() == 200 and table.read(spark).where("ts = 2").first().user_id == 7
