"""Traffic as streams: the batch expressions of time buckets, with watermarks, and a stateful refusal window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.visits import buckets

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
LIMITED = "net bigint, ts timestamp, hosts bigint, limited boolean"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """Event files as they land in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def bucket_stream(stream: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """Sessions, carts and checkouts of each bucket, closed once events are later than the watermark."""
    return buckets(stream.withWatermark("ts", late), width)


def session_stream(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions by a gap of silence. An extension: the retail rules know sessions only as events."""
    s = stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return s.select("user_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "events")


def refusals(stream: DataFrame, seconds: int = 600, hosts: int = 2) -> DataFrame:
    """For each refusal whether ``hosts`` hosts of its network refused within ``seconds``; a network's state is the refusals of that time."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, names = (list(x) for x in state.get) if state.exists else ([], [])
        for pdf in batches:
            out = []
            for r in pdf.sort_values("ts").itertuples():
                t = r.ts.timestamp()
                times.append(t)
                names.append(int(r.user_id))
                keep = [i for i, x in enumerate(times) if t - x <= seconds]
                times, names = [times[i] for i in keep], [names[i] for i in keep]
                n = len(set(names))
                out.append((key[0], r.ts, n, n >= hosts))
            yield pd.DataFrame(out, columns=["net", "ts", "hosts", "limited"])
        state.update((times, names))

    errors = stream.where("event_type = 'error'").select((F.col("user_id") % 10).alias("net"), "ts", "user_id")
    return errors.groupBy("net").applyInPandasWithState(step, LIMITED, "times array<double>, names array<bigint>", "append", GroupStateTimeout.NoTimeout)


def latest_visits_sink(path: str):
    """A ``foreachBatch`` function that keeps each store's last visit in versioned Parquet folders under ``path``."""
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("v")).select("user_id", "v.*")
        if epoch:
            last = spark.read.parquet(f"{path}/{epoch - 1}").unionByName(last).groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("v")).select("user_id", "v.*")
        last.write.mode("overwrite").parquet(f"{path}/{epoch}")

    return write
