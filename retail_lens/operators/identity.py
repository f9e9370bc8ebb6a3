"""Entity resolution: sightings that share an identity key, directly or through others, are one store."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import table
from ..registry import query


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def _saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder that all executors share, and read again."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:  # a session of this machine's own, as in tests
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own_dir()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def resolve(sightings: DataFrame, seq: str, keys: str) -> DataFrame:
    """(seq, store): store is the smallest seq that shared keys lead to.

    A key stands for the first sighting that has it, and a sighting ties the keys that it has to the first of these. Sightings are met but
    twice for that; the rounds run over the different ties alone, of which there are few where many sightings have the same keys. There each
    takes the least label of those it is tied to, and jumps to that label's label, so that long chains end in a logarithmic number of
    rounds. Minima combine before the shuffle, so a key that very many sightings have is no one task's.
    """
    links = _saved(sightings.select(F.col(seq).alias("seq"), F.explode(keys).alias("key")).where("key is not null and key <> ''").distinct(), "links")
    by_key = _saved(links.groupBy("key").agg(F.min("seq").alias("node")), "by-key")
    at = _saved(links.join(by_key, "key").select("seq", "node").distinct(), "nodes")
    hubs = _saved(at.groupBy("seq").agg(F.min("node").alias("hub")), "hubs")
    ties = at.join(hubs, "seq").where("node <> hub").select("hub", "node").distinct()
    ties = _saved(ties.select(F.explode(F.array(F.struct(F.col("hub").alias("a"), F.col("node").alias("b")), F.struct(F.col("node").alias("a"), F.col("hub").alias("b")))).alias("t")).select("t.a", "t.b").distinct(), "ties")
    labels = _saved(ties.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct(), "labels")
    while True:
        least = ties.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("least"))
        near = labels.join(least, "node").select("node", "label", F.least("label", "least").alias("least"))
        hop = labels.select(F.col("node").alias("least"), F.col("label").alias("jump"))
        new = _saved(near.join(hop, "least").select("node", "label", F.least("least", "jump").alias("new")), "labels")
        changed = not new.where("new < label").isEmpty()
        labels = new.select("node", F.col("new").alias("label"))
        if not changed:
            break
    of_hub = hubs.join(labels.select(F.col("node").alias("hub"), "label"), "hub", "left").select("seq", F.coalesce("label", "hub").alias("found"))
    every = sightings.select(F.col(seq).alias("seq")).distinct()
    return _saved(every.join(of_hub, "seq", "left").select("seq", F.coalesce("found", "seq").alias("store")), "labels")


_KEYS = "['site:' || CAST(c_custkey // 3 AS VARCHAR), CASE WHEN c_custkey % 7 = 0 THEN 'in:' || CAST(c_custkey % 49 AS VARCHAR) END, CASE WHEN c_custkey % 100 = 3 THEN 'place:' || CAST(c_nationkey AS VARCHAR) END]"


@query(f"""WITH RECURSIVE k AS (SELECT c_custkey AS seq, unnest({_KEYS}) AS key FROM customer), l AS (SELECT DISTINCT seq, key FROM k WHERE key IS NOT NULL), e AS (SELECT DISTINCT a.seq AS a, b.seq AS b FROM l a JOIN l b ON a.key = b.key), r AS (SELECT c_custkey AS seq, c_custkey AS other FROM customer UNION SELECT r.seq, e.b FROM r JOIN e ON e.a = r.other)
SELECT store, count(*) AS sightings FROM (SELECT seq, min(other) AS store FROM r GROUP BY seq) GROUP BY store""")
def identity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings of each store, by site, handle and place keys."""
    k = F.col("c_custkey")
    keys = F.array(F.concat(F.lit("site:"), F.floor(k / 3).cast("string")), F.when(k % 7 == 0, F.concat(F.lit("in:"), (k % 49).cast("string"))), F.when(k % 100 == 3, F.concat(F.lit("place:"), F.col("c_nationkey").cast("string"))))
    return resolve(table(spark, sf_dir, "customer").select("c_custkey", keys.alias("keys")), "c_custkey", "keys").groupBy("store").agg(F.count("*").alias("sightings"))


@query("WITH k AS (SELECT s_suppkey, s_suppkey % 40 AS site FROM supplier) SELECT site, min(s_suppkey) AS store, count(*) AS folded FROM k GROUP BY site")
def fold_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores of one website folded into the first."""
    return table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 40).alias("site")).agg(F.min("s_suppkey").alias("store"), F.count("*").alias("folded"))
