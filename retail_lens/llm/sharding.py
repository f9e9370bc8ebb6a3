"""Resharding by minimum-cost flow: a layout of files in shards gets new capacities with the fewest bytes moved.

A layout is a folder of generations ``g0``, ``g1``, ...: Parquet files in ``shard=<number>`` folders. A manifest lists the files that count, with
their shard and the number of rows in the shard before them; it is written last, so a run that breaks off leaves the old layout as it was.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Rows of a file that move together. Where a transfer ends inside a block, and only there, rows are placed one by one, by the driver.
BLOCK_ROWS = 4096
#: Shards that a layout may have: the flow is solved on the driver, over (old shards x new shards) numbers.
MAX_SHARDS = 1000
#: Shard of rows that have none yet. No new layout has it.
UNPLACED = -1
OWN = ("shard", "size")


@dataclass(frozen=True)
class Layout:
    root: str
    generations: int
    schema: T.StructType  # of the rows, with size; shard is in the folders' names

    @property
    def manifest(self) -> str:
        return f"{self.root}/manifest-{self.generations}"


def _files(rows: DataFrame) -> DataFrame:
    return rows.groupBy("shard", "file").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def _commit(files: DataFrame, layout: Layout) -> Layout:
    """Writes the manifest: files by shard, with the rows of the shard before each. There is a row a file, and a shard's files are one task's."""
    before = Window.partitionBy("shard").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files.select("shard", "file", "rows", "bytes", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")).write.parquet(layout.manifest)
    return layout


def _generation(spark: SparkSession, layout: Layout, g: int) -> DataFrame:
    """Rows of one generation with shard, file and row (place in the file)."""
    df = spark.read.schema(T.StructType([*layout.schema.fields, T.StructField("shard", T.IntegerType())])).parquet(f"{layout.root}/g{g}")
    at = df.metadataColumn("_metadata")
    return df.select(*layout.schema.names, "shard", at["file_path"].alias("_file"), at["row_index"].alias("_row"))


def _written(df: DataFrame, layout: Layout) -> None:
    """Adds a generation. Rebalancing gives files of even size, however many rows a shard has."""
    df.hint("rebalance", "shard").write.option("compression", "zstd").partitionBy("shard").parquet(f"{layout.root}/g{layout.generations - 1}")


def manifest(spark: SparkSession, layout: Layout) -> DataFrame:
    return spark.read.parquet(layout.manifest)


def write_layout(df: DataFrame, shard: Column, size: Column, root: str) -> Layout:
    """Writes ``df`` as a layout of one generation. A null shard is UNPLACED, a null or negative size 0; columns named shard or size are replaced."""
    kept = [F.col(c) for c in df.columns if c.lower() not in OWN]
    rows = df.select(*kept, F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long").alias("size"), F.coalesce(shard, F.lit(UNPLACED)).cast("int").alias("shard"))
    layout = Layout(root.rstrip("/"), 1, T.StructType([f for f in rows.schema.fields if f.name != "shard"]))
    _written(rows, layout)
    spark = df.sparkSession
    return _commit(_files(_generation(spark, layout, 0).select("shard", F.col("_file").alias("file"), "size")), layout)


def read_layout(spark: SparkSession, layout: Layout) -> DataFrame:
    """All rows with shard and slot (place in the shard, from 0 without gaps). Files that no longer count are left out by the join with the manifest."""
    rows = _generation(spark, layout, 0)
    for g in range(1, layout.generations):
        rows = rows.unionByName(_generation(spark, layout, g))
    live = manifest(spark, layout).select(F.col("file").alias("_file"), "start")
    return rows.join(live, "_file").withColumn("slot", F.col("start") + F.col("_row")).drop("start")


def min_cost_flow(supply: Sequence[int], room: Sequence[int], cost: np.ndarray) -> np.ndarray:
    """Units that go from each old to each new shard, at the least total cost; ``room`` holds all of ``supply`` together.

    Shortest augmenting paths over the residual network, by rounds of relaxation on whole rows and columns of the matrix.
    """
    left, free = np.array(supply, np.int64), np.array(room, np.int64)
    if left.sum() > free.sum():
        raise ValueError("there is not room for all")
    flow = np.zeros((len(left), len(free)), np.int64)
    cost = np.asarray(cost, float)
    while left.any():
        old, new = np.where(left > 0, 0.0, np.inf), np.full(len(free), np.inf)
        into, back = np.full(len(free), -1), np.full(len(left), -1)  # the step before, on the shortest path to each
        while True:
            c = old[:, None] + cost
            best = c.argmin(0)
            c = c[best, np.arange(len(free))]
            nearer = c < new - 1e-9
            new[nearer], into[nearer] = c[nearer], best[nearer]
            c = np.where(flow > 0, new[None, :] - cost, np.inf)
            best = c.argmin(1)
            c = c[np.arange(len(left)), best]
            less = c < old - 1e-9
            old[less], back[less] = c[less], best[less]
            if not less.any():
                break
        j = int(np.where(free > 0, new, np.inf).argmin())
        path, end = [], j
        while True:
            i = int(into[j])
            path.append((i, j, int(back[i])))
            if back[i] < 0:
                break
            j = int(back[i])
        units = min([left[i], free[end], *(flow[i, b] for i, _, b in path if b >= 0)])
        for i, j, b in path:
            flow[i, j] += units
            if b >= 0:
                flow[i, b] -= units
        left[path[-1][0]] -= units
        free[end] -= units
    return flow


def shares(total: int, weights: Sequence[float]) -> list[int]:
    """Whole capacities in proportion to ``weights`` that add up to ``total``."""
    ends = np.concatenate(([0.0], np.cumsum(weights)))
    cuts = [round(total * float(e) / float(ends[-1])) for e in ends]
    return [b - a for a, b in zip(cuts, cuts[1:], strict=False)]


def place_rows(sizes: np.ndarray, own: np.ndarray, room: np.ndarray) -> np.ndarray:
    """A shard for each row. Largest first: a row stays in its own shard if that has room for it, and else goes where there is most room."""
    room, to = room.copy(), np.empty(len(sizes), np.int64)
    for k in np.argsort(-sizes, kind="stable").tolist():
        i = own[k]
        if not (0 <= i < len(room) and room[i] >= sizes[k]):
            i = int(room.argmax())
        to[k] = i
        room[i] -= sizes[k]
    return to


def reshard(spark: SparkSession, layout: Layout, weights: Sequence[float], cost: np.ndarray | None = None) -> Layout:
    """The layout with len(weights) shards whose bytes are in proportion to ``weights``, moving the fewest bytes (or, by ``cost``, the cheapest).

    cost[i][j] is the price of a byte that goes from the i-th old shard (in order of number) to new shard j; it is 0 if they are the same and 1 if not, unless
    given. Shard sizes come from one aggregate; the flow between shards is solved on the driver; in each old shard the first bytes stay and the rest goes to new
    shards in turn, whole blocks at a time. A block in which a transfer ends is placed row by row: at most one for each transfer, so at most (old x new shards x
    BLOCK_ROWS) sizes come to the driver, whatever the table holds. Files from the first row that moves on are rewritten; all others stay as they are.

    Shards differ from their capacity by less than a row in general; a row larger than a capacity stays whole. Shards above the new count, and UNPLACED, are
    emptied. Rows of size 0 go with their block. A layout that fits, or an empty one, is returned as it is. Copies and rows of one key are rows like others:
    blocks are places in files, so no key, source or copy gathers rows.
    """
    n = len(weights)
    live = read_layout(spark, layout).select("shard", "_file", "_row", "size", F.floor(F.col("_row") / BLOCK_ROWS).alias("_block"))
    blocks = common.materialize(live.groupBy("shard", "_file", "_block").agg(F.sum("size").alias("bytes")), "blocks")
    old = {r["shard"]: r["b"] for r in blocks.groupBy("shard").agg(F.sum("bytes").alias("b")).sort("shard").limit(MAX_SHARDS + 1).collect()}
    if not 0 < n <= MAX_SHARDS or len(old) > MAX_SHARDS:
        raise ValueError(f"a layout has 1 to {MAX_SHARDS} shards")
    ids = list(old)
    room = shares(sum(old.values()), weights)
    flow = min_cost_flow(list(old.values()), room, cost if cost is not None else np.array([[float(i != j) for j in range(n)] for i in ids]).reshape(len(ids), n))
    losing = [k for k, i in enumerate(ids) if not 0 <= i < n or flow[k].sum() != flow[k, i]]
    if not losing:
        return layout

    # where in the running bytes of an old shard each transfer begins and ends; its own bytes come first
    spans = []
    for k in losing:
        to = sorted((j for j in range(n) if flow[k, j]), key=lambda j: (j != ids[k], j)) or [0]  # of an empty shard, rows of size 0 go to the first
        ends = np.cumsum([0, *flow[k, to]]).tolist()
        spans.append((ids[k], list(zip(ends, ends[1:], to, strict=False))))
    spans = spark.createDataFrame(spans, "shard int, spans array<struct<begin: long, end: long, to: int>>")
    running = Window.partitionBy("shard").orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, 0)
    summed = blocks.join(F.broadcast(spans), "shard").withColumn("end", F.sum("bytes").over(running))  # a row a losing shard
    fits = F.filter("spans", lambda s: (s["begin"] <= F.col("end") - F.col("bytes")) & (F.col("end") <= s["end"]))
    placed = common.materialize(summed.select("shard", "_file", "_block", "bytes", F.get(fits, F.lit(0))["to"].alias("to")), "placed")

    split = [(r["_file"], r["_block"]) for r in placed.where("to is null").select("_file", "_block").collect()]  # at most one for each transfer
    whole = {r["to"]: r["b"] for r in placed.where("to is not null").groupBy("to").agg(F.sum("bytes").alias("b")).collect()}
    stays = {i: old[i] for k, i in enumerate(ids) if k not in losing}
    free = np.array([room[j] - whole.get(j, 0) - stays.get(j, 0) for j in range(n)], np.int64)
    few = spark.createDataFrame(split, "_file string, _block long")
    rows = live.where(F.col("_file").isin(sorted({f for f, _ in split}))).join(F.broadcast(few), ["_file", "_block"]).select("shard", "_file", "_row", "size").toArrow().sort_by([("_file", "ascending"), ("_row", "ascending")])
    to = place_rows(rows.column("size").to_numpy(), rows.column("shard").to_numpy(), free)
    exact = F.broadcast(spark.createDataFrame(pa.table({"_file": rows.column("_file"), "_row": rows.column("_row"), "_exact": pa.array(to, pa.int32())})))

    # the same transfers as places in files, for every row: the first and last whole block of each
    place = F.struct(F.col("_file").alias("file"), F.col("_block").alias("block"))
    ends = placed.where("to is not null").groupBy("shard", "to").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    ends = F.broadcast(ends.groupBy("shard").agg(F.collect_list(F.struct("first", "last", "to")).alias("_spans")))  # at most a row a shard, of a span a new shard
    moves = placed.where("to is null or to <> shard").groupBy("shard").agg(F.min("_file").alias("_from")).collect()
    touched = F.lit(False)
    for r in moves:
        touched |= (F.col("shard") == r["shard"]) & (F.col("_file") >= r["_from"])
    inside = F.filter("_spans", lambda s: (s["first"] <= place) & (place <= s["last"]))
    affected = read_layout(spark, layout).where(touched).withColumn("_block", F.floor(F.col("_row") / BLOCK_ROWS))
    target = F.coalesce("_exact", F.get(inside, F.lit(0))["to"])
    after = Layout(layout.root, layout.generations + 1, layout.schema)
    _written(affected.join(ends, "shard", "left").join(exact, ["_file", "_row"], "left").select(*layout.schema.names, target.alias("shard")), after)
    kept = manifest(spark, layout).withColumnRenamed("file", "_file").where(~touched).select("shard", F.col("_file").alias("file"), "rows", "bytes")
    made = _files(_generation(spark, after, layout.generations).select("shard", F.col("_file").alias("file"), "size"))
    for x in (blocks, placed):
        common.drop(x)
    return _commit(kept.unionByName(made), after)


#: op12: documents come in shards by source, of which there are OLD; they go to NEW shards of equal bytes.
OLD, NEW = 12, 16


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, laid out in 12 shards by source (a null source is in none yet), resharded to 16 of equal bytes.

    Law ``bytes``: a document's size is its UTF-8 bytes and 1, and shards differ from their share by less than a document in general. A null text has the size 1 and
    the checksum of no bytes. A repeated or null doc_id, copies, and a source of any share are rows like others; an empty table gives no rows.
    """
    docs = common.table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    layout = write_layout(docs, F.pmod(F.crc32("source"), F.lit(OLD)), F.octet_length(text) + 1, common.scratch_dir(spark, "layout"))
    rows = read_layout(spark, reshard(spark, layout, [1.0] * NEW))
    return rows.select("doc_id", "size", F.crc32(text).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
