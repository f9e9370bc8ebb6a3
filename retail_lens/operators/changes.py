"""What changed between two snapshots, and what a search reaches round by round."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import table
from ..registry import query
from ..scratch import drop, saved


def differences(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, change): new, gone or changed rows of two snapshots; rows that are as they were are left out.

    Both sides are tagged and meet in one aggregate by key, whose counts combine before the shuffle: a snapshot of a hot key is a few numbers, and no join is needed.
    Values are compared by two 64-bit hashes of all of them, which tell null from any value; a key that comes more than once is compared as a bag of rows, in any order.
    """
    row = F.struct(*values)
    mark = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64(row).cast("decimal(38,0)")).alias("h"), F.bit_xor(F.xxhash64(F.lit(1), row)).alias("x"))
    side = lambda df, name: df.select(*keys, *values, F.lit(name).alias("_side"))
    both = side(before, 0).unionByName(side(after, 1)).groupBy(*keys, "_side").agg(mark.alias("m"))
    met = both.groupBy(*keys).agg(*(F.max(F.when(F.col("_side") == s, F.col("m"))).alias(name) for s, name in ((0, "was"), (1, "now"))))
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("was") != F.col("now"), "changed")
    return met.select(*keys, change.alias("change")).where("change is not null")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, list_sort(list(struct_pack(q := l_quantity, d := l_discount))) AS v FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY ALL),
a AS (SELECT l_orderkey, l_linenumber, list_sort(list(struct_pack(q := CASE WHEN l_tax > 0.06 THEN l_quantity + 1 ELSE l_quantity END, d := l_discount))) AS v FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY l_orderkey, l_linenumber)
SELECT coalesce(b.l_orderkey, a.l_orderkey) AS l_orderkey, coalesce(b.l_linenumber, a.l_linenumber) AS l_linenumber, CASE WHEN b.v IS NULL THEN 'new' WHEN a.v IS NULL THEN 'gone' ELSE 'changed' END AS change
FROM b FULL JOIN a ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE b.v IS DISTINCT FROM a.v""")
def line_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines that are new, gone or changed between what shipped before 1998 and, with higher quantities where the tax is high, what shipped from 1995 on."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_shipdate", "l_tax")  # noqa: E741
    before = l.where(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp"))
    after = l.where(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp")).withColumn("l_quantity", F.when(F.col("l_tax") > 0.06, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    return differences(before, after, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount"])


def reached(seeds: DataFrame, links: DataFrame, rounds: int, target: int | None = None) -> DataFrame:
    """(node, round): what ``seeds`` (node) reach over ``links`` (node, via), where nodes that share a via are next to each other, and in which round first.

    Semi-naive: only what the last round found goes on, first to the vias that no round has used, then to their nodes that are not known; so each via and node is expanded once. It ends
    when nothing is new, after ``rounds``, or once ``target`` nodes are known (the round that gets there is whole). Both sides of a hop are distinct before they join, and each round
    is written down. Null nodes and vias lead nowhere.
    """
    edges = saved(links.select("node", "via").where("node is not null and via is not null").distinct(), "links")
    known = [saved(seeds.select("node").where("node is not null").distinct().withColumn("round", F.lit(0)), "reached")]
    vias: list[DataFrame] = []
    union = lambda dfs: reduce(DataFrame.unionByName, dfs)
    total = known[0].count()
    for n in range(1, rounds + 1):
        if not total or target is not None and total >= target:
            break
        fresh = edges.join(known[-1].select("node"), "node").select("via").distinct()
        vias.append(saved(fresh.join(union(vias), "via", "left_anti") if vias else fresh, "vias"))
        new = edges.join(vias[-1], "via").select("node").distinct().join(union(known).select("node"), "node", "left_anti")
        known.append(saved(new.withColumn("round", F.lit(n)), "reached"))
        found = known[-1].count()
        total += found
        if not found:
            break
    drop(edges, *vias)
    return union(known)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS node, l_partkey AS via FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity >= 49),
r AS (SELECT node, 0 AS round FROM (SELECT c_custkey AS node FROM customer WHERE c_acctbal > 9990) UNION SELECT b.node, round + 1 FROM r JOIN e a ON a.node = r.node JOIN e b ON b.via = a.via WHERE round < 3)
SELECT node AS c_custkey, CAST(min(round) AS INTEGER) AS round FROM r GROUP BY node""")
def shared_parts_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that the richest ones reach in three rounds over parts that both bought by 49 or more."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("via"))
    links = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("node")).join(lines, "o_orderkey").select("node", "via")
    seeds = table(spark, sf_dir, "customer").where("c_acctbal > 9990").select(F.col("c_custkey").alias("node"))
    return reached(seeds, links, 3).select(F.col("node").alias("c_custkey"), "round")
