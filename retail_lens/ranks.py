"""Exact order statistics of groups of any size: values are counted, counts are summed in spans of neighbouring values, and no group is ever one list or one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import TASK_ROWS, dealt
from .scratch import drop, saved


def ranked(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n, before, total): of each group each distinct value, how often it comes, how many smaller ones there are, and how many values in all.

    Counts combine before the shuffle. They are range-partitioned by group and value, which Spark balances by a sample, and written down with their partition:
    a span. Running sums are made in each span, and the spans of a group, of which there are as many as partitions at most, are summed before them. Null values count for nothing.
    Counts are written down first, so their number is known and a span has about TASK_ROWS of them, however many there are.
    """
    counts = saved(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n")), "counts")
    rows = counts.count()
    spans = saved(counts.repartitionByRange(-(-rows // TASK_ROWS) or 1, *keys, value).withColumn("span", F.spark_partition_id()), "spans")
    drop(counts)
    own = spans.groupBy(*keys, "span").agg(F.sum("n").alias("own"))
    group = Window.partitionBy(*keys)
    own = own.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("span").alias("_span"), F.sum("own").over(group).alias("total"), (F.sum("own").over(group.orderBy("span")) - F.col("own")).alias("start"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col("span") == F.col("_span"))
    inside = F.sum("n").over(Window.partitionBy(*keys, "span").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    summed = dealt(spans, rows, *keys, "span").withColumn("inside", inside)
    return summed.join(own, on).withColumn("before", F.col("start") + F.col("inside")).select(*keys, value, "n", "before", "total")


def at(value: str, place: Column) -> Column:
    """Aggregate over rows of ``ranked``: the value at a place in its group's order, from 1; ``place`` may use the columns of ``ranked``."""
    return F.max(F.when((F.col("before") < place) & (place <= F.col("before") + F.col("n")), F.col(value)))


def exclusive_quartile(value: str, i: int, digits: int) -> Column:
    """Aggregate: the i-th exclusive quartile, at place i (n + 1) / 4; of under four values the least, the median or the greatest."""
    n = F.col("total")
    j = F.least(F.greatest(F.floor(F.lit(i) * (n + 1) / 4), F.lit(1)), n - 1)
    d = F.max(F.lit(i) * (n + 1) - 4 * j)
    few = {1: at(value, F.lit(1)), 2: (at(value, F.floor((n - 1) / 2) + 1) + at(value, F.floor(n / 2) + 1)) / 2, 3: at(value, n)}[i]
    return F.when(F.max(n) < 4, few).otherwise(F.round((at(value, j) * (4 - d) + at(value, j + 1) * d) / 4, digits))


def quantile(value: str, p: float) -> Column:
    """Aggregate: the quantile at place p (n - 1) from 0, between the two values around it."""
    place = F.lit(p) * (F.col("total") - 1)
    low, high = F.floor(place), F.ceil(place)
    a, b, where = at(value, low + 1), at(value, high + 1), F.max(place)
    return F.when(F.max(high) == F.max(low), a).otherwise((F.max(high) - where) * a + (where - F.max(low)) * b)


def percentile_ranks(df: DataFrame, id_: str, values: list[str]) -> DataFrame:
    """(id, rank_<value>...): of each row the share of non-null values up to its own, equal ones at their mean rank; null for null. All columns are ranked in one pass."""
    long = df.unpivot(id_, values, "measure", "v").where("v is not null")
    r = ranked(long, ["measure"], "v").select("measure", "v", ((F.col("before") + (F.col("n") + 1) / 2) / F.col("total")).alias("rank"))
    return long.join(r, ["measure", "v"]).groupBy(id_).agg(*(F.max(F.when(F.col("measure") == c, F.col("rank"))).alias(f"rank_{c}") for c in values))
