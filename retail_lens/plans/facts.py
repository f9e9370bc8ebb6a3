"""What a physical plan does, read from its formatted text: for tests that hold plans to what they should be."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Facts:
    columns: frozenset[str]  # that scans read
    pushed: frozenset[str]  # filters that reach scans
    exchanges: int
    products: int  # joins without keys
    python: int  # row-at-a-time Python functions


def facts(df: DataFrame) -> Facts:
    """Facts of the plan of ``df``, before it runs."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    tree = text.split("\n\n\n")[0]
    columns = {c.split(":")[0] for s in re.findall(r"ReadSchema: struct<(.*?)>\n", text) for c in re.split(r",(?![^<]*>)", s) if c}
    pushed = {f.strip() for s in re.findall(r"PushedFilters: \[(.*?)\]\n", text) for f in re.split(r", (?=[A-Z])", s) if f}
    count = lambda p: len(re.findall(p, tree))
    return Facts(frozenset(columns), frozenset(pushed), count(r"(?<!Broadcast)Exchange \("), count(r"CartesianProduct|NestedLoopJoin"), count(r"BatchEvalPython"))
