"""Named queries, each with the DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("brands", "stores", "customers", "visits", "links", "extraction", "similarity", "identity", "views", "names", "products", "judgement", "feeds", "markup", "runs", "nearest", "matching", "merge", "condense", "suffixes", "changes")
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, sf_dir) under its own name."""
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def fixture(name: str, given: str, rows: Sequence[tuple], expect: str, expected: Sequence[tuple], build: Callable[[DataFrame], DataFrame], doc: str) -> None:
    """Registers a query over literal rows, whose SQL is the rows that the rule, worked out by hand, makes of them.

    ``given`` and ``expect`` are DDL; ``build`` makes a frame with the columns of ``expect`` of one with those of ``given``.
    """
    outs = [f.split(" ") for f in expect.split(", ")]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(spark.createDataFrame(list(rows), given)).select(*(F.col(f).cast(kind).alias(f) for f, kind in outs))

    run.__name__, run.__doc__ = name, doc
    sql_type = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in expected)
    typed = ", ".join(f"CAST({f} AS {sql_type[kind]}) AS {f}" for f, kind in outs)
    query(f"SELECT {typed} FROM (VALUES {values}) AS v({', '.join(f for f, _ in outs)})")(run)


def cases(name: str, given: str, expect: str, rows: Sequence[tuple], build: Callable[[], dict[str, Column]], doc: str) -> None:
    """A fixture of column functions: ``build`` makes the columns of ``expect``, a row's last values, from those of ``given``, its first."""
    n, outs = len(given.split(", ")), [f.split(" ")[0] for f in expect.split(", ")]
    numbered = [(i, *r[:n]) for i, r in enumerate(rows)], [(i, *r[n:]) for i, r in enumerate(rows)]
    fixture(name, f"case_id bigint, {given}", numbered[0], f"case_id bigint, {expect}", numbered[1], lambda df: df.select("case_id", *(x.alias(k) for k, x in build().items() if k in outs)), doc)


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"retail_lens.operators.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["brand_rank"](spark, sf_dir)
