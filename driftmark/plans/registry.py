"""The list of queries, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def no_negative_zero(sql: str) -> str:
    """``sql`` with 0 added to every rounded column, as Spark rounds to plain zeros."""
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        end, depth = start + 6, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[start + 6 : end - 1]
        named = sql.startswith(" as ", end)
        out += [sql[at:start], "round(", no_negative_zero(inner), ")", " + 0" if named else ""]
        at = end
    return "".join([*out, sql[at:]])


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c) -> Column:
    return F.round(c, 6)
