"""Registered queries, each next to the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from duelframe.functions import r6
from duelframe.layout import c

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register the function under its name, with its oracle where SQL can express one."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def with_sql(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


def r6_sql(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5001) / 1e6"


def r4_sql(x: str, places: int = 4) -> str:
    return f"floor(({x}) * 1e{places} + 0.5) / 1e{places}"


def r4(x: Column, places: int = 4) -> Column:
    """Rounded to four places, for results of fits that stop at a tolerance."""
    return F.floor(x * 10.0**places + 0.5) / 10.0**places


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Round the named columns, or all doubles, to six places."""
    wanted = set(names) or {n for n, t in df.dtypes if t == "double"}
    return df.select([r6(c(n)).alias(n) if n in wanted else c(n) for n in df.columns])


def dated(df: DataFrame, name: str = "bout_date") -> DataFrame:
    return df.withColumn(name, F.col(name).cast("date"))
