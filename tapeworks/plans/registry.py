"""Registered queries: a Spark callable over the given tables and, where SQL can say it, the same in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double for comparison; order is irrelevant."""
    return df.select(*[
        F.round(F.col(n), digits).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes
    ])


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = 6):
    """Register a query; `doubles` names the SQL columns to round the same way."""

    def add(fn):
        QUERIES[name] = lambda spark, sf: rounded(fn(spark, sf), digits)
        if sql is not None:
            reps = ", ".join(f"round(cast({x} as double), {digits}) + cast(0 as double) as {x}" for x in doubles.split())
            ORACLES[name] = f"select * replace ({reps}) from ({sql}) q" if reps else sql
        return fn

    return add
