"""Where queries and their SQL are registered, and the views that both engines read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_TABLES = {V.FIX: "events", V.REPORT: "events", V.CONTRIBUTION: "events", V.WEATHER: "events", V.EDGE: "events", V.PLACE: "part", V.GRID: "part", V.PERSON: "customer", V.CLAIM: "lineitem", V.AREA: "nation"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    name = _TABLES[sql]
    text = sql.format(ms="unix_millis(cast(ts as timestamp))").replace(f"FROM {name}", "FROM {source}")
    return spark.sql(text, source=table(spark, sf, name))


def with_views(**named: str) -> str:
    return "WITH " + ", ".join(f"{k} AS ({v.format(ms='epoch_us(ts) // 1000')})" for k, v in named.items()) + " "


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL for DuckDB if it has one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
