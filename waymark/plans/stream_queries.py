"""Queries that run as streams until their input is used up, and return what the sink then holds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..operators import folds
from ..runtime import shared_folder
from ..streaming import stateful
from . import network_queries, place_queries, views as V  # noqa: F401  their SQL is used again
from .registry import ORACLES, query, table


def _stream(spark, sf, sql: str, name: str) -> DataFrame:
    # a pattern, since a stream takes a plain path for a folder and the table may be one file
    source = spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")
    text = sql.format(ms="unix_millis(cast(ts as timestamp))").replace(f"FROM {name}", "FROM {source}")
    return spark.sql(text, source=source)


def drained(stream: DataFrame) -> DataFrame:
    """Runs a stream over all that is there now, into a table in the shared folder."""
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def _fixes(spark, sf):
    return _stream(spark, sf, V.FIX, "events").select("device", "seq", "ms")


@query(ORACLES["session_numbers"])
def stream_sessions(spark, sf):
    return drained(stateful.fold_stream(_fixes(spark, sf), ["device"], ["seq"], folds.session_number(900_000), "session", "long").select("device", "seq", "session"))


@query(ORACLES["monotone_fold"])
def stream_monotone(spark, sf):
    return drained(stateful.fold_stream(_fixes(spark, sf), ["device"], ["seq"], folds.newer(), "kept", "boolean").select("device", "seq"))


@query(ORACLES["rate_limit_buckets"])
def stream_rate_limit(spark, sf):
    kept = stateful.fold_stream(_fixes(spark, sf), ["device"], ["seq"], folds.rate_limit(86_400_000, 2), "kept", "boolean")
    return drained(kept.selectExpr("device", "seq", "floor(ms / 86400000) as bucket"))
