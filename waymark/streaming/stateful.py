"""The steps of `waymark.operators.folds` over streams, and windows with watermarks.

Rows of a key are taken in order of `order` within each micro-batch, and a key's state is kept between
batches.  With an event-time column the state of a key goes when the watermark is `ttl_ms` past its last row,
so state doesn't grow with the number of keys ever seen; rows later than the watermark are dropped.  Without
one, states stay.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import Step, applied, with_verdict

TTL_MS = 45 * 60 * 1000


def fold_stream(stream: DataFrame, keys: list[str], order: list[str], step: Step, name: str, kind: str, time: str | None = None, late: str = "1 hour", ttl_ms: int = TTL_MS) -> DataFrame:
    """Like `fold`, over a stream; time names the column of event times."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable")  # one key's rows of one micro-batch
        now, verdicts = applied(step, pickle.loads(state.get[0]) if state.exists else None, rows)
        state.update((pickle.dumps(now),))
        if time:
            last = int(rows[time].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + ttl_ms)
        yield with_verdict(rows, verdicts, name)

    schema = ", ".join(f"`{c}` {t}" for c, t in [*stream.dtypes, (name, kind)])
    timeout = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout
    watched = stream.withWatermark(time, late) if time else stream
    return watched.groupBy(*keys).applyInPandasWithState(run, schema, "state binary", "append", timeout)


def session_windows(stream: DataFrame, key: str, time: str, gap: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Rows of each session of a key; emitted when the watermark has passed its end."""
    counted = stream.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def window_counts(stream: DataFrame, keys: list[str], time: str, length: str, late: str = "1 hour") -> DataFrame:
    counted = stream.withWatermark(time, late).groupBy(*keys, F.window(time, length).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(*keys, F.col("w.start").alias("start"), "n")


def distinct_stream(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def upsert(batch: DataFrame, path: str, key: str) -> None:
    """For foreachBatch: adds the rows whose key the table at `path` lacks; a batch that runs again adds nothing."""
    from ..operators.matching import unseen
    from ..sources.tables import exists

    spark = batch.sparkSession
    fresh = unseen(batch, spark.read.parquet(path), key) if exists(spark, path) else batch.dropDuplicates([key])
    fresh.write.mode("append").parquet(path)
