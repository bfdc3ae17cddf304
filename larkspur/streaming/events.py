"""Event-time streams (beyond the reference engine's batches) and stage-switching batch streams for training."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stream(spark: SparkSession, path: str, schema: str | T.StructType, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(df: DataFrame, at: str, size: str, late: str | None, keys: list[str], **aggs) -> DataFrame:
    df = df.withWatermark(at, late) if late and df.isStreaming else df
    out = df.groupBy(F.window(at, size), *keys).agg(*(a.alias(n) for n, a in aggs.items()))
    return out.select(F.col("window.start").alias("window_start"), *keys, *aggs)


def sliding(df: DataFrame, at: str, size: str, slide: str, late: str | None, keys: list[str], **aggs) -> DataFrame:
    df = df.withWatermark(at, late) if late and df.isStreaming else df
    out = df.groupBy(F.window(at, size, slide), *keys).agg(*(a.alias(n) for n, a in aggs.items()))
    return out.select(F.col("window.start").alias("window_start"), *keys, *aggs)


def sessions(df: DataFrame, at: str, gap: str, late: str | None, keys: list[str], **aggs) -> DataFrame:
    df = df.withWatermark(at, late) if late and df.isStreaming else df
    out = df.groupBy(F.session_window(at, gap), *keys).agg(*(a.alias(n) for n, a in aggs.items()))
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, *aggs)


def deduplicated(df: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    return df.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def running_counts(df: DataFrame, key: str, timeout_ms: int | None = None) -> DataFrame:
    """Custom keyed state: each key's number of events so far, forgotten after ``timeout_ms`` of quiet, if given.

    A stream with a timeout runs on without data, so it doesn't end by itself.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = df.schema[key].dataType.simpleString()

    def step(k, batches: Iterator, state: GroupState):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        n = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((n,))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({key: [k[0]], "n": [n]})

    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long", "n long", "update", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)


def batches(df: DataFrame, stages: dict[str, int], size: int) -> Iterator[tuple[str, list]]:
    """Rows in batches of ``size``; the stages take turns for so many batches each, over and over, until rows end.

    Rows come one partition at a time, so the driver holds one partition and one batch at most.
    """
    turn = [name for name, n in stages.items() for _ in range(n)]
    held, i = [], 0
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield turn[i % len(turn)], held
            held, i = [], i + 1
    if held:
        yield turn[i % len(turn)], held
