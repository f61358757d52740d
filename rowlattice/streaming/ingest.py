"""Streams of cells: counters, resolved state, windows and hooks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rowlattice.operators.resolve import resolve


def follow(spark: SparkSession, path: str, schema: str | Any, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as they come: the tail of an append-only log."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def append_to(stream: DataFrame, table: str, checkpoint: str, before: Callable | None = None, after: Callable | None = None):
    """Appends each micro-batch to a table of cells; before(df) may change it, after(df, batch) sees what was written. A batch has a folder of its own, so a repeated one replaces itself."""

    def write(df: DataFrame, batch: int) -> None:
        df = before(df) if before else df
        df.write.mode("overwrite").parquet(f"{table}/batch={batch}")
        if after:
            after(df.sparkSession.read.parquet(f"{table}/batch={batch}"), batch)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def state(spark: SparkSession, table: str, **options) -> DataFrame:
    """What a read of the table sees now; late cells take their place by ts, whenever they came."""
    return resolve(spark.read.parquet(table).drop("batch"), **options)


def counters(stream: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Running sums, as increments of counters: partial sums before the state store."""
    return stream.groupBy(*keys).agg(F.sum(value).alias("value"), F.count("*").alias("n"))


def stateful_counters(stream: DataFrame, key: str, value: str) -> DataFrame:
    """The same with state of its own for each key, as a base for read-modify-write rules that aggregates can't express."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], s: GroupState) -> Iterator[pd.DataFrame]:
        total, n = s.get if s.exists else (0, 0)
        for f in frames:
            total, n = total + int(f[value].fillna(0).sum()), n + len(f)
        s.update((total, n))
        yield pd.DataFrame({"key": [k[0]], "value": [total], "n": [n]})

    return stream.groupBy(key).applyInPandasWithState(step, "key string, value long, n long", "value long, n long", "update", GroupStateTimeout.NoTimeout)


def windows(events: DataFrame, ts: str, length: str, slide: str | None = None, keys: tuple[str, ...] = (), late: str | None = None) -> DataFrame:
    """Counts in tumbling or sliding windows; `late` is the watermark of a stream."""
    df = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if late else events
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return df.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def sessions(events: DataFrame, ts: str, gap: str, keys: tuple[str, ...], late: str | None = None) -> DataFrame:
    df = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if late else events
    return df.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")
