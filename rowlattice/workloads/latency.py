"""Latency statistics of a workload's operations."""

from __future__ import annotations


import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lower ends of the latency boxes in seconds, from slow to fast (fixed values).
PIVOTS = [10, 6.0, 5.5, 5.0, 4.5, 4.0, 3.5, 3, 2.5, 2, 1.8, 1.5, 1.3, 1.2, 1.1, 1, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.08, 0.05, 0.02, 0.01, 0.0]


def pivot_of(seconds):
    out = F.lit(float(PIVOTS[-1]))
    for p in reversed(PIVOTS[:-1]):
        out = F.when(seconds >= p, F.lit(float(p))).otherwise(out)
    return out


def cdf(latencies: DataFrame, seconds: str) -> DataFrame:
    """pivot, n, cumulative: of each box the operations in it, and those in it or a faster one. 30 rows."""
    counts = latencies.groupBy(pivot_of(F.col(seconds)).alias("pivot")).agg(F.count("*").alias("n"))
    every = F.explode(F.array(*[F.lit(float(p)) for p in PIVOTS])).alias("pivot")
    full = counts.sparkSession.range(1).select(every).join(counts, "pivot", "left").fillna(0, ["n"])
    return full.withColumn("cumulative", F.sum("n").over(Window.orderBy("pivot").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def summary(latencies: DataFrame, kind: str, seconds: str) -> DataFrame:
    return latencies.groupBy(kind).agg(F.count("*").alias("n"), F.avg(seconds).alias("mean"), F.max(seconds).alias("max"))


def timed(make: Callable[[], DataFrame]) -> dict[str, float]:
    """Seconds to the first row and to all rows, and their number."""
    t = time.perf_counter()
    df = make()
    df.limit(1).collect()
    first = time.perf_counter() - t
    t = time.perf_counter()
    n = make().count()
    return {"first_s": first, "total_s": time.perf_counter() - t, "rows": n}


def parse_report(lines: DataFrame) -> DataFrame:
    """kind, seconds of lines such as `read latency: 0.012`; other lines are left out."""
    pattern = r"(?i)^\s*(\w+) latency:\s*([0-9.]+)"
    return lines.filter(F.col("value").rlike(pattern)).select(F.lower(F.regexp_extract("value", pattern, 1)).alias("kind"), F.regexp_extract("value", pattern, 2).cast("double").alias("seconds"))


__all__ = ["PIVOTS", "cdf", "parse_report", "pivot_of", "summary", "timed"]
