"""Key and value generators as Column expressions of a row number: each follows from a hash, so tasks can be repeated."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def unit(i: Column, seed: int = 0) -> Column:
    """A number in [0, 1) of a row number, from 31 bits of a multiplicative hash that SQL can repeat."""
    x = (i.cast("long") + seed * 7919 + 1) % 2147483647
    for a in (48271, 69621, 40692):
        x = (x * a + 12345) % 2147483647
    return x / F.lit(2147483647.0)


def unit_sql(i: str, seed: int = 0) -> str:
    x = f"(({i} + {seed * 7919 + 1}) % 2147483647)"
    for a in (48271, 69621, 40692):
        x = f"(({x} * {a} + 12345) % 2147483647)"
    return f"({x} / 2147483647.0::DOUBLE)"


def uniform(i: Column, n: int, seed: int = 0) -> Column:
    return F.floor(unit(i, seed) * n).cast("long")


def zipfian(i: Column, n: int, theta: float = 0.99, seed: int = 0) -> Column:
    """Ranks 0 .. n - 1 by the inverse of the continuous approximation of the law; 0 is the most frequent."""
    u = unit(i, seed)
    if abs(theta - 1) < 1e-9:
        x = F.exp(u * math.log(n + 1)) - 1
    else:
        x = F.pow(u * ((n + 1) ** (1 - theta) - 1) + 1, F.lit(1 / (1 - theta))) - 1
    return F.least(F.floor(x), F.lit(n - 1)).cast("long")


def zipfian_sql(i: str, n: int, theta: float = 0.99, seed: int = 0) -> str:
    return f"CAST(least(floor(pow({unit_sql(i, seed)} * {(n + 1) ** (1 - theta) - 1!r} + 1, {1 / (1 - theta)!r}) - 1), {n - 1}) AS BIGINT)"


def scrambled_zipfian(i: Column, n: int, theta: float = 0.99, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(zipfian(i, n, theta, seed)), F.lit(n))


def latest(i: Column, n: int, theta: float = 0.99, seed: int = 0) -> Column:
    """The most recent keys are the most frequent."""
    return F.lit(n - 1) - zipfian(i, n, theta, seed)


def hotspot(i: Column, n: int, hot_share: float = 0.2, hot_chance: float = 0.8, seed: int = 0) -> Column:
    hot = max(1, int(n * hot_share))
    return F.when(unit(i, seed) < hot_chance, uniform(i, hot, seed + 1)).otherwise(F.lit(hot) + uniform(i, max(1, n - hot), seed + 2))


def exponential(i: Column, mean: float, seed: int = 0) -> Column:
    return F.floor(-F.log(1 - unit(i, seed)) * mean).cast("long")


def discrete(i: Column, shares: dict[str, float], seed: int = 0) -> Column:
    """A name by its share; shares need not sum to one."""
    total, at = sum(shares.values()), 0.0
    u = unit(i, seed)
    out = F.lit(list(shares)[-1])
    for name, share in reversed(list(shares.items())[:-1]):
        at = sum(v for k, v in shares.items() if list(shares).index(k) <= list(shares).index(name)) / total
        out = F.when(u < at, name).otherwise(out)
    return out


def histogram_value(i: Column, counts: list[int], width: int = 1, seed: int = 0) -> Column:
    return discrete(i, {str(k * width): float(c) for k, c in enumerate(counts)}, seed).cast("long")


def sequential(i: Column, start: int, end: int) -> Column:
    return F.lit(start) + i % (end - start + 1)


def unix_time(i: Column, start: int, step: int = 60) -> Column:
    return F.lit(start) + i * step


def text(i: Column, n: int, seed: int = 0) -> Column:
    """n printable characters."""
    whole = F.concat(*[F.sha2(F.concat_ws("-", F.lit(f"{seed}-{k}"), i.cast("string")), 256) for k in range(-(-n // 64))])
    return F.substring(whole, 1, n)


def uniform_table(spark: SparkSession, rows: int, top: int = 10_000, payload: int = 16, regions: int = 10) -> DataFrame:
    """row, region, a, b, c below top, and payload integers named by number."""
    df = spark.range(rows).withColumnRenamed("id", "row")
    i = F.col("row")
    return df.withColumns({"region": (i % regions).cast("int")} | {c: uniform(i, top, k).cast("int") for k, c in enumerate("abc")} | {f"c{k}": uniform(i, 2**31 - 1, k).cast("int") for k in range(4, 4 + payload)})


def skewed_table(spark: SparkSession, rows: int, top: int = 10_000, payload: int = 17) -> DataFrame:
    """a by zipf, b uniform, and payload."""
    df = spark.range(rows).withColumnRenamed("id", "row")
    i = F.col("row")
    return df.withColumns({"a": zipfian(i, top, seed=1).cast("int"), "b": uniform(i, top, 2).cast("int")} | {f"c{k}": uniform(i, 2**31 - 1, k).cast("int") for k in range(3, 3 + payload)})


def operations(spark: SparkSession, n: int, shares: dict[str, float] | None = None, keys: int = 1000, law: str = "latest") -> DataFrame:
    """seq, kind, key, scan_file: a mix of operations (by default 10 % writes, 80 % reads, 10 % scans)."""
    shares = shares or {"write": 0.1, "read": 0.8, "scan": 0.1}
    df = spark.range(n).withColumnRenamed("id", "seq")
    i = F.col("seq")
    key = {"latest": latest, "zipfian": zipfian, "uniform": lambda c, k, seed=0: uniform(c, k, seed)}[law](i, keys, seed=5)
    df = df.withColumn("kind", discrete(i, shares, 3))
    return df.withColumns({"key": F.when(F.col("kind") == "write", F.lit(keys) + i).when(F.col("kind") == "read", key), "scan_file": F.when(F.col("kind") == "scan", uniform(i, 3, 7))})


def core_operations(spark: SparkSession, n: int, read: float = 0.95, update: float = 0.05, insert: float = 0.0, scan: float = 0.0, read_modify_write: float = 0.0, fields: int = 10, field_length: int = 100, keys: int = 1000) -> DataFrame:
    """seq, kind, key, fields (of writes), scan_length."""
    shares = {k: v for k, v in {"read": read, "update": update, "insert": insert, "scan": scan, "readmodifywrite": read_modify_write}.items() if v}
    df = spark.range(n).withColumnRenamed("id", "seq").withColumn("kind", discrete(F.col("seq"), shares, 11))
    i = F.col("seq")
    values = F.array(*[text(i, field_length, k) for k in range(fields)])
    return df.withColumns({"key": scrambled_zipfian(i, keys, seed=12), "fields": F.when(F.col("kind").isin("update", "insert", "readmodifywrite"), values), "scan_length": F.when(F.col("kind") == "scan", uniform(i, 100, 13) + 1)})
