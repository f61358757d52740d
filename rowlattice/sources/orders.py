"""The orders workload: typed columns t, d, p and a salted row key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlattice.functions.codecs import date_int, price_cents, priority, salt

INDEXED = ["t", "d", "p"]
#: Bits of a coordinate of the z-order key: cents up to 5 * 10**7 >> 6, days, priority.
BITS = 21


def orders(spark: SparkSession, sf_dir: str, regions: int = 1) -> DataFrame:
    """row, ck, st, t (cents), d (yyyymmdd), p (1..5), region."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("row"), F.col("o_custkey").alias("ck"), F.col("o_orderstatus").alias("st"), price_cents(F.col("o_totalprice")).alias("t"), date_int(F.col("o_orderdate")).alias("d"), priority(F.col("o_orderpriority")).alias("p"), salt(F.col("o_orderkey"), regions).alias("region"))


def orders_text(spark: SparkSession, path: str) -> DataFrame:
    """The same of a file with nine fields between bars."""
    names = ["okey", "ck", "st", "price", "date", "prio", "cl", "sh", "cm"]
    raw = spark.read.csv(path, sep="|", schema=", ".join(f"{n} string" for n in [*names, "rest"]))
    return raw.select(F.col("okey").cast("long").alias("row"), F.col("ck").cast("long"), "st", price_cents(F.col("price").cast("decimal(18,2)")).alias("t"), F.regexp_replace("date", "-", "").cast("int").alias("d"), priority(F.col("prio")).alias("p"), "cl", F.col("sh").cast("int"), "cm")


def scaled(df: DataFrame) -> DataFrame:
    """df with zt, zd, zp: coordinates of at most 21 bits that keep the order of t, d and p."""
    days = F.datediff(F.to_date(F.col("d").cast("string"), "yyyyMMdd"), F.lit("1990-01-01").cast("date"))
    return df.withColumns({"zt": F.shiftright("t", 6), "zd": days, "zp": F.col("p")})
