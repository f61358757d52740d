"""Batch jobs over cell tables."""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlattice.model import CELL
from rowlattice.operators.aggregates import cell_counts, row_count
from rowlattice.operators.joins import difference
from rowlattice.operators.scan import CellTable, Scan
from rowlattice.sources.tables import export, replay, restore


def copy(cells: DataFrame, scan: Scan = Scan(raw=True), rename: dict[str, str] | None = None) -> DataFrame:
    out = CellTable(cells).scan(scan)
    for old, new in (rename or {}).items():
        out = out.withColumn("family", F.when(F.col("family") == old, new).otherwise(F.col("family")))
    return out.select(*CELL)


def hash_batches(df: DataFrame, batch: Column, columns: list[str]) -> DataFrame:
    """batch, n, digest: sums of both halves of the row hashes of each batch, which need neither order nor a gathered group."""
    text = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]))
    half = lambda at: F.conv(F.substring("__h", at, 16), 16, 10).cast("decimal(20,0)")
    total = lambda at: F.sum(half(at)).cast("decimal(38,0)").cast("string")
    return df.select(batch.alias("batch"), text.alias("__h")).groupBy("batch").agg(F.count("*").alias("n"), F.concat_ws(":", total(1), total(17)).alias("digest"))


def _paired(source: DataFrame, target: DataFrame, columns: list[str], batch: Column) -> DataFrame:
    """Batches of both sides by their hashes: batch, and whether they are the same."""
    s, t = hash_batches(source, batch, columns), hash_batches(target, batch, columns)
    t = t.select(F.col("batch").alias("b"), F.col("digest").alias("d"), F.col("n").alias("m"))
    same = F.col("digest").eqNullSafe(F.col("d")) & F.col("n").eqNullSafe(F.col("m"))
    return s.join(t, F.col("batch") == F.col("b"), "full_outer").select(F.coalesce("batch", "b").alias("__odd"), same.alias("same"), F.col("batch").isNotNull().alias("in_source"), F.col("b").isNotNull().alias("in_target"))


def sync(source: DataFrame, target: DataFrame, keys: list[str], value: str, batch: Column) -> DataFrame:
    """Counters of what differs; only batches whose hashes differ are compared row by row."""
    odd = _paired(source, target, [*keys, value], batch).filter("NOT same").select("__odd")
    only = lambda df: df.join(odd, batch == F.col("__odd"), "left_semi")
    return difference(only(source), only(target), keys, value)


def sync_batches(source: DataFrame, target: DataFrame, keys: list[str], value: str, batch: Column) -> DataFrame:
    """One row: batches, how many have matching hashes, how many not, and how many are empty on a side."""
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    both = F.col("in_source") & F.col("in_target")
    return _paired(source, target, [*keys, value], batch).agg(F.count("*").alias("batches"), count(F.col("same")).alias("hashes_matched"), count(both & ~F.col("same")).alias("hashes_not_matched"), count(~F.col("in_source")).alias("source_empty"), count(~F.col("in_target")).alias("target_empty"))


def _batch() -> Column:
    return F.pmod(F.xxhash64("row"), F.lit(256))


def main(args: list[str] | None = None) -> None:
    """python -m rowlattice.plans.jobs JOB SOURCE [TARGET]: rowcount, cellcount, export, import, copy, hash, sync (of cells in batches of 256 row hashes), replay (a log into a table of cells)."""
    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("job", choices=["rowcount", "cellcount", "export", "import", "copy", "hash", "sync", "replay"])
    p.add_argument("source")
    p.add_argument("target", nargs="?")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    cells = spark.read.parquet(a.source)
    match a.job:
        case "rowcount":
            row_count(cells).show()
        case "cellcount":
            cell_counts(cells).show(1000, False)
        case "export" | "copy":
            export(cells, a.target)
        case "hash":
            hash_batches(cells, _batch(), CELL).write.parquet(a.target)
        case "sync":
            other = spark.read.parquet(a.target)
            keys = [c for c in CELL if c != "value"]
            sync_batches(cells, other, keys, "value", _batch()).show()
            sync(cells, other, keys, "value", _batch()).show()
        case "replay":
            replay(cells).select(*CELL).write.mode("append").parquet(a.target)
        case "import":
            restore(spark, a.source).write.mode("append").parquet(a.target)


if __name__ == "__main__":
    main()
