"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the context's. Only a local session may lack both; it then gets a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="rowlattice-checkpoint-"))


def new_place(spark: SparkSession) -> str:
    """A new path in the session's own folder there, which is deleted when the program ends."""
    key = spark.sparkContext.applicationId
    if key not in _folders:
        _folders[key] = f"{shared_folder(spark)}/rowlattice-{uuid.uuid4().hex}"
        atexit.register(clear, spark)
    return f"{_folders[key]}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and go on from the files.

    Lost executors then cost no recomputation from the start, columns are
    pruned, and plans stay small: a checkpointed plan would carry its
    constraints along, which grow with every join of a loop. The tables of a
    session go when it ends, or with clear().
    """
    place = new_place(df.sparkSession)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def clear(spark: SparkSession) -> None:
    """Delete the tables that cut() wrote; DataFrames built on them can't be read afterwards."""
    with contextlib.suppress(Exception):  # the session may have ended
        path = spark._jvm.org.apache.hadoop.fs.Path(_folders.pop(spark.sparkContext.applicationId))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_folders: dict[str, str] = {}
_local: dict[str, str] = {}


def attach_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, n_rows: int, spread: str) -> DataFrame:
    """Left join of rows with groups (one row for each key) that gives no task a hot key.

    A group of n_rows / 2048 rows or more (256 at least) is a large one; there
    are 2048 of these at most, so they are broadcast. Rows that found theirs
    no longer follow their key in the second join: they are dealt by `spread`.
    groups should come from cut(), as it is read twice.
    """
    least = max(256, n_rows // 2048)
    more = [c for c in groups.columns if c not in keys]
    named = groups.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"__v{i}") for i, c in enumerate(more)], F.col(size).alias("__size"))
    large = named.filter(F.col("__size") >= least).drop("__size")
    small = named.filter(F.col("__size") < least).drop("__size")
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    first = rows.join(F.broadcast(large.withColumn("__large", F.lit(True))), on, "left").drop(*[f"__k{i}" for i in range(len(keys))])
    first = first.withColumns({f"__w{i}": F.col(f"__v{i}") for i in range(len(more))}).drop(*[f"__v{i}" for i in range(len(more))])
    first = first.withColumn("__deal", F.when(F.col("__large"), F.xxhash64(F.lit("large"), F.col(spread))).otherwise(F.xxhash64(*keys)))
    small = small.withColumn("__deal2", F.xxhash64(*[F.col(f"__k{i}") for i in range(len(keys))]))
    both = first.join(small, [F.col("__deal") == F.col("__deal2"), F.col("__large").isNull(), *on], "left")
    out = [F.coalesce(F.col(f"__w{i}"), F.col(f"__v{i}")).alias(c) for i, c in enumerate(more)]
    return both.select(*[rows_c for rows_c in rows.columns], *out)


def local_rows(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A small table from the driver, made in the JVM from one JSON literal."""
    import json

    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")))


def small_side(df: DataFrame, n_rows: int, most: int = 100_000) -> DataFrame:
    """df to be broadcast if it is known to have `most` rows at most; else Spark joins it as it does any table."""
    return F.broadcast(df) if n_rows <= most else df


def without(docs: DataFrame, gone: DataFrame, keys: dict[str, Column], most: int = 1_000_000) -> DataFrame:
    """Rows of docs whose keys (named columns of gone: expressions over docs) aren't in gone.

    gone is broadcast up to `most` rows; beyond, both sides are shuffled.
    """
    gone = cut(gone.select(*[F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)]).distinct())
    side = F.broadcast(gone) if gone.count() <= most else gone
    return docs.join(side, [v.eqNullSafe(F.col(f"__g{i}")) for i, v in enumerate(keys.values())], "left_anti")


def one_row_each(docs: DataFrame, keys: list[str], kept: DataFrame) -> DataFrame:
    """docs without rows that repeat keys; kept has the keys of its rows, small, so that a look spares most tables the shuffle."""
    repeated = kept.groupBy(*kept.columns).agg(F.count("*").alias("n")).filter("n > 1")
    return docs if repeated.isEmpty() else docs.dropDuplicates(keys)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """At most so many rows in an Arrow batch, for texts are long: a batch is held by the JVM and by Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
