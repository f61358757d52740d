"""Writes as new cells. A table is append-only: its state is what resolve() makes of its cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlattice.model import CELL, DELETE_COLUMN, DELETE_FAMILY, DELETE_FAMILY_VERSION, DELETE_VERSION, PUT
from rowlattice.operators.resolve import resolve

KINDS = {"version": DELETE_VERSION, "column": DELETE_COLUMN, "family": DELETE_FAMILY, "family_version": DELETE_FAMILY_VERSION}


def put(rows: DataFrame, seq: int | Column) -> DataFrame:
    """rows: row, family, qualifier, ts, value."""
    return rows.withColumn("seq", seq if isinstance(seq, Column) else F.lit(seq).cast("long")).withColumn("type", F.lit(PUT)).select(*CELL)


def delete(rows: DataFrame, kind: str, seq: int | Column) -> DataFrame:
    """Markers for rows: row, family, qualifier (null for whole families), ts."""
    q = F.lit(None).cast("string") if kind.startswith("family") else F.col("qualifier")
    return rows.withColumn("qualifier", q).withColumn("seq", seq if isinstance(seq, Column) else F.lit(seq).cast("long")).withColumn("type", F.lit(KINDS[kind])).withColumn("value", F.lit(None)).select(*CELL)


def mutate_rows(changes: list[tuple[str, DataFrame]], seq: int, only_row: str | None = None) -> DataFrame:
    """Puts and deletes of any kinds as one set of cells with one sequence number, so that all take effect at once or, under check_and, none of a row.

    changes: ("put" or a kind of delete, rows). With only_row every change must
    be of that row; others raise an error when the cells are read.
    """
    out = None
    for kind, rows in changes:
        one = put(rows, seq) if kind == "put" else delete(rows, kind, seq)
        out = one if out is None else out.unionByName(one)  # a marker's value is null
    if only_row is None:
        return out
    other = F.raise_error(F.lit("rows of other keys in a change of one row"))
    return out.withColumn("row", F.when(F.col("row") == only_row, F.col("row")).otherwise(other.cast("string")))


def check_and(cells: DataFrame, condition: Column, family: str, qualifier: str, changes: DataFrame) -> DataFrame:
    """Those of the changes (cells) whose row's newest value in the column meets the condition; a missing value is null."""
    now = resolve(cells).filter((F.col("family") == family) & (F.col("qualifier") == qualifier)).select(F.col("row").alias("__r"), F.col("value").alias("value__now"))
    return changes.join(now, F.col("row") == F.col("__r"), "left").withColumn("current", F.col("value__now")).filter(F.coalesce(condition, F.lit(False))).select(*changes.columns)


def process_rows(cells: DataFrame, rows: DataFrame, make, seq: int) -> DataFrame:
    """Read-modify-write of whole rows: make(newest cells of the rows) gives changes ((kind, rows) pairs, as of mutate_rows), which come as one set of cells.

    rows has row. A change of a row that isn't listed is left out, so each row
    changes by what was read of it alone.
    """
    keys = rows.select(F.col("row").alias("__r")).distinct()
    mine = lambda df: df.join(keys, F.col("row") == F.col("__r"), "left_semi")
    return mutate_rows([(kind, mine(changed)) for kind, changed in make(resolve(mine(cells)))], seq)


def increments(cells: DataFrame) -> DataFrame:
    """row, family, qualifier, value: the sum of all added numbers; order doesn't matter."""
    return cells.groupBy("row", "family", "qualifier").agg(F.sum(F.col("value").cast("long")).alias("value"))


def appends(cells: DataFrame, sep: str = "") -> DataFrame:
    """row, family, qualifier, value: the texts one after another by seq."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("seq", F.col("value").cast("string").alias("v")))), lambda x: x["v"])
    return cells.groupBy("row", "family", "qualifier").agg(F.array_join(parts, sep).alias("value"))


def constrained(cells: DataFrame, check: Column, message: str) -> DataFrame:
    """cells, or an error at the first that fails the check."""
    return cells.withColumn("value", F.when(F.coalesce(check, F.lit(False)), F.col("value")).otherwise(F.raise_error(F.lit(message)).cast(cells.schema["value"].dataType)))


def bulk_delete(cells: DataFrame, condition: Column) -> DataFrame:
    """The table without the cells that meet the condition."""
    return cells.filter(~F.coalesce(condition, F.lit(False)))
