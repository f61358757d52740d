"""The data model: cells in long form, and wide typed tables.

A cell is (row, family, qualifier, ts, seq, type, value). row and qualifier may
be strings or binary; Spark orders both bytewise. value has any type. Cells of
one column are ordered by ts, newest first; of equal ts the larger seq is newer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ["row", "family", "qualifier", "ts", "seq", "type", "value"]
#: Kinds of cells: a value, and markers that hide one version, a column up to ts, a family up to ts, a family at ts.
PUT, DELETE_VERSION, DELETE_COLUMN, DELETE_FAMILY, DELETE_FAMILY_VERSION = 0, 1, 2, 3, 4


@dataclass(frozen=True)
class Family:
    """Settings of a column family that queries can see."""

    name: str
    max_versions: int = 1
    min_versions: int = 0
    ttl: int | None = None


def cell_order(descending: bool = False) -> list[Column]:
    """Sort keys of a scan; a reversed scan turns rows alone around."""
    row = F.col("row").desc() if descending else F.col("row")
    return [row, F.col("family"), F.col("qualifier"), F.col("ts").desc(), F.col("type").desc(), F.col("seq").desc()]


def to_cells(wide: DataFrame, row: str, family: str, columns: list[str], ts: Column | None = None, seq: Column | None = None) -> DataFrame:
    """Long form of a wide table; null columns have no cell. Values become strings, as they share one column."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("qualifier"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")
    out = wide.select(F.col(row).alias("row"), (ts if ts is not None else F.lit(0)).cast("long").alias("ts"), (seq if seq is not None else F.lit(0)).cast("long").alias("seq"), pairs)
    return out.filter("x.value IS NOT NULL").select("row", F.lit(family).alias("family"), "x.qualifier", "ts", "seq", F.lit(PUT).alias("type"), "x.value")


def to_wide(cells: DataFrame, types: dict[str, str]) -> DataFrame:
    """One row for each row key: the newest value of each named qualifier, cast to its type."""
    newest = [F.max_by("value", F.when(F.col("qualifier") == q, F.struct("ts", "seq"))).cast(t).alias(q) for q, t in types.items()]
    return cells.filter(F.col("qualifier").isin(*types)).groupBy("row").agg(*newest)


def nested(cells: DataFrame) -> DataFrame:
    """row and its cells as family -> qualifier -> versions, newest first."""
    versions = cells.groupBy("row", "family", "qualifier").agg(F.reverse(F.sort_array(F.collect_list(F.struct("ts", "value")))).alias("versions"))
    families = versions.groupBy("row", "family").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("qualifier", "versions")))).alias("columns"))
    return families.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("family", "columns"))).alias("families"))


def with_region(df: DataFrame, splits: list, column: str = "row") -> DataFrame:
    """df with region: how many of the sorted split keys are at or below the row key."""
    region = F.lit(0)
    for s in splits:
        region = region + (F.col(column) >= F.lit(s)).cast("int")
    return df.withColumn("region", region)
