"""Files in and out: separated text with a column specification, dumps of cells, sorted bulk loads, snapshots, logs."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlattice.model import CELL, PUT

ROW_KEY, STAMP, TTL, VISIBILITY, ATTRIBUTES = "ROW_KEY", "TS_KEY", "CELL_TTL", "CELL_VISIBILITY", "ATTRIBUTES_KEY"


@dataclass(frozen=True)
class TextSpec:
    """Column names in order: ROW_KEY once, TS_KEY and the other special names at most once, else family:qualifier. Special names may have a capital prefix. One character separates."""

    columns: tuple[str, ...]
    sep: str = "\t"

    def __post_init__(self):
        names = "|".join((ROW_KEY, STAMP, TTL, VISIBILITY, ATTRIBUTES))
        special = [re.sub(rf"^[A-Z]+_(?=(?:{names})$)", "", c) for c in self.columns]
        object.__setattr__(self, "columns", tuple(special))
        if len(self.sep) != 1:
            raise ValueError("a separator is one character")
        if special.count(ROW_KEY) != 1:
            raise ValueError("one column is the row key")
        for name in (STAMP, TTL, VISIBILITY, ATTRIBUTES):
            if special.count(name) > 1:
                raise ValueError(f"{name} is there twice")
        if not self.cells:
            raise ValueError("no column besides the special ones")

    @property
    def cells(self) -> list[tuple[int, str, str]]:
        out = []
        for i, c in enumerate(self.columns):
            if c not in (ROW_KEY, STAMP, TTL, VISIBILITY, ATTRIBUTES):
                family, _, qualifier = c.partition(":")
                out.append((i, family, qualifier))
        return out


def read_text(spark: SparkSession, path: str, spec: TextSpec, ts: int = 0, skip_bad: bool = True) -> DataFrame:
    """Cells of a separated text. A line with another number of fields, an empty key, a bad timestamp or a bad time to live is left out, or an error.

    Special columns of the specification become columns of the cells: ttl (how
    long after ts a cell lives; none if empty), visibility (a label expression)
    and attributes (a map of name=>value pairs between commas).
    """
    parts = F.split(F.col("value"), f"\\Q{spec.sep}\\E", -1)
    lines = spark.read.text(path).select(parts.alias("p"))
    key = F.element_at("p", spec.columns.index(ROW_KEY) + 1)
    stamp = F.try_to_number(F.element_at("p", spec.columns.index(STAMP) + 1), F.lit("9999999999999999999")).cast("long") if STAMP in spec.columns else F.lit(ts).cast("long")
    good = (F.size("p") == len(spec.columns)) & (F.length(F.get("p", F.lit(spec.columns.index(ROW_KEY)))) > 0)
    if STAMP in spec.columns:
        good = good & F.get("p", F.lit(spec.columns.index(STAMP))).rlike(r"^\d{1,18}$")
    at = lambda name: F.get("p", F.lit(spec.columns.index(name)))
    more = []
    if TTL in spec.columns:
        good = good & at(TTL).rlike(r"^\d{0,18}$")
        more.append(F.when(F.length(at(TTL)) > 0, at(TTL)).cast("long").alias("ttl"))
    if VISIBILITY in spec.columns:
        more.append(F.nullif(at(VISIBILITY), F.lit("")).alias("visibility"))
    if ATTRIBUTES in spec.columns:
        more.append(F.str_to_map(at(ATTRIBUTES), F.lit(","), F.lit("=>")).alias("attributes"))
    good = F.coalesce(good, F.lit(False))
    lines = lines.filter(good) if skip_bad else lines.filter(F.when(good, True).otherwise(F.raise_error(F.lit("bad line")).cast("boolean")))
    cell = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(q).alias("qualifier"), F.element_at("p", i + 1).alias("value")) for i, f, q in spec.cells])).alias("x")
    names = [n for n, special in (("ttl", TTL), ("visibility", VISIBILITY), ("attributes", ATTRIBUTES)) if special in spec.columns]
    return lines.select(key.alias("row"), stamp.alias("ts"), *more, cell).select("row", "x.family", "x.qualifier", "ts", F.lit(0).cast("long").alias("seq"), F.lit(PUT).alias("type"), "x.value", *names)


def write_text(wide: DataFrame, path: str, columns: list[str], sep: str = "\t") -> None:
    wide.select(F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value")).write.mode("overwrite").text(path)


def export(cells: DataFrame, path: str, condition: Column | None = None) -> None:
    """Dump of cells (all versions and markers, or what a scan returns)."""
    (cells if condition is None else cells.filter(condition)).select(*CELL).write.mode("overwrite").parquet(path)


def restore(spark: SparkSession, path: str, rename: dict[str, str] | None = None, cell_filter=None) -> DataFrame:
    """Cells of a dump; families can be renamed and cells filtered."""
    out = spark.read.parquet(path)
    out = cell_filter.apply(out) if cell_filter else out
    for old, new in (rename or {}).items():
        out = out.withColumn("family", F.when(F.col("family") == old, new).otherwise(F.col("family")))
    return out


def bulk_load(cells: DataFrame, path: str, files: int) -> None:
    """Sorted files with disjoint row ranges."""
    keys = ["row", "family", "qualifier"]
    cells.select(*CELL).repartitionByRange(files, "row").sortWithinPartitions(*keys, F.col("ts").desc()).write.mode("overwrite").parquet(path)


def snapshot(spark: SparkSession, table: str, name: str) -> str:
    """An immutable copy of a table of files, beside it."""
    place = f"{table.rstrip('/')}.snapshot-{name}"
    spark.read.parquet(table).write.parquet(place)
    return place


def replay(log: DataFrame, start: int | None = None, end: int | None = None, tables: dict[str, str] | None = None) -> DataFrame:
    """Edits of a log (cells with table, written) of a time range, ends included; tables are renamed and others left out."""
    out = log
    if start is not None:
        out = out.filter(F.col("written") >= start)
    if end is not None:
        out = out.filter(F.col("written") <= end)
    if tables:
        names = F.create_map(*[F.lit(x) for kv in tables.items() for x in kv])
        out = out.filter(F.col("table").isin(*tables)).withColumn("table", names[F.col("table")])
    return out
