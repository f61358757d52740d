"""Reads of a cell table: get, scan, and their options."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlattice.model import Family, cell_order
from rowlattice.operators.resolve import resolve


@dataclass(frozen=True)
class Scan:
    """start is included, stop isn't, unless said otherwise. A reversed scan goes down from start to stop."""

    start: Any = None
    stop: Any = None
    include_start: bool = True
    include_stop: bool = False
    prefix: Any = None
    reversed: bool = False
    families: tuple = ()
    columns: tuple = ()  # (family, qualifier)
    time_range: tuple | None = None
    max_versions: int = 1
    filter: Any = None
    raw: bool = False
    limit: int | None = None
    batch: int | None = None
    family_limit: int | None = None
    family_offset: int = 0
    read_point: int | None = None
    now: int | None = None

    def rows(self) -> Column:
        out = F.lit(True)
        low, high = (self.stop, self.start) if self.reversed else (self.start, self.stop)
        low_in, high_in = (self.include_stop, self.include_start) if self.reversed else (self.include_start, self.include_stop)
        if low is not None:
            out = out & (F.col("row") >= F.lit(low) if low_in else F.col("row") > F.lit(low))
        if high is not None:
            out = out & (F.col("row") <= F.lit(high) if high_in else F.col("row") < F.lit(high))
        if self.prefix is not None:
            out = out & F.startswith(F.col("row"), F.lit(self.prefix))
        return out

    def selected(self) -> Column | None:
        if not self.families and not self.columns:
            return None
        out = F.col("family").isin(list(self.families)) if self.families else F.lit(False)
        for family, qualifier in self.columns:
            out = out | ((F.col("family") == family) & (F.col("qualifier") == qualifier))
        return out


@dataclass
class CellTable:
    """Cells and what is known of their families."""

    cells: DataFrame
    families: dict[str, Family] = field(default_factory=dict)

    def scan(self, s: Scan = Scan()) -> DataFrame:
        """Cells of the scan. Row predicates stand next to the source, so they reach Parquet; sort with cell_order() where order matters."""
        cells = self.cells.filter(s.rows())
        if s.raw:
            if s.columns:
                raise ValueError("a raw scan takes no columns")
            out = cells.filter(s.selected()) if s.families else cells
            out = out.filter((F.col("ts") >= s.time_range[0]) & (F.col("ts") < s.time_range[1])) if s.time_range else out
        else:
            out = resolve(cells, s.max_versions, self.families, s.now, s.time_range, s.selected(), s.filter, s.read_point)
        if s.family_limit is not None or s.family_offset:
            w = Window.partitionBy("row", "family").orderBy("qualifier", F.col("ts").desc())
            at = F.row_number().over(w)
            out = out.withColumn("__at", at).filter((F.col("__at") > s.family_offset) & (F.lit(True) if s.family_limit is None else F.col("__at") <= s.family_offset + s.family_limit)).drop("__at")
        if s.batch:
            w = Window.partitionBy("row").orderBy("family", "qualifier", F.col("ts").desc())
            out = out.withColumn("batch", F.floor((F.row_number().over(w) - 1) / s.batch))
        if s.limit is not None:
            rows = out.select("row").distinct().orderBy(F.col("row").desc() if s.reversed else F.col("row")).limit(s.limit)
            out = out.join(F.broadcast(rows) if s.limit <= 100_000 else rows, "row", "left_semi").select(*out.columns)
        return out

    def ordered(self, s: Scan = Scan()) -> DataFrame:
        return self.scan(s).orderBy(*cell_order(s.reversed))

    def get(self, row: Any, **options) -> DataFrame:
        return self.scan(Scan(start=row, stop=row, include_stop=True, **options))

    def get_all(self, keys: DataFrame, s: Scan = Scan()) -> DataFrame:
        """keys has pos and row. One row for each key, in place, with whether it exists and its cells."""
        cells = self.scan(s).join(keys.select(F.col("row").alias("__k")).distinct(), F.col("row") == F.col("__k"), "left_semi")
        found = cells.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("family", "qualifier", "ts", "value"))).alias("cells"))
        return keys.join(found, "row", "left").select("pos", "row", F.col("cells").isNotNull().alias("exists"), F.coalesce(F.size("cells"), F.lit(0)).alias("n_cells"), "cells")

    def closest_at_or_before(self, key: Any, family: str | None = None) -> DataFrame:
        """The cells of the last row at or before key."""
        s = Scan(stop=key, include_stop=True, families=(family,) if family else ())
        cells = self.scan(s)
        last = cells.agg(F.max("row").alias("__last"))
        return cells.join(F.broadcast(last), F.col("row") == F.col("__last"), "left_semi")

    def with_options(self, s: Scan, **changes) -> Scan:
        return replace(s, **changes)
