"""Which cells a read sees: expiry, delete markers, time range, columns, filter, versions, in this order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlattice.model import DELETE_COLUMN, DELETE_FAMILY, DELETE_FAMILY_VERSION, DELETE_VERSION, PUT, Family


def visible_puts(cells: DataFrame, read_point: int | None = None) -> DataFrame:
    """Puts that no marker hides. A marker hides puts up to (or at) its ts whatever their order of arrival.

    All windows are finer than (row, family), so one exchange by these serves
    them; a table without markers passes the same plan.
    """
    seen = cells if read_point is None else cells.filter(F.col("seq") <= read_point)
    family, column = Window.partitionBy("row", "family"), Window.partitionBy("row", "family", "qualifier")
    at = lambda kind: F.when(F.col("type") == kind, F.col("ts"))
    marked = seen.withColumns(
        {
            "__df": F.max(at(DELETE_FAMILY)).over(family),
            "__dc": F.max(at(DELETE_COLUMN)).over(column),
            "__dfv": F.max((F.col("type") == DELETE_FAMILY_VERSION).cast("int")).over(Window.partitionBy("row", "family", "ts")),
            "__dv": F.max((F.col("type") == DELETE_VERSION).cast("int")).over(Window.partitionBy("row", "family", "qualifier", "ts")),
        }
    )
    alive = (F.col("type") == PUT) & ~F.coalesce(F.col("ts") <= F.col("__df"), F.lit(False)) & ~F.coalesce(F.col("ts") <= F.col("__dc"), F.lit(False)) & (F.coalesce("__dfv", F.lit(0)) == 0) & (F.coalesce("__dv", F.lit(0)) == 0)
    return marked.filter(alive).drop("__df", "__dc", "__dfv", "__dv")


def newest_of_each_ts(cells: DataFrame) -> DataFrame:
    """Of cells with equal column and ts the one with the largest seq."""
    w = Window.partitionBy("row", "family", "qualifier", "ts").orderBy(F.col("seq").desc())
    return cells.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def ranked(cells: DataFrame) -> DataFrame:
    """cells with version: 1 for the newest ts of its column. Equal ts count once, the largest seq wins."""
    w = Window.partitionBy("row", "family", "qualifier").orderBy(F.col("ts").desc(), F.col("seq").desc())
    again = F.lag("ts").over(w) == F.col("ts")
    return cells.withColumn("__again", F.coalesce(again, F.lit(False))).filter("NOT __again").withColumn("version", F.row_number().over(w)).drop("__again")


def _by_family(families: dict[str, Family], value, default: int) -> Column:
    out = F.lit(default)
    for name, f in families.items():
        out = F.when(F.col("family") == name, F.lit(value(f))).otherwise(out)
    return out


def resolve(cells: DataFrame, max_versions: int = 1, families: dict[str, Family] | None = None, now: int | None = None, time_range: tuple[int, int] | None = None, columns: Column | None = None, cell_filter=None, read_point: int | None = None) -> DataFrame:
    """Cells that a read returns.

    Cells older than their family's ttl at `now` expire, but for the newest
    min_versions. time_range is half open. cell_filter has apply(cells), and
    sees cells before versions are counted. The number of versions is the
    scan's or the family's, whichever is less.
    """
    families = families or {}
    out = visible_puts(cells, read_point)
    if time_range:
        out = out.filter((F.col("ts") >= time_range[0]) & (F.col("ts") < time_range[1]))
    if columns is not None:
        out = out.filter(columns)
    if cell_filter is not None:
        out = cell_filter.apply(out)
    out = ranked(out)
    most = F.least(F.lit(max_versions), _by_family(families, lambda f: f.max_versions, max_versions))
    keep = F.col("version") <= most
    if now is not None and any(f.ttl is not None for f in families.values()):
        born = _by_family(families, lambda f: now - f.ttl if f.ttl is not None else -(2**62), -(2**62))
        keep = keep & ((F.col("ts") >= born) | (F.col("version") <= _by_family(families, lambda f: f.min_versions, 0)))
    return out.filter(keep).drop("version")


def compacted(cells: DataFrame, families: dict[str, Family], now: int | None = None) -> DataFrame:
    """What a full rewrite of a table keeps: no markers, no hidden, expired or surplus cells."""
    most = max([f.max_versions for f in families.values()], default=1)
    return resolve(cells, most, families, now)


def unexpired(cells: DataFrame, now: int) -> DataFrame:
    """Cells whose own time to live (column ttl, null for none) isn't over."""
    return cells.filter(F.col("ttl").isNull() | (F.col("ts") + F.col("ttl") > F.lit(now)))
