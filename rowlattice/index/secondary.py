"""Access paths: every one answers the same conjunction of column ranges.

An index is a deterministic selection of its base table, so it is never stale.
In a catalog it is a Parquet table sorted by its key, whose row-group
statistics let a range read skip what it doesn't need; without one it is the
same plan on the base. Local indexes are sorted by region first, so each region
is read on its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlattice.functions.zorder import box_ranges, in_ranges, zip_bits
from rowlattice.operators.joins import fetch, intersect_keys
from rowlattice.operators.predicates import OPS, ColumnRange, conjunction


@dataclass
class Indexed:
    """A base table with its row key, indexed columns, and where materialised copies are (name -> DataFrame)."""

    base: DataFrame
    row: str
    indexed: list[str]
    copies: dict[str, DataFrame] = field(default_factory=dict)
    bits: dict[str, int] = field(default_factory=dict)

    def secondary(self, column: str) -> DataFrame:
        """value, row: null values have no entry."""
        return self.copies.get(f"gs_{column}", None) if f"gs_{column}" in self.copies else self.base.filter(F.col(column).isNotNull()).select(F.col(column), F.col(self.row).alias("row"))

    def clustered(self, column: str) -> DataFrame:
        return self.copies.get(f"gc_{column}") if f"gc_{column}" in self.copies else self.base.filter(F.col(column).isNotNull())


def no_index(t: Indexed, ranges: list[ColumnRange], missing_passes: bool = False) -> DataFrame:
    if not ranges:
        raise ValueError("a range is asked for")
    return t.base.filter(conjunction(ranges, missing_passes))


def _usable(t: Indexed, ranges: list[ColumnRange]) -> list[ColumnRange]:
    return [r for r in ranges if r.qualifier in t.indexed and r.is_range]


def global_secondary(t: Indexed, ranges: list[ColumnRange]) -> DataFrame:
    """Row keys of each index range, intersected, then fetched; the full condition is applied once more, so columns without an index and != are right."""
    usable = _usable(t, ranges)
    if not usable:
        return no_index(t, ranges)
    keys = [t.secondary(r.qualifier).filter(r.test()).select("row") for r in usable]
    return fetch(t.base.filter(conjunction(ranges)), intersect_keys(keys), t.row)


def global_clustering(t: Indexed, ranges: list[ColumnRange], chooser=None) -> DataFrame:
    """One scan of the copy sorted by the most selective column; the other ranges are residual."""
    usable = _usable(t, ranges)
    if not usable:
        return no_index(t, ranges)
    best = min(usable, key=chooser) if chooser else usable[0]
    return t.clustered(best.qualifier).filter(conjunction(ranges)).select(*t.base.columns)


def complemental_clustering(t: Indexed, ranges: list[ColumnRange], chooser=None) -> DataFrame:
    """As global_clustering; the check table (index columns alone) decides first which rows are wanted."""
    usable = _usable(t, ranges)
    if not usable:
        return no_index(t, ranges)
    best = min(usable, key=chooser) if chooser else usable[0]
    check = t.copies.get("cct", t.base.select(F.col(t.row).alias("row"), *t.indexed)).filter(conjunction([r for r in ranges if r.qualifier in t.indexed])).select("row")
    return fetch(t.clustered(best.qualifier).filter(conjunction(ranges)), check, t.row).select(*t.base.columns)


@dataclass(frozen=True)
class Covering:
    """An index on `column` that also holds `others`."""

    column: str
    others: tuple[str, ...] = ()


def user_defined(t: Indexed, indexes: list[Covering], ranges: list[ColumnRange], columns: list[str], chooser=None, local: bool = False) -> DataFrame:
    """A covering index whose main column is ranged answers alone (a local one is sorted by region first); else the secondary path over what indexes there are, with residual conditions."""
    need = {*columns, *(r.qualifier for r in ranges)} - {t.row}
    ranged = {r.qualifier: r for r in ranges if r.is_range}
    fit = [i for i in indexes if i.column in ranged and need <= {i.column, *i.others}]
    if fit:
        best = min(fit, key=lambda i: chooser(ranged[i.column])) if chooser else fit[0]
        copy = t.copies.get(f"udl_{best.column}" if local else f"udg_{best.column}", t.base.filter(F.col(best.column).isNotNull()).select(t.row, best.column, *best.others))
        return copy.filter(conjunction(ranges)).select(*columns)
    return global_secondary(Indexed(t.base, t.row, [i.column for i in indexes], t.copies), ranges).select(*columns)


def in_region(t: Indexed, ranges: list[ColumnRange], region: str = "region") -> DataFrame:
    """Row sets are made and intersected inside each region: the region is part of every join key, so a table dealt by region needs no further exchange."""
    usable = _usable(t, ranges)
    if not usable:
        return no_index(t, ranges)
    keys = None
    for r in usable:
        one = t.copies.get(f"ir_{r.qualifier}", t.base).filter(r.test()).select(F.col(region).alias("__g"), F.col(t.row).alias("__r"))
        keys = one if keys is None else keys.join(one, ["__g", "__r"], "left_semi")
    return t.base.filter(conjunction(ranges)).join(keys, (F.col(region) == F.col("__g")) & (F.col(t.row) == F.col("__r")), "left_semi")


def local_clustering(t: Indexed, ranges: list[ColumnRange], chooser=None, region: str = "region") -> DataFrame:
    """A copy sorted by (region, column): one range scan in each region."""
    usable = _usable(t, ranges)
    if not usable:
        return no_index(t, ranges)
    best = min(usable, key=chooser) if chooser else usable[0]
    return t.copies.get(f"lc_{best.qualifier}", t.base.filter(F.col(best.qualifier).isNotNull())).filter(conjunction(ranges)).select(*t.base.columns)


def multi_dimensional(t: Indexed, ranges: list[ColumnRange], by_key: bool = True, most_ranges: int = 64, region: str | None = None) -> DataFrame:
    """Z-order keys: the box becomes key ranges, whose candidates are tested exactly, and fetched (by_key) or returned from the copy itself.

    With region the copy is the local one, sorted by region first; what is
    fetched is met by region and key. Coordinates are non-negative integers of
    t.bits bits. Open ends and operators are exact, as the full condition is
    applied after the candidates.
    """
    dims = [c for c in t.indexed if c in t.bits]
    bits = max(t.bits.values())
    top = (1 << bits) - 1
    low, high = [], []
    for c in dims:
        spans = [r.interval() for r in ranges if r.qualifier == c]
        low.append(int(max([0, *(a for a, _ in spans if a > float("-inf"))])))
        high.append(int(min([top, *(b for _, b in spans if b < float("inf"))])))
    if any(a > b for a, b in zip(low, high, strict=True)):
        return t.base.limit(0)
    spans = box_ranges(low, high, bits, most_ranges)
    name = "lmd" if region else "md"
    if name in t.copies:
        copy = t.copies[name]
    else:
        copy = t.base.filter(" AND ".join(f"{c} IS NOT NULL" for c in dims)).withColumn("zkey", zip_bits([F.col(c) for c in dims], bits))
    found = copy.filter(in_ranges(F.col("zkey"), spans, name not in t.copies)).filter(conjunction(ranges) if not by_key or name not in t.copies else conjunction([r for r in ranges if r.qualifier in dims]))
    if not by_key:
        return found.select(*t.base.columns)
    base = t.base.filter(conjunction(ranges))
    if region:
        keys = found.select(F.col(region).alias("__g"), F.col(t.row).alias("__r"))
        return base.join(keys, (F.col(region) == F.col("__g")) & (F.col(t.row) == F.col("__r")), "left_semi")
    return fetch(base, found.select(F.col(t.row).alias("row")), t.row)


def disjunction(t: Indexed, groups: list[list[ColumnRange]], path) -> DataFrame:
    """Rows of any of the conjunctions: one plan for each, without repeats."""
    out = None
    for ranges in groups:
        one = path(t, ranges)
        out = one if out is None else out.unionByName(one)
    return out.dropDuplicates([t.row])


__all__ = ["OPS", "Covering", "Indexed", "complemental_clustering", "disjunction", "global_clustering", "global_secondary", "in_region", "local_clustering", "multi_dimensional", "no_index", "user_defined"]
