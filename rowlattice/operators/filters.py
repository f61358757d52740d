"""The filter tree over cells.

A filter says of each cell whether it is included, and may drop whole rows. It
is applied before versions are counted, so a rejected newest version lets an
older one through. flags(df) adds two boolean columns and returns their names;
windows are over one row's cells, so one exchange by row serves a whole tree.
Inside a list of mode ALL a filter sees the cells that those before it include:
they are marked in the column SEEN, which windows respect, so that a tree of any
depth reads its table once.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlattice.operators.predicates import OPS, compare, in_intervals

_ids = itertools.count()
ROW = ["row"]
#: Parts of a region in which the first rows are looked for.
PARTS = 256
SEEN = "__seen"


def _seen(df: DataFrame) -> Column:
    return F.col(SEEN) if SEEN in df.columns else F.lit(True)


def _in_row():
    return Window.partitionBy(*ROW)


def _ordered(df: DataFrame):
    """Of a row's cells those in sight first, so that what counts them needs no other order."""
    return _in_row().orderBy(*([F.col(SEEN).desc()] if SEEN in df.columns else []), "family", "qualifier", F.col("ts").desc(), F.col("seq").desc())


def _columns(df: DataFrame):
    """Places of a row's columns, those in sight first."""
    return F.dense_rank().over(_in_row().orderBy(*([F.col(SEEN).desc()] if SEEN in df.columns else []), "family", "qualifier"))


class Filter:
    """Either include() alone is overridden, for filters that look at one cell, or flags()."""

    def include(self) -> Column:
        raise NotImplementedError

    def prepare(self, df: DataFrame) -> DataFrame:
        return df

    def flags(self, df: DataFrame) -> tuple[DataFrame, str, str]:
        n = next(_ids)
        df = self.prepare(df)
        return df.withColumns({f"__i{n}": F.coalesce(self.include(), F.lit(False)), f"__d{n}": F.lit(False)}), f"__i{n}", f"__d{n}"

    def transform(self, df: DataFrame) -> DataFrame:
        """What is done to the included cells."""
        return df

    def apply(self, df: DataFrame) -> DataFrame:
        columns = df.columns
        if type(self).flags is Filter.flags and type(self).prepare is Filter.prepare:
            return self.transform(df.filter(self.include()))  # a bare predicate, which can reach the scan
        out, include, drop = self.flags(df)
        return self.transform(out.filter(F.col(include) & ~F.col(drop)).select(*columns))


# ---- filters that look at one cell ----
@dataclass
class RowFilter(Filter):
    op: str
    comparator: Any

    def include(self):
        return self.comparator.test(F.col("row"), self.op) if OPS.get(self.op, self.op) != "NO_OP" else F.lit(False)


@dataclass
class FamilyFilter(Filter):
    op: str
    comparator: Any

    def include(self):
        return self.comparator.test(F.col("family"), self.op)


@dataclass
class QualifierFilter(Filter):
    op: str
    comparator: Any

    def include(self):
        return self.comparator.test(F.col("qualifier"), self.op)


@dataclass
class ValueFilter(Filter):
    """Rejects cells, not rows."""

    op: str
    comparator: Any

    def include(self):
        return self.comparator.test(F.col("value"), self.op)


@dataclass
class PrefixFilter(Filter):
    prefix: Any

    def include(self):
        return F.startswith(F.col("row"), F.lit(self.prefix))


@dataclass
class InclusiveStopFilter(Filter):
    stop: Any

    def include(self):
        return F.col("row") <= F.lit(self.stop)


@dataclass
class MultiRowRangeFilter(Filter):
    """Rows in any of the ranges (start, inclusive, stop, inclusive)."""

    ranges: list

    def include(self):
        return in_intervals(F.col("row"), self.ranges)


@dataclass
class FuzzyRowFilter(Filter):
    """Patterns (key, mask): a mask of 0 fixes the character at its place, 1 lets any stand there. Rows may be longer."""

    patterns: list

    def include(self):
        out = F.lit(False)
        for key, mask in self.patterns:
            one = F.length("row") >= len(key)
            for i, m in enumerate(mask):
                if not m:
                    one = one & (F.substring("row", i + 1, 1) == F.lit(key[i : i + 1]))
            out = out | one
        return out


@dataclass
class RandomRowFilter(Filter):
    """A row passes with the given chance; a hash of the key and the seed decides, so that a repeated task agrees."""

    chance: float
    seed: int = 0

    def include(self):
        return F.pmod(F.xxhash64(F.lit(self.seed), "row"), F.lit(1 << 30)) < F.lit(int(self.chance * (1 << 30)))


@dataclass
class ColumnPrefixFilter(Filter):
    prefix: Any

    def include(self):
        return F.startswith(F.col("qualifier"), F.lit(self.prefix))


@dataclass
class MultipleColumnPrefixFilter(Filter):
    prefixes: list

    def include(self):
        out = F.lit(False)
        for p in self.prefixes:
            out = out | F.startswith(F.col("qualifier"), F.lit(p))
        return out


@dataclass
class ColumnRangeFilter(Filter):
    low: Any = None
    low_inclusive: bool = True
    high: Any = None
    high_inclusive: bool = False

    def include(self):
        return in_intervals(F.col("qualifier"), [(self.low, self.low_inclusive, self.high, self.high_inclusive)])


@dataclass
class TimestampsFilter(Filter):
    stamps: list

    def include(self):
        return F.col("ts").isin([int(t) for t in self.stamps])


@dataclass
class TimeRangeFilter(Filter):
    """A closed range of ts for one column; other columns pass."""

    family: str
    qualifier: Any
    start: int
    end: int

    def include(self):
        mine = (F.col("family") == self.family) & (F.col("qualifier") == self.qualifier)
        return ~mine | F.col("ts").between(self.start, self.end)


@dataclass
class KeyOnlyFilter(Filter):
    """Empties values, or leaves their length."""

    length_as_value: bool = False

    def include(self):
        return F.lit(True)

    def transform(self, df):
        return df.withColumn("value", F.length(F.col("value").cast("string")).cast("string") if self.length_as_value else F.lit(""))


@dataclass
class VisibilityFilter(Filter):
    """Cells whose label expression (column visibility) the labels satisfy; see functions.visibility."""

    labels: list
    column: str = "visibility"

    def include(self):
        from rowlattice.functions.visibility import visible

        return visible(F.col(self.column), self.labels)


@dataclass
class MultiDimensionFilter(Filter):
    """Cells whose z-order key (column value) lies in a box, bounds included."""

    box: list
    bits: int

    def include(self):
        from rowlattice.functions.zorder import unzip

        out = F.lit(True)
        for i, (low, high) in enumerate(self.box):
            out = out & unzip(F.col("value").cast("long"), i, len(self.box), self.bits).between(low, high)
        return out


# ---- filters over a row's cells ----
@dataclass
class FirstKeyOnlyFilter(Filter):
    def prepare(self, df):
        return df.withColumn("__first", F.row_number().over(_ordered(df)))

    def include(self):
        return F.col("__first") == 1


@dataclass
class FirstKeyValueMatchingQualifiersFilter(Filter):
    """Cells up to and with the first of the listed qualifiers."""

    qualifiers: list

    def prepare(self, df):
        before = _ordered(df).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("__met", F.coalesce(F.max(F.col("qualifier").isin(self.qualifiers).cast("int")).over(before), F.lit(0)))

    def include(self):
        return F.col("__met") == 0


@dataclass
class ColumnCountGetFilter(Filter):
    """The first n columns of a row."""

    n: int

    def prepare(self, df):
        return df.withColumn("__column", _columns(df))

    def include(self):
        return F.col("__column") <= self.n


@dataclass
class ColumnPaginationFilter(Filter):
    """A page of columns; versions of a column don't count. offset is a number or, as column_offset, a first qualifier."""

    limit: int
    offset: int = 0
    column_offset: Any = None

    def prepare(self, df):
        if self.column_offset is None:
            return df.withColumn("__column", _columns(df))
        at = F.when(_seen(df) & (F.col("qualifier") >= self.column_offset), F.struct("family", "qualifier"))
        return df.withColumn("__column", F.when(at.isNotNull(), F.dense_rank().over(_in_row().orderBy(at.asc_nulls_last()))))

    def include(self):
        start = self.offset if self.column_offset is None else 0
        return (F.col("__column") > start) & (F.col("__column") <= start + self.limit)


@dataclass
class DependentColumnFilter(Filter):
    """Cells of a row whose ts a reference column has too, in a version that passes the comparison."""

    family: str
    qualifier: Any
    drop: bool = False
    op: str | None = None
    comparator: Any = None

    def prepare(self, df):
        ref = (F.col("family") == self.family) & (F.col("qualifier") == self.qualifier)
        ref = ref & self.comparator.test(F.col("value"), self.op) if self.comparator else ref
        return df.withColumn("__same", F.max((ref & _seen(df)).cast("int")).over(Window.partitionBy(*ROW, "ts")))

    def include(self):
        mine = (F.col("family") == self.family) & (F.col("qualifier") == self.qualifier)
        passes = self.comparator.test(F.col("value"), self.op) if self.comparator else F.lit(True)
        return (F.col("__same") == 1) & (~mine if self.drop else ~mine | passes)


@dataclass
class SingleColumnValueFilter(Filter):
    """Drops rows whose column fails. A row without the column passes, unless filter_if_missing. The newest version is tested, or with latest_only off any."""

    family: str
    qualifier: Any
    op: str
    comparator: Any
    filter_if_missing: bool = False
    latest_only: bool = True

    def _mine(self) -> Column:
        return (F.col("family") == self.family) & (F.col("qualifier") == self.qualifier)

    def flags(self, df):
        n = next(_ids)
        passes = F.coalesce(self.comparator.test(F.col("value"), self.op), F.lit(False))
        mine = self._mine() & _seen(df)
        if self.latest_only:
            tested = F.max(F.when(mine, F.struct("ts", "seq", passes.alias("ok")))).over(_in_row())["ok"]
        else:
            tested = F.max(F.when(mine, passes)).over(_in_row())
        return df.withColumns({f"__d{n}": ~F.coalesce(tested, F.lit(not self.filter_if_missing)), f"__i{n}": F.lit(True)}), f"__i{n}", f"__d{n}"


@dataclass
class SingleColumnValueExcludeFilter(SingleColumnValueFilter):
    """The same, and the tested column goes."""

    def flags(self, df):
        df, include, drop = super().flags(df)
        return df.withColumn(include, ~self._mine()), include, drop


@dataclass
class SkipFilter(Filter):
    """Drops a row if the child rejects any of its cells."""

    child: Filter

    def flags(self, df):
        df, include, drop = self.child.flags(df)
        n = next(_ids)
        return df.withColumns({f"__i{n}": F.col(include), f"__d{n}": F.col(drop) | (F.coalesce(F.min(F.when(_seen(df), F.col(include).cast("int"))).over(_in_row()), F.lit(1)) == 0)}), f"__i{n}", f"__d{n}"


@dataclass
class WhileMatchFilter(Filter):
    """Ends the scan at the first cell or row that the child rejects.

    That place is the least rejected position, found by an aggregation to one
    row, which is broadcast back: it stays on the executors.
    """

    child: Filter

    def flags(self, df):
        n = next(_ids)
        at = F.struct("row", "family", "qualifier", (-F.col("ts")).alias("t"), (-F.col("seq")).alias("s"))
        df, include, drop = self.child.flags(df)
        first = df.filter(_seen(df) & (~F.col(include) | F.col(drop))).agg(F.min(at).alias(f"__end{n}"))
        out = df.join(F.broadcast(first), F.lit(True), "left")
        return out.withColumns({f"__i{n}": F.coalesce(at < F.col(f"__end{n}"), F.lit(True)), f"__d{n}": F.lit(False)}).drop(f"__end{n}"), f"__i{n}", f"__d{n}"


@dataclass
class PageFilter(Filter):
    """The first n rows of each region (column region, if the table has one; else of the table). A limit over all regions is Scan.limit."""

    n: int

    def flags(self, df):
        k = next(_ids)
        by = ["region"] if "region" in df.columns else []
        rows = df.filter(_seen(df)).select(*by, *ROW).distinct()
        if by:
            # the first n of each of a region's parts, then of the region: no task sorts a region
            first = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*ROW)) <= self.n
            parts = rows.withColumn("__part", F.pmod(F.xxhash64(*ROW), F.lit(PARTS))).withColumn("__first", first(*by, "__part")).filter("__first")
            keep = parts.withColumn("__first", first(*by)).filter("__first")
        else:
            keep = rows.orderBy(*ROW).limit(self.n)
        keep = keep.select(*[F.col(c).alias(f"__p{c}") for c in ROW], F.lit(True).alias(f"__i{k}"))
        cond = [F.col(c) == F.col(f"__p{c}") for c in ROW]
        return df.join(F.broadcast(keep) if not by and self.n <= 100_000 else keep, cond, "left").drop(*[f"__p{c}" for c in ROW]).withColumns({f"__i{k}": F.coalesce(f"__i{k}", F.lit(False)), f"__d{k}": F.lit(False)}), f"__i{k}", f"__d{k}"


# ---- lists ----
@dataclass
class FilterList(Filter):
    """ALL: each filter sees what those before it include. ONE: a cell is included if any filter includes it, a row goes if all drop it; an empty list includes nothing."""

    mode: str = "ALL"
    filters: list = field(default_factory=list)

    def flags(self, df):
        n = next(_ids)
        if self.mode == "ALL":
            # the cells that earlier filters reject are out of sight of later ones
            outer = SEEN in df.columns
            df = df.withColumns({f"__o{n}": _seen(df), SEEN: _seen(df)})
            for f in self.filters:
                df, i, d = f.flags(df)
                df = df.withColumn(SEEN, F.col(SEEN) & F.col(i) & ~F.col(d))
            df = df.withColumns({f"__i{n}": F.col(SEEN), f"__d{n}": F.lit(False)})
            return (df.withColumn(SEEN, F.col(f"__o{n}")) if outer else df.drop(SEEN)).drop(f"__o{n}"), f"__i{n}", f"__d{n}"
        include, drop = F.lit(False), F.lit(bool(self.filters))
        for f in self.filters:
            df, i, d = f.flags(df)
            include, drop = include | (F.col(i) & ~F.col(d)), drop & F.col(d)
        return df.withColumns({f"__i{n}": include, f"__d{n}": drop}), f"__i{n}", f"__d{n}"

    def apply(self, df):
        if self.mode == "ALL":
            for f in self.filters:
                df = f.apply(df)
            return df
        return super().apply(df)

    def transform(self, df):
        for f in self.filters:
            df = f.transform(df)
        return df


def both(*filters: Filter) -> FilterList:
    return FilterList("ALL", list(filters))


def either(*filters: Filter) -> FilterList:
    return FilterList("ONE", list(filters))


@dataclass
class CustomFilter(Filter):
    """Any Column expression over a cell."""

    condition: Column

    def include(self):
        return self.condition


__all__ = [n for n in dir() if n.endswith("Filter") or n in ("FilterList", "both", "either", "compare")]
