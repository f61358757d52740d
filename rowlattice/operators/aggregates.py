"""Aggregates over the cells of a scan, and counts of rows and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cell_aggregates(cells: DataFrame, value: Column) -> DataFrame:
    """One row: max, min, sum over cells (null if there are none), rows, avg as sum of cells by rows (NaN if empty), population std of cells."""
    rows = F.countDistinct("row")
    return cells.agg(
        F.max(value).alias("max"),
        F.min(value).alias("min"),
        F.sum(value).alias("sum"),
        rows.alias("rows"),
        F.coalesce(F.sum(value).cast("double") / F.nullif(rows, F.lit(0)), F.lit(float("nan"))).alias("avg"),
        F.coalesce(F.stddev_pop(value.cast("double")), F.lit(float("nan"))).alias("std"),
    )


def by_region(df: DataFrame, value: str) -> DataFrame:
    """Partial aggregates of each region; total() merges them. Squares of whole numbers are summed as decimals, which don't overflow; deviation is the sum of squared distances from the region's mean."""
    v = F.col(value)
    whole = df.schema[value].dataType.typeName() in ("byte", "short", "integer", "long")
    wide = v.cast("decimal(19,0)") if whole else v
    return df.groupBy("region").agg(F.max(v).alias("max"), F.min(v).alias("min"), F.sum(v).alias("sum"), F.count("*").alias("rows"), F.sum(wide * wide).alias("squares"), (F.coalesce(F.var_pop(v.cast("double")), F.lit(0.0)) * F.count(v)).alias("deviation"))


def total(partials: DataFrame) -> DataFrame:
    """One row. The variance is that inside the regions and that of their means, about a mean of theirs, so nothing large cancels."""
    n = F.sum("rows")
    mean = F.sum("sum").cast("double") / n
    pivot = partials.agg(F.avg(F.col("sum").cast("double") / F.col("rows")).alias("__pivot"))
    off = F.col("sum").cast("double") / F.col("rows") - F.col("__pivot")
    with_pivot = partials.join(F.broadcast(pivot), F.lit(True), "left")
    made = with_pivot.agg(F.max("max").alias("max"), F.min("min").alias("min"), F.sum("sum").alias("sum"), n.alias("rows"), mean.alias("avg"), ((F.sum("deviation") + F.sum(F.col("rows") * off * off)) / n - F.pow(F.sum(F.col("rows") * off) / n, F.lit(2.0))).alias("__var"))
    return made.withColumn("std", F.sqrt(F.greatest("__var", F.lit(0.0)))).drop("__var")


def custom_aggregate(df: DataFrame, value: str, start: Column, step, merge, finish, parts: int = 64) -> DataFrame:
    """One row, result: an aggregate of the caller's own, as Column functions: step(state, value), merge(state, state), finish(state).

    Values are folded in `parts` parts of each region (a hash deals them, so
    none follows a hot region), then parts in regions, then regions. step and
    merge must not depend on order. Nulls are left out; an empty table gives
    finish(start).
    """
    by = ["region"] if "region" in df.columns else []
    dealt = df.filter(F.col(value).isNotNull()).withColumn("__part", F.pmod(F.xxhash64(value, F.monotonically_increasing_id()), F.lit(parts)))
    partial = dealt.groupBy(*by, "__part").agg(F.aggregate(F.collect_list(value), start, step).alias("__s"))
    for keys in ([by] if by else []) + [[]]:
        partial = partial.groupBy(*keys).agg(F.aggregate(F.collect_list("__s"), start, merge).alias("__s"))
    return partial.select(finish(F.col("__s")).alias("result"))


def weighted_median(df: DataFrame, order: str, value: str, weight: str | None = None, most: int = 100_000) -> DataFrame:
    """value of the last row, in `order`, before the running sum of weights passes half of the whole; null if empty or if the first row passes it.

    Without weight the values are their own weights. It doesn't depend on
    regions. Rows that share a key count as one, with the greatest of their
    values, so no key is hot; keys may be of any ordered type. Ranges between
    keys that a hash picks say where the crossing is; they are narrowed until
    `most` keys are left, and only these are sorted in one place.
    """
    keyed = df.groupBy(F.col(order).alias("k")).agg(F.sum(weight or value).alias("w"), F.max(value).alias("v")).filter("k IS NOT NULL")
    all_ = keyed.agg(F.sum("w")).first()[0]
    if all_ is None:
        return df.select(F.col(value).alias("median")).limit(0)
    half, before, low, part, n = all_ / 2, 0, None, keyed, keyed.count()
    while n > most:
        picked = sorted(r["k"] for r in part.filter(F.pmod(F.xxhash64("k", F.lit(n)), F.lit(max(1, n // 256))) == 0).select("k").collect())  # about 256 keys
        bounds = picked[:: max(1, len(picked) // 64)]
        if not bounds:
            break
        place = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("k")))
        sums = sorted(part.groupBy(place.alias("b")).agg(F.sum("w").alias("s"), F.count("*").alias("n")).collect())
        at = sums[-1]
        for at in sums:
            if before + at["s"] > half:
                break
            before += at["s"]
        else:
            before -= at["s"]
        if at["n"] == n:
            break
        b, n = at["b"], at["n"]
        if b > 0:
            low = bounds[b - 1]
            part = part.filter(F.col("k") >= F.lit(low))
        if b < len(bounds):
            part = part.filter(F.col("k") < F.lit(bounds[b]))
    run = F.sum("w").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.lit(before)
    last = part.withColumn("__run", run).filter(F.col("__run") <= half).agg(F.max_by("v", "k").alias("v"))
    if low is not None:
        earlier = keyed.filter(F.col("k") < F.lit(low)).agg(F.max_by("v", "k").alias("v"))
        last = last.withColumn("at", F.lit(1)).unionByName(earlier.withColumn("at", F.lit(0))).filter("v IS NOT NULL").agg(F.max_by("v", "at").alias("v"))
    return last.select(F.col("v").alias("median"))


def row_count(cells: DataFrame) -> DataFrame:
    return cells.agg(F.countDistinct("row").alias("rows"))


def cell_counts(cells: DataFrame) -> DataFrame:
    """family, qualifier, cells, rows, most versions of a column in a row."""
    per = cells.groupBy("row", "family", "qualifier").agg(F.count("*").alias("versions"))
    return per.groupBy("family", "qualifier").agg(F.sum("versions").alias("cells"), F.count("*").alias("rows"), F.max("versions").alias("most_versions"))


def group_by_values(cells: DataFrame, qualifiers: list[str]) -> DataFrame:
    """Rows grouped by the newest values of the qualifiers, joined with spaces in cell order; rows that lack one are left out."""
    names = sorted(qualifiers)
    newest = cells.filter(F.col("qualifier").isin(names)).groupBy("row").agg(*[F.max_by(F.col("value").cast("string"), F.when(F.col("qualifier") == q, F.struct("ts", "seq"))).alias(q) for q in names])
    return newest.dropna(subset=names).groupBy(F.concat_ws(" ", *names).alias("key")).agg(F.count("*").alias("rows"))


def histogram(df: DataFrame, column: str, low: float, high: float, parts: int) -> DataFrame:
    """bucket (0 .. parts - 1, values outside go to the ends), n: equal widths."""
    at = F.floor((F.col(column) - F.lit(low)).cast("double") * parts / F.lit(high - low))
    return df.filter(F.col(column).isNotNull()).groupBy(F.greatest(F.least(at, F.lit(parts - 1)), F.lit(0)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def value_histogram(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.filter(F.col(column).isin(values)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
