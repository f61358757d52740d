"""Joins and set operations on row keys, and lookups by order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def intersect_keys(keys: list[DataFrame]) -> DataFrame:
    """Row keys in all of them; semi-joins keep the first list's partitioning, and an empty list ends the work at run time."""
    return reduce(lambda a, b: a.join(b.select(F.col("row").alias("__r")), F.col("row") == F.col("__r"), "left_semi"), keys)


def union_keys(keys: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, keys).distinct()


def minus_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(F.col("row").alias("__r")), F.col("row") == F.col("__r"), "left_anti")


def fetch(base: DataFrame, keys: DataFrame, key: str = "row") -> DataFrame:
    """Rows of base whose key is listed. Spark broadcasts a short list and shuffles a long one."""
    return base.join(keys.select(F.col("row").alias("__r")), F.col(key) == F.col("__r"), "left_semi")


#: Rows that one window without a partition may hold, and cells in a cell of the next level.
LEVEL_ROWS, LEVEL = 65_536, 4096


def _before(cells: DataFrame) -> DataFrame:
    """__c, __before: the greatest __top of all earlier cells (__c, __top)."""
    earlier = lambda w: F.max("__top").over(w.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1))
    if cells.limit(LEVEL_ROWS + 1).count() <= LEVEL_ROWS:
        return cells.withColumn("__before", earlier(Window)).select("__c", "__before")
    dealt = cells.withColumn("__up", F.floor(F.col("__c") / LEVEL).cast("long"))
    above = _before(dealt.groupBy(F.col("__up").alias("__c")).agg(F.max("__top").alias("__top"))).select(F.col("__c").alias("__up"), F.col("__before").alias("__carry"))
    inside = dealt.withColumn("__local", earlier(Window.partitionBy("__up")))
    return inside.join(above, "__up").select("__c", F.coalesce("__local", "__carry").alias("__before"))


def floor_lookup(points: DataFrame, steps: DataFrame, point: str, step: str, width: int) -> DataFrame:
    """points with floor: the greatest step at or below each (a backward as-of join on long numbers).

    Both sides are put into cells of `width`; a window inside each cell finds
    the step there, and the last step of an earlier cell comes from a running
    maximum over the cells, which is made in cells of cells in turn, until a
    level has LEVEL_ROWS rows at most. No window runs over more.
    """
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    tops = steps.groupBy(cell(step).alias("__c")).agg(F.max(step).alias("__top"))
    per_cell = points.select(cell(point).alias("__c")).distinct().join(tops, "__c", "full_outer")
    earlier = _before(per_cell)
    here = points.withColumn("__c", cell(point)).withColumn("__id", F.struct(*points.columns))
    marks = steps.select(cell(step).alias("__c"), F.col(step).alias("__v")).withColumn("__row", F.lit(None).cast(here.schema["__id"].dataType)).withColumn("__s", F.col("__v"))
    rows = here.select("__c", F.col(point).alias("__v"), F.col("__id").alias("__row"), F.lit(None).cast("long").alias("__s"))
    w = Window.partitionBy("__c").orderBy("__v", F.col("__s").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = marks.select(*rows.columns).unionByName(rows).withColumn("__m", F.max("__s").over(w)).filter("__row IS NOT NULL")
    return local.join(earlier, "__c", "left").select("__row.*", F.coalesce("__m", "__before").alias("floor"))


def overlapping(boxes: DataFrame, buckets: DataFrame, most: int = 10_000) -> DataFrame:
    """Pairs of boxes (low, high) and buckets (start, end) that overlap; a bucket is a power of two wide and starts at a multiple of that.

    Up to `most` boxes are broadcast, after a look at their number. More of them
    meet the buckets by key: each box lists the buckets of each width there is
    that it touches.
    """
    if boxes.limit(most + 1).count() <= most:
        return buckets.join(F.broadcast(boxes), (F.col("low") <= F.col("end")) & (F.col("start") <= F.col("high")))
    one = F.lit(1).cast("long")
    width = F.col("end") - F.col("start") + 1
    sized = buckets.withColumn("__w", width)
    widths = [r[0] for r in sized.select("__w").distinct().collect()]  # 64 at most
    # of each width of bucket the ones that a box touches
    each = F.explode(F.array(*[F.lit(w).cast("long") for w in widths])).alias("__w")
    touched = boxes.select("low", "high", each).withColumn("__k", F.explode(F.sequence(F.floor(F.col("low") / F.col("__w")).cast("long"), F.floor(F.col("high") / F.col("__w")).cast("long"), one)))
    keyed = sized.withColumn("__k", F.floor(F.col("start") / F.col("__w")).cast("long"))
    return keyed.join(touched, ["__w", "__k"]).select(*buckets.columns, "low", "high")


def difference(source: DataFrame, target: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row of counters of a full outer comparison: rows on both sides and equal, on one side only, and with different values."""
    s = source.select(*keys, F.col(value).alias("__s"), F.lit(True).alias("__in_s"))
    t = target.select(*keys, F.col(value).alias("__t"), F.lit(True).alias("__in_t"))
    both = s.join(t, keys, "full_outer")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    only_s, only_t = F.col("__in_t").isNull(), F.col("__in_s").isNull()
    differs = ~only_s & ~only_t & ~F.col("__s").eqNullSafe(F.col("__t"))
    return both.agg(F.coalesce(count(~only_s & ~only_t & ~differs), F.lit(0)).alias("matching"), F.coalesce(count(only_s), F.lit(0)).alias("target_missing"), F.coalesce(count(only_t), F.lit(0)).alias("source_missing"), F.coalesce(count(differs), F.lit(0)).alias("different"))
