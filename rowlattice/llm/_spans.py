"""Places of regular-expression matches in a text, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def let(value: Column, body) -> Column:
    """body(value) with value worked out once: what a lambda function takes from outside is worked out at each of its calls."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(lengths: Column) -> Column:
    """Running sums of an array of longs, block by block, so that long arrays aren't copied at each step."""
    return let(lengths, _running)


def _running(lengths: Column) -> Column:
    zero = F.lit(0).cast("long")
    none = F.array().cast("array<bigint>")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(lengths) - 1) / BLOCK).cast("int"), F.lit(0))), lambda b: F.slice(lengths, b * BLOCK + 1, BLOCK))
    sums = F.transform(blocks, lambda x: F.aggregate(x, zero, lambda a, v: a + v))
    before = F.aggregate(sums, F.struct(zero.alias("t"), none.alias("a")), lambda s, v: F.struct((s["t"] + v).alias("t"), F.concat(s["a"], F.array(s["t"])).alias("a")), lambda s: s["a"])
    inside = lambda x, o: F.aggregate(x, F.struct(o.alias("t"), none.alias("a")), lambda s, v: F.struct((s["t"] + v).alias("t"), F.concat(s["a"], F.array(s["t"] + v)).alias("a")), lambda s: s["a"])
    return F.flatten(F.zip_with(blocks, before, inside))


def found(text: Column, pattern: str) -> Column:
    """The matches, leftmost and non-overlapping, as strings (null for a null text)."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def placed(text: Column, matches: Column, pattern: str) -> Column:
    """array<struct<m, start, end, before, after>> of the matches: code points, end exclusive, and the text on either side up to the next match.

    The text between matches is what split() leaves, so places are running
    sums of lengths.
    """
    empty = F.array().cast("array<struct<m:string,start:bigint,end:bigint,before:string,after:string>>")
    whole = let(F.split(text, pattern, -1), lambda gaps: let(matches, lambda found_: _placed(gaps, found_)))
    return F.when(F.size(matches) > 0, whole).otherwise(empty)


def _placed(gaps: Column, matches: Column) -> Column:
    steps = F.zip_with(matches, F.slice(gaps, 1, F.size(matches)), lambda m, g: (F.length(m) + F.length(g)).cast("long"))
    return F.zip_with(F.zip_with(matches, running(steps), lambda m, e: F.struct(m.alias("m"), e.alias("e"))), F.zip_with(F.slice(gaps, 1, F.size(matches)), F.slice(gaps, 2, F.size(matches)), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda a, b: F.struct(a["m"].alias("m"), (a["e"] - F.length(a["m"])).alias("start"), a["e"].alias("end"), b["x"].alias("before"), b["y"].alias("after")))


def clear_of(s: Column, spans: Column) -> Column:
    """Whether s (start, end) overlaps none of spans, which are disjoint and in order: a search by halves, so that thousands of both are cheap."""
    n = F.size(spans)
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(n + F.lit(1.0))).cast("int")))

    def halve(a: Column, _: Column) -> Column:
        mid = F.floor((a["low"] + a["high"]) / 2).cast("int")
        left = F.struct(a["low"].alias("low"), mid.alias("high"))
        right = F.struct((mid + 1).alias("low"), a["high"].alias("high"))
        return F.when(a["low"] >= a["high"], a).when(F.get(spans, mid)["start"] < s["end"], right).otherwise(left)

    before = F.aggregate(steps, F.struct(F.lit(0).alias("low"), n.alias("high")), halve, lambda a: a["low"])  # so many start before s ends
    return F.when(n == 0, F.lit(True)).otherwise(F.coalesce(F.get(spans, before - 1)["end"] <= s["start"], F.lit(True)))


def joined(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end, comma-joined, of array<struct<..., k, ..>>; k is the kind's number."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
