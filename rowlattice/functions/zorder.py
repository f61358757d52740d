"""Z-order keys of up to 63 bits, prefix buckets, and the key ranges of a box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _mask(group: int, d: int, bits: int) -> Column:
    """Bits in groups of `group`, each group followed by room for those of the other dimensions."""
    return F.lit(sum(1 << (i // group * group * d + i % group) for i in range(bits))).cast("long")


def _groups(bits: int) -> list[int]:
    return [1 << k for k in range((bits - 1).bit_length() - 1, -1, -1)]


def _spread(c: Column, d: int, bits: int) -> Column:
    """Bits of a number d places apart: groups are halved and moved, so it takes log2(bits) steps."""
    x = c.cast("long")
    for g in _groups(bits):
        x = x.bitwiseOR(F.shiftleft(x, g * (d - 1))).bitwiseAND(_mask(g, d, bits))
    return x


def zip_bits(dims: list[Column], bits: int) -> Column:
    """Interleaved bits of non-negative integers below 2**bits, the first dimension's the highest."""
    d = len(dims)
    if d * bits > 63:
        raise ValueError(f"{d} dimensions of {bits} bits don't fit into 63")
    out = F.lit(0).cast("long")
    for i, c in enumerate(dims):
        out = out.bitwiseOR(F.shiftleft(_spread(c, d, bits), d - 1 - i))
    return out


def unzip(key: Column, i: int, d: int, bits: int) -> Column:
    """Coordinate i of a key."""
    x = F.shiftright(key.cast("long"), d - 1 - i).bitwiseAND(_mask(1, d, bits))
    for g in reversed(_groups(bits)):
        x = x.bitwiseOR(F.shiftright(x, g * (d - 1))).bitwiseAND(_mask(2 * g, d, bits))
    return x


def zip_int(point: list[int], bits: int) -> int:
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in point:
            out = out << 1 | (v >> b & 1)
    return out


def box_ranges(low: list[int], high: list[int], bits: int, most: int = 256) -> list[tuple[int, int]]:
    """Key ranges, ends included, that cover the box; at most about `most`, with neighbours merged.

    The cells of the space are halved, widest uncertain cell first, until each
    is inside the box, outside it, or the number is reached; a cell that is
    partly inside then stands whole, and the box test after the scan decides.
    """
    d = len(low)
    total = d * bits
    whole: list[tuple[int, int]] = []
    open_ = [(0, 0)]  # prefix, its length
    while open_ and len(whole) + len(open_) < most:
        prefix, length = open_.pop(0)
        a, b = _corner(prefix, length, d, bits)
        if any(x > h or y < lo for x, y, lo, h in zip(a, b, low, high, strict=True)):
            continue
        if all(lo <= x and y <= h for x, y, lo, h in zip(a, b, low, high, strict=True)) or length == total:
            whole.append((prefix << (total - length), ((prefix + 1) << (total - length)) - 1))
            continue
        open_ += [(prefix << 1, length + 1), (prefix << 1 | 1, length + 1)]
    for prefix, length in open_:
        a, b = _corner(prefix, length, d, bits)
        if not any(x > h or y < lo for x, y, lo, h in zip(a, b, low, high, strict=True)):
            whole.append((prefix << (total - length), ((prefix + 1) << (total - length)) - 1))
    out: list[tuple[int, int]] = []
    for s, e in sorted(whole):
        if out and s <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _corner(prefix: int, length: int, d: int, bits: int) -> tuple[list[int], list[int]]:
    """Least and greatest point of a prefix cell."""
    low, high = [0] * d, [0] * d
    for k in range(d * bits):
        bit = prefix >> (length - 1 - k) & 1 if k < length else None
        i = k % d
        low[i] = low[i] << 1 | (bit or 0)
        high[i] = high[i] << 1 | (1 if bit is None else bit)
    return low, high


def in_ranges(key: Column, ranges: list[tuple[int, int]], computed: bool = False) -> Column:
    """Whether key lies in any range. A computed key is bound once, as a plain predicate would repeat its expression in each comparison; a stored one keeps bare comparisons, which reach the scan."""
    if computed:
        return F.element_at(F.transform(F.array(key), lambda z: in_ranges(z, ranges)), 1)
    out = F.lit(False)
    for s, e in ranges:
        out = out | key.between(s, e)
    return out


def buckets(keys: DataFrame, key: str, total_bits: int, most: int) -> DataFrame:
    """prefix, bits, n: a bucket for each prefix that holds `most` keys at most while its parent holds more (or whole keys).

    Counts of whole keys first; then each of these adds to its prefixes of all
    lengths, and a prefix is held against its parent.
    """
    whole = keys.groupBy(F.col(key).cast("long").alias("key")).agg(F.count("*").alias("n"))
    bits = F.explode(F.sequence(F.lit(0), F.lit(total_bits))).alias("bits")
    counts = whole.select("key", "n", bits).groupBy(F.expr(f"shiftright(key, {total_bits} - bits)").alias("prefix"), "bits").agg(F.sum("n").alias("n"))
    parents = counts.select(F.col("prefix").alias("__p"), (F.col("bits") + 1).alias("__b"), F.col("n").alias("__n"))
    met = counts.join(parents, (F.shiftright("prefix", 1) == F.col("__p")) & (F.col("bits") == F.col("__b")), "left")
    return met.filter(((F.col("n") <= most) | (F.col("bits") == total_bits)) & ((F.col("bits") == 0) | (F.col("__n") > most))).select("prefix", "bits", "n")
