"""Murmur3 (32 bits) and Jenkins's one-at-a-time hash over the UTF-8 bytes of a text, as Columns and in Python.

Both are published algorithms; results are unsigned 32-bit numbers in longs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
#: Fixed values of Murmur3.
C1, C2, ADD, MIX1, MIX2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35


def _long(v: int) -> Column:
    return F.lit(v).cast("long")


def _low(c: Column) -> Column:
    return c.bitwiseAND(_long(MASK))


def _times(a: Column, b: int) -> Column:
    """The low 32 bits of a product of 32-bit numbers, by halves of b, so that no long overflows."""
    return _low(a * _long(b & 0xFFFF) + F.shiftleft((a * _long(b >> 16)).bitwiseAND(_long(0xFFFF)), 16))


def _turn(a: Column, by: int) -> Column:
    return _low(F.shiftleft(a, by)).bitwiseOR(F.shiftright(a, 32 - by))


def _bytes(text: Column) -> Column:
    """The bytes as an array of longs."""
    data = F.hex(F.encode(text, "utf-8"))
    at = F.sequence(F.lit(1), F.greatest(F.length(data) - 1, F.lit(1)), F.lit(2))
    return F.when(F.length(data) > 0, F.transform(at, lambda i: F.conv(F.substring(data, i, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def murmur3(text: Column, seed: int = 0) -> Column:
    def scramble(k: Column) -> Column:
        return _times(_turn(_times(k, C1), 15), C2)

    def word(b: Column, at: Column, n: int) -> Column:
        out = _long(0)
        for j in range(n):
            out = out + F.shiftleft(F.coalesce(F.get(b, at + j), _long(0)), 8 * j)
        return out

    def whole(b: Column) -> Column:
        n = F.size(b)
        blocks = F.filter(F.sequence(F.lit(0), n, F.lit(4)), lambda i: i + 4 <= n)
        h = F.aggregate(blocks, _long(seed & MASK), lambda h, i: _low(_times(_turn(h.bitwiseXOR(scramble(word(b, i, 4))), 13), 5) + _long(ADD)))
        h = h.bitwiseXOR(scramble(word(b, (F.floor(n / 4) * 4).cast("int"), 3))).bitwiseXOR(n.cast("long"))
        return F.aggregate(F.array(_long(MIX1), _long(MIX2)), h, lambda h, m: F.when(m == MIX1, _times(h.bitwiseXOR(F.shiftright(h, 16)), MIX1)).otherwise(_times(h.bitwiseXOR(F.shiftright(h, 13)), MIX2)), lambda h: h.bitwiseXOR(F.shiftright(h, 16)))

    return F.get(F.transform(F.array(_bytes(text)), whole), F.lit(0))


def one_at_a_time(text: Column) -> Column:
    def mixed(h: Column, b: Column) -> Column:
        return _bind(_bind(_low(h + b), lambda x: _low(x + F.shiftleft(x, 10))), lambda x: x.bitwiseXOR(F.shiftright(x, 6)))

    def last(h: Column) -> Column:
        return _bind(_bind(_low(h + F.shiftleft(h, 3)), lambda x: x.bitwiseXOR(F.shiftright(x, 11))), lambda x: _low(x + F.shiftleft(x, 15)))

    return F.aggregate(_bytes(text), _long(0), mixed, last)


def _bind(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def murmur3_int(data: bytes, seed: int = 0) -> int:
    def scramble(k: int) -> int:
        k = k * C1 & MASK
        return ((k << 15 | k >> 17) & MASK) * C2 & MASK

    h, n = seed & MASK, len(data) // 4 * 4
    for i in range(0, n, 4):
        h ^= scramble(int.from_bytes(data[i : i + 4], "little"))
        h = ((h << 13 | h >> 19) & MASK) * 5 + ADD & MASK
    h ^= scramble(int.from_bytes(data[n:], "little")) ^ len(data)
    h = (h ^ h >> 16) * MIX1 & MASK
    h = (h ^ h >> 13) * MIX2 & MASK
    return h ^ h >> 16


def one_at_a_time_int(data: bytes) -> int:
    h = 0
    for b in data:
        h = h + b & MASK
        h = h + (h << 10) & MASK
        h ^= h >> 6
    h = h + (h << 3) & MASK
    h ^= h >> 11
    return h + (h << 15) & MASK
