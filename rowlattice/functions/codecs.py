"""Order-preserving and plain encodings of values as bytes, and other scalar functions."""

from __future__ import annotations

import struct
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Column expressions: hexadecimal texts and bytes that sort as the values do ----


def ordered_long_hex(c: Column) -> Column:
    """16 hexadecimal digits that sort as the signed 64-bit number: the sign bit turned."""
    return F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(-(2**63)).cast("long"))), 16, "0")


def ordered_int_hex(c: Column) -> Column:
    return F.lpad(F.hex(c.cast("long") + F.lit(2**31)), 8, "0")


def ordered_bytes(c: Column) -> Column:
    return F.unhex(ordered_long_hex(c))


def decode_ordered_long(b: Column) -> Column:
    low = F.conv(F.substring(F.hex(b), 9, 8), 16, 10).cast("long")
    high = F.conv(F.substring(F.hex(b), 1, 8), 16, 10).cast("long") - F.lit(2**31)
    return F.shiftleft(high, 32).bitwiseOR(low)


def plain_long_hex(c: Column) -> Column:
    """Big-endian two's complement: sorts negative numbers after the others."""
    return F.lpad(F.hex(c.cast("long")), 16, "0")


def index_key(value: Column, row: Column) -> Column:
    """value, a zero, row, and the row's length with the zero as eight digits; null for an empty value."""
    made = F.concat(value, F.lit("\0"), row, F.lpad((F.length(row) + 1).cast("string"), 8, "0"))
    return F.when(F.length(value) > 0, made)


def index_key_row(key: Column) -> Column:
    n = F.substring(key, -8, 8).cast("int") - 1
    return F.substr(key, F.length(key) - 8 - n + 1, n)


def index_key_value(key: Column) -> Column:
    n = F.substring(key, -8, 8).cast("int")
    return F.substr(key, F.lit(1), F.length(key) - 8 - n)


def price_cents(c: Column) -> Column:
    """Truncated hundredths as an integer; beyond its range an error."""
    cents = (c * 100).cast("long")
    return F.when(cents.between(-(2**31), 2**31 - 1), cents.cast("int")).otherwise(F.raise_error(F.lit("price out of range")).cast("int"))


def date_int(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd").cast("int")


def priority(c: Column) -> Column:
    """1 to 5 of texts such as 1-URGENT; anything else is an error."""
    p = F.regexp_extract(c, r"^([1-5])-", 1)
    return F.when(p != "", p.cast("int")).otherwise(F.raise_error(F.concat(F.lit("unknown priority "), c)).cast("int"))


def salt(key: Column, regions: int) -> Column:
    """Region prefix of a long key: its two halves folded, modulo the regions, with the sign kept."""
    k = key.cast("long")
    folded = k.bitwiseXOR(F.shiftrightunsigned(k, 32)).cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    signed = F.when(folded >= 2**31, folded - 2**32).otherwise(folded)
    return (signed % regions).cast("int")


# ---- single values, for keys made on the driver and for tests ----
def encode(value, kind: str, descending: bool = False) -> bytes:
    """Bytes that sort as the values: INT8/16/32/64, FLOAT32/64, NUMERIC, STRING, BLOB; null sorts first and only NUMERIC, STRING and BLOB take it."""
    if value is None:
        if kind not in ("NUMERIC", "STRING", "BLOB"):
            raise ValueError(f"{kind} has no null")
        out = b"\x05"
    elif kind.startswith("INT"):
        bits = int(kind[3:])
        out = bytes([0x29 + {8: 0, 16: 1, 32: 2, 64: 3}[bits]]) + (value + (1 << (bits - 1))).to_bytes(bits // 8, "big")
    elif kind.startswith("FLOAT"):
        size = int(kind[5:]) // 8
        raw = int.from_bytes(struct.pack(">f" if size == 4 else ">d", value), "big")
        top = 1 << (8 * size - 1)
        out = bytes([0x30 if size == 4 else 0x31]) + ((raw ^ (2 * top - 1)) if raw & top else raw | top).to_bytes(size, "big")
    elif kind == "NUMERIC":
        out = _numeric(Decimal(value))
    elif kind in ("STRING", "BLOB"):
        raw = value.encode() if isinstance(value, str) else bytes(value)
        out = b"\x34" + raw.replace(b"\0", b"\0\xff") + b"\0\0"
    else:
        raise ValueError(kind)
    return bytes(x ^ 0xFF for x in out) if descending else out


def _numeric(v: Decimal) -> bytes:
    if not v:
        return b"\x15"
    sign, digits, exp = v.normalize().as_tuple()
    e = len(digits) + exp  # 0.d1d2.. x 10**e
    body = (e + 2**31).to_bytes(4, "big") + bytes(d + 1 for d in digits) + b"\0"
    return b"\x20" + body if not sign else b"\x10" + bytes(x ^ 0xFF for x in body)


def decode(data: bytes, kind: str, descending: bool = False):
    if descending:
        data = bytes(x ^ 0xFF for x in data)
    if data == b"\x05":
        return None
    if kind.startswith("INT"):
        bits = int(kind[3:])
        return int.from_bytes(data[1:], "big") - (1 << (bits - 1))
    if kind.startswith("FLOAT"):
        size = int(kind[5:]) // 8
        raw, top = int.from_bytes(data[1:], "big"), 1 << (8 * size - 1)
        raw = raw ^ top if raw & top else raw ^ (2 * top - 1)
        return struct.unpack(">f" if size == 4 else ">d", raw.to_bytes(size, "big"))[0]
    if kind == "NUMERIC":
        if data == b"\x15":
            return Decimal(0)
        body = data[1:] if data[0] == 0x20 else bytes(x ^ 0xFF for x in data[1:])
        digits = tuple(b - 1 for b in body[4:-1])
        return Decimal((0 if data[0] == 0x20 else 1, digits, int.from_bytes(body[:4], "big") - 2**31 - len(digits)))
    raw = data[1:-2].replace(b"\0\xff", b"\0")
    return raw.decode() if kind == "STRING" else raw


def encode_struct(values: list, kinds: list[str]) -> bytes:
    """Fields one after another; nulls at the end are left out, so that fields can be added later."""
    while values and values[-1] is None:
        values = values[:-1]
    return b"".join(encode(v, k) for v, k in zip(values, kinds, strict=False))


# ---- byte transforms of the raw types ----
def fixed_length(c: Column, n: int) -> Column:
    """Zero-padded to n characters; longer is an error."""
    return F.when(F.length(c) <= n, F.rpad(c, n, "\0")).otherwise(F.raise_error(F.lit("too long")).cast("string"))


def terminated(c: Column, end: str = "\0") -> Column:
    return F.when(~F.contains(c, F.lit(end)), F.concat(c, F.lit(end))).otherwise(F.raise_error(F.lit("holds its terminator")).cast("string"))
