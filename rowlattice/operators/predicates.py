"""Comparison operators, value comparators and conjunctive column ranges, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens of comparison operators; NO_OP accepts nothing.
OPS = {"<": "LESS", "<=": "LESS_OR_EQUAL", "=": "EQUAL", "==": "EQUAL", "!=": "NOT_EQUAL", ">": "GREATER", ">=": "GREATER_OR_EQUAL"}


def compare(left: Column, op: str, right: Any) -> Column:
    op = OPS.get(op, op)
    right = right if isinstance(right, Column) else F.lit(right)
    match op:
        case "LESS":
            return left < right
        case "LESS_OR_EQUAL":
            return left <= right
        case "EQUAL":
            return left == right
        case "NOT_EQUAL":
            return left != right
        case "GREATER":
            return left > right
        case "GREATER_OR_EQUAL":
            return left >= right
        case "NO_OP":
            return F.lit(False)
    raise ValueError(f"unknown operator {op}")


@dataclass(frozen=True)
class Binary:
    """Bytewise (strings, binary) or typed comparison with a whole value."""

    value: Any

    def test(self, column: Column, op: str) -> Column:
        return compare(column, op, self.value)


@dataclass(frozen=True)
class BinaryPrefix:
    """Compares as many leading characters as the value has."""

    value: Any

    def test(self, column: Column, op: str) -> Column:
        return compare(F.substring(column, 1, len(self.value)), op, self.value)


@dataclass(frozen=True)
class SignedLong:
    """Compares as signed 64-bit numbers."""

    value: int

    def test(self, column: Column, op: str) -> Column:
        return compare(column.cast("long"), op, int(self.value))


@dataclass(frozen=True)
class Null:
    """EQUAL to an absent value."""

    def test(self, column: Column, op: str) -> Column:
        return column.isNull() if OPS.get(op, op) == "EQUAL" else column.isNotNull()


@dataclass(frozen=True)
class Bits:
    """Bitwise AND, OR or XOR with a mask; EQUAL holds if the outcome isn't zero. Longs have equal lengths by type."""

    value: int
    kind: str = "AND"

    def test(self, column: Column, op: str) -> Column:
        word = column.cast("long")
        mask = F.lit(self.value).cast("long")
        out = {"AND": word.bitwiseAND(mask), "OR": word.bitwiseOR(mask), "XOR": word.bitwiseXOR(mask)}[self.kind]
        return out != 0 if OPS.get(op, op) == "EQUAL" else out == 0


@dataclass(frozen=True)
class Regex:
    """Finds a pattern anywhere; EQUAL and NOT_EQUAL only."""

    pattern: str

    def test(self, column: Column, op: str) -> Column:
        if OPS.get(op, op) not in ("EQUAL", "NOT_EQUAL"):
            raise ValueError("a regular expression is equal or not equal")
        found = column.cast("string").rlike(self.pattern)
        return found if OPS.get(op, op) == "EQUAL" else ~found


@dataclass(frozen=True)
class Substring:
    """Contains a text, whatever its case; EQUAL and NOT_EQUAL only."""

    text: str

    def test(self, column: Column, op: str) -> Column:
        if OPS.get(op, op) not in ("EQUAL", "NOT_EQUAL"):
            raise ValueError("a substring is equal or not equal")
        found = F.contains(F.lower(column.cast("string")), F.lit(self.text.lower()))
        return found if OPS.get(op, op) == "EQUAL" else ~found


TYPES = {"SHORT": int, "INT": int, "LONG": int, "DOUBLE": float, "STRING": str, "BOOLEAN": lambda s: s.strip().lower() == "true"}


@dataclass(frozen=True)
class ColumnRange:
    """One conjunct: a column, and one or two comparisons. A missing column passes, unless if_missing says drop."""

    qualifier: str
    low_op: str | None = None
    low: Any = None
    high_op: str | None = None
    high: Any = None
    family: str = "f"
    type: str = "INT"

    @property
    def bounds(self) -> list[tuple[str, Any]]:
        return [(o, v) for o, v in ((self.low_op, self.low), (self.high_op, self.high)) if o is not None]

    def test(self, missing_passes: bool = False) -> Column:
        out = F.lit(True)
        for op, value in self.bounds:
            out = out & compare(F.col(self.qualifier), op, value)
        # null of a missing column filters it out; a wrapper would keep the range from the Parquet scan
        return F.col(self.qualifier).isNull() | out if missing_passes else out

    @property
    def is_range(self) -> bool:
        """Whether an order on the column helps: not for NOT_EQUAL alone."""
        return any(OPS.get(o, o) != "NOT_EQUAL" for o, _ in self.bounds)

    def interval(self) -> tuple[float, float]:
        """Closed hull of a numeric range."""
        low, high = float("-inf"), float("inf")
        for op, v in self.bounds:
            name = OPS.get(op, op)
            if name in ("GREATER", "GREATER_OR_EQUAL", "EQUAL"):
                low = max(low, v)
            if name in ("LESS", "LESS_OR_EQUAL", "EQUAL"):
                high = min(high, v)
        return low, high


def conjunction(ranges: list[ColumnRange], missing_passes: bool = False) -> Column:
    out = F.lit(True)
    for r in ranges:
        out = out & r.test(missing_passes)
    return out


def parse_ranges(text: str) -> list[ColumnRange]:
    """Lines `family qualifier TYPE op value [op value]`, separated by tabs or spaces; # starts a comment."""
    out = []
    for line in text.splitlines():
        parts = line.split("#")[0].split()
        if not parts:
            continue
        if len(parts) not in (5, 7) or parts[2] not in TYPES:
            raise ValueError(f"not a range: {line!r}")
        family, qualifier, kind, *rest = parts
        if any(o not in OPS for o in rest[::2]):
            raise ValueError(f"unknown operator in {line!r}")
        made = [(rest[i], TYPES[kind](rest[i + 1])) for i in range(0, len(rest), 2)]
        out.append(ColumnRange(qualifier, *made[0], *(made[1] if len(made) > 1 else (None, None)), family=family, type=kind))
    return out


def merge_intervals(spans: list[tuple[Any, bool, Any, bool]]) -> list[tuple[Any, bool, Any, bool]]:
    """Sorted, disjoint form of row ranges (start, inclusive, stop, inclusive); None is open."""
    key = lambda s: (s[0] is not None, s[0] if s[0] is not None else "", not s[1])
    out: list[tuple[Any, bool, Any, bool]] = []
    for a, ai, b, bi in sorted(spans, key=key):
        if a is not None and b is not None and (a > b or (a == b and not (ai and bi))):
            continue
        if out:
            pa, pai, pb, pbi = out[-1]
            if pb is None or a is None or a < pb or (a == pb and (ai or pbi)):
                if pb is not None and (b is None or b > pb or (b == pb and bi)):
                    out[-1] = (pa, pai, b, bi)
                continue
        out.append((a, ai, b, bi))
    return out


def in_intervals(column: Column, spans: list[tuple[Any, bool, Any, bool]]) -> Column:
    out = F.lit(False)
    for a, ai, b, bi in merge_intervals(spans):
        low = F.lit(True) if a is None else (column >= F.lit(a) if ai else column > F.lit(a))
        high = F.lit(True) if b is None else (column <= F.lit(b) if bi else column < F.lit(b))
        out = out | (low & high)
    return out


def after_prefix(prefix: str | bytes) -> str | bytes | None:
    """The least key above all keys with the prefix: the last byte plus one, with carry; None if there is none."""
    raw = bytearray(prefix.encode() if isinstance(prefix, str) else prefix)
    while raw and raw[-1] == 0xFF:
        raw.pop()
    if not raw:
        return None
    raw[-1] += 1
    return bytes(raw).decode("utf-8", "surrogateescape") if isinstance(prefix, str) else bytes(raw)
