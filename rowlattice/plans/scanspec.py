"""Scans and filters from plain data: option tables as a shell takes them, and filter trees as JSON."""

from __future__ import annotations

import base64
import json
from typing import Any
from urllib.parse import unquote

from rowlattice.operators import filters as f
from rowlattice.operators import predicates as p
from rowlattice.operators.scan import Scan
from rowlattice.plans.filterlang import parse

OPTIONS = {"FILTER", "STARTROW", "STOPROW", "ROWPREFIXFILTER", "COLUMN", "COLUMNS", "VERSIONS", "TIMERANGE", "TIMESTAMP", "RAW", "REVERSED", "LIMIT", "BATCH", "MAX_RESULTS_PER_COLUMN_FAMILY"}


def scan_of(options: dict[str, Any]) -> Scan:
    """A scan of options; columns are `family` or `family:qualifier`."""
    unknown = set(options) - OPTIONS
    if unknown:
        raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
    names = options.get("COLUMNS", options.get("COLUMN", []))
    names = [names] if isinstance(names, str) else names
    stamp = options.get("TIMESTAMP")
    text = options.get("FILTER")
    return Scan(
        start=options.get("STARTROW"),
        stop=options.get("STOPROW"),
        prefix=options.get("ROWPREFIXFILTER"),
        reversed=bool(options.get("REVERSED", False)),
        families=tuple(n for n in names if ":" not in n),
        columns=tuple(tuple(n.split(":", 1)) for n in names if ":" in n),
        time_range=tuple(options["TIMERANGE"]) if "TIMERANGE" in options else (stamp, stamp + 1) if stamp is not None else None,
        max_versions=int(options.get("VERSIONS", 1)),
        filter=parse(text) if isinstance(text, str) else text,
        raw=bool(options.get("RAW", False)),
        limit=options.get("LIMIT"),
        batch=options.get("BATCH"),
        family_limit=options.get("MAX_RESULTS_PER_COLUMN_FAMILY"),
    )


def scan_of_path(path: str) -> Scan:
    """A scan of a path: /row, /start,end or /prefix*, then /column,column (family or family:qualifier), then /end or /start,end of timestamps, then ?m=versions&n=cells of a row."""
    path, _, query = path.lstrip("/").partition("?")
    parts = [p for p in path.split("/")]
    if not parts[0] or len(parts) > 3:
        raise ValueError("a row, columns and timestamps are asked for")
    start, comma, stop = (unquote(x) for x in parts[0].partition(","))
    if start.endswith("*") and comma:
        raise ValueError("a row range has no wildcard")
    names = [unquote(n) for n in parts[1].split(",") if n] if len(parts) > 1 else []
    stamps = [int(x) for x in parts[2].split(",")] if len(parts) > 2 and parts[2] else []
    options = dict(pair.split("=", 1) for pair in query.split("&")) if query else {}
    if len(stamps) > 2 or set(options) - {"m", "n"}:
        raise ValueError("timestamps are one or two, parameters m or n")
    if start.endswith("*"):
        rows = {"prefix": start[:-1]}
    elif comma:
        rows = {"start": start, "stop": stop or None}
    else:
        rows = {"start": start, "stop": start, "include_stop": True}
    return Scan(
        **rows,
        families=tuple(n for n in names if ":" not in n),
        columns=tuple(tuple(n.split(":", 1)) for n in names if ":" in n),
        time_range=(0, stamps[0]) if len(stamps) == 1 else tuple(stamps) or None,
        max_versions=int(options.get("m", 1)),
        filter=f.ColumnCountGetFilter(int(options["n"])) if "n" in options else None,
    )


def _text(value: str) -> str:
    return base64.b64decode(value).decode()


def _comparator(tree: dict) -> Any:
    match tree["type"]:
        case "BinaryComparator":
            return p.Binary(_text(tree["value"]))
        case "BinaryPrefixComparator":
            return p.BinaryPrefix(_text(tree["value"]))
        case "RegexStringComparator":
            return p.Regex(tree["value"])
        case "SubstringComparator":
            return p.Substring(tree["value"])
        case "NullComparator":
            return p.Null()
        case "BitComparator":
            return p.Bits(int.from_bytes(base64.b64decode(tree["value"]), "big"), tree["op"])
        case "LongComparator":
            return p.SignedLong(int(tree["value"]))
    raise ValueError(f"unknown comparator {tree['type']}")


def filter_of(tree: str | dict) -> f.Filter:
    """A filter of a JSON tree; binary values are base64."""
    t = json.loads(tree) if isinstance(tree, str) else tree
    compared = {"RowFilter": f.RowFilter, "FamilyFilter": f.FamilyFilter, "QualifierFilter": f.QualifierFilter, "ValueFilter": f.ValueFilter}
    kind = t["type"]
    if kind in compared:
        return compared[kind](t["op"], _comparator(t["comparator"]))
    match kind:
        case "FilterList":
            return f.FilterList({"MUST_PASS_ALL": "ALL", "MUST_PASS_ONE": "ONE"}[t["op"]], [filter_of(x) for x in t["filters"]])
        case "SkipFilter":
            return f.SkipFilter(filter_of(t["filters"][0]))
        case "WhileMatchFilter":
            return f.WhileMatchFilter(filter_of(t["filters"][0]))
        case "PrefixFilter":
            return f.PrefixFilter(_text(t["value"]))
        case "ColumnPrefixFilter":
            return f.ColumnPrefixFilter(_text(t["value"]))
        case "MultipleColumnPrefixFilter":
            return f.MultipleColumnPrefixFilter([_text(x) for x in t["prefixes"]])
        case "ColumnRangeFilter":
            return f.ColumnRangeFilter(_text(t["minColumn"]) if t.get("minColumn") else None, t.get("minColumnInclusive", True), _text(t["maxColumn"]) if t.get("maxColumn") else None, t.get("maxColumnInclusive", False))
        case "ColumnCountGetFilter":
            return f.ColumnCountGetFilter(int(t["limit"]))
        case "ColumnPaginationFilter":
            return f.ColumnPaginationFilter(int(t["limit"]), int(t["offset"]))
        case "PageFilter":
            return f.PageFilter(int(t["value"]))
        case "FirstKeyOnlyFilter":
            return f.FirstKeyOnlyFilter()
        case "KeyOnlyFilter":
            return f.KeyOnlyFilter()
        case "InclusiveStopFilter":
            return f.InclusiveStopFilter(_text(t["value"]))
        case "RandomRowFilter":
            return f.RandomRowFilter(float(t["chance"]))
        case "TimestampsFilter":
            return f.TimestampsFilter(t["timestamps"])
        case "SingleColumnValueFilter" | "SingleColumnValueExcludeFilter":
            made = f.SingleColumnValueFilter if kind == "SingleColumnValueFilter" else f.SingleColumnValueExcludeFilter
            return made(_text(t["family"]), _text(t["qualifier"]), t["op"], _comparator(t["comparator"]), t.get("ifMissing", False), t.get("latestVersion", True))
        case "DependentColumnFilter":
            c = t.get("comparator")
            return f.DependentColumnFilter(_text(t["family"]), _text(t["qualifier"]), t.get("dropDependentColumn", False), t.get("op") if c else None, _comparator(c) if c else None)
    raise ValueError(f"unknown filter {kind}")
