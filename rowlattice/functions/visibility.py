"""Cell visibility: expressions over labels with &, |, ! and parentheses."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*([&|!()]|\"(?:[^\"\\]|\\.)*\"|[A-Za-z0-9_.:/-]+)")


def parse(text: str):
    """Nested tuples ('&', a, b), ('|', a, b), ('!', a), or a label; & binds closer than |."""
    parts, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not a visibility expression: {text!r}")
        parts.append(m[1])
        at = m.end()
    parts.append("")
    i = 0

    def either():
        nonlocal i
        out = both()
        while parts[i] == "|":
            i += 1
            out = ("|", out, both())
        return out

    def both():
        nonlocal i
        out = one()
        while parts[i] == "&":
            i += 1
            out = ("&", out, one())
        return out

    def one():
        nonlocal i
        token = parts[i]
        i += 1
        if token == "!":
            return ("!", one())
        if token == "(":
            out = either()
            if parts[i] != ")":
                raise ValueError(f"missing parenthesis in {text!r}")
            i += 1
            return out
        if not token or token in "&|)":
            raise ValueError(f"not a visibility expression: {text!r}")
        return token.strip('"')

    out = either()
    if parts[i] != "":
        raise ValueError(f"unexpected {parts[i]!r} in {text!r}")
    return out


def allows(expression: str, labels: Column) -> Column:
    """Whether an array column of labels satisfies a given expression."""

    def made(e):
        if isinstance(e, str):
            return F.array_contains(labels, e)
        if e[0] == "!":
            return ~made(e[1])
        a, b = made(e[1]), made(e[2])
        return a & b if e[0] == "&" else a | b

    return made(parse(expression))


def visible(expression: Column, labels: list[str]) -> Column:
    """Whether given labels satisfy the expression of each row; null and empty are visible to all.

    Labels become T or F; then the innermost parentheses, !, & and | are
    reduced by replacement, as many times as an expression of 16 nested levels
    needs. All in the JVM.
    """
    known = "|".join(re.escape(x) for x in labels) or "(?!)"
    e = F.regexp_replace(F.regexp_replace(expression, r"[\s\"]+", ""), rf"(?<![A-Za-z0-9_.:/-])(?:{known})(?![A-Za-z0-9_.:/-])", "\u0001")
    e = F.regexp_replace(F.regexp_replace(e, r"[A-Za-z0-9_.:/-]+", "\u0002"), "\u0001", "T")
    e = F.replace(e, F.lit("\u0002"), F.lit("F"))

    def reduced(x: Column) -> Column:
        for a, b in ((r"!T", "f"), (r"!F", "T"), (r"f", "F"), (r"\(([TF])\)", "$1")):
            x = F.regexp_replace(x, a, b)
        for a, b in ((r"T&T", "T"), (r"F&[TF]|T&F", "F")):
            x = F.regexp_replace(x, a, b)
        # | only where no & or ! waits beside it
        for a, b in ((r"(?<![&!TF])T\|[TF](?!&)|(?<![&!TF])F\|T(?!&)", "T"), (r"(?<![&!TF])F\|F(?!&)", "F")):
            x = F.regexp_replace(x, a, b)
        return x

    steps = F.aggregate(F.sequence(F.lit(1), F.lit(24)), e, lambda acc, _: reduced(acc))
    return F.when(F.coalesce(expression, F.lit("")) == "", F.lit(True)).otherwise(steps == "T")
