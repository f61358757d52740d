"""A text description of tables: columns with generators, indexes, and range scans."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlattice.index.secondary import Covering
from rowlattice.operators.predicates import OPS, TYPES, ColumnRange

SPARK_TYPES = {"SHORT": "smallint", "INT": "int", "LONG": "bigint", "DOUBLE": "double", "STRING": "string", "BOOLEAN": "boolean"}


@dataclass
class Description:
    columns: dict[str, tuple[str, str, list[str]]] = field(default_factory=dict)  # name -> type, generator, arguments
    indexed: list[str] = field(default_factory=list)
    covering: list[Covering] = field(default_factory=list)
    scan: list[ColumnRange] = field(default_factory=list)


def parse(text: str) -> Description:
    """`column f q TYPE min max | set v .. | random n`, `index-column f q ..`, `user-defined-index f q [f q ..]`, `scan-range f q TYPE op v [op v]`."""
    out = Description()
    for line in text.splitlines():
        w = line.split("#")[0].split()
        if not w:
            continue
        kind, rest = w[0], w[1:]
        if kind == "column" and len(rest) >= 5 and rest[2] in TYPES:
            name, t, args = rest[1], rest[2], rest[3:]
            out.columns[name] = (t, args[0], args[1:]) if args[0] in ("set", "random") else (t, "range", args)
        elif kind == "index-column" and len(rest) >= 2:
            out.indexed += rest[1::2]
        elif kind == "user-defined-index" and len(rest) >= 2 and not len(rest) % 2:
            out.covering.append(Covering(rest[1], tuple(rest[3::2])))
        elif kind == "scan-range" and len(rest) in (5, 7) and rest[2] in TYPES and all(o in OPS for o in rest[3::2]):
            made = [(rest[i], TYPES[rest[2]](rest[i + 1])) for i in range(3, len(rest), 2)]
            out.scan.append(ColumnRange(rest[1], *made[0], *(made[1] if len(made) > 1 else (None, None)), family=rest[0], type=rest[2]))
        else:
            raise ValueError(f"not a description: {line!r}")
    return out


def _random(seed: int, key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(n))


def generate(spark: SparkSession, d: Description, rows: int) -> DataFrame:
    """row and the described columns; values follow from hashes of the row, so any task can be repeated."""
    df = spark.range(rows).withColumnRenamed("id", "row")
    for i, (name, (t, kind, args)) in enumerate(d.columns.items()):
        if kind == "set":
            c = F.element_at(F.array(*[F.lit(a) for a in args]), (_random(i, F.col("row"), len(args)) + 1).cast("int")).cast(SPARK_TYPES[t])
        elif kind == "random":
            c = F.substring(F.sha2(F.concat_ws("-", F.lit(str(i)), F.col("row").cast("string")), 256), 1, int(args[0]))
        else:
            low, high = float(args[0]), float(args[1])
            c = (F.lit(low) + _random(i, F.col("row"), 1 << 30) / float(1 << 30) * (high - low)).cast(SPARK_TYPES[t])
        df = df.withColumn(name, c)
    return df
