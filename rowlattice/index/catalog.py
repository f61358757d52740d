"""Materialised indexes: Parquet tables sorted by their keys, with a JSON relation beside them.

Files hold about FILE_BYTES each, however large the base is. Rows that come
later are appended to every index as further sorted files; changed and deleted
rows rewrite the indexes, as files are immutable.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlattice.functions.zorder import zip_bits
from rowlattice.index.secondary import Covering, Indexed

FILE_BYTES = 256 << 20


def planned_bytes(df: DataFrame) -> int:
    """What the optimizer takes the size of df to be: that of the files, for a plain scan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


class IndexCatalog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _write(self, df: DataFrame, name: str, keys: list[str], files: int, mode: str = "overwrite") -> None:
        df.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.mode(mode).option("parquet.block.size", 16 << 20).parquet(f"{self.path}/{name}")

    def _tables(self, base: DataFrame, r: dict) -> dict[str, tuple[DataFrame, list[str]]]:
        """Each index of a relation: its rows of base, and the keys that sort it."""
        row, region, kinds = r["row"], r["region"], r["kinds"]
        out = {}
        for c in r["indexed"]:
            filled = base.filter(F.col(c).isNotNull())
            if "gs" in kinds:
                out[f"gs_{c}"] = filled.select(c, F.col(row).alias("row")), [c, "row"]
            if "gc" in kinds:
                out[f"gc_{c}"] = filled, [c, row]
            if "lc" in kinds and region:
                out[f"lc_{c}"] = filled, [region, c, row]
            if "ir" in kinds and region:
                out[f"ir_{c}"] = filled.select(region, c, row), [region, c, row]
        if "cct" in kinds:
            out["cct"] = base.select(F.col(row).alias("row"), *r["indexed"]), ["row"]
        dims = [c for c in r["indexed"] if c in r["bits"]]
        if dims:
            zipped = base.dropna(subset=dims).withColumn("zkey", zip_bits([F.col(c) for c in dims], max(r["bits"].values())))
            if "md" in kinds:
                out["md"] = zipped, ["zkey"]
            if "lmd" in kinds and region:
                out["lmd"] = zipped, [region, "zkey"]
        for column, *others in r["covering"]:
            covered = base.filter(F.col(column).isNotNull())
            out[f"udg_{column}"] = covered.select(row, column, *others), [column, row]
            if "udl" in kinds and region:
                out[f"udl_{column}"] = covered.select(*dict.fromkeys([region, row, column, *others])), [region, column, row]
        return out

    def create(self, base: DataFrame, row: str, indexed: list[str], kinds: tuple[str, ...] = ("gs", "gc", "lc", "md", "cct"), covering: tuple[Covering, ...] = (), bits: dict[str, int] | None = None, region: str | None = None, files: int | None = None) -> dict:
        """Build the named kinds of index (gs, gc, cct, md; with region also ir, lc, lmd, udl); the base is read once for each. files: for each index, else by size. Returns the relation."""
        relation = {"row": row, "indexed": indexed, "bits": bits or {}, "kinds": list(kinds), "covering": [[i.column, *i.others] for i in covering], "region": region}
        files = files or max(1, -(-planned_bytes(base) // FILE_BYTES))
        for name, (rows, keys) in self._tables(base, relation).items():
            self._write(rows, name, keys, files)
        self.spark.createDataFrame([(json.dumps(relation),)], "relation string").coalesce(1).write.mode("overwrite").text(f"{self.path}/_relation")
        return relation

    def append(self, rows: DataFrame, files: int | None = None) -> None:
        """Enter new rows of the base, whose keys it doesn't have yet, into every index."""
        files = files or max(1, -(-planned_bytes(rows) // FILE_BYTES))
        for name, (entries, keys) in self._tables(rows, self.relation()).items():
            self._write(entries, name, keys, files, "append")

    def relation(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/_relation").first()[0])

    def open(self, base: DataFrame) -> Indexed:
        """base with its indexes; one that the relation names and that isn't there is an error."""
        r = self.relation()
        return Indexed(base, r["row"], r["indexed"], {n: self.spark.read.parquet(f"{self.path}/{n}") for n in self._tables(base, r)}, r["bits"])

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def same_relation(a: dict, b: dict) -> bool:
    return all(a.get(k) == b.get(k) for k in ("row", "indexed", "covering", "bits"))
