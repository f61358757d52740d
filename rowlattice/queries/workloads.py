"""Workload generators and latency statistics, on numbers that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowlattice.plans.tabledsl import generate, parse
from rowlattice.queries import query
from rowlattice.workloads import generators as g
from rowlattice.workloads.latency import PIVOTS, cdf, summary

N = 20000
_IDS = f"SELECT i FROM range({N}) r(i)"
query("gen_uniform", lambda s, sf: s.range(N).select(g.uniform(F.col("id"), 100, 3).alias("k")).groupBy("k").agg(F.count("*").alias("n")), f"SELECT CAST(floor({g.unit_sql('i', 3)} * 100) AS BIGINT) AS k, count(*) AS n FROM ({_IDS}) GROUP BY 1")
query("zipf_keys", lambda s, sf: s.range(N).select(g.zipfian(F.col("id"), 1000, seed=5).alias("k")).groupBy("k").agg(F.count("*").alias("n")), f"SELECT {g.zipfian_sql('i', 1000, seed=5)} AS k, count(*) AS n FROM ({_IDS}) GROUP BY 1")
query("gen_latest", lambda s, sf: s.range(N).select(g.latest(F.col("id"), 1000, seed=5).alias("k")).groupBy("k").agg(F.count("*").alias("n")), f"SELECT 999 - {g.zipfian_sql('i', 1000, seed=5)} AS k, count(*) AS n FROM ({_IDS}) GROUP BY 1")
query("gen_hotspot", lambda s, sf: s.range(N).select(g.hotspot(F.col("id"), 1000, seed=8).alias("k")).agg(F.avg((F.col("k") < 200).cast("int")).alias("share")).select(F.col("share").between(0.77, 0.83).alias("ok")), "SELECT true AS ok")
query("op_mix", lambda s, sf: g.operations(s, N).groupBy("kind").agg(F.count("*").alias("n")), f"SELECT CASE WHEN u < 0.1 THEN 'write' WHEN u < 0.9 THEN 'read' ELSE 'scan' END AS kind, count(*) AS n FROM (SELECT {g.unit_sql('i', 3)} AS u FROM ({_IDS})) GROUP BY 1")
query("op_mix_core", lambda s, sf: g.core_operations(s, 5000).groupBy("kind").agg(F.count("*").alias("n"), F.count("fields").alias("with_fields")), f"SELECT CASE WHEN u < 0.95 THEN 'read' ELSE 'update' END AS kind, count(*) AS n, count(*) FILTER (u >= 0.95) AS with_fields FROM (SELECT {g.unit_sql('i', 11)} AS u FROM range(5000) r(i)) GROUP BY 1")
query("uniform_workload", lambda s, sf: g.uniform_table(s, N).filter("a < 1000 AND b BETWEEN 2000 AND 5000").select("row", "a", "b"), f"SELECT i AS \"row\", CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b FROM (SELECT i, floor({g.unit_sql('i', 0)} * 10000) AS a, floor({g.unit_sql('i', 1)} * 10000) AS b FROM ({_IDS})) WHERE a < 1000 AND b BETWEEN 2000 AND 5000")
query("skewed_workload", lambda s, sf: g.skewed_table(s, N).groupBy("a").agg(F.count("*").alias("n")), f"SELECT CAST({g.zipfian_sql('i', 10000, seed=1)} AS INTEGER) AS a, count(*) AS n FROM ({_IDS}) GROUP BY 1")


def _latencies(s, sf):
    return s.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("kind"), (F.col("value") / 40).alias("seconds"))


_PIVOT = "CASE " + " ".join(f"WHEN seconds >= {p} THEN {float(p)}::DOUBLE" for p in PIVOTS[:-1]) + " ELSE 0.0::DOUBLE END"
_LIST = ", ".join(f"({float(p)}::DOUBLE)" for p in PIVOTS)
query("latency_cdf", lambda s, sf: cdf(_latencies(s, sf), "seconds"), f"WITH l AS (SELECT value / 40 AS seconds FROM events), c AS (SELECT {_PIVOT} AS box, count(*) AS n FROM l GROUP BY 1), f AS (SELECT p.box, coalesce(c.n, 0) AS n FROM (VALUES {_LIST}) p(box) LEFT JOIN c ON c.box = p.box) SELECT box AS \"pivot\", n, CAST(sum(n) OVER (ORDER BY box) AS BIGINT) AS cumulative FROM f")
query("latency_summary", lambda s, sf: summary(_latencies(s, sf), "kind", "seconds").withColumns({"mean": F.round("mean", 8), "max": F.round("max", 8)}), "SELECT event_type AS kind, count(*) AS n, round(avg(value / 40), 8) AS mean, round(max(value / 40), 8) AS max FROM events GROUP BY 1")
_DSL = "column f a INT 0 100\ncolumn f s STRING set x y z\nindex-column f a\nuser-defined-index f a f s\nscan-range f a INT >= 10 < 20"


def _described(s, sf):
    from rowlattice.operators.predicates import conjunction

    d = parse(_DSL)
    return generate(s, d, 10000).filter(conjunction(d.scan)).agg(F.min("a").alias("low"), F.max("a").alias("high"), F.countDistinct("s").alias("kinds"))


query("table_description", _described, "SELECT 10 AS low, 19 AS high, 3::BIGINT AS kinds")
