"""Aggregates: by region and in total, over cells, histograms, and relational ones over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowlattice.operators import aggregates as a
from rowlattice.queries import query
from rowlattice.sources.events import PUTS_SQL, event_cells

LINES_SQL = "l AS (SELECT l_orderkey // 10000 AS region, CAST(l_quantity AS BIGINT) AS q FROM lineitem)"


def lines(s, sf):
    return s.read.parquet(f"{sf}/lineitem.parquet").select(F.floor(F.col("l_orderkey") / 10000).alias("region"), F.col("l_quantity").cast("long").alias("q"))


query("agg_region_partials", lambda s, sf: a.by_region(lines(s, sf), "q").drop("deviation").withColumn("squares", F.col("squares").cast("long")), f"WITH {LINES_SQL} SELECT region, max(q) AS max, min(q) AS min, CAST(sum(q) AS BIGINT) AS sum, count(*) AS rows, CAST(sum(q * q) AS BIGINT) AS squares FROM l GROUP BY region")
query("agg_region_total", lambda s, sf: a.total(a.by_region(lines(s, sf), "q")).withColumns({"avg": F.round("avg", 6), "std": F.round("std", 6)}), f"WITH {LINES_SQL} SELECT max(q) AS max, min(q) AS min, CAST(sum(q) AS BIGINT) AS sum, CAST(count(*) AS BIGINT) AS rows, round(avg(q), 6) AS avg, round(stddev_pop(q), 6) AS std FROM l")
for name, expression in {"max": "max(q)", "min": "min(q)", "sum": "CAST(sum(q) AS BIGINT)", "rowcount": "count(*)"}.items():
    column = {"rowcount": "rows"}.get(name, name)
    query(f"agg_{name}", lambda s, sf, column=column: a.total(a.by_region(lines(s, sf), "q")).select(column), f"WITH {LINES_SQL} SELECT {expression} AS {column} FROM l")
query("agg_avg", lambda s, sf: a.total(a.by_region(lines(s, sf), "q")).select(F.round("avg", 6).alias("avg")), f"WITH {LINES_SQL} SELECT round(avg(q), 6) AS avg FROM l")
query("agg_std", lambda s, sf: a.total(a.by_region(lines(s, sf), "q")).select(F.round("std", 6).alias("std")), f"WITH {LINES_SQL} SELECT round(stddev_pop(q), 6) AS std FROM l")
query("agg_cells_column", lambda s, sf: a.cell_aggregates(event_cells(s, sf, False).filter("qualifier = 'view'"), F.col("value")).withColumns({"avg": F.round("avg", 6), "std": F.round("std", 6)}), f"WITH {PUTS_SQL} SELECT max(value) AS max, min(value) AS min, CAST(sum(value) AS BIGINT) AS sum, count(DISTINCT \"row\") AS rows, round(sum(value) / CAST(count(DISTINCT \"row\") AS DOUBLE), 6) AS avg, round(stddev_pop(value), 6) AS std FROM cells WHERE qualifier = 'view'")
query("agg_cells_family", lambda s, sf: a.cell_aggregates(event_cells(s, sf, False).filter("family = 'a'"), F.col("value")).withColumns({"avg": F.round("avg", 6), "std": F.round("std", 6)}), f"WITH {PUTS_SQL} SELECT max(value) AS max, min(value) AS min, CAST(sum(value) AS BIGINT) AS sum, count(DISTINCT \"row\") AS rows, round(sum(value) / CAST(count(DISTINCT \"row\") AS DOUBLE), 6) AS avg, round(stddev_pop(value), 6) AS std FROM cells WHERE family = 'a'")
query("agg_empty", lambda s, sf: a.cell_aggregates(event_cells(s, sf, False).filter("family = 'z'"), F.col("value")).select("max", "sum", "rows", F.isnan("avg").alias("avg_nan"), F.isnan("std").alias("std_nan")), f"WITH {PUTS_SQL} SELECT max(value) AS max, CAST(sum(value) AS BIGINT) AS sum, count(DISTINCT \"row\") AS rows, true AS avg_nan, true AS std_nan FROM cells WHERE family = 'z'")
query("agg_median_weighted", lambda s, sf: a.weighted_median(s.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.floor("o_totalprice").cast("long").alias("v")), "k", "v"), "WITH o AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders), r AS (SELECT *, sum(v) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM o) SELECT arg_max(v, k) AS median FROM r WHERE run <= (SELECT sum(v) / 2.0 FROM o)")
query("agg_median_by_weight", lambda s, sf: a.weighted_median(s.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.floor("o_totalprice").cast("long").alias("v"), F.col("o_custkey").alias("w")), "k", "v", "w"), "WITH o AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS v, o_custkey AS w FROM orders), r AS (SELECT *, sum(w) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM o) SELECT arg_max(v, k) AS median FROM r WHERE run <= (SELECT sum(w) / 2.0 FROM o)")
query("agg_custom", lambda s, sf: a.custom_aggregate(lines(s, sf), "q", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("odd")), lambda x, v: F.struct((x["n"] + 1).alias("n"), F.when(v % 2 == 1, x["odd"] + v).otherwise(x["odd"]).alias("odd")), lambda x, y: F.struct((x["n"] + y["n"]).alias("n"), (x["odd"] + y["odd"]).alias("odd")), lambda x: x).select("result.n", "result.odd"), f"WITH {LINES_SQL} SELECT count(*) AS n, CAST(sum(q) FILTER (q % 2 = 1) AS BIGINT) AS odd FROM l")
query("agg_percentile", lambda s, sf: lines(s, sf).groupBy("region").agg(F.percentile("q", 0.5).alias("median")), f"WITH {LINES_SQL} SELECT region, quantile_cont(q, 0.5) AS median FROM l GROUP BY region")
query("row_counter", lambda s, sf: a.row_count(event_cells(s, sf, False)), f'WITH {PUTS_SQL} SELECT count(DISTINCT "row") AS rows FROM cells')
query("cell_counter", lambda s, sf: a.cell_counts(event_cells(s, sf, False)), f'WITH {PUTS_SQL}, p AS (SELECT "row", family, qualifier, count(*) AS v FROM cells GROUP BY ALL) SELECT family, qualifier, CAST(sum(v) AS BIGINT) AS cells, count(*) AS rows, max(v) AS most_versions FROM p GROUP BY ALL')


def _coarse(s, sf):
    return a.group_by_values(event_cells(s, sf, False).withColumn("value", F.floor(F.col("value") / 5000)), ["view", "click"])


query("group_values", _coarse, f"WITH {PUTS_SQL}, n AS (SELECT \"row\", qualifier, arg_max(CAST(floor(value / 5000.0) AS BIGINT), (ts, seq)) AS v FROM cells WHERE qualifier IN ('view', 'click') GROUP BY ALL), g AS (SELECT \"row\", max(v) FILTER (qualifier = 'click') AS c, max(v) FILTER (qualifier = 'view') AS w FROM n GROUP BY 1) SELECT c || ' ' || w AS key, count(*) AS rows FROM g WHERE c IS NOT NULL AND w IS NOT NULL GROUP BY 1")
query("workload_bounds", lambda s, sf: s.read.parquet(f"{sf}/orders.parquet").agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.min("o_custkey").alias("ck_low"), F.max("o_custkey").alias("ck_high")), "SELECT min(o_totalprice) AS low, max(o_totalprice) AS high, min(o_custkey) AS ck_low, max(o_custkey) AS ck_high FROM orders")


# ---- what Spark adds: joins, grouping sets, windows, approximate counts ----
def _read(s, sf, *names):
    return [s.read.parquet(f"{sf}/{n}.parquet") for n in names]


def _join(how, sql_how):
    """All orders and all lines by whole prices; each side has prices of its own."""

    def make(s, sf):
        o, l = _read(s, sf, "orders", "lineitem")
        o = o.groupBy(F.floor("o_totalprice").cast("long").alias("k")).agg(F.count("*").alias("n"))
        l = l.groupBy(F.floor("l_extendedprice").cast("long").alias("pk")).agg(F.count("*").alias("lines"))
        out = o.join(l, o.k == l.pk, how)
        return out.select("k", "n") if how in ("left_semi", "left_anti") else out

    sql = "WITH o AS (SELECT CAST(floor(o_totalprice) AS BIGINT) AS k, count(*) AS n FROM orders GROUP BY 1), l AS (SELECT CAST(floor(l_extendedprice) AS BIGINT) AS pk, count(*) AS lines FROM lineitem GROUP BY 1) "
    sql += {"left_semi": "SELECT k, n FROM o WHERE k IN (SELECT pk FROM l)", "left_anti": "SELECT k, n FROM o WHERE k NOT IN (SELECT pk FROM l)"}.get(how, f"SELECT k, n, pk, lines FROM o {sql_how} JOIN l ON o.k = l.pk")
    query(f"join_{how}", make, sql)


for how, sql_how in (("inner", ""), ("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL"), ("left_semi", ""), ("left_anti", "")):
    _join(how, sql_how)
query("agg_cube", lambda s, sf: _read(s, sf, "lineitem")[0].cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")), "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
query("agg_rollup", lambda s, sf: _read(s, sf, "part")[0].rollup("p_brand", "p_type").agg(F.count("*").alias("n"), F.max("p_size").alias("top")), "SELECT p_brand, p_type, count(*) AS n, max(p_size) AS top FROM part GROUP BY ROLLUP (p_brand, p_type)")
query("agg_having", lambda s, sf: _read(s, sf, "orders")[0].groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 12"), "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
query("agg_approximate", lambda s, sf: _read(s, sf, "lineitem")[0].groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.01).alias("a"), F.countDistinct("l_partkey").alias("parts")).select("l_returnflag", "parts", (F.abs(F.col("a") - F.col("parts")) <= F.col("parts") * 0.05).alias("near")), "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS near FROM lineitem GROUP BY 1")
query("join_star", lambda s, sf: (lambda l, o, c, n: l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity")))(*_read(s, sf, "lineitem", "orders", "customer", "nation")), "SELECT n_name, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
