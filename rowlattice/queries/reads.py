"""Gets and scans of the event cells: ranges, versions, markers, expiry, paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowlattice.model import CELL, Family, nested, to_cells, to_wide, with_region
from rowlattice.operators import mutations
from rowlattice.operators.resolve import compacted, newest_of_each_ts, resolve
from rowlattice.operators.scan import CellTable, Scan
from rowlattice.queries import query
from rowlattice.sources.events import CELLS_SQL, VISIBLE_SQL, event_cells
from rowlattice.sources.orders import orders

OUT = ["row", "family", "qualifier", "ts", "seq", "value"]
COLS = '"row", family, qualifier, ts, seq, value'
DEDUP = VISIBLE_SQL + """, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "row", family, qualifier, ts ORDER BY seq DESC) AS k FROM visible) WHERE k = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "row", family, qualifier ORDER BY ts DESC) AS version FROM one)"""


def table(s, sf, markers=True, **families):
    return CellTable(event_cells(s, sf, markers), {k: Family(k, **v) for k, v in families.items()})


def scan(s, sf, markers=True, **options):
    return table(s, sf, markers).scan(Scan(**options)).select(*OUT)


def ranked_sql(condition: str, versions: int = 1, columns: str = COLS) -> str:
    """Newest versions after a condition on visible cells."""
    return f"""WITH {VISIBLE_SQL}, f AS (SELECT * FROM visible WHERE {condition}),
    r AS (SELECT *, dense_rank() OVER (PARTITION BY "row", family, qualifier ORDER BY ts DESC) AS version, row_number() OVER (PARTITION BY "row", family, qualifier, ts ORDER BY seq DESC) AS k FROM f)
    SELECT {columns} FROM r WHERE k = 1 AND version <= {versions}"""


query("versions_latest", lambda s, sf: scan(s, sf), ranked_sql("true"))
query("versions_n", lambda s, sf: scan(s, sf, max_versions=3), ranked_sql("true", 3))
query("versions_family_cap", lambda s, sf: table(s, sf, a={"max_versions": 2}, b={"max_versions": 5}).scan(Scan(max_versions=3)).select(*OUT), f"WITH {DEDUP} SELECT {COLS} FROM ranked WHERE version <= CASE WHEN family = 'a' THEN 2 ELSE 3 END")
query("get_row", lambda s, sf: table(s, sf).get("000042", max_versions=2).select(*OUT), ranked_sql("\"row\" = '000042'", 2))
query("scan_range", lambda s, sf: scan(s, sf, start="000010", stop="000050"), ranked_sql("\"row\" >= '000010' AND \"row\" < '000050'"))
query("scan_range_inclusive", lambda s, sf: scan(s, sf, start="000010", include_start=False, stop="000050", include_stop=True), ranked_sql("\"row\" > '000010' AND \"row\" <= '000050'"))
query("row_prefix_scan", lambda s, sf: scan(s, sf, prefix="00001"), ranked_sql("starts_with(\"row\", '00001')"))
query("reverse_scan", lambda s, sf: scan(s, sf, start="000050", stop="000010", reversed=True, limit=5), f"WITH {DEDUP}, x AS (SELECT *, dense_rank() OVER (ORDER BY \"row\" DESC) AS dr FROM ranked WHERE version = 1 AND \"row\" <= '000050' AND \"row\" > '000010') SELECT {COLS} FROM x WHERE dr <= 5")
query("scan_limit", lambda s, sf: scan(s, sf, limit=7), f"WITH {DEDUP}, x AS (SELECT *, dense_rank() OVER (ORDER BY \"row\") AS dr FROM ranked WHERE version = 1) SELECT {COLS} FROM x WHERE dr <= 7")
query("family_projection", lambda s, sf: scan(s, sf, families=("a",)), ranked_sql("family = 'a'"))
query("column_projection", lambda s, sf: scan(s, sf, columns=(("a", "view"), ("b", "signup"))), ranked_sql("(family = 'a' AND qualifier = 'view') OR (family = 'b' AND qualifier = 'signup')"))
query("time_range", lambda s, sf: scan(s, sf, time_range=(5, 12), max_versions=2), ranked_sql("ts >= 5 AND ts < 12", 2))
query("exact_timestamp", lambda s, sf: scan(s, sf, time_range=(7, 8)), ranked_sql("ts = 7"))
query("raw_scan", lambda s, sf: table(s, sf).scan(Scan(raw=True, start="000020", stop="000040")).select(*CELL), f"WITH {CELLS_SQL} SELECT {COLS}, type FROM cells WHERE \"row\" >= '000020' AND \"row\" < '000040'")
query("family_limit_offset", lambda s, sf: scan(s, sf, max_versions=3, family_limit=2, family_offset=1), f"WITH {DEDUP}, x AS (SELECT *, row_number() OVER (PARTITION BY \"row\", family ORDER BY qualifier, ts DESC) AS pos FROM ranked WHERE version <= 3) SELECT {COLS} FROM x WHERE pos > 1 AND pos <= 3")
query("scan_batch", lambda s, sf: table(s, sf).scan(Scan(max_versions=4, batch=3)).select(*OUT, "batch"), f"WITH {DEDUP} SELECT {COLS}, CAST((row_number() OVER (PARTITION BY \"row\" ORDER BY family, qualifier, ts DESC) - 1) // 3 AS BIGINT) AS batch FROM ranked WHERE version <= 4")
query("read_point", lambda s, sf: scan(s, sf, read_point=5000), ranked_sql("true").replace("FROM events)", "FROM events WHERE event_id <= 5000)"))


def _keys(s):
    return s.createDataFrame([(0, "000003"), (1, "000999"), (2, "000003"), (3, "000140")], "pos int, row string")


_KEYS = "(VALUES (0, '000003'), (1, '000999'), (2, '000003'), (3, '000140')) k(pos, \"row\")"
query("multi_get", lambda s, sf: table(s, sf).get_all(_keys(s)).drop("cells"), f"WITH {DEDUP} SELECT pos, k.\"row\", count(version) > 0 AS \"exists\", CAST(count(version) AS INTEGER) AS n_cells FROM {_KEYS} LEFT JOIN ranked r ON r.\"row\" = k.\"row\" AND version = 1 GROUP BY ALL")
query("exists_all", lambda s, sf: table(s, sf).get_all(_keys(s)).select("pos", "exists"), f"WITH {DEDUP} SELECT pos, k.\"row\" IN (SELECT \"row\" FROM ranked) AS \"exists\" FROM {_KEYS}")
query("closest_row_before", lambda s, sf: table(s, sf).closest_at_or_before("000077x").select(*OUT), f"WITH {DEDUP} SELECT {COLS} FROM ranked WHERE version = 1 AND \"row\" = (SELECT max(\"row\") FROM ranked WHERE \"row\" <= '000077x')")


# ---- markers, expiry, rewriting ----
def _with_marker(kind):
    """One marker for each user and day 15: on view, or the family of view."""

    def make(s, sf):
        puts = event_cells(s, sf, markers=False)
        users = puts.select("row").distinct().select("row", F.lit("a").alias("family"), F.lit("view").alias("qualifier"), F.lit(15).cast("long").alias("ts"))
        return resolve(puts.unionByName(mutations.delete(users, kind, 10**9)), 3).select(*OUT)

    return make


_HIDDEN = {"version": "family = 'a' AND qualifier = 'view' AND ts = 15", "column": "family = 'a' AND qualifier = 'view' AND ts <= 15", "family": "family = 'a' AND ts <= 15", "family_version": "family = 'a' AND ts = 15"}
for kind, hidden in _HIDDEN.items():
    query(f"delete_{kind}", _with_marker(kind), ranked_sql(f"NOT ({hidden})", 3).replace("WITH " + VISIBLE_SQL, f"WITH {CELLS_SQL}, visible AS (SELECT * FROM cells WHERE type = 0)"))
query("ttl_min_versions", lambda s, sf: table(s, sf, a={"ttl": 5, "min_versions": 2, "max_versions": 4}, b={"ttl": 10, "max_versions": 4}).scan(Scan(max_versions=4, now=25)).select(*OUT), f"WITH {DEDUP} SELECT {COLS} FROM ranked WHERE version <= 4 AND (ts >= CASE WHEN family = 'a' THEN 20 ELSE 15 END OR version <= CASE WHEN family = 'a' THEN 2 ELSE 0 END)")
query("compaction", lambda s, sf: compacted(event_cells(s, sf), {"a": Family("a", 2), "b": Family("b", 1)}).select(*CELL), f"WITH {DEDUP} SELECT {COLS}, type FROM ranked WHERE version <= CASE WHEN family = 'a' THEN 2 ELSE 1 END")
query("same_ts_newest_wins", lambda s, sf: newest_of_each_ts(event_cells(s, sf, False)).select(*OUT), f"WITH {CELLS_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY \"row\", family, qualifier, ts ORDER BY seq DESC) AS k FROM cells WHERE type = 0) SELECT {COLS} FROM x WHERE k = 1")


def _check_and_put(s, sf):
    puts = event_cells(s, sf, False)
    new = puts.select("row").distinct().select("row", F.lit("a").alias("family"), F.lit("flag").alias("qualifier"), F.lit(40).cast("long").alias("ts"), F.lit(1).cast("long").alias("value"))
    return mutations.check_and(puts, F.col("current") > 10000, "a", "view", mutations.put(new, 10**9)).select("row", "qualifier", "value")


_LATEST = f"""{CELLS_SQL}, l AS (SELECT "row", family, qualifier, arg_max(value, (ts, seq)) AS value FROM cells WHERE type = 0 GROUP BY ALL)"""
query("check_and_put", _check_and_put, f"WITH {_LATEST} SELECT \"row\", 'flag' AS qualifier, 1::BIGINT AS value FROM l WHERE family = 'a' AND qualifier = 'view' AND value > 10000")


def _check_and_delete(s, sf):
    """Rows whose newest view is above 10000 lose all their clicks."""
    puts = event_cells(s, sf, False)
    gone = puts.select("row").distinct().select("row", F.lit("a").alias("family"), F.lit("click").alias("qualifier"), F.lit(2**62).cast("long").alias("ts"))
    markers = mutations.check_and(puts, F.col("current") > 10000, "a", "view", mutations.delete(gone, "column", 10**9))
    return resolve(puts.unionByName(markers.withColumn("value", F.lit(None).cast("long")))).select("row", "family", "qualifier", "value")


query("check_and_delete", _check_and_delete, f"""WITH {_LATEST}, hit AS (SELECT "row" FROM l WHERE family = 'a' AND qualifier = 'view' AND value > 10000)
    SELECT "row", family, qualifier, value FROM l WHERE NOT (family = 'a' AND qualifier = 'click' AND "row" IN (SELECT "row" FROM hit))""")


def _mutate_rows(s, sf):
    """One change of each row with a click: a new total and no click any more, at once."""
    puts = event_cells(s, sf, False)
    clicks = puts.filter("family = 'a' AND qualifier = 'click'").groupBy("row").agg(F.sum("value").alias("value"))
    new = clicks.select("row", F.lit("a").alias("family"), F.lit("total").alias("qualifier"), F.lit(2**62).cast("long").alias("ts"), "value")
    changes = mutations.mutate_rows([("put", new), ("column", new.drop("value").withColumn("qualifier", F.lit("click")))], 10**9)
    return resolve(puts.unionByName(changes.withColumn("value", F.col("value").cast("long")))).select("row", "family", "qualifier", "value")


query("mutate_rows", _mutate_rows, f"""WITH {_LATEST} SELECT "row", family, qualifier, value FROM l WHERE NOT (family = 'a' AND qualifier = 'click')
    UNION ALL SELECT "row", 'a', 'total', CAST(sum(value) AS BIGINT) FROM cells WHERE type = 0 AND family = 'a' AND qualifier = 'click' GROUP BY 1""")
query("increments", lambda s, sf: mutations.increments(event_cells(s, sf, False)), f'WITH {CELLS_SQL} SELECT "row", family, qualifier, CAST(sum(value) AS BIGINT) AS value FROM cells WHERE type = 0 GROUP BY ALL')
query("appends", lambda s, sf: mutations.appends(event_cells(s, sf, False), "-"), f"WITH {CELLS_SQL} SELECT \"row\", family, qualifier, string_agg(CAST(value AS VARCHAR), '-' ORDER BY seq) AS value FROM cells WHERE type = 0 GROUP BY ALL")
query("bulk_delete", lambda s, sf: mutations.bulk_delete(event_cells(s, sf, False), (F.col("qualifier") == "click") & (F.col("value") < 1000)).select(*OUT), f"WITH {CELLS_SQL} SELECT {COLS} FROM cells WHERE type = 0 AND NOT (qualifier = 'click' AND value < 1000)")
query("constraint_pass", lambda s, sf: mutations.constrained(event_cells(s, sf, False), F.col("value") >= 0, "negative").select(*OUT), f"WITH {CELLS_SQL} SELECT {COLS} FROM cells WHERE type = 0")

# ---- shapes ----
query("wide_from_cells", lambda s, sf: to_wide(event_cells(s, sf, False), {"click": "bigint", "view": "bigint"}), f"WITH {_LATEST} SELECT \"row\", max(value) FILTER (qualifier = 'click') AS click, max(value) FILTER (qualifier = 'view') AS view FROM l WHERE qualifier IN ('click', 'view') GROUP BY \"row\"")
query("cells_from_wide", lambda s, sf: to_cells(orders(s, sf), "row", "f", ["t", "d", "p", "st"]).select("row", "qualifier", "value"), """SELECT o_orderkey AS "row", x.q AS qualifier, x.v AS value FROM orders, LATERAL (VALUES ('t', CAST(CAST(trunc(o_totalprice * 100) AS INTEGER) AS VARCHAR)), ('d', strftime(o_orderdate, '%Y%m%d')), ('p', substr(o_orderpriority, 1, 1)), ('st', o_orderstatus)) x(q, v)""")
query("nested_rows", lambda s, sf: nested(resolve(event_cells(s, sf), 2)).select("row", F.size("families").alias("n_families"), F.aggregate(F.map_values("families"), F.lit(0), lambda a, m: a + F.size(m)).alias("n_columns")), f"WITH {DEDUP} SELECT \"row\", CAST(count(DISTINCT family) AS INTEGER) AS n_families, CAST(count(DISTINCT family || qualifier) AS INTEGER) AS n_columns FROM ranked WHERE version <= 2 GROUP BY \"row\"")
query("regions", lambda s, sf: with_region(event_cells(s, sf, False), ["000050", "000100"]).groupBy("region").agg(F.countDistinct("row").alias("rows")), f"WITH {CELLS_SQL} SELECT CASE WHEN \"row\" >= '000100' THEN 2 WHEN \"row\" >= '000050' THEN 1 ELSE 0 END AS region, count(DISTINCT \"row\") AS rows FROM cells WHERE type = 0 GROUP BY 1")

# ---- scans from plain data ----
from rowlattice.plans.scanspec import filter_of, scan_of, scan_of_path  # noqa: E402

query("shell_scan", lambda s, sf: table(s, sf).scan(scan_of({"STARTROW": "000020", "STOPROW": "000060", "COLUMNS": ["a", "b:signup"], "VERSIONS": 2, "TIMERANGE": [3, 20], "FILTER": "QualifierFilter(!=, 'binary:click')"})).select(*OUT), ranked_sql("\"row\" >= '000020' AND \"row\" < '000060' AND (family = 'a' OR qualifier = 'signup') AND ts >= 3 AND ts < 20 AND qualifier <> 'click'", 2))
_JSON = '{"type": "FilterList", "op": "MUST_PASS_ONE", "filters": [{"type": "PrefixFilter", "value": "MDAwMDE="}, {"type": "FilterList", "op": "MUST_PASS_ALL", "filters": [{"type": "QualifierFilter", "op": "EQUAL", "comparator": {"type": "BinaryComparator", "value": "dmlldw=="}}, {"type": "TimestampsFilter", "timestamps": [2, 5]}]}]}'
query("json_filter", lambda s, sf: filter_of(_JSON).apply(event_cells(s, sf, False)).select(*OUT), f"WITH {CELLS_SQL} SELECT {COLS} FROM cells WHERE type = 0 AND (starts_with(\"row\", '00001') OR (qualifier = 'view' AND ts IN (2, 5)))")
query("path_scan", lambda s, sf: table(s, sf).scan(scan_of_path("/000020,000060/a,b:signup/3,20?m=2")).select(*OUT), ranked_sql("\"row\" >= '000020' AND \"row\" < '000060' AND (family = 'a' OR (family = 'b' AND qualifier = 'signup')) AND ts >= 3 AND ts < 20", 2))


def _process_rows(s, sf):
    """Rows with more clicks than views get their difference, and lose their views."""
    puts = event_cells(s, sf, False)

    def make(now):
        per = now.filter("family = 'a'").groupBy("row").agg(F.sum(F.when(F.col("qualifier") == "click", F.col("value"))).alias("c"), F.sum(F.when(F.col("qualifier") == "view", F.col("value"))).alias("v")).filter("c > v")
        new = per.select("row", F.lit("a").alias("family"), F.lit("more").alias("qualifier"), F.lit(2**62).cast("long").alias("ts"), (F.col("c") - F.col("v")).alias("value"))
        return [("put", new), ("column", new.drop("value").withColumn("qualifier", F.lit("view")))]

    changes = mutations.process_rows(puts, puts.select("row"), make, 10**9)
    return resolve(puts.unionByName(changes.withColumn("value", F.col("value").cast("long")))).select("row", "family", "qualifier", "value")


query("process_rows", _process_rows, f"""WITH {_LATEST}, x AS (SELECT "row", max(value) FILTER (qualifier = 'click') - max(value) FILTER (qualifier = 'view') AS more FROM l WHERE family = 'a' GROUP BY 1 HAVING more > 0)
    SELECT "row", family, qualifier, value FROM l WHERE NOT (family = 'a' AND qualifier = 'view' AND "row" IN (SELECT "row" FROM x)) UNION ALL SELECT "row", 'a', 'more', more FROM x""")


def _loaded(s, sf):
    """A bulk load, a snapshot of it, and both read as one input."""
    from rowlattice.sources.places import shared_place
    from rowlattice.sources.tables import bulk_load, snapshot

    place = shared_place(s, "bulk")
    bulk_load(event_cells(s, sf), place, 4)
    copy = snapshot(s, place, "one")
    both = s.read.parquet(place).unionByName(s.read.parquet(copy))
    return both.groupBy("row", "family").agg(F.count("*").alias("cells"), F.min("ts").alias("first"))


query("bulk_load_snapshot", _loaded, f'WITH {CELLS_SQL} SELECT "row", family, 2 * count(*) AS cells, min(ts) AS first FROM cells GROUP BY ALL')
