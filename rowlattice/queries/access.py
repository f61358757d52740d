"""The three-range query over orders by every access path, and what the paths are built of."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from rowlattice.functions.zorder import buckets, box_ranges, unzip, zip_bits
from rowlattice.index import secondary as ix
from rowlattice.index.catalog import IndexCatalog
from rowlattice.operators.aggregates import histogram, value_histogram
from rowlattice.operators.joins import difference, floor_lookup, intersect_keys, minus_keys, overlapping, union_keys
from rowlattice.operators.predicates import ColumnRange, conjunction, parse_ranges
from rowlattice.plans.chooser import Statistics, choose
from rowlattice.plans.indexsql import run_select
from rowlattice.plans.jobs import hash_batches, sync, sync_batches
from rowlattice.queries import query
from rowlattice.sources.orders import BITS, INDEXED, orders, scaled
from rowlattice.sources.places import shared_place

#: Windows that select about the named share of the orders.
WINDOWS = {"s01": (8000000, 19950101, 19950501), "s1": (13500000, 19950101, 19960301), "s2": (19000000, 19950101, 19960901), "s5": (25000000, 19950101, 19980501), "s10": (36000000, 19950101, 19991001), "s15": (37000000, 19950101, 20010801), "s20": (100000000, 19000101, 21000101)}
ORDERS_SQL = """orders_w AS (
  SELECT o_orderkey AS "row", o_custkey AS ck, o_orderstatus AS st, CAST(trunc(o_totalprice * 100) AS INTEGER) AS t,
         CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS d, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS p,
         CAST(o_orderkey % 10 AS INTEGER) AS region FROM orders)"""


def filter_text(window: str) -> str:
    t, a, b = WINDOWS[window]
    return f"# {window}\nf\tt\tINT\t>=\t0\t<=\t{t}\nf\td\tINT\t>=\t{a}\t<=\t{b}\nf\tp\tINT\t>=\t3\t<=\t3\n"


def where(window: str) -> str:
    t, a, b = WINDOWS[window]
    return f"t >= 0 AND t <= {t} AND d >= {a} AND d <= {b} AND p = 3"


_catalogs: dict[tuple, IndexCatalog] = {}


def stored(spark, sf, *kinds, typed=None, names=INDEXED, **options) -> ix.Indexed:
    """The orders with indexes of some kinds, built in the shared folder at their first use in a session; the typed table is stored with them, sorted by its key."""
    key = (spark.sparkContext.applicationId, sf, kinds)
    if key not in _catalogs:
        catalog = IndexCatalog(spark, shared_place(spark, "index"))
        base = orders(spark, sf, 10)
        (typed(base) if typed else base).repartitionByRange("row").sortWithinPartitions("row").write.parquet(f"{catalog.path}/base")
        catalog.create(spark.read.parquet(f"{catalog.path}/base"), "row", list(names), kinds=kinds, region="region", **options)
        _catalogs[key] = catalog
    return _catalogs[key].open(spark.read.parquet(f"{_catalogs[key].path}/base"))


def select(window: str) -> str:
    return f'WITH {ORDERS_SQL} SELECT "row", ck, st, t, d, p, region FROM orders_w WHERE {where(window)}'


for w in WINDOWS:
    query(f"scan_tpch_{w}", lambda s, sf, w=w: ix.no_index(stored(s, sf, "gs"), parse_ranges(filter_text(w))), select(w))

PATHS = {"gs": (ix.global_secondary, ("gs",)), "gc": (ix.global_clustering, ("gc", "cct")), "cc": (ix.complemental_clustering, ("gc", "cct")), "ir": (ix.in_region, ("ir",)), "lc": (ix.local_clustering, ("lc",))}
for name, (path, kinds) in PATHS.items():
    for w in ("s1", "s10"):
        query(f"idx_{name}_3d_{w}", lambda s, sf, path=path, kinds=kinds, w=w: path(stored(s, sf, *kinds), parse_ranges(filter_text(w))), select(w))
query("idx_ls_3d", lambda s, sf: ix.in_region(stored(s, sf, "ir"), parse_ranges(filter_text("s5"))), select("s5"))


def _choose_column(s, sf):
    stats = Statistics.of(orders(s, sf, 10), INDEXED, 100)
    return ix.global_clustering(stored(s, sf, "gc", "cct"), parse_ranges(filter_text("s1")), chooser=stats.selectivity)


query("idx_gc_chosen_column", _choose_column, select("s1"))


def _chosen_path(s, sf):
    ranges = parse_ranges(filter_text("s1"))
    choice = choose(Statistics.of(orders(s, sf, 10), INDEXED, 100), ranges, {"gs", "gc"})
    path, kinds = {"none": (ix.no_index, ("gs",)), **PATHS}[choice.path]
    return path(stored(s, sf, *kinds), ranges)


query("idx_chosen_path", _chosen_path, select("s1"))
COVER = (ix.Covering("t", ("d", "p", "st")), ix.Covering("d", ("p", "t", "region")))
query("idx_udg_cover", lambda s, sf: ix.user_defined(stored(s, sf, "udl", covering=COVER), COVER, parse_ranges(filter_text("s5")), ["row", "t", "st"]), f'WITH {ORDERS_SQL} SELECT "row", t, st FROM orders_w WHERE {where("s5")}')
query("idx_udg_fallback", lambda s, sf: ix.user_defined(stored(s, sf, "gs"), COVER, parse_ranges(filter_text("s5")), ["row", "t", "ck"]), f'WITH {ORDERS_SQL} SELECT "row", t, ck FROM orders_w WHERE {where("s5")}')
query("idx_udl_cover", lambda s, sf: ix.user_defined(stored(s, sf, "udl", covering=COVER), COVER, parse_ranges(filter_text("s5")), ["region", "row", "d"], local=True), f'WITH {ORDERS_SQL} SELECT region, "row", d FROM orders_w WHERE {where("s5")}')
query("idx_unindexed_residual", lambda s, sf: ix.global_secondary(stored(s, sf, "gs"), [*parse_ranges(filter_text("s10")), ColumnRange("ck", "<", 500)]), select("s10") + " AND ck < 500")
query("idx_strict_bounds", lambda s, sf: ix.global_secondary(stored(s, sf, "gs"), [ColumnRange("t", ">", 1000000, "<", 9000000), ColumnRange("p", ">", 1)]), f"WITH {ORDERS_SQL} SELECT * FROM orders_w WHERE t > 1000000 AND t < 9000000 AND p > 1")
query("idx_disjunction", lambda s, sf: ix.disjunction(stored(s, sf, "gs"), [parse_ranges(filter_text("s1")), [ColumnRange("t", "<", 3000000), ColumnRange("p", "=", 1)]], ix.global_secondary), f"WITH {ORDERS_SQL} SELECT * FROM orders_w WHERE ({where('s1')}) OR (t < 3000000 AND p = 1)")
_SELECT = "select row, t, st from orders where (t between 1000000 and 9000000 and d >= 19990101 or p = 1 and t < 3000000) and st <> 'P'"
query("idx_small_sql", lambda s, sf: run_select(_SELECT, {"orders": stored(s, sf, "gc", "cct")}), f"""WITH {ORDERS_SQL} SELECT "row", t, st FROM orders_w WHERE (t BETWEEN 1000000 AND 9000000 AND d >= 19990101 OR p = 1 AND t < 3000000) AND st <> 'P'""")
query("scan_ne", lambda s, sf: ix.global_secondary(stored(s, sf, "gs"), [ColumnRange("p", "!=", 3), ColumnRange("t", "<=", 9000000)]), f"WITH {ORDERS_SQL} SELECT * FROM orders_w WHERE p <> 3 AND t <= 9000000")


def _missing(s, sf):
    base = orders(s, sf, 10).withColumn("t", F.when(F.col("row") % 7 != 0, F.col("t")))
    return base.filter(conjunction([ColumnRange("t", "<=", 9000000), ColumnRange("p", "=", 3)], missing_passes=True))


query("scan_missing_passes", _missing, f'WITH {ORDERS_SQL}, m AS (SELECT * REPLACE (CASE WHEN "row" % 7 <> 0 THEN t END AS t) FROM orders_w) SELECT * FROM m WHERE (t IS NULL OR t <= 9000000) AND p = 3')


# ---- z-order ----
def _md(s, sf, window, by_key=True, local=False):
    t, a, b = WINDOWS[window]
    table = stored(s, sf, "lmd" if local else "md", typed=scaled, names=("zt", "zd", "zp"), bits={"zt": BITS, "zd": BITS, "zp": BITS})
    ranges = [ColumnRange("t", ">=", 0, "<=", t), ColumnRange("d", ">=", a, "<=", b), ColumnRange("p", "=", 3)]
    box = [ColumnRange("zt", ">=", 0, "<=", t >> 6), ColumnRange("zp", ">=", 3, "<=", 3)]
    return ix.multi_dimensional(table, [*box, *ranges], by_key, 24, "region" if local else None).drop("zt", "zd", "zp")


for w in ("s1", "s10"):
    query(f"idx_md_box_{w}", partial(_md, window=w), select(w))
query("idx_lmd_s_box", partial(_md, window="s5", local=True), select("s5"))
query("idx_lmd_d_box", partial(_md, window="s5", by_key=False, local=True), select("s5"))


def _appended(s, sf):
    """An index built over the orders up to a day, then kept up with the later ones."""
    every = orders(s, sf, 10)
    old, new = every.filter("d < 19980101"), every.filter("d >= 19980101")
    catalog = IndexCatalog(s, shared_place(s, "index"))
    catalog.create(old, "row", ["t", "d"], kinds=("gs", "gc"), region="region")
    catalog.append(new)
    t = catalog.open(every)
    ranges = [ColumnRange("t", ">=", 1000000, "<", 9000000), ColumnRange("d", ">=", 19970601, "<=", 19980630)]
    return ix.global_secondary(t, ranges).intersect(ix.global_clustering(t, ranges))


query("idx_after_append", _appended, f"WITH {ORDERS_SQL} SELECT * FROM orders_w WHERE t >= 1000000 AND t < 9000000 AND d BETWEEN 19970601 AND 19980630")


def _zip(s, sf):
    z = orders(s, sf).select("row", (F.col("t") % 64).alias("x"), (F.col("d") % 64).alias("y"))
    z = z.withColumn("z", zip_bits([F.col("x"), F.col("y")], 6))
    return z.select("row", "z", unzip(F.col("z"), 0, 2, 6).alias("x"), unzip(F.col("z"), 1, 2, 6).alias("y"))


_Z = " + ".join(f"(((x >> {b}) & 1) << {2 * b + 1}) + (((y >> {b}) & 1) << {2 * b})" for b in range(6))
query("zorder_zip_unzip", _zip, f'WITH {ORDERS_SQL}, z AS (SELECT "row", CAST(t % 64 AS BIGINT) AS x, CAST(d % 64 AS BIGINT) AS y FROM orders_w) SELECT "row", {_Z} AS z, x, y FROM z')


def _buckets(s, sf, most=1000):
    z = orders(s, sf).select(zip_bits([F.floor(F.col("t") / 800000), F.col("p")], 6).alias("z"))
    return buckets(z, "z", 12, most).select("prefix", "bits", "n")


def _bucket_sql(most=1000, total=12):
    z = " + ".join(f"(((x >> {b}) & 1) << {2 * b + 1}) + (((y >> {b}) & 1) << {2 * b})" for b in range(6))
    return f"""WITH {ORDERS_SQL}, v AS (SELECT CAST(floor(t / 800000.0) AS BIGINT) AS x, CAST(p AS BIGINT) AS y FROM orders_w), z AS MATERIALIZED (SELECT {z} AS z, count(*) AS n FROM v GROUP BY 1),
    l AS MATERIALIZED (SELECT z >> ({total} - CAST(b.bits AS BIGINT)) AS prefix, CAST(b.bits AS INTEGER) AS bits, CAST(sum(n) AS BIGINT) AS n FROM z, range({total + 1}) b(bits) GROUP BY ALL)
    SELECT a.prefix, a.bits, a.n FROM l a LEFT JOIN l b ON b.bits = a.bits - 1 AND b.prefix = a.prefix >> 1
    WHERE (a.n <= {most} OR a.bits = {total}) AND (a.bits = 0 OR b.n > {most})"""


query("md_buckets", _buckets, _bucket_sql())


def _bucket_hits(s, sf):
    b = _buckets(s, sf).withColumns({"start": F.expr("shiftleft(prefix, 12 - bits)"), "end": F.expr("shiftleft(prefix + 1, 12 - bits) - 1")})
    spans = box_ranges([3, 2], [20, 4], 6, 64)
    boxes = s.createDataFrame(spans, "low long, high long")
    return overlapping(boxes, b).select("prefix", "bits", "n").distinct()


_SPANS = ", ".join(f"({a}, {b})" for a, b in box_ranges([3, 2], [20, 4], 6, 64))
query("box_bucket_overlap", _bucket_hits, f"WITH bk AS ({_bucket_sql()}) SELECT DISTINCT prefix, bits, n FROM bk JOIN (VALUES {_SPANS}) x(low, high) ON x.low <= ((prefix + 1) << (12 - bits)) - 1 AND (prefix << (12 - bits)) <= x.high")

# ---- key sets, lookups, differences ----
keys = lambda s, sf, c: orders(s, sf).filter(c).select("row")
query("rowkey_intersect", lambda s, sf: intersect_keys([keys(s, sf, "t <= 20000000"), keys(s, sf, "d >= 19970101"), keys(s, sf, "p = 2")]), f'WITH {ORDERS_SQL} SELECT "row" FROM orders_w WHERE t <= 20000000 INTERSECT SELECT "row" FROM orders_w WHERE d >= 19970101 INTERSECT SELECT "row" FROM orders_w WHERE p = 2')
query("rowkey_intersect_empty", lambda s, sf: intersect_keys([keys(s, sf, "t <= 20000000"), keys(s, sf, "p > 9")]), f'WITH {ORDERS_SQL} SELECT "row" FROM orders_w WHERE p > 9')
query("rowkey_union", lambda s, sf: union_keys([keys(s, sf, "t <= 3000000"), keys(s, sf, "d < 19950301"), keys(s, sf, "p = 1 AND ck < 300")]), f'WITH {ORDERS_SQL} SELECT "row" FROM orders_w WHERE t <= 3000000 UNION SELECT "row" FROM orders_w WHERE d < 19950301 UNION SELECT "row" FROM orders_w WHERE p = 1 AND ck < 300')
query("rowkey_except", lambda s, sf: minus_keys(keys(s, sf, "t <= 9000000"), keys(s, sf, "p = 1")), f'WITH {ORDERS_SQL} SELECT "row" FROM orders_w WHERE t <= 9000000 EXCEPT SELECT "row" FROM orders_w WHERE p = 1')
query("union_all_scans", lambda s, sf: keys(s, sf, "t <= 3000000").unionByName(keys(s, sf, "p = 1")), f'WITH {ORDERS_SQL} SELECT "row" FROM orders_w WHERE t <= 3000000 UNION ALL SELECT "row" FROM orders_w WHERE p = 1')


def _floor_dates(s, sf):
    """For each order's day, the last day up to it on which any line was shipped."""
    points = orders(s, sf).select("row", F.unix_date(F.to_date(F.col("d").cast("string"), "yyyyMMdd")).cast("long").alias("day"))
    steps = s.read.parquet(f"{sf}/lineitem.parquet").select(F.unix_date(F.to_date("l_shipdate")).cast("long").alias("k")).distinct()
    return floor_lookup(points, steps, "day", "k", 64)


query("floor_lookup", _floor_dates, """WITH o AS (SELECT o_orderkey AS "row", CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day FROM orders), k AS (SELECT DISTINCT CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS k FROM lineitem)
    SELECT o."row", o.day, k.k AS floor FROM o ASOF LEFT JOIN k ON o.day >= k.k""")


def _two_sides(s, sf):
    """Two tables of all orders: each lacks some prices, and of one customer group the second has other values."""
    o = orders(s, sf)
    a = o.select("row", F.col("t").alias("v"), "t").filter("NOT t BETWEEN 5000000 AND 6000000").drop("t")
    b = o.select("row", F.when((F.col("st") == "F") & (F.col("p") == 2), F.col("t") + 1).otherwise(F.col("t")).alias("v"), "t").filter("NOT t BETWEEN 9000000 AND 9500000").drop("t")
    return a, b


_SIDES = f"""{ORDERS_SQL}, a AS (SELECT "row" r, t v FROM orders_w WHERE NOT t BETWEEN 5000000 AND 6000000), b AS (SELECT "row" r, CASE WHEN st = 'F' AND p = 2 THEN t + 1 ELSE t END v FROM orders_w WHERE NOT t BETWEEN 9000000 AND 9500000)"""
_COUNTS = "count(*) FILTER (a.r IS NOT NULL AND b.r IS NULL) AS target_missing, count(*) FILTER (a.r IS NULL AND b.r IS NOT NULL) AS source_missing, count(*) FILTER (a.v <> b.v) AS different"
query("sync_diff", lambda s, sf: difference(*_two_sides(s, sf), ["row"], "v"), f"WITH {_SIDES} SELECT count(*) FILTER (a.v = b.v) AS matching, {_COUNTS} FROM a FULL JOIN b ON a.r = b.r")
query("sync_by_hash", lambda s, sf: sync(*_two_sides(s, sf), ["row"], "v", F.floor(F.col("row") / 100)).drop("matching"), f"WITH {_SIDES} SELECT {_COUNTS} FROM a FULL JOIN b ON a.r = b.r")
query("sync_batches", lambda s, sf: sync_batches(*_two_sides(s, sf), ["row"], "v", F.floor(F.col("row") / 100)), f"""WITH {_SIDES}, m AS (SELECT coalesce(a.r, b.r) // 100 AS k, a.v IS NOT DISTINCT FROM b.v AND a.r IS NOT NULL AND b.r IS NOT NULL AS same, a.r IS NOT NULL AS ia, b.r IS NOT NULL AS ib FROM a FULL JOIN b ON a.r = b.r),
    g AS (SELECT k, bool_and(same) AS same, bool_or(ia) AS ia, bool_or(ib) AS ib FROM m GROUP BY k)
    SELECT count(*) AS batches, count(*) FILTER (same) AS hashes_matched, count(*) FILTER (NOT same AND ia AND ib) AS hashes_not_matched, count(*) FILTER (NOT ia) AS source_empty, count(*) FILTER (NOT ib) AS target_empty FROM g""")
query("hash_batches", lambda s, sf: hash_batches(orders(s, sf), F.floor(F.col("row") / 500), ["row", "t"]), f"""WITH {ORDERS_SQL} SELECT CAST(floor("row" / 500.0) AS BIGINT) AS batch, count(*) AS n, CAST(sum(CAST(('0x' || substr(md5("row" || chr(31) || t), 1, 16)) AS UBIGINT)) AS VARCHAR) || ':' || CAST(sum(CAST(('0x' || substr(md5("row" || chr(31) || t), 17, 16)) AS UBIGINT)) AS VARCHAR) AS digest FROM orders_w GROUP BY 1""")

# ---- statistics ----
query("hist_equiwidth", lambda s, sf: histogram(orders(s, sf), "t", 0, 50000000, 100), f"WITH {ORDERS_SQL} SELECT CAST(greatest(least(floor(t::DOUBLE * 100 / 50000000.0), 99), 0) AS INTEGER) AS bucket, count(*) AS n FROM orders_w GROUP BY 1")
query("hist_set", lambda s, sf: value_histogram(orders(s, sf), "p", [1, 3, 5]), f"WITH {ORDERS_SQL} SELECT p AS value, count(*) AS n FROM orders_w WHERE p IN (1, 3, 5) GROUP BY p")


def _selectivity(s, sf):
    stats = Statistics.of(orders(s, sf), INDEXED, 1000)
    rows = [(w, *(round(stats.selectivity(r), 6) for r in parse_ranges(filter_text(w)))) for w in WINDOWS]
    return s.createDataFrame(rows, "w string, t double, d double, p double")


def _selectivity_sql(parts=1000):
    """The same estimate from equal-width histograms: whole buckets count fully, cut ones by their share, but by one row at least."""
    asked = ", ".join(f"('{w}', 't', 0.0, {t}.0), ('{w}', 'd', {a}.0, {b}.0), ('{w}', 'p', 3.0, 3.0)" for w, (t, a, b) in WINDOWS.items())
    return f"""WITH {ORDERS_SQL}, v AS (UNPIVOT (SELECT CAST(t AS DOUBLE) AS t, CAST(d AS DOUBLE) AS d, CAST(p AS DOUBLE) AS p FROM orders_w) ON t, d, p INTO NAME c VALUE x),
    e AS (SELECT c, min(x) AS lo, max(x) AS hi, count(*) AS n FROM v GROUP BY c),
    h AS (SELECT c, lo, hi, e.n, CAST(least(floor((x - lo) * {parts} / greatest(hi - lo, 1e-9)), {parts - 1}) AS INTEGER) AS b, count(*) AS k FROM v JOIN e USING (c) GROUP BY ALL),
    q(w, c, a, z) AS (VALUES {asked}),
    s AS (SELECT w, h.c, n, k, a, z, lo + b * (greatest(hi - lo, 1e-9) / {parts}) AS x0, lo + (b + 1) * (greatest(hi - lo, 1e-9) / {parts}) AS x1, greatest(hi - lo, 1e-9) / {parts} AS width FROM h JOIN q ON q.c = h.c WHERE a <= hi AND z >= lo),
    r AS (SELECT w, c, least(1.0, sum(k * CASE WHEN x0 >= a AND x1 <= z THEN 1.0 ELSE greatest(least((least(x1, z) - greatest(x0, a)) / width, 1.0), 1.0 / k) END) / max(n)) AS share FROM s WHERE x1 >= a AND x0 <= z GROUP BY ALL)
    SELECT q.w, round(coalesce(max(share) FILTER (q.c = 't'), 0.0), 6) AS t, round(coalesce(max(share) FILTER (q.c = 'd'), 0.0), 6) AS d, round(coalesce(max(share) FILTER (q.c = 'p'), 0.0), 6) AS p
    FROM q LEFT JOIN r ON r.w = q.w AND r.c = q.c GROUP BY q.w"""


query("selectivity", _selectivity, _selectivity_sql())
