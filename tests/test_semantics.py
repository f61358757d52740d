"""Goldens, models and round trips."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rowlattice import queries
from rowlattice.functions import codecs as c
from rowlattice.functions import visibility
from rowlattice.functions.zorder import box_ranges, zip_int
from rowlattice.index.catalog import IndexCatalog
from rowlattice.index.secondary import Covering, global_clustering, global_secondary, local_clustering, multi_dimensional, no_index, user_defined
from rowlattice.model import CELL, DELETE_COLUMN, DELETE_FAMILY, DELETE_FAMILY_VERSION, DELETE_VERSION, PUT
from rowlattice.operators import aggregates, mutations
from rowlattice.operators.predicates import ColumnRange, after_prefix, merge_intervals, parse_ranges
from rowlattice.operators.resolve import resolve
from rowlattice.plans import filterlang, jobs, tabledsl
from rowlattice.plans.chooser import Statistics, choose
from rowlattice.queries.access import filter_text
from rowlattice.sources.events import event_cells
from rowlattice.sources.orders import BITS, INDEXED, orders, scaled
from rowlattice.sources.tables import TextSpec, bulk_load, read_text, snapshot
from rowlattice.workloads import generators as g
from rowlattice.workloads.latency import parse_report, timed

SCHEMA = "row string, family string, qualifier string, ts long, seq long, type int, value long"


def golden(spark):
    rows = []
    for i in range(20):
        rows.append((f"testRow{i:04d}", "f", "q", 0, i, PUT, i))
        rows.append((f"testRow{i:04d}", "f", f"q{i}", 0, i, PUT, 10 * i))
    return spark.createDataFrame(rows, SCHEMA)


def test_aggregate_goldens(spark):
    cells = golden(spark)
    one = aggregates.cell_aggregates(cells.filter("qualifier = 'q'"), F.col("value")).first()
    assert (one["rows"], one["max"], one["min"], one["sum"], one["avg"]) == (20, 19, 0, 190, 9.5)
    assert abs(one["std"] - 5.766) < 0.001
    family = aggregates.cell_aggregates(cells, F.col("value")).first()
    assert (family["max"], family["sum"], family["avg"]) == (190, 2090, 104.5)
    empty = aggregates.cell_aggregates(cells.filter("false"), F.col("value")).first()
    assert empty["max"] is None and empty["avg"] != empty["avg"] and empty["std"] != empty["std"]
    # without regions the value before the running sum passes half of 190
    assert aggregates.weighted_median(cells.filter("qualifier = 'q'").withColumn("k", F.col("value")), "k", "value").first()[0] == 13


def model(cells, versions):
    out = set()
    puts = [x for x in cells if x[5] == PUT]
    for r, f, q, ts, seq, _, v in puts:
        hidden = any(m[0] == r and m[1] == f and ((m[5] == DELETE_VERSION and m[2] == q and m[3] == ts) or (m[5] == DELETE_COLUMN and m[2] == q and m[3] >= ts) or (m[5] == DELETE_FAMILY and m[3] >= ts) or (m[5] == DELETE_FAMILY_VERSION and m[3] == ts)) for m in cells)
        if not hidden:
            out.add((r, f, q, ts, seq, v))
    best = {}
    for r, f, q, ts, seq, v in out:
        best[r, f, q, ts] = max(best.get((r, f, q, ts), (-1, 0)), (seq, v))
    kept = {}
    for (r, f, q, ts), (seq, v) in best.items():
        kept.setdefault((r, f, q), []).append((ts, seq, v))
    return {(r, f, q, *x) for (r, f, q), xs in kept.items() for x in sorted(xs, reverse=True)[:versions]}


@pytest.mark.parametrize("versions", [1, 3, 50])
def test_resolve_against_a_model(spark, versions):
    rnd = random.Random(29372937 + versions)
    stamps = [1, 3, 5, 2**31 - 1, 2**62]
    cells = [(f"r{rnd.randrange(20):02d}", "f", f"q{rnd.randrange(8)}", rnd.choice(stamps), i, PUT if rnd.random() > 0.1 else rnd.choice([DELETE_VERSION, DELETE_COLUMN, DELETE_FAMILY, DELETE_FAMILY_VERSION]), i) for i in range(600)]
    got = {(r["row"], r["family"], r["qualifier"], r["ts"], r["seq"], r["value"]) for r in resolve(spark.createDataFrame(cells, SCHEMA), versions).collect()}
    assert got == model(cells, versions)


def test_markers_by_mutations(spark):
    cells = spark.createDataFrame([("a", "f", "q", t, t, PUT, t) for t in range(5)], SCHEMA)
    marks = cells.filter("ts = 3").select("row", "family", "qualifier", "ts")
    assert resolve(cells.unionByName(mutations.delete(marks, "column", 9))).first()["ts"] == 4
    assert resolve(cells.unionByName(mutations.delete(marks, "column", 9)), 9).count() == 1
    assert resolve(cells.unionByName(mutations.delete(marks, "version", 9)), 9).count() == 4
    assert mutations.put(cells.select("row", "family", "qualifier", "ts", "value"), 3).columns == CELL
    with pytest.raises(Exception, match="negative"):
        mutations.constrained(cells, F.col("value") > 2, "negative").collect()


@pytest.mark.parametrize("kind,values", [("INT8", [-128, -1, 0, 5, 127]), ("INT32", [-(2**31), -7, 0, 9]), ("INT64", [-(2**63), 0, 2**63 - 1]), ("FLOAT64", [-1e300, -1.5, 0.0, 2.5, 1e300]), ("FLOAT32", [-2.5, 0.0, 1.5]), ("NUMERIC", [None, Decimal("-12.5"), Decimal("-1.25"), Decimal(0), Decimal("0.001"), Decimal("9.99"), Decimal(10), Decimal("1e40")]), ("STRING", [None, "", "a", "a\0b", "ab", "é"]), ("BLOB", [b"", b"\0", b"\0\xff", b"\x01"])])
def test_codecs_keep_order(kind, values):
    coded = [c.encode(v, kind) for v in values]
    assert coded == sorted(coded) and [c.decode(x, kind) for x in coded] == values
    down = [c.encode(v, kind, True) for v in values]
    assert down == sorted(down, reverse=True) and [c.decode(x, kind, True) for x in down] == values


def test_struct_and_errors(spark):
    assert c.encode_struct([1, None], ["INT32", "STRING"]) == c.encode_struct([1], ["INT32"])
    with pytest.raises(ValueError):
        c.encode(None, "INT32")
    df = spark.createDataFrame([(-3, "ab", "6-NO")], "v long, s string, p string")
    assert df.select(c.decode_ordered_long(c.ordered_bytes(F.col("v"))), c.fixed_length(F.col("s"), 4), c.terminated(F.col("s"))).first()[:] == (-3, "ab\0\0", "ab\0")
    assert df.select(c.salt(F.col("v"), 10)).first()[0] == 2
    with pytest.raises(Exception, match="unknown priority"):
        df.select(c.priority(F.col("p"))).collect()


def test_range_files_and_intervals():
    r = parse_ranges("# c\nf\tt\tINT\t>=\t0\t<=\t9\nf s STRING = x # y\n")
    assert r[0] == ColumnRange("t", ">=", 0, "<=", 9) and r[1].low == "x" and r[1].type == "STRING"
    for bad in ("f t INT", "f t WHAT > 1", "f t INT ~ 1"):
        with pytest.raises(ValueError):
            parse_ranges(bad)
    assert merge_intervals([("b", True, "d", False), ("a", True, "b", True), ("x", True, None, False), ("c", False, "c", True)]) == [("a", True, "d", False), ("x", True, None, False)]
    assert after_prefix(b"a\xff") == b"b" and after_prefix(b"\xff") is None and after_prefix("ab") == "ac"


@pytest.mark.parametrize("text", ["PrefixFilter('a'", "Nope('a')", "PrefixFilter('a') PrefixFilter('b')", "ValueFilter(=, 'x')", "ValueFilter(~, 'binary:x')", "", "PageFilter()"])
def test_filter_language_errors(text):
    with pytest.raises(filterlang.FilterSyntaxError):
        filterlang.parse(text)


def test_filter_language_trees():
    from rowlattice.operators import filters as f

    t = filterlang.parse("PrefixFilter('it''s') OR PageFilter(3) AND SKIP FirstKeyOnlyFilter()")
    assert t.mode == "ONE" and t.filters[0].prefix == "it's" and t.filters[1].mode == "ALL" and isinstance(t.filters[1].filters[1], f.SkipFilter)
    assert len(filterlang.REGISTRY) == 18
    s = filterlang.parse("SingleColumnValueFilter('f', 'q', >=, 'binary:x', true, false)")
    assert s.filter_if_missing and not s.latest_only


def test_visibility():
    assert visibility.parse("a&(b|!c)") == ("&", "a", ("|", "b", ("!", "c")))
    for bad in ("a&", "(a", "a b", "&a"):
        with pytest.raises(ValueError):
            visibility.parse(bad)


def test_visibility_rows(spark):
    def plain(e, have):
        if isinstance(e, str):
            return e in have
        return not plain(e[1], have) if e[0] == "!" else plain(e[1], have) and plain(e[2], have) if e[0] == "&" else plain(e[1], have) or plain(e[2], have)

    texts = ["a", "a|b&c", "(a|b)&c", "!(a&b)|c", "!a&!b", "((a))", "a&(b|(c&!d))", "!!a", "d|c|b", "!(a|b)&!(c&d)"]
    df = spark.createDataFrame([(t,) for t in texts], "e string")
    for have in ([], ["a"], ["b", "c"], ["c", "d"], ["a", "b", "c", "d"]):
        got = {r[0]: r[1] for r in df.select("e", visibility.visible(F.col("e"), have)).collect()}
        assert got == {t: plain(visibility.parse(t), have) for t in texts}, have


def test_box_ranges_cover_exactly():
    for low, high in (([1, 2], [5, 6]), ([0, 0], [7, 7]), ([3, 3], [3, 3])):
        spans = box_ranges(low, high, 3, 10_000)
        inside = {zip_int([x, y], 3) for x in range(low[0], high[0] + 1) for y in range(low[1], high[1] + 1)}
        assert {k for s, e in spans for k in range(s, e + 1)} == inside
        rough = box_ranges(low, high, 3, 3)
        assert inside <= {k for s, e in rough for k in range(s, e + 1)}


def test_materialised_indexes_agree(spark, sf, tmp_path):
    base = scaled(orders(spark, sf, 4))
    catalog = IndexCatalog(spark, str(tmp_path / "ix"))
    made = catalog.create(base, "row", INDEXED, region="region", covering=(Covering("d", ("p", "t")),), files=2)
    assert catalog.relation() == made
    t = catalog.open(base)
    ranges = parse_ranges(filter_text("s10"))
    want = {r["row"] for r in no_index(t, ranges).collect()}
    assert want
    for path in (global_secondary, global_clustering, local_clustering):
        assert {r["row"] for r in path(t, ranges).collect()} == want
    assert {r["row"] for r in user_defined(t, [Covering("d", ("p", "t"))], ranges, ["row", "d"]).collect()} == want
    plan = global_clustering(t, ranges)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual" in plan
    z = IndexCatalog(spark, str(tmp_path / "z"))
    z.create(base, "row", ["zt", "zd", "zp"], kinds=("md",), bits={"zt": BITS, "zd": BITS, "zp": BITS}, files=2)
    box = [ColumnRange("zt", "<", 200000), ColumnRange("zp", "=", 3)]
    assert {r["row"] for r in multi_dimensional(z.open(base), box).collect()} == {r["row"] for r in base.filter("zt < 200000 AND zp = 3").collect()}
    catalog.drop()


def test_registered_index_queries_read_their_indexes(spark, sf):
    """Each path's plan scans its stored table with a pushed range."""
    queries.load()
    for name, table, column in (("idx_gs_3d_s1", "gs_t", "t"), ("idx_gc_3d_s1", "gc_t", "t"), ("idx_cc_3d_s1", "cct", "t"), ("idx_ir_3d_s1", "ir_d", "d"), ("idx_lc_3d_s1", "lc_t", "t"), ("idx_udg_cover", "udg_t", "t"), ("idx_udl_cover", "udl_d", "d"), ("idx_md_box_s1", "md", "zkey"), ("idx_lmd_s_box", "lmd", "zkey")):
        scans = [part for part in queries.QUERIES[name](spark, sf)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).split("Scan parquet") if f"/{table}]" in part]
        assert scans and any(f"GreaterThanOrEqual({column}," in part or f"LessThanOrEqual({column}," in part for part in scans), name


def test_appended_rows_reach_every_index(spark, sf, tmp_path):
    base = scaled(orders(spark, sf, 4))
    catalog = IndexCatalog(spark, str(tmp_path / "ix"))
    catalog.create(base.filter("d < 19980101"), "row", INDEXED, kinds=("gs", "gc", "lc", "ir", "cct", "udl"), region="region", covering=(Covering("d", ("p", "t")),))
    catalog.append(base.filter("d >= 19980101"))
    for name, copy in catalog.open(base).copies.items():
        assert copy.count() == base.count(), name


def test_nested_lists_read_their_table_once(spark):
    from rowlattice.operators import filters as f
    from rowlattice.operators import predicates as p

    cells = golden(spark)
    for n in (2, 6, 10):
        parts = [f.ValueFilter(">", p.Binary(1)), f.FirstKeyOnlyFilter(), f.SingleColumnValueFilter("f", "q", "<", p.Binary(15)), f.ColumnCountGetFilter(3), f.SkipFilter(f.ValueFilter(">", p.Binary(2)))]
        tree = f.either(f.both(*[parts[i % 5] for i in range(n)]), f.both(f.PrefixFilter("zzz"), f.FirstKeyOnlyFilter()))
        plan = tree.apply(cells)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    got = f.either(f.both(f.ValueFilter(">", p.Binary(5)), f.FirstKeyOnlyFilter())).apply(cells).collect()
    # the first cell in sight, not the first of the row
    assert {(r["row"], r["qualifier"]) for r in got} == {(f"testRow{i:04d}", "q" if i > 5 else f"q{i}") for i in range(1, 20)}


def test_floors_by_levels(spark, monkeypatch):
    from rowlattice.operators import joins

    monkeypatch.setattr(joins, "LEVEL_ROWS", 5)
    monkeypatch.setattr(joins, "LEVEL", 3)
    rnd = random.Random(4)
    points = [(i, rnd.randrange(-500, 3000)) for i in range(300)]
    steps = sorted({rnd.randrange(0, 2500) for _ in range(60)})
    got = joins.floor_lookup(spark.createDataFrame(points, "i long, x long"), spark.createDataFrame([(s,) for s in steps], "s long"), "x", "s", 8)
    for r in got.collect():
        assert r["floor"] == max((s for s in steps if s <= r["x"]), default=None)


def test_medians_of_text_keys_and_hot_keys(spark):
    rnd = random.Random(5)
    rows = [(f"k{min(rnd.randrange(900), 300):05d}", rnd.randrange(1, 50)) for _ in range(3000)]
    by = {}
    for k, w in rows:
        by[k] = by.get(k, 0) + w
    half, run, want = sum(by.values()) / 2, 0, None
    top = {k: max(w for x, w in rows if x == k) for k in by}
    for k in sorted(by):
        run += by[k]
        want = top[k] if run <= half else want
    d = spark.createDataFrame(rows, "k string, w long")
    assert aggregates.weighted_median(d, "k", "w", most=10).first()[0] == aggregates.weighted_median(d, "k", "w").first()[0] == want


def test_many_boxes_meet_buckets_by_key(spark):
    from rowlattice.operators.joins import overlapping

    rnd = random.Random(6)
    boxes = [(a, a + rnd.randrange(40)) for a in (rnd.randrange(900) for _ in range(60))]
    sizes = [(w * k, w * k + w - 1) for w in (1, 4, 32) for k in range(0, 1000 // w, 3)]
    b, k = spark.createDataFrame(boxes, "low long, high long"), spark.createDataFrame(sizes, "start long, end long")
    want = sorted((s, e, lo, hi) for s, e in sizes for lo, hi in boxes if lo <= e and s <= hi)
    for most in (10, 1000):
        assert sorted(tuple(r) for r in overlapping(b, k, most=most).select("start", "end", "low", "high").collect()) == want


def test_totals_of_large_numbers(spark):
    big = 4_000_000_000
    d = spark.createDataFrame([(i % 3, big + i) for i in range(9)], "region long, v long")
    one = aggregates.total(aggregates.by_region(d, "v")).first()
    assert one["std"] == pytest.approx((60 / 9) ** 0.5) and one["sum"] == 9 * big + 36


def test_row_mutations(spark):
    cells = spark.createDataFrame([("a", "f", "q", 1, 1, PUT, 5), ("b", "f", "q", 1, 1, PUT, 6), ("b", "f", "r", 1, 1, PUT, 7)], SCHEMA)
    puts = spark.createDataFrame([("a", "f", "q", 2, 8), ("b", "f", "q", 2, 9)], "row string, family string, qualifier string, ts long, value long")
    gone = spark.createDataFrame([("b", "f", "r", 5)], "row string, family string, qualifier string, ts long")
    changes = mutations.mutate_rows([("put", puts), ("column", gone)], 10)
    after = resolve(cells.unionByName(changes))
    assert {(r["row"], r["qualifier"], r["value"]) for r in after.collect()} == {("a", "q", 8), ("b", "q", 9)}
    kept = mutations.check_and(cells, F.col("current") == 6, "f", "q", changes)
    assert {r["row"] for r in kept.collect()} == {"b"} and kept.count() == 2
    with pytest.raises(Exception, match="rows of other keys"):
        mutations.mutate_rows([("put", puts)], 10, only_row="a").collect()


def test_hash_functions():
    from rowlattice.functions import hashes

    # published check values
    assert hashes.murmur3_int(b"", 0) == 0 and hashes.murmur3_int(b"hello", 0) == 0x248BFA47 and hashes.murmur3_int(b"The quick brown fox jumps over the lazy dog", 0) == 0x2E4FF723
    assert hashes.one_at_a_time_int(b"a") == 0xCA2E9442 and hashes.one_at_a_time_int(b"The quick brown fox jumps over the lazy dog") == 0x519E91F5


def test_hash_columns(spark):
    from rowlattice.functions import hashes

    texts = ["", "a", "ab", "abc", "abcd", "hello", "é😀 and more", "x" * 100]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in d.select("t", hashes.murmur3(F.col("t"), 7).alias("m"), hashes.one_at_a_time(F.col("t")).alias("j")).collect():
        assert r["m"] == hashes.murmur3_int(r["t"].encode(), 7) and r["j"] == hashes.one_at_a_time_int(r["t"].encode())


def test_custom_aggregate(spark):
    """A product, which no built-in merges, by partials of each region."""
    d = spark.createDataFrame([(i % 4, i) for i in range(1, 13)], "region int, v long")
    made = aggregates.custom_aggregate(d, "v", F.lit(1).cast("long"), lambda a, v: a * v, lambda a, b: a * b, lambda a: a)
    assert made.first()["result"] == 479001600


def test_small_sql():
    from rowlattice.plans.indexsql import parse_select

    s = parse_select("SELECT a, f:b FROM t WHERE a < 'it''s' AND (b >= -2 OR c = 1.5);")
    assert (s.columns, s.table, [[r.qualifier for r in g] for g in s.groups]) == (["a", "f:b"], "t", [["a", "b"], ["a", "c"]])
    assert parse_select("select * from t").columns is None
    for bad in ("select a", "select from t", "select a from t where", "select a from t where a like 'x'", "select a from t where (a = 1", "select a from t a = 1", "select a from t where a = 1 b"):
        with pytest.raises(ValueError):
            parse_select(bad)


def test_paths():
    from rowlattice.plans.scanspec import scan_of_path

    s = scan_of_path("/r%2F1/f:a,g/5?m=3&n=2")
    assert (s.start, s.stop, s.include_stop, s.columns, s.families, s.time_range, s.max_versions, s.filter.n) == ("r/1", "r/1", True, (("f", "a"),), ("g",), (0, 5), 3, 2)
    assert scan_of_path("ab*").prefix == "ab" and scan_of_path("a,").stop is None
    for bad in ("/", "/a*,b", "/a/f/1,2,3", "/a/f/x", "/a?z=1", "/a/b/1/2"):
        with pytest.raises(ValueError):
            scan_of_path(bad)


def test_chooser(spark, sf):
    stats = Statistics.of(orders(spark, sf), INDEXED, 100)
    assert choose(stats, parse_ranges(filter_text("s01")), {"gc"}).path == "gc"
    assert choose(stats, [ColumnRange("t", ">=", 0)], {"gs"}).path == "none"
    assert stats.selectivity(ColumnRange("t", ">", 10**9)) == 0 and Statistics.any_of(0.5, 0.5) == 0.75


def test_text_files(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("r1\tv1\t5\nr2\tv2\nr3\tv3\tx\n\tv\t1\nr4\tv4\t7\n")
    spec = TextSpec(("STORE_ROW_KEY", "f:q", "STORE_TS_KEY"))
    assert {(r["row"], r["value"], r["ts"]) for r in read_text(spark, str(tmp_path / "x.tsv"), spec).collect()} == {("r1", "v1", 5), ("r4", "v4", 7)}
    for bad in (("f:q",), ("ROW_KEY", "ROW_KEY", "f:q"), ("ROW_KEY",), ("ROW_KEY", "TS_KEY", "TS_KEY", "f:q")):
        with pytest.raises(ValueError):
            TextSpec(bad)
    with pytest.raises(ValueError):
        TextSpec(("ROW_KEY", "f:q"), "::")


def test_bulk_load_and_snapshot(spark, sf, tmp_path):
    cells = event_cells(spark, sf)
    bulk_load(cells, str(tmp_path / "t"), 3)
    copy = snapshot(spark, str(tmp_path / "t"), "one")
    assert spark.read.parquet(copy).count() == cells.count()
    got = jobs.sync(cells, spark.read.parquet(copy), ["seq"], "value", F.floor(F.col("seq") / 50)).first()
    assert (got["different"], got["target_missing"], got["source_missing"]) == (0, 0, 0)


def test_description_and_generators(spark):
    d = tabledsl.parse("column f a INT 0 10\ncolumn f t STRING random 5\nindex-column f a\nuser-defined-index f a f t\nscan-range f a INT >= 2")
    rows = tabledsl.generate(spark, d, 100).collect()
    assert len(rows) == 100 and all(0 <= r["a"] < 10 and len(r["t"]) == 5 for r in rows) and d.covering == [Covering("a", ("t",))]
    with pytest.raises(ValueError):
        tabledsl.parse("column f a")
    n = spark.range(5000)
    i = F.col("id")
    z = {r[0]: r[1] for r in n.select(g.zipfian(i, 100).alias("k")).groupBy("k").count().collect()}
    assert z[0] == max(z.values()) and max(z) < 100
    assert n.select(g.exponential(i, 10.0).alias("k")).agg(F.avg("k")).first()[0] == pytest.approx(9.5, rel=0.1)
    assert n.select(g.histogram_value(i, [1, 3]).alias("k")).agg(F.avg("k")).first()[0] == pytest.approx(0.75, abs=0.03)
    assert n.select(g.sequential(i, 3, 5).alias("k")).distinct().count() == 3
    assert n.select(F.length(g.text(i, 70))).first()[0] == 70
    assert n.select(g.scrambled_zipfian(i, 50).alias("k")).agg(F.max("k")).first()[0] < 50


def test_timing_and_reports(spark):
    assert timed(lambda: spark.range(10))["rows"] == 10
    lines = spark.createDataFrame([("read latency: 0.5",), ("noise",), ("Write latency: 2",)], "value string")
    assert {(r[0], r[1]) for r in parse_report(lines).collect()} == {("read", 0.5), ("write", 2.0)}


def test_plans_push_down(spark, sf):
    plan = no_index(__import__("rowlattice.index.secondary", fromlist=["Indexed"]).Indexed(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderkey", ["o_custkey"]), [ColumnRange("o_custkey", "<", 10)]).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(o_custkey,10)" in plan and "o_totalprice" not in plan.split("ReadSchema")[1]


def test_scans_of_plain_data():
    from rowlattice.operators import filters as f
    from rowlattice.plans.scanspec import filter_of, scan_of

    s = scan_of({"COLUMN": "a:view", "TIMESTAMP": 7, "REVERSED": True, "LIMIT": 3})
    assert s.columns == (("a", "view"),) and s.time_range == (7, 8) and s.reversed and s.limit == 3
    with pytest.raises(ValueError):
        scan_of({"NOPE": 1})
    t = filter_of({"type": "SkipFilter", "filters": [{"type": "ValueFilter", "op": "LESS", "comparator": {"type": "LongComparator", "value": 5}}]})
    assert isinstance(t, f.SkipFilter) and t.child.comparator.value == 5
    with pytest.raises(ValueError):
        filter_of({"type": "Nope"})


@pytest.mark.parametrize("d,bits", [(2, 6), (2, 31), (3, 21), (4, 15), (1, 5)])
def test_zip_and_unzip(spark, d, bits):
    from rowlattice.functions.zorder import unzip, zip_bits

    rnd = random.Random(d * bits)
    points = [[rnd.randrange(1 << bits) for _ in range(d)] for _ in range(50)] + [[0] * d, [(1 << bits) - 1] * d]
    df = spark.createDataFrame([(p,) for p in points], "p array<long>")
    z = df.withColumn("z", zip_bits([F.col("p")[i] for i in range(d)], bits))
    for r in z.select("p", "z", F.array(*[unzip(F.col("z"), i, d, bits) for i in range(d)]).alias("back")).collect():
        assert r["z"] == zip_int(r["p"], bits) and r["back"] == r["p"]


def test_whole_table_queries(spark, sf):
    """No id prefix and no modulo filter: every order is there, and joins have keys of either side and of both."""
    queries.load()
    q = {n: queries.QUERIES[n](spark, sf) for n in ("cells_from_wide", "floor_lookup", "join_full")}
    n_orders = spark.read.parquet(f"{sf}/orders.parquet").count()
    assert q["cells_from_wide"].select("row").distinct().count() == q["floor_lookup"].count() == n_orders
    full = q["join_full"].collect()
    assert sum(r["n"] or 0 for r in full) == n_orders
    assert {(r["k"] is None, r["pk"] is None) for r in full} == {(False, False), (False, True), (True, False)}
