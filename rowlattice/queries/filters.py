"""One query for each filter, comparator and construct of the filter language, over puts of the event cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowlattice.model import with_region
from rowlattice.operators import filters as f
from rowlattice.operators import predicates as p
from rowlattice.operators.resolve import ranked
from rowlattice.plans import filterlang
from rowlattice.queries import query
from rowlattice.sources.events import CELLS_SQL, PUTS_SQL, event_cells

OUT = ["row", "family", "qualifier", "ts", "seq", "value"]
COLS = '"row", family, qualifier, ts, seq, value'
BASE = f"WITH {PUTS_SQL}"


def over(made, prepare=None):
    def run(s, sf):
        cells = event_cells(s, sf, markers=False)
        return made.apply(prepare(cells) if prepare else cells).select(*OUT)

    return run


def simple(name, made, condition):
    query(f"filter_{name}", over(made), f"{BASE} SELECT {COLS} FROM cells WHERE {condition}")


simple("row", f.RowFilter("<=", p.Binary("000020")), "\"row\" <= '000020'")
simple("family", f.FamilyFilter("=", p.Binary("a")), "family = 'a'")
simple("qualifier", f.QualifierFilter("!=", p.Binary("view")), "qualifier <> 'view'")
simple("value", f.ValueFilter(">", p.Binary(5000)), "value > 5000")
simple("no_op", f.ValueFilter("NO_OP", p.Binary(5000)), "false")
simple("prefix", f.PrefixFilter("00010"), "starts_with(\"row\", '00010')")
simple("inclusive_stop", f.InclusiveStopFilter("000033"), "\"row\" <= '000033'")
simple("multi_row_range", f.MultiRowRangeFilter([("000010", True, "000015", False), ("000014", True, "000020", True), ("000100", False, None, False)]), "(\"row\" >= '000010' AND \"row\" <= '000020') OR \"row\" > '000100'")
simple("fuzzy_row", f.FuzzyRowFilter([("0000?5", [0, 0, 0, 0, 1, 0]), ("00010?", [0, 0, 0, 0, 0, 1])]), "\"row\" LIKE '0000_5%' OR \"row\" LIKE '00010_%'")
simple("column_prefix", f.ColumnPrefixFilter("s"), "starts_with(qualifier, 's')")
simple("multiple_column_prefix", f.MultipleColumnPrefixFilter(["s", "cl"]), "starts_with(qualifier, 's') OR starts_with(qualifier, 'cl')")
simple("column_range", f.ColumnRangeFilter("click", False, "signup", True), "qualifier > 'click' AND qualifier <= 'signup'")
simple("timestamps", f.TimestampsFilter([3, 9, 27]), "ts IN (3, 9, 27)")
simple("time_range", f.TimeRangeFilter("a", "view", 4, 8), "NOT (family = 'a' AND qualifier = 'view') OR ts BETWEEN 4 AND 8")
query("filter_key_only", over(f.KeyOnlyFilter()), f"{BASE} SELECT \"row\", family, qualifier, ts, seq, '' AS value FROM cells")
query("filter_key_only_length", over(f.KeyOnlyFilter(True)), f"{BASE} SELECT \"row\", family, qualifier, ts, seq, CAST(length(CAST(value AS VARCHAR)) AS VARCHAR) AS value FROM cells")
query("filter_first_key_only", over(f.FirstKeyOnlyFilter()), f"{BASE}, x AS (SELECT *, row_number() OVER (PARTITION BY \"row\" ORDER BY family, qualifier, ts DESC, seq DESC) AS k FROM cells) SELECT {COLS} FROM x WHERE k = 1")
query("filter_first_matching_qualifiers", over(f.FirstKeyValueMatchingQualifiersFilter(["purchase", "view"])), f"""{BASE}, x AS (SELECT *, coalesce(max(CASE WHEN qualifier IN ('purchase', 'view') THEN 1 ELSE 0 END) OVER (PARTITION BY "row" ORDER BY family, qualifier, ts DESC, seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS met FROM cells) SELECT {COLS} FROM x WHERE met = 0""")
_RANK = "x AS (SELECT *, dense_rank() OVER (PARTITION BY \"row\" ORDER BY family, qualifier) AS c FROM cells)"
query("filter_column_count", over(f.ColumnCountGetFilter(2)), f"{BASE}, {_RANK} SELECT {COLS} FROM x WHERE c <= 2")
query("filter_column_pagination", over(f.ColumnPaginationFilter(2, 1)), f"{BASE}, {_RANK} SELECT {COLS} FROM x WHERE c > 1 AND c <= 3")
query("filter_column_pagination_from", over(f.ColumnPaginationFilter(2, column_offset="purchase")), f"{BASE}, x AS (SELECT *, dense_rank() OVER (PARTITION BY \"row\" ORDER BY family, qualifier) AS c FROM cells WHERE qualifier >= 'purchase') SELECT {COLS} FROM x WHERE c <= 2")
query("filter_dependent_column", over(f.DependentColumnFilter("a", "click")), f"{BASE} SELECT {COLS} FROM cells c WHERE EXISTS (SELECT 1 FROM cells r WHERE r.\"row\" = c.\"row\" AND r.ts = c.ts AND r.qualifier = 'click')")
query("filter_dependent_column_drop", over(f.DependentColumnFilter("a", "click", True, ">", p.Binary(6000))), f"{BASE} SELECT {COLS} FROM cells c WHERE qualifier <> 'click' AND EXISTS (SELECT 1 FROM cells r WHERE r.\"row\" = c.\"row\" AND r.ts = c.ts AND r.qualifier = 'click' AND r.value > 6000)")
_NEW = "n AS (SELECT \"row\", arg_max(value, (ts, seq)) AS v FROM cells WHERE qualifier = '{q}' GROUP BY 1)"
query("filter_single_column_value", over(f.SingleColumnValueFilter("a", "view", ">", p.Binary(9000))), f"{BASE}, {_NEW.format(q='view')} SELECT {COLS} FROM cells LEFT JOIN n USING (\"row\") WHERE n.v IS NULL OR n.v > 9000")
query("filter_single_column_missing", over(f.SingleColumnValueFilter("a", "nothing", ">", p.Binary(0), True)), f"{BASE} SELECT {COLS} FROM cells WHERE false")
query("filter_single_column_passes", over(f.both(f.QualifierFilter("!=", p.Binary("view")), f.SingleColumnValueFilter("a", "view", ">", p.Binary(10**9)))), f"{BASE} SELECT {COLS} FROM cells WHERE qualifier <> 'view'")
query("filter_single_column_any_version", over(f.SingleColumnValueFilter("a", "view", ">", p.Binary(14000), latest_only=False)), f"{BASE}, n AS (SELECT \"row\", max(value) AS v FROM cells WHERE qualifier = 'view' GROUP BY 1) SELECT {COLS} FROM cells LEFT JOIN n USING (\"row\") WHERE n.v IS NULL OR n.v > 14000")
query("filter_single_column_exclude", over(f.SingleColumnValueExcludeFilter("a", "view", "<=", p.Binary(4000))), f"{BASE}, {_NEW.format(q='view')} SELECT {COLS} FROM cells LEFT JOIN n USING (\"row\") WHERE (n.v IS NULL OR n.v <= 4000) AND qualifier <> 'view'")
query("filter_skip", over(f.SkipFilter(f.ValueFilter("<", p.Binary(25000)))), f"{BASE} SELECT {COLS} FROM cells WHERE \"row\" NOT IN (SELECT \"row\" FROM cells WHERE NOT value < 25000)")
query("filter_while_match", over(f.WhileMatchFilter(f.RowFilter("!=", p.Binary("000037")))), f"{BASE} SELECT {COLS} FROM cells WHERE \"row\" < '000037'")
query("filter_while_value", over(f.WhileMatchFilter(f.ValueFilter("<", p.Binary(20000)))), f"{BASE}, o AS (SELECT *, row_number() OVER (ORDER BY \"row\", family, qualifier, ts DESC, seq DESC) AS k FROM cells) SELECT {COLS} FROM o WHERE k < coalesce((SELECT min(k) FROM o WHERE NOT value < 20000), 1000000000)")
query("filter_page", over(f.PageFilter(9)), f"{BASE}, x AS (SELECT *, dense_rank() OVER (ORDER BY \"row\") AS k FROM cells) SELECT {COLS} FROM x WHERE k <= 9")
query("filter_page_per_region", over(f.PageFilter(3), lambda c: with_region(c, ["000050", "000100"])), f"{BASE}, x AS (SELECT *, dense_rank() OVER (PARTITION BY CASE WHEN \"row\" >= '000100' THEN 2 WHEN \"row\" >= '000050' THEN 1 ELSE 0 END ORDER BY \"row\") AS k FROM cells) SELECT {COLS} FROM x WHERE k <= 3")
query("filter_list_all", over(f.both(f.PrefixFilter("0000"), f.ColumnPrefixFilter("p"), f.ValueFilter(">=", p.Binary(1000)))), f"{BASE} SELECT {COLS} FROM cells WHERE starts_with(\"row\", '0000') AND starts_with(qualifier, 'p') AND value >= 1000")
query("filter_list_one", over(f.either(f.PrefixFilter("00010"), f.ValueFilter(">", p.Binary(9000)), f.QualifierFilter("=", p.Binary("signup")))), f"{BASE} SELECT {COLS} FROM cells WHERE starts_with(\"row\", '00010') OR value > 9000 OR qualifier = 'signup'")
query("filter_list_one_rows", over(f.either(f.SingleColumnValueFilter("a", "view", ">", p.Binary(9000), True), f.SingleColumnValueFilter("a", "click", "<", p.Binary(2000), True))), f"{BASE}, {_NEW.format(q='view')}, m AS (SELECT \"row\", arg_max(value, (ts, seq)) AS w FROM cells WHERE qualifier = 'click' GROUP BY 1) SELECT {COLS} FROM cells LEFT JOIN n USING (\"row\") LEFT JOIN m USING (\"row\") WHERE coalesce(n.v > 9000, false) OR coalesce(m.w < 2000, false)")
query("filter_list_one_empty", over(f.either()), f"{BASE} SELECT {COLS} FROM cells WHERE false")
query("filter_nested_lists", over(f.either(f.both(f.FamilyFilter("=", p.Binary("a")), f.ValueFilter("<", p.Binary(3000))), f.both(f.FamilyFilter("=", p.Binary("b")), f.TimestampsFilter([1, 2])))), f"{BASE} SELECT {COLS} FROM cells WHERE (family = 'a' AND value < 3000) OR (family = 'b' AND ts IN (1, 2))")
query("filter_before_versions", lambda s, sf: ranked(f.ValueFilter("<", p.Binary(3000)).apply(event_cells(s, sf, False))).filter("version = 1").select(*OUT), f"{BASE}, x AS (SELECT *, row_number() OVER (PARTITION BY \"row\", family, qualifier ORDER BY ts DESC, seq DESC) AS k FROM cells WHERE value < 3000) SELECT {COLS} FROM x WHERE k = 1")
query("filter_random_row", lambda s, sf: event_cells(s, sf, False).select("row").distinct().agg(F.avg(f.RandomRowFilter(0.5, 1).include().cast("int")).between(0.2, 0.8).alias("about_half")), "SELECT true AS about_half")


def _labelled(s, sf):
    cells = event_cells(s, sf, False)
    label = F.element_at(F.array(F.lit("secret & !public"), F.lit("(admin | staff) & area"), F.lit(""), F.lit("public | area")), (F.col("seq") % 4 + 1).cast("int"))
    return f.VisibilityFilter(["staff", "area"]).apply(cells.withColumn("visibility", label)).select(*OUT)


query("filter_visibility", _labelled, f"{BASE} SELECT {COLS} FROM cells WHERE seq % 4 IN (1, 2, 3)")


def _box(s, sf):
    from rowlattice.functions.zorder import zip_bits

    cells = event_cells(s, sf, False).withColumn("value", zip_bits([F.col("ts"), F.col("value") % 32], 5))
    return f.MultiDimensionFilter([(3, 9), (4, 20)], 5).apply(cells).select("row", "ts", "seq")


query("filter_md_range", _box, f'{BASE} SELECT "row", ts, seq FROM cells WHERE ts BETWEEN 3 AND 9 AND value % 32 BETWEEN 4 AND 20')

# ---- comparators ----
comparator = lambda name, made, condition: query(f"cmp_{name}", over(made), f"{BASE} SELECT {COLS} FROM cells WHERE {condition}")
comparator("binary", f.QualifierFilter(">=", p.Binary("purchase")), "qualifier >= 'purchase'")
comparator("binary_prefix", f.QualifierFilter("<=", p.BinaryPrefix("pu")), "substr(qualifier, 1, 2) <= 'pu'")
comparator("long", f.ValueFilter("<", p.SignedLong(1500)), "value < 1500")
comparator("null", f.ValueFilter("!=", p.Null()), "value IS NOT NULL")
comparator("bit_and", f.ValueFilter("=", p.Bits(6, "AND")), "(value & 6) <> 0")
comparator("bit_or", f.ValueFilter("!=", p.Bits(0, "OR")), "(value | 0) = 0")
comparator("bit_xor", f.ValueFilter("=", p.Bits(655, "XOR")), "xor(value, 655) <> 0")
comparator("regex", f.QualifierFilter("=", p.Regex("i[gc]")), "regexp_matches(qualifier, 'i[gc]')")
comparator("substring", f.QualifierFilter("!=", p.Substring("ICK")), "NOT contains(lower(qualifier), 'ick')")

# ---- the filter language ----
lang = lambda name, text, condition: query(f"lang_{name}", lambda s, sf: filterlang.parse(text).apply(event_cells(s, sf, False)).select(*OUT), f"{BASE} SELECT {COLS} FROM cells WHERE {condition}")
lang("atom", "PrefixFilter('00012')", "starts_with(\"row\", '00012')")
lang("and_or", "PrefixFilter('00001') OR QualifierFilter(=, 'binary:view') AND TimestampsFilter(3, 4)", "starts_with(\"row\", '00001') OR (qualifier = 'view' AND ts IN (3, 4))")
lang("parentheses", "(PrefixFilter('00001') OR QualifierFilter(=, 'binary:view')) AND TimestampsFilter(3, 4)", "(starts_with(\"row\", '00001') OR qualifier = 'view') AND ts IN (3, 4)")
lang("skip", "SKIP QualifierFilter(!=, 'substring:zzz')", "true")
lang("while", "WHILE RowFilter(<, 'binary:000021') AND FamilyFilter(=, 'binary:b')", "\"row\" < '000021' AND family = 'b'")
lang("regex_value", "QualifierFilter(=, 'regexstring:^c.*k$')", "regexp_matches(qualifier, '^c.*k$')")
lang("column_range", "ColumnRangeFilter('click', true, 'purchase', false)", "qualifier >= 'click' AND qualifier < 'purchase'")

query("filter_cells_with_markers", lambda s, sf: f.QualifierFilter("=", p.Binary("view")).apply(event_cells(s, sf)).select(*OUT), f"WITH {CELLS_SQL} SELECT {COLS} FROM cells WHERE qualifier = 'view'")
