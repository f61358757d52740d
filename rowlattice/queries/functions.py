"""Scalar functions, encodings, text files and dumps."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowlattice.functions import codecs as c
from rowlattice.functions import hashes
from rowlattice.functions.visibility import allows
from rowlattice.model import CELL, to_cells
from rowlattice.plans.jobs import copy
from rowlattice.operators.scan import Scan
from rowlattice.queries import query
from rowlattice.sources.events import CELLS_SQL, PUTS_SQL, event_cells
from rowlattice.sources.orders import orders
from rowlattice.sources.places import shared_place
from rowlattice.sources.tables import replay

query("fn_price_date_priority", lambda s, sf: s.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", c.price_cents(F.col("o_totalprice")).alias("t"), c.date_int(F.col("o_orderdate")).alias("d"), c.priority(F.col("o_orderpriority")).alias("p")), "SELECT o_orderkey, CAST(trunc(o_totalprice * 100) AS INTEGER) AS t, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS d, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS p FROM orders")
query("fn_salt", lambda s, sf: s.read.parquet(f"{sf}/orders.parquet").groupBy(c.salt(F.col("o_orderkey"), 10).alias("salt")).agg(F.count("*").alias("n")), "SELECT CAST(o_orderkey % 10 AS INTEGER) AS salt, count(*) AS n FROM orders GROUP BY 1")
query("fn_ordered_encoding", lambda s, sf: event_cells(s, sf, False).select("seq", c.ordered_int_hex(F.col("value") - 5000).alias("k")), f"WITH {PUTS_SQL} SELECT seq, printf('%08X', value - 5000 + 2147483648) AS k FROM cells")
query("fn_ordered_sorts", lambda s, sf: event_cells(s, sf, False).select((F.col("value") - 5000).alias("v")).select("v", c.ordered_long_hex(F.col("v")).alias("k"), c.decode_ordered_long(c.ordered_bytes(F.col("v"))).alias("back")).agg(F.min_by("v", "k").alias("first"), F.max_by("v", "k").alias("last"), F.sum((F.col("v") != F.col("back")).cast("int")).cast("long").alias("lost")), f"WITH {PUTS_SQL} SELECT min(value) - 5000 AS first, max(value) - 5000 AS last, 0::BIGINT AS lost FROM cells")
query("fn_index_key", lambda s, sf: event_cells(s, sf, False).select("seq", c.index_key(F.col("qualifier"), F.col("row")).alias("k")).select("seq", F.replace("k", F.lit("\0"), F.lit("|")).alias("k"), c.index_key_row(F.col("k")).alias("r"), c.index_key_value(F.col("k")).alias("v")), f"WITH {PUTS_SQL} SELECT seq, qualifier || '|' || \"row\" || lpad(CAST(length(\"row\") + 1 AS VARCHAR), 8, '0') AS k, \"row\" AS r, qualifier AS v FROM cells")
query("fn_hashes", lambda s, sf: s.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.md5("c_name").alias("m"), F.sha2("c_name", 256).alias("s")), "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s FROM customer")
query("fn_visibility", lambda s, sf: event_cells(s, sf, False).select("seq", allows("(click | view) & !signup", F.array("qualifier")).alias("ok")), f"WITH {PUTS_SQL} SELECT seq, qualifier IN ('click', 'view') AS ok FROM cells")
query("fn_json_props", lambda s, sf: s.read.parquet(f"{sf}/events.parquet").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n")), "SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1")
query("job_copy_table", lambda s, sf: copy(event_cells(s, sf), Scan(raw=True, start="000010", stop="000020"), {"a": "x"}).select(*CELL), f"WITH {CELLS_SQL} SELECT \"row\", CASE WHEN family = 'a' THEN 'x' ELSE family END AS family, qualifier, ts, seq, type, value FROM cells WHERE \"row\" >= '000010' AND \"row\" < '000020'")
query("job_log_replay", lambda s, sf: replay(event_cells(s, sf).withColumns({"table": F.when(F.col("family") == "a", "t1").otherwise("t2"), "written": F.col("seq")}), 100, 900, {"t1": "n1"}).select("table", "row", "seq"), f"WITH {CELLS_SQL} SELECT 'n1' AS \"table\", \"row\", seq FROM cells WHERE family = 'a' AND seq BETWEEN 100 AND 900")
query("job_index_builder", lambda s, sf: to_cells(orders(s, sf), "row", "f", ["t", "p"]).select("row", "qualifier", c.index_key(F.col("value"), F.col("row").cast("string")).alias("key")).groupBy("qualifier").agg(F.count("key").alias("entries"), F.countDistinct("key").alias("keys")), "SELECT x AS qualifier, count(*) AS entries, count(*) AS keys FROM orders, (VALUES ('t'), ('p')) v(x) GROUP BY 1")


def _round_trip(s, sf):
    """Separated text written and read again, with a bad line."""
    from rowlattice.sources.tables import TextSpec, read_text, write_text

    path = shared_place(s, "text")
    write_text(orders(s, sf).select(F.col("row").cast("string").alias("row"), "d", "st"), path, ["row", "d", "st"])
    return read_text(s, path, TextSpec(("ROW_KEY", "f:d", "f:st"))).select(F.col("row").cast("long").alias("row"), "qualifier", "value")


query("tsv_round_trip", _round_trip, "SELECT o_orderkey AS \"row\", 'd' AS qualifier, strftime(o_orderdate, '%Y%m%d') AS value FROM orders UNION ALL SELECT o_orderkey, 'st', o_orderstatus FROM orders")


def _dump(s, sf):
    from rowlattice.operators.filters import QualifierFilter
    from rowlattice.operators.predicates import Binary
    from rowlattice.sources.tables import export, restore

    path = shared_place(s, "dump")
    export(event_cells(s, sf), path)
    return restore(s, path, {"b": "y"}, QualifierFilter("!=", Binary("view"))).select(*CELL)


query("export_import", _dump, f"WITH {CELLS_SQL} SELECT \"row\", CASE WHEN family = 'b' THEN 'y' ELSE family END AS family, qualifier, ts, seq, type, value FROM cells WHERE qualifier <> 'view'")


def _text_with_cell_options(s, sf):
    """Text whose lines say how long a cell lives, who may see it, and more of it."""
    from rowlattice.operators.filters import VisibilityFilter
    from rowlattice.operators.resolve import unexpired
    from rowlattice.sources.tables import TextSpec, read_text, write_text

    path = shared_place(s, "text")
    wide = orders(s, sf).select(F.col("row").cast("string").alias("row"), "d", (F.col("p") * 10000).alias("ttl"), "st", F.concat(F.lit("who=>"), "ck", F.lit(",p=>"), "p").alias("attributes"), "t")
    write_text(wide, path, wide.columns)
    cells = read_text(s, path, TextSpec(("ROW_KEY", "TS_KEY", "CELL_TTL", "CELL_VISIBILITY", "ATTRIBUTES_KEY", "f:t")))
    seen = VisibilityFilter(["F", "P"]).apply(unexpired(cells, 20000101))
    return seen.select(F.col("row").cast("long").alias("row"), "ts", "ttl", F.element_at("attributes", "who").alias("who"), F.col("value").cast("long").alias("value"))


query("tsv_cell_options", _text_with_cell_options, """WITH o AS (SELECT o_orderkey AS "row", CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT) AS ts, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) * 10000 AS ttl, CAST(o_custkey AS VARCHAR) AS who, CAST(trunc(o_totalprice * 100) AS BIGINT) AS value, o_orderstatus AS st FROM orders)
    SELECT "row", ts, ttl, who, value FROM o WHERE st IN ('F', 'P') AND ts + ttl > 20000101""")

_M = "4294967295"
query("fn_one_at_a_time", lambda s, sf: s.read.parquet(f"{sf}/part.parquet").select("p_partkey", hashes.one_at_a_time(F.col("p_name")).alias("h")), f"""WITH b AS (SELECT p_partkey, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length(p_name) + 1), lambda i: CAST(ord(substr(p_name, i, 1)) AS BIGINT))),
        lambda h, c: list_transform([list_transform([(h + c) & {_M}], lambda x: (x + (x << 10)) & {_M})[1]], lambda y: xor(y, y >> 6))[1]) AS h FROM part),
    c AS (SELECT p_partkey, (h + (h << 3)) & {_M} AS h FROM b), d AS (SELECT p_partkey, xor(h, h >> 11) AS h FROM c)
    SELECT p_partkey, (h + (h << 15)) & {_M} AS h FROM d""")
query("fn_murmur3", lambda s, sf: s.read.parquet(f"{sf}/part.parquet").select("p_partkey", hashes.murmur3(F.col("p_name"), 7).alias("h")))
