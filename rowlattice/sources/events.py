"""Cells of the events table: days as versions, event ids as sequence numbers, and delete markers of its errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_cells(spark: SparkSession, sf_dir: str, markers: bool = True) -> DataFrame:
    """row: user; family: a (click, view) or b; ts: day; seq: event id; value: cents.

    An error event is a marker on a column chosen by its id: of one version, a
    column, a family, or a family's version.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    error = F.col("event_type") == "error"
    q = F.when(error, F.element_at(F.array(*map(F.lit, ("click", "view", "signup", "purchase"))), (F.floor(i / 4) % 4 + 1).cast("int"))).otherwise(F.col("event_type"))
    rows = e.select(
        F.lpad(F.col("user_id").cast("string"), 6, "0").alias("row"),
        F.when(q.isin("click", "view"), "a").otherwise("b").alias("family"),
        q.alias("qualifier"),
        F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("ts"),
        i.alias("seq"),
        F.when(error, (i % 4 + 1).cast("int")).otherwise(0).alias("type"),
        F.when(~error, F.round(F.col("value") * 100).cast("long")).alias("value"),
    )
    return rows if markers else rows.filter("type = 0")


#: The same for DuckDB: a common table expression named cells.
CELLS_SQL = """cells AS (
  SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') AS "row",
         CASE WHEN q IN ('click', 'view') THEN 'a' ELSE 'b' END AS family, q AS qualifier,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS ts, event_id AS seq,
         CASE WHEN event_type = 'error' THEN CAST(event_id % 4 + 1 AS INTEGER) ELSE 0 END AS type,
         CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS BIGINT) END AS value
  FROM (SELECT *, CASE WHEN event_type = 'error' THEN (['click', 'view', 'signup', 'purchase'])[event_id // 4 % 4 + 1] ELSE event_type END AS q FROM events)
)"""
PUTS_SQL = CELLS_SQL.replace("cells AS (", "allcells AS (") + ", cells AS (SELECT * FROM allcells WHERE type = 0)"
#: Puts that no marker hides.
VISIBLE_SQL = (
    CELLS_SQL
    + """, visible AS (
  SELECT c.* FROM cells c WHERE c.type = 0
  AND NOT EXISTS (SELECT 1 FROM cells m WHERE m."row" = c."row" AND m.family = c.family AND (
        (m.type = 1 AND m.qualifier = c.qualifier AND m.ts = c.ts) OR (m.type = 2 AND m.qualifier = c.qualifier AND m.ts >= c.ts)
     OR (m.type = 3 AND m.ts >= c.ts) OR (m.type = 4 AND m.ts = c.ts)))
)"""
)
