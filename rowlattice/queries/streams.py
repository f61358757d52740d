"""Streams driven to their end over the events, and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowlattice.queries import query
from rowlattice.sources.events import event_cells
from rowlattice.sources.places import shared_place
from rowlattice.streaming import ingest


def _work(s, name):
    return shared_place(s, f"stream-{name}")


def _log(s, sf, files=4):
    """The event cells as a log of a few files."""
    place = _work(s, "log")
    event_cells(s, sf).repartitionByRange(files, "seq").write.parquet(place)
    return place


def _counter(s, sf):
    place, out = _log(s, sf), _work(s, "counts")
    stream = ingest.follow(s, place, event_cells(s, sf).schema, 1).filter("type = 0")
    q = ingest.counters(stream, ["family", "qualifier"], "value").writeStream.outputMode("complete").option("checkpointLocation", _work(s, "state")).trigger(availableNow=True).foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return s.read.parquet(out)


query("stream_counter", _counter, """SELECT CASE WHEN event_type IN ('click', 'view') THEN 'a' ELSE 'b' END AS family, event_type AS qualifier, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY ALL""")


def _resolved(s, sf):
    table = _work(s, "table")
    q = ingest.append_to(ingest.follow(s, _log(s, sf), event_cells(s, sf).schema, 1), table, _work(s, "commits"))
    q.awaitTermination()
    return ingest.state(s, table, max_versions=2).select("row", "family", "qualifier", "ts", "seq", "value")


from rowlattice.queries.reads import ranked_sql  # noqa: E402

query("stream_ingest_resolve", _resolved, ranked_sql("true", 2))
events = lambda s, sf: s.read.parquet(f"{sf}/events.parquet")
query("window_tumbling", lambda s, sf: ingest.windows(events(s, sf), "ts", "1 day", keys=("event_type",)).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n"), "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
query("window_sliding", lambda s, sf: ingest.windows(events(s, sf), "ts", "2 days", "1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n"), "SELECT strftime(d, '%Y-%m-%d') AS day, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS d FROM events) GROUP BY 1")
query("window_session", lambda s, sf: ingest.sessions(events(s, sf), "ts", "4 hours", ("user_id",)).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest")), "WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 4 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1")
