from rowlattice.sources.events import event_cells
from rowlattice.streaming import ingest


def test_stateful_counters(spark, sf, tmp_path):
    cells = event_cells(spark, sf, markers=False)
    cells.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = ingest.follow(spark, str(tmp_path / "log"), cells.schema, 1)
    q = ingest.stateful_counters(stream, "qualifier", "value").writeStream.outputMode("update").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["key"]: r["n"] for r in spark.table("counted").groupBy("key").max("n").withColumnRenamed("max(n)", "n").collect()}
    assert got == {r["qualifier"]: r["n"] for r in cells.groupBy("qualifier").count().withColumnRenamed("count", "n").collect()}


def test_watermarked_windows(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "e"))
    stream = ingest.follow(spark, str(tmp_path / "e"), events.schema)
    q = ingest.windows(stream, "ts", "1 day", late="2 days").writeStream.outputMode("append").format("memory").queryName("windowed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windowed").count() > 0


def test_hooks(spark, sf, tmp_path):
    cells = event_cells(spark, sf)
    cells.coalesce(1).write.parquet(str(tmp_path / "log"))
    seen = []
    q = ingest.append_to(ingest.follow(spark, str(tmp_path / "log"), cells.schema), str(tmp_path / "t"), str(tmp_path / "c"), lambda df: df.filter("family = 'a'"), lambda df, b: seen.append(df.count()))
    q.awaitTermination()
    assert sum(seen) == cells.filter("family = 'a'").count()
