from datetime import datetime

from pyspark.sql import functions as F

from folioscope.schema import TABLES
from folioscope.sources.store import Lake
from folioscope.streaming import frontier

PAGES = TABLES["page_outcome"]


def pages(spark, rows):
    return spark.createDataFrame([(i, "s", "c", i, u, u, datetime(2025, 1, 1), 200, [], b"", False, state, None) for i, (u, state) in enumerate(rows)], PAGES)


def test_frontier_visits_each_address_once(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    src = str(tmp_path / "pages")
    pages(spark, [("u0", "Fetched"), ("u1", "HttpFailure")]).coalesce(1).write.parquet(src)
    pages(spark, [("u2", "Blocked")]).coalesce(1).write.mode("append").parquet(src)
    links = lambda p: p.where("state = 'Fetched'").select("source_id", "crawl_id", F.explode(F.array(F.lit("u2"), F.lit("u3"), F.lit("u0"))).alias("url"))
    for _ in range(2):
        q = frontier.run(spark, lake, src, PAGES, links, str(tmp_path / "cp"))
        q.awaitTermination()
    got = {r.url: r.status for r in lake.read("crawl_url").collect()}
    assert got == {"u0": "done", "u1": "failed", "u2": "blocked", "u3": "pending"}
    assert lake.read("page_outcome").count() == 3


def test_windows_of_a_stream_equal_the_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    src = str(tmp_path / "events")
    events.orderBy("ts").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(events.schema).parquet(src)
    q = frontier.event_windows(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.window_start, r.event_type): r.events for r in spark.table("w").collect()}
    batch = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").count()
    assert got == {(r.w.start, r.event_type): r["count"] for r in batch.collect()}
