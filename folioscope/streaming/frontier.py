"""The durable crawl frontier as a stream of page batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.crawling import frontier_counts
from folioscope.operators.history import upserted
from folioscope.sources.staging import stage
from folioscope.sources.store import Lake

KEYS = ["source_id", "crawl_id", "url"]
#: What a visited page's state makes of its address.
STATUS = {"Fetched": "done", "NotModified": "done", "Blocked": "blocked", "HttpFailure": "failed", "TransportFailure": "failed", "Truncated": "failed", "BodyTooLarge": "failed", "RenderFailure": "failed"}


def visited(pages: DataFrame) -> DataFrame:
    """source_id, crawl_id, url, status, reason of the addresses that a batch of pages has visited."""
    status = F.coalesce(*[F.when(F.col("state") == k, v) for k, v in STATUS.items()], F.lit("skipped"))
    rows = pages.select("source_id", "crawl_id", F.col("requested_url").alias("url"), status.alias("status"), F.col("state_message").alias("reason"))
    return rows.groupBy(*KEYS).agg(F.max(F.struct("status", "reason")).alias("r")).select(*KEYS, "r.status", "r.reason")


def found(links: DataFrame) -> DataFrame:
    """New addresses of source_id, crawl_id, url rows, pending."""
    return links.select(*KEYS).distinct().withColumn("status", F.lit("pending")).withColumn("reason", F.lit(None).cast("string"))


def moved(frontier: DataFrame, pages: DataFrame, links: DataFrame) -> DataFrame:
    """The rows that a batch changes: visited addresses with their status, and those found that are not known yet."""
    seen = visited(pages)
    fresh = found(links).join(frontier.select(*KEYS), KEYS, "left_anti").join(seen.select(*KEYS), KEYS, "left_anti")
    return seen.unionByName(fresh)


def advance(frontier: DataFrame, pages: DataFrame, links: DataFrame) -> DataFrame:
    """The frontier after a batch."""
    return upserted(frontier, moved(frontier, pages, links), KEYS)


def seeded(frontier: DataFrame, source_id: str, crawl_id: str, urls: list[str]) -> DataFrame:
    """The rows to add for the addresses a crawl begins with, unless they are there."""
    rows = frontier.sparkSession.createDataFrame([(source_id, crawl_id, u) for u in urls], "source_id string, crawl_id string, url string")
    return found(rows).join(frontier.select(*KEYS), KEYS, "left_anti")


def run(spark: SparkSession, lake: Lake, pages_path: str, schema: str, links_of, checkpoint: str, files: int = 1):
    """Start the stream: each batch of page files is committed with the frontier it leads to, once.

    links_of(pages) gives the source_id, crawl_id, url rows that a batch's pages link to. A batch that was
    committed before the stream broke off is known by its number and not applied again.
    """

    def apply(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:

            def change(base):
                rows = stage(moved(lake.read("crawl_url", base), batch, links_of(batch)), "frontier")
                return {"merge": {"crawl_url": (rows, rows.select(*KEYS), KEYS)}, "append": {"page_outcome": batch}, "batch": f"frontier-{number}"}

            lake.transact(change)
        finally:
            batch.unpersist()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(pages_path)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_urls(stream: DataFrame) -> DataFrame:
    """Addresses of a stream as they first occur."""
    return stream.select(*KEYS).dropDuplicates(KEYS)


def running_counts(stream: DataFrame) -> DataFrame:
    """Counts of each state for each crawl, updated as pages come in."""
    return frontier_counts(stream, ["source_id", "crawl_id"])


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and the sum of their values for each type and hour, closed when nothing of it can come any more."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("window_start"), "event_type", "events", "total"
    )
