"""Reading captured pages, manifests and tables, and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.urls import joined_url
from folioscope.operators.crawling import markdown_links, sitemap_links

FORMATS = ("parquet", "orc", "json", "csv", "text", "binaryFile")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def pages_from_files(spark: SparkSession, path: str, source_id: str, crawl_id: str, root_url: str) -> DataFrame:
    """A folder of saved HTML files as page_outcome rows; a file's path below the folder is its address."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.htm*").load(path)
    below = F.regexp_replace("path", rf"^.*?{path.rstrip('/')}/", "")
    url = F.concat(F.lit(root_url.rstrip("/") + "/"), below)
    return files.select(
        F.lit(source_id).alias("source_id"), F.lit(crawl_id).alias("crawl_id"), url.alias("requested_url"), url.alias("final_url"),
        F.col("modificationTime").alias("fetched_at"), F.lit(200).alias("status"), F.array().cast("array<struct<name:string,value:binary>>").alias("headers"),
        F.col("content").alias("raw_body"), F.lit(False).alias("content_truncated"), F.lit("Fetched").alias("state"), F.lit(None).cast("string").alias("state_message"),
        F.xxhash64("path").alias("page_id"),
    )


def manifest_urls(manifests: DataFrame) -> DataFrame:
    """source_id, url from rows of source_id, name, text and the address (base_url) of llms.txt and sitemap files, each
    address once. Relative ones are resolved against the file's own address; those that can't be are left out."""
    linked = manifests.where(~F.col("name").endswith(".xml")).select("source_id", "base_url", F.explode(markdown_links(F.col("text"))).alias("href")).select("source_id", joined_url("base_url", "href").alias("url"))
    mapped = manifests.where(F.col("name").endswith(".xml")).select("source_id", "base_url", F.explode(sitemap_links(F.col("text"))["pages"]).alias("href")).select("source_id", joined_url("base_url", "href").alias("url"))
    return linked.unionByName(mapped).where("url is not null").distinct()


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text for each row."""
    return df.select(F.to_json(F.struct("*")).alias("json"))
