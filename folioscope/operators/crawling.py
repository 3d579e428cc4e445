"""Rows of captured pages: their state, what may be crawled, and summaries of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.urls import header, in_scope, path_depth, without_fragment
from folioscope.schema import FRONTIER_STATES, MAX_INPUT_BYTES


def page_state(blocked: Column, transport_error: Column, truncated: Column, body: Column, status: Column, cap: int = MAX_INPUT_BYTES) -> Column:
    """The first that applies: Blocked, TransportFailure, Truncated, BodyTooLarge, HttpFailure, Fetched."""
    return (
        F.when(blocked, "Blocked").when(transport_error.isNotNull(), "TransportFailure").when(truncated, "Truncated")
        .when(F.coalesce(F.length(body), F.lit(0)) > cap, "BodyTooLarge").when(~status.between(200, 299), "HttpFailure").otherwise("Fetched")
    )


def media_type(headers: Column) -> Column:
    return F.lower(F.trim(F.regexp_extract(F.coalesce(header(headers, "content-type"), F.lit("")), "^([^;]*)", 1)))


def charset(headers: Column) -> Column:
    said = F.regexp_extract(F.lower(F.coalesce(header(headers, "content-type"), F.lit(""))), "charset\\s*=\\s*[\"']?([^\\s;\"']+)", 1)
    return F.nullif(said, F.lit(""))


def rejection(pages: DataFrame) -> Column:
    """Why a page's metadata rule out its extraction, in order; null if nothing does."""
    return (
        F.when((F.col("state") != "Fetched") | ~F.col("status").between(200, 299) | F.coalesce("content_truncated", F.lit(False)), "FetchNotSuccessful")
        .when(F.length("raw_body") > MAX_INPUT_BYTES, "InputTooLarge")
        .when(~media_type(F.col("headers")).isin("", "text/html", "application/xhtml+xml"), "UnsupportedContentType")
        .when(~F.coalesce(charset(F.col("headers")), F.lit("utf-8")).isin("utf-8", "utf8", "us-ascii"), "UnsupportedEncoding")
        .when(F.coalesce(F.length("raw_body"), F.lit(0)) == 0, "EmptyContent")
    )


def within_budget(pages: DataFrame, max_pages: int) -> DataFrame:
    """Pages with delivered: whether they came within the budget of their crawl, in order of arrival."""
    order = Window.partitionBy("source_id", "crawl_id").orderBy("fetched_at", "page_id")
    return pages.withColumn("delivered", F.row_number().over(order) <= max_pages)


def redirect_verdict(hops: DataFrame, root: str, max_redirects: int, max_depth: int) -> DataFrame:
    """Redirects (requested, target, hop) with the reason that stops each: OutOfScope, TooManyRedirects, TooDeep, or null."""
    reason = (
        F.when(~in_scope(F.col("target"), root), "OutOfScope").when(F.col("hop") > max_redirects, "TooManyRedirects").when(path_depth(F.col("target")) > max_depth, "TooDeep")
    )
    return hops.withColumn("reason", reason)


def discovered(links: DataFrame, root: str) -> DataFrame:
    """The addresses of links (url) in scope, without fragments, each once."""
    return links.select(without_fragment(F.col("url")).alias("url")).where(in_scope(F.col("url"), root)).distinct()


def markdown_links(text: Column, most: int = 1_000) -> Column:
    return F.slice(F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1)), 1, most)


def sitemap_links(xml: Column, most: int = 1_000) -> Column:
    """struct<pages, maps>: the addresses of a site map's pages and of nested maps; none where it declares a document type."""
    clean = F.when(xml.contains("<!DOCTYPE"), F.lit("")).otherwise(xml)
    found = lambda tag: F.transform(
        F.slice(F.regexp_extract_all(clean, F.lit(rf"(?s)<{tag}>.*?<loc>\s*([^<\s]+)\s*</loc>.*?</{tag}>"), F.lit(1)), 1, most),
        lambda u: F.replace(F.replace(u, F.lit("&amp;"), F.lit("&")), F.lit("&apos;"), F.lit("'")),
    )
    return F.struct(found("url").alias("pages"), found("sitemap").alias("maps"))


def run_summary(pages: DataFrame) -> DataFrame:
    """source_id, crawl_id, pages, fetched, failed, blocked, unchanged, bytes, first_fetched, last_fetched of each crawl."""
    state = F.col("state")
    return pages.groupBy("source_id", "crawl_id").agg(
        F.count("*").alias("pages"), F.count_if(state == "Fetched").alias("fetched"),
        F.count_if(state.isin("HttpFailure", "TransportFailure", "RenderFailure", "Truncated", "BodyTooLarge")).alias("failed"),
        F.count_if(state == "Blocked").alias("blocked"), F.count_if(state == "NotModified").alias("unchanged"),
        F.coalesce(F.sum(F.length("raw_body").cast("long")), F.lit(0)).alias("bytes"), F.min("fetched_at").alias("first_fetched"), F.max("fetched_at").alias("last_fetched"),
    )


def frontier_counts(frontier: DataFrame, by: list[str]) -> DataFrame:
    """A column of each state's count, 0 where there is none."""
    return frontier.groupBy(*by).agg(*[F.count_if(F.col("status") == s).alias(s) for s in FRONTIER_STATES])


def next_pending(frontier: DataFrame, limit: int = 20) -> DataFrame:
    return frontier.where("status = 'pending'").orderBy("url").limit(min(limit, 100))


def latest_run(runs: DataFrame) -> DataFrame:
    order = Window.partitionBy("source_id").orderBy(F.desc("last_fetched"), F.desc("crawl_id"))
    return runs.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def with_audit(pages: DataFrame, audit: DataFrame) -> DataFrame:
    """Pages with what an audit row of the same requested_url (status, headers, raw_body) says instead, where it does."""
    other = audit.select("source_id", "crawl_id", "requested_url", *[F.col(c).alias(f"audit_{c}") for c in ("status", "headers", "raw_body")])
    joined = pages.join(other, ["source_id", "crawl_id", "requested_url"], "left")
    for c in ("status", "headers", "raw_body"):
        joined = joined.withColumn(c, F.coalesce(f"audit_{c}", c))
    return joined.drop("audit_status", "audit_headers", "audit_raw_body")


def robots_audit(frontier: DataFrame, capacity: int = 10_000) -> DataFrame:
    """One row for each crawl: blocked (addresses that robots rules keep out) and audit_overflow, whether more than capacity."""
    blocked = frontier.where("status = 'blocked' and reason = 'Robots'").groupBy("source_id", "crawl_id").agg(F.count("*").alias("blocked"))
    return blocked.withColumn("audit_overflow", F.col("blocked") > capacity)


def accumulated(batches: DataFrame) -> DataFrame:
    """source_id, crawl_id and the running totals over the batches of a crawl (pages, bytes, first_fetched, delivered)."""
    return batches.groupBy("source_id", "crawl_id").agg(
        F.sum("pages").alias("pages"), F.sum("bytes").alias("bytes"), F.min("first_fetched").alias("first_fetched"), F.bool_and("delivered").alias("delivered")
    )
