"""Revisions of documents and what a recrawl changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.urls import header, in_scope, valid_etag, valid_http_date
from folioscope.schema import CHUNKING_VERSION, EXTRACTION_VERSION, GRAPH_VERSION, NORMALIZATION_VERSION, REVISION_TAG


def revision_id(target_chars: int | Column = 2_400) -> Column:
    parts = [F.lit(REVISION_TAG), F.col("source_id"), F.col("document_url"), F.col("normalized_sha256"), F.lit(target_chars) if isinstance(target_chars, int) else target_chars]
    return F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 256)


def revisions(states: DataFrame) -> DataFrame:
    """source_id, document_url, normalized_sha256, revision_id, sequence, first_stored, is_current of states with stored_at.

    A content is stored once for a document: going back to an earlier one makes that the current revision again.
    """
    states = states.where("normalized_sha256 is not null")
    first = states.groupBy("source_id", "document_url", "normalized_sha256").agg(F.min("stored_at").alias("first_stored"))
    order = Window.partitionBy("source_id", "document_url").orderBy("first_stored", "normalized_sha256")
    last = states.groupBy("source_id", "document_url").agg(F.max(F.struct("stored_at", "normalized_sha256")).alias("last"))
    rows = first.withColumn("sequence", F.row_number().over(order).cast("long")).withColumn("revision_id", revision_id())
    return rows.join(last, ["source_id", "document_url"]).withColumn("is_current", F.col("last.normalized_sha256") == F.col("normalized_sha256")).drop("last")


def page_after(rows: DataFrame, key: str, after: str | None, limit: int) -> DataFrame:
    """The next rows after a key, with next_cursor: the last key if there are more."""
    rest = rows if after is None else rows.where(F.col(key) > after)
    probe = rest.orderBy(key).limit(limit + 1)
    numbered = probe.withColumn("n", F.row_number().over(Window.orderBy(key)))
    total = F.max("n").over(Window.partitionBy())
    kept = numbered.withColumn("total", total).where(F.col("n") <= limit)
    return kept.withColumn("next_cursor", F.when((F.col("total") > limit) & (F.col("n") == limit), F.col(key))).drop("n", "total")


def change_kind(force: bool = False) -> Column:
    """What became of a fetched page (status, state, requested_url, final_url, raw_sha256, normalized_sha256) against what
    is stored (old_raw_sha256, old_normalized_sha256, old_availability, compatible; nulls if unknown)."""
    known = F.col("old_raw_sha256").isNotNull() | F.col("old_normalized_sha256").isNotNull()
    there = F.coalesce("old_availability", F.lit("active")) != "removed"
    reuse = known & there & F.coalesce("compatible", F.lit(True)) & F.lit(not force)
    gone = F.col("status").isin(404, 410) & (F.col("state") == "HttpFailure") & (F.col("requested_url") == F.col("final_url"))
    return (
        F.when(gone & known & F.lit(not force), "removed")
        .when(F.col("state") == "NotModified", F.when(reuse, "not_modified").when(known, "reprocessed").otherwise("rejected"))
        .when(F.col("state") != "Fetched", "rejected")
        .when(reuse & (F.col("raw_sha256") == F.col("old_raw_sha256")), "raw_unchanged")
        .when(reuse & (F.col("normalized_sha256") == F.col("old_normalized_sha256")), "normalized_unchanged")
        .when(~known, "added")
        .when(F.col("normalized_sha256") == F.col("old_normalized_sha256"), "reprocessed")
        .otherwise("changed")
    )


def merged_headers(base: Column, fresh: Column) -> Column:
    """The base headers that the fresh ones don't repeat, then the fresh ones."""
    names = F.transform(fresh, lambda h: F.lower(h["name"]))
    return F.concat(F.filter(base, lambda h: ~F.array_contains(names, F.lower(h["name"]))), fresh)


def canonical(pages: DataFrame) -> DataFrame:
    """One page for each final_url, requested directly if any was; is_alias tells where another was left out."""
    order = Window.partitionBy("source_id", "final_url").orderBy(F.col("requested_url") != F.col("final_url"), "requested_url", "page_id")
    whole = Window.partitionBy("source_id", "final_url")
    return pages.withColumn("n", F.row_number().over(order)).withColumn("aliases", F.count("*").over(whole) - 1).where("n = 1").drop("n")


def upserted(base: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """base with the fresh rows in place of those of the same keys; columns that one side lacks are null."""
    kept = base.join(fresh.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def representation(target_chars: int) -> str:
    """All that what is stored of a page depends on besides its bytes."""
    return "/".join((EXTRACTION_VERSION, NORMALIZATION_VERSION, CHUNKING_VERSION, str(target_chars)))


def compatible(target_chars: int) -> Column:
    """Whether a stored document (old_representation, old_graph_version) was made as one would be made now."""
    return F.col("old_representation").eqNullSafe(F.lit(representation(target_chars))) & F.col("old_graph_version").eqNullSafe(F.lit(GRAPH_VERSION))


def conditional_headers(headers: Column) -> Column:
    """array<struct<name, value>> to ask with whether a page has changed: If-None-Match and If-Modified-Since of its valid
    validators, none where it varies by request or may not be stored."""
    etag, date = header(headers, "etag"), header(headers, "last-modified")
    varies = F.length(F.coalesce(header(headers, "vary"), F.lit(""))) > 0
    secret = F.array_contains(F.transform(F.split(F.lower(F.coalesce(header(headers, "cache-control"), F.lit(""))), ","), F.trim), "no-store")
    short = lambda c: F.octet_length(c) <= 4_096
    asked = F.array(
        F.when(etag.isNotNull() & short(etag) & valid_etag(etag), F.struct(F.lit("If-None-Match").alias("name"), etag.alias("value"))),
        F.when(date.isNotNull() & short(date) & valid_http_date(date), F.struct(F.lit("If-Modified-Since").alias("name"), date.alias("value"))),
    )
    none = F.array().cast("array<struct<name:string,value:string>>")
    return F.when(varies | secret, none).otherwise(F.filter(asked, lambda h: h.isNotNull()))


def cached_requests(documents: DataFrame, source_id: str, root: str, most: int = 10_000) -> DataFrame:
    """url, ask_with of the stored pages of a source in scope: what a crawl may ask for conditionally, at most `most`."""
    rows = documents.where((F.col("source_id") == source_id) & (F.coalesce("availability", F.lit("active")) != "removed") & in_scope(F.col("document_url"), root))
    return rows.select(F.col("document_url").alias("url"), conditional_headers(F.col("headers")).alias("ask_with")).orderBy("url").limit(most)


def retained(pages: DataFrame, documents: DataFrame, source_id: str, root: str, max_pages: int = 10_000) -> DataFrame:
    """The stored bytes of a source's documents in scope that can be processed again offline: the last fetched page of
    each whose bytes are still those of its document."""
    live = documents.where((F.col("source_id") == source_id) & (F.coalesce("availability", F.lit("active")) != "removed") & in_scope(F.col("document_url"), root))
    good = pages.where((F.col("state") == "Fetched") & (F.col("status") == 200)).withColumn("raw_sha256", F.sha2("raw_body", 256))
    mine = good.join(live.select("source_id", F.col("document_url").alias("final_url"), "raw_sha256"), ["source_id", "final_url", "raw_sha256"], "left_semi")
    order = Window.partitionBy("source_id", "final_url").orderBy(F.desc("fetched_at"), "requested_url")
    return mine.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n", "raw_sha256").orderBy("final_url").limit(max_pages)


def conflicting(pages: DataFrame) -> DataFrame:
    """source_id, final_url of pages that came several times with different bytes: such a batch can't be stored."""
    got = pages.where("state = 'Fetched'").groupBy("source_id", "final_url").agg(F.count_distinct(F.sha2("raw_body", 256)).alias("contents"))
    return got.where("contents > 1").select("source_id", "final_url")


def unvisited_known(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Stored documents, not removed, that no page of a crawl has visited."""
    live = documents.where(F.coalesce("availability", F.lit("active")) != "removed").select("source_id", "document_url")
    seen = pages.select("source_id", F.col("requested_url").alias("document_url")).unionByName(pages.select("source_id", F.col("final_url").alias("document_url")))
    return live.join(seen, ["source_id", "document_url"], "left_anti")


def known_states(documents: DataFrame, urls: DataFrame) -> DataFrame:
    """What is stored of each of some addresses (source_id, document_url): hashes, availability, versions, with known."""
    facts = documents.select("source_id", "document_url", "raw_sha256", "normalized_sha256", "availability", "representation", "graph_version", "checked_at", F.lit(True).alias("known"))
    return urls.join(facts, ["source_id", "document_url"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def recrawl_report(outcome: DataFrame) -> DataFrame:
    """One row: a count of each kind of change."""
    kinds = ("added", "changed", "reprocessed", "not_modified", "raw_unchanged", "normalized_unchanged", "removed", "rejected")
    return outcome.agg(*[F.count_if(F.col("change_kind") == k).alias(k) for k in kinds])


def run_outcome(documents: int, rejected: int, unvisited: int, delivered: bool, embedding_gaps: int = 0) -> str:
    """completed where a run left nothing out; partial where it did; failed where it has nothing to show."""
    if documents == 0:
        return "failed"
    return "completed" if not (rejected or unvisited or embedding_gaps) and delivered else "partial"
