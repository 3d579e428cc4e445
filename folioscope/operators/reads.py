"""Reads of single documents and their revisions, and the states of documents and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Chunks or sections that one read gives; one more tells that there are more.
READ_CAP = 100


def _first_chars(rows: DataFrame, order: list[str], max_chars: int, by: list[str]) -> DataFrame:
    """Rows in order with as much of their text as fits the budget, and text_truncated."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.length("text").cast("long")).over(before), F.lit(0))
    sized = rows.withColumn("spent", spent).where(F.col("spent") < max_chars)
    room = F.least(F.length("text").cast("long"), max_chars - F.col("spent"))
    cut = sized.withColumn("text_truncated", room < F.length("text")).withColumn("text", F.expr("substring(text, 1, int(least(length(text), {} - spent)))".format(int(max_chars))))
    return cut.drop("spent")


def document_chunks(chunks: DataFrame, source_id: str, document_url: str, section_id: int | None = None, max_chars: int = 12_000, cap: int = READ_CAP) -> DataFrame:
    """The chunks of a document (or of one of its sections) in reading order, at most cap, within the budget; more tells
    whether there are others beyond the cap."""
    mine = chunks.where((F.col("source_id") == source_id) & (F.col("document_url") == document_url))
    mine = mine if section_id is None else mine.where(F.col("section_id") == section_id)
    return _capped(mine, max_chars, cap)


def revision_chunks(revision_chunk: DataFrame, revision_id: str, section_id: int | None = None, max_chars: int = 12_000, cap: int = READ_CAP) -> DataFrame:
    """The same for a stored revision."""
    mine = revision_chunk.where(F.col("revision_id") == revision_id)
    mine = mine if section_id is None else mine.where(F.col("section_id") == section_id)
    return _capped(mine, max_chars, cap)


def _capped(mine: DataFrame, max_chars: int, cap: int) -> DataFrame:
    # At most cap + 1 rows.
    probe = mine.orderBy("sequence", "chunk_id").limit(cap + 1).withColumn("one", F.lit(1))
    numbered = probe.withColumn("n", F.row_number().over(Window.partitionBy("one").orderBy("sequence", "chunk_id")))
    more = numbered.withColumn("more", F.max("n").over(Window.partitionBy("one")) > cap).where(F.col("n") <= cap)
    return _first_chars(more, ["n"], max_chars, ["one"]).drop("one", "n")


def whole_document(documents: DataFrame, sections: DataFrame, source_id: str, document_url: str) -> DataFrame:
    """One row: a document with its sections in order."""
    mine = (F.col("source_id") == source_id) & (F.col("document_url") == document_url)
    parts = sections.where(mine).groupBy("source_id", "document_url").agg(
        F.array_sort(F.collect_list(F.struct("section_id", "parent_id", "heading", "heading_level", "anchor", "blocks"))).alias("sections")
    )
    return documents.where(mine).join(parts, ["source_id", "document_url"], "left")


def document_status(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """source_id, document_url, availability, current_revision, graph_version, checked_at, chunks of every document."""
    held = chunks.groupBy("source_id", "document_url").agg(F.count("*").alias("chunks"))
    rows = documents.select("source_id", "document_url", F.coalesce("availability", F.lit("active")).alias("availability"), "current_revision", "graph_version", "checked_at")
    return rows.join(held, ["source_id", "document_url"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))


def source_status(sources: DataFrame, documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """source_id, name, documents, removed, last_checked, active_job of every source."""
    docs = documents.groupBy("source_id").agg(
        F.count_if(F.coalesce("availability", F.lit("active")) != "removed").alias("documents"), F.count_if(F.col("availability") == "removed").alias("removed"), F.max("checked_at").alias("last_checked")
    )
    active = jobs.where("status in ('queued', 'running')").groupBy("source_id").agg(F.max("job_id").alias("active_job"))
    rows = sources.select("source_id", "name").join(docs, "source_id", "left").join(active, "source_id", "left")
    return rows.na.fill(0, ["documents", "removed"])


def named(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """Hits with the name of their source. Hits are few; the sources are read once."""
    return hits.join(sources.select("source_id", F.col("name").alias("source_name")), "source_id", "left")
