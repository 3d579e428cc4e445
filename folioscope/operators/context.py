"""Putting found chunks and their neighbours into a bounded context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def neighbours(hits: DataFrame, chunks: DataFrame, radius: int = 1) -> DataFrame:
    """hit_no, distance and the chunk columns for every chunk up to radius places from a hit in its document.

    The band join on the place is an equi-join: each hit is repeated for the places it wants.
    """
    wanted = hits.select(
        "hit_no", "source_id", "document_url", F.col("sequence").alias("center"),
        F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("sequence") - radius), F.col("sequence") + radius)).alias("sequence"),
    )
    return wanted.join(chunks, ["source_id", "document_url", "sequence"]).withColumn("distance", F.abs(F.col("sequence") - F.col("center")))


def stale_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits whose chunk is gone or has other content."""
    return hits.join(chunks.select("chunk_id", "content_sha256"), ["chunk_id", "content_sha256"], "left_anti")


def budgeted(around: DataFrame, max_chars: int = 12_000, max_chunks: int = 50, max_chunk_chars: int = 4_000, by: tuple[str, ...] = ()) -> DataFrame:
    """What of each chunk fits: found chunks first in order of the hits, then neighbours by distance.

    A chunk wanted by several hits counts once. Every chunk takes what it needs of the rest of the budget,
    so the characters taken follow from the running sum of lengths. `by` names columns that each have a budget.
    """
    first = Window.partitionBy(*by, "chunk_id").orderBy(F.col("distance") > 0, "distance", "hit_no", "sequence")
    once = around.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    order = (F.col("distance") > 0, F.when(F.col("distance") > 0, F.col("distance")), F.col("hit_no"), F.col("sequence"), F.col("chunk_id"))
    whole = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    length = F.least(F.length("text"), F.lit(max_chunk_chars)).cast("long")
    sized = once.withColumn("place", F.row_number().over(whole)).where(F.col("place") <= max_chunks).withColumn("wants", length)
    spent = F.coalesce(F.sum("wants").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = sized.withColumn("spent", spent).where(F.col("spent") < max_chars)
    takes = F.least(F.col("wants"), max_chars - F.col("spent"))
    return taken.withColumn("takes", takes).withColumn("truncated", F.col("takes") < F.length("text"))


def passages(taken: DataFrame) -> DataFrame:
    """source_id, document_url, first_place, chunk_ids and text of each document in the context, in reading order."""
    parts = F.array_sort(F.collect_list(F.struct("sequence", "chunk_id", F.expr("substring(text, 1, int(takes))").alias("text"))))
    return taken.groupBy("source_id", "document_url").agg(F.min("place").alias("first_place"), parts.alias("parts")).select(
        "source_id", "document_url", "first_place", F.col("parts.chunk_id").alias("chunk_ids"), F.array_join("parts.text", "\n\n").alias("text")
    )


def verified(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits (hit_no, chunk_id, content_sha256, ...) whose chunk still has that content, with its place."""
    known = chunks.select("chunk_id", "content_sha256", "source_id", "document_url", "sequence")
    return hits.select("hit_no", "chunk_id", "content_sha256").join(known, ["chunk_id", "content_sha256"])


def report(hits: DataFrame, valid: DataFrame, around: DataFrame, taken: DataFrame) -> DataFrame:
    """One row: skipped_stale_hits, deduplicated_chunks (wanted more than once), omitted_chunks, total_text_chars and
    budget_exhausted: whether anything was left out or cut."""
    counts = [
        hits.agg(F.count("*").alias("asked"), F.lit(1).alias("one")), valid.agg(F.count_distinct("hit_no").alias("good"), F.lit(1).alias("one")),
        around.agg(F.count("*").alias("wanted"), F.count_distinct("chunk_id").alias("distinct"), F.lit(1).alias("one")),
        taken.agg(F.count("*").alias("held"), F.coalesce(F.sum("takes"), F.lit(0)).alias("total_text_chars"), F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("cut"), F.lit(1).alias("one")),
    ]
    row = counts[0]
    for c in counts[1:]:
        row = row.join(c, "one")
    omitted = F.col("distinct") - F.col("held")
    return row.select(
        (F.col("asked") - F.col("good")).alias("skipped_stale_hits"), (F.col("wanted") - F.col("distinct")).alias("deduplicated_chunks"), omitted.alias("omitted_chunks"),
        "total_text_chars", (F.col("cut") | (omitted > 0)).alias("budget_exhausted"),
    )


def with_matches(found: DataFrame, valid: DataFrame, taken: DataFrame) -> DataFrame:
    """Passages with matches: the hits of their document, each with whether its own text was left out."""
    shown = taken.select("chunk_id", F.lit(False).alias("text_omitted")).distinct()
    each = valid.join(shown, "chunk_id", "left").withColumn("text_omitted", F.coalesce("text_omitted", F.lit(True)))
    matches = each.groupBy("source_id", "document_url").agg(F.array_sort(F.collect_list(F.struct("hit_no", "chunk_id", "text_omitted"))).alias("matches"))
    return found.join(matches, ["source_id", "document_url"], "left")
