"""Lines that one source repeats over many of its documents, and texts without them.

Null texts and null lines have no lines; an empty text has one empty line, which is never a case. A null
source or address is a source or address of its own. Rows with one chunk_id are one chunk. Extra columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import spaced_words
from folioscope.sources.staging import small_or_shuffled, stage


def _lines(chunks: DataFrame) -> DataFrame:
    line = F.lower(F.col("line"))
    title = F.lower(F.col("title"))
    blanked = F.when(F.length(title) > 0, F.replace(line, title, F.lit(" "))).otherwise(line)
    return chunks.select(
        "chunk_id", "source_id", "document_url", "title", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")
    ).select("chunk_id", "source_id", "document_url", "line_no", spaced_words(blanked).alias("said"))


def _hashed(chunks: DataFrame, min_words: int) -> DataFrame:
    """Lines of at least min_words words, each as two independent 64-bit hashes of its words."""
    said = F.col("said")
    count = F.length(said) - F.length(F.replace(said, F.lit(" "), F.lit(""))) + 1
    return _lines(chunks).where(count >= min_words).select(
        "chunk_id", "line_no", F.col("source_id"), F.xxhash64("document_url").alias("doc"),
        F.xxhash64(said).alias("h1"), F.xxhash64(F.lit(7), said).alias("h2"),
    )


def frequent_lines(chunks: DataFrame, min_docs: int = 3, min_share: float = 0.03, min_words: int = 3) -> DataFrame:
    """source_id, h1, h2, n_docs of the lines in at least min_docs and min_share of a source's documents."""
    chunks = chunks.select("chunk_id", "source_id", "document_url", "title", "text")
    seen = _hashed(chunks, min_words).groupBy("source_id", "h1", "h2", "doc").agg(F.lit(1).alias("one"))
    counts = seen.groupBy("source_id", "h1", "h2").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)
    docs = chunks.select("source_id", F.xxhash64("document_url").alias("doc")).distinct().groupBy("source_id").agg(F.count("*").alias("of_docs"))
    docs = docs.withColumnRenamed("source_id", "doc_source")
    return (
        counts.join(docs, F.col("source_id").eqNullSafe(F.col("doc_source")))
        .where(F.col("n_docs") >= min_share * F.col("of_docs"))
        .select("source_id", "h1", "h2", "n_docs")
    )


def repeated_lines(chunks: DataFrame, min_docs: int = 3, min_share: float = 0.03, min_words: int = 3) -> DataFrame:
    """chunk_id, line_no of every frequent line of every chunk."""
    frequent = stage(frequent_lines(chunks, min_docs, min_share, min_words), "lines")
    frequent = small_or_shuffled(frequent.select(F.col("source_id").alias("of_source"), "h1", "h2"))
    lines = _hashed(chunks.select("chunk_id", "source_id", "document_url", "title", "text"), min_words)
    on = [lines.h1 == frequent.h1, lines.h2 == frequent.h2, lines.source_id.eqNullSafe(frequent.of_source)]
    return lines.join(frequent, on, "left_semi").select("chunk_id", "line_no").distinct()


def _kept(text: Column, gone: Column) -> Column:
    lines = F.split(text, "\n", -1)
    return F.when(gone.isNull(), text).otherwise(
        F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(gone, i)), "\n")
    )


def without_repeated_lines(chunks: DataFrame, **limits: float) -> DataFrame:
    """chunk_id, text without its frequent lines, lines_removed: one row for each chunk_id.

    The line numbers of a chunk are gathered (as many as its own text has lines), never a source's texts.
    """
    gone = repeated_lines(chunks, **limits).groupBy("chunk_id").agg(F.array_sort(F.collect_set("line_no")).alias("gone"))
    one = chunks.groupBy("chunk_id").agg(F.max_by("text", F.struct("crawled_at", "text")).alias("text"))
    joined = one.join(gone.withColumnRenamed("chunk_id", "gone_id"), F.col("chunk_id").eqNullSafe(F.col("gone_id")), "left")
    return joined.select(
        "chunk_id", _kept(F.col("text"), F.col("gone")).alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("lines_removed")
    )
