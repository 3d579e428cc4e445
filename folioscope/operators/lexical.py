"""Keyword and phrase search with BM25 over the text and the title of chunks.

Both fields are searched on their own: a chunk matches in a field that holds every term of the query. The
stronger field gives the score. Statistics are those of the whole corpus, whatever the filters; filters
apply before any limit.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import tokens
from folioscope.functions.urls import under_prefix

K1, B = 1.2, 0.75
FIELDS = ("text", "title")
TOKEN = re.compile(r"[!-/:-@\[-`{-~]|[^\s!-/:-@\[-`{-~]+")
IDENTIFIER = re.compile(r"^[^\W\d]\w*(?:::[^\W\d]\w*)+(?:\(\))?$")


@dataclass(frozen=True)
class Filter:
    """source_id, a url prefix, a heading and the earliest crawl time (unix seconds, inclusive)."""

    source_id: str | None = None
    url_prefix: str | None = None
    heading: str | None = None
    crawled_after: int | None = None

    def column(self) -> Column:
        keep = F.lit(True)
        if self.source_id:
            keep &= F.col("source_id") == self.source_id
        if self.url_prefix:
            keep &= under_prefix(F.col("document_url"), self.url_prefix)
        if self.heading:
            wanted = self.heading.strip().lower()
            keep &= F.exists("heading_path", lambda h: F.lower(F.trim(h)) == wanted)
        if self.crawled_after is not None:
            keep &= F.unix_seconds(F.col("crawled_at").cast("timestamp")) >= self.crawled_after
        return keep


def query_terms(query: str) -> list[str]:
    return sorted(set(TOKEN.findall(query.lower())))


def is_identifier(query: str) -> bool:
    return bool(IDENTIFIER.match(query.strip()))


def exact_pattern(literal: str) -> str:
    """The literal where no letter, digit or underscore touches it (nor a colon on its right)."""
    body = re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", literal.strip())
    return rf"(?iu)(?<![\p{{L}}\p{{N}}_]){body}(?![\p{{L}}\p{{N}}_:])"


def latest_chunks(chunks: DataFrame, *columns: str) -> DataFrame:
    """One row for each chunk_id: the last crawl's."""
    names = [c for c in dict.fromkeys(("crawled_at", *columns)) if c != "chunk_id"]
    return chunks.groupBy("chunk_id").agg(F.max(F.struct(*names)).alias("r")).select("chunk_id", *[F.col(f"r.{c}").alias(c) for c in names])


def postings(chunks: DataFrame) -> DataFrame:
    """field, chunk_id, term, tf, length: the index to keep where many queries are asked."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("said")) for f in FIELDS])
    rows = chunks.select("chunk_id", F.explode(fields).alias("f")).select("chunk_id", "f.field", "f.said", F.size("f.said").alias("length"))
    return rows.select("field", "chunk_id", "length", F.explode("said").alias("term")).groupBy("field", "chunk_id", "term", "length").agg(F.count("*").alias("tf"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """field, docs, mean_length: one row for each field."""
    parts = [F.avg(F.size(tokens(F.col(f)))).alias(f) for f in FIELDS]
    row = chunks.agg(F.count("*").alias("docs"), *parts)
    return row.select("docs", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("mean_length")) for f in FIELDS])).alias("s")).select(
        "s.field", "docs", "s.mean_length"
    )


def term_stats(chunks: DataFrame) -> DataFrame:
    """field, term, doc_count, total_count of every term of the corpus."""
    return postings(chunks).groupBy("field", "term").agg(F.count("*").alias("doc_count"), F.sum("tf").alias("total_count"))


def bm25(tf: Column, length: Column, docs: Column, found: Column, mean_length: Column) -> Column:
    rarity = F.greatest(F.lit(0.0), F.ln((docs - found + 0.5) / (found + 0.5)))
    return rarity * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))


def _times(said: str, term: str) -> Column:
    return F.size(F.filter(said, lambda x: x == term))


def _counted(chunks: DataFrame, terms: list[str], fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """chunks with the length of each field in tokens and how often it holds each term: one pass over the texts."""
    said = chunks.withColumns({f"said_{k}": tokens(F.col(f)) for k, f in enumerate(fields)})
    counts = {f"length_{k}": F.size(f"said_{k}") for k in range(len(fields))}
    counts |= {f"tf_{k}_{i}": _times(f"said_{k}", t) for k in range(len(fields)) for i, t in enumerate(terms)}
    return said.withColumns(counts).drop(*[f"said_{k}" for k in range(len(fields))])


def field_stats(chunks: DataFrame, terms: list[str], fields: tuple[str, ...] = FIELDS) -> dict[str, float]:
    """Of each field k: docs, mean_k and df_k_i, the chunks that hold term i. One row of numbers comes to the driver."""
    counted = _counted(chunks.select(*fields), terms, fields)
    parts = [F.count("*").alias("docs")]
    for k in range(len(fields)):
        parts.append(F.avg(f"length_{k}").alias(f"mean_{k}"))
        parts += [F.count_if(F.col(f"tf_{k}_{i}") > 0).alias(f"df_{k}_{i}") for i in range(len(terms))]
    return counted.agg(*parts).first().asDict()


def _score(k: int, n: int, stats: dict[str, float]) -> Column:
    """The score of field k where it holds every one of n terms, else null."""
    every = F.lit(True)
    total = F.lit(0.0)
    for i in range(n):
        every &= F.col(f"tf_{k}_{i}") > 0
        total += bm25(F.col(f"tf_{k}_{i}"), F.col(f"length_{k}"), F.lit(stats["docs"]), F.lit(stats[f"df_{k}_{i}"]), F.lit(stats[f"mean_{k}"]))
    return F.when(every, F.round(total, 6))


def field_matches(chunks: DataFrame, field: str, terms: list[str], keep: Column | None = None, pattern: str | None = None) -> DataFrame:
    """chunk_id, source_id, document_url, sequence, score of the chunks whose field holds every term."""
    stats = field_stats(chunks, terms, (field,))
    rows = _counted(chunks if keep is None else chunks.where(keep), terms, (field,))
    rows = rows.where(F.col(field).rlike(pattern)) if pattern else rows
    return rows.withColumn("score", _score(0, len(terms), stats)).where("score is not null").select("chunk_id", "source_id", "document_url", "sequence", "score")


ORDER = (F.desc, "score"), (F.asc, "source_id"), (F.asc, "document_url"), (F.asc, "sequence"), (F.asc, "chunk_id")


def ranked(hits: DataFrame, limit: int) -> DataFrame:
    """The first hits in the one total order that all searches share."""
    return hits.orderBy(*[f(c) for f, c in ORDER]).limit(limit)


def search(chunks: DataFrame, query: str, limit: int = 8, where: Filter = Filter(), mode: str = "auto", max_text: int = 4_000) -> DataFrame:
    """Hits with their score, match_kind, and a prefix of the text with a flag whether it was cut.

    Two passes over the chunks, both narrow: one for the statistics, one that scores both fields and keeps the first
    `limit` rows of each task with what is shown of them.
    """
    exact = mode == "exact" or (mode == "auto" and is_identifier(query))
    terms = query_terms(query.removesuffix("()") if exact else query)
    stats = field_stats(chunks, terms)
    rows = _counted(chunks.where(where.column()), terms)
    scores = []
    for k, field in enumerate(FIELDS):
        score = _score(k, len(terms), stats)
        scores.append(F.when(F.col(field).rlike(exact_pattern(query)), score) if exact else score)
    found = rows.withColumn("score", F.greatest(*scores)).where("score is not null")
    shown = found.select(
        "chunk_id", "source_id", "document_url", "sequence", "score", "title", F.substring("text", 1, max_text).alias("text"),
        (F.length("text") > max_text).alias("text_truncated"), F.lit("exact" if exact else "full_text").alias("match_kind"),
        *[c for c in ("heading_path", "source_url", "anchor", "content_sha256", "crawl_id", "crawled_at") if c in chunks.columns],
    )
    return ranked(shown, limit)
