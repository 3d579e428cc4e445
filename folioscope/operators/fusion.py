"""Reciprocal rank fusion of candidate lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.vectors import finite

from folioscope.schema import RRF_K

LISTS = ("lexical_rank", "vector_rank", "graph_rank")


def reciprocal(rank: Column, k: int = RRF_K) -> Column:
    return F.coalesce(1.0 / (k + rank), F.lit(0.0))


def rrf(candidates: DataFrame, lists: tuple[str, ...] = LISTS, k: int = RRF_K) -> DataFrame:
    """Candidates (one row for each query_id and chunk_id) with rrf_score, the sum of 1 / (k + rank) over the lists."""
    return candidates.withColumn("rrf_score", F.round(sum((reciprocal(F.col(c), k) for c in lists[1:]), reciprocal(F.col(lists[0]), k)), 12))


def hybrid(candidates: DataFrame, limit: int = 8, lists: tuple[str, ...] = LISTS, k: int = RRF_K) -> DataFrame:
    """The best `limit` of each query with their place; ties by source, address and chunk."""
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "source_id", "document_url", "chunk_id")
    return rrf(candidates, lists, k).withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def merged(*lists: DataFrame) -> DataFrame:
    """Ranked lists (chunk_id, score) named by their place as one candidate table with a rank from each."""
    ranked = [
        df.select("chunk_id", F.lit(i).alias("list"), F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")).alias("rank")) for i, df in enumerate(lists)
    ]
    union = ranked[0]
    for df in ranked[1:]:
        union = union.unionByName(df)
    ranks = [F.max(F.when(F.col("list") == i, F.col("rank"))).alias(f"rank_{i}") for i in range(len(lists))]
    return union.groupBy("chunk_id").agg(*ranks)


def recall(found: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query_id, recall: the share of a query's relevant chunks among its first k (place <= k)."""
    hit = found.where(F.col("place") <= k).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    return relevant.join(hit, ["query_id", "chunk_id"], "left").groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


Ranker = Callable[[DataFrame], DataFrame]


def reciprocal_ranker(candidates: DataFrame) -> DataFrame:
    """chunk_id, fused: the default ranker, over all columns that end in _rank."""
    ranks = [c for c in candidates.columns if c.endswith("_rank")]
    return candidates.select("chunk_id", sum((reciprocal(F.col(c)) for c in ranks[1:]), reciprocal(F.col(ranks[0]))).alias("fused"))


def with_evidence(limit: int, ranker: Ranker = reciprocal_ranker, **lists: DataFrame) -> DataFrame:
    """The best of several ranked lists (chunk_id, source_id, document_url, sequence, content_sha256, score, rank), each
    named: the fused score, and of every list <name>_rank and <name>_score as evidence.

    Fails where two lists saw different contents of one chunk, or where the ranker gives a candidate that no list has,
    one twice, or a score that is not finite. Ties go by source, address, place and chunk.
    """
    key = ("source_id", "document_url", "sequence", "content_sha256")
    parts = [df.select("chunk_id", *key, F.lit(name).alias("list"), F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("score")) for name, df in lists.items()]
    union = parts[0]
    for df in parts[1:]:
        union = union.unionByName(df)
    cells = [F.max(F.when(F.col("list") == name, F.col(c))).alias(f"{name}_{c}") for name in lists for c in ("rank", "score")]
    same = F.count_distinct(F.struct("source_id", "document_url", F.coalesce("content_sha256", F.lit(""))))
    merged_ = union.groupBy("chunk_id").agg(*[F.first(c).alias(c) for c in key], same.alias("versions"), *cells)
    checked = F.when(F.col("versions") > 1, F.raise_error(F.lit("a candidate changed during the search"))).otherwise(F.col("source_id"))
    candidates = merged_.withColumn("source_id", checked).drop("versions")
    ranked = ranker(candidates).groupBy("chunk_id").agg(F.max("fused").alias("fused"), F.count("*").alias("times"))
    joined = ranked.join(candidates, "chunk_id", "left")
    bad = F.col("source_id").isNull() | (F.col("times") > 1)
    score = F.when(bad, F.raise_error(F.lit("the ranker gave an unknown or repeated candidate")).cast("double")).otherwise(finite(F.col("fused")))
    # As many rows as the lists have together.
    return joined.withColumn("score", score).drop("fused", "times").orderBy(F.desc("score"), "source_id", "document_url", "sequence", "chunk_id").limit(limit)


def numbered(hits: DataFrame, most: int = 1_000) -> DataFrame:
    """Hits with rank: their number in the order that all searches share. Hits beyond `most` are an error of the caller."""
    order = Window.orderBy(F.desc("score"), "source_id", "document_url", "sequence", "chunk_id")
    return hits.limit(most).withColumn("rank", F.row_number().over(order))
