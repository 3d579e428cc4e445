"""Exact vector search inside one embedding space, and the states of embeddings."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import cosine


def current_embeddings(embeddings: DataFrame) -> DataFrame:
    """One row for each space and chunk: the one updated last."""
    order = Window.partitionBy("space_id", "chunk_id").orderBy(F.desc_nulls_last("updated_at"), F.desc("embedding_id"))
    return embeddings.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def finite(score: Column) -> Column:
    """The score; reading it fails where it is not a finite number."""
    bad = F.isnan(score) | (F.abs(score) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("a score is not finite")).cast("double")).otherwise(score)


def space_id(provider: str, model: str, revision: str, dimensions: int, input_version: str) -> str:
    """The identity of an embedding space: a hash of all that its vectors depend on."""
    described = json.dumps([provider, model, revision, dimensions, input_version], separators=(",", ":"))
    return hashlib.sha256(described.encode()).hexdigest()


#: What a hit shows of its chunk.
PROJECTED = ("title", "heading_path", "source_url", "anchor", "sequence", "crawled_at")


def vector_search(embeddings: DataFrame, query: list[float], space_id: str, limit: int = 8, keep: Column | None = None, chunks: DataFrame | None = None, max_text: int = 4_000) -> DataFrame:
    """embedding_id, chunk_id, source_id, document_url, score of the most similar ready vectors of the space.

    Exact: a scan, a projection and a top-k of `limit` rows a task. Filters come before the limit. With chunks, only
    vectors of a chunk's present content count, and hits show what PROJECTED names and a prefix of the text.
    """
    if chunks is not None:
        known = chunks.select("chunk_id", "content_sha256", *[c for c in PROJECTED if c in chunks.columns])
        embeddings = embeddings.join(known, ["chunk_id", "content_sha256"])
    rows = embeddings.where((F.col("space_id") == space_id) & (F.col("status") == "ready") & F.col("vector").isNotNull())
    rows = rows.where(F.size("vector") == len(query))
    if keep is not None:
        rows = rows.where(keep)
    score = F.round(cosine(F.col("vector"), F.lit([float(x) for x in query])), 9)
    shown = [c for c in PROJECTED if chunks is not None and c in chunks.columns]
    hits = rows.select("embedding_id", "chunk_id", "source_id", "document_url", *(["content_sha256"] if chunks is not None else []), finite(score).alias("score"), *shown)
    order = ["source_id", "document_url", *(["sequence"] if "sequence" in shown else []), "chunk_id", "embedding_id"]
    found = hits.orderBy(F.desc("score"), *order).limit(limit)
    if chunks is None or "text" not in chunks.columns:
        return found
    # At most `limit` hits.
    text = chunks.select("chunk_id", F.substring("text", 1, max_text).alias("text"), (F.length("text") > max_text).alias("text_truncated"))
    return text.join(F.broadcast(found), "chunk_id")


def coverage(chunks: DataFrame, embeddings: DataFrame, space_id: str) -> DataFrame:
    """source_id, chunks, ready, pending, failed, missing, stale: how far each source is embedded.

    Stale are those whose content has changed since; they are not ready.
    """
    state = current_embeddings(embeddings.where(F.col("space_id") == space_id)).select(
        "chunk_id", "status", F.col("content_sha256").alias("embedded_sha256")
    )
    joined = chunks.join(state, "chunk_id", "left")
    fresh = F.col("embedded_sha256").eqNullSafe(F.col("content_sha256"))
    return joined.groupBy("source_id").agg(
        F.count("*").alias("chunks"),
        F.count_if((F.col("status") == "ready") & fresh).alias("ready"),
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status").isNull()).alias("missing"),
        F.count_if((F.col("status") == "ready") & ~fresh).alias("stale"),
    )


def orphaned(embeddings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Embeddings whose chunk is gone or has other content."""
    known = chunks.select("chunk_id", "content_sha256").distinct()
    return embeddings.join(known, ["chunk_id", "content_sha256"], "left_anti")


def to_embed(chunks: DataFrame, embeddings: DataFrame, space_id: str) -> DataFrame:
    """Chunks without a ready vector of their content, with the number of the attempt."""
    state = current_embeddings(embeddings.where(F.col("space_id") == space_id)).select(
        "chunk_id", "status", F.col("content_sha256").alias("embedded_sha256"), "attempts", F.col("vector").isNotNull().alias("has_vector")
    )
    reuse = (F.col("status") == "ready") & (F.col("embedded_sha256") == F.col("content_sha256")) & F.col("has_vector")
    joined = chunks.join(state, "chunk_id", "left").where(~F.coalesce(reuse, F.lit(False)))
    return joined.select("chunk_id", "source_id", "document_url", "text", "content_sha256", (F.coalesce("attempts", F.lit(0)) + 1).alias("attempts"))


def embed(todo: DataFrame, provider: Callable[[list[str]], list[list[float] | None]], space_id: str, batch: int = 32, dimensions: int | None = None, batch_bytes: int = 1 << 20, text_bytes: int = 1 << 18) -> DataFrame:
    """States of the chunks after asking the provider, in batches of at most batch texts and batch_bytes; a failed batch
    is asked one by one.

    A vector that is missing, empty, of other dimensions, not finite or of no length is a failure with its reason, and so
    is a text beyond text_bytes, for which the provider isn't asked.
    """
    import pandas as pd

    def one(texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
        try:
            return [checked(v) for v in provider(texts)] if texts else []
        except Exception as e:  # noqa: BLE001
            return [(None, str(e)[:200])] if len(texts) == 1 else [one([t])[0] for t in texts]

    def checked(v: list[float] | None) -> tuple[list[float] | None, str | None]:
        if v and dimensions is not None and len(v) != dimensions:
            return None, f"{len(v)} dimensions instead of {dimensions}"
        norm = sum(x * x for x in v) ** 0.5 if v else 0.0
        return ([x / norm for x in v], None) if 0 < norm < float("inf") else (None, "no direction")

    def run(frames):
        for pdf in frames:
            got: list[tuple[list[float] | None, str | None]] = []
            texts = pdf["text"].tolist()
            parts: list[list[str]] = [[]]
            for t in texts:
                held = sum(len(x.encode()) for x in parts[-1])
                if len(t.encode()) > text_bytes:
                    parts += [[t], []]
                elif len(parts[-1]) >= batch or held + len(t.encode()) > batch_bytes:
                    parts.append([t])
                else:
                    parts[-1].append(t)
            for asked in parts:
                if asked and len(asked[0].encode()) > text_bytes:
                    got.append((None, "text too long"))
                    continue
                part = one(asked)
                got += part if len(part) == len(asked) else [(None, "wrong number of vectors")] * len(asked)
            out = pdf[["chunk_id", "source_id", "document_url", "content_sha256", "attempts"]].copy()
            out["vector"], out["error"] = [g[0] for g in got], [g[1] for g in got]
            out["status"] = ["ready" if g[0] else "failed" for g in got]
            out["space_id"] = space_id
            yield pd.DataFrame(out)

    return todo.mapInPandas(
        run, "chunk_id string, source_id string, document_url string, content_sha256 string, attempts int, vector array<double>, error string, status string, space_id string"
    )


def completed(states: DataFrame, chunks: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
    """States as they may be stored: stale where the chunk has changed or gone meanwhile. A ready vector of the same
    content that was stored meanwhile is never overwritten: such states are left out."""
    known = chunks.select("chunk_id", F.col("content_sha256").alias("now")).distinct()
    joined = states.join(known, "chunk_id", "left")
    if embeddings is not None:
        done = embeddings.where("status = 'ready' and vector is not null").select("space_id", "chunk_id", "content_sha256").distinct()
        joined = joined.join(done, ["space_id", "chunk_id", "content_sha256"], "left_anti")
    return joined.withColumn("status", F.when(F.col("now").eqNullSafe(F.col("content_sha256")), F.col("status")).otherwise("stale")).drop("now")


def run_report(chunks: DataFrame, todo: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: scanned, reused, generated, failed and superseded chunks of an embedding run."""
    asked = chunks.select("chunk_id").join(todo.select("chunk_id", F.lit(1).alias("todo")), "chunk_id", "left")
    joined = asked.join(stored.select("chunk_id", "status"), "chunk_id", "left")
    return joined.agg(
        F.count("*").alias("scanned"), F.count_if(F.col("todo").isNull()).alias("reused"), F.count_if(F.col("status") == "ready").alias("generated"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("todo").isNotNull() & (F.col("status").isNull() | (F.col("status") == "stale"))).alias("superseded"),
    )
