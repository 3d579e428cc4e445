"""Links between documents and mentions of identifiers: derivation, reads and one-hop expansion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.urls import fragment, joined_url, without_fragment
from folioscope.schema import GRAPH_VERSION, MAX_LINK_TEXT, MAX_LINKS, MAX_MENTIONS, MAX_SYMBOL_BYTES, MAX_URL_BYTES

SYMBOL = r"(?<![\p{L}\p{N}_:])[A-Za-z_][A-Za-z0-9_]*(?:::[A-Za-z_][A-Za-z0-9_]*)+(?![\p{L}\p{N}_:])"


def symbols(code: Column) -> Column:
    """The qualified identifiers in a text, each once, in order of their names."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(code, F.lit(SYMBOL), F.lit(0))))
    return F.filter(found, lambda s: F.octet_length(s) <= MAX_SYMBOL_BYTES)


def link_edges(links: DataFrame) -> DataFrame:
    """source_id, src_url, dst_url, url, text, text_truncated, version from rows of source_id, src_url, position, href, text.

    Addresses are resolved against the page; the first link to a full address counts, up to MAX_LINKS a page.
    """
    resolved = links.withColumn("url", joined_url("src_url", "href")).where(F.col("url").rlike(r"^https?://[^/@]+(?:[/?#]|$)"))
    resolved = resolved.where(F.octet_length("url") <= MAX_URL_BYTES)
    page = Window.partitionBy("source_id", "src_url")
    first = resolved.withColumn("n", F.row_number().over(Window.partitionBy("source_id", "src_url", "url").orderBy("position"))).where("n = 1")
    capped = first.withColumn("n", F.row_number().over(page.orderBy("position"))).where(F.col("n") <= MAX_LINKS)
    return capped.select(
        "source_id", "src_url", without_fragment(F.col("url")).alias("dst_url"), "url", F.substring("text", 1, MAX_LINK_TEXT).alias("text"),
        (F.length("text") > MAX_LINK_TEXT).alias("text_truncated"), F.lit(GRAPH_VERSION).alias("version"),
    )


def code_said(markdown: Column, heading: Column) -> Column:
    """What a chunk says in code, inline or in blocks, and in its section's own heading; its prose is left out."""
    fences = F.regexp_extract_all(markdown, F.lit(r"(?s)```+[^\n]*\n(.*?)\n?```"), F.lit(1))
    spans = F.regexp_extract_all(F.regexp_replace(markdown, r"(?s)```+[^\n]*\n.*?```", " "), F.lit(r"`([^`\n]+)`"), F.lit(1))
    return F.concat_ws("\n", heading, F.array_join(fences, "\n"), F.array_join(spans, "\n"))


def mention_edges(chunks: DataFrame, code: str = "code") -> DataFrame:
    """chunk columns and symbol for each identifier in a chunk's code and own heading, up to MAX_MENTIONS a document."""
    rows = chunks.select("source_id", "document_url", "chunk_id", "sequence", "content_sha256", F.explode(symbols(F.col(code))).alias("symbol"))
    order = Window.partitionBy("source_id", "document_url").orderBy("sequence", "chunk_id", "symbol")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= MAX_MENTIONS).drop("n")


def graph_states(links: DataFrame, mentions: DataFrame, documents: DataFrame) -> DataFrame:
    """source_id, document_url, graph_version, graph_truncated of documents whose edges were derived: truncated where a
    limit was reached or an address was too long. links are those before resolution, mentions those kept."""
    url = joined_url("src_url", "href")
    per_page = links.withColumn("url", url).groupBy("source_id", F.col("src_url").alias("document_url")).agg(
        ((F.count_distinct("url") > MAX_LINKS) | F.coalesce(F.bool_or(F.octet_length("url") > MAX_URL_BYTES), F.lit(False))).alias("links_cut")
    )
    said = mentions.groupBy("source_id", "document_url").agg((F.count("*") >= MAX_MENTIONS).alias("mentions_cut"))
    keys = ["source_id", "document_url"]
    joined = documents.select(*keys).join(per_page, keys, "left").join(said, keys, "left")
    cut = F.coalesce("links_cut", F.lit(False)) | F.coalesce("mentions_cut", F.lit(False))
    return joined.select(*keys, F.lit(GRAPH_VERSION).alias("graph_version"), cut.alias("graph_truncated"))


def seed_states(seeds: DataFrame, chunks: DataFrame, documents: DataFrame, version: str = GRAPH_VERSION) -> DataFrame:
    """The seeds (seed_no, chunk_id, content_sha256, source_id, document_url) with state: stale where the chunk is gone,
    moved or changed or its document removed, unindexed where its edges are of another version, else ready."""
    known = chunks.select("chunk_id", "content_sha256", "source_id", "document_url", F.lit(True).alias("current"))
    docs = documents.select("source_id", "document_url", "graph_version", F.coalesce("graph_truncated", F.lit(False)).alias("index_truncated"),
                            (F.coalesce("availability", F.lit("active")) != "removed").alias("present"))
    joined = seeds.join(known, ["chunk_id", "content_sha256", "source_id", "document_url"], "left").join(docs, ["source_id", "document_url"], "left")
    state = (
        F.when(F.col("current").isNull() | ~F.coalesce("present", F.lit(False)), "stale")
        .when(~F.col("graph_version").eqNullSafe(F.lit(version)), "unindexed").otherwise("ready")
    )
    return joined.withColumn("state", state).drop("current", "present", "graph_version")


def present_edges(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """The edges both of whose documents are known and not removed."""
    live = documents.where(F.coalesce("availability", F.lit("active")) != "removed").select("source_id", "document_url")
    kept = edges.join(live.withColumnRenamed("document_url", "src_url"), ["source_id", "src_url"], "left_semi")
    return kept.join(live.withColumnRenamed("document_url", "dst_url"), ["source_id", "dst_url"], "left_semi")


def expansion_report(states: DataFrame, expanded: DataFrame, hop: Hop | None = None) -> DataFrame:
    """One row: seeds, skipped_stale_seeds, unindexed_seeds, truncated_seed_indexes, traversal_truncated,
    candidates_truncated, candidates."""
    hop = hop or Hop()
    seeds = states.agg(
        F.count("*").alias("seeds"), F.count_if(F.col("state") == "stale").alias("skipped_stale_seeds"), F.count_if(F.col("state") == "unindexed").alias("unindexed_seeds"),
        F.count_if((F.col("state") == "ready") & F.coalesce("index_truncated", F.lit(False))).alias("truncated_seed_indexes"), F.lit(1).alias("one"),
    )
    found = expanded.agg(
        F.coalesce(F.bool_or(F.col("edge_overflow") | F.col("overflow")), F.lit(False)).alias("traversal_truncated"), F.count_distinct("chunk_id").alias("reached"), F.lit(1).alias("one")
    )
    return seeds.join(found, "one").select(
        "seeds", "skipped_stale_seeds", "unindexed_seeds", "truncated_seed_indexes", "traversal_truncated",
        (F.col("reached") > hop.candidates).alias("candidates_truncated"), F.least("reached", F.lit(hop.candidates)).alias("candidates"),
    )


def document_links(edges: DataFrame, documents: DataFrame, source_id: str, url: str, incoming: bool = False, limit: int = 100) -> DataFrame:
    """Links of a document with whether their target is known, and one more than the limit to show that there are more."""
    here = edges.where((F.col("source_id") == source_id) & (F.col("dst_url" if incoming else "src_url") == url))
    known = documents.select("source_id", F.col("document_url").alias("dst_url"), F.lit(True).alias("known"))
    found = here.join(known, ["source_id", "dst_url"], "left").withColumn("target_known", F.coalesce("known", F.lit(False))).drop("known")
    return found.orderBy("src_url" if incoming else "url").limit(limit + 1)


def entity_mentions(mentions: DataFrame, source_id: str, symbol: str, limit: int = 100) -> DataFrame:
    return mentions.where((F.col("source_id") == source_id) & (F.col("symbol") == symbol)).orderBy("document_url", "sequence", "chunk_id").limit(limit + 1)


def graph_coverage(documents: DataFrame, version: str = GRAPH_VERSION) -> DataFrame:
    """documents, indexed, truncated over the documents that are not removed."""
    live = documents.where(F.coalesce("availability", F.lit("active")) != "removed")
    return live.agg(
        F.count("*").alias("documents"), F.count_if(F.col("graph_version").eqNullSafe(version)).alias("indexed"),
        F.count_if(F.coalesce("graph_truncated", F.lit(False))).alias("truncated"),
    )


@dataclass(frozen=True)
class Hop:
    """How far one hop spreads from each seed."""

    edges: int = 4
    chunks: int = 2
    candidates: int = 20
    paths: int = 4


def _top(rows: DataFrame, by: list[str], order: list, keep: int) -> DataFrame:
    """The first `keep` of each group, with whether there were more; Spark prunes beyond keep + 1 before the shuffle."""
    ranked = rows.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("at") <= keep + 1)
    more = F.max(F.when(F.col("at") > keep, True)).over(Window.partitionBy(*by))
    return ranked.withColumn("overflow", F.coalesce(more, F.lit(False))).where(F.col("at") <= keep)


def expand(seeds: DataFrame, edges: DataFrame, mentions: DataFrame, chunks: DataFrame, hop: Hop = Hop(), keep: Column | None = None) -> DataFrame:
    """Chunks one hop from the seeds (seed_no, chunk_id, source_id, document_url): seed_no, group_no, rank, chunk_id, relation, via.

    Links in and out of the seed's document share one order and one limit, shared identifiers have their
    own. A link's landing chunks are those at its anchor, else the earliest of the page; an identifier's are
    those of other documents of the same source. Filters apply before every limit.
    """
    out = seeds.join(edges.where("src_url <> dst_url").withColumnRenamed("src_url", "document_url"), ["source_id", "document_url"]).select(
        "seed_no", "source_id", F.lit("outgoing_link").alias("relation"), F.col("dst_url").alias("target"), "url", fragment(F.col("url")).alias("anchor"),
        F.col("dst_url").alias("order_url"),
    )
    back = seeds.join(edges.where("src_url <> dst_url").withColumnRenamed("dst_url", "document_url"), ["source_id", "document_url"]).select(
        "seed_no", "source_id", F.lit("incoming_link").alias("relation"), F.col("src_url").alias("target"), "url", F.lit(None).cast("string").alias("anchor"),
        F.col("src_url").alias("order_url"),
    )
    wanted = chunks if keep is None else chunks.where(keep)
    landing = wanted.select("source_id", F.col("document_url").alias("target"), F.col("chunk_id").alias("found_id"), "sequence", F.col("anchor").alias("at_anchor"))
    known = landing.select("source_id", "target").distinct()
    both = out.unionByName(back).join(known, ["source_id", "target"], "left_semi").dropDuplicates(["seed_no", "relation", "target", "url"])
    linked = _top(both, ["seed_no"], ["order_url", "url", "relation"], hop.edges).withColumnRenamed("at", "group_no").withColumnRenamed("overflow", "edge_overflow")
    # An address writes an anchor's special characters in percents.
    plain = F.coalesce(F.try_url_decode(F.replace(F.col("anchor"), F.lit("+"), F.lit("%2B"))), F.col("anchor"))
    reached = linked.join(landing, ["source_id", "target"]).where(F.col("anchor").isNull() | (F.col("anchor") == F.col("at_anchor")) | (plain == F.col("at_anchor")))
    by_link = _top(reached, ["seed_no", "group_no"], ["sequence", "found_id"], hop.chunks).select(
        "seed_no", "group_no", F.col("at").alias("rank"), F.col("found_id").alias("chunk_id"), "relation", F.col("url").alias("via"), "edge_overflow", "overflow"
    )
    own = seeds.select("seed_no", "chunk_id").join(mentions.select("chunk_id", "symbol"), "chunk_id").select("seed_no", "symbol").distinct()
    said = _top(own, ["seed_no"], ["symbol"], hop.edges).withColumnRenamed("at", "group_no").withColumnRenamed("overflow", "edge_overflow")
    there = mentions.select("source_id", "symbol", F.col("document_url").alias("other_url"), F.col("chunk_id").alias("found_id"), "sequence")
    place = said.join(seeds.select("seed_no", "source_id", "document_url"), "seed_no").join(there, ["source_id", "symbol"]).where("other_url <> document_url")
    if keep is not None:
        place = place.join(wanted.select(F.col("chunk_id").alias("found_id")), "found_id", "left_semi")
    by_name = _top(place, ["seed_no", "group_no"], ["other_url", "sequence", "found_id"], hop.chunks).select(
        "seed_no", (F.col("group_no") + hop.edges).alias("group_no"), F.col("at").alias("rank"), F.col("found_id").alias("chunk_id"),
        F.lit("shared_entity").alias("relation"), F.col("symbol").alias("via"), "edge_overflow", "overflow",
    )
    return by_link.unionByName(by_name)


def interleaved(expanded: DataFrame, hop: Hop = Hop()) -> DataFrame:
    """chunk_id, graph_rank, up to hop.paths of its paths (the first of every group, then the second, and so on) and
    paths_truncated."""
    turn = F.struct("rank", "seed_no", "group_no")
    every = F.array_sort(F.collect_set(F.struct("rank", "seed_no", "group_no", "relation", "via")))
    best = expanded.groupBy("chunk_id").agg(F.min(turn).alias("turn"), F.slice(every, 1, hop.paths).alias("paths"), (F.size(every) > hop.paths).alias("paths_truncated"))
    # At most seeds x groups x chunks rows.
    order = Window.orderBy("turn.rank", "turn.seed_no", "turn.group_no", "chunk_id")
    return best.withColumn("graph_rank", F.row_number().over(order)).where(F.col("graph_rank") <= hop.candidates).select("chunk_id", "graph_rank", "paths", "paths_truncated")
