"""Cutting sections into retrieval chunks of a target size, with identities that stay the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import markdown_escaped
from folioscope.schema import CHUNKING_VERSION, DEFAULT_TARGET_CHARS


def heading_paths(sections: DataFrame) -> DataFrame:
    """Sections with heading_path: the headings from the outermost down to their own. One document is folded at a time."""
    row = F.struct("section_id", "parent_id", "heading")
    docs = sections.groupBy("source_id", "document_url").agg(F.array_sort(F.collect_list(row)).alias("all"))
    empty = F.lit(None).cast("map<int,array<string>>")
    paths = F.aggregate(
        "all",
        F.coalesce(empty, F.create_map().cast("map<int,array<string>>")),
        lambda m, s: F.map_concat(
            m,
            F.create_map(
                s["section_id"],
                F.concat(
                    F.coalesce(F.try_element_at(m, s["parent_id"]), F.array().cast("array<string>")),
                    F.when(s["heading"].isNull(), F.array().cast("array<string>")).otherwise(F.array(s["heading"])),
                ),
            ),
        ),
    )
    found = docs.select("source_id", "document_url", F.explode(paths).alias("section_id", "heading_path"))
    return sections.join(found, ["source_id", "document_url", "section_id"])


def packed_ranges(kinds: Column, lengths: Column, target: Column) -> Column:
    """array<struct<start, stop>>: whole units put together while they fit the target, 2 characters between blocks.

    A code block belongs to the paragraph or code before it. One fold over a section's blocks.
    """
    n = F.size(kinds)
    joins = lambda i: (F.get(kinds, i) == "code") & (i > 0) & F.get(kinds, i - 1).isin("paragraph", "code")
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(index, lambda i: ~F.coalesce(joins(i), F.lit(False)))
    units = F.transform(
        starts, lambda s, k: F.struct(s.alias("start"), F.coalesce(F.get(starts, k + 1), n).alias("stop"))
    )
    sized = F.transform(
        units,
        lambda u: F.struct(
            u["start"].alias("start"), u["stop"].alias("stop"),
            (F.aggregate(F.slice(lengths, u["start"] + 1, u["stop"] - u["start"]), F.lit(0), lambda a, x: a + x) + 2 * (u["stop"] - u["start"] - 1)).alias("size"),
        ),
    )
    zero = F.array().cast("array<struct<start:int,stop:int,size:int>>")
    last = lambda done: F.element_at(done, -1)
    fits = lambda done, u: (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1))["size"], F.lit(0)) + 2 + u["size"] <= target)
    return F.aggregate(
        sized,
        zero,
        lambda done, u: F.when(
            fits(done, u),
            F.concat(
                F.slice(done, 1, F.greatest(F.lit(0), F.size(done) - 1)),
                F.array(F.struct(last(done)["start"].alias("start"), u["stop"].cast("int").alias("stop"), (last(done)["size"] + 2 + u["size"]).cast("int").alias("size"))),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(u["start"].cast("int").alias("start"), u["stop"].cast("int").alias("stop"), u["size"].cast("int").alias("size"))))),
    )


def chunked(sections: DataFrame, target_chars: int = DEFAULT_TARGET_CHARS) -> DataFrame:
    """Chunks of sections (source_id, document_url, section_id, parent_id, heading, heading_level, anchor, blocks).

    A headed section without blocks is one empty chunk, the introduction without blocks none. char_count is
    that of the markdown with its heading context; a chunk beyond the target says why in oversized.
    """
    if not 1 <= target_chars <= 1_000_000:
        raise ValueError("target_chars must be between 1 and 1,000,000")
    rows = heading_paths(sections.select("source_id", "document_url", "section_id", "parent_id", "heading", "anchor", "blocks"))
    blocks = F.coalesce("blocks", F.array().cast(sections.schema["blocks"].dataType))
    marks = F.transform("heading_path", lambda h, i: F.concat(F.repeat(F.lit("#"), F.least(i + 1, F.lit(6))), F.lit(" "), markdown_escaped(h)))
    rows = rows.withColumn("blocks", blocks).withColumn("prefix", F.array_join(marks, "\n\n"))
    room = F.lit(target_chars) - F.length("prefix") - F.when(F.length("prefix") > 0, 2).otherwise(0)
    kinds, lengths = F.transform("blocks", lambda b: b["kind"]), F.transform("blocks", lambda b: F.length(F.coalesce(b["text"], F.lit(""))))
    ranges = F.when(F.size("blocks") > 0, F.transform(packed_ranges(kinds, lengths, room), lambda r: F.struct(r["start"].alias("start"), r["stop"].alias("stop"))))
    empty = F.when(F.col("heading").isNotNull(), F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"))))
    cut = rows.withColumn("r", F.explode(F.coalesce(ranges, empty)))
    mine = F.slice("blocks", F.col("r.start") + 1, F.col("r.stop") - F.col("r.start"))
    text = F.array_join(F.transform(mine, lambda b: F.coalesce(b["text"], F.lit(""))), "\n\n")
    cut = cut.withColumn("block_start", F.col("r.start")).withColumn("block_end", F.col("r.stop")).withColumn("text", text)
    cut = cut.withColumn("markdown", F.concat_ws("\n\n", F.nullif("prefix", F.lit("")), F.nullif("text", F.lit(""))))
    content = F.to_json(F.struct(F.lit(CHUNKING_VERSION).alias("v"), "heading_path", mine.alias("blocks")))
    cut = cut.withColumn("content_sha256", F.sha2(content, 256)).withColumn("char_count", F.length("markdown").cast("long"))
    place = Window.partitionBy("source_id", "document_url")
    cut = cut.withColumn("sequence", (F.row_number().over(place.orderBy("section_id", "block_start")) - 1).cast("long"))
    # Repeated contents under one heading path are told apart by their number.
    again = Window.partitionBy("source_id", "document_url", "heading_path", "content_sha256").orderBy("section_id", "block_start")
    identity = F.to_json(F.struct(F.lit(CHUNKING_VERSION).alias("v"), F.lit(target_chars).alias("target"), "source_id", "document_url", "heading_path", "content_sha256", F.row_number().over(again).alias("n")))
    why = (
        F.when(F.length("prefix") > target_chars, "HeadingContext").when(F.size(mine) > 1, "ExampleGroup")
        .otherwise(F.initcap(F.get(F.transform(mine, lambda b: b["kind"]), 0)))
    )
    # What the chunk says in code, with its section's own heading: where identifiers are looked for.
    fields = {f.name for f in sections.schema["blocks"].dataType.elementType.fields}
    inner = F.flatten(F.transform(mine, lambda b: F.coalesce(b["code"], F.array().cast("array<string>")))) if "code" in fields else F.array().cast("array<string>")
    whole = F.transform(F.filter(mine, lambda b: b["kind"] == "code"), lambda b: F.coalesce(b["text"], F.lit("")))
    cut = cut.withColumn("code", F.concat_ws("\n", "heading", F.array_join(whole, "\n"), F.array_join(inner, "\n")))
    return cut.withColumn("chunk_id", F.sha2(identity, 256)).select(
        "chunk_id", "source_id", "document_url", "section_id", "heading_path", "anchor", "sequence", "block_start", "block_end", "text", "markdown", "code",
        "content_sha256", "char_count", F.when(F.col("char_count") > target_chars, why).alias("oversized"),
    )


def index_counts(chunks: DataFrame) -> DataFrame:
    """source_id, document_url, chunks, oversized, characters."""
    return chunks.groupBy("source_id", "document_url").agg(
        F.count("*").alias("chunks"), F.count("oversized").alias("oversized"), F.sum("char_count").alias("characters")
    )
