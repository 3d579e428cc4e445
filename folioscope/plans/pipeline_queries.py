"""Registered queries over pages, sections, snapshots and the event log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.functions.html_extract import document_sections, extracted
from folioscope.functions.urls import html_candidate, in_scope, path_depth, under_prefix, without_fragment
from folioscope.operators import chunking, crawling, history
from folioscope.plans.registry import query, table
from folioscope.streaming.frontier import visited


@query(
    "page_states",
    """select page_id, case when state = 'Blocked' then 'Blocked' when state = 'TransportFailure' then 'TransportFailure' when content_truncated then 'Truncated'
      when octet_length(raw_body) > 16777216 then 'BodyTooLarge' when status not between 200 and 299 then 'HttpFailure' else 'Fetched' end as classified from page_outcome""",
)
def page_states(spark, folder):
    """The ordered classification."""
    failed = F.when(F.col("state") == "TransportFailure", F.coalesce("state_message", F.lit("failed")))
    state = crawling.page_state(F.col("state") == "Blocked", failed, F.coalesce("content_truncated", F.lit(False)), F.col("raw_body"), F.col("status"))
    return table(spark, folder, "page_outcome").select("page_id", state.alias("classified"))


HEADER_SQL = """
with h as (select page_id, state, status, content_truncated, octet_length(raw_body) as bytes,
    list_filter(headers, lambda x: lower(x.name) = 'content-type')[1].value as ct, try(decode(raw_body)) is not null or null as decodes from page_outcome),
t as (select *, lower(cast(ct as varchar)) as said from h),
u as (select *, trim(regexp_extract(coalesce(said, ''), '^([^;]*)', 1)) as media,
    coalesce(nullif(regexp_extract(coalesce(replace(said, '\\x22', '"'), ''), 'charset\\s*=\\s*["'']?([^\\s;"'']+)', 1), ''), 'utf-8') as charset from t)
""".replace("\\\\", "\\")


@query(
    "page_rejections",
    HEADER_SQL + """select page_id, case when state <> 'Fetched' or status not between 200 and 299 or coalesce(content_truncated, false) then 'FetchNotSuccessful'
      when bytes > 16777216 then 'InputTooLarge' when media not in ('', 'text/html', 'application/xhtml+xml') then 'UnsupportedContentType'
      when charset not in ('utf-8', 'utf8', 'us-ascii') then 'UnsupportedEncoding' when coalesce(bytes, 0) = 0 then 'EmptyContent' end as rejection from u""",
)
def page_rejections(spark, folder):
    pages = table(spark, folder, "page_outcome")
    return pages.select("page_id", crawling.rejection(pages).alias("rejection"))


@query(
    "run_summaries",
    """select source_id, crawl_id, count(*) as pages, count(*) filter (where state = 'Fetched') as fetched,
      count(*) filter (where state in ('HttpFailure', 'TransportFailure', 'RenderFailure', 'Truncated', 'BodyTooLarge')) as failed,
      count(*) filter (where state = 'Blocked') as blocked, count(*) filter (where state = 'NotModified') as unchanged,
      cast(coalesce(sum(octet_length(raw_body)), 0) as bigint) as bytes from page_outcome group by source_id, crawl_id""",
)
def run_summaries(spark, folder):
    return crawling.run_summary(table(spark, folder, "page_outcome")).drop("first_fetched", "last_fetched")


@query(
    "latest_run_per_source",
    """select source_id, crawl_id, pages from (select *, row_number() over (partition by source_id order by last_fetched desc, crawl_id desc) as n from (
      select source_id, crawl_id, count(*) as pages, max(fetched_at) as last_fetched from page_outcome group by source_id, crawl_id) r) t where n = 1""",
)
def latest_run_per_source(spark, folder):
    return crawling.latest_run(crawling.run_summary(table(spark, folder, "page_outcome"))).select("source_id", "crawl_id", "pages")


@query(
    "delivery_within_budget",
    """select source_id, crawl_id, count(*) filter (where n <= 2) as delivered, count(*) filter (where n > 2) as dropped from (
      select *, row_number() over (partition by source_id, crawl_id order by fetched_at, page_id) as n from page_outcome) t group by source_id, crawl_id""",
)
def delivery_within_budget(spark, folder):
    pages = crawling.within_budget(table(spark, folder, "page_outcome").select("source_id", "crawl_id", "fetched_at", "page_id"), 2)
    return pages.groupBy("source_id", "crawl_id").agg(F.count_if("delivered").alias("delivered"), F.count_if(~F.col("delivered")).alias("dropped"))


@query(
    "url_scope",
    """select page_id, final_url like 'https://docs.tarnwick.example/%' and not contains(regexp_replace(final_url, '[?#].*$', ''), '%') as scoped,
      len(list_filter(string_split(regexp_extract(regexp_replace(final_url, '[?#].*$', ''), '^[a-z]+://[^/]*(.*)$', 1), '/'), lambda x: x <> '')) as depth,
      coalesce(final_url = 'https://docs.tarnwick.example/api' or final_url like 'https://docs.tarnwick.example/api/%' or final_url like 'https://docs.tarnwick.example/api?%', false) as in_api
      from page_outcome where final_url is not null""",
)
def url_scope(spark, folder):
    url = F.col("final_url")
    return table(spark, folder, "page_outcome").where("final_url is not null").select(
        "page_id", in_scope(url, "https://docs.tarnwick.example/").alias("scoped"), path_depth(url).cast("long").alias("depth"),
        under_prefix(url, "https://docs.tarnwick.example/api").alias("in_api"),
    )


@query(
    "html_candidates",
    r"""select source_id, count(*) filter (where e in ('', 'htm', 'html', 'xhtml', 'shtml', 'php', 'asp', 'aspx', 'jsp')) as candidates, count(*) as pages from (
      select source_id, lower(regexp_extract(regexp_extract(regexp_replace(final_url, '[?#].*$', ''), '/([^/]*)$', 1), '\.([^.]*)$', 1)) as e from page_outcome) t group by source_id""",
)
def html_candidates(spark, folder):
    pages = table(spark, folder, "page_outcome")
    return pages.groupBy("source_id").agg(F.count_if(html_candidate(F.col("final_url"))).alias("candidates"), F.count("*").alias("pages"))


@query(
    "canonical_pages",
    """select source_id, final_url, page_id, aliases from (
      select *, row_number() over (partition by source_id, final_url order by requested_url <> final_url, requested_url, page_id) as n,
        count(*) over (partition by source_id, final_url) - 1 as aliases from page_outcome) t where n = 1""",
)
def canonical_pages(spark, folder):
    return history.canonical(table(spark, folder, "page_outcome")).select("source_id", "final_url", "page_id", "aliases")


@query(
    "raw_content_hashes",
    """select sha256(raw_body) as raw_sha256, count(*) as pages, count(distinct final_url) as urls from page_outcome
      where state = 'Fetched' group by sha256(raw_body) having count(*) > 1""",
)
def raw_content_hashes(spark, folder):
    pages = table(spark, folder, "page_outcome").where("state = 'Fetched'").select("final_url", F.sha2("raw_body", 256).alias("raw_sha256"))
    return pages.groupBy("raw_sha256").agg(F.count("*").alias("pages"), F.countDistinct("final_url").alias("urls")).where("pages > 1")


@query("content_hash_check", "select chunk_id, sha256(text) = content_sha256 as intact from (select distinct chunk_id, text, content_sha256 from chunk) t")
def content_hash_check(spark, folder):
    chunks = table(spark, folder, "chunk").select("chunk_id", "text", "content_sha256").distinct()
    return chunks.select("chunk_id", (F.sha2("text", 256) == F.col("content_sha256")).alias("intact"))


@query(
    "recrawl_change_kinds",
    """with s as (select snapshot_no, source_id, regexp_replace(document_url, '#.*$', '') as document_url, normalized_sha256, raw_sha256, availability,
      row_number() over (partition by snapshot_no, source_id, regexp_replace(document_url, '#.*$', '')
        order by stored_at desc nulls last, coalesce(normalized_sha256, '') desc, coalesce(raw_sha256, '') desc, coalesce(availability, '') desc) as n from document_snapshot),
    one as (select * from s where n = 1),
    p as (select snapshot_no, lag(snapshot_no) over (order by snapshot_no) as old_no from (select distinct snapshot_no from document_snapshot) d)
    select f.snapshot_no, f.source_id, f.document_url, case
      when coalesce(f.availability, 'active') = 'removed' then case when o.raw_sha256 is not null or o.normalized_sha256 is not null then 'removed' else 'rejected' end
      when (o.raw_sha256 is not null or o.normalized_sha256 is not null) and coalesce(o.availability, 'active') <> 'removed' and f.raw_sha256 = o.raw_sha256 then 'raw_unchanged'
      when (o.raw_sha256 is not null or o.normalized_sha256 is not null) and coalesce(o.availability, 'active') <> 'removed' and f.normalized_sha256 = o.normalized_sha256 then 'normalized_unchanged'
      when o.raw_sha256 is null and o.normalized_sha256 is null then 'added'
      when f.normalized_sha256 = o.normalized_sha256 then 'reprocessed' else 'changed' end as change_kind
    from one f join p on p.snapshot_no = f.snapshot_no and p.old_no is not null
    left join one o on o.snapshot_no = p.old_no and o.source_id = f.source_id and o.document_url = f.document_url""",
)
def recrawl_change_kinds(spark, folder):
    """Every snapshot as a recrawl of the one before it; a tombstone is a page that answers 410."""
    rows = table(spark, folder, "document_snapshot").withColumn("document_url", without_fragment(F.col("document_url")))
    order = Window.partitionBy("snapshot_no", "source_id", "document_url").orderBy(
        F.desc_nulls_last("stored_at"), *[F.desc(F.coalesce(c, F.lit(""))) for c in ("normalized_sha256", "raw_sha256", "availability")]
    )
    states = rows.withColumn("n", F.row_number().over(order)).where("n = 1")
    numbers = rows.select("snapshot_no").distinct()
    pairs = numbers.withColumn("old_no", F.lag("snapshot_no").over(Window.orderBy("snapshot_no"))).where("old_no is not null")
    gone = F.coalesce("availability", F.lit("active")) == "removed"
    fresh = states.join(F.broadcast(pairs), "snapshot_no").select(
        "snapshot_no", "old_no", "source_id", "document_url", "raw_sha256", "normalized_sha256", F.col("document_url").alias("requested_url"), F.col("document_url").alias("final_url"),
        F.when(gone, 410).otherwise(200).alias("status"), F.when(gone, "HttpFailure").otherwise("Fetched").alias("state"), F.lit(True).alias("compatible"),
    )
    old = states.select(F.col("snapshot_no").alias("old_no"), "source_id", "document_url", *[F.col(c).alias(f"old_{c}") for c in ("raw_sha256", "normalized_sha256", "availability")])
    found = fresh.join(old, ["old_no", "source_id", "document_url"], "left")
    return found.select("snapshot_no", "source_id", "document_url", history.change_kind().alias("change_kind"))


REV_SQL = """
with s as (select source_id, regexp_replace(document_url, '#.*$', '') as document_url, normalized_sha256, stored_at from document_snapshot where normalized_sha256 is not null),
first as (select source_id, document_url, normalized_sha256, min(stored_at) as first_stored from s group by source_id, document_url, normalized_sha256),
last as (select source_id, document_url, normalized_sha256 as current_sha from (select *, row_number() over (partition by source_id, document_url
    order by stored_at desc, normalized_sha256 desc) as n from s where stored_at is not null) t where n = 1),
r as (select f.source_id, f.document_url, f.normalized_sha256, row_number() over (partition by f.source_id, f.document_url order by first_stored, f.normalized_sha256) as sequence,
    f.normalized_sha256 = l.current_sha as is_current from first f join last l on l.source_id = f.source_id and l.document_url = f.document_url)
"""


def _revisions(spark, folder):
    rows = table(spark, folder, "document_snapshot").withColumn("document_url", without_fragment(F.col("document_url")))
    return history.revisions(rows.select("source_id", "document_url", "normalized_sha256", "stored_at").where("stored_at is not null"))


@query("revision_chain", REV_SQL.replace("where normalized_sha256 is not null)", "where normalized_sha256 is not null and stored_at is not null)") + "select source_id, document_url, normalized_sha256, sequence, is_current from r")
def revision_chain(spark, folder):
    return _revisions(spark, folder).select("source_id", "document_url", "normalized_sha256", "sequence", "is_current")


@query(
    "sources_page",
    """select source_id, site_name, case when n = 10 and total > 10 then source_id end as next_cursor from (
      select *, row_number() over (order by source_id) as n, count(*) over () as total from site_source where source_id > 'f') t where n <= 10""",
)
def sources_page(spark, folder):
    return history.page_after(table(spark, folder, "site_source"), "source_id", "f", 10).select("source_id", "site_name", "next_cursor")


@query(
    "frontier_status_counts",
    """with v as (select source_id, crawl_id, requested_url, max(case when state in ('Fetched', 'NotModified') then 'done' when state = 'Blocked' then 'blocked'
        when state in ('HttpFailure', 'TransportFailure', 'Truncated', 'BodyTooLarge', 'RenderFailure') then 'failed' else 'skipped' end) as status
      from page_outcome group by source_id, crawl_id, requested_url)
    select source_id, crawl_id, count(*) filter (where status = 'pending') as pending, count(*) filter (where status = 'done') as done, count(*) filter (where status = 'failed') as failed,
      count(*) filter (where status = 'blocked') as blocked, count(*) filter (where status = 'skipped') as skipped from v group by source_id, crawl_id""",
)
def frontier_status_counts(spark, folder):
    """What the captured pages made of their addresses."""
    return crawling.frontier_counts(visited(table(spark, folder, "page_outcome")), ["source_id", "crawl_id"])


def _sections(spark, folder):
    order = Window.partitionBy("source_id", "document_url", "section_id").orderBy("page_id")
    rows = table(spark, folder, "section").withColumn("n", F.row_number().over(order)).where("n = 1")
    return rows.select("source_id", "document_url", "section_id", "parent_id", "heading", "heading_level", "anchor", "blocks")


SECTION_SQL = """
with recursive one as (select * exclude (n) from (select *, row_number() over (partition by source_id, document_url, section_id order by page_id) as n from section) t where n = 1),
path as (
  select source_id, document_url, section_id, case when heading is null then [] else [heading] end as heading_path from one where parent_id is null
  union all
  select c.source_id, c.document_url, c.section_id, case when c.heading is null then p.heading_path else list_append(p.heading_path, c.heading) end
  from one c join path p on p.source_id = c.source_id and p.document_url = c.document_url and p.section_id = c.parent_id)
"""


@query("heading_paths", SECTION_SQL + "select source_id, document_url, section_id, array_to_string(heading_path, ' / ') as path from path")
def heading_paths(spark, folder):
    found = chunking.heading_paths(_sections(spark, folder))
    return found.select("source_id", "document_url", "section_id", F.array_join("heading_path", " / ").alias("path"))


@query("chunk_sections")
def chunk_sections(spark, folder):
    """Greedy packing is a fold over each section's blocks, which is held against a loop in the tests."""
    return chunking.chunked(_sections(spark, folder), 600).select("chunk_id", "document_url", "section_id", "sequence", "block_start", "block_end", "char_count", "oversized")


@query(
    "section_block_counts",
    """select source_id, b.kind as kind, count(*) as blocks, cast(sum(b.links) as bigint) as links, cast(sum(length(b.text)) as bigint) as characters
      from (select source_id, unnest(blocks) as b from section) t group by source_id, b.kind""",
)
def section_block_counts(spark, folder):
    rows = table(spark, folder, "section").select("source_id", F.explode("blocks").alias("b"))
    return rows.groupBy("source_id", F.col("b.kind").alias("kind")).agg(
        F.count("*").alias("blocks"), F.sum(F.col("b.links").cast("long")).alias("links"), F.sum(F.length("b.text").cast("long")).alias("characters")
    )


@query("extracted_sections")
def extracted_sections(spark, folder):
    """The whole of page_outcome through the structural extractor."""
    found = extracted(table(spark, folder, "page_outcome"))
    return document_sections(found.withColumn("title", F.col("title"))).select(
        "document_url", "section_id", "parent_id", "heading", "heading_level", "anchor", F.size("blocks").alias("n_blocks")
    )


@query(
    "extraction_outcomes",
    HEADER_SQL + """select page_id, case when state <> 'Fetched' or status not between 200 and 299 or coalesce(content_truncated, false) then 'FetchNotSuccessful'
      when bytes > 16777216 then 'InputTooLarge' when media not in ('', 'text/html', 'application/xhtml+xml') then 'UnsupportedContentType'
      when charset not in ('utf-8', 'utf8', 'us-ascii') then 'UnsupportedEncoding' when coalesce(bytes, 0) = 0 then 'EmptyContent' when decodes is null then 'InvalidUtf8' else 'Read' end as metadata_outcome from u""",
)
def extraction_outcomes(spark, folder):
    found = extracted(table(spark, folder, "page_outcome"))
    metadata = ("FetchNotSuccessful", "InputTooLarge", "UnsupportedContentType", "UnsupportedEncoding", "InvalidUtf8")
    empty = (F.col("reject_reason") == "EmptyContent") & (F.col("had_body") == 0)
    sizes = table(spark, folder, "page_outcome").select("page_id", F.coalesce(F.length("raw_body"), F.lit(0)).alias("had_body"))
    outcome = F.when(F.col("reject_reason").isin(*metadata) | empty, F.col("reject_reason")).otherwise("Read")
    return found.select("page_id", "reject_reason").join(sizes, "page_id").select("page_id", outcome.alias("metadata_outcome"))


@query("chunk_pages")
def chunk_pages(spark, folder):
    """From captured bytes to chunks with their hashes, in one plan."""
    order = Window.partitionBy("source_id", "final_url").orderBy("page_id")
    pages = table(spark, folder, "page_outcome").where("state = 'Fetched'").withColumn("n", F.row_number().over(order)).where("n = 1")
    return chunking.chunked(document_sections(extracted(pages)), 2_400).select("chunk_id", "document_url", "section_id", "sequence", "content_sha256", "char_count", "oversized")
