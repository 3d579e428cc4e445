"""Registered queries over links and mentions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.operators import graph
from folioscope.plans.registry import query, table

#: SQL shows a quotation mark in bytes as \\x22.
LINKS_SQL = r"""
with raw as (select source_id, page_id, final_url as src_url, unnest(regexp_extract_all(cast(raw_body as varchar), '<a href=\\x22(/[!#-\[\]-~]*)\\x22>', 1)) as href,
    unnest(range(len(regexp_extract_all(cast(raw_body as varchar), '<a href=\\x22(/[!#-\[\]-~]*)\\x22>', 1)))) as position
  from page_outcome where state = 'Fetched'),
res as (select source_id, src_url, page_id, position, regexp_extract(src_url, '^([a-z]+://[^/?#]*)', 1) || href as url from raw),
first as (select * exclude (n) from (select *, row_number() over (partition by source_id, src_url, url order by page_id, position) as n from res) t where n = 1),
edges as (select source_id, src_url, regexp_replace(url, '#.*$', '') as dst_url, url from first)
"""


def raw_links(spark, folder):
    pages = table(spark, folder, "page_outcome").where("state = 'Fetched'")
    body = F.decode("raw_body", "ISO-8859-1")
    found = F.posexplode(F.regexp_extract_all(body, F.lit(r'<a href="(/[!#-\[\]-~]*)">'), F.lit(1))).alias("position", "href")
    rows = pages.select("source_id", F.col("final_url").alias("src_url"), "page_id", found)
    order = Window.partitionBy("source_id", "src_url").orderBy("page_id", "position")
    return rows.withColumn("position", F.row_number().over(order)).withColumn("text", F.lit(""))


def edges(spark, folder):
    return graph.link_edges(raw_links(spark, folder))


@query("link_edges", LINKS_SQL + "select source_id, src_url, dst_url, url from edges")
def link_edges(spark, folder):
    return edges(spark, folder).select("source_id", "src_url", "dst_url", "url")


@query(
    "links_incoming_counts",
    LINKS_SQL + """select e.source_id, e.dst_url, count(*) as links, count(distinct e.src_url) as pages,
      bool_or(p.final_url is not null) as target_known from edges e left join (select distinct source_id, final_url from page_outcome) p
      on p.source_id = e.source_id and p.final_url = e.dst_url group by e.source_id, e.dst_url""",
)
def links_incoming_counts(spark, folder):
    known = table(spark, folder, "page_outcome").select("source_id", F.col("final_url").alias("dst_url"), F.lit(True).alias("known")).distinct()
    joined = edges(spark, folder).join(known, ["source_id", "dst_url"], "left")
    return joined.groupBy("source_id", "dst_url").agg(
        F.count("*").alias("links"), F.countDistinct("src_url").alias("pages"), F.bool_or(F.coalesce("known", F.lit(False))).alias("target_known")
    )


@query(
    "links_outgoing",
    LINKS_SQL + """, page as (select min(src_url) as u from edges where source_id = 'tarnwick')
    select e.url, e.dst_url, p.final_url is not null as target_known from edges e left join (select distinct source_id, final_url from page_outcome) p
      on p.source_id = e.source_id and p.final_url = e.dst_url where e.source_id = 'tarnwick' and e.src_url = (select u from page) order by e.url limit 101""",
)
def links_outgoing(spark, folder):
    e = edges(spark, folder)
    url = e.where("source_id = 'tarnwick'").agg(F.min("src_url")).first()[0]
    docs = table(spark, folder, "page_outcome").select("source_id", F.col("final_url").alias("document_url")).distinct()
    return graph.document_links(e, docs, "tarnwick", url).select("url", "dst_url", "target_known")


#: Identifiers in the code blocks and the own heading of each section of the first page of every address.
MENTIONS_SQL = r"""
with one as (select * exclude (n) from (select *, row_number() over (partition by source_id, document_url, section_id order by page_id) as n from section) t where n = 1),
said as (select source_id, document_url, document_url || '#' || cast(section_id as varchar) as chunk_id, section_id as sequence,
  coalesce(heading, '') || chr(10) || array_to_string(list_transform(list_filter(blocks, lambda b: b.kind = 'code'), lambda b: coalesce(b.text, '')), chr(10)) as code from one),
runs as (select source_id, document_url, chunk_id, sequence, unnest(list_distinct(regexp_extract_all(code, '[\p{L}\p{N}_:]+'))) as symbol from said),
m as (select * from runs where regexp_full_match(symbol, '[A-Za-z_][A-Za-z0-9_]*(::[A-Za-z_][A-Za-z0-9_]*)+') and strlen(symbol) <= 256)
"""


def mentions(spark, folder):
    """The mentions of every section, as if each were a chunk."""
    order = Window.partitionBy("source_id", "document_url", "section_id").orderBy("page_id")
    one = table(spark, folder, "section").withColumn("n", F.row_number().over(order)).where("n = 1")
    code = F.array_join(F.transform(F.filter("blocks", lambda b: b["kind"] == "code"), lambda b: F.coalesce(b["text"], F.lit(""))), "\n")
    rows = one.select(
        "source_id", "document_url", F.concat("document_url", F.lit("#"), F.col("section_id").cast("string")).alias("chunk_id"), F.col("section_id").alias("sequence"),
        F.lit(None).cast("string").alias("content_sha256"), F.concat_ws("\n", "heading", code).alias("code"),
    )
    return graph.mention_edges(rows)


@query("mention_edges", MENTIONS_SQL + "select source_id, document_url, chunk_id, symbol from m")
def mention_edges(spark, folder):
    return mentions(spark, folder).select("source_id", "document_url", "chunk_id", "symbol")


@query(
    "entity_counts",
    MENTIONS_SQL + "select source_id, symbol, count(*) as mentions, count(distinct document_url) as documents from m group by source_id, symbol",
)
def entity_counts(spark, folder):
    return mentions(spark, folder).groupBy("source_id", "symbol").agg(F.count("*").alias("mentions"), F.countDistinct("document_url").alias("documents"))


@query(
    "entity_mentions_page",
    MENTIONS_SQL + """, top as (select symbol from m where source_id = 'tarnwick' group by symbol order by count(*) desc, symbol limit 1)
    select document_url, sequence, chunk_id from m where source_id = 'tarnwick' and symbol = (select symbol from top)
    order by document_url, sequence, chunk_id limit 101""",
)
def entity_mentions_page(spark, folder):
    m = mentions(spark, folder)
    symbol = m.where("source_id = 'tarnwick'").groupBy("symbol").count().orderBy(F.desc("count"), "symbol").first()[0]
    return graph.entity_mentions(m, "tarnwick", symbol).select("document_url", "sequence", "chunk_id")


SEEDS_SQL = MENTIONS_SQL + """
, seeds as (select chunk_id, source_id, document_url, row_number() over (order by chunk_id) as seed_no
  from (select distinct m.chunk_id, m.source_id, m.document_url from m join (select source_id, symbol from m group by source_id, symbol
        having count(distinct document_url) > 1) w on w.source_id = m.source_id and w.symbol = m.symbol qualify row_number() over (partition by m.source_id order by m.chunk_id) = 1) t),
own as (select *, row_number() over (partition by seed_no order by symbol) as group_no from (
  select distinct s.seed_no, s.source_id, s.document_url, m.symbol from seeds s join m on m.chunk_id = s.chunk_id) t),
there as (select o.seed_no, o.group_no, o.symbol, m.chunk_id,
  row_number() over (partition by o.seed_no, o.group_no order by m.document_url, m.sequence, m.chunk_id) as rank
  from own o join m on m.source_id = o.source_id and m.symbol = o.symbol and m.document_url <> o.document_url where o.group_no <= 4),
hop as (select seed_no, group_no + 4 as group_no, rank, chunk_id, symbol from there where rank <= 2)
"""


def _shared(spark, folder):
    """One hop from the first section of each source that shares an identifier. No link of these tables leads to a known page,
    so all that is reached is reached by identifiers; links are followed in the tests."""
    m = mentions(spark, folder)
    wide = m.groupBy("source_id", "symbol").agg(F.countDistinct("document_url").alias("documents")).where("documents > 1")
    shared = m.join(wide.drop("documents"), ["source_id", "symbol"], "left_semi")
    first = shared.groupBy("source_id").agg(F.min(F.struct("chunk_id", "document_url")).alias("s")).select("source_id", "s.chunk_id", "s.document_url")
    # One seed for each source.
    seeds = first.withColumn("seed_no", F.row_number().over(Window.orderBy("chunk_id")))
    rows = m.select("source_id", "document_url", "chunk_id", "sequence", F.lit(None).cast("string").alias("anchor")).distinct()
    return graph.expand(seeds, edges(spark, folder), m, rows)


@query("graph_shared_entity", SEEDS_SQL + "select seed_no, group_no, rank, chunk_id, symbol as via from hop")
def graph_shared_entity(spark, folder):
    found = _shared(spark, folder)
    return found.select(*[F.col(c).cast("long").alias(c) for c in ("seed_no", "group_no", "rank")], "chunk_id", "via")


@query(
    "graph_interleave",
    SEEDS_SQL + """, best as (select * exclude (n) from (select *, row_number() over (partition by chunk_id order by rank, seed_no, group_no) as n from hop) t where n = 1)
    select chunk_id, graph_rank from (select chunk_id, row_number() over (order by rank, seed_no, group_no, chunk_id) as graph_rank from best) t where graph_rank <= 20""",
)
def graph_interleave(spark, folder):
    return graph.interleaved(_shared(spark, folder)).select("chunk_id", F.col("graph_rank").cast("long").alias("graph_rank"))
