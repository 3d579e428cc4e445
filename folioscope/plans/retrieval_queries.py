"""Registered queries over chunks, embeddings and candidates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.functions.text import tokens
from folioscope.functions.urls import without_fragment
from folioscope.operators import context, fusion, lexical, vectors
from folioscope.plans.registry import query, table

#: The latest crawl of each chunk, as SQL.
CHUNKS = """
with cur as (
  select * exclude (rn) from (
    select *, row_number() over (partition by chunk_id order by crawled_at desc) as rn from chunk) x where rn = 1)
"""
TOK = r"regexp_extract_all(lower({0}), '([[:punct:]]|[^\s[:punct:]]+)')"
COLUMNS = ("source_id", "document_url", "title", "heading_path", "sequence", "text", "anchor", "content_sha256")


def chunks(spark, folder, *columns):
    return lexical.latest_chunks(table(spark, folder, "chunk"), *(columns or COLUMNS))


def bm25_sql(terms: list[str], limit: int, where: str = "true", shown: str = "h.score") -> str:
    """Both fields searched with every term, the better one's score, the first rows in the common order."""
    parts = []
    for no, field in enumerate(("text", "title")):
        tf = ", ".join(f"len(list_filter(said, lambda x: x = '{t}')) as tf_{i}" for i, t in enumerate(terms))
        df = ", ".join(f"sum(case when tf_{i} > 0 then 1 else 0 end) as df_{i}" for i in range(len(terms)))
        score = " + ".join(
            f"greatest(0.0, ln((docs - df_{i} + 0.5) / (df_{i} + 0.5))) * tf_{i} * 2.2 / (tf_{i} + 1.2 * (0.25 + 0.75 * length / mean_length))" for i in range(len(terms))
        )
        every = " and ".join(f"tf_{i} > 0" for i in range(len(terms)))
        parts.append(f"""
        c{no} as (select *, {tf}, len(said) as length from (select *, {TOK.format(field)} as said from cur) t),
        s{no} as (select count(*) as docs, avg(length) as mean_length, {df} from c{no}),
        h{no} as (select chunk_id, source_id, document_url, sequence, round({score}, 6) as score, {no} as field_no
                  from c{no}, s{no} where {every} and {where.replace("{field}", field)} order by score desc, source_id, document_url, sequence, chunk_id limit {limit})""")
    return f"""{CHUNKS}, {','.join(parts)},
    u as (select *, row_number() over (partition by chunk_id order by score desc, field_no) as rn from (select * from h0 union all select * from h1) z),
    h as (select * from u where rn = 1 order by score desc, source_id, document_url, sequence, chunk_id limit {limit})"""


@query("lexical_keywords_topk", bm25_sql(["token", "count"], 10) + " select chunk_id, source_id, document_url, sequence, score from h")
def lexical_keywords_topk(spark, folder):
    return lexical.search(chunks(spark, folder), "token count", limit=10).select("chunk_id", "source_id", "document_url", "sequence", "score")


@query(
    "lexical_filtered_topk",
    bm25_sql(["cold", "cache"], 8, "source_id = 'tarnwick' and (document_url like 'https://docs.tarnwick.example/guide/%')") + " select chunk_id, document_url, score from h",
)
def lexical_filtered_topk(spark, folder):
    where = lexical.Filter(source_id="tarnwick", url_prefix="https://docs.tarnwick.example/guide")
    return lexical.search(chunks(spark, folder), "cold cache", where=where).select("chunk_id", "document_url", "score")


@query(
    "lexical_text_prefix",
    bm25_sql(["batch", "report"], 8) + " select h.chunk_id, substr(c.text, 1, 60) as text, length(c.text) > 60 as text_truncated from h join cur c on c.chunk_id = h.chunk_id",
)
def lexical_text_prefix(spark, folder):
    return lexical.search(chunks(spark, folder), "batch report", max_text=60).select("chunk_id", "text", "text_truncated")


EXACT = r"regexp_matches({field}, '(?i)(^|[^\p{L}\p{N}_])when two workers race($|[^\p{L}\p{N}_:])')"


@query("lexical_exact_phrase", bm25_sql(["race", "two", "when", "workers"], 50, EXACT) + " select chunk_id, score from h")
def lexical_exact_phrase(spark, folder):
    return lexical.search(chunks(spark, folder), "when two workers race", limit=50, mode="exact").select("chunk_id", "score")


@query(
    "analyzer_tokens",
    CHUNKS + f"select chunk_id, len({TOK.format('text')}) as n_tokens, {TOK.format('title')}[1] as first_token from cur",
)
def analyzer_tokens(spark, folder):
    said = F.try_element_at(tokens(F.col("title")), F.lit(1))
    return chunks(spark, folder, "text", "title").select("chunk_id", F.size(tokens(F.col("text"))).cast("long").alias("n_tokens"), said.alias("first_token"))


@query(
    "bm25_term_stats",
    CHUNKS + f""", said as (select 'text' as field, chunk_id, unnest({TOK.format('text')}) as term from cur
      union all select 'title', chunk_id, unnest({TOK.format('title')}) from cur)
    select field, term, count(distinct chunk_id) as doc_count, count(*) as total_count from said group by field, term""",
)
def bm25_term_stats(spark, folder):
    return lexical.term_stats(chunks(spark, folder, "text", "title"))


@query(
    "corpus_stats",
    CHUNKS + f"""select 'text' as field, count(*) as docs, round(avg(len({TOK.format('text')})), 6) as mean_length from cur
    union all select 'title', count(*), round(avg(len({TOK.format('title')})), 6) from cur""",
)
def corpus_stats(spark, folder):
    return lexical.corpus_stats(chunks(spark, folder, "text", "title")).withColumn("mean_length", F.round("mean_length", 6))


EMB = """
with emb as (select * exclude (rn) from (select *, row_number() over (
  partition by space_id, chunk_id order by updated_at desc nulls last, embedding_id desc) as rn from chunk_embedding) x where rn = 1),
probe as (select space_id, vector from chunk_embedding where status = 'ready' and vector is not null order by embedding_id limit 1)
"""


def _probe(embeddings):
    """The query vector: the first ready one."""
    row = embeddings.where("status = 'ready' and vector is not null").orderBy("embedding_id").select("space_id", "vector").first()
    return row["space_id"], list(row["vector"])


@query(
    "vector_topk",
    EMB + """select e.embedding_id, e.chunk_id, round(list_cosine_similarity(e.vector, p.vector), 9) as score from emb e, probe p
    where e.space_id = p.space_id and e.status = 'ready' and e.vector is not null and exists (select 1 from chunk c where c.chunk_id = e.chunk_id and c.content_sha256 = e.content_sha256)
    order by score desc, e.source_id, e.document_url, e.chunk_id, e.embedding_id limit 10""",
)
def vector_topk(spark, folder):
    emb = table(spark, folder, "chunk_embedding")
    space, vector = _probe(emb)
    return vectors.vector_search(vectors.current_embeddings(emb), vector, space, 10, chunks=chunks(spark, folder, "content_sha256")).select("embedding_id", "chunk_id", "score")


@query(
    "vector_topk_filtered",
    EMB + """select e.embedding_id, e.chunk_id, round(list_cosine_similarity(e.vector, p.vector), 9) as score from emb e, probe p
    where e.space_id = p.space_id and e.status = 'ready' and e.vector is not null and e.source_id = 'tarnwick'
      and exists (select 1 from chunk c where c.chunk_id = e.chunk_id and c.content_sha256 = e.content_sha256)
    order by score desc, e.source_id, e.document_url, e.chunk_id, e.embedding_id limit 5""",
)
def vector_topk_filtered(spark, folder):
    emb = table(spark, folder, "chunk_embedding")
    space, vector = _probe(emb)
    found = vectors.vector_search(vectors.current_embeddings(emb), vector, space, 5, F.col("source_id") == "tarnwick", chunks(spark, folder, "content_sha256"))
    return found.select("embedding_id", "chunk_id", "score")


@query(
    "embedding_coverage",
    EMB.rstrip() + """, cur as (select distinct chunk_id, source_id, content_sha256 from chunk),
    j as (select c.source_id, e.status, e.content_sha256 is not distinct from c.content_sha256 as fresh from cur c left join emb e
          on e.chunk_id = c.chunk_id and e.space_id = (select space_id from probe))
    select source_id, count(*) as chunks, count(*) filter (where status = 'ready' and fresh) as ready, count(*) filter (where status = 'pending') as pending,
      count(*) filter (where status = 'failed') as failed, count(*) filter (where status is null) as missing,
      count(*) filter (where status = 'ready' and not fresh) as stale from j group by source_id""",
)
def embedding_coverage(spark, folder):
    emb = table(spark, folder, "chunk_embedding")
    space, _ = _probe(emb)
    known = table(spark, folder, "chunk").select("chunk_id", "source_id", "content_sha256").distinct()
    return vectors.coverage(known, emb, space)


@query(
    "chunks_to_embed",
    EMB.rstrip() + """, cur as (select distinct chunk_id, content_sha256 from chunk)
    select c.chunk_id, coalesce(e.attempts, 0) + 1 as attempts from cur c left join emb e
      on e.chunk_id = c.chunk_id and e.space_id = (select space_id from probe)
    where not coalesce(e.status = 'ready' and e.content_sha256 = c.content_sha256 and e.vector is not null, false)""",
)
def chunks_to_embed(spark, folder):
    emb = table(spark, folder, "chunk_embedding")
    space, _ = _probe(emb)
    known = table(spark, folder, "chunk").select("chunk_id", "source_id", "document_url", "text", "content_sha256").dropDuplicates(["chunk_id", "content_sha256"])
    return vectors.to_embed(known, emb, space).select("chunk_id", "attempts")


@query(
    "orphaned_embeddings",
    """with last as (select source_id, regexp_replace(document_url, '#.*$', '') as document_url from document_snapshot
        where snapshot_no = (select max(snapshot_no) from document_snapshot) and coalesce(availability, 'active') <> 'removed'),
    live as (select distinct chunk_id, content_sha256 from chunk c where exists (select 1 from last l where l.source_id = c.source_id and l.document_url = c.document_url))
    select embedding_id from chunk_embedding e where not exists (select 1 from live c where c.chunk_id = e.chunk_id and c.content_sha256 = e.content_sha256)""",
)
def orphaned_embeddings(spark, folder):
    """Embeddings of chunks whose document isn't in the last snapshot any more, or whose content is another."""
    rows = table(spark, folder, "document_snapshot").where("coalesce(availability, 'active') <> 'removed'")
    last = table(spark, folder, "document_snapshot").agg(F.max("snapshot_no").alias("snapshot_no"))
    live = rows.join(F.broadcast(last), "snapshot_no").select("source_id", without_fragment(F.col("document_url")).alias("document_url"))
    known = table(spark, folder, "chunk").join(live, ["source_id", "document_url"], "left_semi")
    return vectors.orphaned(table(spark, folder, "chunk_embedding"), known).select("embedding_id")


CAND = """
with c as (select * exclude (rn) from (select *, row_number() over (partition by query_id, chunk_id order by scored_at desc nulls last,
    lexical_rank nulls last, vector_rank nulls last, graph_rank nulls last) as rn from fusion_candidate) x where rn = 1),
f as (select *, round(coalesce(1.0 / (60 + lexical_rank), 0) + coalesce(1.0 / (60 + vector_rank), 0) + coalesce(1.0 / (60 + graph_rank), 0), 12) as rrf_score from c),
p as (select *, row_number() over (partition by query_id order by rrf_score desc, source_id, document_url, chunk_id) as place from f)
"""


def candidates(spark, folder):
    order = Window.partitionBy("query_id", "chunk_id").orderBy(
        F.desc_nulls_last("scored_at"), F.asc_nulls_last("lexical_rank"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("graph_rank")
    )
    return table(spark, folder, "fusion_candidate").withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


@query("rrf_fusion", CAND + "select query_id, chunk_id, rrf_score, place from p where place <= 8")
def rrf_fusion(spark, folder):
    return fusion.hybrid(candidates(spark, folder), 8).select("query_id", "chunk_id", "rrf_score", F.col("place").cast("long").alias("place"))


@query(
    "hybrid_recall",
    CAND.replace(" + coalesce(1.0 / (60 + graph_rank), 0)", "") + """
    select query_id, round(avg(case when place <= 8 then 1.0 else 0.0 end), 9) as recall from p where graph_rank <= 4 group by query_id""",
)
def hybrid_recall(spark, folder):
    """How many of the graph's first four, which the fusion doesn't see, are among the first eight of keywords and vectors."""
    ranked = fusion.hybrid(candidates(spark, folder), 1_000_000, ("lexical_rank", "vector_rank"))
    relevant = ranked.where("graph_rank <= 4").select("query_id", "chunk_id")
    return fusion.recall(ranked, relevant, 8).withColumn("recall", F.round("recall", 9))


@query(
    "rank_merge",
    bm25_sql(["late", "scheduler"], 10) + """, a as (select chunk_id, row_number() over (order by score desc, chunk_id) as rank_0 from h0),
    b as (select chunk_id, row_number() over (order by score desc, chunk_id) as rank_1 from h1)
    select coalesce(a.chunk_id, b.chunk_id) as chunk_id, rank_0, rank_1 from a full outer join b on a.chunk_id = b.chunk_id""",
)
def rank_merge(spark, folder):
    rows = chunks(spark, folder)
    lists = [lexical.ranked(lexical.field_matches(rows, f, ["late", "scheduler"]), 10) for f in lexical.FIELDS]
    return fusion.merged(*lists).select("chunk_id", F.col("rank_0").cast("long").alias("rank_0"), F.col("rank_1").cast("long").alias("rank_1"))


HITS = CHUNKS + """, hit as (select distinct c.chunk_id, c.source_id, c.document_url, c.sequence, 1 as hit_no
  from cur c join fusion_candidate f on f.chunk_id = c.chunk_id where f.lexical_rank = 1),
near as (select h.hit_no, c.chunk_id, c.source_id, c.document_url, c.sequence, c.text, abs(c.sequence - h.sequence) as distance
  from hit h join cur c on c.source_id = h.source_id and c.document_url = h.document_url and c.sequence between h.sequence - 1 and h.sequence + 1)
"""


def _hits(spark, folder, rows):
    """The chunks that come first by keywords in any query."""
    first = table(spark, folder, "fusion_candidate").where("lexical_rank = 1").select("chunk_id")
    return rows.join(first, "chunk_id", "left_semi").select("source_id", "document_url", "sequence", F.lit(1).alias("hit_no"))


@query("context_neighbours", HITS + "select chunk_id, document_url, sequence, distance from near")
def context_neighbours(spark, folder):
    rows = chunks(spark, folder, "source_id", "document_url", "sequence")
    found = context.neighbours(_hits(spark, folder, rows), rows, 1)
    return found.select("chunk_id", "document_url", "sequence", "distance")


@query(
    "context_budget",
    HITS + """, one as (select * exclude (n) from (select *, row_number() over (partition by document_url, chunk_id order by distance > 0, distance, sequence) as n from near) t where n = 1),
    placed as (select *, least(length(text), 4000) as wants, row_number() over (partition by document_url order by distance > 0, distance, sequence, chunk_id) as place from one),
    spent as (select *, coalesce(sum(wants) over (partition by document_url order by place rows between unbounded preceding and 1 preceding), 0) as before
              from placed where place <= 50)
    select document_url, chunk_id, place, cast(least(wants, 12000 - before) as bigint) as takes, least(wants, 12000 - before) < length(text) as truncated
    from spent where before < 12000""",
)
def context_budget(spark, folder):
    rows = chunks(spark, folder, "source_id", "document_url", "sequence", "text")
    around = context.neighbours(_hits(spark, folder, rows), rows, 1)
    taken = context.budgeted(around, by=("document_url",))
    return taken.select("document_url", "chunk_id", F.col("place").cast("long").alias("place"), "takes", "truncated")
