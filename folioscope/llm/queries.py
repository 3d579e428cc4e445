"""The registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import main_body, mixing, near_duplicates, packing, rank_fusion, repeated_lines, residue, vector_neighbours, wrong_encoding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


P1_LINES = r"""
with numbered as (
  select chunk_id, source_id, document_url, title, unnest(string_split(text, chr(10))) as line,
         unnest(range(len(string_split(text, chr(10))))) as line_no
  from chunk where text is not null),
said as (
  select chunk_id, source_id, document_url, line_no,
         regexp_extract_all(case when length(title) > 0 then replace(lower(line), lower(title), ' ') else lower(line) end, '\p{L}+') as w
  from numbered),
keyed as (select chunk_id, source_id, document_url, line_no, array_to_string(w, ' ') as said from said where len(w) >= 3),
docs as (select source_id, count(distinct document_url) as of_docs from chunk group by source_id),
frequent as (
  select k.source_id, k.said from keyed k group by k.source_id, k.said
  having count(distinct document_url) >= 3
     and count(distinct document_url) >= 0.03 * (select of_docs from docs d where d.source_id = k.source_id))
"""


@query("p1_found", P1_LINES + """
select distinct k.chunk_id, cast(k.line_no as int) as line_no
from keyed k join frequent f on f.source_id = k.source_id and f.said = k.said
""")  # fmt: skip
def p1_found(spark, folder):
    return repeated_lines.repeated_lines(table(spark, folder, "chunk"))


@query("p1_cleaned_chunks", P1_LINES + """,
found as (select distinct k.chunk_id, k.line_no from keyed k join frequent f on f.source_id = k.source_id and f.said = k.said),
one as (select chunk_id, max(text) as text from chunk group by chunk_id),
cut as (select chunk_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as line_no from one where text is not null),
kept as (select c.chunk_id, string_agg(c.line, chr(10) order by c.line_no) as text from cut c
  where not exists (select 1 from found f where f.chunk_id = c.chunk_id and f.line_no = c.line_no) group by c.chunk_id),
gone as (select chunk_id, count(*) as n from found group by chunk_id)
select o.chunk_id, case when o.text is null then null else coalesce(k.text, '') end as text, cast(coalesce(g.n, 0) as int) as lines_removed
from one o left join kept k on k.chunk_id = o.chunk_id left join gone g on g.chunk_id = o.chunk_id
""")  # fmt: skip
def p1_cleaned_chunks(spark, folder):
    return repeated_lines.without_repeated_lines(table(spark, folder, "chunk"))


P5_SQL = """
with newest as (
  select *, row_number() over (partition by query_id, chunk_id order by scored_at desc nulls last, lexical_score desc nulls last,
         vector_score desc nulls last, graph_rank asc nulls last) as rn
  from fusion_candidate where query_id is not null and chunk_id is not null),
c as (
  select query_id, chunk_id, case when isnan(lexical_score) then null else lexical_score end as a,
         case when isnan(vector_score) then null else vector_score end as b, -cast(graph_rank as double) as g
  from newest where rn = 1),
r as (
  select query_id, chunk_id,
    case when a is null then 1.0 else (rank() over (partition by query_id order by a desc nulls last)
      + (count(*) over (partition by query_id, a) - 1) / 2.0) / count(*) over (partition by query_id) end as ra,
    case when b is null then 1.0 else (rank() over (partition by query_id order by b desc nulls last)
      + (count(*) over (partition by query_id, b) - 1) / 2.0) / count(*) over (partition by query_id) end as rb,
    case when g is null then 1.0 else (rank() over (partition by query_id order by g desc nulls last)
      + (count(*) over (partition by query_id, g) - 1) / 2.0) / count(*) over (partition by query_id) end as rg
  from c),
s as (
  select *, least(ra, rb, rg) as lo, greatest(ra, rb, rg) as hi, ra + rb + rg - least(ra, rb, rg) - greatest(ra, rb, rg) as mid from r),
t as (
  select *, least(1.0, 3 * least(1 - pow(1 - lo, 3), 3 * mid * mid - 2 * pow(mid, 3), pow(hi, 3))) as sig, (ra + rb + rg) / 3 as mr from s),
p as (select *, row_number() over (partition by query_id order by round(sig, 12), round(mr, 12), chunk_id) as position from t)
select p.query_id, p.chunk_id from p join search_query q on q.query_id = p.query_id where p.position <= q.wanted
"""


@query("p5_found", P5_SQL)
def p5_found(spark, folder):
    found = rank_fusion.fused_ranking(table(spark, folder, "fusion_candidate"), table(spark, folder, "search_query"))
    return found.select("query_id", "chunk_id")


#: Every pair that shares a shingle, which small tables alone allow.
P7_SQL = r"""
with one as (select chunk_id, text from (select *, row_number() over (partition by chunk_id order by crawled_at desc) as rn from chunk where text is not null and chunk_id is not null) t where rn = 1),
said as (select chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from one),
sets as (select chunk_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as s from said where len(w) >= 40),
each as (select chunk_id, len(s) as n, unnest(s) as t from sets),
met as (select a.chunk_id as chunk_a, b.chunk_id as chunk_b, count(*) as shared, any_value(a.n) as na, any_value(b.n) as nb
  from each a join each b on a.t = b.t and a.chunk_id < b.chunk_id group by a.chunk_id, b.chunk_id)
select chunk_a, chunk_b from met where shared >= 0.5 * (na + nb - shared)
"""


@query("p7_found", P7_SQL)
def p7_found(spark, folder):
    return near_duplicates.near_duplicate_pairs(table(spark, folder, "chunk"))


@query("p7_groups")
def p7_groups(spark, folder):
    return near_duplicates.near_duplicate_groups(table(spark, folder, "chunk"))


#: Every pair of a space, which small tables alone allow.
P4_SQL = """
with v as (select space_id, embedding_id, vector from (select *, row_number() over (partition by space_id, chunk_id order by updated_at desc nulls last, embedding_id desc) as rn
    from chunk_embedding where status = 'ready' and vector is not null and len(vector) > 0) t where rn = 1 and list_inner_product(vector, vector) > 0),
near as (select a.embedding_id as a, b.embedding_id as b, row_number() over (partition by a.embedding_id
    order by round(list_cosine_similarity(a.vector, b.vector), 9) desc, b.embedding_id) as place
  from v a join v b on a.space_id = b.space_id and len(a.vector) = len(b.vector) and a.embedding_id <> b.embedding_id)
select distinct least(a, b) as embedding_a, greatest(a, b) as embedding_b from near where place <= 5
"""


@query("p4_found", P4_SQL)
def p4_found(spark, folder):
    return vector_neighbours.neighbour_pairs(table(spark, folder, "chunk_embedding"))


@query("p10_found")
def p10_found(spark, folder):
    return wrong_encoding.garbled_documents(table(spark, folder, "documents"))


@query("p10_restored")
def p10_restored(spark, folder):
    return wrong_encoding.restored_documents(table(spark, folder, "documents"))


@query("p8_packed")
def p8_packed(spark, folder):
    return packing.packed(table(spark, folder, "documents"), table(spark, folder, "pack_container"))


@query("p8_report")
def p8_report(spark, folder):
    return packing.packing_report(p8_packed(spark, folder), table(spark, folder, "pack_container"))


@query("p9_mixed")
def p9_mixed(spark, folder):
    return mixing.mixed(table(spark, folder, "documents"), table(spark, folder, "mix_target"))


@query("p9_shares")
def p9_shares(spark, folder):
    return mixing.mix_report(p9_mixed(spark, folder), table(spark, folder, "mix_target"))


@query("p6_found")
def p6_found(spark, folder):
    return main_body.main_blocks(table(spark, folder, "page_outcome"), table(spark, folder, "section"))


@query("p2_found")
def p2_found(spark, folder):
    return residue.residue_pages(table(spark, folder, "page_outcome")).select("page_id")


@query("p2_validation")
def p2_validation(spark, folder):
    return residue.validation(table(spark, folder, "page_outcome"))
