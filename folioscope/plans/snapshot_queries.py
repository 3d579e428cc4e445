"""Queries over periodic full snapshots."""

from __future__ import annotations

from folioscope.operators.snapshots import snapshot_changes
from folioscope.plans.registry import query, table

P3_SQL = r"""
with bare as (
  select snapshot_no, source_id, regexp_replace(document_url, '(?s)#.*$', '') as u, stored_at,
         lower(normalized_sha256) as v, coalesce(availability, 'active') <> 'removed' as present
  from document_snapshot where snapshot_no is not null),
keyed as (
  select snapshot_no, source_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1))
         || substr(u, length(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1)) + 1) as document_url,
         stored_at, v, present
  from bare),
newest as (
  select *, row_number() over (partition by snapshot_no, source_id, document_url
                               order by stored_at desc nulls last, v desc nulls last) as rn from keyed),
state as (select snapshot_no, source_id, document_url, v from newest where rn = 1 and present),
numbers as (select snapshot_no, lag(snapshot_no) over (order by snapshot_no) as earlier
            from (select distinct snapshot_no from keyed) t),
steps as (select snapshot_no, earlier from numbers where earlier is not null),
was as (select s.snapshot_no, p.source_id, p.document_url, p.v from steps s join state p on p.snapshot_no = s.earlier),
now as (select p.* from steps s join state p on p.snapshot_no = s.snapshot_no)
select snapshot_no, source_id, document_url, change_kind from (
  select coalesce(n.snapshot_no, w.snapshot_no) as snapshot_no, coalesce(n.source_id, w.source_id) as source_id,
         coalesce(n.document_url, w.document_url) as document_url,
         case when w.snapshot_no is null then 'added' when n.snapshot_no is null then 'removed'
              when n.v is distinct from w.v then 'changed' end as change_kind
  from now n full outer join was w
    on n.snapshot_no = w.snapshot_no and n.source_id = w.source_id and n.document_url = w.document_url) d
where change_kind is not null
"""


@query("p3_found", P3_SQL)
def p3_found(spark, folder):
    return snapshot_changes(table(spark, folder, "document_snapshot"))
