"""Query p4: snapshot changes."""

from __future__ import annotations

from skein.common import table
from skein.operators import snapshots


def p4_found(spark, d):
    return snapshots.graph_changes(table(spark, d, "graph_meta"), table(spark, d, "entity_snapshots"), table(spark, d, "file_timestamps"))


QUERIES = {"p4_found": p4_found}

_BAG = "list_sort(list_transform(coalesce({0}, []), lambda x: coalesce(x, '')))"
_TIME = "coalesce(cast(epoch_us(try_cast({0} as timestamptz)) as varchar), {0}, '')"
_TEXT = [f"coalesce({c}, '')" for c in ("name", "kind", "description", "package", "last_author", "source_file")]
_ROW = ", ".join([*_TEXT, *[_BAG.format(c) for c in ("calls", "imports", "literals")], _TIME.format("last_modified"), "coalesce(change_count, 0)", "coalesce(source_line, 0)"])

ORACLE = {
    "p4_found": f"""
with one as (select repo, branch, commit_sha, min(graph_id) as graph_id, arg_min(generated_at, graph_id) as made
             from graph_meta group by all),
ordered as (select graph_id, commit_sha, lag(graph_id) over (partition by repo, branch order by try_cast(made as timestamptz) nulls first, made, graph_id) as prev_id from one),
pairs as (select * from ordered where prev_id is not null),
rec as (select distinct graph_id, 'entity' as record_kind, coalesce(id, '') as record_key, md5(cast(row({_ROW}) as varchar)) as h from entity_snapshots
        union select distinct graph_id, 'file', coalesce(path, ''), md5({_TIME.format('modified')}) from file_timestamps),
one_key as (select graph_id, record_kind, record_key, string_agg(h, ',' order by h) as h from rec group by all),
now as (select p.commit_sha, p.graph_id as pair, k.record_kind, k.record_key, k.h from pairs p join one_key k on k.graph_id = p.graph_id),
old as (select p.commit_sha, p.graph_id as pair, k.record_kind, k.record_key, k.h from pairs p join one_key k on k.graph_id = p.prev_id)
select distinct coalesce(n.commit_sha, o.commit_sha) as commit_sha, coalesce(n.record_kind, o.record_kind) as record_kind,
  coalesce(n.record_key, o.record_key) as record_key,
  case when o.h is null then 'added' when n.h is null then 'removed' else 'changed' end as change_kind
from now n full join old o on n.pair = o.pair and n.record_kind = o.record_kind and n.record_key = o.record_key
where n.h is distinct from o.h""",
}
