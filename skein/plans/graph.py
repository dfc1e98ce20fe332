"""Graph queries over the delivered tables, with the SQL that checks them."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.common import latest, once, ranked, table
from skein.functions.text import short_name
from skein.operators import build, lookup, maintain, origin, review, traverse, views
from skein.store import Graph, delivered, merged, normalise

SINCE, SCOPE, _TREE = "2024-06-01T00:00:00Z", ["repo"], ["repo", "branch"]


@lru_cache(maxsize=8)
def _graph(spark: SparkSession, d: str) -> Graph:
    return delivered(spark, d)


@lru_cache(maxsize=8)
def _root(spark: SparkSession, d: str) -> str:
    """The function with the most callers; of several the first by id."""
    g = _graph(spark, d)
    known = g.entities.filter("kind = 'function'").select(F.col("id").alias("dst"))
    row = g.edges.filter("type = 'calls'").join(known, "dst", "left_semi").groupBy("dst").count().orderBy(F.desc("count"), "dst").first()
    return row["dst"] if row else ""


@lru_cache(maxsize=8)
def _controller(spark: SparkSession, d: str) -> str:
    row = _graph(spark, d).entities.filter("kind = 'controller'").orderBy("id").select("id").first()
    return row["id"] if row else ""


def _brief(df: DataFrame, *more) -> DataFrame:
    return df.select("id", "name", "kind", "source_file", F.col("source_line").cast("long").alias("source_line"), *more)


def _timed(df: DataFrame) -> DataFrame:
    return df.select("id", "last_author", "last_modified", F.col("change_count").cast("long").alias("change_count"))


def _edge(df: DataFrame, *more) -> DataFrame:
    return df.select("id", "src", "dst", "type", *more)


QUERIES: dict = {}
ORACLE: dict[str, str] = {}

_T = lambda c: f"coalesce({c}, '') as {c}"
_L = lambda c: f"list_transform(coalesce({c}, []), lambda x: coalesce(x, '')) as {c}"
_ARRAYS = ("files", "imports", "literals", "properties", "embeds", "watches", "calls", "implements", "env_vars")
BASE = f"""e0 as (select * from entities qualify row_number() over (partition by ent_id order by loaded_at desc) = 1),
e as (select repo, ent_id, ord, repo || '/' || coalesce(id, '') as id, coalesce(id, '') as local_id,
  {', '.join(map(_T, ('name', 'kind', 'description', 'package', 'last_author', 'last_modified', 'source_file')))},
  {', '.join(map(_L, _ARRAYS))}, coalesce(change_count, 0) as change_count, coalesce(source_line, 0) as source_line
  from e0 qualify row_number() over (partition by repo, id order by ord, ent_id) = 1),
r0 as (select * from relationships qualify row_number() over (partition by rel_id order by loaded_at desc) = 1),
r as (select repo, ord, rel_id, repo || '/' || coalesce(id, '') as id, repo || '/' || coalesce(src, '') as src, repo || '/' || coalesce(dst, '') as dst,
  {', '.join(map(_T, ('type', 'confidence', 'ev_file', 'ev_snippet')))}, coalesce(ev_line, 0) as ev_line
  from r0 qualify row_number() over (partition by repo, id order by ord, rel_id) = 1),
root as (select dst as id from r where type = 'calls' and dst in (select id from e where kind = 'function') group by dst order by count(*) desc, dst limit 1),
ctl as (select id from e where kind = 'controller' order by id limit 1)"""
_BRIEF = "id, name, kind, source_file, cast(source_line as bigint) as source_line"
_TIMED = "id, last_author, last_modified, cast(change_count as bigint) as change_count"
_EDGE = "id, src, dst, type"


def query(name: str, sql: str | None = None, base: bool = True, recursive: bool = False):
    def add(f):
        QUERIES[name] = lambda spark, d: f(spark, d, _graph(spark, d)) if base else f(spark, d)
        if sql:
            body = sql.strip()
            lead = f"with {'recursive ' if recursive else ''}{BASE}"
            ORACLE[name] = (lead + (", " + body[5:] if body.startswith("with ") else "\n" + body)) if base else body
        return f

    return add


# Lookups, search, counts, history


@query("stats_by_kind", "select kind, count(*) as n from e group by kind")
def _(spark, d, g):
    return lookup.stats(g)[0].select("kind", F.col("count").alias("n"))


@query("stats_by_rel", "select type, count(*) as n from r group by type")
def _(spark, d, g):
    return lookup.stats(g)[1].select("type", F.col("count").alias("n"))


@query("entity_get", f"select {_BRIEF}, description from e where id = (select id from root)")
def _(spark, d, g):
    return _brief(lookup.get(g, _root(spark, d)), "description")


@query("entity_batch", f"select {_BRIEF}, case when id = (select id from root) then cast(0 as bigint) else 2 end as pos from e where id in (select id from root union select id from ctl)")
def _(spark, d, g):
    return _brief(lookup.batch(g, [_root(spark, d), "no/such:id", _controller(spark, d)]), "pos")


@query("lookup_kind_name", f"select {_BRIEF} from e where kind = 'function' and contains(lower(name), 'snapshot') order by id limit 20")
def _(spark, d, g):
    return _brief(lookup.lookup(g, "Function", "SNAPSHOT", 20))


@query("rels_from", f"select {_EDGE} from r where src = (select id from ctl)")
def _(spark, d, g):
    return _edge(lookup.incident(g, _controller(spark, d), "from"))


@query("rels_to", f"select {_EDGE} from r where dst = (select id from root) and type = 'calls'")
def _(spark, d, g):
    return _edge(lookup.incident(g, _root(spark, d), "to", "calls"))


@query("rels_both", f"select {_EDGE} from r where src = (select id from root) union all select {_EDGE} from r where dst = (select id from root)")
def _(spark, d, g):
    return _edge(lookup.incident(g, _root(spark, d)))


def _tier(t: str) -> str:
    any_ = lambda c: f"len(list_filter({c}, lambda x: contains(lower(x), '{t}'))) > 0"
    return (
        f"greatest(case when contains(lower(name), '{t}') then 100 else 0 end, case when contains(lower(id), '{t}') then 90 else 0 end, case when contains(lower(description), '{t}') then 70 else 0 end, "
        f"case when contains(lower(package), '{t}') then 60 else 0 end, case when {any_('imports')} then 40 else 0 end, case when {any_('literals')} then 30 else 0 end, case when {any_('properties')} then 20 else 0 end)"
    )


def _search_sql(*terms: str, limit: int = 20) -> str:
    some = " and ".join(f"{_tier(t)} > 0" for t in terms)
    return f"select id, name, kind, cast({' + '.join(map(_tier, terms))} as bigint) as score from e where {some} order by score desc, id" + (f" limit {limit}" if limit else "")


def _found(df: DataFrame) -> DataFrame:
    return df.select("id", "name", "kind", F.col("score").cast("long").alias("score"))


@query("search_single", _search_sql("snapshot"))
def _(spark, d, g):
    return _found(lookup.search(g, "Snapshot"))


@query("search_and", _search_sql("merge", "secret", limit=0))
def _(spark, d, g):
    return _found(lookup.search(g, "  merge SECRET", 0))


@query("search_array_tiers", _search_sql("limits.yaml", limit=0))
def _(spark, d, g):
    return _found(lookup.search(g, "limits.yaml", 0))


@query("where_path", f"select {_BRIEF} from e where contains(lower(source_file), 'controllers/') or len(list_filter(files, lambda x: contains(lower(x), 'controllers/'))) > 0 order by id limit 30")
def _(spark, d, g):
    return _brief(lookup.where(g, "controllers/"))


@query("callers", f"select {_BRIEF} from e where id in (select src from r where type = 'calls' and dst = (select id from root))")
def _(spark, d, g):
    return _brief(lookup.callers(g, _root(spark, d)))


@query("hotspots", f"select {_TIMED} from e where change_count <> 0 order by change_count desc, id limit 20")
def _(spark, d, g):
    return _timed(lookup.hotspots(g))


@query("stalest", f"select {_TIMED} from e where kind = 'function' and change_count <> 0 order by last_modified, id limit 20")
def _(spark, d, g):
    return _timed(lookup.hotspots(g, "function", stale=True))


@query("temporal_since_author", f"select {_TIMED} from e where contains(lower(last_author), '@ops') and last_modified >= '{SINCE}' and (change_count <> 0 or last_modified <> '') order by last_modified desc, id limit 20")
def _(spark, d, g):
    return _timed(lookup.temporal(g, since=SINCE, author="@OPS"))


@query("temporal_all", f"select {_TIMED} from e where change_count <> 0 or last_modified <> '' order by change_count desc, id limit 20")
def _(spark, d, g):
    return _timed(lookup.temporal(g))


@query("commits", f"select {_TIMED} from e where last_modified >= '{SINCE}' and contains(lower(name), 'quota') order by last_modified desc, id limit 20")
def _(spark, d, g):
    return _timed(lookup.commits(g, "quota", SINCE))


# Traversals

_AROUND = """with recursive both_ways as (select src as a, dst as b from r union select dst, src from r),
walk as (select id, 0 as level from root union select b.b, w.level + 1 from walk w join both_ways b on b.a = w.id where w.level < {0}),
near as (select id, min(level) as level from walk group by id) """
for _depth in (1, 2, 3):

    @query(f"context_d{_depth}_nodes", "with " + _AROUND.format(_depth)[15:] + f"select {_BRIEF} from e where id in (select id from near) order by id limit 50", recursive=True)
    def _(spark, d, g, depth=_depth):
        return _brief(traverse.context(g, _root(spark, d), depth)[0])


@query(
    "context_d2_edges",
    "with " + _AROUND.format(2)[15:] + "select r.id, r.src, r.dst, r.type from r join near n on n.id = r.src and n.level < 2 union all select r.id, r.src, r.dst, r.type from r join near n on n.id = r.dst and n.level < 2",
    recursive=True,
)
def _(spark, d, g):
    return _edge(traverse.context(g, _root(spark, d), 2)[1])


_ENDS = """with x as (select r.id, r.src, r.dst, r.type, o.name as other_name, row_number() over (partition by r.type order by r.ord, r.id) as n
from r join e o on o.id = r.{1} where r.{0} = (select id from {2})) select id, src, dst, type, other_name, n from x where n <= 20"""


@query("investigate_out", _ENDS.format("src", "dst", "ctl"))
def _(spark, d, g):
    return _edge(traverse.investigate(g, _controller(spark, d))["out"], "other_name", F.col("n").cast("long").alias("n"))


@query("investigate_in", _ENDS.format("dst", "src", "root"))
def _(spark, d, g):
    return _edge(traverse.investigate(g, _root(spark, d))["in"], "other_name", F.col("n").cast("long").alias("n"))


@query("investigate_callers", f"select {_BRIEF} from e where id in (select src from r where type = 'calls' and dst = (select id from root))")
def _(spark, d, g):
    return _brief(traverse.investigate(g, _root(spark, d))["callers"])


@query("investigate_tests", _ENDS.format("src", "dst", "(select min(src) as id from r where type = 'tested_by')").replace("where n <= 20", "where n <= 20 and type = 'tested_by'"))
def _(spark, d, g):
    tested = g.edges.filter("type = 'tested_by'").agg(F.min("src")).first()[0] or ""
    return _edge(traverse.investigate(g, tested)["tests"], "other_name", F.col("n").cast("long").alias("n"))


@query(
    "investigate_siblings",
    f"with me as (select id, source_file from e where id = (select id from ctl)), near as (select e.* from e, me where contains(lower(e.source_file), lower(me.source_file)) or len(list_filter(e.files, lambda x: contains(lower(x), lower(me.source_file)))) > 0 order by e.id limit 21) select {_BRIEF} from near where id <> (select id from me) order by id limit 20",
)
def _(spark, d, g):
    return _brief(traverse.investigate(g, _controller(spark, d))["siblings"])


def _up_sql(roots: str = "select id from e where kind = 'function' and id in (select dst from c)", depth: int = traverse.DEPTH, most: int = traverse.CHAIN) -> str:
    """The capped walk, level by level: f0 .. are the frontiers, chain all of them."""
    out = [
        "with pair as (select dst, src, min((ord, id)) as o from r where type = 'calls' and src in (select id from e) group by dst, src)",
        "c as (select dst, src, row_number() over (partition by dst order by o, src) as rk from pair)",
        f"f0 as (select id as root, id, 0 as level, 1 as pos from ({roots}))",
    ]
    for n in range(1, depth + 1):
        seen = " union all ".join(f"select root, id, pos from f{i}" for i in range(n))
        out += [
            f"s{n} as ({seen})",
            f"t{n} as (select f.root, c.src as id, min(f.pos * 1000000 + c.rk) as k from f{n - 1} f join c on c.dst = f.id where not exists (select 1 from s{n} s where s.root = f.root and s.id = c.src) group by f.root, c.src)",
            f"u{n} as (select t.root, t.id, t.k, z.n, y.lead, row_number() over (partition by t.root order by t.k) as i from t{n} t join (select root, max(pos) as n from s{n} group by root) z using (root) join (select root, min(pos) as lead from f{n - 1} group by root) y using (root))",
            f"f{n} as (select root, id, {n} as level, n + i as pos from u{n} where case when n < {most} then i <= {most} - n else i = 1 and k // 1000000 = lead end)",
        ]
    return ", ".join(out) + ", chain as (" + " union all ".join(f"select * from f{n}" for n in range(depth + 1)) + ") "


_UP = _up_sql()
_CHAIN_COLS = "cast(level as bigint) as level, cast(pos as bigint) as pos"


@lru_cache(maxsize=4)
def _all_chains(spark, d):
    g = _graph(spark, d)
    called = g.edges.filter("type = 'calls'").join(g.names.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    return traverse.impact(g, g.entities.filter("kind = 'function'").join(called, "id", "left_semi").select("id"))


def _chained(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.col("level").cast("long").alias("level"), F.col("pos").cast("long").alias("pos"))


@query("impact_all_roots", _UP + f"select root, id, {_CHAIN_COLS} from chain")
def _(spark, d, g):
    return _chained(_all_chains(spark, d), "root", "id")


@query("impact_capped_roots", _UP + f"select root, id, {_CHAIN_COLS} from chain where root in (select root from chain group by root having count(*) >= {traverse.CHAIN})")
def _(spark, d, g):
    chains = _all_chains(spark, d)
    capped = chains.groupBy("root").count().filter(F.col("count") >= traverse.CHAIN).select("root")
    return _chained(chains.join(capped, "root", "left_semi"), "root", "id")


@query("impact_chain", _UP + f"select id, {_CHAIN_COLS} from chain where root = (select id from root)")
def _(spark, d, g):
    return _chained(traverse.impact(g, g.nodes(_root(spark, d)).select("id")), "id")


def _impact_part(name: str, sql: str, cols: list[str]):
    @query(f"impact_{name}", _UP + sql)
    def _(spark, d, g):
        return traverse.impact_parts(g, _all_chains(spark, d))[name].select(*cols)


_impact_part("controllers", "select p.root, e.id, e.name from chain p join e using (id) where e.kind = 'controller'", ["root", "id", "name"])
_impact_part("files", "select distinct p.root, e.source_file from chain p join e using (id) where e.source_file <> ''", ["root", "source_file"])
_impact_part("owners", "select distinct p.root, e.last_author from chain p join e using (id) where e.last_author <> ''", ["root", "last_author"])
_impact_part("recent", "select p.root, e.id, e.last_modified from chain p join e using (id) where e.last_modified <> ''", ["root", "id", "last_modified"])
_REACH = "select root, id, name from (select *, row_number() over (partition by root order by id) as n from (select distinct p.root, o.id, o.name from chain p join r on r.src = p.id join e o on o.id = r.dst where r.type in ({}))) where n <= 30"
_impact_part("tests", _REACH.format("'tested_by'"), ["root", "id", "name"])
_impact_part("resources", _REACH.format("'reconciles', 'creates'"), ["root", "id", "name"])


@query("explain_tree")
def _(spark, d, g):
    tree, capped = traverse.explain(g, _controller(spark, d), 3)
    return spark.createDataFrame([(*x, capped) for x in tree], "pos long, depth long, parent string, type string, id string, capped boolean")


# Building edges

_RESOLVE = """with f as (select *, regexp_replace(local_id, '^function:', '') as q from e where kind = 'function'),
site as (select repo, id as src, kind, package, unnest(calls) as call from e where kind in ('function', 'controller')),
s as (select *, regexp_extract(call, '([^.]*)$', 1) as bare from site),
ok as (select * from s where bare <> '' and bare not in (""" + ", ".join(f"'{x}'" for x in build.SKIPPED) + """)),
byname as (select repo, name, count(*) as n, min(id) as u from f group by all),
bypkg as (select repo, package, name, count(*) as n, min(id) as p from f where package <> '' group by all),
res as (select ok.repo, ok.src, ok.kind, ok.call, case when contains(ok.call, '.') then f.id end as q, case when b.n = 1 then b.u end as u, case when b.n > 1 and k.n = 1 then k.p end as p
  from ok left join f on f.repo = ok.repo and f.q = ok.call left join byname b on b.repo = ok.repo and b.name = ok.bare left join bypkg k on k.repo = ok.repo and k.package = ok.package and k.name = ok.bare),
got as (select *, coalesce(q, u, p) as dst, case when q is not null then 'qualified' when u is not null then 'unique' else 'package' end as how from res where coalesce(q, u, p) is not null) """


@query("resolve_calls", _RESOLVE + "select distinct src, call, dst, how from got")
def _(spark, d, g):
    return build.resolve_calls(g.entities, SCOPE).select("src", "call", "dst", "how").distinct()


@query("edges_calls", _RESOLVE + "select distinct src, dst from got where src <> dst or kind <> 'function'")
def _(spark, d, g):
    return build.call_edges(g.entities, SCOPE).select("src", "dst").distinct()


_WATCH = """with t as (select repo, name, arg_max(id, (ord, id)) as dst from e where kind in ('crd', 'resource') group by all),
w as (select repo, id as src, unnest(watches) as watch, generate_subscripts(watches, 1) as pos from e where kind = 'controller') select distinct w.src, t.dst from w join t on t.repo = w.repo and t.name = w.watch where w.pos {} 1"""
for _type, _sign in (("reconciles", "="), ("watches", ">")):

    @query(f"edges_{_type}", _WATCH.format(_sign))
    def _(spark, d, g, kind=_type):
        return build.watch_edges(g.entities, SCOPE).filter(F.col("type") == kind).select("src", "dst").distinct()


# In the delivered rows no interface bears a function's name, no manifest lies below the parent of
# a package with embeds and no test is named after a function of its package, so these three are
# given rows that do: interfaces named by what a function calls first, manifests moved from config
# to internal, tests named after the first function of their package.

_DIR = "case when contains({0}, '/') then regexp_replace({0}, '/[^/]*$', '') else '.' end"
_IMPLEMENTS = "ff as (select repo, name, arg_min(id, (ord, id)) as dst from e where kind = 'function' group by all), i as (select repo, id as src, regexp_extract(calls[1], '([^.]*)$', 1) as bare from e where len(calls) > 0), implements_ as (select distinct i.src, ff.dst from i join ff on ff.repo = i.repo and ff.name = i.bare)"
_EMBEDS = f"p as (select repo, id as src, {_DIR.format('source_file')} as parent from e where kind = 'package' and len(embeds) > 0), h as (select repo, id as dst, {_DIR.format('m')} as dir from (select *, regexp_replace(source_file, '^config/', 'internal/') as m from e where kind in ('crd', 'resource'))), embeds_ as (select distinct p.src, h.dst from p join h on h.repo = p.repo and starts_with(h.dir, p.parent))"
_TESTED = "fl as (select repo, package, name, arg_max(id, (ord, id)) as src from e where kind = 'function' group by all), fm as (select repo, package, min(name) as name from e where kind = 'function' group by all), tested_ as (select fl.src, t.id as dst from e t join fm on fm.repo = t.repo and fm.package = t.package join fl on fl.repo = t.repo and fl.package = t.package and fl.name = fm.name where t.kind = 'test')"


def _matching(g: Graph) -> DataFrame:
    """Entities that all kinds of edges are made of."""
    named = g.entities.filter("kind = 'function'").groupBy("repo", "package").agg(F.min("name").alias("_named"))
    rows = g.entities.join(named, ["repo", "package"], "left")
    return rows.withColumns({
        "implements": F.slice("calls", 1, 1), "name": F.when(F.col("kind") == "test", F.coalesce(F.concat(F.lit("Test"), F.col("_named")), "name")).otherwise(F.col("name")),
        "source_file": F.when(F.col("kind").isin("crd", "resource"), F.regexp_replace("source_file", "^config/", "internal/")).otherwise(F.col("source_file")),
    }).drop("_named")


@query("edges_implements", "with " + _IMPLEMENTS + " select src, dst from implements_")
def _(spark, d, g):
    return build.implement_edges(_matching(g), SCOPE).select("src", "dst").distinct()


@query("edges_embeds", "with " + _EMBEDS + " select src, dst from embeds_")
def _(spark, d, g):
    return build.embed_edges(_matching(g), SCOPE).select("src", "dst").distinct()


@query("edges_tested_by", "with " + _TESTED + " select src, dst from tested_")
def _(spark, d, g):
    return build.test_edges(_matching(g), SCOPE).select("src", "dst")


_ALL_EDGES = _RESOLVE + ", wt as (select repo, name, arg_max(id, (ord, id)) as dst from e where kind in ('crd', 'resource') group by all), w as (select repo, id as src, unnest(watches) as watch, generate_subscripts(watches, 1) as pos from e where kind = 'controller'), " + ", ".join((_IMPLEMENTS, _EMBEDS, _TESTED)) + """,
made as (select distinct src, dst, 'calls' as type from got where src <> dst or kind <> 'function'
  union select w.src, wt.dst, case when w.pos = 1 then 'reconciles' else 'watches' end from w join wt on wt.repo = w.repo and wt.name = w.watch
  union select src, dst, 'implements' from implements_ union select src, dst, 'embeds' from embeds_ union select src, dst, 'tested_by' from tested_)
select made.src || '--' || type || '--' || made.dst as id, made.src, made.dst, type, case when type = 'reconciles' then 'proven' else 'inferred' end as confidence, 'graph' as ev_parser,
  case when kind in ('crd', 'resource') then regexp_replace(source_file, '^config/', 'internal/') else source_file end as ev_file, cast(case when type = 'embeds' then 1 else source_line end as bigint) as ev_line from made join e on e.id = made.src"""


@query("edges_all", _ALL_EDGES)
def _(spark, d, g):
    return build.edges(_matching(g), SCOPE).drop("made_at", "ev_reason").withColumn("ev_line", F.col("ev_line").cast("long"))


# Maintenance


_MERGE = """with d as (select repo, coalesce(id, '') as id, ord, ent_id, coalesce(name, '') as name, """ + ", ".join(map(_L, ("files", "imports", "literals", "properties", "embeds"))) + """ from e0),
parts as (""" + " union all ".join(f"select repo, id, '{c}' as field, x, min((ord, ent_id, i)) as place from (select repo, id, ord, ent_id, unnest({c}) as x, generate_subscripts({c}, 1) as i from d) group by all" for c in ("files", "imports", "literals", "properties", "embeds")) + """),
u as (select repo, id, field, string_agg(x, '|' order by place) as v from parts group by all)
select d.repo, d.id, arg_min(d.name, (d.ord, d.ent_id)) as name, """ + ", ".join(f"coalesce(max(case when u.field = '{c}' then u.v end), '') as {c}" for c in ("files", "imports", "literals", "properties", "embeds")) + " from d left join u on u.repo = d.repo and u.id = d.id group by d.repo, d.id"


@query("dedup_merge", _MERGE)
def _(spark, d, g):
    rows = normalise(latest(table(spark, d, "entities"), "ent_id")).drop("loaded_at")
    out = merged(rows, ["repo", "id"], ["ord", "ent_id"])
    return out.select("repo", "id", "name", *[F.array_join(c, "|").alias(c) for c in ("files", "imports", "literals", "properties", "embeds")])


_LISTS = """with one as (select repo, branch, commit_sha, min(graph_id) as graph_id, arg_min(generated_at, graph_id) as made from graph_meta group by all),
s as (select repo, repo || '@' || branch as tree, graph_id, row_number() over (partition by repo, branch order by try_cast(made as timestamptz) desc nulls last, made desc, graph_id desc) as n from one),
f as (select s.tree, s.n, s.tree || ':' || t.path as path, strftime(try_cast(modified as timestamptz) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') as m from file_timestamps t join s using (graph_id) where n <= 2),
a as (select * from f where n = 1), b as (select * from f where n = 2),
listing as (select coalesce(a.path, b.path) as path, case when a.path is null then 'deleted' when b.m is null or a.m <> b.m then 'changed' else 'unchanged' end as status from a full join b on a.path = b.path) """


def _listings(spark, d):
    """(new, old): the files of the last two snapshots of each branch."""
    from pyspark.sql import Window

    from skein.common import instant

    meta = table(spark, d, "graph_meta")
    one = meta.groupBy("repo", "branch", "commit_sha").agg(F.min(F.struct("graph_id", "generated_at")).alias("m"))
    w = Window.partitionBy("repo", "branch").orderBy(instant("m.generated_at").desc_nulls_last(), F.desc("m.generated_at"), F.desc("m.graph_id"))
    s = one.select("repo", "branch", F.col("m.graph_id").alias("graph_id"), F.row_number().over(w).alias("n"))
    f = table(spark, d, "file_timestamps").join(s.filter("n <= 2"), "graph_id")
    f = f.select("n", *_TREE, "path", maintain.second(F.col("modified").try_cast("timestamp")).alias("modified"))
    return f.filter("n = 1").drop("n"), f.filter("n = 2").drop("n")


@query("changed_files", _LISTS + "select path, status from listing")
def _(spark, d, g):
    status = maintain.changed_files(*_listings(spark, d), _TREE)
    return status.select(F.concat("repo", F.lit("@"), "branch", F.lit(":"), "path").alias("path"), "status")


@query("carry_over", _LISTS + """, u as (select s.repo, substr(l.path, length(s.tree) + 2) as path from listing l join s on starts_with(l.path, s.tree || ':') and s.n = 1 where l.status = 'unchanged')
select distinct e.id, e.source_file from e where exists (select 1 from u where u.repo = e.repo and (u.path = e.source_file or starts_with(u.path, e.source_file || '/') or e.source_file = '.'))""")
def _(spark, d, g):
    """Entities of the files that the last two snapshots of a branch have unchanged."""
    same = maintain.changed_files(*_listings(spark, d), _TREE).filter("status = 'unchanged'")
    return maintain.carry_over(g.entities, same.select("repo", "path").distinct(), SCOPE).select("id", "source_file")


_COMMITS = """with c as (select coalesce(repo, '') as repo, loaded_at, ev_file as path, rel_id, 'user' || (rel_id % 7) as author from r0 where coalesce(ev_file, '') <> ''),
h as (select repo, path, arg_max(author, (loaded_at, rel_id)) as last_author, strftime(date_trunc('second', max(loaded_at)), '%Y-%m-%dT%H:%M:%SZ') as last_modified, count(*) as change_count from c group by repo, path) """


@query("temporal_enrich", _COMMITS + "select e.id, coalesce(h.last_author, e.last_author) as last_author, coalesce(h.last_modified, e.last_modified) as last_modified, cast(coalesce(h.change_count, e.change_count) as bigint) as change_count from e left join h on h.repo = e.repo and h.path = e.source_file")
def _(spark, d, g):
    """History made of the deliveries of edges, one commit each."""
    rows = normalise(once(table(spark, d, "relationships"), "rel_id")).filter("ev_file <> ''")
    seq = F.struct((-F.unix_micros("loaded_at")).alias("t"), (-F.col("rel_id")).alias("i"))
    commits = rows.select("repo", seq.alias("seq"), F.concat(F.lit("user"), F.col("rel_id") % 7).alias("author"), F.unix_seconds("loaded_at").alias("ts"), F.col("ev_file").alias("path"))
    return maintain.enrich(g.entities, maintain.history(commits, SCOPE), SCOPE).select("id", "last_author", "last_modified", F.col("change_count").cast("long").alias("change_count"))


@query(
    "validate_graph",
    """with d as (select repo || '/' || coalesce(id, '') as id, coalesce(source_file, '') as source_file from e0), i as (select distinct id from d),
q as (select repo || '/' || coalesce(id, '') as id, repo || '/' || coalesce(src, '') as src, repo || '/' || coalesce(dst, '') as dst, coalesce(confidence, '') as confidence, coalesce(ev_file, '') as ev_file from r0)
select 'duplicate entity' as rule, id as subject from d group by id having count(*) > 1
union all select 'missing source file', id from d where source_file = ''
union all select 'unknown source', id from q where src not in (select id from i)
union all select 'unknown target', id from q where dst not in (select id from i)
union all select 'duplicate edge', id from q group by id having count(*) > 1
union all select 'bad confidence', id from q where confidence not in ('proven', 'inferred')
union all select 'missing evidence file', id from q where ev_file = ''""",
)
def _(spark, d, g):
    q = lambda c: F.concat_ws("/", "repo", c)
    e = normalise(latest(table(spark, d, "entities"), "ent_id"))
    r = normalise(latest(table(spark, d, "relationships"), "rel_id"))
    return maintain.validate(Graph(e.withColumn("id", q("id")), r.withColumns({"id": q("id"), "src": q("src"), "dst": q("dst")})))


# Views and questions


def _ends(edge: str, here: str, there: str, how: str) -> str:
    agg = {"last": "arg_max(o.name, (r.ord, r.id))", "all": "string_agg(o.name, ', ' order by o.name)"}
    if how == "ten":
        return f"(select id, string_agg(name, ', ' order by name) as v from (select r.{here} as id, o.name, row_number() over (partition by r.{here} order by r.ord, r.id) as n from r join e o on o.id = r.{there} where r.type = '{edge}') where n <= 10 group by id)"
    return f"(select r.{here} as id, {agg[how]} as v from r join e o on o.id = r.{there} where r.type = '{edge}' group by r.{here})"


_VIEW = f"""with crn as (select r.src as id, list(o.name) as v from r join e o on o.id = r.dst where r.type = 'creates' group by r.src),
said as (select id, list_transform(list_filter(properties, lambda p: starts_with(p, 'creates:')), lambda p: p[9:]) as v from e),
v as (select e.id, e.name, e.kind, e.files, case when e.last_author <> '' then e.last_author else '' end as owners,
  case when kind = 'controller' then coalesce(a.v, '') else '' end as reconciles, case when kind = 'controller' then array_to_string(e.watches, ', ') else '' end as watches,
  case when kind = 'controller' then array_to_string(list_sort(list_concat(coalesce(b.v, []), list_distinct(list_filter(s.v, lambda x: not list_contains(coalesce(b.v, []), x))))), ', ') else '' end as creates,
  case when kind = 'controller' then coalesce(c.v, '') else '' end as calls, coalesce(t.v, '') as tests, case when kind = 'controller' then coalesce(cb.v, '') else '' end as called_by,
  case when kind = 'crd' then coalesce(rb.v, '') else '' end as reconciled_by, case when kind = 'crd' then coalesce(db.v, '') else '' end as created_by
  from e left join {_ends('reconciles', 'src', 'dst', 'last')} a on a.id = e.id left join crn b on b.id = e.id left join said s on s.id = e.id left join {_ends('calls', 'src', 'dst', 'ten')} c on c.id = e.id
  left join {_ends('tested_by', 'src', 'dst', 'all')} t on t.id = e.id left join {_ends('calls', 'dst', 'src', 'all')} cb on cb.id = e.id left join {_ends('reconciles', 'dst', 'src', 'last')} rb on rb.id = e.id left join {_ends('creates', 'dst', 'src', 'all')} db on db.id = e.id
  where kind in ('controller', 'crd')) """
_VIEW_COLS = ["id", "name", "reconciles", "watches", "creates", "calls", "tests", "called_by", "reconciled_by", "created_by"]


def _flat(v: DataFrame) -> DataFrame:
    return v.select(*[F.array_join(c, ", ").alias(c) if t.startswith("array") else F.col(c) for c, t in v.dtypes if c in _VIEW_COLS])


@query("view_controller", _VIEW + f"select {', '.join(_VIEW_COLS)} from v where kind = 'controller'")
def _(spark, d, g):
    return _flat(views.compile_views(g).filter("kind = 'controller'"))


@query("view_crd", _VIEW + f"select {', '.join(_VIEW_COLS)} from v where kind = 'crd'")
def _(spark, d, g):
    return _flat(views.compile_views(g).filter("kind = 'crd'"))


_QUESTIONS = _VIEW + ", q as (" + " union all ".join(
    f"select '{verb}' as verb, name as subject, {col} as answer, id from v"
    for verb, col in zip(views.VERBS, ("reconciles", "reconciled_by", "creates", "created_by", "tests", "owners", "array_to_string(files, ', ')", "watches"))
) + "), a as (select verb, subject, arg_max(answer, id) as answer from q where answer <> '' group by verb, subject) "


@query("questions", _QUESTIONS + "select verb, subject, answer from a")
def _(spark, d, g):
    return views.questions(views.compile_views(g))


@query("ask_quick_answer", _QUESTIONS + "select subject, verb || ': ' || answer as answer from (select *, row_number() over (partition by subject order by case verb when 'reconciles' then 0 when 'creates' then 1 when 'tests' then 2 else 3 end) as n from a where verb in ('reconciles', 'creates', 'tests', 'watches')) where n = 1")
def _(spark, d, g):
    q = views.questions(views.compile_views(g)).filter(F.col("verb").isin(views.QUICK))
    rank = F.array_position(F.array(*map(F.lit, views.QUICK)), F.col("verb"))
    first = q.groupBy("subject").agg(F.min_by(F.struct("verb", "answer"), rank).alias("a"))
    return first.select("subject", F.concat("a.verb", F.lit(": "), "a.answer").alias("answer"))


@query("view_search", "with v as (select id, name from e where kind in ('controller', 'crd')) select id, name from v where contains(lower(name), 'graph') order by case when lower(name) = 'graph' then 0 else 1 end, lower(name), id limit 1")
def _(spark, d, g):
    return views.view_by_name(views.compile_views(g), "graph").select("id", "name")


# Review

_DIFF = """with paths as (select repo, source_file as path, dense_rank() over (order by repo, source_file) as k from (select distinct repo, source_file from e where source_file like '%.go' or source_file like '%.yaml')),
df as (select repo, path, k, case k % 4 when 0 then 'A' when 1 then 'M' when 2 then 'D' else 'R' end as status from paths
  union all select repo, path || '.extra.go', k, 'M' from paths where k % 5 = 0),
hk as (select repo, path, 10 * i as s, (k + i) % 7 as c from df, (select unnest([1, 3, 6]) as i)) """


def _diff(spark, d, g):
    """A made-up diff over every source file: statuses in turn, three hunks each."""
    paths = g.entities.filter(F.col("source_file").endswith(".go") | F.col("source_file").endswith(".yaml")).select("repo", F.col("source_file").alias("path")).distinct()
    k = ranked(paths, "repo", "path", name="k")
    status = F.element_at(F.array(*map(F.lit, "AMDR")), (F.col("k") % 4 + 1).cast("int"))
    files = k.select("repo", "path", "k", status.alias("status")).unionByName(k.filter("k % 5 = 0").select("repo", F.concat("path", F.lit(".extra.go")).alias("path"), "k", F.lit("M").alias("status")))
    hunks = files.select("repo", "path", "k", F.explode(F.array(*map(F.lit, (1, 3, 6)))).alias("i")).select("repo", "path", (F.col("i") * 10).alias("new_start"), ((F.col("k") + F.col("i")) % 7).cast("int").alias("new_count"))
    return files, hunks


@query(
    "diff_map_entities",
    _DIFF + """, x as (select repo, source_file as path, id, source_line as first, lead(source_line) over (partition by repo, source_file order by source_line, id) as nxt from e),
y as (select *, case when nxt is null then 2147483647 else greatest(first, nxt - 1) end as last from x),
m as (select distinct y.id, true as approximate from y join df on df.repo = y.repo and df.path = y.path and df.status in ('M', 'R') join hk on hk.repo = y.repo and hk.path = y.path where hk.s <= y.last and greatest(hk.s, hk.s + hk.c - 1) >= y.first)
select id, approximate from m union all select y.id, false from y join df on df.repo = y.repo and df.path = y.path and df.status = 'A'""",
)
def _(spark, d, g):
    return review.changed_entities(g.entities, *_diff(spark, d, g), scope=SCOPE).select("id", "approximate")


@query("diff_unmapped", _DIFF + "select repo, path, status from df where path like '%.go' and (status = 'D' or not exists (select 1 from e where e.repo = df.repo and e.source_file = df.path))")
def _(spark, d, g):
    return review.unmapped(g.entities, _diff(spark, d, g)[0], SCOPE)


@query(
    "test_targets",
    """with t as (select repo, package, id as test, lower(regexp_replace(name, '^Test', '')) as t, regexp_replace(source_file, '_test\\.go$', '') as stem from e where kind = 'test'),
f as (select repo, package, id as target, lower(name) as f, regexp_replace(source_file, '\\.go$', '') as stem, ord from e where kind = 'function'),
n as (select t.repo, t.package, test, arg_min(target, (ord, target)) as target from t join f on f.repo = t.repo and f.package = t.package where contains(t, f) or contains(f, t) group by all)
select test, target, 'naming convention' as reason from n
union all select t.test, f.target, 'same file' from t join f on f.repo = t.repo and f.package = t.package and f.stem = t.stem where t.test not in (select test from n)""",
)
def _(spark, d, g):
    part = lambda kind: g.entities.filter(F.col("kind") == kind).select("repo", "package", "id", "name", F.col("source_file").alias("path"), "ord")
    return review.test_targets(part("test"), part("function"), ["repo", "package"]).select("test", "target", "reason")


@query(
    "callee_filter",
    "with c as (select distinct id, unnest(calls) as call from e) select id, call from c where not (contains(call, '.') and split_part(call, '.', 1) in ("
    + ", ".join(f"'{x}'" for x in review.NOISE_PACKAGES) + ")) and regexp_extract(call, '([^.]*)$', 1) not in (" + ", ".join(f"'{x}'" for x in review.NOISE_METHODS) + ")",
)
def _(spark, d, g):
    return g.entities.select("id", F.explode(F.array_distinct("calls")).alias("call")).filter(~review.is_noise("call"))


@query("import_origin", "with p as (select distinct trim(unnest(imports), chr(32) || chr(9) || chr(10)) as path from e) select path, case " + " ".join(f"when starts_with(path, '{k}') then '{v}'" for k, v in sorted(origin.PREFIXES.items(), key=lambda kv: (-len(kv[0]), kv[0]))) + " else '' end as origin from p where path <> ''")
def _(spark, d, g):
    return _imports(g).select("path", "origin")


@query("import_stdlib", "with p as (select distinct trim(unnest(imports), chr(32) || chr(9) || chr(10)) as path from e) select path, not contains(split_part(path, '/', 1), '.') as stdlib from p where path <> ''")
def _(spark, d, g):
    return _imports(g).select("path", "stdlib")


def _imports(g: Graph) -> DataFrame:
    paths = g.entities.select(F.explode("imports").alias("p")).select(F.regexp_replace("p", r"^[ \t\n]+|[ \t\n]+$", "").alias("path"))
    return origin.classify(paths.filter("path <> ''").distinct())


@query("short_names", "select id, regexp_extract(regexp_replace(id, '^[^:]*:', ''), '([^.]*)$', 1) as short from e")
def _(spark, d, g):
    return g.entities.select("id", short_name("id").alias("short"))


_CHANGED = _DIFF + f""", x as (select repo, source_file as path, id, kind, source_line as first, lead(source_line) over (partition by repo, source_file order by source_line, id) as nxt from e),
y as (select *, case when nxt is null then 2147483647 else greatest(first, nxt - 1) end as last from x),
touched as (select y.id, y.kind from y join df on df.repo = y.repo and df.path = y.path and df.status in ('M', 'R') join hk on hk.repo = y.repo and hk.path = y.path where hk.s <= y.last and greatest(hk.s, hk.s + hk.c - 1) >= y.first
  union select y.id, y.kind from y join df on df.repo = y.repo and df.path = y.path and df.status = 'A'),
subject as (select distinct id from touched where kind <> 'test'), """ + _up_sql("select id from subject")[5:] + """,
tied as (select distinct r.src as id, r.dst as other, o.name from r join subject s on s.id = r.src join e o on o.id = r.dst where r.type = 'tested_by'),
reach as (select root as id, other, name from (select *, row_number() over (partition by root order by other) as n from (select distinct p.root, o.id as other, o.name from chain p join r on r.src = p.id join e o on o.id = r.dst where r.type in ({0}))) where n <= 30) """
_REVIEW = {
    "callees": (["id", "pos", "call"], "'x'", "select e.id, e.call, cast(e.i - 1 as bigint) as pos from (select id, unnest(calls) as call, generate_subscripts(calls, 1) as i from e) e join subject using (id)"),
    "callers": (["id", "other", "name"], "'x'", "select distinct r.dst as id, r.src as other, o.name from r join subject s on s.id = r.dst join e o on o.id = r.src where r.type = 'calls'"),
    "tests": (["id", "other", "name"], "'tested_by'", "select id, other, name from tied union all select id, other, name from reach where id not in (select id from tied)"),
    "controllers": (["id", "other", "name"], "'x'", "select p.root as id, o.id as other, o.name from chain p join e o on o.id = p.id where o.kind = 'controller'"),
    "resources": (["id", "other", "name"], "'reconciles', 'creates'", "select id, other, name from reach"),
}


@lru_cache(maxsize=4)
def _analyzed(spark, d):
    g = _graph(spark, d)
    return review.analyze(g, review.changed_entities(g.entities, *_diff(spark, d, g), scope=SCOPE))


def _review_part(name: str, cols: list[str], types: str, sql: str):
    @query(f"review_{name}", _CHANGED.format(types) + sql)
    def _(spark, d, g):
        return _analyzed(spark, d)[name].select(*[F.col(c).cast("long").alias(c) if c == "pos" else c for c in cols])


for _name, _part in _REVIEW.items():
    _review_part(_name, *_part)


# Markdown headings of documents


@query(
    "md_headings",
    """with l as (select doc_id, trim(unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)))) as line, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) as i from documents where text is not null),
f as (select *, sum(case when starts_with(line, '```') then 1 else 0 end) over (partition by doc_id order by i) as marks from l),
h as (select doc_id, i, trim(ltrim(line, '#')) as h from f where marks % 2 = 0 and starts_with(line, '#'))
select doc_id, string_agg(h, '; ' order by i) as headings from h where h <> '' group by doc_id""",
    base=False,
)
def _(spark, d):
    """Headings outside fenced code, joined; one pass over a text's lines inside the JVM."""
    lines = F.transform(F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\n"), lambda x: F.trim(x))
    start = F.struct(F.lit(False).alias("fenced"), F.array().cast("array<string>").alias("found"))

    def step(acc, line):
        title = F.trim(F.regexp_replace(line, "^#+", ""))
        fence = line.startswith("```")
        taken = ~acc["fenced"] & ~fence & line.startswith("#") & (title != "")
        return F.struct((acc["fenced"] != fence).alias("fenced"), F.when(taken, F.concat(acc["found"], F.array(title))).otherwise(acc["found"]).alias("found"))

    told = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.aggregate(lines, start, step)["found"].alias("found"))
    return told.filter("size(found) > 0").select("doc_id", F.array_join("found", "; ").alias("headings"))


# Extraction from the delivered files


def _scanned(spark, d):
    """Entities of the delivered Go, YAML and Markdown files outside third-party trees."""
    from skein.sources.scan import PRUNED, extract

    files = latest(table(spark, d, "files"), "file_id")
    inner = F.exists(F.split("path", "/"), lambda p: p.isin(*PRUNED))
    rows = files.filter("content is not null").filter(~inner).select(F.concat_ws("/", "repo", F.regexp_replace("path", r"^\\./", "")).alias("path"), "content")
    return extract(rows)


@query("scan_entities", base=False)
def _(spark, d):
    return _scanned(spark, d).filter("id is not null").groupBy("kind").agg(F.count("*").alias("n"))


@query("scan_warnings_found", base=False)
def _(spark, d):
    return _scanned(spark, d).filter("warning is not null").select("path", "warning")
