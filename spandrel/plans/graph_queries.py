"""Queries of the structural verbs over the edges and entities tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.functions import text as T
from spandrel.operators import graph as G
from spandrel.tables import node_key, table

TARGET = "toolkit/errors.py::Fault"
SPOKEN = "get"


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.nodes_of(table(spark, d, "entities"), table(spark, d, "shared_entities"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return G.links_of(table(spark, d, "edges"))


def _target(spark: SparkSession, key: str = TARGET) -> DataFrame:
    return spark.createDataFrame([(key,)], "key string")


def g_radius(spark: SparkSession, d: str) -> DataFrame:
    return G.radius(_links(spark, d), _target(spark)).select("path", "name", "hops")


def g_radius_all_shared(spark: SparkSession, d: str) -> DataFrame:
    """Dependents of each shared entity, counted by hop."""
    targets = table(spark, d, "shared_entities").select(node_key(F.col("path"), F.col("name")).alias("key")).distinct()
    return G.radius(_links(spark, d), targets).groupBy("target", "hops").agg(F.count("*").alias("n"))


def g_reach(spark: SparkSession, d: str) -> DataFrame:
    """How much each function and method calls, through any number of calls."""
    sources = _nodes(spark, d).filter("kind in ('function', 'method')").select(node_key(F.col("path"), F.col("name")).alias("key"))
    return G.reach(_links(spark, d), sources).groupBy("source").agg(F.count("*").alias("n"), F.max("hops").alias("far"))


def g_ancestry(spark: SparkSession, d: str) -> DataFrame:
    """The holders of every method, innermost first."""
    targets = _nodes(spark, d).filter("kind = 'method'").select(node_key(F.col("path"), F.col("name")).alias("key"))
    return G.ancestry(_links(spark, d), targets)


def g_container_radius(spark: SparkSession, d: str) -> DataFrame:
    """Who touches what holds a class, without depending on the class."""
    targets = _nodes(spark, d).filter("kind = 'class'").select(node_key(F.col("path"), F.col("name")).alias("key"))
    return G.container_radius(_links(spark, d), targets)


def g_who_touches(spark: SparkSession, d: str) -> DataFrame:
    return G.who_touches(_links(spark, d), _target(spark)).select("kind", "src_path", "src_name", "line")


def g_card(spark: SparkSession, d: str) -> DataFrame:
    """The cards of all classes."""
    nodes = _nodes(spark, d)
    targets = nodes.filter("kind = 'class'").select(node_key(F.col("path"), F.col("name")).alias("key"))
    return G.card(nodes, _links(spark, d), targets).groupBy("target", "direction", "path", "name", "kind", "edge_kind").agg(F.count("*").alias("n"))


def g_fan_in(spark: SparkSession, d: str) -> DataFrame:
    return G.fan_in(_nodes(spark, d), _links(spark, d))


def g_load_bearing(spark: SparkSession, d: str) -> DataFrame:
    return G.load_bearing(_nodes(spark, d), _links(spark, d))


def g_system_map(spark: SparkSession, d: str) -> DataFrame:
    return G.system_map(_nodes(spark, d), _links(spark, d))


def g_direct_dependents(spark: SparkSession, d: str) -> DataFrame:
    return G.direct_dependents(_links(spark, d))


def g_handlers(spark: SparkSession, d: str) -> DataFrame:
    return G.handlers(_nodes(spark, d), _links(spark, d))


def g_radius_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.radius_graph(_nodes(spark, d), _links(spark, d), _target(spark))[0].drop("target")


def g_radius_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.radius_graph(_nodes(spark, d), _links(spark, d), _target(spark))[1].drop("target")


def g_file_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.file_graph(_nodes(spark, d), _links(spark, d), "dir")[0]


def g_file_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.file_graph(_nodes(spark, d), _links(spark, d), "dir")[1]


def g_package_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.packages(table(spark, d, "files"))[0]


def g_package_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.packages(table(spark, d, "files"))[1]


def g_tree(spark: SparkSession, d: str) -> DataFrame:
    """path, n, listing: the entities of each file in line order, as text."""
    return G.tree(_nodes(spark, d)).select("path", F.size("entities").cast("long").alias("n"), F.array_join(F.transform("entities", lambda e: e["name"]), ",").alias("listing"))


def g_find_tail(spark: SparkSession, d: str) -> DataFrame:
    """Addresses meant by the spoken name ``Client.get``'s last part."""
    return G.find(_nodes(spark, d), SPOKEN).select("path", "name", "kind", "tier")


def g_find_part(spark: SparkSession, d: str) -> DataFrame:
    """A name that only occurs inside others: every tier is tried before."""
    return G.find(_nodes(spark, d), "_Galaxy").select("path", "name", "kind", "tier")


def g_labels(spark: SparkSession, d: str) -> DataFrame:
    """What targets are called, with the number of edges."""
    e = _links(spark, d).filter("dst_path is not null or ext_name is not null")
    return e.groupBy(G.label(F.col("dst_path"), F.col("dst_name"), F.col("ext_name")).alias("label")).agg(F.count("*").alias("n"))


def g_adjacency(spark: SparkSession, d: str) -> DataFrame:
    """node, degree, weight: links both ways and the sum of their weights."""
    return G.adjacency(_links(spark, d)).groupBy("node", "degree").agg(F.round(F.sum("weight"), 6).alias("weight"))


def g_edges_by_source(spark: SparkSession, d: str) -> DataFrame:
    """kind, n, sources: edges and distinct sources by kind."""
    return _links(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("src_path", "src_name").alias("sources"))


def g_test_paths(spark: SparkSession, d: str) -> DataFrame:
    """repo, tests, files."""
    f = table(spark, d, "files").select("repo", "path").distinct()
    return f.groupBy("repo").agg(F.count_if(T.is_test_path(F.col("path"))).alias("tests"), F.count("*").alias("files"))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("g_")}

_E = "e as (select distinct id, src_path, src_name, kind, dst_path, dst_name, ext_name, line from edges where coalesce(status, '') <> 'dropped')"
_N = """own as (select path, name, min(kind) as kind, min(line) as line, min(meta) as meta, min(lower(doc_kind)) as doc_kind from entities where removed_at is null and path is not null and name is not null group by 1, 2),
n as (select * from own union all select path, name, min(kind), null, null, null from shared_entities s where not exists (select 1 from own o where o.path = s.path and o.name = s.name) group by 1, 2)"""
_IN = "('calls', 'reads', 'writes', 'inherits', 'implements', 'types')"
_P = f"p as (select distinct kind, src_path || '::' || src_name as src, dst_path || '::' || dst_name as dst, src_name from e where dst_path is not null and dst_name is not null)"
_RADIUS = f"""with recursive {_E}, {_P}, i as (select distinct src, dst from p where kind in {_IN} and src_name <> '<module>'),
w as (select '{TARGET}' as node, 0 as hops union select i.src, w.hops + 1 from w join i on i.dst = w.node where w.hops < 40),
r as (select node, min(hops) as hops from w where node <> '{TARGET}' group by 1)"""
_CLASSES = "c as (select path || '::' || name as key from n where kind = 'class')"
_DIR = "case when contains({0}, '/') then split_part({0}, '/', 1) else '.' end"

ORACLE = {
    "g_radius": f"{_RADIUS} select split_part(node, '::', 1) as path, substr(node, instr(node, '::') + 2) as name, hops from r",
    "g_radius_all_shared": f"""with recursive {_E}, {_P}, i as (select distinct src, dst from p where kind in {_IN} and src_name <> '<module>'),
w as (select distinct path || '::' || name as target, path || '::' || name as node, 0 as hops from shared_entities union select w.target, i.src, w.hops + 1 from w join i on i.dst = w.node where w.hops < 24),
r as (select target, node, min(hops) as hops from w where node <> target group by 1, 2) select target, hops, count(*) as n from r group by 1, 2""",
    "g_reach": f"""with recursive {_E}, {_P}, {_N}, c as (select path || '::' || name as key from n where kind in ('function', 'method')), i as (select distinct src, dst from p where kind = 'calls'),
w as (select key as source, key as node, 0 as hops from c union select w.source, i.dst, w.hops + 1 from w join i on i.src = w.node where w.hops < 24),
r as (select source, node, min(hops) as hops from w where node <> source group by 1, 2) select source, count(*) as n, max(hops) as far from r group by 1""",
    "g_ancestry": f"""with recursive {_E}, {_P}, {_N}, up as (select dst, min(src) as src from p where kind = 'contains' group by 1),
w as (select path || '::' || name as target, path || '::' || name as node, 0 as depth from n where kind = 'method' union select w.target, up.src, w.depth + 1 from w join up on up.dst = w.node where w.depth < 32),
r as (select target, node, min(depth) as depth from w where node <> target group by 1, 2) select target, split_part(node, '::', 1) as path, substr(node, instr(node, '::') + 2) as name, depth from r""",
    "g_container_radius": f"""with recursive {_E}, {_P}, {_N}, {_CLASSES}, up as (select dst, min(src) as src from p where kind = 'contains' group by 1),
a as (select key as target, key as node, 0 as depth from c union select a.target, up.src, a.depth + 1 from a join up on up.dst = a.node where a.depth < 32),
h as (select target, node, min(depth) as depth from a where node <> target group by 1, 2),
i as (select distinct src, dst from p where kind in {_IN} and src_name <> '<module>'),
w as (select key as target, key as node, 0 as hops from c union select w.target, i.src, w.hops + 1 from w join i on i.dst = w.node where w.hops < 40),
t as (select h.target, q.src, min(struct_pack(depth := h.depth, holder := h.node)) as b from h join (select distinct src, dst from p where kind in {_IN} or kind = 'imports') q on q.dst = h.node
  where q.src <> q.dst and q.src <> h.target and not exists (select 1 from w where w.target = h.target and w.node = q.src and w.hops > 0) group by 1, 2)
select target, split_part(src, '::', 1) as path, substr(src, instr(src, '::') + 2) as name, b.holder as holder from t""",
    "g_who_touches": f"with {_E} select kind, src_path, src_name, line from e where dst_path || '::' || dst_name = '{TARGET}'",
    "g_card": f"""with {_E}, {_N}, {_CLASSES}, k as (select *, src_path || '::' || src_name as src, dst_path || '::' || dst_name as dst from e where kind <> 'contains'),
x as (select dst as target, 'incoming' as direction, src_path as path, src_name as name, kind as edge_kind from k where dst in (select key from c)
  union all select src, 'outgoing', dst_path, dst_name, kind from k where dst is not null and src in (select key from c)
  union all select distinct src, 'external', null, ext_name, null from k where dst is null and ext_name is not null and src in (select key from c))
select target, direction, x.path, x.name, coalesce(n.kind, '') as kind, edge_kind, count(*) as n from x left join n on n.path = x.path and n.name = x.name group by 1, 2, 3, 4, 5, 6""",
    "g_fan_in": f"with {_E}, {_N} select n.path, n.name, count(e.id) as fan_in from n left join e on e.dst_path = n.path and e.dst_name = n.name and e.kind in {_IN} where n.name not in ('<module>', '<package>') group by 1, 2",
    "g_load_bearing": f"with {_E}, {_N} select n.path, n.name, count(*) as fan_in from n join e on e.dst_path = n.path and e.dst_name = n.name and e.kind in {_IN} where n.name not in ('<module>', '<package>') group by 1, 2 order by 3 desc, 1, 2 limit 5",
    "g_system_map": f"""with {_E}, {_N} select (select count(*) from n where name = '<module>') as files, (select count(*) from n where name not in ('<module>', '<package>')) as entities,
(select count(*) from e where exists (select 1 from n where n.path = e.src_path and n.name = e.src_name and n.name not in ('<module>', '<package>'))) as edges""",
    "g_direct_dependents": f"with {_E}, {_P} select split_part(dst, '::', 1) as path, substr(dst, instr(dst, '::') + 2) as name, count(distinct src) as dependents from p where kind in ('calls', 'reads', 'inherits') and src_name not in ('<module>', '<package>') and src <> dst group by 1, 2",
    "g_handlers": f"""with recursive {_E}, {_P}, {_N}, i as (select distinct src, dst from p where kind = 'calls'),
root as (select path, name, kind, path || '::' || name as key from n where kind in ('function', 'method') and not exists (select 1 from p where p.dst = n.path || '::' || n.name and p.kind in ('calls', 'reads', 'inherits') and p.src_name <> '<module>' and p.src <> p.dst)),
w as (select key as root, key as node from root union select w.root, i.dst from w join i on i.src = w.node)
select root.path, root.name, root.kind, (select count(*) from w where w.root = root.key and w.node <> root.key) as reach, (select count(*) from i where i.src = root.key) as direct from root
where exists (select 1 from w where w.root = root.key and w.node <> root.key)""",
    "g_radius_graph_nodes": f"{_RADIUS}, {_N} select n2.path, n2.name, hops, coalesce(n.kind, '') as kind from (select split_part(node, '::', 1) as path, substr(node, instr(node, '::') + 2) as name, hops from r) n2 left join n on n.path = n2.path and n.name = n2.name",
    "g_radius_graph_edges": f"{_RADIUS}, m as (select node from r union select '{TARGET}') select distinct src, dst, kind from p where kind in ('calls', 'reads', 'inherits') and src in (select node from m) and dst in (select node from m)",
    "g_file_graph_nodes": f"""with recursive {_E}, {_N}, ids as (select distinct {_DIR.format('path')} as id from n where name = '<module>'),
a as (select distinct {_DIR.format('src_path')} as src, {_DIR.format('dst_path')} as dst from e where kind <> 'contains' and dst_path is not null), b as (select * from a where src <> dst),
w as (select id, 0 as depth from ids where id not in (select dst from b) union select b.dst, w.depth + 1 from w join b on b.src = w.id where w.depth < 12)
select ids.id, coalesce(c.entities, 0) as entities, coalesce(l.depth, 0) as depth from ids left join (select {_DIR.format('path')} as id, count(*) as entities from n where name not in ('<module>', '<package>') group by 1) c using (id)
left join (select id, min(depth) as depth from w group by 1) l using (id)""",
    "g_file_graph_edges": f"with {_E}, a as (select {_DIR.format('src_path')} as src, {_DIR.format('dst_path')} as dst from e where kind <> 'contains' and dst_path is not null) select src, dst, count(*) as n from a where src <> dst group by 1, 2",
    "g_package_nodes": """with f as (select distinct string_split(path, '/') as p from files where path is not null) select distinct array_to_string(p[1:i], '/') as path, '<package>' as name, 'package' as kind from f, unnest(range(1, len(p))) t(i)""",
    "g_package_edges": """with f as (select distinct path, string_split(path, '/') as p from files where path is not null), u as (select distinct p[1:i] as d from f, unnest(range(1, len(p))) t(i))
select array_to_string(d[1:len(d) - 1], '/') as src_path, '<package>' as src_name, array_to_string(d, '/') as dst_path, '<package>' as dst_name from u where len(d) > 1
union all select array_to_string(p[1:len(p) - 1], '/'), '<package>', path, '<module>' from f where len(p) > 1""",
    "g_tree": f"with {_N} select path, count(*) as n, string_agg(name, ',' order by line nulls first, name, kind) as listing from n where name not in ('<module>', '<package>') group by 1",
    "g_find_tail": f"with {_N}, h as (select path, name, kind, case when name = '{SPOKEN}' then 1 when string_split(name, '.')[-1] = '{SPOKEN}' then 2 when contains(lower(name), lower('{SPOKEN}')) then 3 end as tier from n where name not in ('<module>', '<package>')) select * from h where tier = (select min(tier) from h)",
    "g_find_part": f"with {_N}, h as (select path, name, kind, case when name = '_Galaxy' then 1 when string_split(name, '.')[-1] = '_Galaxy' then 2 when contains(lower(name), lower('_Galaxy')) then 3 end as tier from n where name not in ('<module>', '<package>')) select * from h where tier = (select min(tier) from h)",
    "g_labels": f"with {_E} select case when dst_path is null then 'external:' || ext_name when dst_name = '<package>' then 'package ' || dst_path when dst_name = '<module>' then 'file ' || dst_path else dst_path || ' :: ' || dst_name end as label, count(*) as n from e where dst_path is not null or ext_name is not null group by 1",
    "g_adjacency": f"""with {_E}, r as (select src_path || '::' || src_name as a, dst_path || '::' || dst_name as b, case kind when 'calls' then 1.0 when 'inherits' then 1.0 when 'implements' then 0.9 when 'reads' then 0.8 when 'types' then 0.7 when 'writes' then 0.6
  when 'imports' then 0.3 when 'loads' then 0.5 when 'copies' then 0.5 when 'contains' then 0.15 else 0.4 end::double as w from e where dst_path is not null and dst_name is not null),
x as (select a as node, w from r where a <> b union all select b, w * 0.7 from r where a <> b) select node, count(*) as degree, round(sum(w), 6) as weight from x group by 1""",
    "g_edges_by_source": f"with {_E} select kind, count(*) as n, count(distinct (src_path, src_name)) as sources from e group by 1",
    "g_test_paths": """with f as (select distinct repo, path, string_split(path, '/') as p from files), t as (select *, list_has_any(p[1:len(p) - 1], ['tests', 'test', 'testing']) or p[-1] like 'test\\_%' escape '\\' or p[-1] like '%\\_test.py' escape '\\' or p[-1] = 'conftest.py' as is_test from f)
select repo, count(*) filter (is_test) as tests, count(*) as files from t group by 1""",
}
