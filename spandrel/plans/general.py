"""Queries of the general data problems (p1, p2, p5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.operators.dangling import dangling_by_period, dangling_ends
from spandrel.operators.heavy_keys import heavy_keys, key_counts
from spandrel.operators.hierarchy import hierarchy
from spandrel.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(table(spark, d, "edges")).select("kind", "dst_key")


def p1_key_counts(spark: SparkSession, d: str) -> DataFrame:
    return key_counts(table(spark, d, "edges")).filter("dst_key is not null")


def _dangling(spark: SparkSession, d: str) -> DataFrame:
    return dangling_ends(*(table(spark, d, t) for t in ("edges", "entities", "shared_entities")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _dangling(spark, d).select("id", "side")


def p2_by_period(spark: SparkSession, d: str) -> DataFrame:
    return dangling_by_period(_dangling(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(table(spark, d, "edges")).labels().select("path", "name", "root_path", "root_name", "depth")


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(table(spark, d, "edges")).paths()


def p5_descendant_counts(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(table(spark, d, "edges")).descendant_counts()


def p5_descendants_of_roots(spark: SparkSession, d: str) -> DataFrame:
    tree = hierarchy(table(spark, d, "edges"))
    return tree.descendants_of(tree.labels().filter("depth = 0"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    """anc_path, anc_name, path, name: all descendants of every node that is not on or below a loop."""
    return hierarchy(table(spark, d, "edges")).descendants_of()


QUERIES = {f.__name__: f for f in (p1_found, p1_key_counts, p2_found, p2_by_period, p5_found, p5_paths, p5_descendant_counts, p5_descendants_of_roots, p5_descendants)}

_EDGES = "e as (select distinct on (id) * from edges where coalesce(status, '') <> 'dropped' order by id, loaded_at desc)"
_KEYS = f"with {_EDGES}, k as (select kind, coalesce(dst_path || '::' || dst_name, 'external:' || ext_name) as dst_key from e)"
_DANGLING = """with p as (select path, name, seen_at, removed_at from entities union all select path, name, seen_at, null from shared_entities),
x as (select distinct id, side, path, name, seen_at from (
  select id, 'src' as side, src_path as path, src_name as name, seen_at from edges where coalesce(status, '') <> 'dropped'
  union all select id, 'dst', dst_path, dst_name, seen_at from edges where coalesce(status, '') <> 'dropped')
  where path is not null and name is not null),
f as (select * from x where not exists (select 1 from p where p.path = x.path and p.name = x.name and p.seen_at <= x.seen_at and (p.removed_at is null or p.removed_at > x.seen_at)))"""
_TREE = """with recursive l as (select dst_path as path, dst_name as name, min(struct_pack(p := src_path, n := src_name)) as up from edges
  where kind = 'contains' and coalesce(status, '') <> 'dropped' and dst_path is not null and dst_name is not null and src_path is not null and src_name is not null group by 1, 2),
n as (select path, name from l union select src_path, src_name from edges where kind = 'contains' and coalesce(status, '') <> 'dropped' and src_path is not null and src_name is not null),
t as (select n.path, n.name, n.path as root_path, n.name as root_name, 0::bigint as depth, n.path || '::' || n.name as full_path from n anti join l using (path, name)
  union all select l.path, l.name, t.root_path, t.root_name, t.depth + 1, t.full_path || '/' || l.path || '::' || l.name from t join l on l.up.p = t.path and l.up.n = t.name)"""

ORACLE = {
    "p1_found": f"{_KEYS} select kind, dst_key from k where dst_key is not null group by 1, 2 having count(*) >= 0.01 * (select count(*) from k)",
    "p1_key_counts": f"{_KEYS} select kind, dst_key, count(*) as n from k where dst_key is not null group by 1, 2",
    "p2_found": f"{_DANGLING} select distinct id, side from f",
    "p2_by_period": f"""{_DANGLING} select 'edges.' || side as ref_table, strftime(seen_at, '%Y-%m') as period, reason, count(*) as n from (
  select side, seen_at, case when not exists (select 1 from p where p.path = f.path and p.name = f.name) then 'missing'
    when not exists (select 1 from p where p.path = f.path and p.name = f.name and p.seen_at <= f.seen_at) then 'late' else 'deleted' end as reason from f) group by 1, 2, 3""",
    "p5_found": f"{_TREE} select n.path, n.name, coalesce(root_path, '') as root_path, coalesce(root_name, '') as root_name, coalesce(depth, -1) as depth from n left join t using (path, name)",
    "p5_paths": f"{_TREE} select n.path, n.name, coalesce(depth, -1) as depth, coalesce(full_path, '') as full_path from n left join t using (path, name)",
    "p5_descendant_counts": f"""{_TREE}, a as (select path, name, path as ap, name as an from t union all select a.path, a.name, l.up.p, l.up.n from a join l on l.path = a.ap and l.name = a.an)
  select n.path, n.name, c.descendants from n left join (select ap as path, an as name, count(*) - 1 as descendants from a group by 1, 2) c using (path, name)""",
    "p5_descendants": f"""{_TREE}, a as (select path, name, path as ap, name as an from t union all select a.path, a.name, l.up.p, l.up.n from a join l on l.path = a.ap and l.name = a.an)
  select ap as anc_path, an as anc_name, path, name from a where not (ap = path and an = name)""",
    "p5_descendants_of_roots": f"{_TREE} select root_path as anc_path, root_name as anc_name, path, name from t where depth > 0",
}
