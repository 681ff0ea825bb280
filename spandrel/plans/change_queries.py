"""Queries of extraction, resolution, changes, streams and set operations over the tables, and their SQL."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.functions import text as T
from spandrel.operators import delta as D
from spandrel.operators import graph as G
from spandrel.operators.extraction import Extracted, extract
from spandrel.operators.resolve import resolve
from spandrel.session import shared_dir
from spandrel.sources.tree import candidates
from spandrel.streaming import refresh as S
from spandrel.tables import in_force, table


def x_entities(spark: SparkSession, d: str) -> DataFrame:
    """recipe, kind, n: entities that extraction finds in all files."""
    return extract(table(spark, d, "files")).entities.groupBy("recipe", "kind").agg(F.count("*").alias("n"))


def x_terraform(spark: SparkSession, d: str) -> DataFrame:
    """path, name, kind of all Terraform blocks."""
    e = extract(table(spark, d, "files").filter(F.col("path").endswith(".tf"))).entities
    return e.filter(F.col("kind").isin("variable", "resource", "output")).select("path", "name", "kind")


def x_edges(spark: SparkSession, d: str) -> DataFrame:
    """kind, inside, n: edges of all files, resolved inside the workspace or external."""
    e = resolve(extract(table(spark, d, "files")))
    return e.groupBy("kind", F.col("dst_path").isNotNull().alias("inside")).agg(F.count("*").alias("n"))


def _known(spark: SparkSession, d: str) -> Extracted:
    """The delivered graph's Python part as extraction would give it: what files import, and names as written."""
    nodes = G.nodes_of(table(spark, d, "entities")).filter(F.col("path").endswith(".py"))
    links = in_force(table(spark, d, "edges")).filter(F.col("src_path").endswith(".py")).select("id", "src_path", "src_name", "kind", "target", "dst_path", "dst_name", "line").distinct()
    paths = nodes.select("path").distinct()
    files = paths.select("path", F.lit("python").alias("language"), F.lit("7").alias("version"), F.lit("ok").alias("status"), F.lit("").alias("error"), F.lit(".py").alias("suffix"), F.lit("__init__").alias("index"), F.lit("self").alias("own"))
    whole = F.col("dst_name") == G.MODULE
    plain = links.filter("kind = 'imports' and dst_name is not null").filter(F.col("dst_path").rlike(r"^[^.]+\.py$"))
    bindings = plain.select(
        "src_path", F.when(whole, F.regexp_extract("dst_path", r"([^/]+)\.py$", 1)).otherwise(T.tail(F.col("dst_name"))).alias("local"), F.replace(F.regexp_replace("dst_path", r"\.py$", ""), F.lit("/"), F.lit(".")).alias("module"),
        F.when(~whole, F.col("dst_name")).alias("member"), F.lit("module").alias("style"), F.lit(False).alias("star"), F.col("id").alias("ord"), "line", F.coalesce("target", F.lit("")).alias("target"),
    )
    only = F.when(F.col("kind").isin("types", "inherits"), F.array(F.lit("class"))).otherwise(F.array().cast("array<string>"))
    references = links.filter(F.col("kind").isin(*G.IMPACT) & F.col("target").isNotNull()).select("src_path", "src_name", "kind", "target", "line", F.lit("lexical").alias("resolve"), only.alias("only"), F.when(F.col("kind") == "calls", "external").otherwise("drop").alias("unresolved"))
    none = links.filter("false").select("src_path", "src_name", "dst_path", "dst_name")
    return Extracted(files, nodes.select("path", "name", "kind"), bindings, references, none, paths)


def x_resolved(spark: SparkSession, d: str) -> DataFrame:
    """src_path, src_name, kind, target, dst_path, dst_name, external, n: names as written in Python files, resolved anew by
    what their files import and define, through modules that pass names on."""
    e = resolve(_known(spark, d)).filter("kind <> 'imports'").drop("line")
    return e.groupBy(*e.columns).agg(F.count("*").alias("n"))


def x_imports(spark: SparkSession, d: str) -> DataFrame:
    """src_path, dst_path, dst_name, external: what Python files import, at its definition."""
    return resolve(_known(spark, d)).filter("kind = 'imports'").select("src_path", "dst_path", "dst_name", F.col("dst_path").isNull().alias("external")).distinct()


def x_html_references(spark: SparkSession, d: str) -> DataFrame:
    """src_path, target: what HTML pages refer to, as written."""
    r = extract(table(spark, d, "files").filter(F.col("path").endswith(".html"))).references
    return r.select("src_path", F.sha2("target", 256).alias("target_hash")).distinct()


def x_copies(spark: SparkSession, d: str) -> DataFrame:
    """src_path, target, line: what build files copy, as written."""
    f = table(spark, d, "files").filter(F.element_at(F.split("path", "/"), -1).rlike("^Dockerfile|\\.dockerfile$"))
    return extract(f).references.select("src_path", "target").distinct()


def x_agreement(spark: SparkSession, d: str) -> DataFrame:
    """kind, known, found: living entities of the table, and how many of them extraction finds again."""
    found = extract(table(spark, d, "files")).entities.select("path", "name").distinct().withColumn("there", F.lit(True))
    known = G.nodes_of(table(spark, d, "entities"))
    return known.join(found, ["path", "name"], "left").groupBy("kind").agg(F.count("*").alias("known"), F.count("there").alias("found"))


def d_patch_lines(spark: SparkSession, d: str) -> DataFrame:
    """id, path, status, old_lines, new_lines of all instances' patches."""
    i = table(spark, d, "instances").select(F.col("instance_id").alias("id"), F.col("patch").alias("diff"))
    return D.changed_lines(i).groupBy("id", "path", "status").agg(F.count_if(F.col("side") == "old").alias("old_lines"), F.count_if(F.col("side") == "new").alias("new_lines"))


def d_patch_runs(spark: SparkSession, d: str) -> DataFrame:
    """id, path, first, last: runs of added lines."""
    i = table(spark, d, "instances").select(F.col("instance_id").alias("id"), F.col("patch").alias("diff"))
    return D.fold_runs(D.changed_lines(i).filter("side = 'new'"), "id", "path")


def d_runs(spark: SparkSession, d: str) -> DataFrame:
    """path, first, last: runs of consecutive lines that hold entities."""
    return D.fold_runs(table(spark, d, "entities").filter("removed_at is null"), "path")


def d_overlap(spark: SparkSession, d: str) -> DataFrame:
    """l_orderkey, first, last, start, stop: runs of odd quantities against windows of line numbers of the same order."""
    li = table(spark, d, "lineitem")
    runs = D.fold_runs(li.select("l_orderkey", (F.col("l_linenumber") * 30).cast("int").alias("line")), "l_orderkey").withColumn("last", F.col("last") + 10)
    spans = li.select("l_orderkey", (F.col("l_linenumber") * 20).cast("int").alias("start"), (F.col("l_linenumber") * 20 + 15).cast("int").alias("stop")).distinct()
    return D.overlapping(runs, spans, "l_orderkey").select("l_orderkey", "first", "last", "start", "stop")


def d_innermost(spark: SparkSession, d: str) -> DataFrame:
    """path, line, owner: the innermost span of entities around the line of each entity (spans reach to 40 lines on)."""
    e = G.nodes_of(table(spark, d, "entities")).filter(~F.col("name").isin(*G.SCOPES) & F.col("line").isNotNull())
    spans = e.select("path", F.col("line").alias("start"), (F.col("line") + F.length("name")).alias("stop"), "name")
    return D.innermost(e.select("path", "line").distinct(), spans, "path")


def d_change_classes(spark: SparkSession, d: str) -> DataFrame:
    """change, n between the first and the last delivered names of entities' owners (kinds by address)."""
    e = table(spark, d, "entities").withColumn("key", F.concat_ws("::", "path", "name"))
    old = e.groupBy("key").agg(F.min("seen_at").alias("v")).filter(F.month("v") <= 9)
    new = e.groupBy("key").agg(F.max("seen_at").alias("v")).filter(F.month("v") >= 3)
    return D.class_of_change(old, new, "key", "v").groupBy("change").agg(F.count("*").alias("n"))


def d_cross_language(spark: SparkSession, d: str) -> DataFrame:
    """path, others: files that files of another recipe refer to."""
    f = table(spark, d, "files").filter("recipe is not null").select("path", F.col("recipe").alias("language")).distinct()
    links = G.links_of(table(spark, d, "edges"))
    return D.cross_language(links, f, f.select("path")).select("path", F.array_join("others", ",").alias("others"))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """path, name, kind, change: addresses that are gone, that came back, and that were first seen in the last quarter."""
    e = table(spark, d, "entities").filter("path is not null and name is not null").filter(~F.col("name").isin(*G.SCOPES))
    per = e.groupBy("path", "name").agg(F.min("kind").alias("kind"), F.count_if(F.col("removed_at").isNull()).alias("living"), F.count_if(F.col("removed_at").isNotNull()).alias("gone"), F.min("seen_at").alias("first"))
    change = F.when(F.col("living") == 0, "deleted").when(F.col("gone") > 0, "modified").when(F.month("first") >= 10, "added")
    return per.withColumn("change", change).filter("change is not null").select("path", "name", "kind", "change")


def d_delta(spark: SparkSession, d: str) -> DataFrame:
    """path, name, kind, change, radius, dependents, load_bearing of what has changed."""
    return D.delta(_changes(spark, d), G.links_of(table(spark, d, "edges")))[0]


def d_at_risk(spark: SparkSession, d: str) -> DataFrame:
    """path, name, hops: what the changes put at risk, with the fewest hops."""
    return D.delta(_changes(spark, d), G.links_of(table(spark, d, "edges")))[1]


def d_truth(spark: SparkSession, d: str) -> DataFrame:
    """id, path, name, is_added: what the instances' patches change, where their files are at hand (added ones always)."""
    i = table(spark, d, "instances").select(F.col("instance_id").alias("id"), F.col("patch").alias("diff"))
    f = table(spark, d, "files").filter("content is not null").groupBy("path", "repo").agg(F.min("hash").alias("hash"))
    known = table(spark, d, "files").select("path", "hash", "content").distinct().join(f, ["path", "hash"])
    own = D.changed_lines(i).select("id", "path").distinct().join(table(spark, d, "instances").select(F.col("instance_id").alias("id"), "repo").distinct(), "id")
    base = own.join(known.select(F.expr("substring(path, length(repo) + 2)").alias("path"), "repo", "content"), ["repo", "path"]).select("id", "path", "content")
    return D.truth(i, base)


def d_still_naming(spark: SparkSession, d: str) -> DataFrame:
    """path, name, n: who names, by the text of external targets, what once was an external target's own address.

    What edges name outside of the workspace stands for entities of a package that is gone (its parts before the last
    dot are the path).
    """
    links = G.links_of(table(spark, d, "edges"))
    cut = F.regexp_replace("ext_name", "[.]?[^.]*$", "")
    gone = links.filter("ext_name is not null").select(F.when(cut != "", cut).otherwise("builtins").alias("path"), T.tail(F.col("ext_name")).alias("name")).distinct()
    return D.still_naming(links, gone).groupBy("path", "name").agg(F.count("*").alias("n"))


def i_refresh(spark: SparkSession, d: str) -> DataFrame:
    """change, n: the last delivery of each file against the first one of the path below another repository's name.

    A file that is alone under its name is new or deleted; of those that are not, content and times differ.
    """
    cols = ("hash", "size", "mtime_ns", "recipe_version")
    f = table(spark, d, "files").filter("path is not null").groupBy("path").agg(F.min(F.struct("loaded_at", *cols)).alias("first"), F.max(F.struct("loaded_at", *cols)).alias("last"))
    beside = f.withColumn("base", F.regexp_replace("path", "^[^/]*/[^/]*/", "")).groupBy("base").agg(F.min(F.struct("path", "first")).alias("k"), F.max(F.struct("path", "last")).alias("l"), F.count("*").alias("n"))
    known = beside.select(F.col("base").alias("path"), *(F.col(f"k.first.{c}").alias(c) for c in cols)).unionByName(f.select("path", *(F.col(f"first.{c}").alias(c) for c in cols)))
    listed = beside.filter("n > 1").select(F.col("base").alias("path"), *(F.col(f"l.last.{c}").alias(c) for c in cols)).unionByName(f.select("path", *(F.col(f"last.{c}").alias(c) for c in cols)))
    return S.changes(listed, known).groupBy("change").agg(F.count("*").alias("n"))


def i_latest(spark: SparkSession, d: str) -> DataFrame:
    """path, hash, loaded_at: the last delivery of each file."""
    f = table(spark, d, "files").select("path", "hash", "loaded_at")
    return S.latest(f)


def i_event_windows(spark: SparkSession, d: str) -> DataFrame:
    got = S.event_counts(table(spark, d, "events"), "1 day")
    return got.select("start", "event_type", "n", F.round("total", 4).alias("total"))


def i_sessions(spark: SparkSession, d: str) -> DataFrame:
    return S.sessions(table(spark, d, "events"), "6 hours")


def i_stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """event_type, n: events counted by a file stream that runs until nothing is left."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    at = f"{shared_dir(spark)}/stream-{next(tempfile._get_candidate_names())}"
    return S.stream_once(events.groupBy("event_type").agg(F.count("*").alias("n")), "i_stream_counts", at, "complete")


def u_union(spark: SparkSession, d: str) -> DataFrame:
    e = G.links_of(table(spark, d, "edges"))
    return e.select(F.col("src_path").alias("path")).union(e.filter("dst_path is not null").select("dst_path")).distinct()


def u_intersect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("path").intersect(table(spark, d, "documents").select("path"))


def u_difference(spark: SparkSession, d: str) -> DataFrame:
    """Files that are no documents: known less there."""
    f = table(spark, d, "files").select("path").distinct()
    return f.join(table(spark, d, "documents").select("path"), "path", "left_anti")


def u_subset(spark: SparkSession, d: str) -> DataFrame:
    """repo, subset, equal: whether a repository's document paths are among, or just, its files."""
    f = table(spark, d, "files").select("repo", "path", F.lit(1).alias("a"), F.lit(0).alias("b"))
    x = table(spark, d, "documents").filter("path is not null and source = 'source_file'").select("repo", "path", F.lit(0).alias("a"), F.lit(1).alias("b"))
    held = f.unionByName(x).groupBy("repo", "path").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    sums = held.groupBy("repo").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.col("a") * F.col("b")).alias("both")).filter("a > 0 and b > 0")
    return sums.select("repo", (F.col("both") == F.col("b")).alias("subset"), ((F.col("both") == F.col("b")) & (F.col("both") == F.col("a"))).alias("equal"))


def u_hashes(spark: SparkSession, d: str) -> DataFrame:
    """path, right: whether the stored hash is that of the content."""
    return table(spark, d, "files").filter("content is not null").select("path", (F.sha2("content", 256) == F.col("hash")).alias("right")).distinct()


def u_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Python files that are no tests and lie in no skipped directory."""
    return candidates(table(spark, d, "files"))


QUERIES = {k: v for k, v in list(globals().items()) if k[:2] in ("x_", "d_", "i_", "u_")}

_E = "e as (select distinct id, src_path, src_name, kind, dst_path, dst_name, ext_name, line from edges where coalesce(status, '') <> 'dropped')"
_SKIP = ", ".join(f"'{x}'" for x in T.SKIP_DIRS)
_KNOWN = """n as (select path, name, min(kind) as kind from entities where removed_at is null and path like '%.py' and name is not null group by 1, 2),
l as (select distinct id, src_path, src_name, kind, target, dst_path, dst_name, line from edges where coalesce(status, '') <> 'dropped' and src_path like '%.py' and src_path in (select path from n)),
b as (select src_path, case when dst_name = '<module>' then regexp_extract(dst_path, '([^/]+)[.]py$', 1) else string_split(dst_name, '.')[-1] end as local, dst_path as to_path, dst_name as to_name, id, coalesce(target, '') as target from l where kind = 'imports' and dst_name is not null and regexp_matches(dst_path, '^[^.]+[.]py$')),
bound as (select src_path, local, max_by(to_path, id) as to_path, max_by(to_name, id) as to_name from b group by 1, 2),
r as (select row_number() over () as row, src_path, src_name, kind, target, line from l where kind in ('calls', 'reads', 'writes', 'inherits', 'implements', 'types') and target is not null),
own as (select r.row, src_path as path, regexp_replace(src_name, '[.][^.]*$', '') || substr(target, 5) as name from r where starts_with(target, 'self.') and contains(src_name, '.')),
hit as (select r.row, bound.to_path, case when to_name = '<module>' then case when contains(target, '.') then substr(target, instr(target, '.') + 1) else '<module>' end else to_name || case when contains(target, '.') then substr(target, instr(target, '.')) else '' end end as name
  from r join bound on bound.src_path = r.src_path and bound.local = string_split(target, '.')[1] where not (starts_with(target, 'self.') and contains(src_name, '.'))),
bare as (select r.row, src_path as to_path, target as name from r where not (starts_with(target, 'self.') and contains(src_name, '.')) and row not in (select row from hit)),
req as (select to_path, name from hit union select to_path, name from bare union select to_path, to_name from b),
m as (select to_path, name, to_path as p, name as x from req union select m.to_path, m.name, bound.to_path, bound.to_name from m join bound on bound.src_path = m.p and bound.local = m.x where not exists (select 1 from n where n.path = m.p and n.name = m.x) and m.p in (select path from n)),
means as (select m.to_path, m.name, n.path as dst_path, n.name as dst_name, n.kind as dst_kind from m join n on n.path = m.p and n.name = m.x)"""
_CHANGES = """c as (select path, name, kind, change from (select path, name, min(kind) as kind, case when count(*) filter (removed_at is null) = 0 then 'deleted' when count(*) filter (removed_at is not null) > 0 then 'modified' when month(min(seen_at)) >= 10 then 'added' end as change
  from entities where path is not null and name is not null and name not in ('<module>', '<package>') group by 1, 2) where change is not null)"""
_DELTA = f"""with recursive {_E}, {_CHANGES}, p as (select distinct kind, src_path || '::' || src_name as src, dst_path || '::' || dst_name as dst, src_name from e where dst_path is not null and dst_name is not null),
i as (select distinct src, dst from p where kind in ('calls', 'reads', 'writes', 'inherits', 'implements', 'types') and src_name <> '<module>'),
w as (select path || '::' || name as target, path || '::' || name as node, 0 as hops from c where change = 'modified' union select w.target, i.src, w.hops + 1 from w join i on i.dst = w.node where w.hops < 40),
t as (select distinct src_path, src_name, ext_name from e where kind in ('calls', 'reads', 'inherits') and ext_name is not null and src_name <> '<module>'),
named as (select distinct c.path || '::' || c.name as target, t.src_path || '::' || t.src_name as node, 1 as hops from c join t on string_split(t.ext_name, '.')[-1] = string_split(c.name, '.')[-1] where change = 'deleted'),
r as (select target, node, min(hops) as hops from w where node <> target group by 1, 2 union all select * from named),
near as (select dst as target, src as node from p where kind in ('calls', 'reads', 'inherits') and src_name not in ('<module>', '<package>') and src <> dst union select target, node from named)"""
ORACLE = {
    "x_resolved": f"""with recursive {_KNOWN}, a as (select own.row, n.path as dst_path, n.name as dst_name, n.kind as dst_kind from own join n using (path, name)
  union all select h.row, dst_path, dst_name, dst_kind from (select * from hit union all select * from bare) h join means on means.to_path = h.to_path and means.name = h.name),
o as (select r.*, case when a.row is not null and (kind not in ('types', 'inherits') or dst_kind = 'class') then dst_path end as dst_path, case when a.row is not null and (kind not in ('types', 'inherits') or dst_kind = 'class') then dst_name end as dst_name from r left join a on a.row = r.row)
select src_path, src_name, kind, target, dst_path, dst_name, case when dst_path is null then target end as external, count(*) as n from o where dst_path is not null or kind = 'calls' group by all""",
    "x_imports": f"with recursive {_KNOWN} select distinct b.src_path, dst_path, dst_name, dst_path is null as external from b left join means on means.to_path = b.to_path and means.name = b.to_name",
    "d_delta": f"""{_DELTA}, s as (select target, count(*) as radius from r group by 1), k as (select target, count(distinct node) as dependents from near group by 1)
select path, name, kind, change, coalesce(radius, 0) as radius, case when change = 'added' then 0 else coalesce(dependents, 0) end as dependents, case when change = 'added' then false else coalesce(dependents, 0) >= 3 end as load_bearing
from c left join s on s.target = path || '::' || name left join k on k.target = path || '::' || name""",
    "d_at_risk": f"""{_DELTA} select split_part(node, '::', 1) as path, substr(node, instr(node, '::') + 2) as name, min(hops) as hops from r where node not in (select path || '::' || name from c) group by 1, 2""",
    "x_terraform": r"""with t as (select path, min(content) as content from files where path like '%.tf' and content is not null group by 1),
m as (select path, unnest(regexp_extract_all(content, '(?m)^[ \t]*(?:variable|output)\s+"[^"]+"|^[ \t]*resource\s+"[^"]+"\s+"[^"]+"')) as m from t)
select distinct path, case when m like '%resource%' and regexp_matches(m, '^\s*resource') then regexp_extract(m, 'resource\s+"([^"]+)"', 1) || '.' || regexp_extract(m, '"([^"]+)"\s*$', 1) else regexp_extract(m, '"([^"]+)"', 1) end as name, regexp_extract(m, '(variable|output|resource)', 1) as kind from m""",
    "x_html_references": """select distinct path as src_path, sha256(trim(unnest(regexp_extract_all(content, '(?i)\\b(?:src|href)\\s*=\\s*"([^"]*)"', 1)))) as target_hash from files where path like '%.html' and content is not null""",
    "x_copies": """with l as (select path, unnest(string_split_regex(content, '\\r\\n|\\n|\\r')) as l from files where content is not null and (string_split(path, '/')[-1] like 'Dockerfile%' or path like '%.dockerfile'))
select distinct path as src_path, unnest(string_split_regex(trim(l), '\\s+')[2:-2]) as target from l where regexp_matches(l, '(?i)^\\s*COPY\\s')""",
    "d_patch_lines": r"""with l as (select instance_id as id, unnest(string_split(patch, chr(10))) as l, regexp_extract(patch, '(?m)^\+\+\+ b/(.*)$', 1) as path from (select distinct instance_id, patch from instances where patch is not null))
select id, path, 'modified' as status, count(*) filter (l like '-%' and l not like '--- %') as old_lines, count(*) filter (l like '+%' and l not like '+++ %') as new_lines from l group by 1, 2""",
    "d_patch_runs": r"""with p as (select distinct instance_id as id, regexp_extract(patch, '(?m)^\+\+\+ b/(.*)$', 1) as path, regexp_extract(patch, '(?m)^@@ -\d+(?:,\d+)? \+(\d+)', 1)::int as start, string_split(regexp_extract(patch, '(?s)\n@@[^\n]*\n(.*)$', 1), chr(10)) as body from instances where patch is not null),
b as (select id, path, start, unnest(body) as l, generate_subscripts(body, 1) as i from p), n as (select *, start - 1 + sum(case when l like '-%' then 0 else 1 end) over (partition by id order by i) as line from b),
a as (select id, path, line from n where l like '+%'), k as (select *, line - row_number() over (partition by id, path order by line) as g from a) select id, path, min(line)::int as first, max(line)::int as last from k group by id, path, g""",
    "d_runs": "with l as (select distinct path, line from entities where removed_at is null and line is not null), i as (select *, line - row_number() over (partition by path order by line) as k from l) select path, min(line) as first, max(line) as last from i group by path, k",
    "d_overlap": """with l as (select distinct l_orderkey, l_linenumber * 30 as line from lineitem), i as (select *, line - row_number() over (partition by l_orderkey order by line) as k from l),
r as (select l_orderkey, min(line) as first, max(line) + 10 as last from i group by l_orderkey, k), s as (select distinct l_orderkey, l_linenumber * 20 as start, l_linenumber * 20 + 15 as stop from lineitem)
select r.l_orderkey, first, last, start, stop from r join s on s.l_orderkey = r.l_orderkey and start <= last and first <= stop""",
    "d_innermost": """with n as (select path, name, min(line) as line from entities where removed_at is null and path is not null and name not in ('<module>', '<package>') group by 1, 2), p as (select distinct path, line from n where line is not null)
select p.path, p.line, (select min(struct_pack(size := len(n.name), name := n.name)).name from n where n.path = p.path and n.line <= p.line and p.line <= n.line + len(n.name)) as owner from p""",
    "d_change_classes": """with e as (select path || '::' || name as key, min(seen_at) as a, max(seen_at) as b from entities group by 1), o as (select key, a as v from e where month(a) <= 9), n as (select key, b as v from e where month(b) >= 3)
select case when o.key is null then 'added' when n.key is null then 'deleted' when o.v <> n.v then 'modified' else 'same' end as change, count(*) as n from o full outer join n using (key) group by 1""",
    "d_cross_language": f"""with {_E}, f as (select distinct path, recipe as language from files where recipe is not null), i as (select distinct src_path, dst_path from e where kind <> 'contains' and dst_path is not null)
select i.dst_path as path, string_agg(distinct a.language, ',' order by a.language) as others from i join f a on a.path = i.src_path join f b on b.path = i.dst_path where a.language <> b.language group by 1""",
    "d_still_naming": f"""with {_E}, x as (select src_path, src_name, kind, ext_name, string_split(ext_name, '.')[-1] as tail from e where ext_name is not null),
g as (select distinct coalesce(nullif(regexp_replace(ext_name, '[.]?[^.]*$', ''), ''), 'builtins') as path, tail as name from x), t as (select distinct src_path, src_name, tail from x where kind in ('calls', 'reads', 'inherits') and src_name <> '<module>')
select path, name, count(distinct (src_path, src_name)) as n from g join t on t.tail = g.name group by 1, 2""",
    "i_refresh": """with o as (select *, row_number() over (partition by path order by loaded_at, hash nulls first, size nulls first, mtime_ns nulls first, recipe_version nulls first) as i, count(*) over (partition by path) as c, regexp_replace(path, '^[^/]*/[^/]*/', '') as base from files where path is not null),
a as (select * from o where i = 1), z as (select * from o where i = c),
k as (select path, hash, size, mtime_ns, recipe_version from a union all select base, hash, size, mtime_ns, recipe_version from (select *, row_number() over (partition by base order by path) as j from a) where j = 1),
l as (select path, hash, size, mtime_ns, recipe_version from z union all select base, hash, size, mtime_ns, recipe_version from (select *, row_number() over (partition by base order by path desc) as j, count(*) over (partition by base) as m from z) where j = 1 and m > 1)
select case when k.size is null and k.hash is null then 'new' when l.size is null and l.hash is null then 'deleted' when l.recipe_version is distinct from k.recipe_version then 'stale' when l.size is not distinct from k.size and l.mtime_ns is not distinct from k.mtime_ns then 'same'
  when l.hash is not distinct from k.hash then 'restamped' else 'changed' end as change, count(*) as n from l full outer join k using (path) group by 1""",
    "i_latest": "select path, max(struct_pack(l := loaded_at, h := hash)).h as hash, max(loaded_at) as loaded_at from files where path is not null group by 1",
    "i_event_windows": "select date_trunc('day', ts)::timestamp as start, event_type, count(*) as n, round(sum(value), 4) as total from events where ts is not null group by 1, 2",
    "i_sessions": """with t as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as before from events where ts is not null), s as (select *, sum(case when before is null or ts >= before + interval 6 hours then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as k from t)
select user_id, min(ts) as start, count(*) as n from s group by user_id, k""",
    "i_stream_counts": "select event_type, count(*) as n from events group by 1",
    "u_union": f"with {_E} select src_path as path from e union select dst_path from e where dst_path is not null",
    "u_intersect": "select path from files intersect select path from documents",
    "u_difference": "select distinct path from files where path not in (select path from documents where path is not null)",
    "u_subset": """with f as (select repo, list_sort(list(distinct path)) as a from files group by 1), x as (select repo, list_sort(list(distinct path)) as b from documents where path is not null and source = 'source_file' group by 1)
select f.repo, list_has_all(a, b) as subset, a = b as equal from f join x on x.repo = f.repo""",
    "u_hashes": 'select distinct path, sha256(content) = hash as "right" from files where content is not null',
    "u_candidates": f"""with f as (select distinct path, string_split(path, '/') as p from files where path like '%.py') select path from f where not list_has_any(p[1:len(p) - 1], ['tests', 'test', 'testing']) and not starts_with(p[-1], 'test_') and not ends_with(path, '_test.py') and p[-1] <> 'conftest.py'
and not list_has_any(p[1:len(p) - 1], [{_SKIP}])""",
}
