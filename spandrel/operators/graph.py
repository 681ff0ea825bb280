"""Structural questions over a code graph: what depends on what, where things sit, where work begins.

A graph is two DataFrames: ``nodes`` (one row an address) and ``links`` (one row an edge in force). All verbs are
plans over whole graphs and take sets of targets; a walk is a loop over frontiers in the driver, of which every
round joins only the frontier with the links and is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.session import Scratch
from spandrel.tables import in_force, node_key

MODULE, PACKAGE = "<module>", "<package>"
SCOPES = (MODULE, PACKAGE)
# Which kinds of edge carry a dependency, for the three questions that differ in it.
IMPACT = ("calls", "reads", "writes", "inherits", "implements", "types")
CONTAINER = (*IMPACT, "imports")
LOAD_BEARING = ("calls", "reads", "inherits")
# How much of a score an edge passes on, by kind; other kinds pass 0.4, and back 0.7 of it.
KIND_WEIGHTS = {"calls": 1.0, "inherits": 1.0, "implements": 0.9, "reads": 0.8, "types": 0.7, "writes": 0.6, "imports": 0.3, "loads": 0.5, "copies": 0.5, "contains": 0.15}
OTHER_KIND, BACKWARDS = 0.4, 0.7
DEEPEST = 32  # containment is shallow; a guard against loops


def nodes_of(entities: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """path, name, kind, line, meta, doc_kind of living addresses; rows that repeat one are one (smallest values)."""
    live = entities.filter("removed_at is null and path is not null and name is not null")
    own = live.groupBy("path", "name").agg(F.min("kind").alias("kind"), F.min("line").alias("line"), F.min("meta").alias("meta"), F.min(F.lower("doc_kind")).alias("doc_kind"))
    if shared is None:
        return own
    more = shared.groupBy("path", "name").agg(F.min("kind").alias("kind")).select("path", "name", "kind", F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("meta"), F.lit(None).cast("string").alias("doc_kind"))
    return own.unionByName(more.join(own.select("path", "name"), ["path", "name"], "left_anti"))


def links_of(edges: DataFrame) -> DataFrame:
    """Edges in force, rows that repeat an id once."""
    return in_force(edges).select("id", "src_path", "src_name", "kind", "dst_path", "dst_name", "ext_name", "line").distinct()


def pairs(links: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Distinct src, dst keys (path::name) of resolved links of some kinds, with src_name."""
    some = links.filter(F.col("kind").isin(*kinds) & F.col("dst_path").isNotNull() & F.col("dst_name").isNotNull())
    return some.select(node_key(F.col("src_path"), F.col("src_name")).alias("src"), node_key(F.col("dst_path"), F.col("dst_name")).alias("dst"), "src_name").distinct()


def split_key(key: Column, prefix: str = "") -> list[Column]:
    cut = F.split(key, "::", 2)
    return [cut[0].alias(f"{prefix}path"), cut[1].alias(f"{prefix}name")]


def label(path: Column, name: Column, external: Column | None = None) -> Column:
    """How an address is spoken of: ``package p``, ``file p``, ``p :: n``, ``external:x``."""
    own = F.when(name == PACKAGE, F.concat(F.lit("package "), path)).when(name == MODULE, F.concat(F.lit("file "), path)).otherwise(F.concat(path, F.lit(" :: "), name))
    return own if external is None else F.when(path.isNull(), F.concat(F.lit("external:"), external)).otherwise(own)


def find(nodes: DataFrame, name: str) -> DataFrame:
    """Addresses that a spoken name means: ``path::name`` if it exists, else an equal name, else an equal last part,
    else names that contain it in any case; only the first of these that finds any."""
    if "::" in name:
        path, _, qual = name.partition("::")
        return nodes.filter((F.col("path") == path.strip()) & (F.col("name") == qual.strip())).withColumn("tier", F.lit(0))
    tail = F.element_at(F.split("name", "\\."), -1)
    tier = F.when(F.col("name") == name, 1).when(tail == name, 2).when(F.contains(F.lower("name"), F.lit(name.lower())), 3)
    hits = nodes.filter(~F.col("name").isin(*SCOPES)).withColumn("tier", tier).filter("tier is not null")
    best = hits.agg(F.min("tier").alias("best"))
    return hits.join(F.broadcast(best), F.col("tier") == F.col("best")).drop("best")


def walk(steps: DataFrame, start: DataFrame, scratch: Scratch, most: int | None = None) -> DataFrame:
    """origin, node, hops: all nodes that the distinct ``steps`` (at, to) lead to from ``start`` (origin, node), with
    the fewest hops; an origin itself is left out. Loops end as a node is visited once an origin."""
    front = scratch.keep(start.select("origin", "node").distinct())
    seen, hops = [front.withColumn("hops", F.lit(0))], 0
    while most is None or hops < most:
        hops += 1
        been = seen[0]
        for s in seen[1:]:
            been = been.unionByName(s)
        nxt = front.join(steps, front["node"] == steps["at"]).select("origin", F.col("to").alias("node")).distinct()
        front = scratch.keep(nxt.join(been.select("origin", "node"), ["origin", "node"], "left_anti"))
        if front.isEmpty():
            break
        seen.append(front.withColumn("hops", F.lit(hops)))
    out = seen[0]
    for s in seen[1:]:
        out = out.unionByName(s)
    return out.filter("hops > 0")


def radius(links: DataFrame, targets: DataFrame, most: int | None = None) -> DataFrame:
    """target, path, name, hops: who breaks if a target (column ``key``) changes, over the six impact kinds.

    File scopes are neither reported nor walked through; self-links and loops back to the target do not count.
    """
    scratch = Scratch(links.sparkSession)
    steps = scratch.keep(pairs(links, IMPACT).filter(F.col("src_name") != MODULE).select(F.col("dst").alias("at"), F.col("src").alias("to")))
    return walk(steps, targets.select(F.col("key").alias("origin"), F.col("key").alias("node")), scratch, most).select(F.col("origin").alias("target"), *split_key(F.col("node")), "hops")


def reach(links: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """source, path, name, hops: what a source (column ``key``) calls, through any number of calls."""
    scratch = Scratch(links.sparkSession)
    steps = scratch.keep(pairs(links, ("calls",)).select(F.col("src").alias("at"), F.col("dst").alias("to")))
    return walk(steps, sources.select(F.col("key").alias("origin"), F.col("key").alias("node")), scratch, most).select(F.col("origin").alias("source"), *split_key(F.col("node")), "hops")


def ancestry(links: DataFrame, targets: DataFrame, most: int = DEEPEST) -> DataFrame:
    """target, path, name, depth: what holds a target, innermost first; of several parents the smallest.

    Chains of holders double in length each round, so ``most`` holders take log2(most) rounds.
    """
    scratch = Scratch(links.sparkSession)
    up = pairs(links, ("contains",)).groupBy("dst").agg(F.min("src").alias("to"))
    chain, length = scratch.keep(up.select(F.col("dst").alias("at"), F.array("to").alias("chain"))), 1
    while length < most:
        more = chain.select(F.col("at").alias("last"), F.col("chain").alias("more"))
        joined = chain.withColumn("last", F.element_at("chain", -1)).join(more, "last", "left")
        chain = scratch.keep(joined.select("at", F.slice(F.concat("chain", F.coalesce("more", F.array().cast("array<string>"))), 1, most).alias("chain")))
        length *= 2
    held = targets.select(F.col("key").alias("target")).distinct().join(chain, F.col("target") == F.col("at"))
    steps = held.select("target", F.posexplode("chain").alias("nth", "node")).filter("node <> target")
    return steps.groupBy("target", "node").agg((F.min("nth") + 1).alias("depth")).select("target", *split_key(F.col("node")), "depth")


def container_radius(links: DataFrame, targets: DataFrame) -> DataFrame:
    """target, path, name, holder: who touches what holds a target without depending on the target itself.

    One hop off each holder over the impact kinds and imports; the innermost holder counts.
    """
    direct = radius(links, targets).select("target", node_key(F.col("path"), F.col("name")).alias("src"))
    holders = ancestry(links, targets).select("target", node_key(F.col("path"), F.col("name")).alias("dst"), "depth")
    touch = pairs(links, CONTAINER).join(holders, "dst").filter((F.col("src") != F.col("dst")) & (F.col("src") != F.col("target")))
    near = touch.join(direct, ["target", "src"], "left_anti").groupBy("target", "src").agg(F.min(F.struct("depth", "dst")).alias("h"))
    return near.select("target", *split_key(F.col("src")), F.col("h.dst").alias("holder"))


def who_touches(links: DataFrame, targets: DataFrame) -> DataFrame:
    """target, kind, src_path, src_name, line of every incoming edge."""
    keyed = links.withColumn("target", node_key(F.col("dst_path"), F.col("dst_name")))
    return keyed.join(targets.select(F.col("key").alias("target")), "target").select("target", "kind", "src_path", "src_name", "line")


def card(nodes: DataFrame, links: DataFrame, targets: DataFrame) -> DataFrame:
    """target, direction (incoming, outgoing, external), path, name, kind, edge_kind; containment is left out."""
    rel = links.filter(F.col("kind") != "contains").withColumns({"src": node_key(F.col("src_path"), F.col("src_name")), "dst": node_key(F.col("dst_path"), F.col("dst_name"))})
    kinds = nodes.select("path", "name", F.col("kind").alias("node_kind"))
    want = targets.select(F.col("key").alias("target"))
    inc = rel.join(want, rel["dst"] == want["target"]).select("target", F.lit("incoming").alias("direction"), F.col("src_path").alias("path"), F.col("src_name").alias("name"), F.col("kind").alias("edge_kind"))
    out = rel.join(want, rel["src"] == want["target"])
    inner = out.filter("dst is not null").select("target", F.lit("outgoing").alias("direction"), F.col("dst_path").alias("path"), F.col("dst_name").alias("name"), F.col("kind").alias("edge_kind"))
    outer = out.filter("dst is null and ext_name is not null").select("target", F.lit("external").alias("direction"), F.lit(None).cast("string").alias("path"), F.col("ext_name").alias("name"), F.lit(None).cast("string").alias("edge_kind")).distinct()
    return inc.unionByName(inner).unionByName(outer).join(kinds, ["path", "name"], "left").select("target", "direction", "path", "name", F.coalesce("node_kind", F.lit("")).alias("kind"), "edge_kind")


def fan_in(nodes: DataFrame, links: DataFrame, kinds: tuple[str, ...] = IMPACT) -> DataFrame:
    """path, name, fan_in of entities that are no scopes: incoming edges of the kinds, file scopes included."""
    n = links.filter(F.col("kind").isin(*kinds) & F.col("dst_path").isNotNull()).groupBy(F.col("dst_path").alias("path"), F.col("dst_name").alias("name")).agg(F.count("*").alias("fan_in"))
    return nodes.filter(~F.col("name").isin(*SCOPES)).select("path", "name").join(n, ["path", "name"], "left").select("path", "name", F.coalesce("fan_in", F.lit(0)).alias("fan_in"))


def load_bearing(nodes: DataFrame, links: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` entities by fan-in (ties by path, name); those without any are hidden."""
    return fan_in(nodes, links).filter("fan_in > 0").orderBy(F.desc("fan_in"), "path", "name").limit(top)


def system_map(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """files, entities, edges: one row; edges are those that leave entities, not files or packages."""
    n = nodes.agg(F.count_if(F.col("name") == MODULE).alias("files"), F.count_if(~F.col("name").isin(*SCOPES)).alias("entities"))
    own = nodes.filter(~F.col("name").isin(*SCOPES)).select(F.col("path").alias("src_path"), F.col("name").alias("src_name"))
    e = links.join(own, ["src_path", "src_name"], "left_semi").agg(F.count("*").alias("edges"))
    return n.withColumn("one", F.lit(1)).join(e.withColumn("one", F.lit(1)), "one").drop("one")


def direct_dependents(links: DataFrame) -> DataFrame:
    """path, name, dependents: distinct sources of the three load-bearing kinds, no scopes, not itself."""
    p = pairs(links, LOAD_BEARING).filter(~F.col("src_name").isin(*SCOPES) & (F.col("src") != F.col("dst")))
    return p.groupBy("dst").agg(F.countDistinct("src").alias("dependents")).select(*split_key(F.col("dst")), "dependents")


def handlers(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """path, name, kind, reach, direct: functions and methods that nothing but file scopes and themselves depends on,
    with the number of nodes their calls reach (themselves left out) and of distinct first targets; reach > 0."""
    scratch = Scratch(links.sparkSession)
    used = pairs(links, LOAD_BEARING).filter((F.col("src_name") != MODULE) & (F.col("src") != F.col("dst"))).select(F.col("dst").alias("key"))
    roots = nodes.filter(F.col("kind").isin("function", "method")).select("path", "name", "kind", node_key(F.col("path"), F.col("name")).alias("key")).join(used, "key", "left_anti")
    steps = scratch.keep(pairs(links, ("calls",)).select(F.col("src").alias("at"), F.col("dst").alias("to")))
    roots = scratch.keep(roots.join(steps.select(F.col("at").alias("key")), "key", "left_semi"))
    direct = roots.join(steps, roots["key"] == steps["at"]).groupBy("key").agg(F.count("*").alias("direct"))
    got = walk(steps, roots.select(F.col("key").alias("origin"), F.col("key").alias("node")), scratch)
    size = got.groupBy(F.col("origin").alias("key")).agg(F.count("*").alias("reach"))
    return roots.join(size, "key").join(direct, "key").select("path", "name", "kind", "reach", "direct")


def radius_graph(nodes: DataFrame, links: DataFrame, targets: DataFrame, direction: str = "in") -> tuple[DataFrame, DataFrame]:
    """The hop diagram: (target, path, name, hops, kind) and (target, src, dst, kind) among its members.

    ``in`` walks the impact kinds and draws the load-bearing ones; ``out`` walks and draws calls.
    """
    hops = (radius(links, targets) if direction == "in" else reach(links, targets).withColumnRenamed("source", "target"))
    shown = hops.join(nodes.select("path", "name", "kind"), ["path", "name"], "left").select("target", "path", "name", "hops", F.coalesce("kind", F.lit("")).alias("kind"))
    members = hops.select("target", node_key(F.col("path"), F.col("name")).alias("key")).unionByName(targets.select(F.col("key").alias("target"), "key"))
    kinds = LOAD_BEARING if direction == "in" else ("calls",)
    rel = links.filter(F.col("kind").isin(*kinds) & F.col("dst_path").isNotNull()).select(node_key(F.col("src_path"), F.col("src_name")).alias("src"), node_key(F.col("dst_path"), F.col("dst_name")).alias("dst"), "kind").distinct()
    a, b = members.withColumnRenamed("key", "src"), members.withColumnRenamed("key", "dst")
    return shown, rel.join(a, "src").join(b, ["target", "dst"]).select("target", "src", "dst", "kind")


def group_of(path: Column, mode: str) -> Column:
    """The node of the file graph a path belongs to: itself, or its top directory (``.`` for files at the root)."""
    return path if mode == "file" else F.when(F.contains(path, F.lit("/")), F.split(path, "/")[0]).otherwise(F.lit("."))


def file_graph(nodes: DataFrame, links: DataFrame, mode: str | None = None, most_files: int = 150) -> tuple[DataFrame, DataFrame]:
    """(id, entities, depth) and (src, dst, n): files, or top directories if there are more than ``most_files``,
    with links between different ones; depth is by layers from those that nothing links to (0 where none leads)."""
    scratch = Scratch(links.sparkSession)
    if mode is None:
        mode = "file" if nodes.filter(F.col("name") == MODULE).select("path").distinct().count() <= most_files else "dir"
    ids = nodes.filter(F.col("name") == MODULE).select(group_of(F.col("path"), mode).alias("id")).distinct()
    count = nodes.filter(~F.col("name").isin(*SCOPES)).groupBy(group_of(F.col("path"), mode).alias("id")).agg(F.count("*").alias("entities"))
    rel = links.filter((F.col("kind") != "contains") & F.col("dst_path").isNotNull()).select(group_of(F.col("src_path"), mode).alias("src"), group_of(F.col("dst_path"), mode).alias("dst"))
    agg = scratch.keep(rel.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n")))
    starts = ids.join(agg.select(F.col("dst").alias("id")), "id", "left_anti").select(F.lit("").alias("origin"), F.col("id").alias("node"))
    layers = walk(agg.select(F.col("src").alias("at"), F.col("dst").alias("to")), starts, scratch).select(F.col("node").alias("id"), F.col("hops").alias("depth"))
    shown = ids.join(count, "id", "left").join(layers, "id", "left").select("id", F.coalesce("entities", F.lit(0)).alias("entities"), F.coalesce("depth", F.lit(0)).alias("depth"))
    return shown, agg


def packages(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Package nodes (path, name, kind) and contains edges (src_path, src_name, dst_path, dst_name) that a list of
    file paths implies: every directory above a file, the root left out."""
    parts = F.split("path", "/")
    files = paths.select("path").filter("path is not null").distinct().withColumn("parts", parts).filter(F.size("parts") > 1)
    ups = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.array_join(F.slice(F.col("parts"), 1, i), "/"))).alias("path")).distinct()
    nodes = ups.select("path", F.lit(PACKAGE).alias("name"), F.lit("package").alias("kind"))
    parent = F.array_join(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), "/")
    inner = ups.filter(F.contains("path", F.lit("/"))).select(parent.alias("src_path"), F.lit(PACKAGE).alias("src_name"), F.col("path").alias("dst_path"), F.lit(PACKAGE).alias("dst_name"))
    leaf = files.select(F.array_join(F.slice("parts", 1, F.size("parts") - 1), "/").alias("src_path"), F.lit(PACKAGE).alias("src_name"), F.col("path").alias("dst_path"), F.lit(MODULE).alias("dst_name"))
    return nodes, inner.unionByName(leaf)


def tree(nodes: DataFrame) -> DataFrame:
    """path, entities: the entities of each file in line order, as an array of (line, name, kind)."""
    return nodes.filter(~F.col("name").isin(*SCOPES)).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "name", "kind"))).alias("entities"))


def kind_weight(kind: Column) -> Column:
    """How much of a score an edge of a kind passes on."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in KIND_WEIGHTS.items() for x in kv)), kind), F.lit(OTHER_KIND))


def adjacency(links: DataFrame) -> DataFrame:
    """node, next, weight, degree: resolved links both ways, weighted by kind; self-links are left out."""
    rel = links.filter("dst_path is not null and dst_name is not null").select(node_key(F.col("src_path"), F.col("src_name")).alias("a"), node_key(F.col("dst_path"), F.col("dst_name")).alias("b"), kind_weight(F.col("kind")).alias("w")).filter("a <> b")
    both = rel.select(F.col("a").alias("node"), F.col("b").alias("next"), F.col("w").alias("weight")).unionByName(rel.select(F.col("b").alias("node"), F.col("a").alias("next"), (F.col("w") * BACKWARDS).alias("weight")))
    degree = both.groupBy("node").agg(F.count("*").alias("degree"))
    return both.join(degree, "node")


def ranked(df: DataFrame, score: str, *ties: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``rank`` from 1, best score first, ties by the columns named."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), *ties) if by else Window.orderBy(F.desc(score), *ties)
    return df.withColumn("rank", F.row_number().over(order))
