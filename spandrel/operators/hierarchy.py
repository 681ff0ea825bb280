"""Parent-child links to full hierarchies by heavy-path decomposition, cycles told apart."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spandrel.session import Scratch
from spandrel.tables import in_force

BUCKET = 1024  # preorder numbers of one bucket of descendants
WAYS = 64  # into so many runs the children of one parent are cut for their prefix sums


@dataclass
class Hierarchy:
    """Labels of every node; all tables lie in the shared folder.

    nodes: id, path, name. links: id, parent (the one parent in force). chains: id, head, pos (place on its heavy
    chain), size (nodes in its subtree, itself included); nodes on or below a loop are missing here. heads: head,
    root, base (depth of the head).
    """

    scratch: Scratch
    nodes: DataFrame
    links: DataFrame
    chains: DataFrame
    heads: DataFrame

    def labels(self) -> DataFrame:
        """id, path, name, root_path, root_name, depth, size; root '' and depth -1 on or below a loop."""
        placed = self.chains.join(self.heads, "head").select("id", "root", (F.col("base") + F.col("pos")).alias("depth"), "size")
        roots = self.nodes.select(F.col("id").alias("root"), F.col("path").alias("root_path"), F.col("name").alias("root_name")).join(self.heads.filter("root = head").select("root"), "root", "left_semi")
        return (
            self.nodes.join(placed, "id", "left")
            .join(roots, "root", "left")
            .select("id", "path", "name", F.coalesce("root_path", F.lit("")).alias("root_path"), F.coalesce("root_name", F.lit("")).alias("root_name"), F.coalesce("depth", F.lit(-1)).cast("long").alias("depth"), "size")
        )

    def intervals(self) -> DataFrame:
        """id, root, first, last: the descendants of a node are the nodes of its tree with ``first`` in (first, last].

        Numbers are given in preorder, heavy child first, so a chain is one run of numbers. A light child starts
        after its parent, the parent's heavy subtree and its earlier siblings; sums over siblings are taken in
        64 runs a parent, so a parent of very many children is not one task's work.
        """
        size = self.chains.select("id", "head", "pos", "size")
        kids = self.links.join(size, "id")
        heavy = kids.filter("id <> head").select("parent", F.col("size").alias("heavy_size"))
        light = kids.filter("id = head").select("id", "parent", "size").withColumn("way", F.pmod(F.xxhash64("id"), F.lit(WAYS)))
        runs = light.groupBy("parent", "way").agg(F.sum("size").alias("run_size"))
        runs = runs.withColumn("before", F.sum("run_size").over(Window.partitionBy("parent").orderBy("way").rowsBetween(Window.unboundedPreceding, -1)))
        light = light.withColumn("within", F.sum("size").over(Window.partitionBy("parent", "way").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)))
        light = light.join(runs.select("parent", "way", "before"), ["parent", "way"]).join(heavy, "parent", "left")
        offset = light.select(F.col("id").alias("head"), "parent", (1 + F.coalesce("heavy_size", F.lit(0)) + F.coalesce("within", F.lit(0)) + F.coalesce("before", F.lit(0))).alias("offset"))
        at = self.chains.select(F.col("id").alias("parent"), F.col("head").alias("up"), F.col("pos").alias("at"))
        links = offset.join(at, "parent").select("head", "up", (F.col("at") + F.col("offset")).alias("step"))
        starts = _to_top(self.scratch, self.heads.select("head"), links)
        return (
            self.chains.join(starts.select("head", F.col("sum").alias("start")), "head")
            .join(self.heads.select("head", "root"), "head")
            .select("id", "root", (F.col("start") + F.col("pos")).alias("first"), (F.col("start") + F.col("pos") + F.col("size") - 1).alias("last"))
        )

    def segments(self) -> DataFrame:
        """id, segments: the chains (head, upto) that make up the way from the root; at most log2(nodes) of them."""
        at = self.chains.select(F.col("id").alias("parent"), F.col("head").alias("up"), F.col("pos").alias("at"))
        ups = self.links.join(self.chains.filter("id = head").select("id"), "id").join(at, "parent").select(F.col("id").alias("head"), "up", "at")
        done = [self.scratch.keep(self.heads.filter("root = head").select("head", F.array().cast("array<struct<head:bigint,upto:bigint>>").alias("above")))]
        while True:
            step = ups.join(done[-1].select(F.col("head").alias("up"), "above"), "up").select("head", F.concat("above", F.array(F.struct(F.col("up").alias("head"), F.col("at").alias("upto")))).alias("above"))
            step = self.scratch.keep(step)
            if step.isEmpty():
                break
            done.append(step)
        above = done[0]
        for d in done[1:]:
            above = above.unionByName(d)
        return self.chains.join(above, "head").select("id", F.concat("above", F.array(F.struct("head", F.col("pos").alias("upto")))).alias("segments"))

    def paths(self, separator: str = "/") -> DataFrame:
        """path, name, depth, full_path: node keys from the root down, joined; loops give ''.

        Each way is put together from the segments of the few chains it runs over, so the work is in proportion
        to the text that comes out.
        """
        named = self.nodes.select("id", F.concat("path", F.lit("::"), "name").alias("key"))
        links = self.chains.join(named, "id").select(F.col("head").alias("on"), F.col("pos").alias("link"), "key")
        parts = self.segments().select("id", F.posexplode("segments").alias("nth", "s")).select("id", "nth", F.col("s.head").alias("on"), F.col("s.upto").alias("upto"))
        steps = parts.join(links, (parts["on"] == links["on"]) & (links["link"] <= parts["upto"])).select("id", F.struct("nth", "link", "key").alias("s"))
        full = steps.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["key"]).alias("keys"))
        return self.labels().join(full, "id", "left").select("path", "name", "depth", F.coalesce(F.array_join("keys", separator), F.lit("")).alias("full_path"))

    def descendant_counts(self) -> DataFrame:
        """path, name, descendants (0 for a leaf, null on or below a loop)."""
        return self.labels().select("path", "name", (F.col("size") - 1).alias("descendants"))

    def descendants_of(self, keys: DataFrame | None = None) -> DataFrame:
        """All descendants of the nodes in ``keys`` (path, name), else of every node: ancestor path and name, path, name.

        By chain intervals; nodes on or below a loop have none. Names are joined before pairs are made, so that no
        pair is shuffled.
        """
        spans = self.scratch.keep(self.intervals().join(self.nodes, "id").select("root", "path", "name", "first", "last"))
        asked = spans if keys is None else keys.select("path", "name").distinct().join(spans, ["path", "name"])
        asked = asked.select("root", F.col("path").alias("anc_path"), F.col("name").alias("anc_name"), F.col("first").alias("lo"), F.col("last").alias("hi"))
        # runs of numbers meet in buckets: each bucket inside an interval is all descendants, so no pair is tried in vain
        nth = lambda c: F.floor(c / BUCKET)
        asked = asked.filter("hi > lo").withColumn("bucket", F.explode(F.sequence(nth(F.col("lo") + 1), nth(F.col("hi")))))
        inside = spans.select("root", "path", "name", "first").withColumn("bucket", nth(F.col("first"))).join(asked, ["root", "bucket"]).filter("first > lo and first <= hi")
        return inside.select("anc_path", "anc_name", "path", "name")


def _to_top(scratch: Scratch, heads: DataFrame, links: DataFrame) -> DataFrame:
    """head, top, sum: where the way over ``links`` (head, up, step) ends and the sum of its steps, by doubling.

    Every round joins only what has not arrived, with what is known of the place it has come to.
    """
    way = heads.join(links, "head", "left").select("head", F.coalesce("up", "head").alias("top"), F.coalesce("step", F.lit(0)).cast("long").alias("sum"), F.col("up").isNull().alias("done"))
    done, todo = [], scratch.keep(way)
    while True:
        known = todo
        for d in done:
            known = known.unionByName(d)
        seen = known.select(F.col("head").alias("top"), F.col("top").alias("next"), F.col("sum").alias("more"), F.col("done").alias("there"))
        go = todo.filter("not done")
        if go.isEmpty():
            break
        went = scratch.keep(go.join(seen, "top").select("head", F.col("next").alias("top"), (F.col("sum") + F.col("more")).alias("sum"), F.col("there").alias("done")))
        done.append(todo.filter("done"))
        todo = went
    out = todo
    for d in done:
        out = out.unionByName(d)
    return out.select("head", "top", "sum")


def _nodes(edges: DataFrame, kind: str) -> DataFrame:
    """path, name, up (struct of the smallest parent's path and name, null for a root): one row a node, one shuffle."""
    rel = in_force(edges).filter(F.col("kind") == kind)
    whole = F.col("src_path").isNotNull() & F.col("src_name").isNotNull()
    src = F.struct("src_path", "src_name")
    below = rel.select(F.col("dst_path").alias("path"), F.col("dst_name").alias("name"), F.when(whole, src).alias("up")).filter("path is not null and name is not null")
    above = rel.filter(whole).select(F.col("src_path").alias("path"), F.col("src_name").alias("name")).distinct().withColumn("up", F.lit(None).cast(below.schema["up"].dataType))
    return below.unionByName(above).groupBy("path", "name").agg(F.min("up").alias("up"))


def hierarchy(edges: DataFrame, kind: str = "contains") -> Hierarchy:
    """Decompose the forest that the edges of ``kind`` in force make (src contains dst) into heavy paths.

    1. Nodes get dense ids. 2. Rounds k = 0, 1, ... hold the nodes that have a 2**k-th ancestor, with that ancestor
    and the number of descendants nearer than 2**k; sums over them by ancestor add up to all subtree sizes. A round
    that loses no node holds just the nodes on and below loops (were there a node of finite depth among them, one
    of its ancestors would have been lost), and ends the rounds: log2(depth) + 2 of them, each over fewer rows.
    3. The child with the largest subtree continues its parent's chain (of equal ones, the one with the smallest
    id); doubling along chains gives head and position. 4. Doubling over the tree of chains, at most log2(nodes)
    high, gives each head its root and depth.

    Defined results: edges that are not in force, of other kinds, or repeated are ignored; an end with null path
    or name is no node, and a node whose only link has a null source is a root; of several parents the smallest
    (path, name) counts; a self-link is a loop; an empty table gives no rows; other columns are ignored.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark)
    nodes = scratch.keep(_nodes(edges, kind).withColumn("id", F.monotonically_increasing_id()))
    up = nodes.filter("up is not null").select("id", F.col("up.src_path").alias("path"), F.col("up.src_name").alias("name"))
    links = scratch.keep(up.join(nodes.select("path", "name", F.col("id").alias("parent")), ["path", "name"]).select("id", "parent"))
    nodes = nodes.select("id", "path", "name")

    sums = []
    here = links.select("id", F.col("parent").alias("anc"), F.lit(1).cast("long").alias("size"))
    n = links.count()
    old = None
    while n:
        more = here.groupBy("anc").agg(F.sum("size").alias("more"))
        sums.append(more := scratch.keep(more))
        far = here.select(F.col("id").alias("anc"), F.col("anc").alias("next"))
        later = here.join(far, "anc").join(more.withColumnRenamed("anc", "id"), "id", "left").select("id", F.col("next").alias("anc"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        later = scratch.keep(later)
        m = later.count()
        if old is not None:
            scratch.drop(old)
        here, old = later, later
        if m == n:
            break
        n = m
    looped = here.select("id") if n else None

    tree = nodes.select("id")
    if looped is not None:
        tree = tree.join(looped, "id", "left_anti")
    below = sums[0] if sums else None
    for s in sums[1:]:
        below = below.unionByName(s)
    if below is not None:
        below = below.groupBy(F.col("anc").alias("id")).agg(F.sum("more").alias("below"))
        size = tree.join(below, "id", "left").select("id", (1 + F.coalesce("below", F.lit(0))).alias("size"))
    else:
        size = tree.select("id", F.lit(1).cast("long").alias("size"))
    sized = scratch.keep(size.join(links, "id", "left").select("id", "size", "parent"))

    heavy = sized.filter("parent is not null").groupBy("parent").agg(F.max(F.struct("size", (-F.col("id")).alias("back"))).alias("h")).select((-F.col("h.back")).alias("head"), F.col("parent").alias("up"), F.lit(1).cast("long").alias("step"))
    chain = _to_top(scratch, sized.select(F.col("id").alias("head")), heavy)
    chains = scratch.keep(chain.select(F.col("head").alias("id"), F.col("top").alias("head"), F.col("sum").alias("pos")).join(sized, "id"))

    at = chains.select(F.col("id").alias("parent"), F.col("head").alias("up"), (F.col("pos") + 1).alias("step"))
    tops = chains.filter("id = head").select("head", "parent")
    ups = tops.join(at, "parent").select("head", "up", "step")
    heads = scratch.keep(_to_top(scratch, tops.select("head"), ups).select("head", F.col("top").alias("root"), F.col("sum").alias("base")))
    return Hierarchy(scratch, nodes, links, chains.drop("parent"), heads)
