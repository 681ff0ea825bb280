"""What a change touches: changed lines against the spans of entities, and who is at risk."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.extract.patches import PatchError, anchored, apply, changed, parse, unapply
from spandrel.operators.extraction import extract
from spandrel.operators.graph import LOAD_BEARING, MODULE, SCOPES, radius
from spandrel.session import Scratch
from spandrel.tables import node_key

HEAVY = 3  # direct dependents that make an entity load-bearing
BUCKET = 64  # lines of a bucket of the range join


def changed_lines(diffs: DataFrame) -> DataFrame:
    """id, path, status, side (old, new, anchor), line of every changed line of the diffs (id, diff).

    Null and empty diffs change nothing; a file without hunks gives one row with a null line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for id_, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for d in parse(text):
                    sides = changed(d)
                    rows += [(id_, d.path, d.status, side, n) for side, ns in zip(("old", "new", "anchor"), sides) for n in ns]
                    if not any(sides):
                        rows.append((id_, d.path, d.status, None, None))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string()] * 4 + [pa.int32()])], ["id", "path", "status", "side", "line"])

    return diffs.filter("diff is not null").select(F.col("id").cast("string"), "diff").mapInArrow(run, "id string, path string, status string, side string, line int")


def fold_runs(lines: DataFrame, *by: str, line: str = "line") -> DataFrame:
    """by..., first, last: runs of consecutive numbers; repeated and null numbers count once and not at all."""
    rows = lines.filter(F.col(line).isNotNull()).select(*by, line).distinct()
    island = F.col(line) - F.row_number().over(Window.partitionBy(*by).orderBy(line))
    return rows.withColumn("island", island).groupBy(*by, "island").agg(F.min(line).alias("first"), F.max(line).alias("last")).drop("island")


def _buckets(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(F.floor(first / BUCKET), F.floor(last / BUCKET)))


def overlapping(runs: DataFrame, spans: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``runs`` (first, last) and ``spans`` (start, stop) of equal keys that share a line.

    Both are cut into buckets of 64 lines, so that the join is one of equal keys and buckets; a pair that meets in
    several buckets is kept in the first they share.
    """
    a = runs.withColumn("bucket", _buckets(F.col("first"), F.col("last")))
    b = spans.withColumn("bucket", _buckets(F.col("start"), F.col("stop")))
    meet = a.join(b, [*keys, "bucket"]).filter("start <= last and first <= stop")
    return meet.filter(F.col("bucket") == F.greatest(F.floor(F.col("first") / BUCKET), F.floor(F.col("start") / BUCKET))).drop("bucket")


def innermost(points: DataFrame, spans: DataFrame, *keys: str) -> DataFrame:
    """points with ``owner``: the name of the smallest span (start, stop, name) that holds the line; null if none does."""
    hit = overlapping(points.withColumns({"first": F.col("line"), "last": F.col("line")}), spans, *keys)
    best = hit.groupBy(*keys, "line").agg(F.min(F.struct((F.col("stop") - F.col("start")).alias("size"), "name")).alias("o"))
    return points.join(best.select(*keys, "line", F.col("o.name").alias("owner")), [*keys, "line"], "left")


def base_files(head: DataFrame, diffs: DataFrame) -> DataFrame:
    """path, content, status: the files that one diff changes as they were before it, from those after it.

    ``status`` is ok, or ``failed`` where the diff does not fit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                for d in parse(text):
                    if d.path == path and d.status != "added":
                        try:
                            rows.append((path, unapply(content or "", d), "ok"))
                        except PatchError:
                            rows.append((path, None, "failed"))
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["path", "content", "status"])

    touched = changed_lines(diffs).select("path", "status").distinct()
    one = diffs.select(F.col("diff")).limit(1)
    files = touched.join(head.select("path", "content"), "path", "left").select("path", "content").withColumn("one", F.lit(1)).join(F.broadcast(one.withColumn("one", F.lit(1))), "one").drop("one")
    return files.mapInArrow(run, "path string, content string, status string")


def touched(diffs: DataFrame, head: DataFrame, base: DataFrame) -> DataFrame:
    """path, name, kind, change (added, modified, deleted) of entities whose span a changed line meets.

    ``diffs`` has one diff, ``head`` and ``base`` the files (path, content) after and before it. Every span that a
    line meets is touched, so a class is along with its method; an entity of one side only is added or deleted.
    """
    lines = changed_lines(diffs)
    paths = lines.select("path").distinct()

    def spans(files: DataFrame) -> DataFrame:
        got = extract(files.join(paths, "path", "left_semi")).entities.filter(~F.col("name").isin(*SCOPES))
        return got.select("path", "name", "kind", F.col("line").alias("start"), F.greatest("line", "last").alias("stop"))

    new, old = spans(head), spans(base)
    of = lambda side: fold_runs(lines.filter(F.col("side") == side), "path")
    hit_new = overlapping(of("new"), new, "path").select("path", "name").distinct().withColumn("hit_new", F.lit(True))
    hit_old = overlapping(of("old"), old, "path").select("path", "name").distinct().withColumn("hit_old", F.lit(True))
    both = new.select("path", "name", F.col("kind").alias("new_kind")).join(old.select("path", "name", F.col("kind").alias("old_kind")), ["path", "name"], "full_outer")
    both = both.join(hit_new, ["path", "name"], "left").join(hit_old, ["path", "name"], "left")
    change = F.when(F.col("old_kind").isNull() & F.col("hit_new"), "added").when(F.col("new_kind").isNull() & F.col("hit_old"), "deleted").when(F.col("old_kind").isNotNull() & F.col("new_kind").isNotNull() & (F.coalesce("hit_new", F.lit(False)) | F.coalesce("hit_old", F.lit(False))), "modified")
    return both.withColumn("change", change).filter("change is not null").select("path", "name", F.coalesce("new_kind", "old_kind").alias("kind"), "change")


def still_naming(links: DataFrame, gone: DataFrame) -> DataFrame:
    """path, name, src_path, src_name: who still names an entity that is gone, by the text of external targets.

    A text names it if it is the name, its last part, or ends in a dot and its last part.
    """
    text = links.filter(F.col("kind").isin(*LOAD_BEARING) & F.col("ext_name").isNotNull() & (F.col("src_name") != MODULE)).select("src_path", "src_name", F.col("ext_name").alias("text")).distinct()
    tail = F.element_at(F.split("name", "\\."), -1)
    by_tail = gone.select("path", "name", tail.alias("tail"))
    return text.withColumn("tail", F.element_at(F.split("text", "\\."), -1)).join(by_tail, "tail").select("path", "name", "src_path", "src_name").distinct()


def delta(changes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(touched entities with radius size, dependents and load_bearing; those at risk with the fewest hops).

    ``changes`` is what ``touched`` gives, ``links`` the resolved links after the change. What is added has no
    dependents yet; what is deleted endangers those that still name it, one hop off. What is itself touched is not
    at risk.
    """
    mod = changes.filter("change = 'modified'").select(node_key(F.col("path"), F.col("name")).alias("key"))
    hops = radius(links, mod)
    named = still_naming(links, changes.filter("change = 'deleted'")).select(node_key(F.col("path"), F.col("name")).alias("target"), F.col("src_path").alias("path"), F.col("src_name").alias("name"), F.lit(1).alias("hops"))
    every = hops.unionByName(named)
    direct = links.filter(F.col("kind").isin(*LOAD_BEARING) & F.col("dst_path").isNotNull() & ~F.col("src_name").isin(*SCOPES)).select(node_key(F.col("dst_path"), F.col("dst_name")).alias("target"), node_key(F.col("src_path"), F.col("src_name")).alias("src")).filter("target <> src").distinct()
    near = direct.unionByName(named.select("target", node_key(F.col("path"), F.col("name")).alias("src"))).groupBy("target").agg(F.countDistinct("src").alias("dependents"))
    size = every.groupBy("target").agg(F.count("*").alias("radius"))
    keyed = changes.withColumn("target", node_key(F.col("path"), F.col("name")))
    shown = keyed.join(size, "target", "left").join(near, "target", "left")
    shown = shown.select("path", "name", "kind", "change", F.coalesce("radius", F.lit(0)).alias("radius"), F.when(F.col("change") == "added", 0).otherwise(F.coalesce("dependents", F.lit(0))).alias("dependents"))
    shown = shown.withColumn("load_bearing", F.col("dependents") >= HEAVY)
    risk = every.groupBy("path", "name").agg(F.min("hops").alias("hops")).join(changes.select("path", "name"), ["path", "name"], "left_anti")
    return shown, risk


def cross_language(links: DataFrame, languages: DataFrame, paths: DataFrame) -> DataFrame:
    """path, others: for changed files, the languages of other files that refer to them in another language."""
    a = languages.select(F.col("path").alias("src_path"), F.col("language").alias("src_language"))
    b = languages.select(F.col("path").alias("dst_path"), F.col("language").alias("dst_language"))
    into = links.filter("kind <> 'contains' and dst_path is not null").select("src_path", "dst_path").distinct().join(paths.select(F.col("path").alias("dst_path")).distinct(), "dst_path", "left_semi")
    got = into.join(a, "src_path").join(b, "dst_path").filter("src_language <> dst_language")
    return got.groupBy(F.col("dst_path").alias("path")).agg(F.array_sort(F.collect_set("src_language")).alias("others"))


def class_of_change(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, change (added, deleted, modified, same) between two snapshots, compared by a hash of ``value``."""
    a = old.select(key, F.sha2(F.coalesce(F.col(value).cast("string"), F.lit("\u0000")), 256).alias("a"))
    b = new.select(key, F.sha2(F.coalesce(F.col(value).cast("string"), F.lit("\u0000")), 256).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified").otherwise("same")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


PYTHON = ("function", "class", "method")


def patched_files(instances: DataFrame, base: DataFrame) -> DataFrame:
    """id, path, side (old, new), content, lines (changed lines of that side), status of the files that each instance's diff (id, diff) changes.

    ``base`` has id, path, content before the diff. Hunks that have moved are anchored anew, so lines are those where
    the old lines really stand; ``status`` is ok, or ``failed`` where a hunk fits nowhere (then contents and lines are
    those stated). A file that the diff adds has no old side, one that it deletes no new one.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, d.old_path if d.status != "added" else d.path, k) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, d in enumerate(parse(text))]
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32()))], ["id", "path", "nth"])

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, nth, text, content in zip(*(c.to_pylist() for c in b.columns)):
                d = parse(text)[nth]
                d = d._replace(old_path=d.path) if d.status == "added" else d
                status, new, at = "ok", None, d
                try:
                    at = anchored(content or "", d)
                    new = apply(content or "", at)
                except PatchError:
                    status = "failed"
                removed, added, anchors = changed(at)
                if d.status != "added":
                    rows.append((i, d.old_path, "old", content, sorted({*removed, *anchors}), status))
                if d.status != "deleted":
                    rows.append((i, d.path, "new", new, added, status))
            cols = list(zip(*rows)) or [()] * 6
            types = [pa.string()] * 4 + [pa.list_(pa.int32()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["id", "path", "side", "content", "lines", "status"])

    diffs = instances.filter("diff is not null").select(F.col("id").cast("string").alias("id"), "diff").distinct()
    parts = diffs.mapInArrow(split, "id string, path string, nth int")
    held = parts.join(base.select(F.col("id").cast("string").alias("id"), "path", "content"), ["id", "path"], "left").join(diffs, "id")
    return held.select("id", "nth", "diff", "content").mapInArrow(sides, "id string, path string, side string, content string, lines array<int>, status string")


def truth(instances: DataFrame, base: DataFrame) -> DataFrame:
    """id, path, name, is_added: what a gold patch changes, the innermost entity around each changed line.

    Old lines (removed, or those that additions follow) are looked up before the patch, and added lines after it; an
    entity that only the new side has ``is_added``. A line outside of any entity stands for the file (``<module>``).

    ``instances`` has id, diff; ``base`` has id, path, content before the patch. Kept apart from what is judged by it.
    """
    scratch = Scratch(instances.sparkSession)
    files = scratch.keep(patched_files(instances, base))
    key = F.concat_ws("\u0001", "side", "id", "path")
    found = extract(files.filter("content is not null").select(key.alias("path"), "content")).entities.filter(~F.col("name").isin(*SCOPES) & F.col("kind").isin(*PYTHON))
    cut = F.split("path", "\u0001", 3)
    spans = scratch.keep(found.select(cut[0].alias("side"), cut[1].alias("id"), cut[2].alias("path"), "name", F.col("line").alias("start"), F.greatest("line", "last").alias("stop")))
    lines = files.select("side", "id", "path", F.explode("lines").alias("line")).distinct()
    owned = innermost(lines, spans, "side", "id", "path").select("side", "id", "path", F.coalesce("owner", F.lit(MODULE)).alias("name")).distinct()
    had = spans.filter("side = 'old'").select("id", "path", "name").distinct()
    old = owned.filter("side = 'old'").select("id", "path", "name")
    # of the new side only what was not there before counts, as its other lines have their place on the old side
    new = owned.filter((F.col("side") == "new") & (F.col("name") != MODULE)).select("id", "path", "name").join(had, ["id", "path", "name"], "left_anti")
    fresh = files.filter("side = 'new'").select("id", "path").join(files.filter("side = 'old'").select("id", "path"), ["id", "path"], "left_anti").withColumn("name", F.lit(MODULE))
    added = new.unionByName(fresh).distinct().withColumn("is_added", F.lit(True))
    return old.withColumn("is_added", F.lit(False)).unionByName(added).select("id", "path", "name", "is_added")
