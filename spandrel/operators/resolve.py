"""Resolution: names as written become edges between addresses.

All lookups are joins. What a name means in a module (its own definition, what an import or a star import brings
in, through any number of re-exports) is one table of requests that is widened round by round until no request is
new, then answered from the definitions back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.functions.text import module_path, normal_path, path_reference
from spandrel.operators.extraction import Extracted
from spandrel.operators.graph import MODULE
from spandrel.session import Scratch


def _candidates(module: Column, source: Column, style: Column, suffix: Column, index: Column) -> Column:
    """Paths that a module may be, best first: as a path (itself, with the suffix, its index file) or dotted."""
    p = normal_path(path_reference(module), source)
    by_path = F.when(p.isNull(), F.array().cast("array<string>")).otherwise(F.array(p, F.concat(p, suffix), F.when(index != "", F.concat(p, F.lit("/"), index, suffix))))
    dotted = F.array(module_path(module, source, suffix), F.when((index != "") & (suffix != ""), F.concat(module_path(module, source, F.lit("")), F.lit("/"), index, suffix)))
    return F.filter(F.when(style == "path", by_path).otherwise(dotted), lambda x: x.isNotNull() & (x != ""))


def _submodule(module: Column, member: Column, source: Column, suffix: Column) -> Column:
    return module_path(F.when(module.endswith("."), F.concat(module, member)).otherwise(F.concat(module, F.lit("."), member)), source, suffix)


def _meanings(asked: DataFrame, ents: DataFrame, paths: DataFrame, bound: DataFrame, stars: DataFrame, scratch: Scratch) -> DataFrame:
    """in_path, in_name, path, name: what the names asked for (in_path, in_name) mean there."""
    todo = scratch.keep(asked.distinct())
    every, links = todo, []
    defined = ents.select("path", "name", F.col("path").alias("in_path"), F.col("name").alias("in_name"))
    while True:  # a request is made once, so loops of imports end as well
        open_ = todo.join(defined.select("in_path", "in_name"), ["in_path", "in_name"], "left_anti")
        named = open_.join(bound.select(F.col("src_path").alias("in_path"), F.col("local").alias("in_name"), "member", "cands"), ["in_path", "in_name"])
        named = named.select("in_path", "in_name", F.posexplode("cands").alias("ord", "to_path"), F.coalesce("member", F.lit(MODULE)).alias("to_name"))
        starred = open_.join(bound.select(F.col("src_path").alias("in_path"), F.col("local").alias("in_name")), ["in_path", "in_name"], "left_anti")
        starred = starred.join(stars.select(F.col("src_path").alias("in_path"), "ord", "cands"), "in_path").select("in_path", "in_name", F.posexplode("cands").alias("nth", "to_path"), F.col("in_name").alias("to_name"), "ord")
        step = named.unionByName(starred.select("in_path", "in_name", (F.col("ord") * 10 + F.col("nth")).alias("ord"), "to_path", "to_name"))
        step = scratch.keep(step.join(paths.withColumnRenamed("path", "to_path"), "to_path").select("in_path", "in_name", "ord", "to_path", "to_name"))
        links.append(step)
        todo = scratch.keep(step.select(F.col("to_path").alias("in_path"), F.col("to_name").alias("in_name")).distinct().join(every, ["in_path", "in_name"], "left_anti"))
        if todo.isEmpty():
            break
        every = every.unionByName(todo)
    known = scratch.keep(every.join(defined, ["in_path", "in_name"]).select("in_path", "in_name", "path", "name"))
    own = known
    steps = links[0]
    for s in links[1:]:
        steps = steps.unionByName(s)
    for _ in links:
        # a name means what the first of its alternatives that means anything does
        via = steps.join(known.select(F.col("in_path").alias("to_path"), F.col("in_name").alias("to_name"), "path", "name"), ["to_path", "to_name"])
        got = via.groupBy("in_path", "in_name").agg(F.min(F.struct("ord", "path", "name")).alias("b")).select("in_path", "in_name", "b.path", "b.name")
        known = scratch.keep(own.unionByName(got))
    return known


def resolve(x: Extracted) -> DataFrame:
    """src_path, src_name, kind, target, dst_path, dst_name, external, line: the edges of everything extracted.

    Imports: a member that a candidate module means, else the module file itself, else the member as a module of
    its own, else external. Other references: ``self.x`` in a method is its class's x or nothing; else the longest
    imported prefix decides (one that is bound but leads nowhere ends the search); else the file's own definition;
    else star imports. References by path need an existing file, by name the smallest address of an allowed kind
    with that name or ending. What only some kinds may answer is dropped when another kind does; what is not found
    becomes external or is dropped, as its rule says.
    """
    spark = x.files.sparkSession
    scratch = Scratch(spark)
    ents = scratch.keep(x.entities.groupBy("path", "name").agg(F.min("kind").alias("kind")))
    about = x.files.select(F.col("path").alias("src_path"), "suffix", "index", "own")
    tracked = x.files.select("path")
    bind = scratch.keep(x.bindings.join(about, "src_path").withColumn("cands", _candidates(F.col("module"), F.col("src_path"), F.col("style"), F.col("suffix"), F.col("index"))))
    last = bind.filter("not star").groupBy("src_path", "local").agg(F.max_by(F.struct("module", "member", "style", "cands", "suffix"), "ord").alias("b")).select("src_path", "local", "b.*")
    bound = scratch.keep(last)
    stars = bind.filter("star").select("src_path", "ord", "cands")

    # what has to be known: the members of imports, the rest of each bound prefix, and bare names
    imports = bind.filter("not star").select("src_path", "local", "module", "member", "style", "cands", "suffix", "line", "target").withColumn("row", F.monotonically_increasing_id())
    imports = scratch.keep(imports)
    refs = scratch.keep(x.references.join(about, "src_path").withColumn("row", F.monotonically_increasing_id()))
    lex = refs.filter("resolve = 'lexical'")
    in_self = (F.col("own") != "") & F.startswith("target", F.concat("own", F.lit("."))) & F.contains("src_name", F.lit("."))
    mine = lex.filter(in_self).select("row", "src_path", F.concat(F.regexp_replace("src_name", "\\.[^.]*$", ""), F.expr("substring(target, length(own) + 1)")).alias("name"))
    free = lex.filter(~in_self).withColumn("parts", F.split("target", "\\."))
    cuts = free.select("row", "src_path", "parts", F.explode(F.sequence(F.size("parts"), F.lit(1), F.lit(-1))).alias("cut")).withColumn("local", F.array_join(F.slice("parts", F.lit(1), F.col("cut")), "."))
    hit = cuts.join(bound, ["src_path", "local"])
    longest = hit.groupBy("row").agg(F.max("cut").alias("cut"))
    hit = scratch.keep(
        hit.join(longest, ["row", "cut"]).withColumn("rest", F.array_join(F.slice("parts", F.col("cut") + 1, F.greatest(F.size("parts") - F.col("cut"), F.lit(0))), "."))
        .withColumn("name", F.when(F.col("member").isNotNull() & (F.col("rest") != ""), F.concat("member", F.lit("."), "rest")).when(F.col("member").isNotNull(), F.col("member")).when(F.col("rest") != "", F.col("rest")))
    )
    bare = free.join(hit.select("row"), "row", "left_anti").select("row", F.col("src_path").alias("in_path"), F.col("target").alias("in_name"))

    hit_alts = hit.select("row", F.posexplode("cands").alias("ord", "in_path"), F.coalesce("name", F.lit(MODULE)).alias("in_name"))
    imp_alts = imports.select("row", F.posexplode("cands").alias("ord", "in_path"), F.coalesce("member", F.lit(MODULE)).alias("in_name"))
    asked = hit_alts.select("in_path", "in_name").unionByName(imp_alts.select("in_path", "in_name")).unionByName(bare.select("in_path", "in_name"))
    means = _meanings(asked.join(tracked.withColumnRenamed("path", "in_path"), "in_path", "left_semi"), ents, tracked, bound, stars, scratch)

    def first(alts: DataFrame) -> DataFrame:
        got = alts.join(means, ["in_path", "in_name"])
        return got.groupBy("row").agg(F.min(F.struct("ord", "path", "name")).alias("b")).select("row", "b.path", "b.name")

    def also_module(rows: DataFrame, rest: Column) -> DataFrame:
        """The member may be a module: its own name in there, or the file itself."""
        m = rows.filter("member is not null and style = 'module'").select("row", _submodule(F.col("module"), F.col("member"), F.col("src_path"), F.col("suffix")).alias("path"), F.when(rest != "", rest).otherwise(F.lit(MODULE)).alias("name"))
        return m.join(ents.select("path", "name"), ["path", "name"], "left_semi").select("row", "path", "name")

    def either(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.unionByName(b.join(a.select("row"), "row", "left_anti"))

    imported = either(first(imp_alts), also_module(imports, F.lit("")))
    bound_refs = either(first(hit_alts), also_module(hit, F.col("rest")))
    own_refs = mine.withColumnRenamed("src_path", "path").join(ents.select("path", "name"), ["path", "name"], "left_semi").select("row", "path", "name")
    bare_refs = bare.join(means, ["in_path", "in_name"]).select("row", "path", "name")

    by_path = refs.filter("resolve = 'path'").withColumn("p", normal_path(path_reference(F.col("target")), F.col("src_path"))).filter("p is not null")
    by_path = by_path.select("row", F.posexplode(F.when(F.col("suffix") != "", F.array("p", F.concat("p", "suffix"))).otherwise(F.array("p"))).alias("ord", "path")).join(x.paths, "path")
    by_path = by_path.groupBy("row").agg(F.min(F.struct("ord", "path")).alias("b")).select("row", "b.path", F.lit(MODULE).alias("name"))
    ends = ents.withColumn("parts", F.split("name", "\\.")).select("path", "name", "kind", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice(F.col("parts"), i, F.size("parts")), "."))).alias("target"))
    named = refs.filter("resolve = 'name'").select("row", "target", "only").join(ends, "target").filter((F.size("only") == 0) | F.array_contains("only", F.col("kind")))
    by_name = named.groupBy("row").agg(F.min(F.struct("path", "name")).alias("b")).select("row", "b.path", "b.name")

    answers = own_refs.unionByName(bound_refs).unionByName(bare_refs).unionByName(by_path).unionByName(by_name)
    kinds = ents.withColumnRenamed("kind", "dst_kind")
    told = refs.join(answers, "row", "left").join(kinds, ["path", "name"], "left")
    allowed = (F.col("resolve") == "path") | (F.size("only") == 0) | F.coalesce(F.array_contains("only", F.col("dst_kind")), F.lit(False))
    found = F.col("path").isNotNull() & allowed
    out = told.filter(found | (F.col("unresolved") == "external")).select(
        "src_path", "src_name", "kind", "target", F.when(found, F.col("path")).alias("dst_path"), F.when(found, F.col("name")).alias("dst_name"), F.when(~found, F.col("target")).alias("external"), "line"
    )
    imp = imports.join(imported, "row", "left").select("src_path", F.lit(MODULE).alias("src_name"), F.lit("imports").alias("kind"), "target", F.col("path").alias("dst_path"), F.col("name").alias("dst_name"), F.when(F.col("path").isNull(), F.col("target")).alias("external"), "line")
    star = bind.filter("star").select("src_path", F.posexplode("cands").alias("nth", "path"), "ord", "target", "line").join(tracked, "path", "left_semi").groupBy("src_path", "ord", "target", "line").agg(F.min(F.struct("nth", "path")).alias("b"))
    star_all = bind.filter("star").select("src_path", "ord", "target", "line").join(star.select("src_path", "ord", "b"), ["src_path", "ord"], "left")
    star_all = star_all.select("src_path", F.lit(MODULE).alias("src_name"), F.lit("imports").alias("kind"), "target", F.col("b.path").alias("dst_path"), F.when(F.col("b").isNotNull(), F.lit(MODULE)).alias("dst_name"), F.when(F.col("b").isNull(), F.col("target")).alias("external"), "line")
    held = x.contains.select("src_path", "src_name", F.lit("contains").alias("kind"), F.lit(None).cast("string").alias("target"), "dst_path", "dst_name", F.lit(None).cast("string").alias("external"), F.lit(0).alias("line"))
    return out.unionByName(imp).unionByName(star_all).unionByName(held)


def conforms(edges: DataFrame, expected: DataFrame) -> DataFrame:
    """The expected edges (src_path, src_name, kind, dst_path, dst_name) that are not there; empty if all are."""
    keys = ["src_path", "src_name", "kind", "dst_path", "dst_name"]
    return expected.select(*keys).join(edges.select(*keys), keys, "left_anti")
