"""Extraction: files in, entities, bindings, raw references and a status a file out, in one pass of workers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.extract.languages import BUILT_IN, Language, language_of
from spandrel.extract.readers import MODULE, read
from spandrel.operators.graph import packages
from spandrel.session import Scratch, spread

_ROW = (
    "path string, part string, language string, version string, name string, kind string, line int, last int, meta string, doc_kind string, parent string, "
    "module string, member string, style string, star boolean, ord int, target string, resolve string, only array<string>, unresolved string, "
    "delivery struct<hash:string,row:bigint>"
)
_TYPES = [pa.string()] * 6 + [pa.int32()] * 2 + [pa.string()] * 6 + [pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.struct([("hash", pa.string()), ("row", pa.int64())])]
_NAMES = [x.split()[0] for x in _ROW.split(", ")]


@dataclass
class Extracted:
    """files: path, language, version, suffix, index, own, status (ok, partial or failed), error. entities, bindings,
    references: one row a finding. contains: containment edges. paths: every file path, claimed or not."""

    files: DataFrame
    entities: DataFrame
    bindings: DataFrame
    references: DataFrame
    contains: DataFrame
    paths: DataFrame


def _rows(path: str, text: str, languages: tuple[Language, ...]) -> Iterator[dict]:
    lang = language_of(path, languages)
    if lang is None:
        return
    base = {"path": path, "language": lang.name, "version": lang.version}
    try:
        source = read(text, lang)
    except Exception as e:  # noqa: BLE001 - a file that can't be read must not end the job
        yield {**base, "part": "file", "kind": "failed", "meta": f"{type(e).__name__}: {e}"[:200]}
        yield {**base, "part": "entity", "name": MODULE, "kind": "module", "line": 1, "meta": "", "doc_kind": "none"}
        return
    yield {**base, "part": "file", "kind": "partial" if source.error else "ok", "meta": source.error or None}
    yield {**base, "part": "entity", "name": MODULE, "kind": "module", "line": 1, "last": text.count("\n") + 1, "meta": source.module_doc[0], "doc_kind": source.module_doc[1]}
    for e in source.entities:
        yield {**base, "part": "entity", **e._asdict()}
    for i, b in enumerate(source.bindings):
        yield {**base, "part": "binding", "name": b.local, "module": b.module, "member": b.member, "style": b.style, "star": b.star, "line": b.line, "ord": i, "target": ".".join(filter(None, [b.module.rstrip("."), b.member])) or b.module}
    for r in source.references:
        yield {**base, "part": "reference", "name": r.src, "kind": r.kind, "target": r.target, "line": r.line, "resolve": r.resolve, "only": list(r.only), "unresolved": r.unresolved}


def extract(files: DataFrame, languages: tuple[Language, ...] = BUILT_IN) -> Extracted:
    """Read every file (path, content) that a language claims.

    A worker reads a file by itself, in one pass that shuffles no text; a file that it can't read is recorded as
    failed and has only its module. Of rows that repeat a path one counts (the smallest hash of the content), which is
    settled among what was found; null contents are paths without findings.
    """
    scratch = Scratch(files.sparkSession)
    known = files.filter("path is not null")
    one = known.filter("content is not null").select("path", "content", F.struct(F.sha2("content", 256).alias("hash"), F.monotonically_increasing_id().alias("row")).alias("delivery"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{**r, "delivery": d} for p, t, d in zip(*(c.to_pylist() for c in b.columns)) for r in _rows(p, t, languages)]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(_NAMES, _TYPES)], _NAMES)

    all_ = scratch.keep(spread(one).mapInArrow(run, _ROW), "part")
    heard = all_.filter("part = 'file'").groupBy("path").agg(F.min("delivery").alias("delivery"), F.count("*").alias("times"))
    again = scratch.keep(heard.filter("times > 1").select("path", F.col("delivery").alias("first")))  # paths that were delivered more than once
    kept = all_.join(again, "path", "left").filter("first is null or first = delivery").drop("first", "delivery")
    of = lambda part: kept.filter(F.col("part") == part)
    spark = files.sparkSession
    kinds = spark.createDataFrame([(x.name, x.suffix, x.index, x.own) for x in languages], "language string, suffix string, index string, own string")
    got = of("file").select("path", "language", "version", F.col("kind").alias("status"), F.col("meta").alias("error")).join(F.broadcast(kinds), "language")
    entities = of("entity").select("path", "name", "kind", "line", "last", "meta", "doc_kind", F.col("language").alias("recipe"), F.col("version").alias("recipe_version"), "parent")
    own = entities.filter("parent is not null").select(F.col("path").alias("src_path"), F.col("parent").alias("src_name"), F.col("path").alias("dst_path"), F.col("name").alias("dst_name"))
    nodes, up = packages(got)
    pack = nodes.select("path", "name", "kind", F.lit(0).alias("line"), F.lit(0).alias("last"), F.lit("").alias("meta"), F.lit("none").alias("doc_kind"), F.lit("").alias("recipe"), F.lit("").alias("recipe_version"), F.lit(None).cast("string").alias("parent"))
    bindings = of("binding").select(F.col("path").alias("src_path"), F.col("name").alias("local"), "module", "member", "style", "star", "ord", "line", "target")
    references = of("reference").select(F.col("path").alias("src_path"), F.col("name").alias("src_name"), "kind", "target", "line", "resolve", "only", "unresolved")
    return Extracted(got, entities.unionByName(pack), bindings, references, own.unionByName(up), known.select("path").distinct())
