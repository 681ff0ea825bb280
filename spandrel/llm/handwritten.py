"""Generated, minified, vendored and data files among source files, by layout statistics tuned per language."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.session import spread

LINE_KEYS = 2_000_000  # most upstream lines that are broadcast; beyond that the join is shuffled


@dataclass(frozen=True)
class Layout:
    """Thresholds of one language: what a person's file stays below (or above, for white space)."""

    mean_line: float  # characters a line
    longest: int  # characters of the longest line
    white: float  # least share of white space
    alnum: float = 0.85  # most share of letters and digits in code, however dense; beyond it a text is prose or encoded
    data: float = 0.65  # share of the text that number tables and encoded runs take
    alike: float = 0.5  # share of the lines that are other lines but for their numbers


LAYOUTS = {
    "py": Layout(110, 1500, 0.08),
    "ts": Layout(110, 1000, 0.08),
    "tsx": Layout(110, 1000, 0.08),
    "js": Layout(110, 1000, 0.08),
    "html": Layout(220, 1400, 0.08),
    "yml": Layout(160, 1500, 0.06, alike=0.95),  # lists of like entries are written by hand
    "tf": Layout(160, 1500, 0.06, alike=0.95),
    "docker": Layout(160, 1500, 0.05),
}
_OTHER = Layout(200, 2000, 0.06)
ALIKE = 6  # lines that are one another but for their numbers before they count

#: Directories that hold other people's packages, one directory a package.
VENDOR_DIRS = frozenset("node_modules bower_components vendor _vendor third_party thirdparty third-party external external_libs extern site-packages deps".split())
#: Names that code generators give their output.
_TOOL_NAME = re.compile(r"(?:[._](?:pb2?|pb2_grpc|generated|autogen)|\.(?:gen|g|designer))\.\w+$", re.I)

# What a tool writes at the beginning or end of its output: that it was made by itself, or that it was made and from
# what, when or by which version, or what becomes of edits. Only comments and the opening docstring are read.
_BY_ITSELF = re.compile(r"@generated\b|\b(?:auto(?:matically)?|machine)[-\s]?(?:generated|created|written|produced|made)\b", re.I)
_MADE = re.compile(r"\b(?:(?:re)?generated?|produced|written|wrote|emitted|rendered|compiled|output)\b", re.I)
_SOURCE = re.compile(r"\b(?:from|source:?|see)\s+[\w/-]+\.[a-z_]\w*|\b\d+\.\d+\b|\b\d{4}-\d\d-\d\d\b|\bwith\s+make\b", re.I)
_FATE = re.compile(r"\bdo(?:\s+not|n't)\s+(?:edit|modify|change)\b|\b(?:changes|edits)\s+(?:are|will\s+be|get)\b|\brun\s+(?:it\s+)?again\b|\b(?:0|no|not|none|never)\b[^.]{0,20}\bby\s+hand\b", re.I)
_OTHER_THINGS = re.compile(r"\b(?!this\b|files?\b|modules?\b|code\b|output\b)\w+\s+(?:is|are|was|were)\s+(?:being\s+)?(?:generated|produced|written|emitted|rendered|compiled)\b", re.I)
EDGE = 4  # lines at each end of a text, and of a docstring, where a tool writes what it has to say
_COMMENT = re.compile(r"^\s*(?:#|//|/\*+!?|\*|<!--|--)(.*)")
_OPENING = re.compile(r"\s*(?:#[^\n]*\n\s*)*[rRuU]?(\"\"\"|''')(.*?)(?:\1|\Z)", re.S)
_NUMBERS = re.compile(r"[-+(\[{]*(?:0x[0-9a-f]+|\d+(?:\.\d+)?(?:e[-+]?\d+)?)[)\]}]*(?:[\s,;]+[-+(\[{]*(?:0x[0-9a-f]+|\d+(?:\.\d+)?(?:e[-+]?\d+)?)[)\]}]*){7,}", re.I)
_ENCODED = re.compile(r"[A-Za-z0-9+/=_-]{56,}|(?:\\x[0-9a-fA-F]{2}){25,}")
_BREAK = re.compile(r"\r\n|\n|\r")
_DIGITS = re.compile(r"\d+")


def language(path: str) -> str:
    base = path.rsplit("/", 1)[-1]
    if base.startswith("Dockerfile") or base.endswith(".dockerfile"):
        return "docker"
    return {"htm": "html", "yaml": "yml", "jsx": "js", "mjs": "js"}.get(ext := base.rsplit(".", 1)[-1].lower(), ext)


def layout(text: str) -> dict[str, float]:
    """Statistics of a text's layout."""
    lines = [x for x in _BREAK.split(text) if x.strip()]
    n = max(1, len(text))
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    low = np.minimum(raw, 255)
    digits = int(((low >= 48) & (low <= 57)).sum())
    letters = int((((low | 32) >= 97) & ((low | 32) <= 122)).sum() + (raw > 191).sum())
    white = int(((low == 32) | ((low >= 9) & (low <= 13))).sum())
    lengths = [len(x) for x in lines] or [0]
    found = 0
    if digits > 0.08 * n or max(lengths) >= 56:  # else no run can reach a tenth of the text
        found = sum(m.end() - m.start() for m in _NUMBERS.finditer(text)) + sum(m.end() - m.start() for m in _ENCODED.finditer(text))
    alike = 0
    if digits > 0.02 * n and len(lines) >= 2 * ALIKE:
        shapes = Counter(y for x in lines if (y := _DIGITS.sub("0", x)) != x)
        alike = sum(k for k in shapes.values() if k >= ALIKE)
    return {
        "mean_line": sum(lengths) / len(lengths), "longest": max(lengths), "white": white / n,
        "alnum": (digits + letters) / n, "digits": digits / n, "data": min(1.0, found / n), "alike": alike / len(lengths),
    }


def notes(text: str) -> Iterator[str]:
    """Comments and docstring lines at the beginning and the end of a text."""
    lines = [x for x in _BREAK.split(text) if x.strip()]
    for line in [*lines[:EDGE], *lines[max(EDGE, len(lines) - EDGE) :]]:
        if m := _COMMENT.match(line):
            yield m.group(1)
    if m := _OPENING.match(text):
        said = _BREAK.split(m.group(2).strip())
        yield from said[:EDGE]
        yield from said[max(EDGE, len(said) - EDGE) :]


def made_by_tool(line: str) -> bool:
    """Whether a line says that a tool made what it stands in."""
    if _BY_ITSELF.search(line):
        return True
    return bool(_MADE.search(line) and (_SOURCE.search(line) or _FATE.search(line)) and not _OTHER_THINGS.search(line))


def verdict(path: str, text: str) -> str | None:
    """``vendored``, ``generated``, ``minified``, ``data`` or None, from text and path alone."""
    limit = LAYOUTS.get(language(path), _OTHER)
    at = layout(text)
    if at["data"] >= limit.data:
        return "data"
    # one long line in an otherwise loose text is a table or a string, not minified code
    if at["white"] < limit.white and at["alnum"] < limit.alnum and (at["mean_line"] > limit.mean_line or at["longest"] > limit.longest):
        return "minified"
    if at["alike"] >= limit.alike:
        return "generated"
    if any(p in VENDOR_DIRS for p in path.split("/")[:-2]):
        return "vendored"
    if text.strip() and (_TOOL_NAME.search(path) or any(map(made_by_tool, notes(text)))):
        return "generated"
    return None


def tool_note(meta: str | None) -> bool:
    """Whether what is known of a module says that a tool wrote it."""
    return bool(meta) and any(map(made_by_tool, _BREAK.split(meta)))


def _by_text(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            found = [(p, v) for p, t in zip(paths, texts) if (v := verdict(p, t))]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], ["path", "why"])

    return spread(files).mapInArrow(run, "path string, why string")


def _lines(text):
    """Lines as written but for white space; blank ones are gone."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, "[ \\t\\f\\x0b\\xa0]+", " "), "\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")


def _whole(lines):
    return F.xxhash64(F.lit(1), F.array_join(lines, "\n"))


def _copies(files: DataFrame, upstream: DataFrame, least: float) -> DataFrame:
    """Files that are an upstream file but for white space, or hold at least ``least`` of the telling lines of one.

    Lines that more than two packages hold tell nothing; the others count by their length.
    """
    known = upstream.filter("content is not null").select(F.xxhash64("package_name", "release_tag", "path").alias("up"), "package_name", _lines("content").alias("lines")).filter("size(lines) > 0")
    lines = known.select("up", "package_name", F.explode("lines").alias("l")).select("up", "package_name", F.xxhash64("l").alias("line"), F.length("l").alias("chars")).distinct()
    # packages of a line are counted in two steps, so that a licence that all hold is no single group of rows
    telling = lines.select("line", "package_name").distinct().groupBy("line").agg(F.count("*").alias("packages")).filter("packages <= 2")
    lines = lines.join(telling, "line", "left_semi").select("line", "up", "chars")
    sizes = lines.groupBy("up").agg(F.sum("chars").alias("size"))
    # an equal text counts as all of the lines, even where none is telling
    same = known.select(_whole(F.col("lines")).alias("line"), "up").distinct().join(sizes, "up", "left").select("line", "up", F.coalesce("size", F.lit(1)).alias("chars"), F.coalesce("size", F.lit(1)).alias("size"))
    keys = lines.join(sizes, "up").select("line", "up", "chars", "size").unionByName(same)
    if keys.limit(LINE_KEYS + 1).count() <= LINE_KEYS:
        keys = F.broadcast(keys)
    cut = files.select("path", _lines("content").alias("lines"))
    held = cut.select("path", F.explode(F.array_distinct(F.concat(F.transform("lines", lambda x: F.xxhash64(x)), F.array(_whole(F.col("lines")))))).alias("line"))
    # a line counts once a path, however often the path was delivered
    shared = held.join(keys, "line").groupBy("path", "up", "line").agg(F.first("chars").alias("chars"), F.first("size").alias("size"))
    shared = shared.groupBy("path", "up").agg(F.sum("chars").alias("chars"), F.first("size").alias("size")).filter(F.col("chars") >= F.lit(least) * F.col("size"))
    return shared.select("path", F.lit("vendored").alias("why"))


def not_handwritten(files: DataFrame, entities: DataFrame, upstream: DataFrame, least_copy: float = 0.5) -> DataFrame:
    """path, why of the files that nobody on the team wrote by hand.

    ``why``: ``data`` (number tables and encoded runs take at least 65 % of the text), ``minified`` (little white
    space, not mostly letters and digits, and long lines, by language), ``generated`` (lines that are one another but
    for their numbers, a name as generators give it, or a comment at either end, the opening docstring or the module's
    meta that says a tool made the file), ``vendored`` (a package below a vendor directory, an upstream file's text, or
    at least ``least_copy`` of its telling lines by length). Of several reasons an upstream file comes first, then layout.

    Layout is judged in one narrow pass; only flagged paths and lines shared with upstream files are shuffled.

    Defined results: rows with null path or content are ignored; an empty text is no case; a path delivered more
    than once gives one row if any of its texts is a case; empty tables give no rows (without upstream files or
    entities the other signs still count); other columns are ignored.
    """
    files = files.select("path", "content").filter("path is not null and content is not null")
    note = F.pandas_udf(lambda metas: metas.map(tool_note), "boolean")  # Arrow batches
    said = entities.filter((F.col("name") == "<module>") & F.col("meta").isNotNull()).select("path", "meta").filter(note("meta"))
    said = files.select("path").join(said.select("path").distinct(), "path", "left_semi").select("path", F.lit("generated").alias("why"))
    ranked = [df.select("path", F.struct(F.lit(n).alias("rank"), "why").alias("why")) for n, df in enumerate((_copies(files, upstream, least_copy), _by_text(files), said))]
    return ranked[0].unionByName(ranked[1]).unionByName(ranked[2]).groupBy("path").agg(F.min("why").alias("why")).select("path", "why.why")
