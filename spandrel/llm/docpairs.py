"""Functions paired with their documentation, trivial documentation dropped."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.extract.functions import BREAK, functions
from spandrel.session import Scratch, spread

#: Words that say nothing about a particular function.
_EMPTY = frozenset(
    """a an the this that these it its is are was be been to of in on for from with by and or as at into do does did done
    function method procedure routine helper util utility callback handler wrapper class module object code
    takes take given returns return returned returning value values result results output input inputs parameter parameters
    param params argument arguments arg args self cls none null void any type types name named called call calls
    gets get sets set makes make performs perform handles handle implements implementation simple default main basic
    see todo fixme doc docs documentation documented description summary comment method's function's""".split()
)
_LATER = re.compile(
    r"""^\W*(?:to-?\s?do|fixme|xxx+|hack|tbd|tba|t\.\s?b\.\s?d|wip|undocumented|not\ documented|undescribed|lorem\ ipsum)\b|^\W*(?:stub(?:bed)?|placeholder)\b(?!\s+\w+s\b)
    |^\W*(?:(?:short|brief|one-?line)\ )?(?:summary|description)(?:\ line)?\W*$|^\W*(?:same\ as\ (?:before|above|below)|as\ (?:above|before)|ditto|idem)\W*$
    |^\W*(?:n\W?a|none|nothing|empty|summary|_?summary_?|description|_?description_?|docstring|comment|documentation|docs?)\W*$
    |^\W*(?:see\ (?:above|below|code|elsewhere|the\ code|other\ docs?))\W*$
    |\b(?:documentation|description|docstring|docs?|comment|text|explanation)\ (?:is\ |are\ )?(?:still\ )?(?:missing|pending|goes\ here|here|follows?|to\ follow|to\ come|later|needed|outstanding)\b
    |\b(?:yet|still|needs|has|have|remains)\ to\ be\ (?:documented|described|written|explained|filled|added|done)\b
    |^\W*to\ be\ (?:documented|described|written|explained|filled|added|done|defined|determined)\b
    |\b(?:no|without)\ (?:documentation|description|docs|docstring)\b|\b(?:write|fill|add|document|describe|explain)\ (?:this|me|in|text|it|later)\W*$
    |\bneeds?\ a\ (?:description|docstring|comment)\b""",
    re.I | re.X,
)
_OTHER = re.compile(
    r"""^\W*(?:copyright\b|\(c\)\s|©|spdx\b|licen[cs]ed?\b|all\ rights\ reserved|owner\s*:|author\s*:|maintainer\s*:|created\ (?:by|on)\b)
    |^\W*(?:noqa\b|type:\s*ignore|pragma\b|pylint\b|flake8\b|mypy\b|ruff\b|fmt:|isort\b|eslint\b|tslint\b|prettier\b|jshint\b|istanbul\b|c8\ ignore|@?ts-|region\b|endregion\b|nosec\b|coding[:=]|vim?:|!/)
    |^\s*([-=*~\#_+.\s]{2,}).*?([-=*~\#_+.]{2,})\s*$""",
    re.I | re.X,
)
_CODE = re.compile(
    r"""^\s*(?:if|elif|while|for)\b[^.]*:\s*(?:return|pass|break|continue|raise)?.*$(?<![.])|^\s*(?:return|yield|raise|throw|await|del|assert|import|from)\b(?=.*[\[\](){}=;+*<>]|\s+\w+;?\s*$).*(?<![.!])$
    |^\s*(?:const|let|var)\s+\w+\s*=|^\s*[\w.\[\]]+\s*[-+*/|&]?=(?!=)\s*\S+|^\s*[\w.]+\([^)]*\);?\s*(?:\#.*|//.*)?$|^\s*(?:def|class|function|export|async)\s+\w+.*[({:].*$|^\s*[{}\])();,]+\s*$
    |^\s*if\s*\(.*\).*[;{]?\s*$|^\s*(?:else|try|finally|except\b.*|catch\b.*)\s*[:{]""",
    re.X,
)
_TAG = re.compile(r"^\s*(?:@|:|\\)(?:param|parameter|arg|argument|key|return|returns|rtype|type|raises?|throws?|template|see|since|version|author)\b\s*:?(?:\s*\{[^}]*\})?\s*(.*)$", re.I)
_HEAD = re.compile(r"^\s*(?:args?|arguments|parameters|params|returns?|yields?|raises|attributes|notes?|examples?)\s*:?\s*-*\s*$", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")


def _stem(word: str) -> str:
    for end in ("ing", "ies", "es", "ed", "s", "e", "y"):
        if len(word) > len(end) + 3 and word.endswith(end):
            return word[: -len(end)]
    return word


def says_something(doc: str, name: str, params: tuple[str, ...] = ()) -> bool:
    """Whether a documentation text tells more than the names of the function and its parameters.

    At least two words must remain when the words of the names, words without content and tags are taken away;
    texts that stand in for documentation, and notices, directives, dividers and commented-out code are nothing.
    """
    lines = [x.strip() for x in BREAK.split(doc)]
    lines = [x for x in lines if x and not _HEAD.match(x)]
    main = [x for x in lines if not _TAG.match(x)]
    while main and _OTHER.search(main[0]):
        main.pop(0)
    text = " ".join(main)
    if main and (_LATER.search(re.split(r"(?<=[.!?])\s", text, maxsplit=1)[0]) or all(_CODE.search(x) for x in main)):
        return False
    # elsewhere a note that more is to come takes its own sentence only
    main = [x for x in re.split(r"(?<=[.!?])\s+", text) if x and not _LATER.search(x)]
    last = name.rsplit(".", 1)[-1]
    known = {_stem(p.lower()) for n in (name, *params) for p in _PARTS.findall(n)}
    known |= {re.sub(r"\W|_", "", n).lower() for n in (last, *params)}
    told = set()
    for line in [*main, *(m.group(1) for x in lines if (m := _TAG.match(x)))] if main else ():
        for w in _WORD.findall(line):
            low = w.lower()
            if low in known or low in _EMPTY:
                continue
            rest = [p for p in (q.lower() for q in _PARTS.findall(w)) if p not in _EMPTY and _stem(p) not in known and len(p) > 1]
            told.update(rest)
    return len(told) >= 2


_SYMBOL = "path string, module string, name string, line int, params array<string>, kind string, doc string, says boolean, body boolean"


def _module(path: str) -> str:
    return re.sub(r"(?:\.d)?\.(?:pyi?|tsx?)$", "", path)


def symbols(files: DataFrame) -> DataFrame:
    """The symbol table of all files: one row a function or method, with its best documentation.

    The best is the first that says something, else the first there is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for f in functions(path, text):
                    best, says = (None, None), False
                    for kind, doc in f.docs:
                        if says := says_something(doc, f.name, f.params):
                            best = (kind, doc)
                            break
                    else:
                        best = f.docs[0] if f.docs else best
                    rows.append((path, _module(path), f.name, f.line, list(f.params), *best, says, f.has_body))
            cols = list(zip(*rows)) or [()] * 9
            types = [pa.string()] * 3 + [pa.int32(), pa.list_(pa.string()), pa.string(), pa.string(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["path", "module", "name", "line", "params", "kind", "doc", "says", "body"])

    return spread(files.filter("path is not null and content is not null").select("path", "content")).mapInArrow(run, _SYMBOL)


def _signature(params):
    """Parameter names without case and underscores, so that overloads and their definition compare."""
    return F.array_join(F.transform(params, lambda p: F.lower(F.regexp_replace(p, "[_$]", ""))), ",")


def documented_functions(files: DataFrame, entities: DataFrame) -> DataFrame:
    """path, name, kind, doc of living functions and methods whose documentation says something.

    Symbol tables of all files are built in one narrow pass. Declarations without a body (overloads, interface
    members, stub files) are joined with definitions of the same module and qualified name; a definition without
    documentation takes that of the declaration with the same normalised signature, else of the one with as many
    parameters, else of the first. The pairs are then joined with the entities.

    Defined results: a function is an address of kind function or method with a row whose removed_at is null;
    where files hold no content for its path, meta stands in unless doc_kind says there is no documentation or
    meta is a slice of source; null, empty and trivial documentation is dropped; repeated rows give one row (the
    latest delivered symbol does not matter, the smallest text counts); empty tables give no rows; other columns
    are ignored.
    """
    table = Scratch(files.sparkSession).keep(symbols(files.select("path", "content").filter(F.lower("path").rlike("\\.(pyi?|tsx?)$"))))  # parsed once
    found = table.filter("says")
    own = found.filter("body").select("path", "name", "kind", "doc", F.lit(0).alias("rank"))
    declared = found.filter("not body").select("module", "name", F.col("path").alias("at"), "kind", "doc", _signature(F.col("params")).alias("sig"), F.size("params").alias("arity"))
    lacking = table.filter("body and not says").select("path", "module", "name", _signature(F.col("params")).alias("own_sig"), F.size("params").alias("own_arity"))
    lent = declared.join(lacking, ["module", "name"]).select("path", "name", "kind", "doc", F.when(F.col("sig") == F.col("own_sig"), 1).when(F.col("arity") == F.col("own_arity"), 2).otherwise(3).alias("rank"))
    direct = declared.select(F.col("at").alias("path"), "name", "kind", "doc", F.lit(4).alias("rank"))
    pairs = own.unionByName(lent).unionByName(direct)

    living = entities.filter(F.col("removed_at").isNull() & F.col("kind").isin("function", "method") & F.col("path").isNotNull() & F.col("name").isNotNull())
    living = living.select("path", "name", "meta", F.lower("doc_kind").alias("doc_kind"))
    says = F.pandas_udf(lambda docs, names: pd.Series([says_something(d, n) for d, n in zip(docs, names)], dtype=bool), "boolean")  # Arrow batches
    silent = files.filter("path is not null").groupBy("path").agg(F.max(F.col("content").isNotNull()).alias("held")).filter("not held").select("path")
    slices = F.col("meta").rlike(r"^\s*(?:(?:export|default|public|private|protected|static|async|declare)\s+)*(?:def|function|class)\s+\w+|^\s*\w+\s*\([^)]*\)\s*(?::[^\n{]*)?\{")
    stand_in = living.join(silent, "path", "left_semi").filter(F.col("meta").isNotNull() & F.coalesce(F.col("doc_kind") != "none", F.lit(True)) & ~slices)
    stand_in = stand_in.filter(says("meta", "name")).select("path", "name", F.coalesce("doc_kind", F.lit("leading")).alias("kind"), F.col("meta").alias("doc"), F.lit(5).alias("rank"))
    both = pairs.join(living.select("path", "name").distinct(), ["path", "name"], "left_semi").unionByName(stand_in)
    return both.groupBy("path", "name").agg(F.min(F.struct("rank", "doc", "kind")).alias("d")).select("path", "name", "d.kind", "d.doc")
