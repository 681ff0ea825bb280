"""What a source file defines, imports and refers to. Plain Python for workers; nothing here imports Spark."""

from __future__ import annotations

import ast
import bisect
import re
import warnings
from typing import NamedTuple

from spandrel.extract.functions import BREAK
from spandrel.extract.languages import Language

LONGEST = 400  # characters of documentation or source kept with an entity
DOC_RANK = {"none": 0, "leading": 1, "jsdoc": 2, "docstring": 3}
MODULE = "<module>"


class Entity(NamedTuple):
    name: str
    kind: str
    line: int
    last: int
    meta: str
    doc_kind: str
    parent: str


class Binding(NamedTuple):
    local: str | None  # None for a star
    module: str
    member: str | None
    style: str
    star: bool
    line: int


class Reference(NamedTuple):
    src: str
    kind: str
    target: str
    line: int
    resolve: str
    only: tuple[str, ...]
    unresolved: str


class Source(NamedTuple):
    entities: list[Entity]
    bindings: list[Binding]
    references: list[Reference]
    module_doc: tuple[str, str]  # text, kind
    error: str = ""  # of a file that was read in part


# What is no part of a comment's words: its marks at either end of a line; and whole lines: shebangs, rules between
# sections, orders to tools, lines without a letter.
_FRAME = re.compile(r"\A\s*(?:(?:#|//|/\*|\*/?|\"{3})\s*)*|[\s*/]+\Z")
_NO_WORDS = re.compile(r"\A\s*#!|[-=*~_#─]{3}")
# Orders to tools.
_ORDER = re.compile(r"(?:type:\s*ignore|noqa|pragma|pylint:|eslint-|prettier-|@ts-|coding[:=]|-\*-)")


def plain_comment(text: str) -> str:
    """A comment's words, line by line."""
    said = (_FRAME.sub("", line) for line in BREAK.split(text) if not _NO_WORDS.search(line))
    return "\n".join(line for line in said if re.search(r"[^\W\d_]", line) and not _ORDER.match(line))


def _comment_above(lines: list[str], at: int, mark: str) -> tuple[str, str] | None:
    """(kind, words) of the comment that only blank lines and decorators part from line ``at`` (from 0)."""
    i = at - 1
    while i >= 0 and (not lines[i].strip() or lines[i].lstrip().startswith("@")):
        i -= 1
    if i < 0:
        return None
    if mark == "//" and lines[i].rstrip().endswith("*/"):
        j = i
        while j >= 0 and "/*" not in lines[j]:
            j -= 1
        if j < 0 or not lines[j].lstrip().startswith("/*"):
            return None
        return ("jsdoc" if lines[j].lstrip().startswith("/**") else "leading"), plain_comment("\n".join(lines[j : i + 1]))
    j = i
    while j >= 0 and (lines[j].lstrip().startswith(mark) or (not lines[j].strip() and j > 0 and lines[j - 1].lstrip().startswith(mark))):
        j -= 1
    if j == i:
        return None
    return "leading", plain_comment("\n".join(lines[j + 1 : i + 1]))


def _first_comment(lines: list[str], mark: str) -> tuple[str, str]:
    block = []
    for line in lines:
        s = line.strip()
        if s.startswith(mark) or (mark == "//" and (s.startswith(("/*", "*")) or (block and block[-1].startswith(("/*", "*")) and not block[-1].endswith("*/")))):
            block.append(s)
        elif s or block:
            break
    words = plain_comment("\n".join(block))
    return words, ("jsdoc" if block and block[0].startswith("/**") else "leading") if words else "none"


def _entity(name: str, kind: str, first: int, last: int, docs: list[tuple[str, str]], slice_: str) -> Entity:
    best = ("", "none")
    for doc_kind, text in docs:
        text = text.strip()[:LONGEST]
        if text and DOC_RANK[doc_kind] > DOC_RANK[best[1]]:
            best = (text, doc_kind)
    return Entity(name, kind, first, last, best[0] or slice_.strip()[:LONGEST], best[1], name.rpartition(".")[0] or MODULE)


def _dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        return ".".join([node.id, *reversed(parts)])
    return None


class _Python(ast.NodeVisitor):
    def __init__(self, text: str):
        self.lines = BREAK.split(text)
        self.entities: dict[str, Entity] = {}
        self.bindings: list[Binding] = []
        self.found: dict[tuple, Reference] = {}
        self.scope: list[str] = []
        self.in_class: list[bool] = []

    def refer(self, kind: str, target: str | None, node: ast.AST, rule: str, only: tuple[str, ...] = (), unresolved: str = "external", src: str | None = None, resolve: str = "lexical") -> None:
        if target:
            src = src or ".".join(self.scope) or MODULE
            self.found.setdefault((rule, src, kind, target, node.lineno), Reference(src, kind, target, node.lineno, resolve, only, unresolved))

    def define(self, node: ast.AST, name: str, kind: str, docs: list[tuple[str, str]]) -> None:
        full = ".".join([*self.scope, name])
        if full not in self.entities:
            self.entities[full] = _entity(full, kind, node.lineno, node.end_lineno or node.lineno, docs, "\n".join(self.lines[node.lineno - 1 : node.end_lineno]))

    def definition(self, node, kind: str) -> None:
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        docs = [("docstring", d)] if (d := ast.get_docstring(node, clean=False)) else []
        if above := _comment_above(self.lines, first - 1, "#"):
            docs.append(above)
        self.define(node, node.name, kind, docs)
        full = ".".join([*self.scope, node.name])
        for d in node.decorator_list:
            f = d.func if isinstance(d, ast.Call) else d
            self.refer("calls", _dotted(f) or ast.unparse(f), d, "decorator", src=full)
            self.visit(d)
        if kind == "class":
            for base in node.bases:
                self.refer("inherits", _dotted(base) or ast.unparse(base), base, "inherits", src=full)
        else:
            for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs, node.args.vararg, node.args.kwarg]:
                if a is not None and a.annotation is not None:
                    self.annotate(a.annotation, full)
            if node.returns is not None:
                self.annotate(node.returns, full)
            for x in [*node.args.defaults, *(x for x in node.args.kw_defaults if x)]:
                self.visit(x)
        self.scope.append(node.name)
        self.in_class.append(kind == "class")
        if kind == "class":
            for base in [*node.bases, *(k.value for k in node.keywords)]:
                self.visit(base)
        for child in node.body:
            self.visit(child)
        self.scope.pop()
        self.in_class.pop()

    def annotate(self, node: ast.AST, src: str | None = None) -> None:
        inner = [node]
        if isinstance(node, ast.Subscript):
            inner = [node.value, *(node.slice.elts if isinstance(node.slice, ast.Tuple) else [node.slice])]
        elif isinstance(node, ast.BinOp):
            inner = [node.left, node.right]
        for x in inner:
            if isinstance(x, ast.Name):
                self.refer("types", x.id, x, "types", ("class",), "drop", src=src)

    def visit_FunctionDef(self, node):
        self.definition(node, "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node):
        self.definition(node, "class")

    def assigned(self, node, targets) -> None:
        if not self.scope or self.in_class[-1]:
            for t in targets:
                for n in t.elts if isinstance(t, (ast.Tuple, ast.List)) and not self.scope else [t]:
                    if isinstance(n, ast.Name):
                        above = _comment_above(self.lines, node.lineno - 1, "#")
                        full = ".".join([*self.scope, n.id])
                        if full not in self.entities:
                            self.entities[full] = _entity(full, "state", n.lineno, n.lineno, [above] if above else [], "\n".join(self.lines[node.lineno - 1 : node.end_lineno]))
        for t in targets:
            if isinstance(t, ast.Attribute):
                self.refer("writes", _dotted(t), t, "writes attribute", ("state",), "drop")
            self.visit(t)

    def visit_Assign(self, node):
        self.assigned(node, node.targets)
        self.visit(node.value)

    def visit_AnnAssign(self, node):
        self.annotate(node.annotation)
        self.assigned(node, [node.target])
        if node.value:
            self.visit(node.value)

    def visit_AugAssign(self, node):
        if isinstance(node.target, ast.Attribute):
            self.refer("writes", _dotted(node.target), node.target, "writes attribute", ("state",), "drop")
        self.generic_visit(node)

    def visit_Global(self, node):
        for n in node.names:
            self.refer("writes", n, node, "writes global", ("state",), "drop")

    def visit_Import(self, node):
        for a in node.names:
            self.bindings.append(Binding(a.asname or a.name, a.name, None, "module", False, node.lineno))

    def visit_ImportFrom(self, node):
        module = "." * node.level + (node.module or "")
        for a in node.names:
            if a.name == "*":
                self.bindings.append(Binding(None, module, None, "module", True, node.lineno))
            else:
                self.bindings.append(Binding(a.asname or a.name, module, a.name, "module", False, node.lineno))

    def visit_Call(self, node):
        self.refer("calls", _dotted(node.func) or ast.unparse(node.func), node, "calls")
        for a in node.args:
            for x in a.elts if isinstance(a, ast.Tuple) else [a]:
                if isinstance(x, ast.Name):
                    self.refer("reads", x.id, x, "argument", ("class",), "drop")
        self.generic_visit(node)

    def visit_Raise(self, node):
        if isinstance(node.exc, ast.Name):
            self.refer("reads", node.exc.id, node, "raise", ("class",), "drop")
        self.generic_visit(node)

    def visit_ExceptHandler(self, node):
        for x in node.type.elts if isinstance(node.type, ast.Tuple) else [node.type]:
            if isinstance(x, ast.Name):
                self.refer("reads", x.id, x, "except", ("class",), "drop")
        self.generic_visit(node)

    def visit_Subscript(self, node):
        if isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, str) and node.slice.value:
            self.refer("reads", node.slice.value, node, "setting", ("key", "variable", "output"), "drop", resolve="name")
        self.generic_visit(node)

    def visit_Name(self, node):
        self.refer("reads", node.id, node, "name", ("state",), "drop")

    def visit_Attribute(self, node):
        self.refer("reads", _dotted(node), node, "attribute", ("state",), "drop")
        self.generic_visit(node)


def _may_resolve(refs: list[Reference], entities: dict[str, Entity], bindings: list[Binding], own: str) -> list[Reference]:
    """References without those to local names, which could only be dropped: no name of the file, import or star has them."""
    if any(b.star for b in bindings):
        return refs
    bound = {b.local for b in bindings} | {b.local.split(".")[0] for b in bindings if b.local}
    return [r for r in refs if r.unresolved != "drop" or r.resolve != "lexical" or r.target in entities or r.target.split(".")[0] in bound or (own and r.target.startswith(own + "."))]


MENDED = 20  # places of one file that are left out before it counts as unreadable


def _parsed(text: str) -> tuple[ast.Module, str]:
    """The tree of a text, and the first error if it has any: then statements around errors are left out."""
    lines, said = BREAK.split(text), ""
    for _ in range(MENDED):
        try:
            return ast.parse("\n".join(lines)), said
        except SyntaxError as e:
            said = said or f"{type(e).__name__}: line {e.lineno}: {e.msg}"
            at = min(max(0, (e.lineno or 1) - 1), len(lines) - 1)
            margin = len(lines[at]) - len(lines[at].lstrip())
            if "expected an indented block" in e.msg:  # the header before it gets an empty body
                k = at - (at > 0)
                while k > 0 and not lines[k].rstrip().endswith(":"):
                    k -= 1
                if not lines[k].rstrip().endswith(":"):
                    raise
                lines[k] += " pass"
                continue
            while at > 0 and not lines[at].strip():
                at -= 1
            if not lines[at].strip():
                raise
            header = re.match(r"\s*(?:async\s+)?(?:def|class|if|elif|for|while|with|try|except|else|finally)\b", lines[at])
            lines[at] = ""
            # what stands deeper belonged to it
            for k in range(at + 1, len(lines)) if header or "unexpected indent" in e.msg else ():
                own = len(lines[k]) - len(lines[k].lstrip())
                if lines[k].strip() and (own < margin if "unexpected indent" in e.msg else own <= margin):
                    break
                lines[k] = ""
    raise SyntaxError(said)


def read_python(text: str, lang: Language) -> Source:
    """A file with errors gives what stands outside of the statements around them."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree, said = _parsed(text)
    v = _Python(text)
    v.visit(tree)
    doc = ast.get_docstring(tree, clean=False)
    module = (doc.strip()[:LONGEST], "docstring") if doc and doc.strip() else _first_comment(v.lines, "#")
    refs = _may_resolve(list(v.found.values()), v.entities, v.bindings, lang.own)
    return Source(list(v.entities.values()), v.bindings, refs, module, said)


_BLANK = re.compile(r"//[^\n\r]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)
_WORD = r"[A-Za-z_$][\w$]*"
_DEFS = (
    ("function", re.compile(rf"(?:^|(?<=[\s;{{}}]))(?:(?:export|default|declare|async)\s+)*function\s*\*?\s*(?P<name>{_WORD})\s*(?:<[^>(]*>)?\s*\(")),
    ("class", re.compile(rf"(?:^|(?<=[\s;{{}}]))(?:(?:export|default|declare|abstract)\s+)*class\s+(?P<name>{_WORD})")),
    ("interface", re.compile(rf"(?:^|(?<=[\s;{{}}]))(?:(?:export|declare)\s+)*interface\s+(?P<name>{_WORD})")),
    ("type", re.compile(rf"(?:^|(?<=[\s;{{}}]))(?:(?:export|declare)\s+)*type\s+(?P<name>{_WORD})\s*(?:<[^=]*>)?\s*=")),
    ("enum", re.compile(rf"(?:^|(?<=[\s;{{}}]))(?:(?:export|declare|const)\s+)*enum\s+(?P<name>{_WORD})")),
    ("function", re.compile(rf"(?:^|(?<=[\s;{{}}]))(?:export\s+)?(?:const|let|var)\s+(?P<name>{_WORD})\s*(?::[^=;\n]+)?=\s*(?:async\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=;\n{{]+)?|{_WORD})\s*=>")),
    ("state", re.compile(rf"(?:^|(?<=[\s;{{}}]))(?:export\s+)?(?:const|let|var)\s+(?P<name>{_WORD})")),
)
_METHOD = re.compile(rf"(?:^|(?<=[\s;{{}}]))(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+)*\*?(?P<name>{_WORD})\??\s*(?:<[^>(]*>)?\s*\(")
_RESERVED = frozenset("if for while switch catch return function typeof await new super throw else do import constructor_ of in case delete void yield with const let var class interface type enum extends implements export default from as async this null true false undefined".split())
_IMPORT = re.compile(rf"""(?:^|(?<=[\s;]))import\s+(?:type\s+)?(?:(?P<default>{_WORD})\s*,?\s*)?(?:\{{(?P<names>[^}}]*)\}}|\*\s+as\s+(?P<all>{_WORD}))?\s*(?:from\s*)?["'](?P<module>[^"'\n]+)["']""")
_REEXPORT = re.compile(r"""(?:^|(?<=[\s;]))export\s+(?:type\s+)?(?:\{(?P<names>[^}]*)\}|(?P<star>\*)(?:\s+as\s+\w+)?)\s*from\s*["'](?P<module>[^"'\n]+)["']""")


def read_script(text: str, lang: Language) -> Source:
    """TypeScript and TSX: comments and strings are blanked, braces give spans, patterns give names."""
    hidden = _BLANK.sub(lambda m: re.sub(r"[^\n\r]", " ", m.group()), text)
    starts = [0, *(m.end() for m in BREAK.finditer(text))]
    lines = BREAK.split(text)
    line_of = lambda at: bisect.bisect_right(starts, at)
    ends: dict[int, int] = {}
    depth_at, stack = [], []
    for i, c in enumerate(hidden):
        if c == "{":
            stack.append(i)
        elif c == "}" and stack:
            ends[stack.pop()] = i
    for i in stack:
        ends[i] = len(text)
    opens = sorted(ends)

    closes = sorted(ends.values())

    def depth(at: int) -> int:
        return bisect.bisect_left(opens, at) - bisect.bisect_left(closes, at)

    spans: list[tuple[int, int, str, str]] = []  # start, end, name, kind
    claimed: set[int] = set()
    for kind, pattern in _DEFS:
        for m in pattern.finditer(hidden):
            at = m.start("name")
            if at in claimed or m["name"] in _RESERVED or (kind == "state" and depth(m.start("name"))):
                continue
            claimed.add(at)
            end = m.end()
            if kind not in ("state", "type"):
                close = hidden.find(";", m.end()) if kind == "function" else -1
                o = bisect.bisect_left(opens, m.end() - 1)
                # the body is the first brace group after the parameters
                while o < len(opens) and kind == "function" and hidden.count("(", m.end() - 1, opens[o]) > hidden.count(")", m.end() - 1, opens[o]):
                    o += 1
                if o < len(opens) and not (0 <= close < opens[o] and hidden[m.end() : opens[o]].count(")") > 0 and "=>" not in hidden[m.start() : m.end()] and ";" in hidden[m.end() : opens[o]]):
                    end = ends[opens[o]] + 1
                elif 0 <= close:
                    end = close
                if "=>" in m.group():
                    rest = re.compile(r"\s*\{").match(hidden, m.end())
                    end = ends[rest.end() - 1] + 1 if rest else (hidden.find("\n", m.end()) if hidden.find("\n", m.end()) >= 0 else len(text))
            spans.append((at if kind == "state" else m.start(), end, m["name"], kind))
    for s, e, _, kind in list(spans):
        if kind not in ("class", "interface", "enum"):
            continue
        body = bisect.bisect_left(opens, s)
        if body >= len(opens):
            continue
        inside = opens[body]
        if kind == "enum":
            for m in re.compile(rf"(?:^|[{{,])\s*(?P<name>{_WORD})\s*(?=[,=}}])").finditer(hidden, inside, e):
                spans.append((m.start("name"), m.end("name"), m["name"], "state"))
            continue
        for m in _METHOD.finditer(hidden, inside + 1, e):
            if m["name"] in _RESERVED or m.start("name") in claimed or depth(m.start("name")) != depth(inside) + 1:
                continue
            claimed.add(m.start("name"))
            o = bisect.bisect_left(opens, m.end())
            while o < len(opens) and hidden.count("(", m.end() - 1, opens[o]) > hidden.count(")", m.end() - 1, opens[o]):
                o += 1
            stop = hidden.find(";", m.end())
            end = ends[opens[o]] + 1 if o < len(opens) and opens[o] < e and not (0 <= stop < opens[o]) else (stop if 0 <= stop < e else m.end())
            spans.append((m.start(), end, m["name"], "method"))
    spans.sort(key=lambda x: (x[0], -x[1]))
    entities: dict[str, Entity] = {}
    placed: list[tuple[int, int, str]] = []
    above: list[tuple[int, str]] = []
    for s, e, name, kind in spans:
        while above and above[-1][0] <= s:
            above.pop()
        full = f"{above[-1][1]}.{name}" if above else name
        first = line_of(s + len(hidden[s:]) - len(hidden[s:].lstrip()))
        docs = [d] if (d := _comment_above(lines, first - 1, "//")) else []
        if full not in entities:
            entities[full] = _entity(full, kind, first, line_of(max(s, e - 1)), docs, text[s:e])
        if kind != "state":
            placed.append((s, e, full))
            above.append((e, full))

    bindings: list[Binding] = []
    covered: list[tuple[int, int]] = []
    for m in _IMPORT.finditer(text):
        if hidden[m.start() : m.start() + 6] != "import":
            continue
        covered.append(m.span())
        line = line_of(m.start())
        if m["default"] and m["default"] != "type":
            bindings.append(Binding(m["default"], m["module"], None, "path", False, line))
        if m["all"]:
            bindings.append(Binding(m["all"], m["module"], None, "path", False, line))
        for part in (m["names"] or "").split(","):
            names = part.replace("type ", "").split(" as ")
            if names[0].strip():
                bindings.append(Binding(names[-1].strip(), m["module"], names[0].strip(), "path", False, line))
        if not (m["default"] or m["all"] or m["names"]):
            bindings.append(Binding(m["module"], m["module"], None, "path", False, line))
    for m in _REEXPORT.finditer(text):
        if hidden[m.start() : m.start() + 6] != "export":
            continue
        covered.append(m.span())
        line = line_of(m.start())
        if m["star"]:
            bindings.append(Binding(None, m["module"], None, "path", True, line))
        for part in (m["names"] or "").split(","):
            names = part.split(" as ")
            if names[0].strip():
                bindings.append(Binding(names[-1].strip(), m["module"], names[0].strip(), "path", False, line))

    found: dict[tuple, Reference] = {}

    # spans nest: the innermost one around a place is the last that begins before it, or one that holds that one
    begins = [s for s, _, _ in placed]
    holder: list[int] = []
    inside: list[int] = []
    for k, (s, _, _) in enumerate(placed):
        while inside and placed[inside[-1]][1] <= s:
            inside.pop()
        holder.append(inside[-1] if inside else -1)
        inside.append(k)

    def within(at: int) -> str:
        k = bisect.bisect_right(begins, at) - 1
        while k >= 0 and placed[k][1] <= at:
            k = holder[k]
        return placed[k][2] if k >= 0 else MODULE

    def refer(rule: str, kind: str, target: str, at: int, only: tuple[str, ...] = (), unresolved: str = "external") -> None:
        if any(a <= at < b for a, b in covered):
            return
        src, line = within(at), line_of(at)
        found.setdefault((rule, src, kind, target, line), Reference(src, kind, target, line, "lexical", only, unresolved))

    contracts = ("interface", "class", "type", "enum")
    for m in re.finditer(rf"(?P<new>\bnew\s+)?(?<![\w$.])(?P<t>{_WORD}(?:\s*\.\s*{_WORD})*)\s*(?:<[\w\s,.\[\]|]*>)?\s*\(", hidden):
        target = re.sub(r"\s+", "", m["t"])
        before = hidden[max(0, m.start("t") - 12) : m.start("t")]
        if target in _RESERVED or m.start("t") in claimed or re.search(r"\bfunction\s*\*?\s*$", before):
            continue
        refer("new" if m["new"] else "calls", "calls", target, m.start("t"))
    for m in re.finditer(rf"\bclass\s+{_WORD}(?:<[^>{{]*>)?\s*(?:extends\s+(?P<base>{_WORD}(?:\.{_WORD})*))?[^{{]*?(?:implements\s+(?P<all>[^{{]+))?\{{", hidden):
        if m["base"]:
            refer("inherits", "inherits", m["base"], m.start("base"))
        for part in re.findall(_WORD, re.sub(r"<[^>]*>", "", m["all"] or "")):
            refer("implements", "implements", part, m.start("all"))
    for m in re.finditer(rf"(?<![\w$.])(?P<t>{_WORD}(?:\.{_WORD})*)", hidden):
        if m["t"] not in _RESERVED:
            refer("name", "reads", m["t"], m.start(), ("state",), "drop")
    for m in re.finditer(rf"(?<![\w$.])(?P<t>{_WORD}(?:\.{_WORD})*)\s*(?:[-+*/%&|^]|\?\?|&&|\|\||\*\*|<<|>>>?)?=(?![=>])", hidden):
        if m["t"] not in _RESERVED and m.start() not in claimed:
            refer("writes", "writes", m["t"], m.start(), ("state",), "drop")
    for m in re.finditer(rf"(?::\s*|<)(?P<t>{_WORD})", hidden):
        refer("types", "types", m["t"], m.start("t"), contracts, "drop")
    if lang.name == "tsx":
        for m in re.finditer(rf"<(?P<t>[A-Z][\w$]*(?:\.{_WORD})*)", hidden):
            refer("element", "calls", m["t"], m.start("t"), ("function", "class"), "drop")
    return Source(list(entities.values()), bindings, _may_resolve(list(found.values()), entities, bindings, lang.own), _first_comment(lines, "//"))


_YAML_KEY = re.compile(r"""^(\s*)(?:-\s+)*("[^"]*"|'[^']*'|[^\s#:\[\]{},&*!|>'"%@`][^#:]*?)\s*:(?:\s|$)""")


def read_yaml(text: str, lang: Language) -> Source:
    """Every mapping key is an entity, its dotted name shows where it is nested."""
    entities: dict[str, Entity] = {}
    stack: list[tuple[int, str]] = []
    block: int | None = None
    lines = BREAK.split(text)
    for i, line in enumerate(lines):
        indent = len(line) - len(line.lstrip())
        if block is not None:
            if not line.strip() or indent > block:
                continue
            block = None
        m = _YAML_KEY.match(line)
        if not m:
            continue
        at = m.start(2)
        while stack and stack[-1][0] >= at:
            stack.pop()
        key = m.group(2).strip("\"'")
        name = f"{stack[-1][1]}.{key}" if stack else key
        stack.append((at, name))
        if re.search(r":\s*[|>][-+\d]*\s*$", line):
            block = indent
        if name not in entities:
            entities[name] = Entity(name, "key", i + 1, i + 1, line.strip()[:LONGEST], "none", stack[-2][1] if len(stack) > 1 else MODULE)
    return Source(list(entities.values()), [], [], ("", "none"))


def read_rules(text: str, lang: Language) -> Source:
    """Entities and references by a language's own patterns."""
    starts = [0, *(m.end() for m in BREAK.finditer(text))]
    line_of = lambda at: bisect.bisect_right(starts, at)
    entities: dict[str, Entity] = {}
    for rule in lang.entities:
        for m in re.finditer(rule.pattern, text):
            name = ".".join(v for k, v in sorted(m.groupdict().items()) if k.startswith("name") and v)
            if name and name not in entities:
                entities[name] = Entity(name, rule.kind, line_of(m.start("name")), line_of(m.end()), text[m.start() : m.start() + LONGEST].strip(), "none", MODULE)
    found: dict[tuple, Reference] = {}
    for k, rule in enumerate(lang.references):
        for m in re.finditer(rule.pattern, text):
            target, line = m["target"].strip(), line_of(m.start("target"))
            if target:
                found.setdefault((k, target, line), Reference(MODULE, rule.kind, target, line, rule.resolve, rule.only, rule.unresolved))
    return Source(list(entities.values()), [], list(found.values()), ("", "none"))


READERS = {"python": read_python, "script": read_script, "yaml": read_yaml, "rules": read_rules}


def read(text: str, lang: Language) -> Source:
    """What one file holds; raises what the reader raises on a file it can't read."""
    return READERS[lang.reader](text, lang)
