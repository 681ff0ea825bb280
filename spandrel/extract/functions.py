"""Functions and methods of source files with the comments that belong to them; tolerant of broken files."""

from __future__ import annotations

import re
from typing import NamedTuple

BREAK = re.compile(r"\r\n|\n|\r")


class Function(NamedTuple):
    name: str  # dotted
    line: int  # from 1
    params: tuple[str, ...]
    docs: tuple[tuple[str, str], ...]  # (kind, text): docstring, jsdoc, leading
    has_body: bool  # False for a declaration


_PY = re.compile(r"([ \t]*)(async[ \t]+def|def|class)[ \t]+(\w+)")
_PY_DOC = re.compile(r"""\s*(?:\#[^\n]*\n\s*)*[rRuU]?(?:\"\"\"(.*?)(?:\"\"\"|\Z)|'''(.*?)(?:'''|\Z)|"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)')""", re.S)
_PARAM = re.compile(r"^\s*(?:\.\.\.|\*{0,2})(?:(?:public|private|protected|readonly)\s+)*([A-Za-z_$][\w$]*)")
_TS_FUNCTION = re.compile(r"([ \t]*)(?:(?:export|default|declare|async)\s+)*function\s*\*?\s*([A-Za-z_$][\w$]*)\s*(?:<[^>(]*>)?\s*\(")
_TS_ARROW = re.compile(r"([ \t]*)(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b[^(]*)?\(")
_TS_CLASS = re.compile(r"([ \t]*)(?:(?:export|default|declare|abstract)\s+)*(class|interface|namespace)\s+([A-Za-z_$][\w$]*)")
_TS_METHOD = re.compile(r"([ \t]+)(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+)*\*?([A-Za-z_$#][\w$]*)\??\s*(?:<[^>(]*>)?\s*\(")
_NOT_METHODS = frozenset("if for while switch catch return function typeof await new super throw else do import emit".split())


def closing(text: str, at: int) -> int:
    """Index after the bracket that closes the one at ``at``; strings are skipped; -1 if none does."""
    depth, i, n = 0, at, len(text)
    while i < n:
        c = text[i]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                return i + 1
        elif c in "\"'`":
            i += 1
            while i < n and text[i] != c and (c == "`" or text[i] != "\n"):
                i += 2 if text[i] == "\\" else 1
        i += 1
    return -1


def _params(inside: str) -> tuple[str, ...]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(inside + ","):
        if c in "([{<":
            depth += 1
        elif c in ")]}>" and inside[i - 1 : i + 1] != "=>":
            depth -= 1
        elif c == "," and depth <= 0:
            if m := _PARAM.match(inside[start:i]):
                out.append(m.group(1))
            start = i + 1
    return tuple(p for p in out if p not in ("self", "cls", "this"))


def _above(lines: list[str], at: int, mark: str, skip: str) -> tuple[str, str] | None:
    """The comment that ends directly above line ``at`` (from 0); decorators may stand between."""
    i = at - 1
    while i >= 0 and lines[i].lstrip().startswith("@"):
        i -= 1
    if i < 0:
        return None
    last = lines[i].strip()
    if mark == "//" and last.endswith("*/"):
        j = i
        while j >= 0 and "/*" not in lines[j]:
            j -= 1
        if j < 0 or not lines[j].lstrip().startswith("/*"):
            return None
        body = "\n".join(x.strip() for x in lines[j : i + 1])
        kind = "jsdoc" if body.startswith("/**") else "leading"
        inner = re.sub(r"^/\*+|\*+/$", "", body)
        return kind, "\n".join(re.sub(r"^\s*\*+ ?", "", x) if k else x for k, x in enumerate(inner.split("\n"))).strip()
    j = i
    while j >= 0 and lines[j].lstrip().startswith(mark):
        j -= 1
    if j == i:
        return None
    return "leading", "\n".join(x.strip()[len(mark) :].lstrip(skip).strip() for x in lines[j + 1 : i + 1]).strip()


def _starts(text: str) -> tuple[list[str], list[int]]:
    lines, starts, at = [], [], 0
    for m in BREAK.finditer(text):
        lines.append(text[at : m.start()])
        starts.append(at)
        at = m.end()
    lines.append(text[at:])
    starts.append(at)
    return lines, starts


def python_functions(text: str) -> list[Function]:
    lines, starts = _starts(text)
    out: list[Function] = []
    stack: list[tuple[int, str]] = []
    for i, line in enumerate(lines):
        m = _PY.match(line)
        if not m:
            continue
        indent = len(m.group(1).expandtabs())
        while stack and stack[-1][0] >= indent:
            stack.pop()
        name = ".".join([*(n for _, n in stack), m.group(3)])
        stack.append((indent, m.group(3)))
        if m.group(2) == "class":
            continue
        open_at = starts[i] + m.end()
        params, docs, body = (), [], True
        if text[open_at : open_at + 1] == "(" and (end := closing(text, open_at)) > 0:
            params = _params(text[open_at + 1 : end - 1])
            colon = re.compile(r"\s*(?:->[^\n]*?)?:(?=[ \t]*(?:#|\n|\r|\Z|\.|\S))").match(text, end)
            if colon:
                if d := _PY_DOC.match(text, colon.end()):
                    docs.append(("docstring", next(g for g in d.groups() if g is not None)))
                body = not re.compile(r"\s*\.\.\.\s*(?:\n|\r|\Z)").match(text, d.end() if d else colon.end())
        if (above := _above(lines, i, "#", "#!")) is not None:
            docs.append(above)
        out.append(Function(name, i + 1, params, tuple(docs), body))
    return out


def typescript_functions(text: str) -> list[Function]:
    lines, starts = _starts(text)
    out: list[Function] = []
    stack: list[tuple[int, str]] = []
    comment = False
    for i, line in enumerate(lines):
        bare = line.lstrip()
        if comment or bare.startswith("/*"):
            comment = "*/" not in bare
            continue
        if not bare or bare.startswith("//"):
            continue
        indent = len(line) - len(bare)
        while stack and indent <= stack[-1][0]:
            stack.pop()
        if m := _TS_CLASS.match(line):
            stack.append((indent, m.group(3)))
            continue
        m = _TS_FUNCTION.match(line) or _TS_ARROW.match(line)
        if not m and stack and (m := _TS_METHOD.match(line)) and m.group(2) in _NOT_METHODS:
            m = None
        if not m:
            continue
        open_at = starts[i] + m.end() - 1
        end = closing(text, open_at)
        params = _params(text[open_at + 1 : end - 1]) if end > 0 else ()
        rest = text[end : text.find("\n", end) if text.find("\n", end) >= 0 else len(text)] if end > 0 else ""
        body = "{" in rest or "=>" in rest
        if m.re is _TS_METHOD and end > 0 and not body and not rest.rstrip().endswith(";"):
            continue  # a call
        above = _above(lines, i, "//", "/!")
        out.append(Function(".".join([*(n for _, n in stack), m.group(2)]), i + 1, params, (above,) if above else (), body))
        if body:
            stack.append((indent, m.group(2)))
    return out


def functions(path: str, text: str) -> list[Function]:
    """Functions of a file by its name; none for other languages."""
    low = path.lower()
    if low.endswith((".py", ".pyi")):
        return python_functions(text)
    if low.endswith((".ts", ".tsx")):
        return typescript_functions(text)
    return []
