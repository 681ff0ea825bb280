"""Handwritten sources, syntax repair and documentation pairs."""

import itertools

import pytest

import valid_sources
from spandrel.llm import handwritten as H
from spandrel.llm import syntax as S
from spandrel.llm.chart import Grammar
from spandrel.llm.docpairs import documented_functions, says_something

HAND = "import os\n\n\ndef a_function(values):\n    total = 0\n    for value in values:\n        total += value * 3\n    return total\n"


@pytest.mark.parametrize(
    "path, text, want",
    [
        ("r/a.py", HAND, None),
        ("r/a.py", "# Code generated by toolx 1.2; DO NOT EDIT.\n" + HAND, "generated"),
        ("r/a.py", '"""toolx wrote this module from a.spec; edit the spec and run it again."""\n' + HAND, "generated"),
        ("r/a.ts", "const a = 1;\n// end of output written by toolx on 2024-01-02\n", "generated"),
        ("r/a.py", HAND + "# ids are generated by the store, do not edit them by hand\n", None),
        ("r/a.py", 'BANNER = "# Code generated by toolx; DO NOT EDIT."\n' + HAND, None),
        ("r/a.py", "\n".join(f"def get_x_{i:04}(m):\n    return m.s[{i}]\n" for i in range(20)), "generated"),
        ("r/a.js", "function f(a){return a.b?a.b:1}" * 60, "minified"),
        ("r/a.js", "function f(a) {\n  return a.b ? a.b : 1;\n}\n" * 60, None),
        ("r/a.py", HAND * 4 + "WEIGHTS = [" + ", ".join(map(str, range(100, 160))) + "]\n", None),
        ("r/a.py", "T = (\n" + "    0x7a, 0x7f, 0xab, 0x22, 0x60, 0xc5, 0x6a, 0x14,\n" * 40 + ")\n", "data"),
        ("r/a.yml", "x: |\n" + "  8CsdKqN38sdkfjQ0sdf98sdfkjQWERsdfkjlwefsd0fjklwefjsdklfjwefkjsdlfkjwef\n" * 20, "data"),
        ("r/node_modules/pkg/a.py", HAND, "vendored"),
        ("r/vendors/a.py", HAND, None),
        ("r/a.js", "function f(a){return a.b?a.b:1};var x=f(3);for(var i=0;i<9;i++)x[i]=f(i);export{x};" * 2, "minified"),  # short and minified
        ("r/a.ts", "\n".join(f"export function getX{i:04}(m) {{\n  return m.s[{i}];\n}}" for i in range(20)), "generated"),
        ("r/a_pb2.py", HAND, "generated"), ("r/a.g.ts", "const a = 1;\n", "generated"), ("r/generated_reports/a.py", HAND, None), ("r/pb2.py", HAND, None),
        ("r/a.py", "# toolx output, source: a.spec\n" + HAND, "generated"), ("r/a.py", HAND + "# toolx: 12 rows written, 0 kept by hand\n", "generated"), ("r/a.py", "# Machine written from rows, changes will be overwritten.\n" + HAND, "generated"),
        ("r/a.py", "# Not safe while another row is being written.\n" + HAND, None), ("r/a.py", "# Generate the row in place, and report how many were touched.\n" + HAND, None), ("r/a.py", "# Rows are written by the loader, do not change them by hand.\n" + HAND, None),
        ("r/a.py", HAND * 2 + "# Code generated by toolx 1.2; DO NOT EDIT, says the other file.\n" + HAND * 2, None),  # a mention in the middle
        ("r/a.py", "import b\n" + "12:01:33 [info] " + "words and more words of a log that goes on " * 3 + "\n", None),
        ("r/x.py", "", None),
    ],
)
def test_verdicts(path, text, want):
    assert H.verdict(path, text) == want


def test_not_handwritten_over_tables(spark):
    lines = [f"def upstream_{w}(value, other_{w}):\n    return value + other_{w} * {i}\n" for i, w in enumerate("abcdefghijklmnopqrst")]
    copy = "# local\n" + "\n".join(lines).replace("value + other_d", "value - other_d")
    files = spark.createDataFrame([("r/a.py", HAND, "x"), ("r/c.py", copy, "x"), ("r/c.py", copy, "x"), ("r/n.py", None, "x"), (None, copy, "x"), ("r/meta.py", HAND, "x")], "path string, content string, why string")
    ents = spark.createDataFrame([("r/meta.py", "<module>", "toolx wrote this module from m.spec; edit the spec"), ("r/a.py", "f", "Code generated by x"), ("r/a.py", "<module>", None)], "path string, name string, meta string")
    up = spark.createDataFrame([("p", "1", "p/u.py", "\n".join(lines)), ("q", "1", "q/u.py", None)], "package_name string, release_tag string, path string, content string")
    got = {r.path: r.why for r in H.not_handwritten(files, ents, up).collect()}
    assert got == {"r/c.py": "vendored", "r/meta.py": "generated"}
    assert {r.path for r in H.not_handwritten(files, ents.limit(0), up.limit(0)).collect()} == set()
    assert H.not_handwritten(files.limit(0), ents, up).count() == 0
    notes = ["Machine-made from m.spec", "automatically created", "Rendered by toolx 2.1", "Written from a.spec; changes will be overwritten", "machine written", "Counts rows by day."]
    many = spark.createDataFrame([(f"r/m{i}.py", HAND) for i in range(len(notes))], "path string, content string")
    said = spark.createDataFrame([(f"r/m{i}.py", "<module>", n) for i, n in enumerate(notes)], "path string, name string, meta string")
    assert {r.path for r in H.not_handwritten(many, said, up).collect()} == {f"r/m{i}.py" for i in range(len(notes) - 1)}


def test_copies_of_any_size(spark):
    licence = "\n".join(f"licence line {w} that every package holds" for w in "abcdefghijklmnopqrstuvwxyz")
    body = lambda k: "\n".join(f"{k}{i} = {i}" for i in range(12))
    up = spark.createDataFrame([(f"p{k}", v, f"p{k}/u.py", f"{licence}\n{body(chr(97 + k))}\n" if k else "x = 1\ny = 2\nw = 5\n") for k in range(9) for v in ("1", "2", "3")], "package_name string, release_tag string, path string, content string")
    rows = [("r/tiny.py", "x = 1\n\n  y = 2\r\nw  = 5"), ("r/near.py", "x = 1\ny = 3\nz = 4\n"), ("r/licence.py", licence + "\n" + HAND), ("r/copy.py", body("c")), ("r/half.py", body("d").replace("= 1", "= 7")), ("r/few.py", "\n".join(body("e").split("\n")[:3]) + "\n" + HAND)]
    got = {r.path for r in H.not_handwritten(spark.createDataFrame(rows, "path string, content string"), spark.createDataFrame([], "path string, name string, meta string"), up).collect()}
    assert got == {"r/tiny.py", "r/copy.py", "r/half.py"}


def test_chart_finds_the_least_repair():
    g = Grammar("Su -> () | Pr Su\nPr -> ( Su ) | [ Su ] | a", "Su")
    sentences = {""}
    for _ in range(3):
        sentences |= {x + y for x in sentences for y in ("a", *(f"({s})" for s in list(sentences)[:40]), *(f"[{s}]" for s in list(sentences)[:40])) if len(x + y) <= 5}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    legal = {s for n in range(6) for s in map("".join, itertools.product("()[]a", repeat=n)) if ok(s)}
    for text in map("".join, itertools.product("()[]a", repeat=4)):
        best = min(distance(text, s) for s in legal)
        assert g.repair(text, 3)[0] == min(best, 4), text
    assert g.repair("(a", 3)[0] == 1 and g.repair("(a)", 3) == (0, ())


def test_chart_finds_the_least_repair_with_errors_at_both_ends():
    g = S._GRAMMARS["hcl", "P"]
    assert g.repair(",diuc", 6)[0] == 2  # udiu
    assert S._GRAMMARS["docker", "line"].repair("wojg", 6)[0] == 2
    assert g.repair("i" * 40, 2)[0] == 3 and g.repair("i" * 9)[0] == 4


@pytest.mark.parametrize("n", [0, 1, 5, 11, 12, 13, 30, 60, 200, 500])
def test_costs_do_not_depend_on_length(n):
    cost = lambda text, path="a.ts": S.check(path, text).cost
    more, items = " + a" * n, ", a" * n
    assert [cost(f"x = = 1{more}\n"), cost(f"x = = 1{more} + = b\n"), cost(f"x = = 1 + = b + = c{more}\n")] == [1, 2, 3]
    assert cost(f"f(a,, b{items});\n") == 1 and cost(f"f(a b{items}, c d);\n") == 2 and cost(f"f(a{items}, b, c);\n") == 0
    assert cost(f"[a b, c d, e f{items}];\n") == 3 and cost(f"[a,, b{items}];\n") == 0
    assert cost("f();\n" * n + "a = ;\n" + "f();\n" * n) == 1
    assert cost(f"f(a b{items})\n", "a.py") == 1
    assert cost("x = {\n  k = 1\n" + "  a = 2\n" * n + "  b = = 3\n}\n", "a.tf") == cost("x = {\n  k = 1\n  b = = 3\n}\n", "a.tf")


def test_shortened_lists_cost_what_whole_ones_do():
    for kind, wrong in itertools.product(("", "C", "P", "B"), ("", "io", "ii", "Rn", "gi", "o", "i;")):
        for at in (0, 1, 9, 18):
            row = ["i", "iP", "ion"] * 6
            row.insert(at, wrong)
            piece = ",".join(row)
            assert sum(c for _, c in S._repairs("script", kind, piece)) == S._GRAMMARS["script", kind].repair(piece, S.MOST)[0], (kind, piece)


def ok(text):
    while True:
        less = text.replace("a", "").replace("()", "").replace("[]", "")
        if less == text:
            return not text
        text = less


VALID = {
    "a.py": ["", "x = 1\n", HAND, "def f():\n    return {'a': [1, 2]}\n", "async def g():\n    await h()\n"],
    "a.ts": [
        "", "export function f(a: any, b?: string): any {\n  const x: any[] = [];\n  if (!a) return 1;\n  for (const i of a) {\n    x.push(i.b * 3);\n  }\n  return x;\n}\n",
        "export class A extends B implements C {\n  private x: number = 1;\n  m(a: any): any {\n    return String(a).split(\"{\")[0] ?? /[/]x/g;\n  }\n}\nexport interface I {\n  a: string;\n  b?: number;\n}\nexport type K = \"a\" | \"b\";\n",
        "import { a, b as c } from \"./x\";\nimport d, * as e from './y';\nexport * from \"./z\";\nexport default { a: 1, ...d, f() { return 2; } };\nconst g = async (x: number): Promise<void> => { await h(x); };\n",
        "switch (a) {\n  case 1:\n    b();\n    break;\n  default:\n    c();\n}\ntry { a(); } catch (e) { b(); } finally { c(); }\nlet namespace = 1; namespace += 2;\nconst t = `a ${b} ${`c`}`;\n",
    ],
    "a.js": ["!function(d){d.x=7}(u);function a(r){return r.s?r.s:1}var b=v=>v*4;if(k&&v){k.p(v,4)}for(var b=0;b<9;b++)u[b]=\"s\";", '"use strict";\n\nfunction f(a) {\n  if (!a) return 95;\n  return a.w + "p";\n}\n'],
    "a.tsx": ['import { R } from "./r";\nexport function F(a: any) {\n  return (\n    <div className="x">\n      <span>some text</span>\n      <R value={27} />\n    </div>\n  );\n}\n'],
    "a.yml": ["a: 1\nb:\n  - x\n  - y: 2\n    z: [1, 2]\nc: |\n  any: text [\n  more\nd: \"q: r\"\n# end\n", "- a\n- b:\n    c: d\n", "a:\n  b: >\n    folded\n  c: 'it''s'\n"],
    "a.tf": ['variable "A" {\n  default = "x"\n  tags = {\n    k = "1"\n  }\n}\n\nresource "r" "n" {\n  count = 2\n  l = [1, 2]\n}\noutput "o" {\n  value = var.A\n}\n'],
    "Dockerfile": ['FROM base:1 AS b\nWORKDIR /x\nENV A=1\nCOPY a b ./c/\nRUN mkdir -p /v && \\\n    touch /w\nCMD ["python", "a.py"]\n'],
    "a.html": ['<!doctype html>\n<html>\n<head>\n  <title>t</title>\n  <script src="./a.ts"></script>\n</head>\n<body>\n  <section id="s">\n    <p>Text, and more.</p>\n    <br>\n  </section>\n</body>\n</html>\n'],
}
CORPUS = [(path, text) for name, path in (("TS", "a.ts"), ("TSX", "a.tsx"), ("HCL", "a.tf"), ("YAML", "a.yml"), ("DOCKER", "Dockerfile"), ("HTML", "a.html"), ("PY", "a.py")) for text in getattr(valid_sources, name).strip("\n").split("\n===\n")]
BROKEN = {
    "a.py": [("def f(a:\n    return 1\n", "local"), ("<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n", "conflict"), ("def f():\n", "truncation"), ('x = """no end\n', None), ("<!doctype html>\n<html>\n<body>\n</body>\n</html>\n", "mismatch"), ("if x:\n        a = 1\n   b = 2\n", None)],
    "a.ts": [("export function f() {\n  return (1;\n}\n", None), ("export function f() {\n  return 1;\n", "truncation"), ("function f() {\n<<<<<<< a\n  x();\n}\n", "conflict"), ("import json\n\ndef f(a):\n    return a\n", None), ("const a = `no end\n", None), ("11:14:43 [warn] We debug the bitmap now.\n13:24:45 [info] Please move it.\n", None), ("const a = ;\n", None), ("f(a b);\n", None)],
    "a.js": [("function f(a) {\n  return a +;\n}\n", None), ("if (a {\n}\n", None)],
    "a.tsx": [("export function F() {\n  return (\n    <div>\n      <span>x</div>\n  );\n}\n", None)],
    "a.yml": [("a: [1, 2\nb: 3\n", None), ("a:\n\tb: 1\n", None), ('a: 1\n"b: no end\n', None), ("<<<<<<< x\na: 1\n>>>>>>> y\n", "conflict"), ("a: 1\n  b: 2\n", None), ("def f(x):\n    total: [\n  return x}\n", None)],
    "a.tf": [('variable "A" {\n  default = "x\n}\n', None), ('variable "A" {\n', "truncation"), ("import os\nx = 1\n", None), ("a = {\n", None)],
    "Dockerfile": [("FROM a\nCOPIED x y\n", None), ("RUN x\n", None), ('FROM a\nCMD ["python", \n', None), ("FROM a\nRUN x && \\\n", None), ("FROM a\n=======\nRUN x\n", "conflict")],
    "a.html": [("<html><body><p>x</p>\n>>>>>>> b\n</body></html>\n", "conflict"), ("<html><body><div></body></html>\n", None), ("import os\nx = 1\n", None), ("<html><body></section></body></html>", None)],
}


@pytest.mark.parametrize("path, text", [(p, t) for p, ts in VALID.items() for t in ts])
def test_valid_sources_cost_nothing(path, text):
    assert S.check(path, text) == (0, (), None)
    assert S.check(path, text.replace("\n", "\r\n")).cost == 0


@pytest.mark.parametrize("path", sorted({p for p, _ in CORPUS}))
def test_valid_corpus_costs_nothing_and_a_lost_bracket_something(path):
    for text in (t for p, t in CORPUS if p == path):
        assert S.check(path, text).cost == 0, text
        for at in [i for i, c in enumerate(text) if c in "()[]{}"][:6]:
            if path in ("a.ts", "a.tf") and not set("'\"`/<") & set(text):  # a bracket in a string, a pattern or a type is text
                assert S.check(path, text[:at] + text[at + 1 :]).cost, (text, at)


def test_long_and_deep_sources():
    assert S.check("a.ts", "const a = [" + "1, -2, f(3), " * 4000 + "];\n").cost == 0
    assert S.check("a.ts", "const a = [" + "1, -2, f(3), " * 4000 + "4 5];\n").cost > 0
    assert S.check("a.tf", "# " + "x" * 9000 + ' "{\nvariable "a" {\n}\n').cost == 0
    assert S.check("a.py", "x = " + "(" * 3000 + ")" * 3000 + "\n").cost == 0  # beyond the parser: no case
    assert S.check("a.py", "f(" + "a, " * 300 + "b c)\n").cost > 0
    many = S.check("a.py", "\n".join("x = = 1" for _ in range(90)) + "\n")
    assert many.cost >= 90 and len(many.lines) == 90 and many.why == "mismatch"
    assert S.check("a.ts", "f();\n" * 30 + ">>>>>>> b\n" + "g(;\n" * 1).why == "conflict"
    assert S.check("a.ts", "/*\n=======\n*/\n" + "f();\n" * 30 + "g(a b);\n" + "f();\n" * 30).why == "local"  # marks in a comment


@pytest.mark.parametrize("path, text, why", [(p, t, w) for p, ts in BROKEN.items() for t, w in ts])
def test_broken_sources_cost_something(path, text, why):
    got = S.check(path, text)
    assert got.cost > 0 and got.lines and (why is None or got.why == why), got


@pytest.mark.parametrize(
    "path, text, broken",
    [
        ("a.tsx", "<p>{format(total}</p>", True), ("a.tsx", "<Row value={a +} />", True), ("a.tsx", "<Row value={} />", True), ("a.tsx", "<Row {a} />", True), ("a.tsx", "<Row b={...a} />", True),
        ("a.tsx", "<p>{a b}</p>", True), ("a.tsx", "<p>{xs.map((v) => { return <li>{v.}</li>; })}</p>", True), ("a.tsx", "<p>{`${f(}`}</p>", True), ("a.tsx", "<p>{if (a) { b(); }}</p>", True), ("a.tsx", "<p>{a</p>", True),
        ("a.ts", "`${f(}`", True), ("a.ts", "`a ${} b`", True), ("a.ts", "`${`${a +}`}`", True), ("a.ts", "`${a; b}`", True), ("a.js", "`${[1, 2}`", True), ("a.ts", "`${a", True), ("a.ts", "`${() => { f( }}`", True),
        ("a.tsx", "<p>{format(total)}</p>", False), ("a.tsx", "<Row value={a + 1} {...rest} {/* c */ ...b} on={() => { go(1); }} style={{ a: 1, \"b\": `}` }} />", False), ("a.tsx", "<p>{}{/* note } */}{\" \"}{...a}</p>", False),
        ("a.tsx", "<ul>\n  {xs\n    .filter((v) => v.ok && v.n > 1)\n    .map((v) => (\n      <li key={`k-${v.id}`}>{v.on ? <b>{v.name}</b> : null} it's</li>\n    ))}\n</ul>", False),
        ("a.tsx", "<>{a?.b ?? c[0]}{d as any}{e!}{f! && <G h='}' />} // no note </>", False), ("a.tsx", "<T a={function () { if (x) { return /[}]/.test(y); } return z; }} />", False),
        ("a.ts", "`${f(\"}\")} and ${a ? `${b}` : \"`\"} \\${ $ { ${x => { return { a: 1 }; }}`", False), ("a.ts", "`${\n  a +\n  b // note }\n}`", False), ("a.js", "tag`a ${b, c}`", False), ("a.ts", "`${e!}`", False),
    ],
)
def test_containers_are_levels_of_their_own(path, text, broken):
    text = f"import {{ x }} from \"./x\";\nexport function f(a) {{\n  return (\n{text}\n  );\n}}\n"
    got = S.check(path, text)
    assert (got.cost > 0) is broken and S.check(path, text.replace("\n", "\r\n")).cost == got.cost, got


def test_deep_and_broken_containers_take_bounded_work():
    assert S.check("a.ts", "const a = " + "`${" * 1500 + "b" + "}`" * 1500 + ";\n").cost == 0
    assert S.check("a.ts", "const a = " + "`${" * 5000 + "b" + "}`" * 5000 + ";\n").cost > 0
    assert S.check("a.tsx", "const a = " + "<p>{" * 300 + "b" + "}</p>" * 299 + ";\n").cost > 0


def test_unparsable_over_tables(spark):
    rows = [("r/a.py", "r", "x = 1\n"), ("r/b.py", "r", "def f(:\n"), ("r/b.py", "r", "def f(:\n"), ("r/c.py", None, "x ="), ("r/n.py", "r", None), (None, "r", "x ="), ("r/e.py", "r", "  \n"), ("r/z.txt", "r", "((("), ("r/long.js", "r", "f(" * 5000)]
    files = spark.createDataFrame([(*r, "clash", 1) for r in rows], "path string, repo string, content string, why string, cost int")
    assert {r.path for r in S.unparsable(files).collect()} == {"r/b.py", "r/c.py", "r/long.js"}
    rates = {(r.repo, r.language): (r.files, r.broken) for r in S.error_rates(files).collect()}
    assert rates == {("r", "python"): (3, 1), (None, "python"): (1, 1), ("r", "js"): (1, 1)}
    assert S.unparsable(files.limit(0)).count() == 0


@pytest.mark.parametrize(
    "doc, name, params, want",
    [
        ("Newest match first, penalty last.", "store_goalkeeper", (), True), ("O(n) over all pages of the ledger.", "attach", (), True), ("None once the bond is closed.", "collect_bond_window", (), True),
        ("TODO: describe", "f", (), False), ("T.B.D. - fill in", "f", (), False), ("_summary_", "f", (), False), ("n/a", "f", (), False), ("See above.", "f", (), False), ("Documentation missing.", "f", (), False),
        ("Fetch liquidity argument.", "fetch_liquidity_argument", (), False), ("The scoreMarathon function.", "scoreMarathon", (), False), ("Choreographpoem.", "choreographPoem", (), False),
        ("Merge stadium\n\n:param paddock: the paddock\n:return: the result", "merge_stadium", ("paddock",), False), ("@param rows:\n@returns", "x", ("rows",), False),
        ("Blocks until the lock is free.\n\n@param ward the ward", "admit", ("ward",), True), ("===== models =====", "f", (), False), ("(c) 2015 the ember team", "f", (), False), ("SPDX: private", "f", (), False),
        ("noqa: E256", "f", (), False), ("if caller > 12: return jobs", "f", (), False), ("payload = payload + 4", "f", (), False), ("print(key, models)", "f", (), False), ("-", "f", (), False), ("", "f", (), False),
        ("This is the function load_key. It takes rows and returns a value.", "load_key", ("rows",), False), ("This docstring still has to be written, please add a\n  description of the function here.", "f", (), False),
    ],
)
def test_what_documentation_says(doc, name, params, want):
    assert says_something(doc, name, params) is want


def test_documented_functions(spark):
    py = 'class A:\n    """Holds things."""\n    # Counts open orders by day.\n    def m(self):\n        return 1\n\n    def n(self, x):\n        """TODO"""\n\n\ndef f(a):\n    \'\'\'Drops rows without a key.\'\'\'\n\n\ndef g():\n    return 1\n\n\ndef gone():\n    """Was removed long before."""\n'
    ts = "/** Picks the cheapest offer. */\nexport function pick(a: string): void;\nexport function pick(b: number, c: number): void;\nexport function pick(b: any, c?: any): void {\n  return;\n}\n\nexport interface I {\n  /** Blocks until the printer is ready. */\n  wait(): void;\n}\n"
    stub = "def g():\n    \"\"\"Looks up the oldest invoice.\"\"\"\n    ...\n"
    files = spark.createDataFrame([("r/a.py", py), ("r/a.py", py), ("r/b.ts", ts), ("r/a.pyi", stub), ("r/null.py", None), ("r/broken.py", "def h(:\n    pass\n\ndef k():\n    'Sorts all late rows.'\n"), (None, py)], "path string, content string")
    ent = [("r/a.py", "A.m", "method", None, None, None), ("r/a.py", "A.n", "method", "TODO", "docstring", None), ("r/a.py", "f", "function", None, "none", None), ("r/a.py", "g", "function", None, None, None), ("r/a.py", "gone", "function", None, None, "x"), ("r/b.ts", "pick", "function", None, None, None), ("r/b.ts", "I.wait", "method", None, None, None), ("r/null.py", "q", "function", "Rounds the tax of one order.", None, None), ("r/null.py", "s", "function", "def s():\n    return 1", None, None), ("r/broken.py", "k", "function", "", "x", None), ("r/a.py", "A", "class", "Holds things.", "docstring", None)]
    entities = spark.createDataFrame([(*e[:5], None if e[5] is None else __import__("datetime").datetime(2024, 1, 1), "clash") for e in ent] * 2, "path string, name string, kind string, meta string, doc_kind string, removed_at timestamp, doc string")
    got = {(r.path, r.name): (r.kind, r.doc) for r in documented_functions(files, entities).collect()}
    assert got.keys() == {("r/a.py", "A.m"), ("r/a.py", "f"), ("r/a.py", "g"), ("r/b.ts", "pick"), ("r/b.ts", "I.wait"), ("r/null.py", "q"), ("r/broken.py", "k")}
    assert got["r/a.py", "g"][1] == "Looks up the oldest invoice." and got["r/a.py", "A.m"] == ("leading", "Counts open orders by day.") and got["r/b.ts", "pick"][0] == "jsdoc"
    assert documented_functions(files.limit(0), entities).count() == 0 and documented_functions(files, entities.limit(0)).count() == 0
