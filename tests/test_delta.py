"""Diffs: parsing, applying, moved hunks, and what a change touches and endangers."""

import difflib
import random
import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spandrel.extract import patches as P
from spandrel.operators import delta as D
from spandrel.operators.extraction import extract
from spandrel.operators.resolve import resolve

BASE = {
    "gauge.py": "def rainfall(drops):\n    return max(drops)\n\ndef listing(drops):\n    return sorted(drops)\n\ndef dewpoint(drops):\n    return drops[0]\n",
    "forecast.py": "from gauge import rainfall, dewpoint\n\ndef predict(week):\n    return rainfall(week)\n\ndef verify(week):\n    return dewpoint(week)\n",
    "bulletin.py": "from forecast import predict\n\ndef announce(week):\n    return predict(week)\n",
    "coast.py": "import gauge\n\ndef tide(week):\n    return gauge.rainfall(week)\n",
    "ridge.py": "from gauge import rainfall as wet\n\ndef snow(week):\n    return wet(week)\n",
}
HEAD = {**BASE, "gauge.py": "def rainfall(drops):\n    return max(drops) + 1\n\ndef listing(drops):\n    return sorted(drops)\n\ndef gusts(drops):\n    return drops[-1]\n"}


def diff_of(old: str, new: str, path: str, n: int = 3) -> str:
    body = "\n".join(difflib.unified_diff(old.split("\n"), new.split("\n"), f"a/{path}", f"b/{path}", n=n, lineterm=""))
    return f"diff --git a/{path} b/{path}\n{body}\n" if body else ""


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "", "-- x", "++ y", "--- a/x", "@@ -1 +1 @@"]), max_size=25), st.integers(0, 10**6), st.sampled_from([0, 1, 3, 5]))
def test_applying_a_diff_gives_the_other_side(old, seed, context):
    rng = random.Random(seed)
    new = [x for x in old if rng.random() > 0.2]
    for _ in range(rng.randrange(4)):
        new.insert(rng.randrange(len(new) + 1), rng.choice(["c", "d", "--- z"]))
    a, b = "\n".join(old), "\n".join(new)
    for d in P.parse(diff_of(a, b, "f.txt", context)):
        if context:  # without context a repeated line may stand in several places
            assert P.apply(a, d) == b and P.unapply(b, d) == a
        removed, added, _ = P.changed(d)
        assert len(added) - len(removed) == b.count("\n") - a.count("\n")


def test_hunks_move_renames_and_misfits():
    old = "\n".join(f"line {i}" for i in range(50))
    d = P.parse(diff_of(old, old.replace("line 30", "LINE"), "f"))[0]
    assert P.apply("\n".join(["new"] * 20) + "\n" + old, d).count("LINE") == 1
    with pytest.raises(P.PatchError):
        P.apply("nothing like it", d)
    got = P.parse("diff --git a/x b/y\nrename from x\nrename to y\n")
    assert [(g.path, g.status) for g in got] == [("x", "deleted"), ("y", "added")]
    assert P.parse(None) == [] and P.parse("no diff") == []
    assert P.runs([5, 1, 2, 3, 9, 5]) == [(1, 3), (5, 5), (9, 9)]


def frame(spark, tree):
    return spark.createDataFrame(list(tree.items()), "path string, content string")


def test_delta_of_a_change(spark):
    diffs = spark.createDataFrame([("1", diff_of(BASE["gauge.py"], HEAD["gauge.py"], "gauge.py"))], "id string, diff string")
    back = D.base_files(frame(spark, HEAD), diffs).collect()
    assert [(r.path, r.content, r.status) for r in back] == [("gauge.py", BASE["gauge.py"], "ok")]
    changes = D.touched(diffs, frame(spark, HEAD), frame(spark, BASE)).cache()
    assert {(r.name, r.change) for r in changes.collect()} == {("rainfall", "modified"), ("dewpoint", "deleted"), ("gusts", "added")}
    e = resolve(extract(frame(spark, HEAD)))
    links = e.selectExpr("src_path", "src_name", "kind", "dst_path", "dst_name", "case when external = 'gauge.dewpoint' then 'dewpoint' else external end as ext_name", "line").cache()
    shown, risk = D.delta(changes, links)
    got = {r.name: (r.radius, r.dependents, r.load_bearing) for r in shown.collect()}
    assert got["rainfall"] == (4, 3, True) and got["gusts"] == (0, 0, False) and got["dewpoint"][0] == 1
    assert {(r.path, r.name, r.hops) for r in risk.collect()} == {("forecast.py", "predict", 1), ("bulletin.py", "announce", 2), ("coast.py", "tide", 1), ("ridge.py", "snow", 1), ("forecast.py", "verify", 1)}


def test_overlap_against_brute_force_and_innermost(spark):
    rng = random.Random(5)
    runs = [("p", a, a + rng.randrange(200)) for a in (rng.randrange(1, 500) for _ in range(40))]
    spans = [("p", a, a + rng.randrange(300), f"s{i}") for i, a in enumerate(rng.randrange(1, 500) for _ in range(40))]
    got = D.overlapping(spark.createDataFrame(runs, "k string, first int, last int"), spark.createDataFrame(spans, "k string, start int, stop int, name string"), "k").collect()
    assert sorted((r.first, r.last, r.name) for r in got) == sorted((a, b, n) for _, a, b in runs for _, s, e, n in spans if s <= b and a <= e)
    points = spark.createDataFrame([("p", n) for n in range(1, 900, 7)], "k string, line int")
    for r in D.innermost(points, spark.createDataFrame(spans, "k string, start int, stop int, name string"), "k").collect():
        inside = [(e - s, n) for _, s, e, n in spans if s <= r.line <= e]
        assert r.owner == (min(inside)[1] if inside else None)


def test_truth_of_a_patch(spark):
    diffs = spark.createDataFrame([("i", diff_of(BASE["gauge.py"], HEAD["gauge.py"], "gauge.py")), ("none", None)], "id string, diff string")
    base = spark.createDataFrame([("i", p, c) for p, c in BASE.items()], "id string, path string, content string")
    assert {(r.path, r.name, r.is_added) for r in D.truth(diffs, base).collect()} == {("gauge.py", "rainfall", False), ("gauge.py", "dewpoint", False), ("gauge.py", "gusts", True)}


def test_truth_of_moved_hunks_module_lines_and_new_files(spark):
    old = BASE["gauge.py"]
    moved = "# one\n# two\n# three\nUNIT = 1\n\n" + old  # the file has grown since the patch was made
    cases = {
        "moved": (moved, diff_of(old, HEAD["gauge.py"], "gauge.py"), {("rainfall", False), ("dewpoint", False), ("gusts", True)}),
        "module": (moved, diff_of(moved, moved.replace("UNIT = 1", "UNIT = 2"), "gauge.py"), {("<module>", False)}),
        "misfit": ("x = 1\n", diff_of(old, HEAD["gauge.py"], "gauge.py"), {("<module>", False)}),
        "fresh": (None, "diff --git a/gauge.py b/gauge.py\n--- /dev/null\n+++ b/gauge.py\n@@ -0,0 +1,2 @@\n+def wet():\n+    return 1\n", {("<module>", True), ("wet", True)}),
    }
    diffs = spark.createDataFrame([(k, d) for k, (_, d, _) in cases.items()], "id string, diff string")
    base = spark.createDataFrame([(k, "gauge.py", c) for k, (c, _, _) in cases.items() if c], "id string, path string, content string")
    got = D.truth(diffs, base).collect()
    for k, (_, _, want) in cases.items():
        assert {(r.name, r.is_added) for r in got if r.id == k} == want, k


def test_applying_agrees_with_git(tmp_path):
    rng = random.Random(11)
    for k in range(12):
        old = [f"line {rng.randrange(6)}" for _ in range(rng.randrange(5, 40))]
        new = [x for x in old if rng.random() > 0.15] + ["end"]
        for _ in range(3):
            new.insert(rng.randrange(len(new)), f"new {rng.randrange(9)}")
        a, b = "\n".join(old) + "\n", "\n".join(new) + "\n"
        text = diff_of("\n".join(old), "\n".join(new), "f.txt", rng.choice([1, 3, 5]))
        (tmp_path / "f.txt").write_text(a)
        (tmp_path / "p.diff").write_text(text)
        subprocess.run(["git", "apply", "--unsafe-paths", "p.diff"], cwd=tmp_path, check=True)
        assert (tmp_path / "f.txt").read_text() == P.apply(a, P.parse(text)[0]) == b, k


def test_diffs_without_tests():
    both = diff_of("a\n", "b\n", "src/x.py") + diff_of("a\n", "b\n", "tests/test_x.py")
    assert P.without_tests(both, lambda p: p.startswith("tests/")) == diff_of("a\n", "b\n", "src/x.py")
