"""Key counts, dangling references and hierarchies against brute force, with nulls, repeats, ties and empty tables."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from spandrel.operators.dangling import dangling_by_period, dangling_ends
from spandrel.operators.heavy_keys import heavy_keys, key_counts
from spandrel.operators.hierarchy import hierarchy
from spandrel.plans.general import QUERIES

EDGE = "id long, src_path string, src_name string, kind string, dst_path string, dst_name string, ext_name string, status string, seen_at timestamp_ntz, loaded_at timestamp_ntz, key string, n int, hops int, way int, at int"
T0 = datetime(2024, 1, 1)


def edge(id_, src, kind, dst=None, ext=None, status="ok", seen=0, loaded=0):
    """src and dst are 'path::name'; the last columns clash with names that the operators use inside."""
    a, b = src.split("::") if src else (None, None), dst.split("::") if dst else (None, None)
    return (id_, *a, kind, *b, ext, status, None if seen is None else T0 + timedelta(days=seen), None if loaded is None else T0 + timedelta(days=loaded), "x", 1, 2, 3, 4)


def test_key_counts_against_brute_force(spark):
    rng = random.Random(1)
    rows, seen = [], {}
    for i in range(3000):
        dst = "hot::f" if rng.random() < 0.4 else f"p{rng.randrange(400)}::f"
        e = edge(i, "a::b", rng.choice(["calls", "reads", None]), *((dst, None) if rng.random() < 0.7 else (None, rng.choice(["len", None]))), status=rng.choice(["ok", "ok", "raw", "dropped", None]))
        rows += [e] * rng.choice([1, 1, 2])
        if e[7] != "dropped":
            key = "::".join(e[4:6]) if e[4] else f"external:{e[6]}" if e[6] else None
            seen[i] = (e[3], key)
    rows += [edge(None, "a::b", "calls", "nil::f")] * 3  # null ids are records of their own
    df = spark.createDataFrame(rows, EDGE)
    want = defaultdict(int)
    for k in seen.values():
        want[k] += 1
    want["calls", "nil::f"] += 3
    for blocks in (1, 7):
        assert {(r.kind, r.dst_key): r.n for r in key_counts(df, blocks).collect()} == dict(want)
    total = sum(want.values())
    got = {(r.kind, r.dst_key) for r in heavy_keys(df, 0.05).collect()}
    assert got == {k for k, n in want.items() if k[1] and n >= 0.05 * total} and ("calls", "hot::f") in got


def test_key_counts_of_conflicting_repeats_and_nothing(spark):
    rows = [edge(1, "a::b", "calls", "old::f", loaded=0), edge(1, "a::b", "calls", "new::f", loaded=5), edge(2, "a::b", "calls", "z::f"), edge(2, "a::b", "calls", "y::f"), edge(3, "a::b", "calls", "u::f", loaded=None)]
    df = spark.createDataFrame(rows, EDGE)
    assert {r.dst_key for r in key_counts(df).collect()} == {"new::f", "y::f", "u::f"}
    assert key_counts(df.limit(0)).count() == 0 and heavy_keys(df.limit(0)).count() == 0


ENTITY = "path string, name string, seen_at timestamp_ntz, removed_at timestamp_ntz, at int, stop int, ref boolean, h1 int"


def test_dangling_ends_against_brute_force(spark):
    rng = random.Random(2)
    day = lambda n: None if n is None else T0 + timedelta(days=n)
    ents = []
    for i in range(60):
        start = rng.randrange(50)
        ents.append((f"p{rng.randrange(30)}", "f", day(start), day(rng.choice([None, start + rng.randrange(30)])), 1, 2, True, 3))
    ents += [("p1", None, T0, None, 1, 2, True, 3), (None, "f", T0, None, 1, 2, True, 3), ("p2", "f", None, None, 1, 2, True, 3)]
    shared = [("s", "f", day(10))]
    edges = []
    for i in range(3000):
        ends = [rng.choice(["s::f", "p0::f", f"p{rng.randrange(40)}::f"]) for _ in range(2)]
        e = edge(i, ends[0] if rng.random() < 0.95 else None, "calls", ends[1] if rng.random() < 0.8 else None, status=rng.choice(["ok", "dropped", "ok"]), seen=rng.choice([None, *range(60)]))
        edges += [e] * rng.choice([1, 2])
    want = {}
    for e in edges:
        for side, p, n in (("src", e[1], e[2]), ("dst", e[4], e[5])):
            if e[7] == "dropped" or p is None:
                continue
            own = [(a, b) for q, m, a, b, *_ in ents if (q, m) == (p, n) and a] + [(a, None) for q, m, a in shared if (q, m) == (p, n)]
            t = e[8]
            if t is None:
                want[e[0], side] = "undated"
            elif not any(a <= t and (b is None or b > t) for a, b in own):
                want[e[0], side] = "missing" if not own else "late" if all(a > t for a, _ in own) else "deleted"
    df, en, sh = spark.createDataFrame(edges, EDGE), spark.createDataFrame(ents, ENTITY), spark.createDataFrame(shared, "path string, name string, seen_at timestamp_ntz")
    got = dangling_ends(df, en, sh)
    assert {(r.id, r.side): r.reason for r in got.collect()} == want
    assert sum(r.n for r in dangling_by_period(got).collect()) == len(want)
    assert dangling_ends(df.limit(0), en, sh).count() == 0
    assert {r.reason for r in dangling_ends(df, en.limit(0), sh.limit(0)).collect()} <= {"missing", "undated"}


def brute(links):
    up = {}
    for p, c in links:
        up[c] = min(up.get(c, p), p)
    out = {}
    for n in {x for pc in links for x in pc}:
        way, at = [n], n
        while at in up and up[at] not in way:
            at = up[at]
            way.append(at)
        out[n] = None if at in up else way[::-1]
    return out


def test_hierarchy_against_brute_force(spark):
    rng = random.Random(3)
    links = [(f"n{i}::x", f"n{i + 1}::x") for i in range(70)]  # a deep chain
    links += [("hub::x", f"leaf{i}::x") for i in range(300)] + [("n3::x", "hub::x")]  # a wide node
    links += [(f"t{rng.randrange(i)}::x", f"t{i}::x") for i in range(1, 200)]
    links += [("c1::x", "c2::x"), ("c2::x", "c3::x"), ("c3::x", "c1::x"), ("c2::x", "below::x"), ("below::x", "more::x"), ("self::x", "self::x")]
    links += [("pa::x", "two::x"), ("pb::x", "two::x")]  # two parents: the smaller counts
    rows = [edge(i, p, "contains", c) for i, (p, c) in enumerate(links)] * 2
    rows += [edge(900, "n1::x", "contains", "dropped::x", status="dropped"), edge(901, "a::x", "calls", "b::x"), edge(902, "alone::x", "contains"), edge(903, None, "contains", "orphan::x")]
    want = brute(links) | {"alone::x": ["alone::x"], "orphan::x": ["orphan::x"]}
    tree = hierarchy(spark.createDataFrame(rows, EDGE))
    got = {f"{r.path}::{r.name}": r for r in tree.labels().collect()}
    assert got.keys() == want.keys()
    for n, way in want.items():
        r = got[n]
        assert (f"{r.root_path}::{r.root_name}", r.depth) == ((way[0], len(way) - 1) if way else ("::", -1)), n
    below = defaultdict(set)
    for n, way in want.items():
        for a in (way or [])[:-1]:
            below[a].add(n)
    for n, way in want.items():
        assert got[n].size == (len(below[n]) + 1 if way else None)
    assert {f"{r.path}::{r.name}": r.full_path for r in tree.paths().collect()} == {n: "/".join(way or []) for n, way in want.items()}
    asked = spark.createDataFrame([("hub", "x"), ("n0", "x"), ("t0", "x"), ("c1", "x"), ("nowhere", "x")], "path string, name string")
    found = defaultdict(set)
    for r in tree.descendants_of(asked).collect():
        found[f"{r.anc_path}::{r.anc_name}"].add(f"{r.path}::{r.name}")
    assert found == {k: below[k] for k in ("hub::x", "n0::x", "t0::x")}
    assert max(r.n for r in tree.segments().select(F.size("segments").alias("n")).collect()) <= 11  # log2 of the nodes


def test_descendants_of_every_node(spark, tmp_path):
    links = [(f"n{i}::x", f"n{i + 1}::x") for i in range(40)] + [(f"n{i % 7}::x", f"leaf{i}::x") for i in range(1200)] + [("c1::x", "c2::x"), ("c2::x", "c1::x"), ("c2::x", "below::x"), ("below::x", "more::x")]
    rows = [edge(i, p, "contains", c) for i, (p, c) in enumerate(links)] * 2 + [edge(9000, "n1::x", "contains", "dropped::x", status="dropped"), edge(9001, "a::x", "calls", "b::x")]
    spark.createDataFrame(rows, EDGE).write.parquet(str(tmp_path / "edges.parquet"))
    want = {(a, n) for n, way in brute(links).items() for a in (way or [])[:-1]}
    got = [(f"{r.anc_path}::{r.anc_name}", f"{r.path}::{r.name}") for r in QUERIES["p5_descendants"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want


def test_hierarchy_of_nothing(spark):
    tree = hierarchy(spark.createDataFrame([edge(1, "a::b", "calls", "c::d")], EDGE))
    assert tree.labels().count() == 0 and tree.paths().count() == 0
