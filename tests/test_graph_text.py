"""Walks, retrieval, fusion and metrics against short plain versions."""

import math
import random
import re
from collections import Counter, defaultdict, deque

import pytest

from spandrel.functions import text as T
from spandrel.operators import evaluate as E
from spandrel.operators import graph as G
from spandrel.operators import retrieval as R

LINK = "id long, src_path string, src_name string, kind string, dst_path string, dst_name string, ext_name string, line int"
NODE = "path string, name string, kind string, line int, meta string, doc_kind string"


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(4)
    rows = []
    for i in range(240):
        a, b = rng.randrange(60), rng.randrange(60)
        name = "<module>" if rng.random() < 0.1 else f"f{a}"
        rows.append((i, f"m{a % 7}.py", name, rng.choice(["calls", "reads", "imports", "types"]), f"m{b % 7}.py", f"f{b}", None, i))
    rows.append((999, "m1.py", "f1", "calls", None, None, "len", 1))
    nodes = [(f"m{i % 7}.py", f"f{i}", "function", i, "", "none") for i in range(60)] + [(f"m{i}.py", "<module>", "module", 1, "", "none") for i in range(7)]
    return spark.createDataFrame(rows, LINK), spark.createDataFrame(nodes, NODE), rows, nodes


def bfs(start, steps):
    far, queue = {start: 0}, deque([start])
    while queue:
        at = queue.popleft()
        for to in steps[at]:
            if to not in far:
                far[to] = far[at] + 1
                queue.append(to)
    return {k: v for k, v in far.items() if v}


def test_radius_and_handlers_against_plain_walks(spark, graph):
    links, nodes, rows, all_nodes = graph
    back, calls = defaultdict(set), defaultdict(set)
    used = set()
    for _, sp, sn, kind, dp, dn, _, _ in rows:
        a, b = f"{sp}::{sn}", f"{dp}::{dn}"
        if dp and kind in G.IMPACT and sn != "<module>":
            back[b].add(a)
        if dp and kind == "calls":
            calls[a].add(b)
        if dp and kind in G.LOAD_BEARING and sn != "<module>" and a != b:
            used.add(b)
    targets = ["m1.py::f1", "m2.py::f2", "no::where"]
    got = defaultdict(dict)
    for r in G.radius(links, spark.createDataFrame([(t,) for t in targets], "key string")).collect():
        got[r.target][f"{r.path}::{r.name}"] = r.hops
    assert got == {t: w for t in targets if (w := bfs(t, back))}
    want = {f"{p}::{n}": (len(bfs(f"{p}::{n}", calls)), len(calls[f"{p}::{n}"])) for p, n, k, *_ in all_nodes if k == "function" and f"{p}::{n}" not in used}
    assert {f"{r.path}::{r.name}": (r.reach, r.direct) for r in G.handlers(nodes, links).collect()} == {k: v for k, v in want.items() if v[0]}
    assert G.radius(links.limit(0), spark.createDataFrame([("a::b",)], "key string")).count() == 0


def test_find_tiers_packages_and_file_graph(spark, graph):
    nodes = spark.createDataFrame([("a.py", "get", "function", 1, "", "none"), ("b.py", "C.get", "method", 1, "", "none"), ("c.py", "getter", "function", 1, "", "none"), ("c.py", "<module>", "module", 1, "", "none")], NODE)
    names = lambda q: sorted(r.name for r in G.find(nodes, q).collect())
    assert names("get") == ["get"] and names("C.get") == ["C.get"] and names("ETT") == ["getter"] and names("a.py::get") == ["get"] and names("a.py::no") == [] and names("zzz") == []
    pk, up = G.packages(spark.createDataFrame([("a/b/c.py",), ("a/d.py",), ("e.py",), ("e.py",), (None,)], "path string"))
    assert sorted(r.path for r in pk.collect()) == ["a", "a/b"] and up.count() == 3
    links, nodes, rows, _ = graph
    shown, agg = G.file_graph(nodes, links)
    want = Counter((r[1], r[4]) for r in rows if r[4] and r[1] != r[4])
    assert {(r.src, r.dst): r.n for r in agg.collect()} == dict(want) and shown.count() == 7


def plain_tokens(text):
    out = []
    for word in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", text):
        out.append(word.lower())
        for parts in ([p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z0-9]+", word) if len(p) > 1], [p for p in word.lower().split("_") if len(p) > 1]):
            out += parts if len(parts) > 1 else []
    return out


def test_tokens_paths_and_references(spark):
    texts = ["get_axis_limits getAxisLimits HTTPServer2 x _a_b", "", "a1B2 éa déjà_vu", "ABCdef XMLHttp __init__"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(T.tokens(df.t)).collect()] == [plain_tokens(t) for t in texts]
    refs = {"./a.ts": "x/a.ts", "../b": "b", "../../c": None, "/abs": None, "https://x": None, "#top": None, "a b": None, "app.js?v=3#t": "x/app.js", "data:image/png;base64,xx": None, "": None, ".././x/./d": "x/d", "y" * 2000: None}
    df = spark.createDataFrame([(k,) for k in refs], "t string").withColumn("src", T.F.lit("x/i.html"))
    assert [r[0] for r in df.select(T.normal_path(T.path_reference(df.t), df.src)).collect()] == list(refs.values())
    mods = [("pkg.a", "x/y.py", "pkg/a.py"), (".a", "x/y.py", "x/a.py"), ("..a.b", "x/z/y.py", "x/a/b.py"), (".", "x/y.py", "x.py"), ("...a", "y.py", "a.py")]
    df = spark.createDataFrame(mods, "m string, s string, w string")
    assert [r[0] for r in df.select(T.module_path(df.m, df.s, T.F.lit(".py"))).collect()] == [w for *_, w in mods]
    paths = {"a/tests/x.py": True, "test_x.py": True, "a/x_test.py": True, "conftest.py": True, "a/testing/y.ts": True, "contest.py": False, "a/latest.py": False}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(T.is_test_path(df.p)).collect()] == list(paths.values())


def test_bm25_fusion_and_boost(spark):
    rng = random.Random(6)
    words = [f"w{i}x" for i in range(30)]
    docs = {f"d{i}": [rng.choice(words) for _ in range(rng.randrange(5, 30))] for i in range(25)}
    df = spark.createDataFrame([("s", d, " ".join(ws)) for d, ws in docs.items()], "space string, doc string, text string")
    posts = R.postings(df, T.tokens(df.text))
    q = ["w1x", "w2x", "w3x", "none"]
    got = {r.doc: r.score for r in R.bm25(spark.createDataFrame([("s", "q", " ".join(q))], "space string, query string, text string"), posts).collect()}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df_ = Counter(w for ws in docs.values() for w in set(ws))
    want = {}
    for d, ws in docs.items():
        s = sum(math.log(1 + (n - df_[t] + 0.5) / (df_[t] + 0.5)) * ws.count(t) * 2.2 / (ws.count(t) + 1.2 * (0.25 + 0.75 * len(ws) / avg)) for t in q if t in ws)
        if s:
            want[d] = s
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 for d in want)
    a = spark.createDataFrame([("s", "q", "x", 1), ("s", "q", "y", 2)], "space string, query string, doc string, rank int")
    b = spark.createDataFrame([("s", "q", "y", 1)], "space string, query string, doc string, rank int")
    assert [(r.doc, round(r.score, 9)) for r in R.fuse(a, b).orderBy("rank").collect()] == [("y", round(1 / 62 + 1 / 61, 9)), ("x", round(1 / 61, 9))]


def test_seeds_search_and_spread(spark, graph):
    text = 'File "a.py", line 3, in run_it\nUse `Axis.limits` and `foo_bar`; call sin(x). CamelCase here.\n```py\nmod.func(1)\n```\nself.none the()'
    got = {r.symbol: r.weight for r in R.seeds(spark.createDataFrame([("q", text)], "query string, text string")).collect()}
    assert got["run_it"] == 1.0 and got["Axis.limits"] == 0.8 and got["foo_bar"] == 0.8 and got["mod.func"] == 0.7 and got["func"] == 0.75 and got["sin"] == 0.65 and got["CamelCase"] == 0.5
    assert "the" not in got
    nodes = spark.createDataFrame([("shop/a.py", "checkout", "function", 1, "pays the order", "docstring"), ("b.py", "other", "function", 2, None, None), ("b.py", "<module>", "module", 1, "", "none")], NODE)
    hits = R.search(nodes, spark.createDataFrame([("1", "chekout"), ("2", "pays"), ("3", " ")], "query string, text string")).collect()
    assert {(r.query, r.name) for r in hits} == {("1", "checkout"), ("2", "checkout")}
    links, *_ = graph
    start = spark.createDataFrame([("q", "m1.py::f1", 1.0, 1), ("q", "m2.py::f2", 0.5, 2)], "query string, doc string, score double, mask long")
    out = {r.node: (r.score, r.mask) for r in R.spread(start, links, 1).collect()}
    assert out["m1.py::f1"][0] >= 1.0 and len(out) > 2 and all(m in (1, 2, 3) for _, m in out.values())


def test_metrics(spark):
    rank = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2), ("q1", "c", 3), ("q2", "z", 1), ("q1", "b", 9)], "query string, doc string, rank int")
    gold = spark.createDataFrame([("q1", "b"), ("q1", "c"), ("q1", "c"), ("q2", "x"), ("q3", "y")], "query string, doc string")
    got = {r.query: r for r in E.score_rankings(rank, gold, (1, 3)).collect()}
    assert (got["q1"]["recall@1"], got["q1"]["recall@3"], got["q1"]["mrr"], got["q1"]["all_found@3"], got["q1"]["exact_set"], got["q1"]["precision@1"]) == (0.0, 1.0, 0.5, 1.0, 0.0, 0.0)
    assert got["q2"]["mrr"] == 0 and got["q3"]["retrieved"] == 0
    assert E.macro(E.score_rankings(rank, gold, (1,))).first()["instances"] == 3
    added = spark.createDataFrame([("q1", "b", False), ("q1", "new", True), ("q2", "x", True)], "query string, doc string, is_added boolean")
    assert {r.query: r["entity_recall@3"] for r in E.entity_recall(rank, added, (3,)).filter("query = 'q1'").collect()} == {"q1": 1.0}
    lead = spark.createDataFrame([(a, f"q{i}", v + (0.2 if a == "x" else 0)) for i in range(30) for a, v in (("x", i / 60), ("y", i / 60))], "arm string, query string, value double")
    one, two = (E.paired_interval(lead, "x", "y", "mrr", 500).first() for _ in range(2))
    assert one == two and one.n == 30 and abs(one.difference - 0.2) < 1e-6 and one.separates
    assert E.paired_interval(lead.filter("query = 'q1'"), "x", "y", "mrr").first().difference is None
    pool = spark.createDataFrame([(f"{r}{i}", r) for r, n in (("a", 5), ("b", 1), ("c", 3)) for i in range(n)], "k string, s string")
    assert [r.k for r in E.stratified(pool, "s", "k", 5).collect()] == ["a0", "b0", "c0", "a1", "c1"]
    assert E.ceiling(spark.createDataFrame([("b",)], "doc string"), gold).first().asDict() == {"truth": 4, "reachable": 1}
    arms = spark.createDataFrame([("x", 0.5), ("y", 0.4)], "arm string, mrr double")
    assert [r.text for r in E.verdicts(arms, "mrr", E.paired_interval(lead, "x", "y", "mrr", 200)).orderBy("rank").collect()] == ["leads", "behind"]
    assert E.verdicts(arms, "mrr").orderBy("rank").first().text == "ahead, not established"


def test_arms_side_by_side(spark):
    from spandrel.operators import arms as A

    files = spark.createDataFrame([("r", f"r/m{i}.py", f"def task_{i}():\n    return step_{i}()\n") for i in range(6)] + [("q", "q/other.py", "x = 1")], "repo string, path string, content string")
    ents = spark.createDataFrame([(f"r/m{i}.py", f"task_{i}", "function", 1, f"does task {i}", "docstring", None) for i in range(6)], "path string, name string, kind string, line int, meta string, doc_kind string, removed_at timestamp")
    edges = spark.createDataFrame([(i, f"r/m{i}.py", f"task_{i}", "calls", f"r/m{(i + 1) % 6}.py", f"task_{(i + 1) % 6}", None, 1, "ok") for i in range(6)], LINK + ", status string")
    queries = spark.createDataFrame([("r", "q1", "task_3 fails in `task_3`")], "space string, query string, text string")
    truth = spark.createDataFrame([("q1", "r/m3.py")], "query string, doc string")
    c = A.Corpus(files, ents, edges, queries)
    got = {r.arm: r.mrr for r in A.run(c, truth, ks=(1, 3)).collect()}
    assert got.keys() == A.ARMS.keys() and all(got[a] == 1.0 for a in ("bm25", "map", "walk", "hybrid", "hybrid_walk"))
    for bad in (["bm25"], ["bm25", "nope"]):
        with pytest.raises(ValueError):
            A.run(c, truth, bad)
    configs = A.grid(rounds=[1, 2], seed_top=[5])
    assert len(configs) == 2 and len(A.grid(a=[1, 2, 3], b=[1, 2], c=[1, 2, 3], d=[1, 2, 3])) == 54
    tuned = A.tune(c, truth, configs).collect()
    assert len(tuned) == 2 and tuned[0].value == 1.0 and len(tuned[0].fingerprint) == 12
    with pytest.raises(ValueError, match="reporting"):
        A.tune(c, truth, configs, dataset="final", reporting=frozenset({"final"}))


def plain_spread(start, links, rounds, top):
    """``R.spread`` in loops: links are (a, b, kind)."""
    near, state, spent = defaultdict(list), {(q, d): (s, m) for q, d, s, m in start}, set()
    for a, b, kind in links:
        if a != b:
            near[a].append((b, G.KIND_WEIGHTS.get(kind, G.OTHER_KIND)))
            near[b].append((a, G.KIND_WEIGHTS.get(kind, G.OTHER_KIND) * G.BACKWARDS))
    for _ in range(rounds):
        front = {}
        for q in {q for q, _ in state}:
            fresh = sorted((-s, d, m) for (x, d), (s, m) in state.items() if x == q and (q, d) not in spent)[:top]
            front |= {(q, d): (-s, m) for s, d, m in fresh}
        spent |= set(front)
        for (q, d), (s, m) in front.items():
            for to, w in near[d]:
                gain, (path, name) = s * R.DAMPING / len(near[d]) * w, to.split("::")
                if gain > 1e-9 and name not in G.SCOPES and not path.rpartition("/")[2].startswith("test_"):
                    had = state.get((q, to), (0.0, 0))
                    state[q, to] = (had[0] + gain, had[1] | m)
    return state


@pytest.fixture(scope="module")
def hubs(spark):
    """Links with hubs that half of all nodes lead to, several links between two nodes, files and tests; starts of 5 queries in 3 spaces."""
    rng = random.Random(8)
    nodes = [(f"{s}/m{i % 5}.py", f"f{i}") for s in "abc" for i in range(40)] + [("kit/log.py", "emit"), ("kit/log.py", "<module>"), ("a/test_m.py", "t")]
    rows = [(*rng.choice(nodes), rng.choice(["calls", "reads", "odd", None]), *(rng.choice(nodes[-3:]) if rng.random() < 0.5 else rng.choice(nodes)), None, 1) for _ in range(900)]
    links = [(f"{r[0]}::{r[1]}", f"{r[3]}::{r[4]}", r[2]) for r in rows]
    start = [(space, f"q{n}", f"{p}::{f}", rng.random() * 9, rng.randrange(1, 99)) for n, space in enumerate("aabbc") for p, f in rng.sample([x for x in nodes if x[0].startswith(f"{space}/m")], 15)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], LINK), links, spark.createDataFrame(start, "space string, query string, doc string, score double, mask long"), start


@pytest.mark.parametrize(("at_once", "rounds", "top", "own"), [(3, 2, 6, False), (1000, 2, 6, True), (1000, 3, 200, False)])
def test_spread_against_loops_and_in_the_own_space(spark, hubs, monkeypatch, at_once, rounds, top, own):
    links, pairs, start, rows = hubs
    monkeypatch.setattr(R, "QUERIES_SPREAD", at_once)
    space = {r[1]: r[0] for r in rows}
    want = {k: v for k, v in plain_spread([r[1:] for r in rows], pairs, rounds, top).items() if not own or k[1].startswith(space[k[0]] + "/")}
    got = {(r.query, r.node): r for r in R.spread(start, links, rounds, top, own=own).collect()}
    assert got.keys() == want.keys()
    assert all(abs(r.score - want[k][0]) < 1e-9 and r.mask == want[k][1] and r.reached == bin(r.mask).count("1") for k, r in got.items())


def test_spread_of_nothing_and_over_nothing(hubs):
    links, _, start, rows = hubs
    assert R.spread(start.limit(0), links, 1).count() == 0 and R.spread(start, links.limit(0), 1).count() == len(rows)


def test_spread_shuffles_links_and_not_products(hubs):
    """What the workers give is the result: no exchange or aggregate lies over it."""
    links, _, start, _ = hubs
    plan = R.spread(start, links)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan.partition("MapInArrow")[0] and "Repartition" not in plan.partition("MapInArrow")[0]


@pytest.mark.parametrize("asked", [0, 200_000])
def test_bm25_over_terms_is_that_over_postings(spark, monkeypatch, asked):
    monkeypatch.setattr(R, "ASKED", asked)
    docs = [("r", "a", "get_it getIt x"), ("r", "b", "it is other"), ("r", "b", "twice it"), ("r", "empty", ""), ("r", "null", None), ("s", "a", "getIt there"), ("t", "z", "no one asks")]
    df = spark.createDataFrame(docs, "space string, doc string, text string").select("space", "doc", T.tokens(T.F.col("text")).alias("terms"))
    queries = spark.createDataFrame([("r", "1", "get getIt other"), ("r", "2", "get"), ("s", "3", "there none"), ("u", "4", "get"), ("r", "5", None)], "space string, query string, text string")
    parts = lambda d: {(r.space, r.query, r.doc, r.term): (r.df, round(r.weight, 12), round(r.part, 12)) for r in R.bm25_terms(queries, d).collect()}
    assert parts(df) == parts(R.postings(df, T.F.col("terms"))) and len(parts(df)) > 4


def test_arms_that_others_are_fused_from_run_once(spark, monkeypatch):
    from spandrel.operators import arms as A

    files = spark.createDataFrame([("r", "r/a.py", "def one_two(): pass"), ("r", "r/b.py", "one")], "repo string, path string, content string")
    ents = spark.createDataFrame([("r/a.py", "one_two", "function", 1, "", "none", None)], "path string, name string, kind string, line int, meta string, doc_kind string, removed_at timestamp")
    edges = spark.createDataFrame([(1, "r/b.py", "<module>", "calls", "r/a.py", "one_two", None, 1, "ok")], LINK + ", status string")
    runs = Counter()
    for name in ("bm25", "map_arm", "spread"):
        monkeypatch.setattr(R, name, lambda *a, f=getattr(R, name), n=name, **k: (runs.update([n]), f(*a, **k))[1])
    A.run(A.Corpus(files, ents, edges, spark.createDataFrame([("r", "q", "`one_two` fails")], "space string, query string, text string")), spark.createDataFrame([("q", "r/a.py")], "query string, doc string"), ks=(1,))
    assert runs == {"bm25": 1, "map_arm": 1, "spread": 1}
