"""The verbs end to end over a small mixed tree on disk, and the protocol around them."""

import io
import json
import subprocess

import pytest

from spandrel.serve import Server, Workspace, panel
from spandrel.sources import sinks, tree

SHOP = {
    "Dockerfile": "FROM python:3.11\nCOPY app.py ./\n", "infra.tf": 'variable "DB_URL" {\n}\n',
    "billing.py": 'import os\n\n\ndef save_order(items):\n    """Stores the order."""\n    return os.environ["DB_URL"], items\n\n\ndef checkout(items):\n    return save_order(items)\n',
    "app.py": "from billing import checkout\n\n\ndef main():\n    return checkout([])\n",
    "web/cart.ts": "export function add(x: number): number {\n  return x;\n}\nexport function twice(x: number): number {\n  return add(x);\n}\n",
    "web/index.html": '<html><script src="./cart.ts"></script></html>\n', "node_modules/x.py": "def no():\n    pass\n", "notes.txt": "x",
}


@pytest.fixture(scope="module")
def shop(tmp_path_factory):
    root = tmp_path_factory.mktemp("shop")
    for p, t in SHOP.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    return root


def ask(server, tool, **args):
    got = server.handle({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": tool, "arguments": args}})["result"]
    return got["content"][0]["text"], got["isError"]


def test_verbs_and_protocol(spark, shop):
    assert "notes.txt" not in tree.listing(shop) and not [p for p in tree.listing(shop) if "node_modules" in p]
    s = Server(spark, shop)
    text, bad = ask(s, "radius", name="DB_URL")
    assert not bad and "3 at risk" in text and "1 hop: billing.py :: save_order" in text and "3 hops: app.py :: main" in text
    assert "main (reach 2, direct 1)" in ask(s, "handlers")[0]
    what = ask(s, "what", name="save_order")[0]
    assert "says: Stores the order." in what and "dependents: 1 (billing.py :: checkout)" in what
    assert "web/cart.ts :: twice calls it" in ask(s, "who", name="add")[0]
    assert ask(s, "map")[0].startswith("6 files, 6 entities")
    assert "checkout" in ask(s, "locate", query="chekout")[0]
    assert "checkout: app.py :: main" in ask(s, "changed", paths=["billing.py"])[0]
    assert ask(s, "what", name="nope") == ("Nothing is called 'nope'.", False) and "Nothing is called" in ask(s, "who", name="app.py::gone")[0]
    assert ask(s, "wrong")[1]
    out = io.StringIO()
    s.serve(['{"id": 1, "method": "ping"}', '{"method": "note"}', "no json", '{"id": 2, "method": "tools/list"}', '{"id": 3, "method": "x"}', '{"id": 4, "method": "initialize"}'], out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r.get("error", {}).get("code") for r in replies] == [None, -32700, None, -32601, None] and len(replies[2]["result"]["tools"]) == 8
    w = s.workspace()
    assert {n["id"] for n in panel(w, "graph")["nodes"]} >= {"app.py", "web/cart.ts"}
    assert panel(w, "radius", "DB_URL")["nodes"][0]["hops"] == 1 and panel(w, "card", "nope") == {}
    assert panel(w, "tree")[0]["path"] and panel(w, "search", "checkout")[0]["name"] == "checkout"
    stamp = w.stamp
    (shop / "app.py").write_text(SHOP["app.py"] + "\n\ndef other():\n    return main()\n")
    w.checked = 0
    assert s.workspace().stamp != stamp and "main: app.py :: other" not in ask(s, "changed", paths=["app.py"])[0]
    sinks.write_graph(w.nodes, w.links, w.files, str(shop / "out"))
    assert spark.read.parquet(str(shop / "out/edges")).filter("kind = 'copies'").count() == 1


def test_delta_verb_and_sources(spark, shop):
    def git(*a):
        subprocess.run(["git", "-C", str(shop), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)

    git("add", "-A"), git("commit", "-qm", "x")
    (shop / "billing.py").write_text(SHOP["billing.py"].replace("items\n\n", "items + [1]\n\n", 1))
    w = Workspace(spark, shop)
    w.refresh()
    from spandrel.serve import delta

    got = delta(w)
    assert "modified billing.py :: save_order: 2 at risk" in got or "modified billing.py :: save_order: 3 at risk" in got
    assert tree.modified(shop) == ["billing.py"] and tree.nested_repositories(shop) == []
    for bad in ("--output=x", "nosuch", ""):
        with pytest.raises(tree.CheckoutError):
            tree.diff_since(shop, bad)
    with pytest.raises(tree.CheckoutError):
        tree.root_of("/")
    (shop / "bin.py").write_bytes(b"\xff\xfe\x00")
    rows = {r.path: r.content for r in tree.read_tree(spark, shop).collect()}
    assert rows["bin.py"] is None and rows["app.py"].startswith("from billing")
    assert {r.path for r in tree.read_directory(spark, str(shop)).collect()} >= {"app.py", "web/cart.ts"}
    assert {r.path for r in tree.candidates(tree.read_tree(spark, shop)).collect()} >= {"app.py", "billing.py"}
    assert "a.py" in sinks.scorecard([{"arm": "a.py", "mrr": 0.5}], [{"metric": "mrr", "n": 1, "difference": None}], shop / "card.md")
