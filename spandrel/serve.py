"""The verbs as tools: a workspace of tables, answers in plain sentences, and a JSON-RPC and HTTP-style front."""

from __future__ import annotations

import json
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.operators import delta as D
from spandrel.operators import graph as G
from spandrel.operators import retrieval as R
from spandrel.operators.extraction import extract
from spandrel.operators.resolve import resolve
from spandrel.session import Scratch
from spandrel.sources.tree import diff_since, read_tree, root_of
from spandrel.tables import node_key

FRESH_SECONDS = 2.0


class Workspace:
    """The graph of one tree, read again when it is asked after ``FRESH_SECONDS`` and a file has changed."""

    def __init__(self, spark: SparkSession, root: str | Path | None = None, files: DataFrame | None = None):
        self.spark, self.root, self.given = spark, Path(root) if root else None, files
        self.checked, self.stamp = 0.0, None

    def refresh(self) -> None:
        if time.monotonic() - self.checked < FRESH_SECONDS and self.stamp is not None:
            return
        files = self.given if self.given is not None else read_tree(self.spark, self.root)
        stamp = files.agg(F.count("*"), F.sum(F.xxhash64("path", "content").cast("decimal(38,0)"))).first()
        if stamp != self.stamp:
            scratch = Scratch(self.spark)
            x = extract(files)
            e = resolve(x)
            self.nodes = scratch.keep(x.entities.select("path", "name", "kind", "line", "meta", "doc_kind", "recipe", "recipe_version"))
            self.links = scratch.keep(e.select("src_path", "src_name", "kind", "dst_path", "dst_name", F.col("external").alias("ext_name"), "line").distinct())
            self.files, self.languages = files, x.files.select("path", "language")
            self.stamp = stamp
        self.checked = time.monotonic()


def _find(w: Workspace, name: str) -> list[tuple[str, str]]:
    return [(r.path, r.name) for r in G.find(w.nodes, name).orderBy("path", "name").collect()]


def _key(w: Workspace, hit: tuple[str, str]) -> DataFrame:
    return w.spark.createDataFrame([("::".join(hit),)], "key string")


def _said(path: str, name: str) -> str:
    return f"package {path}" if name == G.PACKAGE else f"file {path}" if name == G.MODULE else f"{path} :: {name}"


def _others(hits: list[tuple[str, str]]) -> str:
    if len(hits) < 2:
        return ""
    more = f" and {len(hits) - 6} more" if len(hits) > 6 else ""
    return "\nThe name also stands for " + ", ".join("::".join(h) for h in hits[1:6]) + more + "; ask for path::name to mean one of them."


def _none(name: str) -> str:
    return f"Nothing is called '{name}'."


def what(w: Workspace, name: str) -> str:
    hits = _find(w, name)
    if not hits:
        return _none(name)
    parts = []
    for hit in hits[:3]:
        node = w.nodes.filter((F.col("path") == hit[0]) & (F.col("name") == hit[1])).first()
        rows = G.card(w.nodes, w.links, _key(w, hit)).collect()
        calls = sorted({_said(r.path, r.name) if r.path else f"external:{r.name}" for r in rows if r.direction == "external" or (r.direction == "outgoing" and r.edge_kind == "calls")})
        users = sorted({_said(r.path, r.name) for r in rows if r.direction == "incoming" and r.edge_kind in G.IMPACT and r.name != G.MODULE})
        inside = [_said(r.path, r.name) for r in G.ancestry(w.links, _key(w, hit)).orderBy("depth").collect()]
        says = f"\n  says: {node.meta.splitlines()[0]}" if node.doc_kind != "none" and node.meta else ""
        parts.append(f"{_said(*hit)} [{node.kind}], line {node.line}, read as {node.recipe} {node.recipe_version}{says}\n  inside: {' < '.join(inside) or '-'}\n  calls: {', '.join(calls) or '-'}\n  dependents: {len(users)}" + (f" ({', '.join(users)})" if users else ", though tests and dynamic calls are not seen"))
    return "\n\n".join(parts) + (f"\n\n{len(hits) - 3} more go by that name." if len(hits) > 3 else "")


def who(w: Workspace, name: str) -> str:
    hits = _find(w, name)
    if not hits:
        return _none(name)
    rows = G.who_touches(w.links, _key(w, hits[0])).orderBy("kind", "src_path", "line").collect()
    return ("\n".join(f"{_said(r.src_path, r.src_name)} {r.kind} it (line {r.line})" for r in rows) or f"Nothing touches {_said(*hits[0])}.") + _others(hits)


def radius(w: Workspace, name: str) -> str:
    hits = _find(w, name)
    if not hits:
        return _none(name)
    key = _key(w, hits[0])
    near = G.radius(w.links, key).orderBy("hops", "path", "name").collect()
    through = G.container_radius(w.links, key).orderBy("holder", "path", "name").collect()
    lines = [f"A change of {_said(*hits[0])} puts {len(near)} at risk." if near else f"Nothing depends on {_said(*hits[0])} directly."]
    lines += [f"  {r.hops} hop{'s' if r.hops > 1 else ''}: {_said(r.path, r.name)}" for r in near]
    if through:
        lines.append(f"Through what holds it, a weaker claim, {len(through)} more:")
        lines += [f"  via {r.holder}: {_said(r.path, r.name)}" for r in through]
    return "\n".join(lines) + _others(hits)


def changed(w: Workspace, paths: list[str]) -> str:
    known = w.spark.createDataFrame([(p,) for p in paths], "path string") if paths else None
    own = w.nodes.join(known, "path").filter(~F.col("name").isin(*G.SCOPES)) if known is not None else None
    if own is None or own.isEmpty():
        return "None of these paths is tracked."
    keyed = own.select("path", "name", node_key(F.col("path"), F.col("name")).alias("key"))
    risk = G.radius(w.links, keyed).withColumnRenamed("target", "key").withColumnRenamed("path", "at").withColumnRenamed("name", "who")
    rows = keyed.join(risk, "key", "left").filter("at is null or at <> path").groupBy("path", "name").agg(F.array_sort(F.collect_set(F.concat_ws(" :: ", "at", "who"))).alias("r")).orderBy("path", "name").collect()
    return "\n".join(f"{r.path} :: {r.name}: " + (", ".join(x for x in r.r if x) or "nothing downstream") for r in rows)


def locate(w: Workspace, query: str) -> str:
    asked = w.spark.createDataFrame([("q", query)], "query string, text string")
    rows = R.search(w.nodes, asked, 5).orderBy("rank").collect()
    return "\n".join(f"{r.score:.2f} {_said(r.path, r.name)}" for r in rows) or f"Nothing matches '{query}'."


def overview(w: Workspace) -> str:
    m = G.system_map(w.nodes, w.links).first()
    top = G.load_bearing(w.nodes, w.links).collect()
    return f"{m.files} files, {m.entities} entities, {m.edges} edges." + ("\nMost depended on: " + "; ".join(f"{_said(r.path, r.name)} ({r.fan_in})" for r in top) if top else "")


def handlers(w: Workspace) -> str:
    rows = G.handlers(w.nodes, w.links).orderBy(F.desc("reach"), "path", "name").collect()
    shown = "\n".join(f"  {_said(r.path, r.name)} (reach {r.reach}, direct {r.direct})" for r in rows[:20])
    return f"{len(rows)} entry points that nothing calls:\n{shown}" + (f"\n  and {len(rows) - 20} more" if len(rows) > 20 else "") if rows else "There are no entry points."


def delta(w: Workspace, revision: str = "HEAD", diff: str | None = None) -> str:
    text = diff if diff is not None else diff_since(w.root, revision)
    diffs = w.spark.createDataFrame([("1", text)], "id string, diff string")
    base = D.base_files(w.files, diffs).select("path", "content")
    shown, risk = D.delta(D.touched(diffs, w.files, base), w.links)
    rows, at_risk = shown.orderBy("path", "name").collect(), risk.orderBy("hops", "path", "name").collect()
    if not rows:
        return "The change touches no entity."
    lines = [f"{r.change} {_said(r.path, r.name)}: {r.radius} at risk" + (", load-bearing" if r.load_bearing else "") for r in rows]
    lines += [f"At risk in all: {len(at_risk)}"] + [f"  {r.hops}: {_said(r.path, r.name)}" for r in at_risk]
    for r in D.cross_language(w.links, w.languages, D.changed_lines(diffs).select("path")).collect():
        lines.append(f"{r.path} is used from {', '.join(r.others)}")
    return "\n".join(lines)


TOOLS = {
    "what": (what, ["name"], "What a name stands for"), "who": (who, ["name"], "Who touches it"), "radius": (radius, ["name"], "What breaks if it changes"),
    "changed": (changed, ["paths"], "What changed files put at risk"), "locate": (locate, ["query"], "Where something lives"), "map": (overview, [], "The whole at a glance"),
    "handlers": (handlers, [], "Where work begins"), "delta": (delta, [], "What a diff touches"),
}


class Server:
    """JSON-RPC over lines: one workspace a repository, opened when it is first named."""

    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark, self.root, self.open = spark, root, {}

    def workspace(self, repo: str | None = None) -> Workspace:
        at = root_of(repo or self.root) if not isinstance(self.root, Workspace) else None
        w = self.root if at is None else self.open.setdefault(at, Workspace(self.spark, at))
        w.refresh()
        return w

    def handle(self, message: dict) -> dict | None:
        """The reply to a request; None for notifications."""
        method, id_ = message.get("method"), message.get("id")
        if id_ is None:
            return None
        reply = {"jsonrpc": "2.0", "id": id_}
        if method == "initialize":
            return reply | {"result": {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "spandrel", "version": "0.1.0"}}}
        if method == "ping":
            return reply | {"result": {}}
        if method == "tools/list":
            kinds = lambda a: {"type": "array", "items": {"type": "string"}} if a == "paths" else {"type": "string"}
            return reply | {"result": {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {a: kinds(a) for a in (*args, "repo")}, "required": args}, "annotations": {"readOnlyHint": True}} for n, (_, args, d) in TOOLS.items()]}}
        if method == "tools/call":
            params = message.get("params") or {}
            args = dict(params.get("arguments") or {})
            try:
                tool = TOOLS[params.get("name")][0]
                text, failed = tool(self.workspace(args.pop("repo", None)), **args), False
            except Exception as e:  # noqa: BLE001 - a wrong question must not end the server
                text, failed = f"{type(e).__name__}: {e}"[:500], True
            return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}
        return reply | {"error": {"code": -32601, "message": f"unknown method {method}"}}

    def serve(self, lines, out) -> None:
        for line in lines:
            if line.strip():
                try:
                    answer = self.handle(json.loads(line))
                except ValueError:
                    answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
                if answer is not None:
                    out.write(json.dumps(answer) + "\n")
                    out.flush()


def panel(w: Workspace, verb: str, arg: str = "") -> dict | list:
    """What the HTTP panel shows, as plain data: tree, card, search, handlers, radius, reach, graph."""
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    if verb == "tree":
        return rows(G.tree(w.nodes).orderBy("path"))
    if verb == "handlers":
        return rows(G.handlers(w.nodes, w.links).orderBy(F.desc("reach"), "path", "name"))
    if verb == "graph":
        nodes, edges = G.file_graph(w.nodes, w.links)
        return {"nodes": rows(nodes.orderBy("id")), "edges": rows(edges.orderBy("src", "dst"))}
    if verb == "search":
        return rows(R.search(w.nodes, w.spark.createDataFrame([("q", arg)], "query string, text string")).orderBy("rank"))
    hits = _find(w, arg)
    if not hits:
        return {}
    if verb == "card":
        return rows(G.card(w.nodes, w.links, _key(w, hits[0])).orderBy("direction", "path", "name"))
    if verb in ("radius", "reach"):
        nodes, edges = G.radius_graph(w.nodes, w.links, _key(w, hits[0]), "in" if verb == "radius" else "out")
        return {"nodes": rows(nodes.orderBy("hops", "path", "name")), "edges": rows(edges.orderBy("src", "dst"))}
    raise KeyError(verb)
