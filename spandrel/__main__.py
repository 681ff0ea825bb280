"""Command line: ``index ROOT OUT``, ``ask ROOT TOOL [ARGUMENT...]``, ``serve ROOT``."""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    from spandrel.serve import TOOLS, Server, Workspace
    from spandrel.session import local_session
    from spandrel.sources.sinks import write_graph

    if len(args) < 2 or args[0] not in ("index", "ask", "serve") or (args[0] == "index" and len(args) != 3) or (args[0] == "ask" and (len(args) < 3 or args[2] not in TOOLS)):
        print(__doc__, file=sys.stderr)
        return 2
    spark = local_session()
    if args[0] == "serve":
        Server(spark, args[1]).serve(sys.stdin, sys.stdout)
        return 0
    w = Workspace(spark, args[1])
    w.refresh()
    if args[0] == "index":
        write_graph(w.nodes, w.links, w.files, args[2])
        print(TOOLS["map"][0](w))
        return 0
    tool, names, _ = TOOLS[args[2]]
    rest = args[3:]
    print(tool(w, rest) if names == ["paths"] else tool(w, *rest))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
