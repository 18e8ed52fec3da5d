"""Tools over a project: fifteen questions by name, and a line-based JSON-RPC server that answers them."""

from __future__ import annotations

import argparse
import json
import sys
import traceback
from functools import cached_property
from typing import IO, Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.operators import diff, graph_query, history
from quarry.operators import index as ix
from quarry.operators.graph import Graph, build_graph
from quarry.plans import render
from quarry.sources import git
from quarry.sources.store import SnapshotStore
from quarry.sources.tree import list_tree, read_tree
from quarry.streaming.incremental import update

# ---- Fixed values: names, arguments and required arguments of the tools; protocol strings ----
TOOLS = """
code_summary
code_search query! type lang limit:integer
code_deps path! depth:integer
code_dependents path!
code_diff base! target format
code_log_recent n:integer since author area
code_log_search query! search_in n:integer
code_log_trace symbol! n:integer
code_log_impact commit!
code_hotspots n:integer since
code_index_build incremental:boolean commit
code_graph_stats
code_graph_trace name! depth:integer direction
code_graph_dead_code
code_graph_architecture
"""
PROTOCOL, NOT_FOUND = "2024-11-05", -32601

ABOUT = {
    "code_summary": "Figures of the project, its entry points, directories and configuration.", "code_search": "Files by a part of their symbols' names or of their path.",
    "code_deps": "What a file imports, down to a depth.", "code_dependents": "Which files import a file.", "code_diff": "Symbol-level difference of two commits.",
    "code_log_recent": "Newest commits with what they touch.", "code_log_search": "Commits by message or changed code.", "code_log_trace": "Commits that change how often a symbol occurs.",
    "code_log_impact": "Files, symbols and dependents of a commit.", "code_hotspots": "Files that change often and that many depend on.", "code_index_build": "Build or update index and graph.",
    "code_graph_stats": "Nodes and edges by type.", "code_graph_trace": "Calls from or to a symbol.", "code_graph_dead_code": "Functions without calls.", "code_graph_architecture": "Communities and call activity.",
}


def schemas() -> list[dict[str, Any]]:
    """Name, description and input schema of each tool."""
    out = []
    for line in TOOLS.strip().split("\n"):
        name, *args = line.split()
        fields = {a.rstrip("!").split(":")[0]: {"type": (a.split(":") + ["string"])[1]} for a in args}
        schema: dict[str, Any] = {"type": "object", "properties": fields}
        if required := [a[:-1] for a in args if a.endswith("!")]:
            schema["required"] = required
        out.append({"name": name, "description": ABOUT[name], "inputSchema": schema})
    return out


class Project:
    """A source tree with its snapshots; the index is built on first use."""

    def __init__(self, spark: SparkSession, root: str, store: str | None = None):
        self.spark, self.root = spark, root
        self.store = SnapshotStore(spark, store or f"{root}/.quarry")
        self._graph: Graph | None = None

    def build(self, incremental: bool = True, commit: str | None = None) -> str:
        """Index the tree (only what changed, unless asked otherwise) or a commit, and the graph; the current snapshot moves only with the tree."""
        about = git.identity(self.root) if git.is_repo(self.root) else {}
        if commit:
            snapshot = git.resolve(self.root, commit)
            self.store.save(ix.build_index(git.read_commit(self.spark, self.root, snapshot), about={"git_commit": snapshot}), snapshot, current=False)
            return snapshot
        files, known = read_tree(self.spark, self.root), self.store.resolve(None)
        listing = list_tree(self.spark, self.root)
        fresh = ix.build_index(files, listing, about=about) if known is None or not incremental else update(files, self.store.load(known))
        snapshot = "tree-b" if known == "tree-a" else "tree-a"
        self.store.save(fresh, snapshot, branch=about.get("git_branch"))
        self._build_graph()
        return snapshot

    def _build_graph(self) -> None:
        known = self.store.refs().where("kind = 'graph'").first()
        graph_id = "graph-b" if known and known["snapshot_id"] == "graph-a" else "graph-a"
        self.store.save_graph(build_graph(read_tree(self.spark, self.root, graph=True)), graph_id)
        self._graph = self.store.load_graph()

    def index(self, ref: str | None = None) -> ix.Index:
        """The current index, or that of a commit; built where it is missing."""
        if ref is None:
            if self.store.resolve(None) is None:
                self.build(incremental=False)
            return self.store.load()
        snapshot = git.resolve(self.root, ref)
        if self.store.resolve(snapshot) is None:
            self.build(commit=snapshot)
        return self.store.load(snapshot)

    @property
    def graph(self) -> Graph:
        """The stored graph; built where there is none."""
        if self._graph is None:
            self._graph = self.store.load_graph()
        if self._graph is None:
            self._build_graph()
        return self._graph

    @cached_property
    def log(self):
        return git.read_history(self.spark, self.root)

    def run(self, tool: str, a: dict[str, Any]) -> str:
        """The answer of a tool as text."""
        return getattr(self, f"_{tool}")(a)

    def _code_summary(self, a):
        return render.summary(ix.summary(self.index()))

    def _code_search(self, a):
        return render.search(ix.search(self.index(), a["query"], a.get("lang"), a.get("type"), int(a.get("limit", 20))))

    def _code_deps(self, a):
        return render.paths(ix.dependencies(self.index(), a["path"], int(a.get("depth", 2))).orderBy("dist", "path"), "No dependencies.")

    def _code_dependents(self, a):
        return render.paths(ix.dependent_files(self.index(), a["path"]).orderBy("path"), f"No files depend on {a['path']}.")

    def _code_diff(self, a):
        return render.diff(diff.diff(self.index(a["base"]), self.index(a.get("target", "HEAD"))), a.get("format", "compact"))

    def _code_log_recent(self, a):
        commits, files, _ = self.log
        chosen = history.recent(commits, files, int(a.get("n", 20)), a.get("since"), None, a.get("author"), None, [a["area"]] if a.get("area") else None)
        index = self.index()
        return render.timeline(history.recent_impact(chosen, files, index.import_edges, index.symbols).orderBy(*history.newest()))

    def _code_log_search(self, a):
        commits, files, patches = self.log
        return render.timeline(history.search_commits(commits, files, history.patch_lines(patches), a["query"], a.get("search_in", "all"), int(a.get("n", 30)), self.index().import_edges))

    def _code_log_trace(self, a):
        commits, _, patches = self.log
        return render.trace(history.trace(commits, history.patch_lines(patches), self.index().import_edges, a["symbol"], int(a.get("n", 20))))

    def _code_log_impact(self, a):
        _, files, _ = self.log
        full, index = git.resolve(self.root, a["commit"]), self.index()
        one = history.commit_impact(files, index.import_edges, index.symbols, files.where(F.col("hash") == full).select("hash").distinct())
        return render.impact(one, history.impact_files(files, index.import_edges, index.symbols, full))

    def _code_hotspots(self, a):
        commits, files, _ = self.log
        return render.hotspots(history.hotspots(history.recent(commits, files, int(a.get("n", 100)), a.get("since")), files, self.index().import_edges))

    def _code_index_build(self, a):
        return f"Indexed as {self.build(bool(a.get('incremental', True)), a.get('commit'))}."

    def _areas(self, a):
        commits, files, _ = self.log
        return render.areas(history.area_summary(commits, files))

    def _code_graph_stats(self, a):
        return render.graph_stats(graph_query.graph_stats(self.graph))

    def _code_graph_trace(self, a):
        found = graph_query.trace_edges(self.graph, a["name"], int(a.get("depth", 3)), a.get("direction", "outbound"))
        return render.nodes(found.orderBy("start", "depth", "file_path", "line", "name"), f"No calls of {a['name']}.")

    def _code_graph_dead_code(self, a):
        return render.nodes(graph_query.dead_code(self.graph, limit=50), "No dead code.")

    def _code_graph_architecture(self, a):
        return render.architecture(graph_query.architecture(self.graph))


class Server:
    """JSON-RPC 2.0, a message a line."""

    def __init__(self, project: Project):
        self.project = project

    def answer(self, message: dict[str, Any]) -> dict[str, Any] | None:
        """The response to a message, None to a notification."""
        method, params = message.get("method", ""), message.get("params") or {}
        reply = {"jsonrpc": "2.0", "id": message.get("id")}
        if method == "notifications/initialized":
            return None
        if method == "initialize":
            return reply | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "quarry", "version": "0.1"}}}
        if method == "tools/list":
            return reply | {"result": {"tools": schemas()}}
        if method == "ping":
            return reply | {"result": {}}
        if method == "tools/call":
            return reply | {"result": self._call(params.get("name", ""), params.get("arguments") or {})}
        return reply | {"error": {"code": NOT_FOUND, "message": f"Method not found: {method}"}}

    def _call(self, name: str, arguments: dict[str, Any]) -> dict[str, Any]:
        text = lambda t, bad=False: {"content": [{"type": "text", "text": t}]} | ({"isError": True} if bad else {})
        if name not in ABOUT:
            return text(f"Unknown tool: {name}", True)
        try:
            return text(self.project.run(name, arguments))
        except Exception as e:  # a tool's failure is an answer
            return text(f"{type(e).__name__}: {e}\n{traceback.format_exc(limit=3)}", True)

    def serve(self, lines: IO[str], out: IO[str]) -> None:
        for line in filter(None, map(str.strip, lines)):
            try:
                message = json.loads(line)
            except ValueError as e:
                print(f"not JSON: {e}", file=sys.stderr)
                continue
            if (reply := self.answer(message)) is not None:
                out.write(json.dumps(reply, ensure_ascii=False) + "\n")
                out.flush()


def main() -> None:
    p = argparse.ArgumentParser(prog="quarry", description="Answers questions about a source tree over JSON-RPC on standard input and output.")
    p.add_argument("--project", default=".")
    p.add_argument("--describe", action="store_true", help="print the tools and end")
    p.add_argument("ask", nargs="*", help="a tool (or areas) and its arguments as name=value: print the answer and end")
    args = p.parse_args()
    if args.describe:
        print(json.dumps(schemas(), indent=2))
        return
    spark = SparkSession.builder.appName("quarry").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    project = Project(spark, args.project)
    if args.ask:
        print(project.run(args.ask[0], dict(x.split("=", 1) for x in args.ask[1:])))
    else:
        Server(project).serve(sys.stdin, sys.stdout)


if __name__ == "__main__":
    main()
