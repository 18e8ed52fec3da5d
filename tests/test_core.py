"""Hand-derived goldens on small source trees: extraction, import graph, call graph, history, diff, communities, sources, store."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from quarry.functions.paths import gitignore_patterns, glob_regex
from quarry.operators import extract, graph_query, history
from quarry.operators import index as ix
from quarry.operators.communities import local_moves
from quarry.operators.diff import diff, file_changes, summarise
from quarry.operators.graph import build_graph
from quarry.operators.imports import deps, deps_closure, impact_closure, import_edges
from quarry.operators.scopes import scan
from quarry.operators.substring import contains_join

UTIL = """import os, sys
from pkg.core import run
class Helper(Base):
    def go(self):
        return run(1)
async def main():
    await Helper().go()"""
CORE = """def run(n):
    return helper(n)
def helper(n):
    return n"""
FILES = "path string, content string, size long, mtime long"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def python(spark):
    return spark.createDataFrame([("pkg/util.py", UTIL, 150, 1), ("pkg/core.py", CORE, 60, 2)], FILES).cache()


@pytest.fixture(scope="module")
def python_graph(python):
    return build_graph(python)


def test_index_of_python(python):
    index = ix.build_index(python)
    assert rows(index.symbols, "path", "line", "type", "name") == [
        ("pkg/core.py", 1, "function", "run"), ("pkg/core.py", 3, "function", "helper"), ("pkg/util.py", 3, "class", "Helper"), ("pkg/util.py", 4, "function", "go"),
        ("pkg/util.py", 6, "async_function", "main"),
    ]
    assert rows(index.imports, "path", "module") == [("pkg/util.py", "os,"), ("pkg/util.py", "pkg.core")]
    assert rows(index.import_edges, "src", "dst") == [("pkg/util.py", "pkg/core.py")]
    one = ix.stats(index).first()
    assert (one["total_files"], one["total_symbols"], one["files_with_imports"]) == (2, 5, 1)
    assert [r["path"] for r in ix.search(index, "he").collect()] == ["pkg/core.py", "pkg/util.py"]


def test_graph_of_python(python_graph):
    nodes = {r["id"]: r["name"] for r in python_graph.nodes.collect()}
    edges = {(r["type"], nodes[r["src_id"]], nodes[r["dst_id"]]) for r in python_graph.edges.collect()}
    assert edges == {
        ("DEFINES", "pkg/util.py", "Helper"), ("DEFINES", "Helper", "go"), ("DEFINES", "Helper", "main"), ("DEFINES", "pkg/core.py", "run"), ("DEFINES", "pkg/core.py", "helper"),
        ("IMPORTS", "pkg/util.py", "pkg/core.py"), ("CALLS", "go", "run"), ("CALLS", "main", "go"), ("CALLS", "run", "helper"),
    }
    assert graph_query.dead_code(python_graph).count() == 0
    start = python_graph.nodes.where("name = 'main'").select("id")
    assert rows(graph_query.trace_calls(python_graph, start, 2), "name", "depth") == [("go", 1), ("main", 0), ("run", 2)]
    assert [r["name"] for r in graph_query.find_nodes(python_graph.nodes, "hel").collect()] == ["helper", "Helper"]
    assert rows(graph_query.trace_edges(python_graph, "main", 1), "depth", "name") == [(1, "go"), (2, "run")]
    calls = python_graph.edges.where("type = 'CALLS'")
    assert rows(calls, "strategy") == [("imported file",), ("same file",), ("same file",)] and rows(calls, "confidence") == [(0.7,)] * 3
    assert rows(python_graph.communities, "community_id")[0] == (0,) and python_graph.communities.count() == 4


def test_passes_can_run_alone(python):
    g = build_graph(python, ("resolve",))
    assert rows(g.edges, "type")[0] == ("CALLS",) and g.edges.where("type = 'IMPORTS'").count() == 1


@pytest.mark.parametrize(
    ("lang", "text", "expected"),
    [
        ("typescript", "import { a } from './lib'\nexport class Store {\n  load() { return fetchAll() }\n}\nexport const init = async (x) => {\n  boot(x)\n}", {(2, "class", "Store"), (5, "function", "init")}),
        ("javascript", "export class Store {\nclass B {", {(2, "class", "B")}),
        ("go", "type T struct {\ntype I interface {\nfunc (t *T) Run() {\nfunc main() {", {(1, "struct", "T"), (2, "interface", "I"), (3, "function", "Run"), (4, "function", "main")}),
        ("rust", "pub fn f() {\nmod m;\nmacro_rules! mac {\ntrait Tr {\nimpl Tr for S {", {(1, "function", "f"), (2, "module", "m"), (3, "macro", "mac"), (4, "trait", "Tr"), (5, "impl", "S")}),
        ("java", "public class A {\n  public static int f(int x) {\n  enum E", {(1, "class", "A"), (2, "method", "f"), (3, "enum", "E")}),
        ("c", "struct s {\nstatic int f(int a) {\ntypedef int (*cb)(int);\ntypedef int num;", {(1, "struct", "s"), (2, "function", "f"), (3, "typedef", "cb"), (4, "typedef", "num")}),
        ("ruby", "module M\nclass C < D\ndef m", {(1, "module", "M"), (2, "class", "C"), (3, "method", "m")}),
        ("shell", "function a() {\nb () {", {(1, "function", "a"), (2, "function", "b")}),
        ("capnp", "struct S {\ninterface I {\n  get @0 (x :Int) -> R;\nunion {", {(1, "struct", "S"), (2, "interface", "I"), (3, "method", "get")}),
        ("cpp", "class A {\nA::A() {\nA::~A() {\nnamespace n {\nint f(int x) {\nusing T = int;\nenum class E", {
            (1, "class", "A"), (2, "constructor", "A"), (4, "namespace", "n"), (5, "method", "f"), (6, "type_alias", "T"), (7, "enum", "E"), (3, "destructor", "A")}),
    ],
)
def test_symbols_of_each_language(spark, lang, text, expected):
    files = spark.createDataFrame([("f", lang, text)], "path string, lang string, content string")
    assert {(r["line"], r["type"], r["name"]) for r in extract.symbols(extract.lines(files)).collect()} == expected


def test_imports_and_quirks(spark):
    files = [("a.ts", "typescript", "import x from './y'\nrequire('z')"), ("b.cpp", "cpp", '#include <v/w.h>\n#include "q.h"'), ("c.py", "python", "def naïve(x):\nimport ab"), ("d.sh", "shell", "source './e.sh'")]
    of = extract.lines(spark.createDataFrame(files, "path string, lang string, content string"))
    assert rows(extract.imports(of), "path", "module") == [("a.ts", "./y"), ("a.ts", "z"), ("b.cpp", "q.h"), ("b.cpp", "v/w.h"), ("c.py", "ab"), ("d.sh", "./e.sh")]
    assert rows(extract.symbols(of.where("path = 'c.py'")), "name") == [("naïve",)]


def test_coroutines(spark):
    text = "task f(int x) {\n  co_await g();\n}\nvoid h(int x) {\n  g();\n}\nint k(int a) { co_return 1; }"
    assert extract.coroutine_lines(text, [1, 4, 7]) == [1]
    index = ix.build_index(spark.createDataFrame([("a.cpp", text, 1, 1)], FILES))
    assert rows(index.symbols, "line", "type") == [(1, "coroutine"), (4, "method"), (7, "method")]
    assert "f" not in {r["name"] for r in index.exports.collect()}


def test_truncation_keeps_containers(spark):
    text = "\n".join(f"def f{i}(): pass" for i in range(5)) + "\nclass C: pass"
    index = ix.build_index(spark.createDataFrame([("a.py", text, 1, 1)], FILES), max_symbols=2)
    assert rows(index.symbols, "name") == [("C",), ("f0",)] and index.exports.count() == 6


def test_scopes():
    js = "function a() {\n  bb();\n}\ncc();\nfunction d() {\n}\nee();"
    assert [(k, n, c) for k, _, _, n, c in scan(js, "javascript")] == [("symbol", "a", None), ("call", "bb", "a"), ("symbol", "d", None)]
    py = "def a():\n    bb()\n# comment()\nif xx():\n    cc()\nyy()\ndd()"
    assert [n for k, _, _, n, _ in scan(py, "python") if k == "call"] == ["bb", "xx", "cc"]


def test_inherit_and_test_edges(spark):
    files = [("src/base.py", "class Base:\n    pass"), ("src/child.py", "class Child(Base):\n    pass"), ("tests/test_child.py", "def test_it():\n    pass"), ("A.java", "class A implements Base {")]
    g = build_graph(spark.createDataFrame([(p, c, 1, 1) for p, c in files], FILES))
    names = {r["id"]: r["name"] for r in g.nodes.collect()}
    found = {(r["type"], names[r["src_id"]], names[r["dst_id"]]) for r in g.edges.where("type in ('INHERITS', 'IMPLEMENTS', 'TESTS')").collect()}
    assert found == {("INHERITS", "Child", "Base"), ("IMPLEMENTS", "A", "Base"), ("TESTS", "tests/test_child.py", "src/child.py")}


def test_import_edge_rules(spark):
    files = spark.createDataFrame([("a/x.py",), ("b/y.py",), ("c/z.py",)], "path string")
    exports = spark.createDataFrame([("a/x.py", "own")], "path string, name string")
    asked = spark.createDataFrame([("a/x.py", "own"), ("b/y.py", "m.n.x"), ("c/z.py", "./x"), ("c/z.py", "y")], "path string, module string")
    assert rows(import_edges(asked, exports, files), "src", "dst") == [("b/y.py", "a/x.py"), ("c/z.py", "b/y.py")]


def test_levels(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    assert rows(deps(e, "a", 1), "path", "dist") == [("a", 0)]
    assert rows(deps(e, "a", 3), "path", "dist") == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(deps_closure(e, "a"), "path", "dist") == [("b", 1), ("c", 2), ("d", 3)]
    assert rows(impact_closure(e, "d"), "path", "dist") == [("a", 3), ("b", 2), ("c", 1)]


def test_contains_join(spark):
    n = spark.createDataFrame([("core",), ("o",), ("xyz",), ("",), ("util.py",)], "n string")
    h = spark.createDataFrame([("pkg/core.py",), ("pkg/util.py",)], "t string")
    assert rows(contains_join(n, "n", h, "t"), "n", "t") == [("core", "pkg/core.py"), ("o", "pkg/core.py"), ("util.py", "pkg/util.py")]


COMMITS = "hash string, short string, date_raw string, date_ts timestamp, author string, message string, body string"


@pytest.fixture(scope="module")
def commits(spark):
    raw = [("h1", "2026-01-03"), ("h2", "2026-01-02"), ("h3", "2026-01-01")]
    c = spark.createDataFrame([(h, h, d, None, "me", f"msg {h}", "") for h, d in raw], COMMITS).withColumn("date_ts", F.to_timestamp("date_raw"))
    files = spark.createDataFrame([("h1", "a.py", "M"), ("h1", "b.py", "M"), ("h2", "a.py", "M"), ("h3", "c.py", "A")], "hash string, path string, status string")
    return c, files, spark.createDataFrame([("b.py", "a.py"), ("c.py", "a.py"), ("a.py", "c.py")], "src string, dst string")


def test_history(spark, commits):
    c, f, e = commits
    hot = history.hotspots(history.recent(c, f, 10), f, e).collect()
    assert [(r["path"], r["changes"], r["dependent_count"], r["score"]) for r in hot] == [("a.py", 2, 2, 4), ("c.py", 1, 1, 2), ("b.py", 1, 0, 1)]
    none = spark.createDataFrame([], "path string, name string")
    one = history.commit_impact(f, e, none).where("hash = 'h1'").first()
    assert (one["total_dependents"], one["files"], one["impact_score"]) == (2, 2, 4)
    assert rows(history.areas(f), "area")[0] == ("root",)
    patch = "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n-x = run()\n+x = run(run())\ndiff --git a/b.py b/b.py\n-run\n+run"
    lines = history.patch_lines(spark.createDataFrame([("h1", patch)], "hash string, patch string"))
    found = history.trace(c, lines, e, "run").collect()
    assert [(r["hash"], r["files"], r["impact"]) for r in found] == [("h1", ["a.py"], {"a.py": 2})]
    both = history.search_commits(c, f, lines, "run", edges=e).collect()
    assert [(r["hash"], r["match_type"], r["impact_score"]) for r in both] == [("h1", "code", 2)]


def test_diff(spark):
    def index(files):
        return ix.build_index(spark.createDataFrame([(p, "\n".join(f"def {n}(): pass" for n in names), size, 1) for p, names, size in files], FILES))

    base = index([("a.py", "fg", 100), ("b.py", "f", 100), ("c.py", "f", 100), ("d.py", "f", 10)])
    target = index([("a.py", "fh", 100), ("b.py", "f", 140), ("c.py", "f", 151), ("e.py", "f", 10)])
    changes = file_changes(base, target)
    assert rows(changes, "path", "change") == [("a.py", "modified"), ("b.py", "unchanged"), ("c.py", "modified"), ("d.py", "deleted"), ("e.py", "added")]
    s = summarise(changes).first()
    assert (s["files_added"], s["files_deleted"], s["files_modified"], s["files_unchanged"], s["symbols_added"], s["symbols_removed"]) == (1, 1, 2, 1, 1, 1)
    assert diff(base, base)["changes"].where("change <> 'unchanged'").count() == 0


def test_local_moves_keep_triangles():
    a = {1: {2, 3}, 2: {1, 3}, 3: {1, 2, 4}, 4: {3, 5, 6}, 5: {4, 6}, 6: {4, 5}}
    found = local_moves(a, sum(map(len, a.values())))
    assert found[1] == found[2] == found[3] != found[4] == found[5] == found[6]


def test_globs_and_ignores():
    import re

    assert re.match(glob_regex("*.py").replace(r"\z", r"\Z"), "a/b.py") and not re.match(glob_regex("?.py").replace(r"\z", r"\Z"), "ab.py")
    assert gitignore_patterns(["# x", " /out/ ", "", "*.log"]) == ["*.log", "out"]


def test_tree_store_and_git(spark, tmp_path):
    from quarry.sources.git import changed_files, identity, read_commit, read_history, resolve
    from quarry.sources.store import SnapshotStore, export_document, read_document
    from quarry.sources.tree import read_tree
    from quarry.streaming.incremental import update

    root = tmp_path / "repo"
    (root / "pkg").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "node_modules" / "x.js").write_text("class X {")
    (root / ".gitignore").write_text("*.gen.py\n")
    (root / "a.gen.py").write_text("def no(): pass")
    (root / "pkg" / "util.py").write_bytes(UTIL.encode() + b"\r\n\xff")
    (root / "pkg" / "core.py").write_text(CORE)
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=me", "-c", "user.email=me@x", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    git("add", ".")
    git("commit", "-q", "-m", "first")
    (root / "pkg" / "core.py").write_text(CORE.replace("helper", "aid"))
    git("commit", "-qam", "second")

    files = read_tree(spark, str(root))
    assert rows(files, "path", "lang") == [("pkg/core.py", "python"), ("pkg/util.py", "python")]
    assert rows(read_commit(spark, str(root), "HEAD~1").where("path like 'pkg%'"), "path") == [("pkg/core.py",), ("pkg/util.py",)]
    assert rows(changed_files(spark, str(root), "HEAD~1", "HEAD"), "status", "path") == [("M", "pkg/core.py")]
    commits, changed, patches = read_history(spark, str(root))
    assert rows(commits, "message") == [("first",), ("second",)] and changed.where("path = 'pkg/core.py'").count() == 2
    assert [r["message"] for r in history.pickaxe(commits, history.patch_lines(patches), "aid").collect()] == ["second"]
    assert identity(str(root))["git_branch"] == "main" and len(resolve(str(root), "main")) == 40

    store = SnapshotStore(spark, str(tmp_path / "store"))
    store.save(ix.build_index(read_commit(spark, str(root), "HEAD~1").where("path like 'pkg%'")), "aaa111")
    store.save(ix.build_index(files), "bbb222", branch="feature/x")
    assert store.resolve("aaa") == "aaa111" and store.resolve("feature/x") == "bbb222" and store.resolve(None) == "bbb222" and store.resolve("none") is None
    changes = file_changes(store.load("aaa111"), store.load("feature/x"))
    assert rows(changes, "path", "change")[0] == ("pkg/core.py", "modified")
    assert store.snapshots().count() == 4
    merged = update(files.where("path = 'pkg/core.py'").withColumn("mtime", F.col("mtime") + 1), store.load("bbb222"), files.select("path", "mtime").withColumn("mtime", F.col("mtime") + F.when(F.col("path") == "pkg/core.py", 1).otherwise(0)))
    assert rows(merged.files, "path") == [("pkg/core.py",), ("pkg/util.py",)] and merged.import_edges.count() == 1
    out = tmp_path / "index.json"
    out.write_text(export_document(store.load("bbb222")))
    assert rows(read_document(spark, str(out)).import_edges, "src", "dst") == [("pkg/util.py", "pkg/core.py")] and json.loads(out.read_text())["dir_map"]["pkg"]["file_count"] == 2


def test_stream(spark, tmp_path):
    from quarry.sources.store import SnapshotStore
    from quarry.streaming.incremental import follow

    store, inbox = SnapshotStore(spark, str(tmp_path / "store")), str(tmp_path / "in")
    for i, (path, text) in enumerate([("a.py", "def f(): pass"), ("b.py", "import a")]):
        spark.createDataFrame([(path, text, 1, i)], FILES).write.mode("append").parquet(inbox)
        follow(spark, inbox, store, str(tmp_path / "cp")).awaitTermination()
    assert rows(store.load().import_edges, "src", "dst") == [("b.py", "a.py")]


def test_replayed_batch_keeps_the_snapshot(spark, tmp_path, monkeypatch):
    """A batch that fails after its snapshot was saved runs again; nothing is lost, and old snapshots go."""
    from quarry.sources.store import SnapshotStore
    from quarry.streaming.incremental import follow

    store, inbox = SnapshotStore(spark, str(tmp_path / "store")), str(tmp_path / "in")
    save, fail = SnapshotStore.save, [True]

    def once(self, *a, **b):
        save(self, *a, **b)
        if fail[0]:
            fail[0] = False
            raise RuntimeError("lost")

    for i, path in enumerate(["a.py", "b.py", "c.py", "d.py"]):
        spark.createDataFrame([(path, "import a", 1, i)], FILES).write.mode("append").parquet(inbox)
        if i == 1:
            monkeypatch.setattr(SnapshotStore, "save", once)
            with pytest.raises(Exception, match="lost"):
                follow(spark, inbox, store, str(tmp_path / "cp")).awaitTermination()
        follow(spark, inbox, store, str(tmp_path / "cp")).awaitTermination()
    assert rows(store.load().files, "path") == [("a.py",), ("b.py",), ("c.py",), ("d.py",)]
    assert sorted(p.name for p in (tmp_path / "store" / "files").iterdir()) == ["snapshot_id=stream-2", "snapshot_id=stream-3"]


def test_patch_lines_of_odd_content_and_paths(spark, tmp_path):
    from quarry.sources.git import read_history

    root = tmp_path / "odd"
    root.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=me", "-c", "user.email=me@x", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    names = ["q.sql", "é ü.py", "x b/y b/z.py", 'quo"te.py', "tab\there.py"]
    for n in names:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_text("-- a comment\n++ plus\nkept\n")
    git("add", ".")
    git("commit", "-q", "-m", "first")
    for n in names:
        (root / n).write_text("kept\n-- b\n@@ no hunk\n")
    git("commit", "-qam", "second")
    commits, files, patches = read_history(spark, str(root))
    assert {r["path"] for r in files.collect()} == set(names) and files.count() == 10
    last = commits.where("message = 'second'").select("hash")
    lines = history.patch_lines(patches).join(last, "hash")
    assert rows(lines, "path", "sign", "text") == sorted((n, s, t) for n in names for s, t in [("-", "-- a comment"), ("-", "++ plus"), ("+", "-- b"), ("+", "@@ no hunk")])
    assert {(r["path"], r["added"], r["removed"]) for r in history.diff_stat(lines).collect()} == {(n, 2, 2) for n in names}


def test_remote_tree_and_first_files(spark, tmp_path):
    from quarry.sources.tree import read_remote

    root = tmp_path / "o'dd" / "src" / "src"
    root.mkdir(parents=True)
    (root / "a.py").write_text("def f(): pass\nclass G: pass")
    (root / "b.py").write_text("def f(): pass")
    files = read_remote(spark, "file://" + str(tmp_path / "o'dd" / "src"))
    assert rows(files, "path") == [("src/a.py",), ("src/b.py",)]
    assert rows(ix.first_files(ix.build_index(files, staged=True)), "name", "path") == [("G", "src/a.py"), ("f", "src/a.py")]


def test_stored_graph(spark, python_graph, tmp_path):
    """Another store object finds the graph; search by tokens gives what a scan gives."""
    from quarry.sources.store import SnapshotStore

    assert SnapshotStore(spark, str(tmp_path)).load_graph() is None
    SnapshotStore(spark, str(tmp_path)).save_graph(python_graph, "one")
    g = SnapshotStore(spark, str(tmp_path)).load_graph()
    for name in ("nodes", "edges", "communities", "stats"):
        assert sorted(map(str, getattr(g, name).collect())) == sorted(map(str, getattr(python_graph, name).collect()))
    for query in ("hel", "helper", "function hel", "pkg core", "util.py", "lpe", "go", "none such"):
        assert graph_query.find_nodes(g.nodes, query, tokens=g.tokens).collect() == graph_query.find_nodes(python_graph.nodes, query).collect()
    plan = graph_query.get_node(g.nodes, g.nodes.first()["id"])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(id), EqualTo(id," in plan


def test_queries_without_optional_libraries():
    """The core's queries are there where a library of the training-data operators is missing."""
    import sys

    code = "import sys; sys.modules['zstandard'] = None; sys.modules['tokenizers'] = None\nimport __spark_entry__ as e\nq = e.queries(); assert 'hotspots' in q and 'hotspots' in e.oracle_sql(); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__import__("pathlib").Path(__file__).resolve().parent.parent)
    assert done.returncode == 0 and int(done.stdout) > 60, done.stderr


def test_bound_index_makes_what_is_asked(spark, tmp_path):
    """A query on paths reads no texts and makes no import edges; texts are read once for symbols."""
    from quarry.plans import registry

    spark.createDataFrame([(i, "Der Text\nEin Satz. Der Rest", "en", "src1", 20) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    known = registry.queries()
    for name in ("dir_stats", "dirs_depth_1", "languages", "entry_points", "summary_top"):
        plan = known[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "ReadSchema" in plan and "text:" not in plan and "MapInArrow" not in plan, name
    for name in ("index_symbols", "index_exports", "symbol_part", "search"):
        plan = known[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "text:" not in plan and "import_edges" not in plan, name
    assert known["import_graph"](spark, str(tmp_path)).count() == 72 and known["index_stats"](spark, str(tmp_path)).first()["import_edge_count"] == 72


def test_import_edges_in_blocks(spark, monkeypatch):
    """The same edges whatever the blocks, each made once, so that none is shuffled; counted without being written."""
    import random

    from quarry.operators import imports

    r = random.Random(7)
    names = [f"{i % 7}/f{i}.py" for i in range(60)]
    exports = {(p, f"n{r.randrange(40)}") for p in names for _ in range(4)}
    asked = {(p, r.choice(["", "pkg."]) + f"n{r.randrange(50)}") for p in names for _ in range(5)} | {("0/f0.py", "f1"), ("0/f0.py", "f0")}
    offers = {(n, p) for p, n in exports} | {(p[2:-3], p) for p in names}
    keys = {k for k, _ in offers}
    want = sorted({(p, t) for p, m in asked for k, t in offers if k == (m if m in keys else m.rsplit(".", 1)[-1]) and t != p})
    tables = [spark.createDataFrame(sorted(x), s) for x, s in ((asked, "path string, module string"), (exports, "path string, name string"), ({(p,) for p in names}, "path string"))]
    for block, least in ((1 << 19, 1000), (50, 10)):
        monkeypatch.setattr(imports, "BLOCK", block)
        monkeypatch.setattr(imports, "LEAST_SOURCES", least)
        edges = imports.import_edges(*tables)
        assert rows(edges, "src", "dst") == want
        assert edges._jdf.queryExecution().executedPlan().toString().index("Generate") < edges._jdf.queryExecution().executedPlan().toString().index("Exchange")
        assert tuple(imports.edge_totals(*tables).first()) == (len({p for p, _ in want}), len(want))


def test_texts_are_read_to_their_end(spark):
    """A long file gives all its lines, exports, imports and calls."""
    from quarry.sources.tree import decode

    text = "x = 1\n" * 40_000 + "import last\nclass End: pass\ndef f():\n    called()\n"
    files = spark.createDataFrame([("a.py", text, len(text), 1)], FILES)
    own = ix.TextIndex(files.withColumn("lang", F.lit("python")))
    assert ("a.py", "End") in rows(own.exports, "path", "name") and rows(own.imports, "module") == [("last",)]
    assert rows(own.files, "lines", "truncated") == [(40_005, False)]
    assert [n for k, _, _, n, _ in scan(text, "python") if k == "call"] == ["called"]
    assert files.select(F.length(decode(F.col("content").cast("binary"))).alias("n")).first()["n"] == len(text)


def test_exact_symbols_of_long_files(spark, tmp_path):
    """An exact name is found behind a file's first hundred symbols, in a stored index too, and after a merge."""
    from quarry.sources.store import SnapshotStore
    from quarry.streaming.incremental import merge

    text = "\n".join(f"def f{i}(): pass" for i in range(150))
    own = ix.TextIndex(spark.createDataFrame([("a.py", text, len(text), 1)], FILES).withColumn("lang", F.lit("python")))
    assert rows(ix.symbol(own, "f149", exact=True), "path", "line") == [("a.py", 150)] and own.symbols.count() == 100
    store = SnapshotStore(spark, str(tmp_path))
    store.save(own, "one")
    assert rows(ix.symbol(store.load("one"), "f149", exact=True), "path", "line") == [("a.py", 150)]
    other = ix.TextIndex(spark.createDataFrame([("b.py", "def g(): pass", 9, 1)], FILES).withColumn("lang", F.lit("python")))
    merged = merge(other, store.load("one"), spark.createDataFrame([("a.py",), ("b.py",)], "path string"))
    assert rows(ix.symbol(merged, "f149", exact=True), "path", "line") == [("a.py", 150)]


def test_components_are_moved_within_bounds(monkeypatch):
    """A component's links are not held: the same communities from a file, in memory that its nodes take."""
    import random
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from quarry.operators import communities

    r = random.Random(3)
    links = sorted({(0, a + s, b + s) for s, n, m in ((0, 400, 20_000), (1000, 30, 90)) for x, y in ((r.randrange(n), r.randrange(n)) for _ in range(m)) for a, b in ((x, y), (y, x)) if a != b})
    links = [(0 if a < 1000 else 1000, a, b) for _, a, b in links]

    def batches(rows):
        for i in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.array(rows[i : i + 1000]).T.copy()], ["component", "a", "b"])

    want = {}
    for start in (0, 1000):
        adjacent: dict[int, set[int]] = {}
        for c, a, b in links:
            if c == start:
                adjacent.setdefault(a, set()).add(b)
        found = local_moves(adjacent, len(links))
        want |= {n: min(x for x in found if found[x] == found[n]) for n in found}
    for held in (1 << 20, 500):
        monkeypatch.setattr(communities, "HELD", held)
        got = [p for p in communities.move_components(batches(links), len(links))]
        assert {n: x for p in got for n, x in zip(p["node_id"].to_pylist(), p["lowest"].to_pylist(), strict=True)} == want
    wide = np.stack([np.zeros(400_000, np.int64), np.repeat(np.arange(2000), 200), np.tile(np.arange(200) * 10, 2000)], axis=1)
    monkeypatch.setattr(communities, "HELD", 10_000)
    tracemalloc.start()
    list(communities.move_components(batches(wide), len(wide), 1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_000_000


def _orders(spark, folder):
    """Three orders of three parts as the tables that edges are made from."""
    lines = [(o, n, (o + n) % 4 + 1, 1, "A") for o in range(3) for n in range(3)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(i, f"Brand#{i}", 1) for i in range(1, 5)], "p_partkey long, p_brand string, p_size int").write.parquet(f"{folder}/part.parquet")


def test_traces_deal_calls_evenly(spark, tmp_path):
    """Edges go to as many tasks as shuffles have, not to fewer by their bytes; a trace takes calls as they are, more than once too."""
    from quarry.operators.graph import Graph
    from quarry.plans import bindings

    _orders(spark, tmp_path)
    assert bindings.part_edges(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2
    nodes = spark.createDataFrame([(i, "function", f"f{i}", "a", i, "python") for i in range(4)], "id long, type string, name string, file_path string, line int, lang string")
    g = Graph(nodes, spark.createDataFrame([(a, b, "CALLS") for a, b in [(0, 1), (0, 1), (1, 2), (0, 2), (2, 0)]], "src_id long, dst_id long, type string"), None, None)
    assert "Aggregate" not in graph_query._calls(g, "outbound")._jdf.queryExecution().optimizedPlan().toString()
    assert rows(graph_query.trace_calls(g, spark.createDataFrame([(0,)], "id long")), "node_id", "depth") == [(0, 0), (1, 1), (2, 1)]
    few = graph_query.trace_edges(g, "f0", fan_out=2)
    assert sorted(r["node_id"] for r in few.where("depth = 1").collect()) == [1, 2]


def test_dependents_are_dealt_evenly(spark):
    """Counts of distinct dependents, dealt by pairs, so that neither bytes nor a file that many import make a large task; levels take edges as they are."""
    from quarry.operators.imports import dependent_counts, reach

    e = spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "b"), (None, "b"), ("b", "d"), (None, "e")], "src string, dst string")
    counts = dependent_counts(e)
    assert "REPARTITION_BY_NUM" in counts._jdf.queryExecution().executedPlan().toString()
    assert rows(counts, "path", "dependent_count") == [("b", 2), ("d", 1)]
    assert rows(reach(e, spark.createDataFrame([("a",)], "path string"), None), "node", "dist") == [("a", 0), ("b", 1), ("d", 2)]


def test_commit_impact_moves_names_once(spark):
    """Names of a commit's files, whatever characters they hold; no row for each file and name."""
    files = spark.createDataFrame([("c1", "a"), ("c1", "b"), ("c2", "b"), ("c3", "none")], "hash string, path string")
    edges = spark.createDataFrame([("x", "a"), ("y", "a"), ("x", "b"), ("x", "b"), (None, "b")], "src string, dst string")
    symbols = spark.createDataFrame([("a", "f"), ("a", "f"), ("a", "50%0A"), ("b", "f"), ("b", "two\nlines"), ("b", ""), ("b", "%25"), ("none", None)], "path string, name string")
    out = history.commit_impact(files, edges, symbols)
    assert rows(out, "hash", "files", "total_dependents", "impact_score", "symbols_affected") == [
        ("c1", 2, 3, 5, ["", "%25", "50%0A", "f", "two\nlines"]), ("c2", 1, 1, 2, ["", "%25", "f", "two\nlines"]), ("c3", 1, 0, 1, []),
    ]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2


def test_changed_files_are_dealt_evenly(spark, tmp_path):
    from quarry.plans import bindings

    _orders(spark, tmp_path)
    plan = history.areas(bindings.commit_files(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange hashpartitioning") == 1
    assert rows(bindings.commit_files(spark, str(tmp_path)), "hash", "path")[0] == ("0", "Brand1/s1/p1.py")
