"""Every query of the engine by name, on the bound test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import paths
from quarry.operators import diff, extract, graph, graph_query, history, imports, index
from quarry.plans import bindings as b
from quarry.plans.oracles import SQL
from quarry.sources.tree import source_files
from quarry.streaming.incremental import changed

Query = Callable[[SparkSession, str], DataFrame]


def _map_text(c: str):
    """A map of counts as sorted text."""
    return F.array_join(F.transform(F.sort_array(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")


def _list_text(c: str):
    return F.array_join(F.sort_array(c), ",")


def _pairs_text(c: str):
    return F.array_join(F.transform(F.sort_array(c), lambda e: F.concat(e["type"], F.lit(":"), e["name"])), ",")


def _hotspots(s, d):
    out = history.hotspots(history.recent(b.commits(s, d), b.commit_files(s, d), 500), b.commit_files(s, d), b.import_edges(s, d))
    return out.select("path", "changes", "dependent_count", "score", F.array_join("recent_commits", ",").alias("recent_commits"), F.array_join("recent_messages", ",").alias("recent_messages"))


def _path_functions(s, d):
    p = F.col("path")
    return b.files(s, d).select(
        "path", paths.base_name(p).alias("base"), paths.extension(p).alias("ext"), paths.stem(p).alias("stem"), paths.directory(p).alias("dir"), paths.area(p).alias("area"),
        paths.directory_at(paths.directory(p), 2).alias("dir2"), F.coalesce(paths.language(p), F.lit("-")).alias("lang"), paths.size_label(F.col("size") * 100).alias("label"),
    )


def _ignored(s, d):
    extra = ["src3", "*.txt"]
    return b.files(s, d).select("path", paths.is_ignored(F.col("path"), extra).alias("ignored"), paths.is_ignored(F.col("path"), (), True).alias("ignored_in_graph"))


def _changes(s, d):
    return diff.file_changes(b.year_index(s, d, True), b.year_index(s, d, False))


def _start(s, d):
    return b.part_paths(s, d).where("partkey = 1").select("path")


def _resolve_calls(s, d):
    p = b.table(s, d, "part")
    path = F.concat(F.lit("d"), F.col("p_size") % 5, F.lit("/"), F.regexp_replace("p_brand", "#", ""), F.lit(".py"))
    occ = p.select(path.alias("path"), F.col("p_name").alias("name"), F.col("p_partkey").cast("int").alias("line"), F.lit(0).alias("seq"), F.col("p_partkey").alias("id"))
    own = occ.select(F.col("id").alias("s"), "path", F.col("name").alias("caller"), "line", "seq")
    callee = F.when(F.col("id") % 4 == 0, F.upper("name")).otherwise(F.col("name"))
    calls = b.part_edges(s, d).join(own, "s").join(occ.select(F.col("id").alias("t"), callee.alias("name")), "t").select("path", "name", "caller", "line", F.col("s").cast("int").alias("seq"))
    pp = occ.select("path").distinct()
    imported = b.table(s, d, "supplier").select(F.concat(F.lit("d"), F.col("s_suppkey") % 5, F.lit("/Brand"), F.col("s_suppkey") % 25 + 1, F.lit(".py")).alias("src"), F.concat(F.lit("d"), F.col("s_nationkey") % 5, F.lit("/Brand"), F.col("s_nationkey") % 25 + 1, F.lit(".py")).alias("dst"))
    imported = imported.join(pp.withColumnRenamed("path", "src"), "src", "left_semi").where("src <> dst").distinct()
    return graph.resolve_calls(calls, occ, imported).select("src_id", "dst_id", "type", "confidence", "strategy", "strategy_confidence")


def _targets(s, d):
    words = b.table(s, d, "benchmark").select(F.explode(F.split("text", r"[ \n]+")).alias("w")).select(F.lower("w").alias("module"))
    more = b.table(s, d, "part").select(F.concat(F.lit("x."), F.regexp_replace("p_brand", "Brand#", "doc_")).alias("module"))
    return graph.resolve_targets(words.unionByName(more).where(F.length("module") > 1), b.files(s, d))


def _tests(s, d):
    p = b.table(s, d, "part")
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    src = p.select(F.concat(F.lit("src/"), F.regexp_replace("p_brand", "#", ""), F.lit("/"), name, F.lit(".py")).alias("path"))
    tests = p.select(F.concat(F.lit("tests/test_"), name, F.lit(".py")).alias("path"))
    files = src.unionByName(tests).distinct()
    ids = files.select("path", graph.node_id(F.lit("file"), F.col("path"), F.col("path")).alias("id"))
    e = graph.test_edges(files)
    return e.join(ids.select(F.col("id").alias("src_id"), F.col("path").alias("test")), "src_id").join(ids.select(F.col("id").alias("dst_id"), "path"), "dst_id").select("test", "path")


def _incremental(s, d):
    now = b.files(s, d).select("path", "mtime")
    before = now.where("mtime % 5 <> 0").withColumn("mtime", F.when(F.col("mtime") % 7 == 0, 0).otherwise(F.col("mtime")))
    return changed(now, before)


def _activity(s, d, by):
    return graph_query.call_activity(b.graph(s, d), by_symbols=by)


def queries() -> dict[str, Query]:
    ix = b.index
    return {
        "hotspots": _hotspots,
        "path_functions": _path_functions,
        "ignored_paths": _ignored,
        "source_files": lambda s, d: source_files(b.files(s, d).drop("lang")).select("path", "lang"),
        "file_lines": lambda s, d: extract.lines(b.files(s, d)).select("path", "line", F.length("text").alias("n_chars")),
        "index_entries": lambda s, d: ix(s, d).files.select("path", "base", "stem", "dir", "lang", "size", "lines", "truncated"),
        "index_symbols": lambda s, d: ix(s, d).symbols.select("path", "line", "type", "name"),
        "index_imports": lambda s, d: ix(s, d).imports,
        "index_exports": lambda s, d: ix(s, d).exports,
        "truncated_symbols": lambda s, d: extract.truncate(extract.symbols(extract.lines(b.files(s, d)), b.SYMBOL_PATTERNS), 4).select("path", "line", "type", "name"),
        "import_graph": lambda s, d: ix(s, d).import_edges,
        "entry_points": lambda s, d: index.entries(ix(s, d)),
        "config_files": lambda s, d: extract.config_files(b.files(s, d).select(F.regexp_replace("path", "^src1/en/d[0-9]+/main.py$", "setup.py").alias("path"))),
        "dir_stats": lambda s, d: ix(s, d).dir_stats.select("dir", "file_count", "total_size", _map_text("languages").alias("languages")),
        "dirs_depth_1": lambda s, d: index.dirs(ix(s, d), 1).select("dir", "file_count", "total_size", _map_text("languages").alias("languages")),
        "dirs_depth_2": lambda s, d: index.dirs(ix(s, d), 2).select("dir", "file_count", "total_size", _map_text("languages").alias("languages")),
        "languages": lambda s, d: index.languages(ix(s, d)),
        "index_stats": lambda s, d: index.stats(ix(s, d)).drop("languages"),
        "summary_top": lambda s, d: index.summary(ix(s, d))["top"].select("dir", "file_count", "size", _map_text("languages").alias("languages")),
        "symbol_exact": lambda s, d: index.symbol(ix(s, d), "The", exact=True),
        "symbol_part": lambda s, d: index.symbol(ix(s, d), "TH"),
        "importers": lambda s, d: index.importers(ix(s, d), "er"),
        "files_glob": lambda s, d: index.files(ix(s, d), "src1*/*/doc_*[05].txt").select("path", "lang", F.array_join("symbols", ",").alias("symbols"), "n_symbols"),
        "files_glob_base": lambda s, d: index.files(ix(s, d), "m?in.py").select("path", "lang", F.array_join("symbols", ",").alias("symbols"), "n_symbols"),
        "search": lambda s, d: index.search(ix(s, d), "an", limit=50).select("path", "lang", "n_matches", "path_match", "score"),
        "search_filtered": lambda s, d: index.search(ix(s, d), "e", "en", "function").select("path", "lang", "n_matches", "path_match", "score", F.array_join(F.transform("matches", lambda m: m["name"]), ",").alias("shown")),
        "dependents": lambda s, d: b.part_paths(s, d).where("partkey = 1").select(F.col("path").alias("dst")).join(b.import_edges(s, d), "dst").select(F.col("src").alias("path")),
        "dependent_counts": lambda s, d: imports.dependent_counts(b.import_edges(s, d)),
        "dependents_of": lambda s, d: imports.dependents_of(b.import_edges(s, d), b.part_paths(s, d).where("partkey % 100 = 0")).select("path", F.array_join("dependents", ",").alias("dependents")),
        "reach_depth_3": lambda s, d: imports.reach(b.import_edges(s, d), _start(s, d), 3),
        "impact_closure": lambda s, d: imports.reach(b.import_edges(s, d).select(F.col("dst").alias("src"), F.col("src").alias("dst")), _start(s, d), 4).where("dist > 0").select(F.col("node").alias("path"), "dist"),
        "recent_commits": lambda s, d: history.recent(b.commits(s, d), b.commit_files(s, d), 50, since="1995-01-01", until="1997-06-30", author="author1", grep="^[1-3]").select("hash", "short", "author", "message"),
        "recent_below": lambda s, d: history.recent(b.commits(s, d), b.commit_files(s, d), 30, paths=["Brand1/s1", "Brand2"]).select("hash"),
        "file_history": lambda s, d: history.file_history(b.commits(s, d), b.commit_files(s, d).withColumn("path", F.split_part("path", F.lit("/"), F.lit(1))), "Brand13", 25).select("hash", "author"),
        "commit_detail": lambda s, d: history.commit_detail(b.commits(s, d), b.commit_files(s, d), "10").select("hash", "message", "body", F.array_join(F.transform("files", lambda f: F.concat(f["status"], F.lit(" "), f["path"])), ",").alias("files")),
        "recent_impact": lambda s, d: history.recent_impact(history.recent(b.commits(s, d), b.commit_files(s, d), 40), b.commit_files(s, d), b.import_edges(s, d), b.part_symbols(s, d)).select(
            "hash", "dependent_count", "symbol_count", F.array_join("high_impact_files", ",").alias("high_impact_files"), F.coalesce(_map_text("areas"), F.lit("")).alias("areas")
        ),
        "areas": lambda s, d: history.areas(b.commit_files(s, d)),
        "area_summary": lambda s, d: history.area_summary(b.commits(s, d), b.commit_files(s, d)),
        "commit_impact": lambda s, d: history.commit_impact(b.commit_files(s, d), b.import_edges(s, d), b.part_symbols(s, d)).select("hash", "files", "total_dependents", "impact_score", F.size("symbols_affected").alias("n_symbols")),
        "impact_files": lambda s, d: history.impact_files(b.commit_files(s, d), b.import_edges(s, d), b.part_symbols(s, d), "1").select("path", "dependent_count", F.array_join("dependents", ",").alias("dependents"), "symbol_count"),
        "pickaxe": lambda s, d: history.pickaxe(b.commits(s, d), b.diff_lines(s, d), "N", 40).select("hash", F.array_join("files", ",").alias("files"), F.array_join("diff_lines", ",").alias("diff_lines")),
        "trace": lambda s, d: history.trace(b.commits(s, d), b.diff_lines(s, d), b.import_edges(s, d), "A", 30).select("hash", F.coalesce(_map_text("impact"), F.lit("")).alias("impact")),
        "search_commits": lambda s, d: history.search_commits(b.commits(s, d), b.commit_files(s, d), b.diff_lines(s, d), "O", "all", 30, b.import_edges(s, d)).select("hash", "match_type", "impact_score"),
        "diff_changes": lambda s, d: _changes(s, d).select(
            "path", "change", "size_delta", "lines_delta", _pairs_text("symbols_added").alias("symbols_added"), _pairs_text("symbols_removed").alias("symbols_removed"),
            _list_text("imports_added").alias("imports_added"), _list_text("imports_removed").alias("imports_removed"),
        ),
        "diff_summary": lambda s, d: diff.summarise(_changes(s, d)),
        "diff_entries": lambda s, d: diff.entry_changes(b.year_index(s, d, True), b.year_index(s, d, False)),
        "diff_high_impact": lambda s, d: diff.high_impact(_changes(s, d), b.import_edges(s, d), b.import_edges(s, d)),
        "diff_most_changed": lambda s, d: diff.most_changed(_changes(s, d)),
        "incremental": _incremental,
        "graph_nodes": lambda s, d: b.graph(s, d).nodes.select("id", "type", "name", "file_path", "line", "parent_id"),
        "graph_stats": lambda s, d: graph_query.graph_stats(b.graph(s, d)).withColumn("type", F.coalesce("type", F.lit("-"))),
        "graph_find": lambda s, d: graph_query.find_nodes(b.graph(s, d).nodes, "red"),
        "graph_find_like": lambda s, d: graph_query.find_nodes(b.graph(s, d).nodes, "idge"),
        "graph_neighbors": lambda s, d: graph_query.neighbors(b.graph(s, d), b.table(s, d, "part").select(F.col("p_partkey").alias("id")).unionByName(b.table(s, d, "customer").select((-1000 - F.col("c_custkey")).alias("id"))).where("id % 100 = 0"), None, "both").select("id", "node_id", "edge_type", "node_type", "name", "direction"),
        "graph_trace": lambda s, d: graph_query.trace_calls(b.graph(s, d), b.table(s, d, "part").where("p_partkey = 1").select(F.col("p_partkey").alias("id")), 3).select("start", "node_id", "depth", "name"),
        "graph_dead_code": lambda s, d: graph_query.dead_code(b.graph(s, d), limit=None),
        "graph_no_inbound": lambda s, d: graph_query.dead_code(b.graph(s, d), "no_inbound", None),
        "graph_communities": lambda s, d: graph_query.community_report(b.graph(s, d)).select("community_id", "size", "names", F.array_join("sample_nodes", ",").alias("sample_nodes")),
        "graph_file_activity": lambda s, d: _activity(s, d, False),
        "graph_symbol_activity": lambda s, d: _activity(s, d, True),
        "graph_local_moves": lambda s, d: graph.communities(b.graph(s, d).edges),
        "import_targets": _targets,
        "test_edges": _tests,
        "call_resolution": _resolve_calls,
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
