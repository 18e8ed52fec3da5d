"""The knowledge graph: nodes and edges from files. Each pass reads tables, so any of them can run alone.

Order, where a first match counts, is (path, line, seq). A node's id is a 64-bit hash of (type, name, file_path), which needs no
global numbering. All lookups are equal-key joins with tables that hold one first row for each key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import fixed
from quarry.functions.paths import base_name, directory, extension, language, stem
from quarry.functions.patterns import import_patterns, inherit_patterns, words
from quarry.functions.staging import cut
from quarry.operators import extract
from quarry.operators.communities import communities
from quarry.operators.scopes import scan_files
from quarry.operators.substring import contains_join

PASSES = ("structure", "extract", "resolve", "enrich", "analyze")


@dataclass
class Graph:
    """nodes (id, type, name, file_path, line, lang, parent_id, size, mtime), edges (src_id, dst_id, type, confidence, line, strategy,
    strategy_confidence), communities (node_id, community_id), stats: stage figures (key, value), tokens: (token, id) of a stored graph."""

    nodes: DataFrame
    edges: DataFrame
    communities: DataFrame
    stats: DataFrame
    tokens: DataFrame | None = None


def node_id(type_: Column, name: Column, path: Column) -> Column:
    return F.xxhash64(type_, name, path)


def _ord() -> Column:
    return F.struct("path", "line", "seq")


def file_nodes(files: DataFrame) -> DataFrame:
    path = F.col("path")
    return files.select(
        node_id(F.lit("file"), path, path).alias("id"), F.lit("file").alias("type"), path.alias("name"), path.alias("file_path"), F.lit(0).alias("line"), "lang",
        F.lit(None).cast("long").alias("parent_id"), "size", "mtime",
    )


def occurrences(scanned: DataFrame) -> DataFrame:
    """Every symbol occurrence with its node id and its parent's: the last class, struct or namespace before it in the file, or the file."""
    own = scanned.where("kind = 'symbol'").withColumn("id", node_id(F.col("type"), F.col("name"), F.col("path")))
    holder = F.when(F.col("type").isin(*words(fixed.CONTAINERS)), F.col("id"))
    before = Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    at_file = node_id(F.lit("file"), F.col("path"), F.col("path"))
    return own.withColumn("parent_id", F.coalesce(F.last(holder, True).over(before), at_file))


def symbol_nodes(occ: DataFrame) -> DataFrame:
    """One node for each (type, name, file): overloads are one, at the first line."""
    one = occ.groupBy("id", "type", "name", F.col("path").alias("file_path")).agg(F.min_by(F.struct("line", "lang", "parent_id"), "seq").alias("f"))
    return one.select("id", "type", "name", "file_path", "f.line", "f.lang", "f.parent_id", F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("mtime"))


def _edges(df: DataFrame, src: str, dst: str, type_: Column | str, line: str | None = None) -> DataFrame:
    kind = F.lit(type_) if isinstance(type_, str) else type_
    at = F.col(line).cast("int") if line else F.lit(None).cast("int")
    none = F.lit(None)
    return df.select(
        F.col(src).alias("src_id"), F.col(dst).alias("dst_id"), kind.alias("type"), F.lit(1.0).alias("confidence"), at.alias("line"), none.cast("string").alias("strategy"),
        none.cast("double").alias("strategy_confidence"),
    )


def resolve_targets(modules: DataFrame, paths: DataFrame) -> DataFrame:
    """(module, dst) for distinct modules: the least path that contains the module; or else whose base name or stem is its last
    part; or else that contains what follows its last dot or slash. Modules without any are left out."""
    asked = modules.select("module").distinct()
    known = paths.select("path").distinct()
    first = contains_join(asked, "module", known, "path").groupBy("module").agg(F.min("path").alias("dst"))
    rest = asked.join(first, "module", "left_anti")
    keys = known.select(base_name(F.col("path")).alias("key"), "path").unionByName(known.select(stem(F.col("path")).alias("key"), "path")).groupBy("key").agg(F.min("path").alias("dst"))
    second = rest.withColumn("key", base_name(F.col("module"))).join(keys, "key").select("module", "dst")
    rest = rest.join(second, "module", "left_anti").withColumn("last", F.regexp_extract("module", r"(?s)([^./\\]*)$", 1))
    third = contains_join(rest.where("last <> ''"), "last", known, "path").groupBy("module").agg(F.min("path").alias("dst"))
    empty = rest.where("last = ''").select("module").crossJoin(known.agg(F.min("path").alias("dst")))  # with one row: every path contains nothing
    return first.unionByName(second).unionByName(third).unionByName(empty.where("dst is not null"))


def import_edges(lines: DataFrame, files: DataFrame) -> DataFrame:
    """IMPORTS edges between files, by path too (src, dst)."""
    found = extract.imports(lines, import_patterns(graph=True))
    # quotes are never part of a group here, so stripping them changes nothing
    pairs = found.join(resolve_targets(found, files), "module").where("path <> dst").select(F.col("path").alias("src"), "dst").distinct()
    file = lambda c: node_id(F.lit("file"), F.col(c), F.col(c))
    return pairs.select("src", "dst", file("src").alias("src_id"), file("dst").alias("dst_id"))


def _first(occ: DataFrame, *keys: Column) -> DataFrame:
    """The first occurrence (ord, id) for each key."""
    return occ.groupBy(*keys).agg(F.min(F.struct(_ord().alias("ord"), "id")).alias("hit"))


def resolve_calls(calls: DataFrame, occ: DataFrame, imported: DataFrame) -> DataFrame:
    """CALLS edges from calls (path, name, caller, line): the callee is the first symbol of that name (or, if there is none, of the first
    name that differs only in case) in an imported file, in the same file, in the same directory, or anywhere; no self edges.

    Which symbol a name means depends on the file alone, so each (file, name) is looked up once, in tables of first occurrences.
    """
    asked = calls.select("path", "name").distinct()
    names = occ.groupBy("name").agg(F.min(_ord()).alias("ord"), F.count(F.lit(1)).alias("n"))
    lower = names.groupBy(F.lower("name").alias("lower")).agg(F.min_by("name", "ord").alias("other"))
    asked = asked.join(names.select("name", F.lit(True).alias("known")), "name", "left").withColumn("lower", F.lower("name")).join(lower, "lower", "left")
    asked = asked.select("path", "name", F.when(F.col("known"), F.col("name")).otherwise(F.col("other")).alias("meant")).where("meant is not null")
    asked = asked.withColumn("dir", directory(F.col("path")))
    in_file = _first(occ, F.col("path").alias("file"), F.col("name").alias("meant"))
    in_dir = _first(occ, directory(F.col("path")).alias("dir"), F.col("name").alias("meant"))
    anywhere = _first(occ, F.col("name").alias("meant")).join(names.select(F.col("name").alias("meant"), "n"), "meant")
    hit = lambda df, name: df.withColumnRenamed("hit", name)
    by_import = asked.select("path", "meant").distinct().join(imported.select(F.col("src").alias("path"), F.col("dst").alias("file")).distinct(), "path").join(in_file, ["file", "meant"])
    by_import = by_import.groupBy("path", "meant").agg(F.min("hit").alias("h0"))
    found = asked.join(by_import, ["path", "meant"], "left").join(hit(in_file, "h1").withColumnRenamed("file", "path"), ["path", "meant"], "left")
    found = found.join(hit(in_dir, "h2"), ["dir", "meant"], "left").join(hit(anywhere, "h3"), "meant")
    step = F.when(F.col("h0").isNotNull(), 0).when(F.col("h1").isNotNull(), 1).when(F.col("h2").isNotNull(), 2).when(F.col("n") == 1, 3).otherwise(4)
    target = found.select("path", "name", step.alias("step"), F.coalesce("h0.id", "h1.id", "h2.id", "h3.id").alias("dst_id"))
    callers = in_file.select(F.col("file").alias("path"), F.col("meant").alias("caller"), F.col("hit.id").alias("src_id"))
    out = calls.join(callers, ["path", "caller"]).join(target, ["path", "name"]).where("src_id <> dst_id")
    out = out.groupBy("src_id", "dst_id").agg(F.min_by(F.struct("line", "step"), F.struct("path", "seq")).alias("f"))
    label = F.element_at(F.array(*map(F.lit, ("imported file", "same file", "same directory", "unique name", "first"))), F.col("f.step") + 1)
    sure = F.element_at(F.array(*map(F.lit, fixed.STEP_CONFIDENCE)), F.col("f.step") + 1)
    return out.select(
        "src_id", "dst_id", F.lit("CALLS").alias("type"), F.lit(fixed.CALL_CONFIDENCE).alias("confidence"), F.col("f.line").alias("line"), label.alias("strategy"), sure.alias("strategy_confidence")
    )


def inherit_edges(lines: DataFrame, occ: DataFrame) -> DataFrame:
    """INHERITS edges, IMPLEMENTS where the line says so, from a class in the file to the first symbol of the parent's name."""
    pairs = F.lit(None)
    for lang in dict.fromkeys(x for x, _ in inherit_patterns()):
        own = [r for x, r in inherit_patterns() if x == lang]
        made = F.array(*[F.struct(extract.match(F.col("text"), r, 1).alias("child"), extract.match(F.col("text"), r, 2).alias("parent")) for r in own])
        pairs = F.when(F.col("lang") == lang, made).otherwise(pairs)
    kind = F.when(F.lower("text").contains("implements"), "IMPLEMENTS").otherwise("INHERITS")
    found = lines.select("path", "line", kind.alias("type"), F.explode(pairs).alias("p")).where("p.child is not null").select("path", "line", "type", "p.child", "p.parent")
    children = _first(occ, F.col("path"), F.col("name").alias("child")).select("path", "child", F.col("hit.id").alias("src_id"))
    parents = _first(occ, F.col("name").alias("parent")).select("parent", F.col("hit.id").alias("dst_id"))
    return _edges(found.join(children, ["path", "child"]).join(parents, "parent"), "src_id", "dst_id", F.col("type"), "line")


def test_edges(files: DataFrame) -> DataFrame:
    """TESTS edges from files with ``test`` in their path to files without it whose path holds the base name less the test mark."""
    path = F.col("path")
    is_test = F.lower(path).contains("test")
    base = base_name(path)
    marks = F.array(*[F.replace(base, F.lit(x), F.lit("")) for x in ("test_", "_test", "Test")])
    variants = files.where(is_test).select(F.col("path").alias("test"), F.explode(marks).alias("v"))
    bare = F.substring(F.col("v"), F.lit(1), F.length("v") - F.length(extension(F.col("v"))))
    asked = variants.select("test", bare.alias("variant")).where("variant <> ''").distinct()
    pairs = contains_join(asked, "variant", files.where(~is_test).select("path").distinct(), "path").select("test", "path").distinct()
    file = lambda c: node_id(F.lit("file"), F.col(c), F.col(c))
    return _edges(pairs.select(file("test").alias("a"), file("path").alias("b")), "a", "b", "TESTS")


def first_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (source, target, type): the first by line."""
    rest = [c for c in edges.columns if c not in ("src_id", "dst_id", "type")]
    return edges.groupBy("src_id", "dst_id", "type").agg(F.min_by(F.struct(*rest), F.coalesce("line", F.lit(0))).alias("f")).select("src_id", "dst_id", "type", "f.*")


def build_graph(files: DataFrame, passes: tuple[str, ...] = PASSES) -> Graph:
    """The graph of files (path, content, size, mtime and, if there, lang). passes: a prefix or any choice of PASSES; structure always runs.

    The scan of contents is checkpointed, as several passes read it.
    """
    if "lang" not in files.columns:
        files = files.withColumn("lang", language(F.col("path"), graph=True)).where("lang is not null")
    spark = files.sparkSession
    nodes, edges, figures = file_nodes(files), [], [("files", files)]
    occ, imported = None, None
    if {"extract", "resolve", "enrich"} & set(passes):
        scanned = cut(scan_files(files))
        occ = occurrences(scanned)
        figures.append(("symbols", occ.select("name").distinct()))
    if "extract" in passes:
        nodes = nodes.unionByName(symbol_nodes(occ))
        edges.append(_edges(occ, "parent_id", "id", "DEFINES"))
    text = extract.lines(files)
    if "resolve" in passes:
        imported = import_edges(text, files)
        calls = resolve_calls(scanned.where("kind = 'call'"), occ, imported)
        edges += [_edges(imported, "src_id", "dst_id", "IMPORTS"), calls]
        figures += [("imports", imported), ("calls", calls)]
    if "enrich" in passes:
        inherits = inherit_edges(text, occ)
        edges += [inherits, test_edges(files)]
        figures.append(("inherits", inherits))
    all_edges = spark.createDataFrame([], "src_id long, dst_id long, type string, confidence double, line int, strategy string, strategy_confidence double")
    for e in edges:
        all_edges = all_edges.unionByName(e)
    all_edges = cut(first_edges(all_edges))
    found = communities(all_edges) if "analyze" in passes else spark.createDataFrame([], "node_id long, community_id long")
    stats = None
    for key, df in figures:
        one = df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(key).alias("key"), "value")
        stats = one if stats is None else stats.unionByName(one)
    return Graph(nodes, all_edges, found, stats)
