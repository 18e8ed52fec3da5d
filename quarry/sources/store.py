"""Snapshots: indices by commit and branch as Parquet partitions, and the table of references to them; JSON in and out."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.graph import Graph
from quarry.operators.graph_query import node_tokens
from quarry.operators.index import Index

REFS = "ref string, kind string, snapshot_id string, at long"
_ENTRY = "array<struct<type:string,name:string,line:int,is_coroutine:boolean>>"
TABLES = {
    "files": "path string, base string, stem string, dir string, lang string, size long, lines int, truncated boolean, mtime long",
    "symbols": "path string, lang string, line int, type string, name string, is_coroutine boolean",
    "all_symbols": "path string, lang string, line int, type string, name string, is_coroutine boolean",
    "imports": "path string, module string",
    "exports": "path string, name string",
    "import_edges": "src string, dst string",
    "entry_points": "path string",
    "config_files": "path string",
    "dir_stats": "dir string, file_count long, total_size long, languages map<string,bigint>",
}
DOCUMENT = f"""
meta struct<root:string,indexed_at:long,build_time_ms:long,total_files:long,total_symbols:long,languages:map<string,bigint>,git_commit:string,
git_short_commit:string,git_branch:string,git_tag:string,git_describe:string,git_dirty:boolean>,
files array<struct<path:string,size:bigint,lines:int,mtime:bigint,lang:string,symbols:{_ENTRY},imports:array<string>,exports:array<string>>>,
import_graph map<string,array<string>>, entry_points array<string>, config_files array<string>,
dir_map map<string,struct<file_count:bigint,total_size:bigint,languages:map<string,bigint>>>
"""


class SnapshotStore:
    """A folder, local or in any store that Spark reads: one Parquet table for each table of an index, partitioned by snapshot, and refs.

    A snapshot is written by overwriting its own folders only. References are appended with a time; the latest row of each counts,
    so a branch name may hold slashes and indexing an old commit moves no branch unless asked to.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, name: str, snapshot_id: str) -> str:
        return f"{self.root}/{name}/snapshot_id={snapshot_id}"

    def refs(self) -> DataFrame:
        try:
            rows = self.spark.read.schema(REFS).parquet(f"{self.root}/refs")
            return rows.groupBy("ref", "kind").agg(F.max_by("snapshot_id", "at").alias("snapshot_id"))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], "ref string, kind string, snapshot_id string")

    def _write(self, name: str, df: DataFrame, snapshot_id: str) -> None:
        row = df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "void"})
        key = [c for c in ("path", "src", "dir") if c in df.columns][:1]
        row = row.sortWithinPartitions(*key) if key else row  # so that lookups by key skip row groups
        row.write.mode("overwrite").parquet(self._at(name, snapshot_id))

    def _read(self, name: str, snapshot_id: str) -> DataFrame:
        return (self.spark.read.schema(TABLES[name]) if name in TABLES else self.spark.read).parquet(self._at(name, snapshot_id))

    def keep(self, name: str, df: DataFrame, snapshot_id: str) -> DataFrame:
        """One table of a snapshot, written and read from there; no reference leads to it."""
        self._write(name, df, snapshot_id)
        return self._read(name, snapshot_id)

    def save(self, index: Index, snapshot_id: str, branch: str | None = None, current: bool = True) -> None:
        """Write an index; its commit, its branch if given, and the current snapshot then refer to it."""
        for name, df in index.tables().items():
            self._write(name, df, snapshot_id)
        at = time.time_ns()
        rows = [(snapshot_id, "commit", snapshot_id, at)] + ([(branch, "branch", snapshot_id, at)] if branch else []) + ([("current", "current", snapshot_id, at)] if current else [])
        self.spark.createDataFrame(rows, REFS).coalesce(1).write.mode("append").parquet(f"{self.root}/refs")

    def resolve(self, ref: str | None, fallback_current: bool = False) -> str | None:
        """The snapshot of a reference: an exact commit, then the beginning of one, then a branch, then (if asked for, or for None) the current one."""
        name = F.lit(ref)
        priority = F.when((F.col("kind") == "commit") & (F.col("ref") == name), 0).when((F.col("kind") == "commit") & F.startswith("ref", name), 1).when((F.col("kind") == "branch") & (F.col("ref") == name), 2)
        if fallback_current or ref in (None, "current"):
            priority = priority.when(F.col("kind") == "current", 3)
        got = self.refs().withColumn("p", priority).where("p is not null").agg(F.min_by("snapshot_id", F.struct("p", "ref")).alias("s")).first()
        return got["s"]

    def load(self, ref: str | None = None, fallback_current: bool = False) -> Index:
        """An index by reference; partitions of other snapshots are not read."""
        snapshot = self.resolve(ref, fallback_current)
        if snapshot is None:
            raise KeyError(f"no snapshot for {ref!r}")
        return Index(**{name: df for name in Index.__dataclass_fields__ if (df := self._there(name, snapshot)) is not None})

    def _there(self, name: str, snapshot_id: str) -> DataFrame | None:
        """A table of a snapshot; None for all_symbols of one from before they were stored."""
        try:
            return self._read(name, snapshot_id)
        except Exception as e:
            if name != "all_symbols" or "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def drop(self, snapshot_id: str) -> None:
        """Delete a snapshot's tables; references to it stay and are resolved no more once others took their place."""
        context = self.spark.sparkContext
        for name in Index.__dataclass_fields__:
            there = context._jvm.org.apache.hadoop.fs.Path(self._at(name, snapshot_id))
            there.getFileSystem(context._jsc.hadoopConfiguration()).delete(there, True)

    def save_graph(self, graph: Graph, graph_id: str) -> None:
        """Write a graph and the tokens of its nodes, each sorted by what it is looked up by; it is the current graph then."""
        tables = {"nodes": (graph.nodes, "id"), "edges": (graph.edges, "src_id"), "communities": (graph.communities, "community_id"), "stats": (graph.stats, "key"), "tokens": (node_tokens(graph.nodes), "token")}
        for name, (df, key) in tables.items():
            df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{self.root}/graph/{name}/graph_id={graph_id}")
        self.spark.createDataFrame([("current", "graph", graph_id, time.time_ns())], REFS).coalesce(1).write.mode("append").parquet(f"{self.root}/refs")

    def load_graph(self) -> Graph | None:
        """The current graph, read as far as queries ask for it; None where there is none."""
        got = self.refs().where("kind = 'graph'").first()
        if got is None:
            return None
        read = lambda name: self.spark.read.parquet(f"{self.root}/graph/{name}/graph_id={got['snapshot_id']}")
        return Graph(*(read(name) for name in ("nodes", "edges", "communities", "stats", "tokens")))

    def snapshots(self) -> DataFrame:
        """Every reference with the figures of its snapshot."""
        refs = self.refs()
        if refs.isEmpty():
            return refs
        meta = self.spark.read.schema("total_files long, total_symbols long, snapshot_id string").parquet(f"{self.root}/meta")
        return refs.join(meta.select("snapshot_id", "total_files", "total_symbols"), "snapshot_id", "left").orderBy("kind", "ref")


def read_document(spark: SparkSession, path: str) -> Index:
    """An index from one JSON document."""
    doc = spark.read.schema(DOCUMENT).json(path, multiLine=True)
    from quarry.functions.paths import base_name, directory, stem

    files = doc.select(F.explode("files").alias("f")).select("f.*")
    p = F.col("path")
    entries = files.select("path", base_name(p).alias("base"), stem(p).alias("stem"), directory(p).alias("dir"), "lang", "size", "lines", (F.col("lines") < 0).alias("truncated"), "mtime")
    symbols = files.select("path", "lang", F.explode("symbols").alias("s")).select("path", "lang", "s.line", "s.type", "s.name", "s.is_coroutine")
    each = lambda c, name: files.select("path", F.explode(c).alias(name)).distinct()
    edges = doc.select(F.explode("import_graph").alias("src", "to")).select("src", F.explode("to").alias("dst"))
    dirs = doc.select(F.explode("dir_map").alias("dir", "d")).select("dir", "d.*")
    plain = lambda c: doc.select(F.explode(c).alias("path"))
    return Index(entries, symbols, each("imports", "module"), each("exports", "name"), edges, plain("entry_points"), plain("config_files"), dirs, doc.select("meta.*"))


def file_entries(index: Index) -> DataFrame:
    """One nested row for each file, as in a document: for ``write.json`` as lines."""
    symbols = index.symbols.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", "type", "name"))).alias("symbols"))
    names = lambda df, c, to: df.groupBy("path").agg(F.sort_array(F.collect_set(c)).alias(to))
    out = index.files.select("path", "size", "lines", "mtime", "lang").join(symbols, "path", "left").join(names(index.imports, "module", "imports"), "path", "left")
    return out.join(names(index.exports, "name", "exports"), "path", "left").orderBy("path")


def export_document(index: Index) -> str:
    """The whole index as one JSON document: for small indices, as it is built on the driver."""
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    graph: dict[str, list[str]] = {}
    for r in index.import_edges.orderBy("src", "dst").collect():
        graph.setdefault(r["src"], []).append(r["dst"])
    return json.dumps({
        "meta": rows(index.meta)[0], "files": rows(file_entries(index)), "import_graph": graph, "entry_points": [r["path"] for r in index.entry_points.orderBy("path").collect()],
        "config_files": [r["path"] for r in index.config_files.orderBy("path").collect()], "dir_map": {r["dir"]: r.asDict(recursive=True) for r in index.dir_stats.orderBy("dir").collect()},
    })
