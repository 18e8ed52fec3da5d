"""The import graph: resolution of imports to files, dependents, and levels of dependencies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.paths import stem
from quarry.functions.staging import cut, dealt


#: A block of offers has about so many rows; a group of blocks and sources is made of so many sources at least.
BLOCK, LEAST_SOURCES, GROUPS = 1 << 19, 1000, 32


def _wanted_and_offers(imports: DataFrame, exports: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, key) and (key, dst), both distinct. A module is looked up among exported names and file stems; one that is in neither is
    looked up by what follows its last dot."""
    offers = exports.select(F.col("name").alias("key"), F.col("path").alias("dst")).unionByName(files.select(stem(F.col("path")).alias("key"), F.col("path").alias("dst"))).distinct()
    known = offers.select(F.col("key").alias("module"), F.lit(True).alias("known")).distinct()
    asked = imports.select("path", "module").distinct().join(known, "module", "left")
    key = F.when(F.col("known"), F.col("module")).otherwise(F.substring_index("module", ".", -1))
    wanted = asked.select(F.col("path").alias("src"), key.alias("key")).distinct()
    return wanted, offers.join(wanted.select("key").distinct(), "key", "left_semi")


def _grouped(imports: DataFrame, exports: DataFrame, files: DataFrame) -> DataFrame:
    """(block, chunk, side, name, items): for each block of offers and chunk of sources first the offers as (key, targets), then the sources with their keys.

    The pairs grow with the square of the files, so they are not what is shuffled: a target stands in one block with all its keys, and
    each source meets each block once, so that no pair has to be told from another afterwards.
    """
    wanted, offers = _wanted_and_offers(imports, exports, files)
    size = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    blocks = F.floor(F.col("offered") / BLOCK + 1)
    chunks = F.greatest(F.lit(1), F.least(F.floor(F.col("asked") / LEAST_SOURCES), F.floor(F.lit(GROUPS) / blocks)))
    n = size(offers, "offered").crossJoin(size(wanted, "asked")).select(blocks.alias("blocks"), chunks.alias("chunks"))  # one row with one row
    all_of = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    by = offers.crossJoin(n).withColumn("block", F.pmod(F.xxhash64("dst"), "blocks"))  # with one row
    by = by.groupBy("block", "chunks", F.col("key").alias("name")).agg(F.collect_list("dst").alias("items"))
    left = by.select("block", all_of("chunks").alias("chunk"), F.lit(0).alias("side"), "name", "items")
    own = wanted.groupBy(F.col("src").alias("name")).agg(F.collect_list("key").alias("items")).crossJoin(n)  # with one row
    right = own.select(all_of("blocks").alias("block"), F.pmod(F.xxhash64("name"), "chunks").alias("chunk"), F.lit(1).alias("side"), "name", "items")
    return left.unionByName(right).repartition("block", "chunk").sortWithinPartitions("block", "chunk", "side")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, pa.Array]]:
    """(source, numbers of its targets, all target names) for each source and block. One block of offers is held, and one row of marks."""
    at, held, names = None, [], None
    for batch in batches:
        place = np.stack([batch[c].to_numpy() for c in ("block", "chunk", "side")])
        cuts = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            part, group = batch.slice(lo, hi - lo), tuple(place[:2, lo]) if hi > lo else at
            if group != at:
                at, held, names = group, [], None
            keys = part["name"].to_pylist()
            if hi > lo and not place[2, lo]:
                held.append((keys, part["items"].value_lengths().to_numpy(), part["items"].flatten()))
                continue
            if names is None and held:
                coded = pa.concat_arrays([x for _, _, x in held]).dictionary_encode()
                names, ids = coded.dictionary, coded.indices.to_numpy()
                ends = np.cumsum(np.concatenate([n for _, n, _ in held]))
                of = {k: slice(a, b) for k, a, b in zip((k for x, _, _ in held for k in x), [0, *ends], ends, strict=False)}
                number, mark = {x: i for i, x in enumerate(names.to_pylist())}, np.zeros(len(names), bool)
                held = []
            for source, wanted in zip(keys, part["items"].to_pylist(), strict=True) if names is not None else ():
                for key in wanted:
                    if key in of:
                        mark[ids[of[key]]] = True
                if source in number:
                    mark[number[source]] = False
                found = np.flatnonzero(mark)
                mark[found] = False
                if len(found):
                    yield source, found, names


def _write_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sources, found, names = [], [], None

    def done() -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
        return pa.RecordBatch.from_arrays([pa.array(sources, pa.string()), pa.ListArray.from_arrays(pa.array(ends), names.take(pa.array(np.concatenate(found))))], ["src", "targets"])

    for source, ids, of in _met(batches):
        if sources and (names is not of or sum(map(len, found)) + len(ids) > 100_000):
            yield done()
            sources, found = [], []
        names = of
        sources.append(source)
        found.append(ids)
    if sources:
        yield done()


def _count_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[str, int]] = []
    made = lambda: pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["src", "n"])
    for source, ids, _ in _met(batches):
        rows.append((source, len(ids)))
        if len(rows) == 10_000:
            yield made()
            rows = []
    if rows:
        yield made()


def import_edges(imports: DataFrame, exports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst), distinct, src <> dst. A module is looked up among exported names and file stems; one that is in neither is
    looked up by what follows its last dot. A module that is found only in its own file gives no edge, and no second lookup."""
    return _grouped(imports, exports, files).mapInArrow(_write_edges, "src string, targets array<string>").select("src", F.explode("targets").alias("dst"))


def edge_totals(imports: DataFrame, exports: DataFrame, files: DataFrame) -> DataFrame:
    """One row (files_with_imports, import_edge_count) of the edges, which are counted where they would be made."""
    own = _grouped(imports, exports, files).mapInArrow(_count_edges, "src string, n long")
    return own.agg(F.countDistinct("src").alias("files_with_imports"), F.coalesce(F.sum("n"), F.lit(0)).alias("import_edge_count"))


def dependents(edges: DataFrame, path: str) -> DataFrame:
    """(path): files that import the given one."""
    return edges.where(F.col("dst") == path).select(F.col("src").alias("path")).distinct()


def dependent_counts(edges: DataFrame) -> DataFrame:
    """(path, dependent_count) of each file that is imported."""
    pairs = dealt(edges.where("src is not null").select(F.col("dst").alias("path"), "src"), "path", "src").distinct()
    return pairs.groupBy("path").agg(F.count(F.lit(1)).alias("dependent_count"))


def dependents_of(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, dependents): each given path with its sorted dependents, an empty list if none."""
    own = edges.join(paths.select(F.col("path").alias("dst")).distinct(), "dst", "left_semi")
    got = own.groupBy(F.col("dst").alias("path")).agg(F.sort_array(F.collect_set("src")).alias("dependents"))
    return paths.select("path").distinct().join(got, "path", "left").withColumn("dependents", F.coalesce("dependents", F.array().cast("array<string>")))


def reach(edges: DataFrame, starts: DataFrame, max_dist: int | None) -> DataFrame:
    """(start, node, dist): shortest distances from each start over edges (src, dst), itself at 0. One join a level, each level
    checkpointed; it ends when a level finds nothing new, or at max_dist."""
    seen = cut(starts.select(F.col("path").alias("start"), F.col("path").alias("node")).distinct().withColumn("dist", F.lit(0)))
    edge, front, level = edges.select(F.col("src").alias("node"), "dst"), seen, 0
    while max_dist is None or level < max_dist:
        level += 1
        step = front.join(edge, "node").select("start", F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("dist", F.lit(level)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def deps(edges: DataFrame, path: str, depth: int = 1) -> DataFrame:
    """(path, dist): files at distances 0 to depth - 1; depth 1 is the file alone."""
    start = edges.sparkSession.createDataFrame([(path,)], "path string")
    return reach(edges, start, depth - 1).select(F.col("node").alias("path"), "dist")


def deps_closure(edges: DataFrame, path: str, max_dist: int | None = None) -> DataFrame:
    """(path, dist) of everything that a file depends on, directly or not."""
    start = edges.sparkSession.createDataFrame([(path,)], "path string")
    return reach(edges, start, max_dist).where("dist > 0").select(F.col("node").alias("path"), "dist")


def impact_closure(edges: DataFrame, path: str, max_dist: int | None = None) -> DataFrame:
    """(path, dist) of everything that depends on a file, directly or not."""
    return deps_closure(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), path, max_dist)
