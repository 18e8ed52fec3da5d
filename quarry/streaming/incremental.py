"""Incremental indexing: only changed files are read again, in batches or from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.extract import directory_stats, entry_points
from quarry.operators.imports import import_edges
from quarry.operators.index import Index, build_index
from quarry.sources.store import SnapshotStore


def changed(listing: DataFrame, previous: DataFrame) -> DataFrame:
    """Listed files that the previous index doesn't have, or has with another time."""
    return listing.join(previous.select("path", "mtime"), ["path", "mtime"], "left_anti")


def merge(new: Index, old: Index, listing: DataFrame) -> Index:
    """The new entries, and the old ones of files that are still listed and weren't read again. The import graph is resolved anew."""
    there = listing.select("path").distinct()
    kept = old.files.select("path").join(there, "path", "left_semi").join(new.files.select("path"), "path", "left_anti")
    both = lambda a, b: a.unionByName(b.join(kept, "path", "left_semi"), allowMissingColumns=True)
    files, symbols, imports, exports = (both(getattr(new, t), getattr(old, t)) for t in ("files", "symbols", "imports", "exports"))
    everything = both(new.all_symbols, old.all_symbols) if new.all_symbols is not None and old.all_symbols is not None else None
    langs = files.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    meta = langs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_files"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", "n")))).alias("languages"))
    meta = meta.crossJoin(symbols.agg(F.count(F.lit(1)).alias("total_symbols")))  # one row with one row
    return Index(files, symbols, imports, exports, import_edges(imports, exports, files), entry_points(files), new.config_files, directory_stats(files), meta, everything)


def update(files: DataFrame, old: Index, listing: DataFrame | None = None) -> Index:
    """An index of files (path, content, size, mtime) that re-reads only what changed since ``old``."""
    listed = files.select("path", "mtime") if listing is None else listing
    fresh = files.join(changed(listed, old.files).select("path"), "path", "left_semi")
    return merge(build_index(fresh, listing=listed), old, listed)


def follow(spark: SparkSession, folder: str, store: SnapshotStore, checkpoint: str, snapshot_id: str = "stream") -> StreamingQuery:
    """Index a stream of Parquet files of (path, content, size, mtime): each batch is merged into the current snapshot.

    Each batch writes a snapshot of its own number, so none is read and overwritten at once. A batch that is repeated after its
    snapshot became the current one changes nothing; the snapshot before the last is dropped when the next one is there.
    """
    rows = spark.readStream.schema("path string, content string, size long, mtime long").parquet(folder)

    def add(batch: DataFrame, number: int) -> None:
        own = f"{snapshot_id}-{number}"
        known = store.resolve(None)
        if known == own:
            return
        last = batch.groupBy("path").agg(F.max_by(F.struct("content", "size", "mtime"), "mtime").alias("f")).select("path", "f.*")
        new = build_index(last)
        if known is not None:
            old = store.load(known)
            new = merge(new, old, old.files.select("path").unionByName(last.select("path")))
        store.save(new, own, branch=snapshot_id)
        if number > 1:
            store.drop(f"{snapshot_id}-{number - 2}")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
