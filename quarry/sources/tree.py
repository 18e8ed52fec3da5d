"""Files of a source tree: listed first, then read by executors, so ignored files are never opened."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import fixed
from quarry.functions.paths import gitignore_patterns, is_ignored, language
from quarry.functions.patterns import extensions, ignored

LISTING = "path string, location string, size long, mtime long"


def read_gitignore(root: str) -> list[str]:
    try:
        with open(os.path.join(root, ".gitignore"), encoding="utf-8", errors="ignore") as f:
            return gitignore_patterns(f)
    except OSError:
        return []


def walk(root: str, follow_symlinks: bool = False, extra: Iterable[str] = (), graph: bool = False) -> Iterator[tuple[str, str, int, int]]:
    """(path, location, size, mtime) below a local folder; ignored and dotted folders are not entered."""
    skipped = {*ignored(graph)[0], *extra}
    for at, folders, names in os.walk(root, followlinks=follow_symlinks):
        folders[:] = sorted(d for d in folders if d not in skipped and not d.startswith("."))
        for name in sorted(names):
            full = os.path.join(at, name)
            try:
                stat = os.stat(full)
            except OSError:
                continue
            yield os.path.relpath(full, root), "file://" + os.path.abspath(full), stat.st_size, int(stat.st_mtime)


def list_tree(spark: SparkSession, root: str, follow_symlinks: bool = False, extra: Iterable[str] = (), graph: bool = False) -> DataFrame:
    """All files below a local folder (path, location, size, mtime), pruned while walking."""
    return spark.createDataFrame(list(walk(root, follow_symlinks, extra, graph)), LISTING)


def source_files(listing: DataFrame, extra: Iterable[str] = (), graph: bool = False) -> DataFrame:
    """The listed files that are source and not ignored, with their language."""
    kept = listing.where(~is_ignored(F.col("path"), extra, graph))
    return kept.withColumn("lang", language(F.col("path"), graph)).where("lang is not null")


@F.pandas_udf(T.StringType())
def decode(content: pd.Series) -> pd.Series:
    """UTF-8 without what doesn't decode, line ends as \\n."""
    text = content.map(lambda b: bytes(b).decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n"))
    return text.astype("object")


def read_listed(files: DataFrame) -> DataFrame:
    """Contents of source files (path, location, size, mtime, lang): only these are opened."""
    spark = files.sparkSession
    places = [r["location"] for r in files.select("location").collect()]  # paths for the reader, as any file listing on the driver
    if not places:
        return files.drop("location").withColumn("content", F.lit(None).cast("string"))
    parts = [spark.read.format("binaryFile").load(places[i : i + 10_000]) for i in range(0, len(places), 10_000)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return files.join(whole.select(plain(F.col("path")).alias("__at"), decode("content").alias("content")), plain(F.url_decode(F.col("location"))) == F.url_decode(F.col("__at"))).drop("location", "__at")


def read_tree(spark: SparkSession, root: str, follow_symlinks: bool = False, graph: bool = False) -> DataFrame:
    """(path, lang, size, mtime, content) of the source files below a local folder, its .gitignore heeded unless for the graph."""
    extra = [] if graph else read_gitignore(root)
    return read_listed(source_files(list_tree(spark, root, follow_symlinks, extra, graph), extra, graph))


def read_remote(spark: SparkSession, root: str, graph: bool = False) -> DataFrame:
    """As read_tree for a folder in any store that Spark reads. Names are filtered before files are opened; paths after."""
    glob = "{" + ",".join(["*" + e for e in extensions()] + list(fixed.MAKEFILES)) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    bare = re.sub("^[A-Za-z0-9+.-]+:/*", "", root.rstrip("/")).lstrip("/")
    path = F.substring(F.regexp_replace("path", "^[A-Za-z0-9+.-]+:/*", ""), len(bare) + 2, 2147483647)
    rows = raw.select(path.alias("path"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"), decode("content").alias("content"))
    return source_files(rows, graph=graph)
