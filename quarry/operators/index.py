"""An index: the tables that files give, and the ten read queries on them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import fixed
from quarry.functions.paths import base_name, directory_at, glob_match, language, size_label
from quarry.functions.patterns import ImportPattern, SymbolPattern
from quarry.functions.staging import cut
from quarry.operators import extract
from quarry.operators.imports import dependents, deps, edge_totals, import_edges


@dataclass
class Index:
    """files, symbols, imports, exports, import_edges, entry_points, config_files, dir_stats; meta has one row. all_symbols: before a file's symbols
    are cut down; None in snapshots from before they were stored."""

    files: DataFrame
    symbols: DataFrame
    imports: DataFrame
    exports: DataFrame
    import_edges: DataFrame
    entry_points: DataFrame
    config_files: DataFrame
    dir_stats: DataFrame
    meta: DataFrame
    all_symbols: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {name: df for name in Index.__dataclass_fields__ if (df := getattr(self, name)) is not None}

    def edge_totals(self) -> DataFrame:
        return self.import_edges.agg(F.countDistinct("src").alias("files_with_imports"), F.count(F.lit(1)).alias("import_edge_count"))


class TextIndex(Index):
    """The index of files (path, lang, content, size, mtime), each table made when it is first asked for, from those columns that it needs. ``keep`` stores
    what is read out of the texts (all_symbols, imports), so that these are read once; import edges, which may be the square of the files, are made anew."""

    def __init__(
        self,
        texts: DataFrame,
        listing: DataFrame | None = None,
        symbol_table: Sequence[SymbolPattern] | None = None,
        import_table: Sequence[ImportPattern] | None = None,
        max_symbols: int = fixed.MAX_SYMBOLS,
        keep: Callable[[str, DataFrame], DataFrame] = lambda _, df: df,
    ):
        self.texts, self.listing, self.keep, self.max_symbols = texts, texts if listing is None else listing, keep, max_symbols
        self.symbol_table, self.import_table = symbol_table, import_table

    @cached_property
    def files(self) -> DataFrame:
        return extract.entries(self.texts)

    @cached_property
    def all_symbols(self) -> DataFrame:
        return self.keep("all_symbols", extract.mark_coroutines(extract.symbols(extract.lines(self.texts), self.symbol_table), self.texts, self.symbol_table))

    @cached_property
    def symbols(self) -> DataFrame:
        return self.keep("symbols", extract.truncate(self.all_symbols, self.max_symbols))

    @cached_property
    def imports(self) -> DataFrame:
        return self.keep("imports", extract.imports(extract.lines(self.texts), self.import_table))

    @cached_property
    def exports(self) -> DataFrame:
        return extract.exports(self.all_symbols)

    @cached_property
    def import_edges(self) -> DataFrame:
        return import_edges(self.imports, self.exports, self.files)

    @cached_property
    def entry_points(self) -> DataFrame:
        return extract.entry_points(self.files)

    @cached_property
    def config_files(self) -> DataFrame:
        return extract.config_files(self.listing)

    @cached_property
    def dir_stats(self) -> DataFrame:
        return extract.directory_stats(self.files)

    @cached_property
    def meta(self) -> DataFrame:
        langs = self.files.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
        sums = langs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_files"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", "n")))).alias("languages"))
        return sums.crossJoin(self.symbols.agg(F.count(F.lit(1)).alias("total_symbols")))  # one row with one row

    def edge_totals(self) -> DataFrame:
        return edge_totals(self.imports, self.exports, self.files)


def build_index(
    files: DataFrame,
    listing: DataFrame | None = None,
    symbol_table: Sequence[SymbolPattern] | None = None,
    import_table: Sequence[ImportPattern] | None = None,
    max_symbols: int = fixed.MAX_SYMBOLS,
    graph: bool = True,
    about: dict[str, str | None] | None = None,
    staged: bool = False,
) -> Index:
    """The index of files (path, content, size, mtime and, if there, lang). listing: all paths, for configuration files.

    Everything is lazy, unless ``staged``: then symbols, imports and entries are extracted once and checkpointed, and all that
    follows from them reads these. Without ``graph`` no import is resolved. about: columns of the one row of meta, such as git_commit.
    """
    if "lang" not in files.columns:
        files = files.withColumn("lang", language(F.col("path"))).where("lang is not null")
    of = TextIndex(files, listing, symbol_table, import_table, max_symbols, keep=lambda name, df: cut(df) if staged and name != "symbols" else df)
    if staged:
        of.files = cut(of.files)
    if not graph:
        of.import_edges = files.sparkSession.createDataFrame([], "src string, dst string")
    for k, v in (about or {}).items():
        of.meta = of.meta.withColumn(k, F.lit(v))
    return Index(**of.tables())


def _holds(text: Column, part: str) -> Column:
    return F.contains(F.lower(text), F.lit(part.lower()))


def symbol(index: Index, name: str, exact: bool = False) -> DataFrame:
    """(path, line, type, name): where a symbol is defined. An exact name is looked up among all symbols of a file, a part of one among those that are kept."""
    if exact:
        own, hit = index.symbols if index.all_symbols is None else index.all_symbols, F.col("name") == name
    else:
        own, hit = index.symbols, _holds(F.col("name"), name)
    return own.where(hit).select("path", "line", "type", "name")


def first_files(index: Index) -> DataFrame:
    """(name, path): the first file, by path, that defines each symbol."""
    return index.symbols.groupBy("name").agg(F.min("path").alias("path"))


def importers(index: Index, module: str) -> DataFrame:
    """(path, module): files that import something with this text in its name, with the first such import."""
    return index.imports.where(F.contains("module", F.lit(module))).groupBy("path").agg(F.min("module").alias("module"))


def entries(index: Index) -> DataFrame:
    return index.entry_points.orderBy("path")


def dirs(index: Index, depth: int = 2) -> DataFrame:
    """(dir, file_count, total_size, languages) rolled up to ``depth`` parts."""
    return extract.roll_up(index.dir_stats, directory_at(F.col("dir"), depth))


def files(index: Index, glob: str) -> DataFrame:
    """(path, lang, symbols, n_symbols) of paths that match; if none does, of those whose base name matches. symbols: the first five."""
    paths = index.files.where(glob_match(F.col("path"), glob))
    bases = index.files.where(glob_match(base_name(F.col("path")), glob))
    none = paths.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(1).alias("one"))
    hit = paths.unionByName(bases.withColumn("one", F.lit(1)).join(none, "one", "left_semi").drop("one"))
    label = F.transform(F.slice(F.sort_array("__all"), 1, 5), lambda s: F.concat(s["type"], F.lit(":"), s["name"]))
    own = index.symbols.groupBy("path").agg(F.collect_list(F.struct("line", "type", "name")).alias("__all"))
    own = own.select("path", label.alias("symbols"), F.size("__all").alias("n_symbols"))
    out = hit.select("path", "lang").join(own, "path", "left")
    return out.select("path", "lang", F.coalesce("symbols", F.array().cast("array<string>")).alias("symbols"), F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"))


def search(index: Index, query: str, lang: str | None = None, type: str | None = None, limit: int = 20) -> DataFrame:
    """(path, lang, n_matches, path_match, score, matches): files by symbols and path that hold the query, twice as much for a symbol.

    A path that matches counts whatever the type. matches: the first five symbols. By score, then path; at most ``limit`` files.
    """
    own = index.files if lang is None else index.files.where(F.col("lang") == lang)
    hit = index.symbols.where(_holds(F.col("name"), query))
    hit = hit if type is None else hit.where(F.col("type") == type)
    hit = hit.groupBy("path").agg(F.count(F.lit(1)).alias("n_matches"), F.sort_array(F.collect_list(F.struct("line", "type", "name"))).alias("all"))
    out = own.select("path", "lang").join(hit, "path", "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))
    out = out.withColumn("path_match", _holds(F.col("path"), query)).where("n_matches > 0 or path_match")
    out = out.withColumn("score", 2 * F.col("n_matches") + F.col("path_match").cast("int")).withColumn("matches", F.slice("all", 1, 5))
    return out.select("path", "lang", "n_matches", "path_match", "score", "matches").orderBy(F.desc("score"), "path").limit(limit)


def dependencies(index: Index, path: str, depth: int = 1) -> DataFrame:
    return deps(index.import_edges, path, depth)


def dependent_files(index: Index, path: str) -> DataFrame:
    return dependents(index.import_edges, path)


def stats(index: Index) -> DataFrame:
    """One row: meta, and counts of entry points, configuration files, files with imports and import edges."""
    count = lambda df, name, what=F.lit(1): df.agg(F.count(what).alias(name))
    return index.meta.crossJoin(count(index.entry_points, "entry_point_count")).crossJoin(count(index.config_files, "config_file_count")).crossJoin(index.edge_totals())


def languages(index: Index) -> DataFrame:
    """(lang, files), most first."""
    return index.files.groupBy("lang").agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "lang")


def summary(index: Index) -> dict[str, DataFrame]:
    """meta, the first ten entry points, directories at the top with size labels, the first eight configuration files."""
    top = extract.roll_up(index.dir_stats, F.split_part("dir", F.lit("/"), F.lit(1)))
    return {
        "meta": index.meta,
        "entry_points": entries(index).limit(10),
        "top": top.withColumn("size", size_label(F.col("total_size"))).orderBy("dir"),
        "config_files": index.config_files.orderBy("path").limit(8),
    }
