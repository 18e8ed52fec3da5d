"""Lines, symbols, imports and entries from file contents."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import fixed
from quarry.functions.paths import base_name, directory, stem
from quarry.functions.patterns import ImportPattern, SymbolPattern, import_patterns, symbol_patterns, words

#: \w, \s and \b as for Unicode text, and a dot that stops at \n only.
UNICODE = "(?Ud)"


def lines(files: DataFrame) -> DataFrame:
    """(path, lang, line, text): lines from 1, split at \\n, trailing empty ones included."""
    cut = F.split("content", "\n", -1)
    return files.select("path", "lang", F.posexplode(cut).alias("__at", "text")).select("path", "lang", (F.col("__at") + 1).alias("line"), "text")


def _by_language(patterns: Sequence, lang: Column, build) -> Column:
    out = F.lit(None)
    for name in dict.fromkeys(p.lang for p in patterns):
        out = F.when(lang == name, build([p for p in patterns if p.lang == name])).otherwise(out)
    return out


def match(text: Column, regex: str, group: int) -> Column:
    """The group's text in the first match, null without one. Evaluated once, so a long choice of patterns stays small code."""
    return F.get(F.regexp_extract_all(text, F.lit(UNICODE + regex), F.lit(group)), F.lit(0))


def symbols(of: DataFrame, patterns: Sequence[SymbolPattern] | None = None) -> DataFrame:
    """(path, lang, line, type, name) from lines: the first pattern of the language that matches wins. A projection, nothing is shuffled."""
    table = symbol_patterns() if patterns is None else patterns
    # type and name travel as one string, which is null where the name is
    first = lambda own: F.coalesce(*[F.concat(F.lit(p.type + "\n"), match(F.col("text"), p.regex, p.group)) for p in own], F.lit(None))
    # exploding keeps the long expression from being repeated in the filter and in what is made of it
    found = of.select("path", "lang", "line", F.explode(F.array_compact(F.array(_by_language(table, F.col("lang"), first)))).alias("__s"))
    cut = F.split("__s", "\n", 2)
    return found.select("path", "lang", "line", F.get(cut, F.lit(0)).alias("type"), F.get(cut, F.lit(1)).alias("name")).where("name <> ''")


def imports(of: DataFrame, patterns: Sequence[ImportPattern] | None = None) -> DataFrame:
    """(path, module), distinct, from lines: all groups of all patterns of the language, quotes stripped."""
    table = import_patterns() if patterns is None else patterns
    groups = lambda own: F.array(*[F.regexp_extract("text", UNICODE + p.regex, g) for p in own for g in p.groups])
    found = of.select("path", F.explode(_by_language(table, F.col("lang"), groups)).alias("module"))
    return found.where("module <> ''").select("path", F.btrim("module", F.lit("'\"")).alias("module")).distinct()


_SUSPENDS = re.compile(r"\bco_(?:await|return|yield)\b")


def coroutine_lines(content: str, starts: list[int]) -> list[int]:
    """Of the function lines ``starts`` those whose braced body, on later lines, suspends. A body must open on its first line."""
    begin, found, open_at, depth = set(starts), [], 0, 0
    for at, line in enumerate(content.split("\n"), 1):
        change = line.count("{") - line.count("}")
        if not open_at:
            if at in begin and change > 0:
                open_at, depth = at, change
            continue
        depth += change
        if _SUSPENDS.search(line) and (not found or found[-1] != open_at):
            found.append(open_at)
        if depth <= 0:
            open_at = 0
    return found


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _coroutines(content: pd.Series, starts: pd.Series) -> pd.Series:
    return pd.Series([coroutine_lines(c, list(s)) for c, s in zip(content, starts, strict=True)])


def mark_coroutines(found: DataFrame, files: DataFrame, patterns: Sequence[SymbolPattern] | None = None) -> DataFrame:
    """symbols with ``is_coroutine``; C and C++ functions whose body suspends become type ``coroutine``. Where the patterns have neither language there is nothing to join."""
    if not {"cpp", "c"} & {p.lang for p in (symbol_patterns() if patterns is None else patterns)}:
        return found.withColumn("is_coroutine", F.lit(None).cast("boolean"))
    body = F.col("lang").isin("cpp", "c") & F.col("type").isin("function", "method", "coroutine")
    starts = found.where(body).groupBy("path").agg(F.collect_set("line").alias("starts"))
    hits = files.where(F.col("lang").isin("cpp", "c")).select("path", "content").join(starts, "path").select("path", F.explode(_coroutines("content", "starts")).alias("line"))
    marked = found.join(hits.withColumn("is_coroutine", F.lit(True)), ["path", "line"], "left")
    return marked.withColumn("type", F.when(F.col("is_coroutine") & body, "coroutine").otherwise(F.col("type"))).select("path", "lang", "line", "type", "name", F.when(body, F.col("is_coroutine")).alias("is_coroutine"))


def exports(of_symbols: DataFrame) -> DataFrame:
    """(path, name), distinct: names of exported types, before a file's symbols are cut down."""
    return of_symbols.where(F.col("type").isin(*words(fixed.EXPORTED))).select("path", "name").distinct()


def truncate(of_symbols: DataFrame, most: int = fixed.MAX_SYMBOLS) -> DataFrame:
    """At most ``most`` symbols of a file; in a longer list the types that matter most stay first, each part by line."""
    by = Window.partitionBy("path").orderBy(F.col("type").isin(*words(fixed.KEPT_FIRST)).cast("int").desc(), "line")
    return of_symbols.withColumn("__rank", F.row_number().over(by)).where(F.col("__rank") <= most).drop("__rank")


def entries(files: DataFrame) -> DataFrame:
    """One row for each file: path, base, stem, dir, lang, size, lines, truncated (never: contents are read whole), mtime."""
    n = F.length("content") - F.length(F.replace(F.col("content"), F.lit("\n"), F.lit(""))) + 1
    return files.select(
        "path", base_name(F.col("path")).alias("base"), stem(F.col("path")).alias("stem"), directory(F.col("path")).alias("dir"), "lang", "size",
        n.cast("int").alias("lines"), F.lit(False).alias("truncated"), "mtime",
    )


def entry_points(files: DataFrame) -> DataFrame:
    """(path), distinct: base names that mark an entry point, and paths with a directory that does."""
    names = words(fixed.ENTRY_NAMES)
    out = base_name(F.col("path")).isin(*names)
    for d in (x for x in names if x.endswith("/")):
        out = out | F.concat(F.lit("/"), "path").contains("/" + d)
    return files.where(out).select("path").distinct()


def config_files(listing: DataFrame) -> DataFrame:
    """(path) of a whole listing of relative paths: configuration files at the top, and files directly in configuration directories."""
    names = words(fixed.CONFIG_NAMES)
    out = F.col("path").isin(*[x for x in names if not x.endswith("/")])
    for d in (x for x in names if x.endswith("/")):
        out = out | F.col("path").rlike("^" + re.escape(d) + "[^/]+$")
    return listing.where(out).select("path").distinct()


def directory_stats(of_entries: DataFrame) -> DataFrame:
    """(dir, file_count, total_size, languages): partial counts by language first, so a large directory is a few rows."""
    part = of_entries.groupBy("dir", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    return _merged(part, "dir")


def _merged(part: DataFrame, key: str) -> DataFrame:
    both = F.sort_array(F.collect_list(F.struct("lang", "n")))
    return part.groupBy(key).agg(F.sum("n").alias("file_count"), F.sum("size").alias("total_size"), F.map_from_entries(both).alias("languages"))


def roll_up(stats: DataFrame, key: Column) -> DataFrame:
    """Directory statistics summed by another key (column ``dir``)."""
    part = stats.select(key.alias("dir"), F.col("file_count").alias("n"), F.col("total_size").alias("size"), "languages")
    sizes = part.groupBy("dir").agg(F.sum("n").alias("file_count"), F.sum("size").alias("total_size"))
    langs = part.select("dir", F.explode("languages").alias("lang", "n")).groupBy("dir", "lang").agg(F.sum("n").alias("n"))
    langs = langs.groupBy("dir").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", "n")))).alias("languages"))
    return sizes.join(langs, "dir")
