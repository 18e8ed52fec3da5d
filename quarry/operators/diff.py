"""Symbol-level difference of two indices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import fixed
from quarry.operators.index import Index

_SYMBOLS = "array<struct<type:string,name:string>>"


def _entry(index: Index) -> DataFrame:
    own = index.symbols.groupBy("path").agg(F.collect_set(F.struct("type", "name")).alias("symbols"))
    modules = index.imports.groupBy("path").agg(F.collect_set("module").alias("imports"))
    out = index.files.select("path", "size", "lines").join(own, "path", "left").join(modules, "path", "left")
    return out.select("path", F.struct("size", "lines", F.coalesce("symbols", F.array().cast(_SYMBOLS)).alias("symbols"), F.coalesce("imports", F.array().cast("array<string>")).alias("imports")).alias("e"))


def file_changes(base: Index, target: Index) -> DataFrame:
    """(path, change, size_delta, lines_delta, symbols_added, symbols_removed, imports_added, imports_removed) of every path in
    either: added, deleted, modified (any symbol or import change, or more than 50 bytes) or unchanged. Lists are whole and sorted."""
    b, t = _entry(base).withColumnRenamed("e", "b"), _entry(target).withColumnRenamed("e", "t")
    both = b.join(t, "path", "full_outer")
    none = {"symbols": F.array().cast(_SYMBOLS), "imports": F.array().cast("array<string>")}
    own = lambda x, f: F.coalesce(F.col(f"{x}.{f}"), none[f])
    less = lambda x, y, f: F.sort_array(F.array_except(own(x, f), own(y, f)))
    out = both.select(
        "path", F.col("b").isNull().alias("new"), F.col("t").isNull().alias("gone"), (F.col("t.size") - F.col("b.size")).alias("size_delta"), (F.col("t.lines") - F.col("b.lines")).alias("lines_delta"),
        less("t", "b", "symbols").alias("symbols_added"), less("b", "t", "symbols").alias("symbols_removed"), less("t", "b", "imports").alias("imports_added"), less("b", "t", "imports").alias("imports_removed"),
    )
    lists = ["symbols_added", "symbols_removed", "imports_added", "imports_removed"]
    changed = F.abs("size_delta") > fixed.SIZE_CHANGE
    for c in lists:
        changed = changed | (F.size(c) > 0)
    change = F.when(F.col("new"), "added").when(F.col("gone"), "deleted").when(changed, "modified").otherwise("unchanged")
    return out.select("path", change.alias("change"), "size_delta", "lines_delta", *lists)


def capped(changes: DataFrame) -> DataFrame:
    """Modified files with lists cut to 20 symbols and 10 imports, as they are shown."""
    out = changes.where("change = 'modified'")
    for c, n in (("symbols", fixed.DIFF_SYMBOLS), ("imports", fixed.DIFF_IMPORTS)):
        for way in ("added", "removed"):
            out = out.withColumn(f"{c}_{way}", F.slice(f"{c}_{way}", 1, n))
    return out


def summarise(changes: DataFrame) -> DataFrame:
    """One row of counters; symbols_added and symbols_removed count whole lists of modified files, capped_* the lists as they are shown."""
    mod = F.col("change") == "modified"
    count = lambda c: F.count_if(F.col("change") == c).alias(f"files_{c}")
    total = lambda c, n: F.coalesce(F.sum(F.when(mod, F.least(F.size(c), F.lit(n)) if n else F.size(c))), F.lit(0))
    return changes.agg(
        count("added"), count("deleted"), count("modified"), count("unchanged"), total("symbols_added", None).alias("symbols_added"), total("symbols_removed", None).alias("symbols_removed"),
        total("symbols_added", fixed.DIFF_SYMBOLS).alias("capped_symbols_added"), total("symbols_removed", fixed.DIFF_SYMBOLS).alias("capped_symbols_removed"),
    )


def entry_changes(base: Index, target: Index) -> DataFrame:
    """(path, change) of entry points that came or went."""
    added = target.entry_points.join(base.entry_points, "path", "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(base.entry_points.join(target.entry_points, "path", "left_anti").withColumn("change", F.lit("removed")))


def high_impact(changes: DataFrame, base_edges: DataFrame, target_edges: DataFrame) -> DataFrame:
    """(path, out_degree_before, out_degree_after, in_degree_before, in_degree_after, new_high_impact): modified files whose number
    of imports changed by more than 2, and new files with 5 or more; by the size of the change."""
    degree = lambda e, c, name: e.groupBy(F.col(c).alias("path")).agg(F.count(F.lit(1)).alias(name))
    out = changes.where("change in ('modified', 'added')").select("path", "change")
    names = [("out_degree_before", base_edges, "src"), ("out_degree_after", target_edges, "src"), ("in_degree_before", base_edges, "dst"), ("in_degree_after", target_edges, "dst")]
    for name, edges, c in names:
        out = out.join(degree(edges, c, name), "path", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    out = out.withColumn("new_high_impact", F.col("change") == "added").withColumn("out_degree_before", F.when(F.col("new_high_impact"), 0).otherwise(F.col("out_degree_before")))
    change = F.abs(F.col("out_degree_after") - F.col("out_degree_before"))
    keep = (~F.col("new_high_impact") & (change > fixed.DEGREE_CHANGE)) | (F.col("new_high_impact") & (F.col("out_degree_after") >= fixed.HIGH_IMPACT))
    return out.where(keep).drop("change").orderBy(change.desc(), "path")


def most_changed(changes: DataFrame, top: int = 10) -> DataFrame:
    """(path, symbol_changes) of the modified files with most added and removed symbols."""
    return changes.where("change = 'modified'").select("path", (F.size("symbols_added") + F.size("symbols_removed")).alias("symbol_changes")).orderBy(F.desc("symbol_changes"), "path").limit(top)


def diff(base: Index, target: Index) -> dict[str, DataFrame]:
    """All tables of a difference: base, target, summary, changes, modified, entry_changes, high_impact, compact."""
    changes = file_changes(base, target)
    return {
        "base": base.meta, "target": target.meta, "summary": summarise(changes), "changes": changes, "modified": capped(changes), "entry_changes": entry_changes(base, target),
        "high_impact": high_impact(changes, base.import_edges, target.import_edges), "compact": most_changed(changes),
    }


def to_json(tables: dict[str, DataFrame]) -> DataFrame:
    """(part, json): every row of a difference as JSON."""
    out = None
    for name, df in tables.items():
        own = df.select(F.lit(name).alias("part"), F.to_json(F.struct(*df.columns)).alias("json"))
        out = own if out is None else out.unionByName(own)
    return out
