"""Results as text: at most some hundred rows that are fetched to be read."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _rows(df: DataFrame, most: int = 200) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(most).collect()]


def _langs(m: dict) -> str:
    return ", ".join(f"{k}:{v}" for k, v in sorted((m or {}).items()))


def summary(tables: dict[str, DataFrame]) -> str:
    meta = _rows(tables["meta"])[0]
    out = [f"Files: {meta['total_files']} | Symbols: {meta['total_symbols']} | Languages: {', '.join(sorted(meta['languages'] or {}))}", "", "Entry points"]
    out += [f"  {r['path']}" for r in _rows(tables["entry_points"])] + ["", "Directories"]
    out += [f"  {r['dir']:<30} {r['file_count']:>5} files {r['size']:>8}  {_langs(r['languages'])}" for r in _rows(tables["top"])]
    return "\n".join([*out, "", "Configuration: " + ", ".join(r["path"] for r in _rows(tables["config_files"]))])


def search(df: DataFrame) -> str:
    out = []
    for r in _rows(df):
        out += [f"{r['path']}:{s['line']}  [{s['type']}] {s['name']}" for s in r["matches"] or []] or [f"{r['path']}  [{r['lang']}]"]
    return "\n".join(out) or "Nothing found."


def paths(df: DataFrame, none: str) -> str:
    return "\n".join("  " * r.get("dist", 0) + r["path"] for r in _rows(df)) or none


def timeline(df: DataFrame) -> str:
    out = []
    for r in _rows(df):
        out.append(f"{str(r['date_raw'])[:10]} {r['short']} {r['author']}: {r['message']}")
        if r.get("areas"):
            top = sorted(r["areas"].items(), key=lambda x: (-x[1], x[0]))[:5]
            out.append(f"    areas {_langs(dict(top))} | dependents {r['dependent_count']} | symbols {r['symbol_count']}")
        out += [f"    high impact: {p}" for p in (r.get("high_impact_files") or [])[:5]]
        if r.get("match_type"):
            out.append(f"    found in {r['match_type']}, impact {r.get('impact_score')}")
    return "\n".join(out) or "No commits."


def trace(df: DataFrame) -> str:
    out = []
    for r in _rows(df):
        out.append(f"{str(r['date_raw'])[:10]} {r['short']} {r['author']}: {r['message']}")
        out += [f"    {x}" for x in r["diff_lines"][:10]] + [f"    {p}: {n} dependents" for p, n in (r["impact"] or {}).items()]
    return "\n".join(out) or "No commits change it."


def impact(one: DataFrame, files: DataFrame) -> str:
    head = _rows(one)
    if not head:
        return "No such commit."
    out = [f"Impact score {head[0]['impact_score']}: {head[0]['files']} files, {head[0]['total_dependents']} dependents, {len(head[0]['symbols_affected'])} symbols"]
    for r in _rows(files, 15):
        out.append(f"  {r['path']}: {r['dependent_count']} dependents, {r['symbol_count']} symbols")
        out += [f"    <- {d}" for d in r["dependents"]]
    return "\n".join(out)


def hotspots(df: DataFrame) -> str:
    return "\n".join(f"{r['score']:>4}  {r['path']}  ({r['changes']} changes, {r['dependent_count']} dependents)" for r in _rows(df)) or "No changes."


def areas(df: DataFrame) -> str:
    return "\n".join(f"{r['area']:<30} {r['commits']:>5} commits {r['authors']:>4} authors {r['files_changed']:>5} files" for r in _rows(df))


def diff(tables: dict[str, DataFrame], form: str = "compact") -> str:
    s = _rows(tables["summary"])[0]
    out = [f"Files +{s['files_added']} -{s['files_deleted']} ~{s['files_modified']} ={s['files_unchanged']} | symbols +{s['symbols_added']} -{s['symbols_removed']}"]
    if form == "summary":
        return out[0]
    if form == "compact":
        out += [f"  {r['path']}: {r['symbol_changes']} symbol changes" for r in _rows(tables["compact"])]
    else:
        for what, most in (("added", 30), ("deleted", 30), ("modified", 50)):
            for r in _rows(tables["changes"].where(f"change = '{what}'").orderBy("path"), most):
                out.append(f"  {what}: {r['path']}")
                out += [f"    + {x['type']} {x['name']}" for x in r["symbols_added"][:5]] + [f"    - {x['type']} {x['name']}" for x in r["symbols_removed"][:5]] if what == "modified" else []
                out += [f"    imports +{x}" for x in r["imports_added"][:5]] + [f"    imports -{x}" for x in r["imports_removed"][:5]] if what == "modified" else []
    out += [f"  high impact: {r['path']} {r['out_degree_before']} -> {r['out_degree_after']} imports, {r['in_degree_after']} dependents" for r in _rows(tables["high_impact"], 30)]
    return "\n".join(out + [f"  entry point {r['change']}: {r['path']}" for r in _rows(tables["entry_changes"], 30)])


def graph_stats(df: DataFrame) -> str:
    return "\n".join(f"{r['what']:<12} {r['type'] or 'all':<20} {r['count']:>8}" for r in _rows(df.orderBy("what", "type")))


def nodes(df: DataFrame, none: str) -> str:
    return "\n".join("  " * r.get("depth", 0) + f"[{r['type']}] {r['name']} ({r['file_path']}:{r['line']})" for r in _rows(df)) or none


def architecture(tables: dict[str, DataFrame]) -> str:
    out = ["Communities"] + [f"  {r['community_id']}: {r['size']} nodes: {r['names']}" for r in _rows(tables["communities"])]
    out += ["Calls by file"] + [f"  {r['file_path']:<40} out {r['out_calls']} in {r['in_calls']}" for r in _rows(tables["call_activity"])]
    return "\n".join([*out, "Node types"] + [f"  {r['type']:<20} {r['count']:>6}" for r in _rows(tables["node_types"])])
