"""Queries on the graph: search, neighbours, traces, dead code, statistics, architecture."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.staging import cut
from quarry.operators.graph import Graph

NODE = ["id", "type", "name", "file_path", "line", "lang"]


def get_node(nodes: DataFrame, id_: int) -> DataFrame:
    return nodes.where(F.col("id") == id_)


def _token_text(text: Column) -> Column:
    """The tokens of a text, lower-cased, between blanks: letters and digits, split at everything else."""
    return F.concat(F.lit(" "), F.array_join(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""), " "), F.lit(" "))


def node_tokens(nodes: DataFrame) -> DataFrame:
    """(token, id), distinct: the tokens of each node's name, type and path."""
    texts = F.concat_ws(" ", "name", "type", "file_path")
    return nodes.select(F.explode(F.split(F.trim(_token_text(texts)), " ")).alias("token"), "id").where("token <> ''").distinct()


def find_nodes(
    nodes: DataFrame, name: str | None = None, type: str | None = None, file_path: str | None = None, limit: int = 200, tokens: DataFrame | None = None
) -> DataFrame:
    """Nodes by name, type and file. A name is looked up as token prefix in name, type and path; where that finds nothing, or the name
    is no plain words, as a part of the name in any case. In the order of file, line, name. tokens: a stored token table, which
    then says which nodes are looked at."""
    own = nodes
    if type is not None:
        own = own.where(F.col("type") == type)
    if file_path is not None:
        own = own.where(F.col("file_path") == file_path)
    if not name:
        return own.select(*NODE).orderBy("file_path", "line", "name", "type", "id").limit(limit)
    part = own.where(F.col("name").ilike(f"%{name}%"))
    phrases = [re.findall(r"[^\W_]+", w.lower()) for w in name.removesuffix("*").split()]
    if not re.fullmatch(r"[\w\s]+\*?", name) or not all(phrases):
        return part.select(*NODE).orderBy("file_path", "line", "name", "type", "id").limit(limit)
    hit, near = F.lit(True), own
    if tokens is not None:
        for i, p in enumerate(phrases):
            for k, word in enumerate(p):
                last = i == len(phrases) - 1 and k == len(p) - 1
                near = near.join(tokens.where(F.startswith("token", F.lit(word)) if last else F.col("token") == word).select("id").distinct(), "id", "left_semi")
    for i, p in enumerate(phrases):
        wanted = " " + " ".join(p) + ("" if i == len(phrases) - 1 else " ")
        hit = hit & (_token_text(F.col("name")).contains(wanted) | _token_text(F.col("type")).contains(wanted) | _token_text(F.col("file_path")).contains(wanted))
    found = near.where(hit)
    none = found.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(1).alias("one"))
    both = found.select(*NODE).unionByName(part.withColumn("one", F.lit(1)).join(none, "one", "left_semi").select(*NODE))
    return both.orderBy("file_path", "line", "name", "type", "id").limit(limit)


def neighbors(graph: Graph, ids: DataFrame, edge_type: str | None = None, direction: str = "outbound") -> DataFrame:
    """(id, node_id, edge_type, node_type, name, file_path, line, direction) for each id in ids; ``both`` is the union of the two ways."""
    own = graph.edges if edge_type is None else graph.edges.where(F.col("type") == edge_type)
    out = None
    for way, a, b in (("outbound", "src_id", "dst_id"), ("inbound", "dst_id", "src_id")):
        if direction in (way, "both"):
            step = own.select(F.col(a).alias("id"), F.col(b).alias("node_id"), F.col("type").alias("edge_type")).join(ids.select("id").distinct(), "id", "left_semi")
            named = graph.nodes.select(F.col("id").alias("node_id"), F.col("type").alias("node_type"), "name", "file_path", "line")
            part = step.join(named, "node_id").select("id", "node_id", "edge_type", "node_type", "name", "file_path", "line", F.lit(way).alias("direction"))
            out = part if out is None else out.unionByName(part)
    return out


def _calls(graph: Graph, direction: str) -> DataFrame:
    a, b = ("src_id", "dst_id") if direction == "outbound" else ("dst_id", "src_id")
    own = graph.edges.where("type = 'CALLS'")
    steps = own.select(F.col(a).alias("node_id"), F.col(b).alias("next"))
    return steps if direction != "both" else steps.unionByName(own.select(F.col("dst_id").alias("node_id"), F.col("src_id").alias("next")))


def trace_calls(graph: Graph, starts: DataFrame, max_depth: int = 3, direction: str = "outbound") -> DataFrame:
    """(start, node_id, depth, trail, type, name, file_path, line): what is reached over calls, each node at its least depth, with the least trail
    of ids that leads there. One join a level, checkpointed."""
    seen = cut(starts.select(F.col("id").alias("start"), F.col("id").alias("node_id")).distinct().withColumn("depth", F.lit(0)).withColumn("trail", F.array().cast("array<bigint>")))
    steps, front = _calls(graph, direction), seen
    for depth in range(1, max_depth + 1):
        step = front.join(steps, "node_id").select("start", F.col("next").alias("n"), F.array_append("trail", F.col("node_id")).alias("trail"))
        step = step.groupBy("start", F.col("n").alias("node_id")).agg(F.min("trail").alias("trail"))
        front = cut(step.join(seen.select("start", "node_id"), ["start", "node_id"], "left_anti").select("start", "node_id", F.lit(depth).alias("depth"), "trail"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    named = graph.nodes.select(F.col("id").alias("node_id"), "type", "name", "file_path", "line")
    return seen.join(named, "node_id").select("start", "node_id", "depth", "trail", "type", "name", "file_path", "line")


def trace_edges(graph: Graph, name: str, depth: int = 3, direction: str = "outbound", starts: int = 5, fan_out: int = 20) -> DataFrame:
    """(start, depth, node_id, type, name, file_path, line) as a trace is listed: up to five symbols of the name, all edges of each node reached
    within ``depth`` (so one level more than it), twenty a node at most, by file, line and name."""
    ids = graph.nodes.where(F.col("name") == name).orderBy("file_path", "line", "type").limit(starts)
    named = graph.nodes.select(F.col("id").alias("next"), "type", "name", "file_path", "line")
    by = Window.partitionBy("node_id").orderBy("file_path", "line", "name", "next")
    steps = cut(_calls(graph, direction).distinct().join(named, "next").withColumn("r", F.row_number().over(by)).where(F.col("r") <= fan_out).drop("r"))
    front = cut(ids.select(F.col("id").alias("start"), F.col("id").alias("node_id")))
    seen, out = front, None
    for d in range(depth + 1):
        listed = front.join(steps, "node_id").select("start", F.lit(d + 1).alias("depth"), "next", "type", "name", "file_path", "line")
        out = listed if out is None else out.unionByName(listed)
        if d == depth:
            break
        new = listed.select("start", F.col("next").alias("node_id")).distinct()
        front = cut(new.join(seen, ["start", "node_id"], "left_anti"))
        seen = seen.unionByName(front)
    return out.withColumnRenamed("next", "node_id")


def dead_code(graph: Graph, mode: str = "isolated", limit: int | None = 200) -> DataFrame:
    """(id, name, file_path, line, type) of functions, methods and coroutines without calls in and out; ``no_inbound``: without calls in. By name."""
    calls = graph.edges.where("type = 'CALLS'")
    out = graph.nodes.where(F.col("type").isin("function", "method", "coroutine")).join(calls.select(F.col("dst_id").alias("id")).distinct(), "id", "left_anti")
    if mode == "isolated":
        out = out.join(calls.select(F.col("src_id").alias("id")).distinct(), "id", "left_anti")
    out = out.select("id", "name", "file_path", "line", "type").orderBy("name", "file_path", "line", "type")
    return out if limit is None else out.limit(limit)


def graph_stats(graph: Graph) -> DataFrame:
    """(what, type, count): nodes and edges in all and by type, and communities."""
    part = lambda df, what: df.groupBy("type").agg(F.count(F.lit(1)).alias("count")).select(F.lit(what).alias("what"), "type", "count")
    whole = lambda df, what: df.agg(F.count(F.lit(1)).alias("count")).select(F.lit(what).alias("what"), F.lit(None).cast("string").alias("type"), "count")
    comms = graph.communities.select("community_id").distinct()
    return whole(graph.nodes, "nodes").unionByName(part(graph.nodes, "nodes")).unionByName(whole(graph.edges, "edges")).unionByName(part(graph.edges, "edges")).unionByName(whole(comms, "communities"))


def community_report(graph: Graph, top: int = 10, sample: int = 5, chars: int = 120) -> DataFrame:
    """(community_id, size, names, sample_nodes) of the largest communities: names joined and cut, the first five as type:name."""
    rows = graph.communities.join(graph.nodes.select(F.col("id").alias("node_id"), "type", "name"), "node_id")
    largest = rows.groupBy("community_id").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "community_id").limit(top)
    ranked = rows.join(largest, "community_id").withColumn("r", F.row_number().over(Window.partitionBy("community_id").orderBy("name", "type", "node_id")))
    few = ranked.where(F.col("r") <= chars)  # each name takes a character at least, so no more can show
    named = F.transform(F.sort_array(F.collect_list(F.struct("r", "name", "type"))), lambda s: s["name"])
    shown = F.transform(F.sort_array(F.collect_list(F.struct("r", "name", "type"))), lambda s: F.concat(s["type"], F.lit(":"), s["name"]))
    out = few.groupBy("community_id", "size").agg(F.substring(F.array_join(named, ", "), 1, chars).alias("names"), F.slice(shown, 1, sample).alias("sample_nodes"))
    return out.orderBy(F.desc("size"), "community_id")


def call_activity(graph: Graph, top: int = 10, by_symbols: bool = False) -> DataFrame:
    """(file_path, out_calls, in_calls) of files, most calls out first. Edges of the file nodes themselves, which carry no calls; with
    ``by_symbols`` those of the symbols in the file."""
    calls = graph.edges.where("type = 'CALLS'")
    owner = graph.nodes.select("id", "file_path") if by_symbols else graph.nodes.where("type = 'file'").select("id", "file_path")
    count = lambda c, name: calls.join(owner.withColumnRenamed("id", c), c).groupBy("file_path").agg(F.count(F.lit(1)).alias(name))
    files = graph.nodes.where("type = 'file'").select("file_path").distinct()
    out = files.join(count("src_id", "out_calls"), "file_path", "left").join(count("dst_id", "in_calls"), "file_path", "left")
    out = out.select("file_path", F.coalesce("out_calls", F.lit(0)).alias("out_calls"), F.coalesce("in_calls", F.lit(0)).alias("in_calls"))
    return out.orderBy(F.desc("out_calls"), "file_path").limit(top)


def architecture(graph: Graph) -> dict[str, DataFrame]:
    """Statistics, communities, call activity of files as such and by their symbols, node types."""
    types = graph.nodes.groupBy("type").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "type").limit(10)
    return {"stats": graph_stats(graph), "communities": community_report(graph), "entry_points": call_activity(graph), "call_activity": call_activity(graph, by_symbols=True), "node_types": types}
