"""Communities of the call graph by local moves (one level, at most ten sweeps), in the order of node ids.

Moves lead only into a neighbour's community, so connected components don't affect each other but through the sum of degrees; each
component is moved by itself with that global sum. A component is one task: this is not a distributed optimiser for one giant
component. Its links are streamed from a file in each sweep, so the task holds some 30 bytes a node, whatever the number of links.
"""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.staging import cut

SWEEPS = 10
#: Links held at once: of a component with more they lie in a temporary file.
HELD = 1 << 20


def _sweep(offsets: np.ndarray, links: Callable[[int, int], np.ndarray], total: int, sweeps: int) -> np.ndarray:
    """Community (a node number) of each node number; links(a, b) are those from place a to b, sorted within a node."""
    n = len(offsets) - 1
    at, size, whole = np.arange(n, dtype=np.int32), [1] * n, max(total, 1)
    cuts = [0]
    while cuts[-1] < n:  # nodes whose links are read together
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(offsets, offsets[cuts[-1]] + HELD, "right")) - 1))
    for _ in range(sweeps):
        moved = False
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            near, ends = links(int(offsets[lo]), int(offsets[hi])), (offsets[lo : hi + 1] - offsets[lo]).tolist()
            for node, a, b in zip(range(lo, hi), ends, ends[1:], strict=False):
                home = int(at[node])
                size[home] -= 1
                best, gain = home, 0.0
                for c, weight in Counter(at[near[a:b]].tolist()).items():
                    if weight > gain and (worth := weight - (b - a) * size[c] / whole) > gain:
                        best, gain = c, worth
                size[best] += 1
                if best != home:
                    at[node], moved = best, True
        if not moved:
            break
    return at


def local_moves(adjacent: dict[int, set[int]], total: int, sweeps: int = SWEEPS) -> dict[int, int]:
    """Community (a node id that names it) of each node. A node leaves for the neighbouring community with the largest gain, links into it less
    degree times its size over the sum of degrees; ties go to the community of the lowest neighbour; a gain must be positive."""
    ids = sorted(adjacent)
    number = {x: i for i, x in enumerate(ids)}
    near = np.array([number[x] for i in ids for x in sorted(adjacent[i])], dtype=np.int32)
    at = _sweep(np.cumsum([0, *(len(adjacent[i]) for i in ids)]), lambda a, b: near[a:b], total, sweeps)
    return {x: ids[c] for x, c in zip(ids, at.tolist(), strict=True)}


class _Component:
    """The links (a, b) of a component, which come sorted by both."""

    def __init__(self):
        self.nodes, self.counts, self.ends, self.n, self.held, self.file = [], [], [], 0, 0, None

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        at = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1])
        nodes, counts = a[at], np.diff(np.append(at, len(a)))
        if self.nodes and self.nodes[-1][-1] == nodes[0]:
            self.counts[-1][-1] += counts[0]
            nodes, counts = nodes[1:], counts[1:]
        if len(nodes):
            self.nodes.append(nodes)
            self.counts.append(counts)
        self.ends.append(b)
        self.n += len(b)
        self.held += len(b)
        if self.held > HELD:
            self.file = self.file or tempfile.TemporaryFile()
            for x in self.ends:
                self.file.write(x.tobytes())
            self.ends, self.held = [], 0

    def placed(self, total: int, sweeps: int) -> Iterator[pa.RecordBatch]:
        """(node_id, lowest): the lowest node of each node's community."""
        ids, rest = np.concatenate(self.nodes), np.concatenate(self.ends) if self.ends else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(self.counts))])
        self.nodes, self.counts, self.ends = [], [], []
        number = lambda x: np.searchsorted(ids, x).astype(np.int32)
        if self.file is None:
            near = number(rest)
            at = _sweep(offsets, lambda a, b: near[a:b], total, sweeps)
        else:
            self.file.write(rest.tobytes())
            self.file.seek(0)
            with tempfile.TemporaryFile() as numbered:
                while part := self.file.read(8 * HELD):
                    numbered.write(number(np.frombuffer(part, np.int64)).tobytes())
                self.file.close()

                def links(a: int, b: int) -> np.ndarray:
                    numbered.seek(4 * a)
                    return np.frombuffer(numbered.read(4 * (b - a)), np.int32)

                at = _sweep(offsets, links, total, sweeps)
        low = np.full(len(ids), len(ids), np.int32)
        np.minimum.at(low, at, np.arange(len(ids), dtype=np.int32))
        for i in range(0, len(ids), HELD):
            yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + HELD]), pa.array(ids[low[at[i : i + HELD]]])], ["node_id", "lowest"])


def move_components(batches: Iterator[pa.RecordBatch], total: int, sweeps: int = SWEEPS) -> Iterator[pa.RecordBatch]:
    """(node_id, lowest) from links (component, a, b), sorted by all three."""
    at, of = None, _Component()
    for batch in batches:
        component, a, b = (batch[c].to_numpy() for c in ("component", "a", "b"))
        cuts = [0, *(np.flatnonzero(component[1:] != component[:-1]) + 1), len(a)] if len(a) else [0]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if component[lo] != at and of.n:
                yield from of.placed(total, sweeps)
                of = _Component()
            at = component[lo]
            of.add(a[lo:hi], b[lo:hi])
    if of.n:
        yield from of.placed(total, sweeps)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) over undirected edges (a, b): the least node reachable, by least labels and label jumping, a checkpoint a round."""
    return _components(cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()))


def _components(both: DataFrame) -> DataFrame:
    """As components, of stored edges that stand there both ways."""
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        new = cut(low.join(jump, "to").select("node", "old", F.least("to", "further").alias("label")))
        if new.where("old <> label").isEmpty():
            return new.select("node", F.col("label").alias("component"))
        labels = new.select("node", "label")


def communities(edges: DataFrame, sweeps: int = SWEEPS) -> DataFrame:
    """(node_id, community_id) of each node with a CALLS edge; communities numbered from 0 by their lowest node."""
    pairs = edges.where("type = 'CALLS'").select(F.col("src_id").alias("a"), F.col("dst_id").alias("b")).where("a <> b")
    both = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    total = both.count()
    parts = both.join(_components(both).withColumnRenamed("node", "a"), "a").select("component", "a", "b")
    parts = parts.repartition("component").sortWithinPartitions("component", "a", "b")
    placed = cut(parts.mapInArrow(lambda batches: move_components(batches, total, sweeps), "node_id long, lowest long"))
    number = placed.select("lowest").distinct().select("lowest", (F.row_number().over(Window.orderBy("lowest")) - 1).cast("long").alias("community_id"))
    return placed.join(number, "lowest").select("node_id", "community_id")
