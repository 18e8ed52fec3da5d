"""Exact Jaccard self-join of documents on their word shingles, with count vectors in R-tree nodes.

Texts are reduced to sets of shingle hashes; all is exact up to clashes of 64-bit shingle hashes. Pairs that can link must share
some of each other's leading shingles in one global order (a prefix filter), which gives buckets; of buckets with the same members
one stays. In a bucket, documents are points: their shingles are hashed into groups and the group counts are the coordinates. The
overlap of two sets is at most the sum of the coordinates' minima, and that of a point with anything below a tree node is at most
the sum of minima with the node's upper corner. Trees over blocks of points search each bucket; what the bound leaves is compared
by count vectors of 2^32 groups in the same task, which puts out only a forest of the links that it finds, and these are
verified on the whole sets. Before that, two rounds link each text with one leader of its buckets, so that large groups of near
copies come together by as many tests as they have members and need no further comparing. Buckets that stay large are dealt anew by
their texts' whole sets, as a line that many texts hold would have them compared by the square of their number.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.common import discard, tune

stage = functools.partial(common.stage, arrow=True)

WORDS, PERCENT = 5, 75
#: Groups that shingles are hashed into; sums of so many of them bound first; points in a leaf of the tree; points in a block, the unit
#: that a task holds; a count that fits no more and so bounds nothing.
GROUPS, COARSE, LEAF, BLOCK, FULL = 256, 4, 16, 256, 15
#: What stands for such a count in sums: COARSE of them fit 16 bits.
SATURATED = 1 << 12
#: A point counts as one more for each so many shingles, so that blocks are bounded in bytes too.
HEAVY = 2000
#: A document shows SLACK more of its leading shingles, as a share of their number, so that frequent ones can be left out.
SLACK = 10
#: Pairs that a worker remembers as tested.
TESTED = 1 << 19
#: Texts that may link for each part of the tables of pairs.
PART_TEXTS = 4000
#: Buckets of a home that are searched together, with each text's count vectors in the task once.
HOME = 32
#: Rounds in which members of a large bucket leave it that the other members' sizes rule out.
ROUNDS = 3
#: Shown shingles of a bucket, the unit in which a task compares what texts show.
BUCKET_ROWS = 500_000
#: Documents for each file of a table that holds all of them: many small input files needn't become as many small staged ones.
FILE_ROWS = 8000
#: Shingles that a worker gathers before it looks for frequent ones; texts from which on a shingle of these is known to be shared; parts
#: that such a shingle's texts are dealt to.
GATHERED, FREQUENT, DEALT = 1 << 19, 64, 4096

_SHOWN = np.dtype([("sig", "<u8"), ("h1", "<i8"), ("h2", "<i8"), ("n", "<i4"), ("deal", "<i4")])
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    """Words of a text with A-Z lower-cased; split at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """The set of a text's shingles as sorted 64-bit hashes; with fewer words than ``size`` the whole sequence is the only one."""
    if not words:
        return np.empty(0, np.uint64)
    h = pd.util.hash_array(np.array(words, object), categorize=False)
    size, short = min(size, len(h)), len(h) < size
    total = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        total += _mix(h[k : len(h) - size + 1 + k] + np.uint64(k)) * _MULTIPLIERS[k % 5]
    return np.unique(_mix(total + np.uint64(size if short else 0)))


def groups_of(s: np.ndarray) -> bytes:
    """The count vector of a set, two counts in a byte."""
    v = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=GROUPS).clip(max=FULL).astype(np.uint8)
    return (v[::2] << 4 | v[1::2]).tobytes()


def needed(n: int) -> int:
    """Shingles that a set of n shares at least with any partner."""
    return -(-PERCENT * n // 100)


def shown(n: int) -> int:
    """Leading shingles that a set of n shows: with the extra ones, partners share ``sure(n)`` of them at least."""
    return n - needed(n) + 1 + n // SLACK


def sure(n: int) -> int:
    return 1 + needed(n) // SLACK


def linked(overlap: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """100 * intersection >= PERCENT * union."""
    return 100 * overlap >= PERCENT * (n + m - overlap)


def _may_link(bound: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether texts link for all that a sum of minima says: one that holds a saturated group bounds nothing where both are larger than that."""
    return linked(bound, n, m) | ((bound >= SATURATED) & (np.minimum(n, m) > SATURATED))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _key(words: list[bytes]) -> tuple[int, int]:
    d = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's key, the size of its set, and its leading shingles: null for rows without id and for copies in a partition."""
    seen: dict[tuple[int, int], int] = {}
    shows: set[tuple[int, int]] = set()
    for b in batches:
        keys, n, sigs = [], [], []
        for doc_id, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            w = words_of(t)
            key = _key(w)
            shown_ = None
            if key not in seen or (doc_id is not None and key not in shows):
                s = shingles(w)
                seen[key] = len(s)
                if doc_id is not None and w:
                    shows.add(key)
                    shown_ = s[: shown(len(s))]
            keys.append(key)
            n.append(seen[key])
            sigs.append(shown_)
        ends = pa.array(np.cumsum([0, *(0 if s is None else len(s) for s in sigs)]).astype(np.int32))
        flat = _signed(np.concatenate([np.empty(0, np.uint64), *(s for s in sigs if s is not None)]))
        lists = pa.ListArray.from_arrays(ends, flat, mask=pa.array([s is None for s in sigs], pa.bool_()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(n, pa.int32()), lists], names=["doc_id", "h1", "h2", "n", "sigs"])


def _shows(n_buckets: int):
    """Rows (bucket, blob): what texts show, packed by the bucket that a shingle hashes to, so that Spark moves few rows.

    What FREQUENT texts of those gathered show is known to be shared, and its texts are dealt to buckets apart; two of them stay
    undealt, as witnesses for texts elsewhere.
    """

    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        lists = t.column("sigs").combine_chunks()
        at = np.repeat(np.arange(t.num_rows), lists.value_lengths().to_numpy())
        rows = np.empty(len(at), _SHOWN)
        rows["sig"], rows["h1"], rows["h2"], rows["n"] = lists.flatten().to_numpy().view(np.uint64), *(t.column(c).to_numpy()[at] for c in ("h1", "h2", "n"))
        rows = rows[np.argsort(rows["sig"], kind="stable")]
        starts = np.concatenate([[0], np.flatnonzero(rows["sig"][1:] != rows["sig"][:-1]) + 1])
        lengths = np.diff(np.concatenate([starts, [len(rows)]]))
        known = (np.repeat(lengths, lengths) >= FREQUENT) & (np.arange(len(rows)) - np.repeat(starts, lengths) > 1)
        rows["deal"] = np.where(known, 1 + (rows["h1"] & (DEALT - 1)), 0)
        bucket = (_mix(rows["sig"] + rows["deal"].astype(np.uint64) * _MULTIPLIERS[0]) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, rows = bucket[order], rows[order]
        cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(rows)]])
        blobs = [rows[x:y].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b.column(b.schema.get_field_index("sigs")).flatten())
            if size >= GATHERED:
                yield out(held)
                held, size = [], 0
        if size:
            yield out(held)

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket to (h1, h2, n, sig) of the shingles that more than one text shows."""
    for t, cuts in _groups(batches, ("bucket",)):
        for a, z in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            rows = np.frombuffer(b"".join(t.column("blob").slice(a, z - a).to_pylist()), _SHOWN)
            rows = rows[np.lexsort((rows["deal"], rows["sig"]))]
            starts = np.concatenate([[0], np.flatnonzero((rows["sig"][1:] != rows["sig"][:-1]) | (rows["deal"][1:] != rows["deal"][:-1])) + 1])
            several = np.minimum.reduceat(rows["h1"], starts) != np.maximum.reduceat(rows["h1"], starts)
            rows = rows[np.repeat(several, np.diff(np.concatenate([starts, [len(rows)]]))) | (rows["deal"] > 0)]
            cols = [rows["h1"], rows["h2"], rows["n"], rows["sig"].view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["h1", "h2", "n", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done = set()  # repeated rows
    for b in batches:
        rows = []
        for rep, h1, h2, t in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            w = words_of(t)
            if _key(w) == (h1, h2) and (rep, h1, h2) not in done:  # not another text that has the same doc_id
                done.add((rep, h1, h2))
                s = shingles(w)
                fine = (s >> np.uint64(32)).astype("<u4").tobytes()
                rows.append((rep, h1, h2, len(s), groups_of(s), fine, s.astype("<u8").tobytes()))
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["rep", "h1", "h2", "n", "vec", "fine", "whole"])


def _vectors(column: pa.Array) -> np.ndarray:
    half = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, GROUPS // 2)
    v = np.empty((len(half), GROUPS), np.uint16)
    v[:, ::2], v[:, 1::2] = half >> 4, half & 15
    v[v == FULL] = SATURATED
    return v


def _summed(v: np.ndarray) -> np.ndarray:
    return v.reshape(len(v), -1, COARSE).sum(2, dtype=np.uint16)


def _possible(v: np.ndarray, w: np.ndarray, n: np.ndarray, m: np.ndarray, coarse: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of index pairs (i, j) into the points v and w those that the bound leaves: first on summed groups, then on all."""
    keep = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 15):
        a, b = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
        at = np.flatnonzero(_may_link(np.minimum(coarse[0][a], coarse[1][b]).sum(1, dtype=np.int64), n[a], m[b]))
        a, b = a[at], b[at]
        keep[k + at[_may_link(np.minimum(v[a], w[b]).sum(1, dtype=np.int64), n[a], m[b])]] = True
    return keep


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Elements of the shorter sorted array that are in the other one."""
    if len(y) < len(x):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def _checked(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b.column("n").to_numpy().astype(np.int64), b.column("m").to_numpy().astype(np.int64)
            found = np.array([_overlap(np.frombuffer(x.as_buffer(), kind), np.frombuffer(y.as_buffer(), kind)) for x, y in zip(b.column("x"), b.column("y"), strict=True)], np.int64)
            keep = pa.array(linked(found, n, m))
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    return run


def _side(name: str, size: str, what: str, to: str, sets: DataFrame) -> DataFrame:
    return sets.select(F.col("rep").alias(name), F.col("n").alias(size), F.col(what).alias(to))


def exact(pairs: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """Of distinct pairs (a, b) (a staged table) those that link, by the whole sets."""
    own = _those(sets, pairs)
    met = pairs.join(_side("a", "n", "whole", "x", own), "a").join(_side("b", "m", "whole", "y", own), "b")
    return met.mapInArrow(_checked("<u8"), "a long, b long").distinct().coalesce(parts)


def verify(pairs: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """Of distinct pairs (a, b) (a staged table) those that link, staged.

    First by sizes; then by count vectors of 2^32 groups, kept as the sorted groups of each set (four bytes for each shingle), which
    leave little but links; then on the whole sets.
    """
    own = _those(sets, pairs)
    met = pairs.join(_side("a", "n", "fine", "x", own), "a").join(_side("b", "m", "fine", "y", own), "b")
    rough = met.where(_sizes_fit(F.col("n"), F.col("n"), F.col("m"), F.col("m"))).mapInArrow(_checked("<u4"), "a long, b long")
    rough = stage(rough.distinct().coalesce(parts), "rough")
    links = stage(exact(rough, sets, parts), "links")
    discard(rough)
    return links


def _those(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets of texts in pairs (a staged table), where these are few; all of them where picking them out would move as much."""
    if 4 * pairs.count() > sets.count():
        return sets
    return sets.join(pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct(), "rep", "left_semi")


def _sizes_fit(nmin: Column, nmax: Column, mmin: Column, mmax: Column) -> Column:
    return (100 * nmax >= PERCENT * mmin) & (100 * mmax >= PERCENT * nmin)


class RTree:
    """Points (count vectors) in leaves of LEAF, packed by size and then by a part of their counts; nodes hold upper corners."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        self.vectors, self.sizes, self.coarse = vectors, sizes, _summed(vectors)
        self.order = np.lexsort((self.coarse[:, : GROUPS // COARSE // 2].sum(1, dtype=np.int64), sizes))
        starts = np.arange(0, len(sizes), LEAF)
        self.upper = np.maximum.reduceat(self.coarse[self.order], starts, axis=0)
        self.least, self.most = np.minimum.reduceat(sizes[self.order], starts), np.maximum.reduceat(sizes[self.order], starts)

    def search(self, vectors: np.ndarray, sizes: np.ndarray, apart) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) index pairs that the bound doesn't rule out, as far as ``apart`` wants them."""
        found, coarse = [], _summed(vectors)
        for k, upper in enumerate(self.upper):
            fits = (100 * self.most[k] >= PERCENT * sizes) & (100 * sizes >= PERCENT * self.least[k])
            q = np.flatnonzero(fits)
            bound = np.minimum(coarse[q], upper).sum(1, dtype=np.int64)
            q = q[linked(bound, sizes[q], np.full(len(q), self.least[k])) | _may_link(bound, sizes[q], np.full(len(q), self.most[k]))]
            if len(q):
                own = self.order[k * LEAF : (k + 1) * LEAF]
                i, j = np.repeat(q, len(own)), np.tile(own, len(q))
                want = apart(i, j)
                i, j = i[want], j[want]
                keep = _possible(vectors, self.vectors, sizes, self.sizes, (coarse, self.coarse), i, j)
                found.append((i[keep], j[keep]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


class _Forest:
    """What has come together in this task; labels are components."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        at = x
        while (to := self.up.get(at, at)) != at:
            at = to
        while x != at:
            self.up[x], x = at, self.up.get(x, x)
        return at

    def join(self, x: int, y: int) -> None:
        self.up[max(x, y)] = min(x, y)


def _corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sig, block): of each block the ranges of components and sizes and the upper corner of its count vectors."""
    for t, cuts in _groups(batches, ("sig", "block")):
        n, comp, v = t.column("n").to_numpy(), t.column("comp").to_numpy(), _summed(_vectors(t.column("vec")))
        at = cuts[:-1]
        upper = [x.astype("<u2").tobytes() for x in np.maximum.reduceat(v, at, axis=0)]
        cols = [t.column("sig").to_numpy()[at], t.column("block").to_numpy()[at]]
        cols += [f.reduceat(x, at) for x in (comp, n) for f in (np.minimum, np.maximum)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(upper, pa.binary())], names=["sig", "block", "cmin", "cmax", "nmin", "nmax", "upper"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs of blocks those whose corners leave a link possible."""
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(b.num_rows, -1) for c in ("upper", "upper_"))
        bound = np.minimum(x, y).sum(1, dtype=np.int64)
        least, least_, most, most_ = (b.column(c).to_numpy().astype(np.int64) for c in ("nmin", "nmin_", "nmax", "nmax_"))
        keep = pa.array(linked(bound, least, least_) | _may_link(bound, most, most_))
        yield pa.RecordBatch.from_arrays([b.column(c).filter(keep) for c in ("sig", "x", "y")], names=["sig", "x", "y"])


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in tables of whole groups, with where the groups start and the last one ends."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(c)) for c in keys]
        first, end = (tuple(c[i].as_py() for c in cols) for i in (0, -1))
        if held and last == first == end:  # the group goes on; joined up only when it ends
            held.append(b)
            continue
        t = pa.Table.from_batches([*held, b])
        at = np.stack([t.column(c).to_numpy() for c in keys], 1)
        cuts = np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1])
        if cuts[-1]:
            yield t.slice(0, cuts[-1]).combine_chunks(), cuts
        held, last = t.slice(cuts[-1]).to_batches(), end
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, np.array([0, t.num_rows])


class _Search:
    """What a task has found: pairs that link as far as bounds tell, and with ``forest`` only those that bring together what no earlier pair has."""

    def __init__(self, forest: bool):
        self.forest, self.together, self.tested = forest, _Forest(), set()

    def block(self, comp: list[int], rep: list[int], n: np.ndarray, vectors, fine, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        """Pairs of the points ``left`` and ``right`` (indices; the same array: each pair once). vectors(): all count vectors; fine(k): a point's groups."""
        root = np.array([self.together.root(c) for c in comp] if self.forest else comp)
        out: list[tuple[int, int]] = []
        if (root == root[0]).all() or not len(left) or not len(right):
            return out
        one, v = left is right, vectors()
        apart = lambda i, j: (root[left[i]] != root[right[j]]) & ((left[i] < right[j]) if one else True)
        i, j = RTree(v[right], n[right]).search(v[left], n[left], apart)
        sets: dict[int, np.ndarray] = {}
        for p, q in zip(left[i].tolist(), right[j].tolist(), strict=True):
            ends = self.together.root(int(root[p])), self.together.root(int(root[q]))
            pair = (min(rep[p], rep[q]), max(rep[p], rep[q]))
            if self.forest and ends[0] == ends[1] or pair in self.tested:
                continue
            if len(self.tested) == TESTED:
                self.tested.clear()
            self.tested.add(pair)
            for k in (p, q):
                if k not in sets:
                    sets[k] = fine(k)
            if linked(_overlap(sets[p], sets[q]), n[p], n[q]):
                out.append(pair)
                if self.forest:
                    self.together.join(*ends)
        return out


def _batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    found = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def _found_in_homes(forest: bool):
    """Rows sorted by (home, sig): first the texts of a home with their count vectors (sig null), then its buckets' members, to pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(forest)
        for t, cuts in _groups(batches, ("home",)):
            pairs: list[tuple[int, int]] = []
            for a, z in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                g = t.slice(a, z - a)
                texts, members = g.filter(g.column("vec").is_valid()).combine_chunks(), g.filter(g.column("vec").is_null()).combine_chunks()
                key = lambda x: list(zip(*(x.column(c).to_pylist() for c in ("rep", *TEXT)), strict=True))
                at = {k: i for i, k in enumerate(key(texts))}
                own = np.array([at[k] for k in key(members)], np.int64)
                v, fine = _vectors(texts.column("vec")), texts.column("fine")
                sets = [np.frombuffer(x.as_buffer(), "<u4") for x in fine]
                rep, comp, n, sig = members.column("rep").to_pylist(), members.column("comp").to_pylist(), members.column("n").to_numpy().astype(np.int64), members.column("sig").to_numpy()
                ends = np.concatenate([[0], np.flatnonzero(sig[1:] != sig[:-1]) + 1, [len(sig)]]).tolist()
                for x, y in zip(ends, ends[1:], strict=False):
                    index = np.arange(y - x)
                    pairs += search.block(comp[x:y], rep[x:y], n[x:y], lambda x=x, y=y: v[own[x:y]], lambda k, x=x: sets[own[x + k]], index, index)  # noqa: B023
            yield _batch(pairs)

    return run


def _found_in_blocks(forest: bool):
    """Rows sorted by (sig, x, y), blocks x and y of a bucket, to pairs of the points of one with those of the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(forest)
        for t, cuts in _groups(batches, ("sig", "x", "y")):
            pairs: list[tuple[int, int]] = []
            side, x, y, n = t.column("side").to_numpy(), t.column("x").to_numpy(), t.column("y").to_numpy(), t.column("n").to_numpy().astype(np.int64)
            for a, z in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                g = t.slice(a, z - a)
                left = np.flatnonzero(side[a:z] == 0)
                right = left if x[a] == y[a] else np.flatnonzero(side[a:z] == 1)
                fine = g.column("fine")
                pairs += search.block(g.column("comp").to_pylist(), g.column("rep").to_pylist(), n[a:z], lambda g=g: _vectors(g.column("vec")), lambda k, fine=fine: np.frombuffer(fine[k].as_buffer(), "<u4"), left, right)
            yield _batch(pairs)

    return run


def components(edges: DataFrame, parts: int, name: str = "components") -> DataFrame:
    """(node, component) of each node on an edge (a, b): the smallest node reachable. Each round is staged in the shared folder.

    A round takes the least label among neighbours and then that label's own label, twice, until nothing changes. Tables are written in
    ``parts`` parts, as the number of texts asks for.
    """
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().coalesce(parts), f"{name}-edges")

    def lower(labels: DataFrame) -> DataFrame:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", F.least("label", "near").alias("to"))
        return low.join(labels.select(F.col("node").alias("to"), F.col("label").alias("further")), "to").select("node", F.least("to", "further").alias("label"))

    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label")
    labels = stage(lower(labels).coalesce(parts), name)
    while True:
        once = lower(labels)
        new = lower(once).join(labels.select("node", F.col("label").alias("old")), "node").select("node", "old", "label")
        new = stage(new.coalesce(parts), name)
        if new.where("old <> label").isEmpty():
            return new.select("node", F.col("label").alias("component"))
        labels = new.select("node", "label")


TEXT = ["h1", "h2"]


def _sure(n: Column) -> Column:
    return 1 + F.floor(F.ceil(F.lit(PERCENT) * n / 100) / SLACK)


def _needed(n: Column) -> Column:
    return F.ceil(F.lit(PERCENT) * n / 100)


def _enough(rows: DataFrame, least: Callable[[Column], Column] = _sure) -> DataFrame:
    """Rows of texts that have enough of them to link; least: how many of them a text shares with any partner."""
    return rows.withColumn("__all", F.count(F.lit(1)).over(Window.partitionBy(*TEXT))).where(F.col("__all") >= least(F.col("n"))).drop("__all")


def _shared(sized: DataFrame) -> tuple[DataFrame, int]:
    """(h1, h2, n, sig): the shown shingles that more than one text shows; how many parts tables of shingles may have.

    Frequent shingles are found among those that a worker gathers and dealt apart, so that no task holds all rows of one.
    """
    named = sized.where("sigs is not null")
    n_buckets = (named.agg(F.sum(F.size("sigs"))).first()[0] or 0) // BUCKET_ROWS + 12
    shows = named.select("h1", "h2", "n", "sigs").mapInArrow(_shows(n_buckets), "bucket long, blob binary")
    met = shows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_met, "h1 long, h2 long, n int, sig long")
    return _enough(met.repartition(*TEXT).dropDuplicates([*TEXT, "sig"])), n_buckets


def _mixed(shared: DataFrame, comps: DataFrame | None, parts: int) -> DataFrame:
    """Rows (h1, h2, rep, comp, n, sig, count) of shingles that texts of different components show, with their number, of texts that have enough of them to link."""
    if comps is None:
        placed = shared.select(*TEXT, "rep", "n", "sig", F.col("rep").alias("comp"))
    else:
        placed = shared.select(*TEXT, "rep", "n", "sig").join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    return _mixed_placed(placed, parts, _sure)


def _mixed_placed(placed: DataFrame, parts: int, least: Callable[[Column], Column]) -> DataFrame:
    """What ``_mixed`` gives, of rows that have their components."""
    ends = placed.groupBy("sig").agg(F.min("comp").alias("__a"), F.max("comp").alias("__b"), F.count(F.lit(1)).alias("count")).where("__a <> __b").select("sig", "count")
    ends = stage(ends, "ends", parts)  # so that the join can split a frequent shingle
    out = stage(_enough(placed.join(ends, "sig"), least).select(*TEXT, "rep", "comp", "n", "sig", "count"), "mixed", parts)
    discard(ends)
    return out


def _selected(mixed: DataFrame, parts: int) -> DataFrame:
    """Buckets: mixed's rows of those shingles that each text needs to be found by, rarest first, staged.

    Texts that link share ``sure(n)`` of them at least, so all but ``sure(n) - 1`` of each side's, in one order, have one in common. part:
    which part of all that the text shows others show too. Of buckets with the same members one stays; weight: how many they are; home:
    a member, the same for many of the buckets of a group.
    Members are compared by their number and three 64-bit sums modulo 2 of their keys.
    """
    n = F.col("n")
    n_shown = n - _needed(n) + 1 + F.floor(n / SLACK)
    return _buckets(stage(_rarest(mixed, _sure).select(*TEXT, "rep", "comp", "n", "sig", (F.col("__all") / n_shown).alias("part")), "kept", parts), parts)


def _rarest(mixed: DataFrame, least: Callable[[Column], Column]) -> DataFrame:
    """Of each text's rows, rarest first, all but the last ``least(n) - 1``; rest: how many there are from a row on, of __all."""
    own = Window.partitionBy(*TEXT)
    ranked = mixed.withColumn("__all", F.count(F.lit(1)).over(own)).withColumn("rest", F.col("__all") - F.row_number().over(own.orderBy("count", "sig")) + 1)
    return ranked.where(F.col("rest") >= least(F.col("n")))


def _buckets(kept: DataFrame, parts: int) -> DataFrame:
    """Rows of kept (a staged table), with home and weight, of shingles that several texts have; of those with the same texts one. Staged."""
    whose = kept.groupBy("sig").agg(F.count(F.lit(1)).alias("c"), F.bit_xor("h1").alias("x"), F.bit_xor("h2").alias("y"), F.bit_xor(F.xxhash64(*TEXT)).alias("z"), F.min("rep").alias("home")).where("c > 1")
    one = stage(whose.groupBy("c", "x", "y", "z").agg(F.min("sig").alias("sig"), F.min("home").alias("home"), F.count(F.lit(1)).alias("weight")).select("sig", "home", "weight"), "one", parts)
    buckets = stage(kept.join(one, "sig"), "buckets", parts)
    discard(kept, one)
    return buckets


def _leader_pairs(buckets: DataFrame, turn: int, parts: int) -> DataFrame:
    """(a, b): each text with the leader that most of its buckets have, of those in other components.

    At first a bucket's leader is the text with the least of its own: what copies were made from shares all, while each copy has
    edits. At later turns it is a pseudorandom one, another in each bucket.
    """
    rank = F.struct("part", *TEXT) if turn == 0 else F.struct(F.xxhash64(*TEXT, "sig", F.lit(turn)), *TEXT)
    leader = stage(buckets.groupBy("sig").agg(F.max_by(F.struct("rep", "comp"), rank).alias("to")), "leader", parts)
    votes = buckets.join(leader, "sig").where("comp <> to.comp").groupBy(*TEXT, "rep", F.col("to.rep").alias("to")).agg(F.sum("weight").alias("votes"))
    best = votes.groupBy(*TEXT, "rep").agg(F.max_by("to", F.struct("votes", "to")).alias("to")).where("rep <> to")
    out = stage(best.select(F.least("rep", "to").alias("a"), F.greatest("rep", "to").alias("b")).distinct(), "leaders", parts)
    discard(leader)
    return out


def _still_mixed(buckets: DataFrame, comps: DataFrame, parts: int) -> DataFrame:
    """buckets with the components of now and their numbers of texts, without those that have only one component left, staged."""
    now = buckets.drop("comp").join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    ends = stage(now.groupBy("sig").agg(F.min("comp").alias("__a"), F.max("comp").alias("__b"), F.count(F.lit(1)).alias("size")).where("__a <> __b").select("sig", "size"), "ends", parts)
    out = stage(now.join(ends, "sig"), "buckets", parts)
    discard(ends, buckets)
    return out


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each shingle of each text's whole set, with the text's other columns."""
    names = [*TEXT, "rep", "comp", "n"]
    for b in batches:
        whole = [np.frombuffer(x.as_buffer(), "<i8") for x in b.column(b.schema.get_field_index("whole"))]
        ends = np.cumsum([len(x) for x in whole])
        for rows in np.split(np.arange(len(whole)), np.flatnonzero(np.diff(ends // GATHERED)) + 1):
            at = pa.array(np.repeat(rows, [len(whole[k]) for k in rows]))
            sigs = np.concatenate([np.empty(0, np.int64), *(whole[k] for k in rows)])
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)).take(at) for c in names), pa.array(sigs)], names=[*names, "sig"])


def _within_reach(kept: DataFrame, parts: int) -> DataFrame:
    """kept (rows of whole sets, staged) without those that no other text of the bucket can be found by, staged.

    The first shingle that two linked texts have in common leaves each no more in common than what it has from there on (``rest``),
    and they share the more the larger the other one is.
    """
    least = stage(kept.groupBy("sig").agg(F.min("n").alias("__n"), F.min("comp").alias("__a"), F.max("comp").alias("__b")).where("__a <> __b").select("sig", "__n"), "least", parts)
    fits = (100 + PERCENT) * F.col("rest") >= PERCENT * (F.col("n") + F.col("__n"))
    out = stage(kept.join(least, "sig").where(fits).select(*kept.columns), "kept", parts)
    discard(least, kept)
    return out


def _narrowed(buckets: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """buckets with the texts of those of more than BLOCK texts dealt anew by their whole sets, staged.

    A line that many texts hold makes buckets that grow with the corpus. Two texts that link share ``needed(n)`` of all their
    shingles at least, so in one order, rarest among the texts of such buckets first, all but ``needed(n) - 1`` of each side's have
    one in common: what is frequent comes last and brings together only texts that consist of it.
    """
    cols = ["sig", "home", *TEXT, "rep", "comp", "n"]
    large, small = buckets.where(F.col("size") > BLOCK), buckets.where(F.col("size") <= BLOCK).select(*cols)
    if large.isEmpty():
        return buckets
    whole = large.select("rep", *TEXT, "comp", "n").distinct().join(sets.select("rep", *TEXT, "whole"), ["rep", *TEXT])
    placed = stage(whole, "spread", parts, mapped=(_spread, "h1 long, h2 long, rep long, comp long, n int, sig long"))
    mixed = _mixed_placed(placed, parts, _needed)
    kept = stage(_rarest(mixed, _needed).select(*TEXT, "rep", "comp", "n", "sig", "rest"), "kept", parts)
    for _ in range(ROUNDS):
        kept = _within_reach(kept, parts)
    dealt = _buckets(kept, parts)
    # a shingle that makes a small bucket too makes another one here
    out = stage(small.unionByName(dealt.withColumn("sig", F.xxhash64("sig", F.lit(BLOCK))).select(*cols)), "buckets", parts)
    discard(placed, mixed, dealt, buckets)
    return out


def _blocks(buckets: DataFrame, parts: int) -> DataFrame:
    """(sig, home, block, rep, h1, h2, comp, n): the points of each bucket in blocks, staged.

    A bucket whose points count for no more than BLOCK is one block, 0. Larger ones are dealt by size and then by component; a
    component that fills blocks has its own, as points of one component needn't meet.
    """
    weight, size = 1 + F.floor(F.col("n") / HEAVY), F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.15)))
    rows = buckets.select("sig", "home", *TEXT, "rep", "comp", "n", weight.alias("w"), size.alias("g"))
    large = stage(rows.groupBy("sig").agg(F.sum("w").alias("__all")).where(F.col("__all") > BLOCK).select("sig"), "large", parts)
    crowded = rows.join(large, "sig").groupBy("sig", "g", "comp").agg(F.sum("w").alias("__own"))
    alone = F.col("__own") > BLOCK // 2
    bands = crowded.groupBy("sig", "g").agg(F.sum(F.when(alone, 0).otherwise(F.col("__own"))).alias("__band"))
    key = F.when(alone, F.xxhash64("g", "comp")).otherwise(F.xxhash64("g"))
    n_parts = F.ceil(F.when(alone, F.col("__own")).otherwise(F.col("__band")) / BLOCK)
    crowded = stage(crowded.join(bands, ["sig", "g"]).select("sig", "g", "comp", key.alias("__key"), alone.alias("__alone"), n_parts.alias("__parts")), "crowded", parts)
    part = F.pmod(F.when(F.col("__alone"), F.xxhash64("rep", *TEXT)).otherwise(F.xxhash64("comp")), F.col("__parts"))
    dealt = rows.join(crowded, ["sig", "g", "comp"], "left").withColumn("block", F.when(F.col("__key").isNull(), 0).otherwise(F.xxhash64("__key", part).bitwiseOR(F.lit(1))))
    points = stage(dealt.select("sig", "home", "block", "rep", *TEXT, "comp", "n"), "points", parts)
    discard(large, crowded)
    return points


def _later_pairs(points: DataFrame, sets: DataFrame, parts: int, forest: bool) -> DataFrame:
    """Pairs from different components that share a bucket, as far as the bounds on nodes, points and groups leave them, staged."""
    vectors = sets.select("rep", *TEXT, "vec", "fine")
    # buckets of one block: those of a home come together, so that its texts' vectors are there once and its pairs are tested once
    small = points.where("block = 0")
    homes = stage(small.select("home", "sig").distinct().groupBy("home").agg(F.ceil(F.count(F.lit(1)) / HOME).alias("__n")), "homes", parts)
    small = small.join(homes, "home").withColumn("home", F.xxhash64("home", F.pmod("sig", "__n"))).select("home", "sig", "rep", *TEXT, "comp", "n")
    texts = small.select("home", "rep", *TEXT).distinct().join(vectors, ["rep", *TEXT])
    none = lambda kind: F.lit(None).cast(kind)
    rows = small.withColumn("vec", none("binary")).withColumn("fine", none("binary")).unionByName(
        texts.withColumn("sig", none("long")).withColumn("comp", none("long")).withColumn("n", none("int")).select("home", "sig", "rep", *TEXT, "comp", "n", "vec", "fine")
    )
    rows = rows.repartition("home").sortWithinPartitions("home", "sig")
    in_homes = rows.mapInArrow(_found_in_homes(forest), "a long, b long")
    # larger ones: pairs of blocks whose corners leave a link possible
    many = points.where("block <> 0").join(vectors, ["rep", *TEXT]).select("sig", "block", "rep", "comp", "n", "vec", "fine")
    many = stage(many, "many", parts)
    nodes = many.select("sig", "block", "comp", "n", "vec").repartition("sig", "block").sortWithinPartitions("sig", "block")
    nodes = stage(nodes, "nodes", parts, mapped=(_corners, "sig long, block long, cmin long, cmax long, nmin int, nmax int, upper binary"))
    other = nodes.select("sig", *[F.col(c).alias(f"{c}_") for c in nodes.columns if c != "sig"])
    met = nodes.join(other, "sig").where("block <= block_ and not (cmin = cmax and cmin_ = cmax_ and cmin = cmin_)")
    met = met.where(_sizes_fit(F.col("nmin"), F.col("nmax"), F.col("nmin_"), F.col("nmax_"))).select("sig", F.col("block").alias("x"), F.col("block_").alias("y"), "nmin", "nmax", "nmin_", "nmax_", "upper", "upper_")
    met = stage(met, "met", parts, mapped=(_near, "sig long, x long, y long"))
    cols = ["sig", "x", "y", "side", "rep", "comp", "n", "vec", "fine"]
    left = met.join(many.withColumnRenamed("block", "x"), ["sig", "x"]).withColumn("side", F.lit(0))
    right = met.where("x <> y").join(many.withColumnRenamed("block", "y"), ["sig", "y"]).withColumn("side", F.lit(1))
    rows = left.select(*cols).unionByName(right.select(*cols)).repartition("sig", "x", "y").sortWithinPartitions("sig", "x", "y")
    in_blocks = rows.mapInArrow(_found_in_blocks(forest), "a long, b long")
    out = stage(in_homes.unionByName(in_blocks).distinct().coalesce(parts), "later")
    discard(homes, many, nodes, met)
    return out


def _settled(points: DataFrame, sets: DataFrame, links: DataFrame, parts: int) -> DataFrame:
    """links and all others that the points' buckets hold, as far as components ask for them.

    Tasks put out forests of pairs that 2^32 groups leave. Where all of these link, what they bring together is together. Where one
    doesn't, which takes clashing groups, all pairs of what hangs together with it are verified.
    """
    pairs = _later_pairs(points, sets, parts, True)
    more = stage(exact(pairs, sets, parts), "links")
    failed = pairs.join(more, ["a", "b"], "left_anti")
    links = stage(links.unionByName(more), "links", parts)
    if not failed.isEmpty():
        comps = components(links, parts)
        # pairs are between reps, and tasks merge components: what hangs together is told by both
        tied = points.select(F.col("comp").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()
        hangs = components(pairs.unionByName(tied), parts)
        bad = failed.select(F.col("a").alias("node")).join(hangs, "node").select("component").distinct()
        nodes = hangs.join(bad, "component", "left_semi").select(F.col("node").alias("rep"))
        again = points.drop("comp").join(nodes, "rep", "left_semi").join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
        again = stage(again.withColumn("comp", F.coalesce("component", "rep")).select(*points.columns), "points")
        rest = _later_pairs(again, sets, parts, False)
        links = stage(links.unionByName(exact(rest, sets, parts)), "links")
        discard(again, rest)
    discard(pairs, more)
    return links


def _files(documents: DataFrame) -> int:
    """Files at most that a table of all documents is written to; of a stored table this reads row counts only."""
    return documents.count() // FILE_ROWS + 24


def jaccard_components(documents: DataFrame) -> DataFrame:
    """op3: (doc_id, n_shingles, component_id) for each document row.

    Texts with equal words are one class and links are found between classes, all of them. A text without words (or null) has
    n_shingles 0 and is its own component. Rows that share a doc_id are one document with several texts: what links to either
    is linked to it. Rows with a null doc_id get component null and link nothing. An empty table gives no rows.
    """
    spark = documents.sparkSession
    tune(spark)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sized = stage(rows, "sized", _files(documents), mapped=(_sized, "doc_id long, h1 long, h2 long, n int, sigs array<long>"))
    keys = sized.drop("sigs")
    named = keys.where("n > 0 and doc_id is not null")
    shared, wide = _shared(sized)
    classes = stage(named.groupBy(*TEXT).agg(F.min("doc_id").alias("rep")), "classes", wide)
    shared = stage(shared.join(classes, TEXT), "shared", wide)
    first = _mixed(shared, None, wide)
    discard(shared)
    buckets = _selected(first, wide)
    chosen = stage(buckets.select("rep", *TEXT).distinct(), "chosen", wide)
    parts = chosen.count() // PART_TEXTS + 12
    held = rows.where("doc_id is not null").join(chosen.withColumnRenamed("rep", "doc_id").hint("shuffle_hash"), "doc_id")
    sets = (_sets, "rep long, h1 long, h2 long, n int, vec binary, fine binary, whole binary")
    sets = stage(held.select("doc_id", *TEXT, "text"), "sets", parts, mapped=sets)
    pairs = _leader_pairs(buckets, 0, parts)
    links = verify(pairs, sets, parts)
    comps = components(links, parts)
    discard(pairs, buckets)
    # what is together needs no further comparing, so each turn leaves less to the next
    mixed = _mixed(first, comps, wide)
    discard(first)
    buckets = _selected(mixed, wide)
    pairs = _leader_pairs(buckets, 1, parts)
    links = stage(links.unionByName(verify(pairs, sets, parts)), "links", parts)
    buckets = _still_mixed(buckets, components(links, parts), wide)
    # a text that shared no bucket with another at first links with nothing
    buckets = _narrowed(buckets, sets, wide)
    points = _blocks(buckets.join(chosen, ["rep", *TEXT], "left_semi"), wide)
    links = _settled(points, sets, links, parts)
    # several texts of one doc_id are one document
    of_doc = named.join(classes, TEXT).groupBy("doc_id").agg(F.collect_set("rep").alias("reps")).where(F.size("reps") > 1)
    ties = of_doc.select(F.array_min("reps").alias("a"), F.explode("reps").alias("b")).where("a <> b")
    comps = components(links.unionByName(ties), parts)
    discard(mixed, buckets, points, sets, links, chosen)
    known = classes.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
    known = known.select("h1", "h2", F.coalesce("component", "rep").alias("__component"))
    out = keys.join(known, ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("__component")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def keep_one(documents: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of each component, with its own columns; rows with a null doc_id stay.

    Repeated rows of that document stay too, as they are one document.
    """
    first = jaccard_components(documents).where("doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    cols = [F.col(f"`{c}`") for c in documents.columns]
    kept = documents.join(first, documents["doc_id"].cast("long") == F.col("__id"), "left_semi")
    return kept.select(*cols).unionByName(documents.where("doc_id is null").select(*cols)).coalesce(_files(documents))


#: jaccard_components in SQL: shingles by an inverted join, components by recursion.
SQL = r"""with recursive split as (select doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] as w from documents),
shingle as (select distinct doc_id, array_to_string(w[k : k + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as k from split where len(w) > 0)),
size as (select doc_id, count(*) as n from shingle group by doc_id),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as o from shingle a join shingle b on a.s = b.s and a.doc_id < b.doc_id group by all),
link as (select a, b from pair join size x on x.doc_id = a join size y on y.doc_id = b where 100 * o >= 75 * (x.n + y.n - o)),
edge as (select a, b from link union all select b, a from link),
reach(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, e.b from reach r join edge e on e.a = r.other)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, c.component_id from documents d left join size s using (doc_id) join (select doc_id, min(other) as component_id from reach group by doc_id) c using (doc_id)"""
