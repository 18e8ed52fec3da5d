"""Document fingerprints by SimHash (Charikar, 2002), searched with permuted block tables (Manku et al., 2007)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import stage, tune

BITS = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(27))


def fingerprints(texts: list[str]) -> np.ndarray:
    """SimHash of each text: terms are adjacent word pairs (a lone word counts as a term), weighted by how often they occur.

    Words are split at ASCII white space. A text without words has fingerprint 0. Bits with a tied vote are 0.
    """
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    ends = np.cumsum([len(w) for w in words])
    flat = np.empty(int(ends[-1]) if len(ends) else 0, object)
    flat[:] = [x for w in words for x in w]
    h = pd.util.hash_array(flat, categorize=False) if len(flat) else np.empty(0, np.uint64)
    pairs = _mixed(h[:-1] * _ODD + h[1:]) if len(h) > 1 else h[:0]
    out, begin = np.zeros(len(texts), np.uint64), 0
    for i, end in enumerate(ends):
        votes = pairs[begin : end - 1] if end - begin > 1 else _mixed(h[begin:end])
        if len(votes):
            total = np.zeros(BITS, np.int64)
            for k in range(0, len(votes), 4096):
                total += np.unpackbits(votes[k : k + 4096].astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
            out[i] = np.packbits(2 * total > len(votes)).view(">u8")[0]
        begin = end
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits, 0 to 1."""
    return 1 - np.bitwise_count(a ^ b) / BITS


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_LINK = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("head", pa.string()), ("tail", pa.string()),
])
_LINK_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, part int, head string, tail string"


def _rows(ids: list, texts: list[str], following: list[str], fps: np.ndarray) -> dict:
    """The columns of complete rows. fps: of texts and of the last one's follower."""
    changed = [_edited(t, n) for t, n in zip(texts, following, strict=True)]
    edited = fingerprints(changed)
    return {
        "doc_id": ids, "n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
        "fingerprint": [f"{x:016x}" for x in fps[:-1].tolist()], "edited_fingerprint": [f"{x:016x}" for x in edited.tolist()],
        "near_edited": likeness(fps[:-1], edited), "near_next": likeness(fps[:-1], fps[1:]),
    }


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order -> each row but the last with what its follower gives; then a row with the part's first and last text."""
    last, head, part = None, None, 0
    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        if not ids:
            continue
        if head is None:
            head, part = texts[0], b.column(2)[0].as_py()
        if last is not None:
            ids, texts = [last[0], *ids], [last[1], *texts]
        last = ids[-1], texts[-1]
        if len(ids) > 1:
            cols = _rows(ids[:-1], texts[:-1], texts[1:], fingerprints(texts))
            cols |= {"part": [part] * (len(ids) - 1), "head": [None] * (len(ids) - 1), "tail": [None] * (len(ids) - 1)}
            yield pa.RecordBatch.from_pydict(cols, schema=_LINK)
    if last is not None:
        end = {f.name: [None] for f in _LINK} | {"doc_id": [last[0]], "part": [part], "head": [head], "tail": [last[1]]}
        yield pa.RecordBatch.from_pydict(end, schema=_LINK)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts, following = (b.column(i).to_pylist() for i in range(3))
        done = []
        for i, t, n in zip(ids, texts, following, strict=True):
            done.append(pd.DataFrame(_rows([i], [t], [n], fingerprints([t, n]))).astype({"doc_id": object}))
        if done:
            cols = pd.concat(done)
            yield pa.RecordBatch.from_pydict({c: cols[c].tolist() for c in _LINK.names[:7]}, schema=pa.schema(list(_LINK)[:7]))


def fingerprint_documents(documents: DataFrame, radius: int = 3, every: int = 100) -> DataFrame:
    """op4: fingerprints of each text and of its edited text, whose last half is replaced from the next document.

    n_near: how many other rows have a fingerprint within ``radius`` bits, by block tables over all rows; asked for those whose
    doc_id is divisible by ``every``, null for the others.

    Documents are put in order of doc_id (null first, then by a hash of the text) by one range exchange; each task streams its
    range and keeps one row back, and the parts' ends are closed afterwards, one row for each part. A null text counts as
    empty. Rows with equal doc_id and text follow each other. The only document follows itself.
    """
    tune(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text", F.spark_partition_id().alias("part"))
    linked = stage(ordered.mapInArrow(_follow, _LINK_DDL), "simhash")
    ends = linked.where("head is not null")
    # one narrow row for each part of the exchange, not for each document
    order = Window.orderBy("part")
    first = F.first("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = ends.select("part", "doc_id").withColumn("next", F.coalesce(F.lead("part").over(order), first)).select("part", "next")
    heads = ends.select(F.col("part").alias("next"), F.col("head").alias("following"))
    closing = ends.select("part", "doc_id", "tail").join(after, "part").join(heads, "next").select("doc_id", "tail", "following")
    done = closing.mapInArrow(_close, ", ".join(_LINK_DDL.split(", ")[:7]))
    out = linked.where("head is null").select(done.columns).unionByName(done)
    value = lambda c: F.conv(c, 16, -10).cast("long")
    out = stage(out.withColumn("__fp", value(F.col("fingerprint"))), "fingerprints")
    asked = F.when(F.col("doc_id") % every == 0, F.col("__fp"))
    near = count_within(out.select("__fp"), out.select(asked.alias("__fp")), "__fp", radius)
    return out.withColumn("__asked", asked).join(near.withColumnRenamed("__fp", "__asked"), "__asked", "left").select(*done.columns, (F.col("n_within") - 1).alias("n_near"))


def _masks(radius: int, blocks: int | None) -> list[int]:
    """The bits that each table's keys hold: of 64 bits cut into ``blocks`` blocks, each choice of blocks - radius."""
    blocks = blocks or radius + 2
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    return [sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def block_tables(fps: DataFrame, fingerprint: str, radius: int, blocks: int | None = None) -> DataFrame:
    """fps once for each table: ``table`` and ``key``, the bits of the blocks that this table holds in front.

    The 64 bits are cut into ``blocks`` blocks. Two fingerprints within ``radius`` agree on blocks - radius blocks at least, and
    there is a table for each choice of so many; so each such pair shares a key in some table. fingerprint: a long column.
    """
    signed = [m - (1 << 64) if m >> 63 else m for m in _masks(radius, blocks)]
    tables = F.array(*[F.struct(F.lit(t).alias("table"), F.col(fingerprint).bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(signed)])
    return fps.select("*", F.explode(tables).alias("__t")).select(*fps.columns, "__t.table", "__t.key")


#: Fingerprints of one key that a task holds against those that are asked for.
KEY_ROWS = 4096


def count_within(fps: DataFrame, queries: DataFrame, fingerprint: str, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """(fingerprint, n_within): for each distinct fingerprint of queries how many rows of fps are within ``radius``, equal ones included.

    Distinct fingerprints with their numbers of rows go through block tables, and tasks put out one count for each query and key,
    never pairs. A pair counts in the first table in which it shares a key. A key of many fingerprints is dealt to several tasks,
    each of which gets its queries. Null fingerprints match nothing; empty tables give no rows.
    """
    masks = np.array(_masks(radius, blocks), np.uint64)
    points = fps.where(F.col(fingerprint).isNotNull()).groupBy(F.col(fingerprint).alias("fp")).agg(F.count(F.lit(1)).alias("rows"))
    points = stage(block_tables(points, "fp", radius, blocks), "points")
    asked = block_tables(queries.where(F.col(fingerprint).isNotNull()).select(F.col(fingerprint).alias("fp")).distinct(), "fp", radius, blocks)
    large = stage(points.groupBy("table", "key").agg(F.ceil(F.count(F.lit(1)) / KEY_ROWS).alias("parts")).where("parts > 1"), "large-keys")
    dealt = points.join(large, ["table", "key"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("fp"), "parts"), F.lit(0)))
    asked = asked.join(large, ["table", "key"], "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)))
    cols = ["table", "key", "part", "rows", "fp"]
    both = dealt.select(*cols).unionByName(asked.withColumn("rows", F.lit(0).cast("long")).select(*cols)).repartition("table", "key", "part").sortWithinPartitions("table", "key", "part", "rows")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, at, found = np.empty(0, np.uint64), None, {}
        for b in batches:
            where = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(3)], 1)
            rows, fp = b.column(3).to_numpy(), b.column(4).to_numpy().view(np.uint64)
            cuts = np.concatenate([[0], np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1, [len(where)]]) if len(where) else [0]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if at != (here := tuple(where[a].tolist())):
                    at, ask = here, np.empty(0, np.uint64)
                k = a + np.searchsorted(rows[a:z], 1)  # queries, of no rows, come first
                ask = np.concatenate([ask, fp[a:k]])
                for i in range(k, z if len(ask) else k, 1024):
                    apart = ask[:, None] ^ fp[i : min(i + 1024, z)]
                    near = np.bitwise_count(apart) <= radius
                    for m in masks[: at[0]]:
                        near &= (apart & m) != 0
                    for q, n in zip(ask.tolist(), (near * rows[i : min(i + 1024, z)]).sum(1).tolist(), strict=True):
                        if n:
                            found[q] = found.get(q, 0) + n
        out = np.array(list(found), np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(list(found.values()), pa.int64())], names=["fp", "n"])

    return both.mapInArrow(count, "fp long, n long").groupBy(F.col("fp").alias(fingerprint)).agg(F.sum("n").alias("n_within"))


def distance(a: Column, b: Column) -> Column:
    """Bits in which two long fingerprints differ."""
    return F.bit_count(a.bitwiseXOR(b))


def find_within(fps: DataFrame, queries: DataFrame, id_col: str, fingerprint: str, radius: int = 3) -> DataFrame:
    """Per query id: the id and distance of every row with a fingerprint within ``radius``, equal fingerprints included, itself not.

    Search runs on distinct fingerprints, so copies cost one probe; members are joined at the end, so the result has a row for each
    query and member: ``count_within`` says how many these are. Null fingerprints match nothing, null ids are never partners, and
    an empty table gives no rows.
    """
    own = fps.where(F.col(fingerprint).isNotNull()).select(F.col(id_col).alias("id"), F.col(fingerprint).alias("fp"))
    ask = queries.where(F.col(fingerprint).isNotNull()).select(F.col(id_col).alias("query_id"), F.col(fingerprint).alias("qfp"))
    index = block_tables(own.select("fp").distinct(), "fp", radius)
    probes = block_tables(ask.select("qfp").distinct(), "qfp", radius)
    pairs = probes.join(index, ["table", "key"]).withColumn("distance", distance(F.col("qfp"), F.col("fp"))).where(F.col("distance") <= radius)
    pairs = pairs.select("qfp", "fp", "distance").distinct()
    return ask.join(pairs, "qfp").join(own, "fp").where("id <> query_id").select("query_id", "id", "distance")
