"""Mixing sources to target weights: fixed-length blocks, drawn for output shards and looked up through pseudorandom permutations.

The words of a source stand in one stream, cut into blocks of ``block_words``. The mix has one slot for each block it takes.
Slot counts of sources in an output shard are multinomial draws given the corpus totals: a pseudorandom permutation deals the
slots of all sources over the shards, so totals meet the targets and each shard is a random draw. A source's k-th slot takes
block ``perm(k mod n)`` of epoch ``k div n``, where each epoch permutes the source's n blocks anew; so no block comes up twice
before all have come up once. Only ``block_slots`` shows shards: op6 and the corpus count over all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import repeat_rows, running_total, stage, tune

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS, SHARD_SLOTS, MOST, SEED = 64, 4096, 3, 17
#: Slots that a task makes.
PART_SLOTS = 100_000


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def permuted(n: np.ndarray, key: np.ndarray, x: np.ndarray) -> np.ndarray:
    """x's image under a pseudorandom permutation of 0..n-1 chosen by key: a four-round Feistel network that is walked until inside."""
    n, key, x = n.astype(np.uint64), key.astype(np.uint64), x.astype(np.uint64)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(float) + 1)).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)

    rounds = np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def walk(i: np.ndarray) -> np.ndarray:
        a, b, m = x[i] >> half[i], x[i] & mask[i], mask[i]
        for r in range(4):
            f = (b + rounds[r]) ^ key[i]
            f = (f ^ (f >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            a, b = b, a ^ ((f ^ (f >> np.uint64(31))) & m)
        return (a << half[i]) | b

    out, i = x.copy(), np.arange(len(x))
    while len(i):
        x[i] = out[i] = walk(i)
        i = i[out[i] >= n[i]]
    return out.astype(np.int64)


@F.pandas_udf(T.LongType())
def _permuted(n: pd.Series, key: pd.Series, x: pd.Series) -> pd.Series:
    return pd.Series(permuted(n.to_numpy(np.int64), key.to_numpy(np.int64).view(np.uint64), x.to_numpy(np.int64)), n.index)


def source_targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """sizes (source, source_size) with rank, weight and target.

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share the sum of all sizes. A target stops at ``most`` times
    its source's size; what is over is shared anew by weight until none is above. In the order of size over weight the sources
    that stop come first, so running sums over one row for each source give the result without rounds.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", (F.col("rank") % 3 + 1).cast("double")).withColumn("cap", (most * F.col("source_size")).cast("double"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    nil = lambda c: F.coalesce(c, F.lit(0.0))
    total, weights = F.sum("source_size").over(whole).cast("double"), F.sum("weight").over(whole)
    ranked = ranked.withColumn("__level", (total - nil(F.sum("cap").over(by))) / (weights - nil(F.sum("weight").over(by))))
    ranked = ranked.withColumn("__stops", F.col("cap") <= F.col("__level") * F.col("weight"))
    spent = nil(F.sum(F.when(F.col("__stops"), F.col("cap"))).over(whole))
    sharing = nil(F.sum(F.when(~F.col("__stops"), F.col("weight"))).over(whole))
    level = (total - spent) / F.when(sharing > 0, sharing)
    return ranked.withColumn("target", F.when(F.col("__stops"), F.col("cap")).otherwise(level * F.col("weight"))).drop("cap", "__level", "__stops")


def _others(documents: DataFrame) -> Column:
    """A hash of the columns other than doc_id, source and text."""
    cols = [(F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else F.col(f"`{f.name}`")) for f in documents.schema if f.name not in ("doc_id", "source", "text")]
    return F.xxhash64(*cols, F.lit(0))


def _plan(documents: DataFrame, block_words: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their place in the source's stream; sources with targets and slot counts; slots (rank, block, shard, slot).

    Slots are made from one row for each source, so the planner takes them for a small table, which they aren't: joins with them
    must ask for a merge join, or else they would be broadcast.
    """
    tune(documents.sparkSession)
    rows = stage(documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("h"), _others(documents).alias("o")), "mix-rows", arrow=True)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    blocks = F.ceil(F.col("source_size") / block_words)
    sources = source_targets(sizes).withColumn("n_blocks", blocks.cast("long"))
    slots_of = F.round(F.col("target") * F.col("n_blocks") / F.when(F.col("source_size") > 0, F.col("source_size")))
    sources = stage(sources.withColumn("n_slots", F.coalesce(slots_of, F.lit(0)).cast("long")), "mix-sources", arrow=True)
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    deal = sources.select(
        "rank", "n_blocks", "n_slots", F.coalesce(F.sum("n_slots").over(upto), F.lit(0)).cast("long").alias("begin"),
        F.sum("n_slots").over(Window.partitionBy(F.lit(0))).alias("all"),
    ).where("n_slots > 0")
    n_slots = sources.agg(F.coalesce(F.sum("n_slots"), F.lit(0))).first()[0]
    slots = repeat_rows(deal, "n_slots", "k", parts=n_slots // PART_SLOTS + 1)
    place = _permuted(F.col("all"), F.lit(seed).cast("long"), F.col("begin") + F.col("k"))
    key = F.xxhash64(F.lit(seed), F.col("rank"), F.expr("k div n_blocks"))
    slots = slots.select("rank", place.alias("place"), _permuted(F.col("n_blocks"), key, F.col("k") % F.col("n_blocks")).alias("block"))
    slots = slots.select("rank", "block", F.expr(f"place div {SHARD_SLOTS}").alias("shard"), (F.col("place") % SHARD_SLOTS).alias("slot"))
    known = sources.select(F.col("source").alias("__source"), "rank", "source_size", "target")
    placed = rows.join(known, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    return running_total(placed, ["rank"], ["doc_id", "h", "o"], "size", "begin"), sources, slots


def _pieces(rows: DataFrame, block_words: int) -> DataFrame:
    """A row for each block that a document reaches into: its words ``from`` to ``to`` (exclusive), counted in the document."""
    first, last = F.expr(f"begin div {block_words}"), F.expr(f"(begin + size - 1) div {block_words}")
    pieces = rows.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("block") * block_words, F.col("begin")) - F.col("begin")
    end = F.least((F.col("block") + 1) * block_words, F.col("begin") + F.col("size")) - F.col("begin")
    return pieces.withColumn("from", start).withColumn("to", end)


def block_slots(documents: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mix slot by slot: shard, slot, and the pieces (doc_id, words from, to) of the block that it takes, joined by block index."""
    rows, _, slots = _plan(documents, block_words, seed)
    return slots.hint("merge").join(_pieces(rows, block_words).select("rank", "block", "doc_id", "from", "to"), ["rank", "block"]).select("shard", "slot", "doc_id", "from", "to")


def mix_documents(documents: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """op6: for each document row its size, its source's size and target, and the words that the mix takes of it.

    A null source is a source of its own; documents without words (or with null text) have size 0 and give nothing. Rows alike
    in doc_id, source and text share their source's draws as separate rows. Equal inputs give equal results.
    """
    rows, _, slots = _plan(documents, block_words, seed)
    times = slots.groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times"))
    got = _pieces(rows, block_words).join(times.hint("merge"), ["rank", "block"])
    got = got.groupBy("rank", "begin").agg(F.sum((F.col("to") - F.col("from")) * F.col("times")).alias("taken"))  # begin is unique where size > 0
    full = rows.where("size > 0").join(got, ["rank", "begin"], "left")
    none = rows.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    cols = ["doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")]
    return full.select(*cols).unionByName(none.select(*cols))


def _cut(text: str, parts: list[tuple[int, int, int]]) -> str:
    """The words of the parts (from, to, times), each as often as it says: round by round, runs of words with the text between them."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    space = np.concatenate([[True], (data == 32) | ((data >= 9) & (data <= 13)), [True]])
    starts = np.flatnonzero(space[:-2] & ~space[1:-1])
    ends = np.flatnonzero(~space[1:-1] & space[2:]) + 1
    out, raw = [], data.tobytes()
    for k in range(1, max(t for _, _, t in parts) + 1):
        run: list[list[int]] = []
        for a, b, t in sorted(parts):
            if t >= k and run and run[-1][1] == a:
                run[-1][1] = b
            elif t >= k:
                run.append([a, b])
        out += [raw[starts[a] : ends[b - 1]] for a, b in run]
    return b"\n".join(out).decode("utf-8", "surrogatepass")


def mixed_corpus(documents: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The documents as the mix takes them: texts hold the words taken, repeats included; documents of which it takes none are gone.

    The other columns stay. Rows alike in every column come out as one that holds what all of them give; rows that differ in any
    column stay apart. A null or empty text gives nothing, so its row is gone; an empty table gives no rows; a null doc_id or
    source is a value like others.
    """
    rows, _, slots = _plan(documents, block_words, seed)
    times = slots.groupBy("rank", "block").agg(F.count(F.lit(1)).cast("int").alias("times"))
    got = _pieces(rows, block_words).join(times.hint("merge"), ["rank", "block"])
    got = got.groupBy("doc_id", "source", "h", "o", "from", "to").agg(F.sum("times").cast("int").alias("times"))
    parts = got.groupBy("doc_id", "source", "h", "o").agg(F.collect_list(F.struct("from", "to", "times")).alias("__parts"))
    cols = documents.columns
    aside = documents.where(word_count(F.col("text")) > 0).select(
        F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__row"), F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.xxhash64("text").alias("__h"), _others(documents).alias("__o")
    ).dropDuplicates(["__id", "__source", "__h", "__o"])
    same = F.col("__id").eqNullSafe(F.col("doc_id")) & F.col("__source").eqNullSafe(F.col("source")) & (F.col("__h") == F.col("h")) & (F.col("__o") == F.col("o"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("__row").field(b.schema.field("__row").type.get_field_index("text")).to_pylist()
            new = [_cut(t, [(p["from"], p["to"], p["times"]) for p in ps]) for t, ps in zip(texts, b.column("__parts").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("__row"), pa.array(new, pa.string())], names=["__row", "__text"])

    row = aside.schema["__row"].dataType.simpleString()
    done = aside.join(parts, same).select("__row", "__parts").mapInArrow(cut, f"__row {row}, __text string")
    new = {"text": F.col("__text")} | ({"n_chars": F.length("__text").cast(documents.schema["n_chars"].dataType)} if "n_chars" in cols else {})
    return done.select(*[(new[c] if c in new else F.col(f"__row.`{c}`")).alias(c) for c in cols])
