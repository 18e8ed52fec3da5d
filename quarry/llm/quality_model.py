"""Quality classifier from weak labels: EM estimates how far overlapping heuristic labellers can be trusted (Dawid and Skene, 1979),
and a linear scorer on hashed features is trained on the posterior labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stage, tune
from quarry.llm.quality_rules import LEVEL, base_counts, ratios, verdict

#: Hashed features; most rows that the scorer is fitted on, those with the smallest hashes of doc_id and text.
FEATURES, FIT_ROWS, EPOCHS, SEED = 1 << 16, 6000, 8, 11
#: Frequent short words of four languages.
STOP = frozenset(b"the of and to in is that it for a de la que el en los del le les des et un une der die und das den von zu mit ist ou was as are on".split())
LABELLERS = ("symbols", "capitals", "repeats", "length", "echoes", "compression", "marks", "stop_words", "word_length")


def votes(text: str, compressor: zstandard.ZstdCompressor) -> list[int]:
    """Each labeller's vote on a text: 1 good, -1 bad, 0 none, in the order of LABELLERS."""
    n, chars, symbols, _, repeated = base_counts(text)
    if not n:
        return [0, 0, 0, -1, 0, 0, 0, 0, 0]
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    low = data.lower().split()
    echoes = sum(a == b for a, b in zip(low, low[1:], strict=False)) / n
    capitals = sum(w.isupper() and len(w) > 1 for w in words) / n
    marked = sum(len(w) > 2 and not w[-2:].strip(b"!?#*$%&|<>") for w in words) / n
    stop = sum(w in STOP for w in low) / n
    whole, chunks = ratios(data, compressor)
    size = chars / n
    between = lambda x, good, bad: 1 if x <= good else -1 if x >= bad else 0
    return [
        between(symbols / n, 0.02, 0.10), between(capitals, 0.10, 0.40), between(repeated / n, 0.05, 0.20), -1 if n < 10 else 1 if n >= 30 else 0,
        between(echoes, 0.03, 0.15), 1 if verdict(len(data), whole, chunks) else -1, between(marked, 0.02, 0.10), between(-stop, -0.10, -0.02), 1 if 3 <= size <= 9 else -1 if not 2 <= size <= 14 else 0,
    ]


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """EM over distinct vote patterns (rows of -1, 0, 1) and how often each occurs: the share of good, and p(vote | class).

    The table is (labeller, class bad or good, vote -1, 0, 1). Starts at labellers that are right four times of five.
    """
    k = patterns.shape[1]
    table = np.tile(np.array([[0.6, 0.25, 0.15], [0.15, 0.25, 0.6]]), (k, 1, 1))
    prior, one_hot = 0.8, (patterns[:, :, None] == np.array([-1, 0, 1])).astype(float)
    for _ in range(rounds):
        q = posterior(patterns, prior, table)
        w = np.stack([(1 - q) * counts, q * counts])
        new = np.einsum("cp,pkv->kcv", w, one_hot) + 0.5
        new /= new.sum(2, keepdims=True)
        moved = np.abs(new - table).max()
        prior, table = float(np.clip(w[1].sum() / max(1.0, counts.sum()), 0.01, 0.99)), new
        if moved < 1e-7:
            break
    return prior, table


def posterior(patterns: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    """Probability that a text with these votes is good."""
    at = np.log(table)[np.arange(patterns.shape[1])[None, :], :, patterns + 1].sum(1)
    return 1 / (1 + np.exp(np.clip(at[:, 0] - at[:, 1] + np.log1p(-prior) - np.log(prior), -500, 500)))


def hashed_features(texts: list[str]) -> Iterator[tuple[np.ndarray, int]]:
    """For each text the features of its words, with repeats, and the number of words: the word itself, its last two bytes, and whether it echoes the one before."""
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    flat = [w for ws in words for w in ws]
    if not flat:
        yield from ((np.zeros(0, np.int64), 0) for _ in texts)
        return
    whole = pd.util.hash_array(np.array([w.lower() for w in flat], object), categorize=False)
    ends = pd.util.hash_array(np.array([b"~" + w[-2:] for w in flat], object), categorize=False)
    echo = np.where(whole == np.concatenate([~whole[:1], whole[:-1]]), np.uint64(1), np.uint64(2))
    at = (np.stack([whole, ends], 1) % np.uint64(FEATURES - 3) + np.uint64(3)).astype(np.int64)
    at = np.concatenate([at, echo[:, None].astype(np.int64)], 1)
    begin = 0
    for ws in words:
        yield at[begin : begin + len(ws)].ravel(), len(ws)
        begin += len(ws)


def counted(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct features and how often each occurs, as 16 and 32 bits: FEATURES of them at most, however long the text."""
    u, c = np.unique(at, return_counts=True)
    return u.astype("<u2"), c.astype("<u4")


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of a logistic scorer by AdaGrad on soft labels; weight 0 belongs to the intercept. rows: distinct features and their counts."""
    w, g, r = np.zeros(FEATURES), np.full(FEATURES, 1e-2), np.random.default_rng(SEED)
    unique = [(u.astype(np.int64), c / max(1, int(c.sum()) // 3)) for u, c in rows]
    for _ in range(epochs):
        for i in r.permutation(len(rows)):
            at, x = unique[i]
            err = 1 / (1 + np.exp(-np.clip(w[0] + w[at] @ x, -30, 30))) - labels[i]
            grad = np.append(err * x + 1e-6 * w[at], err)
            at = np.append(at, 0)
            g[at] += grad**2
            w[at] -= 0.3 * grad / np.sqrt(g[at])
    return w


def score(w: np.ndarray, at: np.ndarray, n: int) -> float:
    """Probability of good: the weights' mean over the words, and the intercept."""
    return float(1 / (1 + np.exp(-np.clip(w[0] + w[at].sum() / max(1, n), -30, 30))))


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    c = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)
    for b in batches:
        code = ["".join("-0+"[v + 1] for v in votes(t, c)) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("place"), pa.array(code, pa.string())], names=["doc_id", "place", "votes"])


def _decode(codes: list[str]) -> np.ndarray:
    return np.array([["-0+".index(c) - 1 for c in x] for x in codes], np.int64).reshape(-1, len(LABELLERS))


def classify_quality(documents: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = 0.5) -> DataFrame:
    """op8: (doc_id, score, kept) for each document row.

    Votes of all documents are counted by pattern, of which there are 3 ** 9 at most, so EM runs over the whole corpus in a table
    of bounded size. The scorer is fitted on ``fit_rows`` rows at most and its weights, FEATURES numbers, score every document.
    kept: score of threshold or more. A null text counts as empty. Rows alike in doc_id and text come out alike. An empty table
    gives no rows.
    """
    spark = documents.sparkSession
    tune(spark)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("place", F.xxhash64("doc_id", "text"))
    voted = stage(rows.mapInArrow(_voted, "doc_id long, place long, votes string"), "votes")
    seen = voted.groupBy("votes").count().orderBy("votes").collect()  # 3 ** 9 rows at most
    patterns, counts = _decode([r["votes"] for r in seen]), np.array([r["count"] for r in seen], float)
    prior, table = fit_labellers(patterns, counts)
    belief = dict(zip([r["votes"] for r in seen], posterior(patterns, prior, table).tolist(), strict=True))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [counted(x) for x, _ in hashed_features(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[i].tobytes() for x in got], pa.binary()) for i in (0, 1))], names=["place", "at", "count"])

    lowest = voted.select("place").distinct().orderBy("place").limit(fit_rows)
    sample = rows.join(lowest, "place", "left_semi").dropDuplicates(["place"]).select("place", "text").mapInArrow(hashed, "place long, at binary, count binary")
    sample = sample.join(voted.select("place", "votes").dropDuplicates(["place"]), "place").orderBy("place").collect()  # fit_rows at most
    found = [(np.frombuffer(r["at"], "<u2"), np.frombuffer(r["count"], "<u4")) for r in sample]
    weights = fit_scorer(found, np.array([belief[r["votes"]] for r in sample]))
    shared = spark.sparkContext.broadcast(weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [score(shared.value, at, n) for at, n in hashed_features(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64()), pa.array([x >= threshold for x in s], pa.bool_())], names=["doc_id", "score", "kept"])

    return rows.select("doc_id", "text").mapInArrow(scored, "doc_id long, score double, kept boolean")
