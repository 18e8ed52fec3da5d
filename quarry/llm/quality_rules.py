"""Quality rules by compression bands: zstandard ratios of whole documents and of fixed chunks, with limits that depend on length."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import tune

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


#: Limits of the ratio (compressed over plain size) at log2 of a text's UTF-8 bytes; between these points they are drawn straight,
#: beyond them they stay level. Short texts hardly compress and carry the frame's overhead; long prose settles in a narrow band.
#: Set with a margin outside what texts labelled good reach (see ``ratio_table``).
LOW = ((6, 0.75), (6.5, 0.68), (7, 0.66), (7.5, 0.60), (8, 0.565), (8.5, 0.545), (9, 0.515), (9.5, 0.48), (10, 0.465), (10.5, 0.445), (11, 0.44), (11.5, 0.43), (12, 0.418), (12.5, 0.41), (13, 0.402), (13.5, 0.395), (14, 0.388), (15, 0.38), (16, 0.37), (18, 0.36))
HIGH = ((5, 1.45), (6, 1.25), (7, 1.05), (8, 0.88), (9, 0.80), (10, 0.68), (11, 0.62), (12, 0.58), (13, 0.54), (14, 0.51), (16, 0.50))
#: Chunks of CHUNK bytes: a share of more than CHUNK_SHARE outside CHUNK_BAND rejects.
CHUNK, CHUNK_BAND, CHUNK_SHARE, LEVEL = 4096, (0.40, 0.62), 0.34, 3


_ODD = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(16)]


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words that lie in a window of ``size`` words found twice or more in the text, first occurrences included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    mixed = np.zeros(n, np.uint64)
    for k in range(size):  # equal windows have equal sums; most texts have no two alike and end here
        mixed += (codes[k : n + k].astype(np.uint64) + np.uint64(1)) * _ODD[k]
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():
        return 0
    rank = codes
    for k in range(1, size):  # rank of each window, doubled word by word: exact, no hashing
        _, rank = np.unique(rank[: len(codes) - k] * len(ids) + codes[k:], return_inverse=True)
    twice = np.bincount(rank)[rank] > 1
    if not twice.any():
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + size, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(text.count(c) for c in _SPACE)
    symbols = sum(text.count(c) for c in _SYMBOLS)
    lines = Counter(x for x in text.split("\n") if x.strip(_SPACE))
    return len(words), chars, symbols, sum(lines.values()) - len(lines), repeated_words(words)


def ratios(data: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, list[float]]:
    """Compressed over plain size of the whole and of each chunk; a last chunk under half the size joins the one before."""
    if not data:
        return 1.0, []
    cuts = list(range(0, max(1, len(data) - CHUNK // 2), CHUNK))
    chunks = [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)]
    whole = len(compressor.compress(data)) / len(data)
    return whole, [len(compressor.compress(c)) / len(c) for c in chunks] if len(chunks) > 1 else [whole]


def verdict(size: int, whole: float, chunks: list[float]) -> bool:
    """True: inside the limits for its size, and no more than CHUNK_SHARE of its chunks outside theirs."""
    if not size:
        return False
    x = math.log2(size)
    if not np.interp(x, *zip(*LOW, strict=True)) <= whole <= np.interp(x, *zip(*HIGH, strict=True)):
        return False
    outside = sum(not CHUNK_BAND[0] <= r <= CHUNK_BAND[1] for r in chunks) if len(chunks) > 1 else 0
    return outside <= CHUNK_SHARE * len(chunks)


_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_ADDED = [*((n, pa.int64()) for n in _NAMES), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()), ("worst_chunk", pa.float64())]
_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, worst_chunk double"


def _judge(text: str | None, compressor: zstandard.ZstdCompressor) -> tuple:
    text = text or ""
    counts = base_counts(text)
    failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
    data = text.encode("utf-8", "surrogatepass")
    whole, chunks = ratios(data, compressor)
    return (*counts, failed, not failed and verdict(len(data), whole, chunks), whole, min(chunks, default=1.0))


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)
    for b in batches:
        found = [_judge(t, compressor) for t in b.column("text").to_pylist()]
        own = [n for n in b.schema.names if n not in dict(_ADDED)]
        cols = [b.column(n) for n in own] + [pa.array([x[i] for x in found], kind) for i, (_, kind) in enumerate(_ADDED)]
        yield pa.RecordBatch.from_arrays(cols, names=own + [n for n, _ in _ADDED])


def judge_quality(documents: DataFrame) -> DataFrame:
    """documents with the counts, the ratios and ``kept``. One pass, nothing shuffled.

    A null text counts as no text: all counts 0, rejected. Repeated rows are judged alike. Columns that have the names of the
    added ones are replaced, others stay.
    """
    tune(documents.sparkSession)
    own = documents.drop(*dict(_ADDED))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return own.mapInArrow(_judged, f"{kinds}, {_DDL}")


def quality_report(documents: DataFrame) -> DataFrame:
    """op7: the counts and the verdict for each document."""
    out = judge_quality(documents.select("doc_id", "text"))
    return out.select("doc_id", *_NAMES, "base_failed", "kept", "ratio", "worst_chunk")


def keep_good(documents: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns. Clashing names are set aside while judging, so they survive."""
    cols = documents.columns
    aside = documents.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__row"), F.col("text"))
    return judge_quality(aside).where("kept").select("__row.*").select(*[F.col(f"`{c}`") for c in cols])


def ratio_table(documents: pd.DataFrame) -> pd.DataFrame:
    """Ratios of a small pandas frame with ``text``: for setting the bands."""
    compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)
    found = [ratios((t or "").encode(), compressor) for t in documents["text"]]
    return documents.assign(size=[len((t or "").encode()) for t in documents["text"]], ratio=[x[0] for x in found], low=[min(x[1], default=1) for x in found], high=[max(x[1], default=1) for x in found])
