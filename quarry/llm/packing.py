"""Packing by lexical retrieval: a sharded BM25 index returns unused neighbours of each seed, which fill its window one after the other.

Terms are token ids, so document frequencies over the whole corpus fit in one table of vocabulary size.
"""

from __future__ import annotations

import json
import os
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stage, tune

WINDOW, END_ID, SHARD_TOKENS = 2048, 1, 4_000_000
K1, B = 1.2, 0.75
#: Characters of texts that are encoded together, so that a word is looked at once; encoded words that a worker remembers.
GATHERED, CACHE_WORDS = 8 << 20, 200_000
#: Latin letters that are precomposed and letters to every library (words are lower-case); symbols that the tokenizer never joins with letters.
LETTERS = "".join(map(chr, [*range(0x61, 0x7B), 0xAA, 0xB5, 0xBA, *range(0xDF, 0xF7), *range(0xF8, 0x250)]))
SYMBOLS = string.punctuation.replace("'", "")
#: Words of such letters, with such symbols behind them or not.
LATIN = f"^[{LETTERS}]{{1,200}}[{re.escape(SYMBOLS)}]{{0,200}}$"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Letters:
    """Ids of runs of letters or of symbols by the same merges, run by a faster library.

    A word's end is written as byte 0, which makes word-end symbols ordinary merges of first rank. Each token is the outcome of one
    merge, and what lies inside its bounds has gone through the same merges wherever it stands; so looking merges up by their
    outcome, as that library does, gives the same ids as looking them up by their parts.
    """

    def __init__(self, model: dict):
        import tiktoken

        byte, vocabulary = _byte_letters(), model["vocab"]
        raw = lambda w: bytes(byte[c] for c in w.removesuffix("</w>")) + (b"\0" if w.endswith("</w>") else b"")
        ranks = {bytes([b]): b for b in byte.values()}
        self.ids = np.zeros(512 + len(model["merges"]), np.int64)
        for c, b in byte.items():
            self.ids[b] = vocabulary[c]
            if b:
                ranks[bytes([b, 0])], self.ids[256 + b] = 256 + b, vocabulary[c + "</w>"]
        for i, m in enumerate(model["merges"]):
            w = "".join(m if isinstance(m, list) else m.split(" "))
            ranks[raw(w)], self.ids[512 + i] = 512 + i, vocabulary[w]
        if len(ranks) != 511 + len(model["merges"]):
            raise ValueError("two merges have one outcome")
        self.ends = np.zeros(len(self.ids), bool)
        self.ends[[r for w, r in ranks.items() if w.endswith(b"\0")]] = True
        self.coder = tiktoken.Encoding("letters", pat_str=r"[^\x00]*\x00", mergeable_ranks=ranks, special_tokens={})

    def encode(self, words: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs that each end with a null character, in a row, and where each run ends."""
        r = self.coder.encode_to_numpy(words)
        return self.ids[r], np.flatnonzero(self.ends[r]) + 1


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges one after the other."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))


class WordEncoder:
    """Ids of whole texts as a tokenizer of this kind gives them, word by word.

    The tokenizer lower-cases and never joins text over white space, so ids of a text are those of its words in a row. Where that
    might not hold (special tokens' strings, a capital sigma) the whole text goes through the tokenizer, and so does each word
    that isn't of Latin letters with symbols behind them or not. Of the latter the tokenizer takes letters and symbols apart, so
    distinct ones of each are encoded.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = max(self.tokenizer.get_vocab().values()) + 1
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            self.letters = _Letters(json.load(f)["model"])
        self.cache: dict[str, np.ndarray] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def _other(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words that aren't of Latin letters, by the tokenizer."""
        if new := [w for w in words if w not in self.cache]:
            if len(self.cache) + len(new) > CACHE_WORDS:
                self.cache, new = {}, words
            for w, e in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False), strict=True):
                self.cache[w] = np.array(e.ids, np.int64)
        return [self.cache[w] for w in words]

    def _runs(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Distinct runs of letters and of symbols in words of LATIN, and which are each word's two; the second may be empty."""
        letters, symbols = pc.ascii_rtrim(words, SYMBOLS).dictionary_encode(), pc.utf8_ltrim(words, LETTERS).dictionary_encode()
        first = len(letters.dictionary)
        which = np.column_stack([letters.indices.to_numpy(), first + symbols.indices.to_numpy()]).ravel()
        return pa.concat_arrays([letters.dictionary, symbols.dictionary]), which

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct words where in a row of ids each one's begin and how many they are; the row."""
        latin = pc.match_substring_regex(words, LATIN)
        fast = words.filter(latin)
        starts, lengths = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        at = latin.to_numpy(zero_copy_only=False)
        rows = [np.empty(0, np.int64)]
        if len(fast):
            runs, which = self._runs(fast)
            joined = pc.binary_join(pa.LargeListArray.from_arrays([0, len(runs)], runs), pa.scalar("\0", runs.type))[0].as_py()
            ids, ends = self.letters.encode(joined + "\0")
            begin, size = np.concatenate([[0], ends[:-1]]), np.where(pc.binary_length(runs).to_numpy() > 0, np.diff(ends, prepend=0), 0)
            n = size[which]
            rows.append(ids[_ranges(begin[which], n)])
            lengths[at] = n.reshape(-1, 2).sum(1)
            starts[at] = np.cumsum(lengths[at]) - lengths[at]
        if len(fast) < len(words):
            other = self._other(words.filter(pc.invert(latin)).to_pylist())
            n = np.array([len(x) for x in other])
            starts[~at], lengths[~at] = len(rows[-1]) + np.cumsum(n) - n, n
            rows += other
        return starts, lengths, np.concatenate(rows).astype(self.kind)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian, without an end id."""
        plain = ["<|" in t or "Σ" in t for t in texts]
        split = pc.split_pattern(pa.array(["" if p else t.lower().replace("\n", " ") for t, p in zip(texts, plain, strict=True)], pa.large_string()), " ")
        found = split.flatten().dictionary_encode()
        starts, lengths, row = self._words(found.dictionary)
        which = found.indices.to_numpy()
        n = lengths[which]
        data, width = row[_ranges(starts[which], n)].tobytes(), self.kind.itemsize
        bounds = (np.concatenate([[0], np.cumsum(n)])[split.offsets.to_numpy() - split.offsets[0].as_py()] * width).tolist()
        return [self._ids(t).tobytes() if p else data[a:z] for t, p, a, z in zip(texts, plain, bounds, bounds[1:], strict=False)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of a file; one in a worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


_TOKENS = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("ids", pa.binary()), ("term", pa.int32()), ("df", pa.int64())])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches together while their texts are no longer than GATHERED bytes."""
    held, size = [], 0
    for b in batches:
        n = b.column(1).nbytes
        if held and size + n > GATHERED:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        held.append(b)
        size += n
    if held:
        yield pa.Table.from_batches(held)


def _tokenised(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        df, last, seen = np.zeros(e.size, np.int64), np.zeros(e.size, np.int64), {}
        end = np.array([end_id], e.kind).tobytes()
        for t in _gathered(batches):
            ids, place = t.column(0).to_pylist(), t.column(2).to_pylist()
            blobs = [x + end for x in e.encode(t.column(1).to_pylist())]
            for k, blob in enumerate(blobs):
                row = np.frombuffer(blob, e.kind)
                places = np.arange(len(row))
                last[row] = places
                df[row[last[row] == places]] += 1  # each id once, where it stands last
                n = seen[place[k]] = seen.get(place[k], -1) + 1  # repeated rows are dealt apart
                place[k] ^= (n * 0x9E3779B97F4A7C15) & 0x7FFFFFFFFFFFFFFF
            none = [None] * len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(place, pa.int64()), pa.array(blobs, pa.binary()), pa.array(none, pa.int32()), pa.array(none, pa.int64())], schema=_TOKENS)
        at = np.flatnonzero(df)
        none = [None] * len(at)
        yield pa.RecordBatch.from_arrays([pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.binary()), pa.array(at.astype(np.int32)), pa.array(df[at])], schema=_TOKENS)

    return run


def _rarity(df: np.ndarray, n: int) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5))


class _Index:
    """BM25 weights of documents (``of``: which of docs) by term.

    Terms that over an eighth of the documents hold are also rows of a dense table, which are added faster than lists.
    """

    def __init__(self, docs: list[np.ndarray], of: np.ndarray, idf: np.ndarray, mean: float):
        size = np.array([len(docs[d]) for d in of.tolist()], np.int64)
        kind = np.uint32 if len(idf) * len(of) < 1 << 32 else np.uint64
        key = np.concatenate([docs[d] for d in of.tolist()] or [np.empty(0, kind)]).astype(kind) * kind(len(of)) + np.repeat(np.arange(len(of), dtype=kind), size)
        key.sort()
        first = np.flatnonzero(np.concatenate([key[:1] == key[:1], key[1:] != key[:-1]]))
        tf = np.diff(first, append=len(key))
        term, doc = (x.astype(np.int64) for x in np.divmod(key[first], kind(max(1, len(of)))))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / mean))
        self._set(of, np.searchsorted(term, np.arange(len(idf) + 1)), doc, weight)

    def _set(self, of: np.ndarray, bounds: np.ndarray, doc: np.ndarray, weight: np.ndarray) -> None:
        self.of, self.bounds, self.begin, self.doc, self.weight = of, bounds, bounds.tolist(), doc, weight
        often = np.flatnonzero(np.diff(bounds) * 8 > len(of))
        self.row, dense = np.full(len(bounds) - 1, -1), np.zeros((len(often), len(of)))
        self.row[often] = np.arange(len(often))
        for r, t in enumerate(often.tolist()):
            dense[r, doc[self.begin[t] : self.begin[t + 1]]] = weight[self.begin[t] : self.begin[t + 1]]
        self.dense = list(dense)

    def keep(self, these: np.ndarray) -> None:
        """Drop the other documents; these: for each of ``of``."""
        at = these[self.doc]
        bounds = np.concatenate([[0], np.cumsum(at)])[self.bounds]
        self._set(self.of[these], bounds, (np.cumsum(these) - 1)[self.doc[at]], self.weight[at])

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """Of each document for a query of distinct terms."""
        row = self.row[terms]
        score = np.zeros(len(self.of))
        if at := [slice(self.begin[t], self.begin[t + 1]) for t in terms[row < 0].tolist()]:
            score += np.bincount(np.concatenate([self.doc[x] for x in at]), np.concatenate([self.weight[x] for x in at]), len(self.of))
        for r in row[row >= 0].tolist():
            np.add(score, self.dense[r], score)
        return score


def pack_shard(docs: list[np.ndarray], df: np.ndarray, n: int, mean: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard's token arrays.

    A long document's full windows come first, each a sequence of its own; what is left of each document is packed: the seed is
    the document that the last window cut, or else the first unused one, and its best unused neighbours, by BM25 over all of the
    seed's distinct terms, follow until the window is full; the last is cut there. So only the shard's last sequence is not full.
    """
    out, sequence, tail = [], 0, []
    for d, ids in enumerate(docs):
        full = len(ids) // window
        out += [(d, k * window, window, sequence + k, 0) for k in range(full)]
        sequence += full
        tail.append(full * window)
    left = [len(ids) - t for ids, t in zip(docs, tail, strict=True)]
    unused = np.array([x > 0 for x in left])
    index = _Index(docs, np.flatnonzero(unused), _rarity(df, n), mean)
    seed, filled, first = -1, 0, 0
    queue: Iterator[int] = iter(())

    def neighbours(d: int) -> Iterator[int]:
        if len(index.of) > 256 and 4 * np.count_nonzero(unused) < 3 * len(index.of):  # used documents fall out of the index
            index.keep(unused[index.of])
        score, of = index.scores(np.unique(docs[d])) * unused[index.of], index.of
        found = np.flatnonzero(score)
        if len(found) > 64:  # the best are asked for first, the others if those are used up
            best = np.argpartition(-score[found], 64)
            yield from of[found[best[:64]][np.argsort(-score[found[best[:64]]], kind="stable")]].tolist()
            found = found[best[64:]]
        yield from of[found[np.argsort(-score[found], kind="stable")]].tolist()

    while True:
        if seed < 0:  # the next piece: a neighbour, or else the first unused document, which is asked for neighbours in turn
            seed = next((d for d in queue if unused[d]), -1)
            if seed < 0:
                while first < len(docs) and not unused[first]:
                    first += 1
                if first == len(docs):
                    return out
                seed, queue = first, neighbours(first)
            unused[seed] = False
        take = min(left[seed], window - filled)
        out.append((seed, len(docs[seed]) - left[seed], take, sequence, filled))
        filled, left[seed] = filled + take, left[seed] - take
        if filled == window:
            filled, sequence = 0, sequence + 1
            if left[seed]:
                queue = neighbours(seed)
                continue
            queue = iter(())
        seed = -1


_PIECES = pa.schema([("doc_id", pa.int64()), *((x, pa.int64()) for x in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])
_PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(documents: DataFrame, tokenizer: str | None = None, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """op10: the pieces of all documents in sequences of at most ``window`` tokens.

    Texts are encoded once and staged as binary ids. Document frequencies come from all documents. Each document goes to one of
    the index's shards by a hash; shards hold about ``shard_tokens`` tokens whatever the corpus, so a task's memory is bounded and
    repeated rows are dealt apart. A null or empty text is the end id alone. Sequence ids are unique, not gapless.
    """
    tune(documents.sparkSession)
    path = tokenizer or default_tokenizer()
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("place"))
    tokens = stage(rows, "tokens", arrow=True, mapped=(_tokenised(path, END_ID), "doc_id long, place long, ids binary, term int, df long"))
    width = encoder(path).kind.itemsize
    whole = tokens.agg(F.count("ids").alias("n"), F.coalesce(F.sum(F.octet_length("ids")), F.lit(0)).alias("bytes")).first()
    n, total = whole["n"], whole["bytes"] // width
    df = np.zeros(encoder(path).size, np.int64)
    for r in tokens.where("term is not null").groupBy("term").agg(F.sum("df").alias("df")).collect():  # vocabulary size at most
        df[r["term"]] = r["df"]
    kind, mean, shards = encoder(path).kind, max(1.0, total / max(1, n)), max(1, -(-total // shard_tokens))
    shared = documents.sparkSession.sparkContext.broadcast(df)

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("place", "ascending")])
        docs = [np.frombuffer(x.as_buffer(), kind) for x in table.column("ids")]
        ids, shard = table.column("doc_id").to_pylist(), table.column("shard")[0].as_py()
        found = pack_shard(docs, shared.value, n, mean, window)
        rows = [(ids[d], s, k, zlib.crc32(docs[d][s : s + k].astype("<u4").tobytes()), len(docs[d]), (shard << 32) + q, at) for d, s, k, q, at in found]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_PIECES)

    held = tokens.where("ids is not null").select("doc_id", "place", "ids", F.pmod("place", F.lit(shards)).alias("shard"))
    return held.groupBy("shard").applyInArrow(packed, _PIECES_DDL)
