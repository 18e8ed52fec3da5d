"""Secret scans: fixed patterns, and tokens that a character model of random strings explains better than one of ordinary identifiers."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import tune

#: Kinds in the order in which they are listed where spans start alike.
KINDS = ("assign", "access", "hex", "random")
#: Letters of the first count in either case, but ASCII only. The lower limits that the contract sets are checked afterwards.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: A run of these shorter than the limit holds no match, and a longer one is matched from its start: so the limit can stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN_CHARS = 16
TOKEN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{TOKEN_CHARS},}}")
MASK = "[SECRET]"

_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
_CODE = np.full(256, len(_ALPHABET), np.uint8)
for _i, _c in enumerate(_ALPHABET):
    _CODE[ord(_c)] = _i
_SIZE = len(_ALPHABET) + 1


def _codes(token: str) -> np.ndarray:
    return _CODE[np.frombuffer(token.encode("ascii", "replace"), np.uint8)]


def markov(samples: Iterable[str], smooth: float = 0.5) -> np.ndarray:
    """Log probabilities of each character after each other one (the last row: at the start), with additive smoothing."""
    counts = np.full((_SIZE + 1, _SIZE), smooth)
    for s in samples:
        if s:
            c = _codes(s).astype(np.int64)
            np.add.at(counts, (np.concatenate([[_SIZE], c[:-1]]), c), 1)
    return np.log(counts / counts.sum(1, keepdims=True))


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratio of random against ordinary for each pair of characters; limits for a token's mean and sum."""

    ratio: np.ndarray
    mean: float = 0.9
    total: float = 20.0

    def score(self, token: str) -> tuple[float, float]:
        c = _codes(token).astype(np.int64)
        s = float(self.ratio[np.concatenate([[_SIZE], c[:-1]]), c].sum())
        return s / max(1, len(c)), s

    def is_random(self, token: str) -> bool:
        mean, total = self.score(token)
        return mean >= self.mean and total >= self.total


def train(random_samples: Iterable[str], ordinary_samples: Iterable[str], **limits: float) -> Model:
    """A model from labelled samples: strings known to be random, and identifiers and words known to be ordinary."""
    return Model(markov(random_samples) - markov(ordinary_samples), **limits)


def random_strings(n: int = 4000, seed: int = 20240229) -> list[str]:
    """Labelled random samples: hexadecimal, base 64, base 62 and upper-case base 32, 16 to 64 characters, from a fixed seed."""
    r = random.Random(seed)
    sets = ["0123456789abcdef", _ALPHABET[:62] + "+/", _ALPHABET[:62], _ALPHABET[26:52] + "234567", _ALPHABET[:62] + "_-"]
    return ["".join(r.choices(sets[i % len(sets)], k=r.randint(16, 64))) for i in range(n)]


#: Words of which ordinary identifiers are made.
WORDS = """
access account action address agent alpha amount array async axis back batch begin binary block body border branch buffer build byte cache call change channel
check child class code color column command common config connect content control count create current cursor data date default delete device
document domain draw driver element engine entry equal error event field file filter find folder frame function get global group
handle hash height help host import index info input install integer item join json key label layout length level limit line list load local lock
logger main manager map match matrix maximum memory message method mode model module name network next node number object offset option order output owner
package page parent parse password path pattern point prefix process profile proxy public query queue quiet quota quote random range reader record
region request require response result route schema screen search sequence server session shape signal size socket source stack start state status stream string style
switch symbol system table target task template test text thread timer title token trace tree type unique unit update upload user value vector version view visible volume
wait weight widget width window worker write xml year yield zero zone
""".split()


def ordinary_strings() -> list[str]:
    """Labelled ordinary samples: words alone, joined in the usual styles, as paths and versions; the same in every process."""
    r = random.Random(7)
    words = WORDS
    joined = [sep.join(r.choices(words, k=r.randint(2, 5))) for sep in ("_", "-", ".", "/", "") for _ in range(800)]
    camel = ["".join(w.title() for w in r.choices(words, k=r.randint(2, 4))) for _ in range(800)]
    shout = ["_".join(r.choices(words, k=r.randint(1, 4))).upper() for _ in range(800)]
    dated = [f"{r.choice(words)}-{r.randint(1, 99)}.{r.randint(0, 9)}.{r.randint(0, 9)}" for _ in range(200)]
    rules = [c * r.randint(16, 80) for c in "=-_./+" for _ in range(20)]
    numbers = [str(r.randint(0, 10**6)) for _ in range(100)]
    return [*words, *joined, *camel, *shout, *dated, *rules, *numbers]


_DEFAULT: list[Model] = []


def default_model() -> Model:
    """The model of the built-in labelled samples; made once in a process."""
    if not _DEFAULT:
        _DEFAULT.append(train(random_strings(), ordinary_strings()))
    return _DEFAULT[0]


def find_spans(text: str, model: Model | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, end exclusive, by start, then by kind as listed. Base spans are whole matches.

    Random tokens are looked for outside the base spans only, so base spans stay as they are: what a base span leaves of a token
    is judged piece by piece, from the same length on.
    """
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    if model is not None:
        base, first = sorted(spans), 0  # spans of one kind don't overlap, so ends go back over a few spans at most
        for m in TOKEN.finditer(text):
            at = m.start()
            while first < len(base) and max(b for _, b, _ in base[first : first + 3]) <= at:
                first += 1
            k = first
            while k < len(base) and base[k][0] < m.end():
                a, b, _ = base[k]
                if b > m.start():
                    if a - at >= TOKEN_CHARS and model.is_random(text[at:a]):
                        spans.append((at, a, 3))
                    at = max(at, b)
                k += 1
            if m.end() - at >= TOKEN_CHARS and model.is_random(text[at : m.end()]):
                spans.append((at, m.end(), 3))
    return [(a, b, KINDS[k]) for a, b, k in sorted(spans, key=lambda s: (s[0], s[2]))]


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each run of overlapping spans replaced by MASK."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


_ADDED = [
    ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_random", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()),
    ("redacted", pa.string()),
]
_DDL = "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string, redacted string"


def scan_secrets(documents: DataFrame, model: Model | None = None, with_text: bool = True) -> DataFrame:
    """documents with the secrets found in ``text``: counts by kind, the digest of the base spans, all spans, and the redacted text.

    One pass, nothing shuffled; the model is a table of fixed size. A null text counts as empty, and its redacted text is null.
    Columns that have the names of the added ones are replaced, others stay. ``with_text=False``: ``redacted`` is null.
    """
    tune(documents.sparkSession)
    model = model or default_model()

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                spans = find_spans(text or "", model)
                n = [sum(s[2] == k for s in spans) for k in KINDS]
                base = _listed([s for s in spans if s[2] != "random"])
                rows.append((*n, hashlib.sha256(base.encode()).hexdigest(), _listed(spans), redact(text, spans) if with_text and text is not None else None))
            own = [n for n in b.schema.names if n not in dict(_ADDED)]
            cols = [b.column(n) for n in own] + [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(_ADDED)]
            yield pa.RecordBatch.from_arrays(cols, names=own + [n for n, _ in _ADDED])

    own = documents.drop(*dict(_ADDED))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return own.mapInArrow(scanned, f"{kinds}, {_DDL}")


def secret_report(documents: DataFrame) -> DataFrame:
    """op9: counts of the base kinds, their digest and all spans for each document."""
    return scan_secrets(documents.select("doc_id", "text"), with_text=False).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


def redact_secrets(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """documents with secrets in ``text`` masked and ``n_chars``, if there, counted anew; the other columns stay, whatever their names."""
    cols = documents.columns
    aside = documents.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__row"), F.col("text"))
    out = scan_secrets(aside, model)
    new = {"text": F.col("redacted")} | ({"n_chars": F.length("redacted").cast(documents.schema["n_chars"].dataType)} if "n_chars" in cols else {})
    changed = F.col("n_assign") + F.col("n_access") + F.col("n_hex") + F.col("n_random") > 0
    return out.select(*[(F.when(changed, new[c]).otherwise(F.col(f"__row.`{c}`")) if c in new else F.col(f"__row.`{c}`")).alias(c) for c in cols])


def llr_accuracy(model: Model, random_held: list[str], ordinary_held: list[str]) -> tuple[float, float]:
    """Shares of held-out random and ordinary strings (16 characters and more) that the model takes for what they are."""
    long = [s for s in ordinary_held if len(s) >= 16]
    return sum(map(model.is_random, random_held)) / max(1, len(random_held)), 1 - sum(map(model.is_random, long)) / max(1, math.ceil(len(long)))
