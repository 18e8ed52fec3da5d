"""Substring dedup: texts are cut into lines, and these at the ends of clauses; of repeated runs of such units the earliest stays, the others go, with their original offsets kept."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, stage, tune

#: Behind what a text is cut. Clauses end with a mark before white space (or with a full-width mark), and with their line.
CUTS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[ \t\r\f\v]*\n"), "clause": re.compile(r"\n|[.!?,;:][ \t\r\f\v]+|[。！？，；：]")}
#: Units with fewer words don't count: short ones repeat by chance. So many counted words make a repeated run a passage.
MIN_WORDS, RUN_WORDS = 3, 20


def units(text: str, mode: str = "clause") -> list[tuple[int, int]]:
    """(start, end) in code points, end exclusive, of the pieces of a text that hold a word; what follows a piece belongs to it up to the cut."""
    ends = [m.end() for m in CUTS[mode].finditer(text)]
    return [(a, z) for a, z in zip([0, *ends], [*ends, len(text)], strict=True) if a < z and not text[a:z].isspace()]


def normalised(unit: str) -> str:
    """Case folded away and runs of white space made one blank."""
    return " ".join(unit.lower().split())


def _units(mode: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, at = [], []
            rows: list[list[int]] = [[], [], [], []]
            for i, text in enumerate(b.column(2).to_pylist()):
                for k, (a, z) in enumerate(units(text, mode)):
                    words = text[a:z].lower().split()
                    digests.append(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest())
                    at.append(i)
                    for column, x in zip(rows, (k, a, z, len(words)), strict=True):
                        column.append(x)
            halves = pa.FixedSizeListArray.from_arrays(pa.Array.from_buffers(pa.int64(), 2 * len(at), [None, pa.py_buffer(b"".join(digests))]), 2).flatten() if at else pa.array([], pa.int64())
            d1, d2 = halves[::2] if len(at) else halves, halves[1::2] if len(at) else halves
            where = pa.array(at, pa.int64())
            cols = [d1, d2, b.column(0).take(where), b.column(1).take(where), *(pa.array(x, pa.int32()) for x in rows)]
            yield pa.RecordBatch.from_arrays(cols, names=["d1", "d2", "doc_id", "h", "k", "start", "end", "words"])

    return run


def passages(found: list[dict] | None, min_words: int, run_words: int) -> list[tuple[int, int]]:
    """Spans of the runs of neighbouring repeated units that hold ``run_words`` words or more in units of ``min_words`` and more."""
    out: list[list[int]] = []
    for u in sorted(found or [], key=lambda u: u["k"]):
        counted = u["words"] if u["words"] >= min_words else 0
        if out and out[-1][2] + 1 == u["k"]:
            out[-1][1:] = [u["end"], u["k"], out[-1][3] + counted]
        else:
            out.append([u["start"], u["end"], u["k"], counted])
    return [(a, z) for a, z, _, n in out if n >= run_words]


def remove_repeats(documents: DataFrame, mode: str = "clause", min_words: int = MIN_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """documents with the text that stays and three columns: ``n_units``, ``n_removed`` and ``removed_spans`` (start:end, comma-joined).

    Units (``line``, ``paragraph``, or ``clause``: lines cut further) are compared by a 128-bit digest of their normalised form over
    the whole corpus; the earliest by doc_id (null first), then a hash of the text, then offset, stays. Runs of neighbouring units
    that stand earlier are removed where they hold ``run_words`` words in units of ``min_words`` words or more; other repeated units
    stay. What stays is the text without the spans. Rows alike in doc_id and text are one document: they come out alike. A null
    text has no units and stays null, an empty one stays empty, an empty table gives no rows. Other columns stay; those with the
    three names are replaced.

    Digests are counted with partial sums before the exchange, so a unit that a third of all documents hold is a row for each task;
    only repeated ones are joined back, in joins of two written tables, whose frequent keys Spark splits.
    """
    tune(documents.sparkSession)
    added = ["n_units", "n_removed", "removed_spans"]
    own = [c for c in documents.columns if c not in added]
    digest, doc = ["d1", "d2"], ["doc_id", "h"]
    rows = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    found = stage(rows.mapInArrow(_units(mode), "d1 long, d2 long, doc_id long, h long, k int, start int, end int, words int"), "units")
    often = stage(found.groupBy(*digest).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*digest), "often")
    met = stage(found.join(often, digest), "repeated")
    discard(found, often)
    rank = F.struct(*doc, "start")
    first = stage(met.groupBy(*digest).agg(F.min(rank).alias("first")), "first")
    later = met.join(first, digest).where(F.col("first") != rank)
    gone = stage(later.groupBy(*doc).agg(F.collect_set(F.struct("k", "start", "end", "words")).alias("later")), "later")
    discard(met, first)
    aside = documents.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("__row"), F.col("doc_id").cast("long").alias("__doc_id"), F.xxhash64("text").alias("__h"))
    both = aside.join(gone, F.col("__doc_id").eqNullSafe(F.col("doc_id")) & (F.col("__h") == F.col("h")), "left").select("__row", "later")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = b.column("__row")
            texts = row.field(row.type.get_field_index("text")).to_pylist()
            spans = [[] if t is None else passages(x, min_words, run_words) for t, x in zip(texts, b.column("later").to_pylist(), strict=True)]
            kept = [t if t is None else "".join(t[z:a] for z, a in zip([0, *(s[1] for s in x)], [*(s[0] for s in x), len(t)], strict=True)) for t, x in zip(texts, spans, strict=True)]
            listed = [",".join(f"{a}:{z}" for a, z in s) for s in spans]
            n = [len(units(t, mode)) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([row, pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(listed, pa.string())], names=["__row", "__text", *added])

    kind = aside.schema["__row"].dataType.simpleString()
    done = both.mapInArrow(cut, f"__row {kind}, __text string, n_units long, n_removed long, removed_spans string")
    return done.select(*[(F.col("__text") if c == "text" else F.col(f"__row.`{c}`")).alias(c) for c in own], *added)


def repeat_report(documents: DataFrame) -> DataFrame:
    """op1: what is removed from each document, and the length and digest of what stays."""
    out = remove_repeats(documents.select("doc_id", "text"))
    return out.select("doc_id", "n_units", "n_removed", "removed_spans", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: The same result in SQL, by the normalised units themselves.
SQL = rf"""with tiles as (select doc_id, string_split(regexp_replace(text, '(\n|[.!?,;:][ \t\r\f\v]+|[。！？，；：])', '\1' || chr(1), 'g'), chr(1)) as p from documents where text is not null),
cut as (select doc_id, unnest(p) as tile, generate_subscripts(p, 1) as i from tiles),
placed as (select *, coalesce(sum(length(tile)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as a, trim(regexp_replace(lower(tile), '\s+', ' ', 'g')) as plain from cut),
unit as (select *, a + length(tile) as z, row_number() over (partition by doc_id order by i) as k, length(plain) - length(replace(plain, ' ', '')) + 1 as w from placed where plain <> ''),
ranked as (select *, row_number() over (partition by plain order by doc_id, a) as r from unit),
runs as (select *, k - row_number() over (partition by doc_id order by k) as g from ranked where r > 1),
spans as (select doc_id, min(a) as a, max(z) as z from runs group by doc_id, g having sum(case when w >= {MIN_WORDS} then w else 0 end) >= {RUN_WORDS}),
listed as (select doc_id, count(*) as n, string_agg(a || ':' || z, ',' order by a) as spans from spans group by doc_id),
kept as (select p.doc_id, string_agg(p.tile, '' order by p.i) filter (where s.a is null) as text from placed p left join spans s on s.doc_id = p.doc_id and p.a >= s.a and p.a < s.z group by p.doc_id),
counted as (select doc_id, count(*) as n from unit group by doc_id)
select d.doc_id, coalesce(c.n, 0)::bigint as n_units, coalesce(l.n, 0)::bigint as n_removed, coalesce(l.spans, '') as removed_spans,
  case when d.text is not null then length(coalesce(k.text, ''))::bigint end as kept_chars, case when d.text is not null then sha256(coalesce(k.text, '')) end as kept_sha256
from documents d left join counted c using (doc_id) left join listed l using (doc_id) left join kept k using (doc_id)"""
