"""The pattern tables, parsed: extraction works on any such tables, so a user can add languages by passing their own."""

from __future__ import annotations

from dataclasses import dataclass

from quarry.functions import fixed


@dataclass(frozen=True)
class SymbolPattern:
    lang: str
    type: str
    group: int
    regex: str


@dataclass(frozen=True)
class ImportPattern:
    lang: str
    groups: tuple[int, ...]
    regex: str


def words(text: str) -> list[str]:
    return text.split()


def _lines(text: str, fields: int) -> list[list[str]]:
    return [x.split(" ", fields - 1) for x in text.strip().split("\n")]


def extensions() -> dict[str, str]:
    """Extension -> language; the first language that has it wins."""
    out: dict[str, str] = {}
    for line in fixed.EXTENSIONS.strip().split("\n"):
        lang, *own = line.split()
        for e in own:
            out.setdefault(e, lang)
    return out


def symbol_patterns(graph: bool = False) -> list[SymbolPattern]:
    left_out = set(words(fixed.NOT_IN_GRAPH)) if graph else set()
    other = {(lang, t): regex for lang, t, _, regex in _lines(fixed.GRAPH_SYMBOLS, 4)} if graph else {}
    return [
        SymbolPattern(lang, fixed.SAME_TYPE.get(t, t), int(g), other.get((lang, t), regex))
        for lang, t, g, regex in _lines(fixed.SYMBOLS, 4)
        if f"{lang}:{t}" not in left_out
    ]


def import_patterns(graph: bool = False) -> list[ImportPattern]:
    parsed = lambda text: [ImportPattern(lang, tuple(map(int, g.split(","))), regex) for lang, g, regex in _lines(text, 3)]
    own = parsed(fixed.GRAPH_IMPORTS) if graph else []
    return [p for p in parsed(fixed.IMPORTS) if p.lang not in {x.lang for x in own}] + own


def call_patterns() -> list[tuple[str, str]]:
    return [(lang, regex) for lang, regex in _lines(fixed.CALLS, 2)]


def inherit_patterns() -> list[tuple[str, str]]:
    return [(lang, regex) for lang, regex in _lines(fixed.INHERITS, 2)]


def ignored(graph: bool = False) -> tuple[list[str], list[str]]:
    """Names that are ignored as a part of a path, and suffixes that are ignored as the end of its last part."""
    out = [x for x in words(fixed.IGNORED) if not graph or x not in words(fixed.IGNORED_IN_INDEX_ONLY)]
    return out, [x[1:] for x in out if x.startswith("*.")]
