"""Symbols and calls of a file in one pass, with the function that each call stands in.

The one place where lines depend on all lines before them; so it runs file by file in Python, fed in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame

from quarry.functions import fixed
from quarry.functions.patterns import call_patterns, symbol_patterns, words

SCHEMA = "path string, lang string, seq int, kind string, line int, type string, name string, caller string"


@cache
def _compiled(lang: str) -> tuple[list, list]:
    found = [(re.compile(p.regex), p.type, p.group) for p in symbol_patterns(graph=True) if p.lang == lang]
    return found, [re.compile(r) for name, r in call_patterns() if name == lang]


_CALLABLE, _SCOPED, _BRACED, _NO_CALLS = (frozenset(words(x)) for x in (fixed.CALLABLE, fixed.SCOPED, fixed.BRACED, fixed.NO_CALLS))


@dataclass
class _Scope:
    """The function that the current line stands in: by braces, or else by indentation."""

    braced: bool
    name: str | None = None
    indent: int = 0
    depth: int = 0
    fresh: bool = False

    def define(self, type_: str, name: str, indent: int) -> None:
        if type_ in _CALLABLE:
            self.name, self.indent, self.depth, self.fresh = name, indent, 0, True
        elif type_ in _SCOPED and not self.braced and indent <= self.indent:
            self.name = None

    def advance(self, text: str, indent: int) -> str | None:
        """Take in a line; the function that its calls belong to."""
        if self.braced:
            self.depth += text.count("{") - text.count("}")
            if self.depth < 0:
                self.name, self.depth = None, 0
            return self.name if self.depth > 0 else None
        ends = self.name and not self.fresh and indent <= self.indent and not text.startswith(fixed.CONTINUING_STARTS)
        self.name, self.fresh = None if ends else self.name, False
        return self.name


def scan(content: str, lang: str) -> list[tuple[str, int, str | None, str, str | None]]:
    """(kind, line, type, name, caller) in the order of the text: kind is symbol or call."""
    patterns, calls = _compiled(lang)
    scope, out = _Scope(lang in _BRACED), []
    for at, line in enumerate(content.split("\n"), 1):
        text = line.strip()
        if not text or text.startswith(fixed.SKIPPED_STARTS):
            continue
        indent = len(line) - len(line.lstrip())
        hits = ((t, m.group(g)) for p, t, g in patterns if (m := p.search(line)))
        if hit := next((h for h in hits if h[1]), None):
            out.append(("symbol", at, *hit, None))
            scope.define(*hit, indent)
        if caller := scope.advance(text, indent):
            for p in calls:
                out += [("call", at, None, n, caller) for n in (m.group(1) for m in p.finditer(text)) if len(n) > 1 and n not in _NO_CALLS]
    return out


def scan_files(files: DataFrame) -> DataFrame:
    """Symbols and calls of files (path, lang, content), seq numbering them within the file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, lang, i, *x) for p, lang, c in zip(b["path"], b["lang"], b["content"], strict=True) for i, x in enumerate(scan(c, lang))]
            yield pd.DataFrame(rows, columns=["path", "lang", "seq", "kind", "line", "type", "name", "caller"])

    return files.select("path", "lang", "content").mapInPandas(run, SCHEMA)
