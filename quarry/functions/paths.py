"""Column expressions on paths: base names, languages, areas, globs, ignore rules."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import fixed
from quarry.functions.patterns import extensions, ignored


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """With its dot, '' if none; leading dots of the base name don't begin one."""
    return F.regexp_extract(base_name(path), r"(?s)^\.*[^.].*?(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    base = base_name(path)
    return F.substring(base, F.lit(1), F.length(base) - F.length(extension(path)))


def directory(path: Column) -> Column:
    """The directory part, '.' at the top."""
    d = F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)
    return F.when(d == "", ".").otherwise(d)


def area(path: Column) -> Column:
    """The first part of a path, ``root`` for files at the top."""
    return F.when(F.contains(path, F.lit("/")), F.split_part(path, F.lit("/"), F.lit(1))).otherwise("root")


def directory_at(d: Column, depth: int) -> Column:
    """The first ``depth`` parts of a directory; all of it for depth 0 or less."""
    return F.array_join(F.slice(F.split(d, "/", -1), 1, depth), "/") if depth > 0 else d


def language(path: Column, graph: bool = False) -> Column:
    """Language of a path, null if it isn't source; the graph doesn't take makefiles."""
    base, ext = base_name(path), F.lower(extension(path))
    table = F.create_map(*[F.lit(x) for pair in extensions().items() for x in pair])
    bare = F.when(base.endswith(".capnp"), "capnp")
    if not graph:
        bare = F.when(base.isin(*fixed.MAKEFILES), "makefile").otherwise(bare)
    return F.when(ext == "", bare).when(path.endswith(".capnp"), "capnp").otherwise(F.try_element_at(table, ext))


def is_ignored(path: Column, extra: Iterable[str] = (), graph: bool = False) -> Column:
    """A part of the relative path is an ignored name, or its base name ends in an ignored suffix. Other globs match only as names."""
    names, suffixes = ignored(graph)
    names, suffixes = [*names, *extra], [*suffixes, *(x[1:] for x in extra if x.startswith("*."))]
    out = F.arrays_overlap(F.split(path, "/", -1), F.array(*map(F.lit, names)))
    for s in suffixes:
        out = out | base_name(path).endswith(s)
    return out | path.contains(".capnp.h") | path.contains(".capnp.c++") if graph else out


def gitignore_patterns(lines: Iterable[str]) -> list[str]:
    """Patterns of a .gitignore: names and ``*.ext``; no negation, no anchors."""
    kept = (x.strip() for x in lines)
    return sorted({x.strip("/") for x in kept if x and not x.startswith("#")})


def glob_regex(glob: str) -> str:
    """A shell glob as a Java regex over the whole string; ``*`` and ``?`` also match slashes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2 + glob.startswith("!", i + 1)) if c == "[" else -1
        if c in "*?":
            out += ".*" if c == "*" else "."
        elif close > 0:
            inside = re.sub(r"([\\\[\]&~^])", r"\\\1", glob[i + 1 : close].removeprefix("!"))
            out += "[" + "^" * glob.startswith("!", i + 1) + inside + "]"
            i = close
        else:
            out += re.sub(r"([^\w])", r"\\\1", c)
        i += 1
    return rf"(?s)\A(?:{out})\z"


def glob_match(text: Column, glob: str) -> Column:
    return text.rlike(glob_regex(glob))


def size_label(size: Column) -> Column:
    """Bytes as whole KB, from 1024 KB on as MB with one digit."""
    kb = size / F.lit(1024.0)
    return F.when(kb < 1024, F.format_string("%.0fKB", F.bround(kb, 0))).otherwise(F.format_string("%.1fMB", F.bround(kb / 1024, 1)))
