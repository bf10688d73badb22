"""Path arithmetic on '/'-separated relative paths, all JVM-side."""
from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """'' for a root-level path."""
    return F.left(path, F.length(path) - F.length(basename(path)) - 1)


def stem(name: Column) -> Column:
    """Name without its last suffix; leading dots do not start a suffix."""
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def suffix(name: Column) -> Column:
    """Lower-cased last suffix without the dot, '' if there is none."""
    return F.lower(F.regexp_extract(name, r"[^.]\.([^.]*)$", 1))


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def ancestors(path: Column) -> Column:
    """All proper directory prefixes, outermost first: a/b/c.py -> [a, a/b]."""
    parts = F.split(path, "/")
    return F.transform(
        F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1))
        .otherwise(F.array().cast("array<int>")),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def normalise(path: Column) -> Column:
    """Collapse '.', '..' and empty segments; '..' beyond the start is kept."""
    folded = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg.isin("", "."), acc)
        .when((seg == "..") & (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")) != ".."),
              F.slice(acc, F.lit(1), F.size(acc) - 1))
        .otherwise(F.concat(acc, F.array(seg))))
    return F.when(F.size(folded) == 0, F.lit(".")).otherwise(F.array_join(folded, "/"))


def glob_to_regex(pattern: str) -> str:
    """Shell glob as an anchored Java regex; '*' and '?' cross '/'."""
    out, i = [], 0
    while i < len(pattern):
        char = pattern[i]
        close = pattern.find("]", i + 2) if char == "[" else -1
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif close > 0:
            body = pattern[i + 1:close].replace("\\", r"\\").replace("[", r"\[").replace("&", r"\&")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body.replace("^", r"\^", 1)
                              if body[0] == "^" else body) + "]")
            i = close
        else:
            out.append(re.sub(r"([^\w/\- ])", r"\\\1", char))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def any_glob(path: Column, patterns: list[str]) -> Column:
    """True where the path or its basename matches one of the globs."""
    hit = F.lit(False)
    for pattern in patterns:
        regex = glob_to_regex(pattern)
        hit = hit | path.rlike(regex) | basename(path).rlike(regex)
    return hit
