"""Include and exclude globs, and ignore rules, as predicates."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a glob; ** crosses directories, and a pattern without it also fits one path part."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$" if "**" in pattern else f"(^|/){out}(/|$)"


def path_filter(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Paths that fit one of include, if there is any, and none of exclude."""

    def anyone(patterns: list[str]) -> Column:
        return reduce(lambda a, b: a | b, (path.rlike(glob_regex(p)) for p in patterns), F.lit(False))

    return (anyone(include) if include else F.lit(True)) & ~anyone(exclude)
