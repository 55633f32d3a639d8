"""Gitignore patterns compiled to regular expressions, applied as one column expression or on the driver."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def translate(line: str) -> tuple[str, bool] | None:
    """(regex over a relative POSIX path, negated) of one line, None for blanks and comments.

    A pattern with a slash before its end is anchored at the root, others match at any depth; a trailing slash asks for a directory,
    so only paths below it match.
    """
    line = line.rstrip("\n").rstrip("\r")
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    body = line[1:] if negated else line
    if body.startswith(("\\#", "\\!")):
        body = body[1:]
    only_dir = body.endswith("/")
    body = body.rstrip("/")
    if not body:
        return None
    anchored = "/" in body
    body = body.lstrip("/")
    out, i = "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + "/.*", i + 3
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in body[i + 2 :]:
            j = body.index("]", i + 2)
            group = body[i + 1 : j]
            out, i = out + "[" + ("^" + group[1:] if group[0] in "!^" else group).replace("\\", "\\\\") + "]", j + 1
        elif c == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    head = "^" if anchored else "^(?:.*/)?"
    return head + out + ("/.*$" if only_dir else "(?:/.*)?$"), negated


def compile_lines(lines: list[str]) -> list[tuple[str, bool]]:
    return [t for t in map(translate, lines) if t]


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether the last rule that matches is no exception."""
    return reduce(lambda acc, r: F.when(path.rlike(r[0]), F.lit(not r[1])).otherwise(acc), rules, F.lit(False))


def is_ignored(path: str, rules: list[tuple[str, bool]]) -> bool:
    hit = False
    for pattern, negated in rules:
        if re.search(pattern, path):
            hit = not negated
    return hit
