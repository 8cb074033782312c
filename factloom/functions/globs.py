"""Ignore-file patterns compiled to regular expressions, for rlike and for the walk."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """One pattern (without a leading !) as a regex over a whole relative path, its children included."""
    body = glob.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out, i = [], 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
        elif body[i:] == "**" and (i == 0 or body[i - 1] == "/"):
            out.append(".+")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and (end := body.find("]", i + 2)) > 0:
            inner = body[i + 1 : end]
            out.append("[" + ("^" + re.escape(inner[1:]).replace(r"\-", "-") if inner[0] in "!^" else re.escape(inner).replace(r"\-", "-")) + "]")
            i = end + 1
        elif c == "\\" and i + 1 < len(body):
            out.append(re.escape(body[i + 1]))
            i += 2
        else:
            out.append(re.escape(c))
            i += 1
    tail = "/.*" if glob.endswith("/") else "(?:/.*)?"
    return ("^" if anchored else "^(?:.*/)?") + "".join(out) + tail + "$"


def matches_any(path: Column, globs: list[str]) -> Column:
    """The last pattern that fits decides; ! takes a match back."""
    out = F.lit(False)
    for g in globs:
        negated, pattern = g.startswith("!"), g.removeprefix("!")
        out = F.when(path.rlike(glob_regex(pattern)), F.lit(not negated)).otherwise(out)
    return out


def ignored(path: str, is_dir: bool, rules: list[tuple[str, str]]) -> bool:
    """rules: (directory of the ignore file, pattern) in order; for the driver's walk."""
    out = False
    for base, rule in rules:
        if base and not path.startswith(base + "/"):
            continue
        inner = path[len(base) + 1 :] if base else path
        negated, pattern = rule.startswith("!"), rule.removeprefix("!")
        if pattern.endswith("/"):
            hit = re.match(glob_regex(pattern), inner + ("/" if is_dir else ""), re.S)
        else:
            hit = re.match(glob_regex(pattern), inner, re.S)
        if hit:
            out = not negated
    return out
