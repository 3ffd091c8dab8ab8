"""Ignore rules in the usual syntax: the last rule that matches decides, and nothing below an ignored folder comes back.

Rules become regular expressions on the driver; `ignored` is then one column expression: a path is ignored if it, or a
folder above it, is matched last by a plain rule. Rules are few, so no table of them meets the paths."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import text as T


@dataclass(frozen=True)
class Rule:
    pattern: str
    negated: bool = False


def parse(text: str) -> list[Rule]:
    out = []
    for line in re.split(r"\r?\n", text):
        line = line.strip()
        if line and not line.startswith("#"):
            rule = Rule(line[1:], True) if line.startswith("!") else Rule(line)
            if rule.pattern:
                out.append(rule)
    return out


def to_regex(pattern: str) -> tuple[str, bool]:
    """(regular expression of a path without trailing slash, whether only folders fit)."""
    only_folders = pattern.endswith("/")
    p = pattern.rstrip("/")
    anchored = "/" in p
    p = p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i) and (i == 0 or p[i - 1] == "/"):
            out += "(?:[^/]+/)*"
            i += 3
        elif p.startswith("**", i) and i + 2 == len(p) and i and p[i - 1] == "/":
            out += ".+"
            i += 2
        elif p[i] == "*":
            out += "[^/]*"
            i += 1
        elif p[i] == "?":
            out += "[^/]"
            i += 1
        elif p[i] == "[" and (end := p.find("]", i + 2)) > 0:
            body = p[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end + 1
        elif p[i] == "\\" and i + 1 < len(p):
            out += re.escape(p[i + 1])
            i += 2
        else:
            out += re.escape(p[i])
            i += 1
    return ("^" if anchored else "^(?:.*/)?") + out + "$", only_folders


def ignored(path: Column, rules: list[Rule]) -> Column:
    """Whether a file's path is ignored."""
    if not rules:
        return F.lit(False)
    p = F.regexp_replace(T.slashes(path), "^/+", "")
    compiled = [(*to_regex(r.pattern), r.negated) for r in rules]

    def last_says(x: Column, folder: bool) -> Column:
        # the last rule that fits comes first in the chain
        use = [(e, n) for e, only, n in reversed(compiled) if folder or not only]
        return reduce(lambda rest, en: F.when(F.rlike(x, F.lit(en[0])), not en[1]).otherwise(rest), reversed(use), F.lit(False))

    parts = F.split(p, "/")
    folders = F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i > 0), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.exists(folders, lambda x: last_says(x, True)) | last_says(p, False)


def is_ignored(path: str, rules: list[Rule]) -> bool:
    """The same for one path on the driver."""
    p = path.replace("\\", "/").lstrip("/")
    compiled = [(*to_regex(r.pattern), r.negated) for r in rules]

    def says(x: str, folder: bool) -> bool:
        for e, only, n in reversed(compiled):
            if (folder or not only) and re.match(e, x):
                return not n
        return False

    parts = p.split("/")
    return any(says("/".join(parts[:i]), True) for i in range(1, len(parts))) or says(p, False)
