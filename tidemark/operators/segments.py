"""Greedy cutting of texts under a byte budget: diff segments and source chunks.

Where a piece begins depends on where the last one ended, so a file is cut by a Python function over
whole Arrow batches; files are independent and never meet in one task but for their batch."""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import keys as K

_HEADER = re.compile(r"@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@")
_SIGNS = {"+": ("addition", 0, 1), "-": ("deletion", 1, 0), " ": ("context", 1, 1)}
NOT_CITABLE = " [cut line: not to be cited]"


@dataclass(frozen=True)
class Line:
    text: str
    kind: str | None = None
    old: int | None = None
    new: int | None = None
    complete: bool = True


def parsed(patch: str) -> list[Line]:
    out: list[Line] = []
    at: tuple[int, int] | None = None
    for text in patch.split("\n"):
        if m := _HEADER.match(text):
            at = int(m[1]), int(m[2])
            out.append(Line(text))
        elif at and (step := _SIGNS.get(text[:1])):
            kind, o, n = step
            out.append(Line(text, kind, at[0] if o else None, at[1] if n else None))
            at = at[0] + o, at[1] + n
        else:
            out.append(Line(text))
    return out


def spans(numbers: list[int]) -> list[dict]:
    out: list[dict] = []
    for x in sorted(set(numbers)):
        if out and x == out[-1]["end"] + 1:
            out[-1]["end"] = x
        else:
            out.append({"start": x, "end": x})
    return out


def segment(group: list[Line], truncated: bool = False) -> dict:
    """A segment's text, line map, citable ranges and content-derived id."""
    text = "\n".join(x.text for x in group)
    maps = [{"segmentLine": i, "kind": x.kind} | ({} if x.old is None else {"oldLine": x.old}) | ({} if x.new is None else {"newLine": x.new}) | {"complete": x.complete} for i, x in enumerate(group, 1) if x.kind]
    shown = json.dumps(maps, separators=(",", ":"))
    cited = spans([x.new for x in group if x.kind == "addition" and x.complete and x.new])
    return {"id": hashlib.sha256((text + shown).encode()).hexdigest()[:16], "text": text, "mappings": maps, "ranges": cited, "truncated": truncated or not all(x.complete for x in group)}


Fits = Callable[[dict], bool]


def most(limit: int, ok: Callable[[int], bool]) -> int:
    """The largest n in 0..limit with ok(n), for an ok that only ever turns false: doubling, then halving."""
    good, step = 0, 1
    while good < limit and ok(min(good + step, limit)):
        good = min(good + step, limit)
        step *= 2
    bad = min(good + step, limit + 1)
    while bad - good > 1:
        mid = (good + bad) // 2
        good, bad = (mid, bad) if ok(mid) else (good, mid)
    return good


def fragments(line: Line, limit: int, fits: Fits) -> tuple[list[Line], bool]:
    """Pieces of a line that does not fit alone, each fitting and none citable; whether content was left over."""
    sign, body = (line.text[:1], line.text[1:]) if line.kind else ("", line.text)
    make = lambda a, n, tail: replace(line, text=sign + body[a : a + n] + tail, complete=False)
    alone = lambda x: fits(segment([x]))
    tail = NOT_CITABLE if alone(make(0, 1, NOT_CITABLE)) else ""
    out: list[Line] = []
    at = 0
    while at < len(body) and len(out) < limit:
        n = most(len(body) - at, lambda k, a=at: alone(make(a, k, tail)))
        if not n:
            break
        out.append(make(at, n, tail))
        at += n
    return out, bool(out) and at < len(body)


def plan(patch: str, limit: int, fits: Fits) -> tuple[list[dict], bool]:
    """At most `limit` segments that fit, whole lines first, and whether anything is not shown as a citable line."""
    todo = parsed(patch)
    groups: list[list[Line]] = []
    truncated, at = False, 0
    while at < len(todo):
        if len(groups) == limit:
            truncated = True
            break
        n = most(len(todo) - at, lambda k, a=at: fits(segment(todo[a : a + k])))
        if n:
            groups.append(todo[at : at + n])
            at += n
        else:
            pieces, left = fragments(todo[at], limit - len(groups), fits)
            truncated |= left or not pieces
            todo[at : at + 1] = pieces
    return [segment(g, truncated) for g in groups], truncated


def within(max_tokens: int) -> Fits:
    """The cap on a segment's own text."""
    return lambda s: len(s["text"].encode()) + 1 <= max(1, max_tokens)


SEGMENTS = "filename string, seg_no int, id string, text string, line_ranges array<struct<start:long,end:long>>, line_mappings array<struct<segment_line:int,kind:string,old_line:long,new_line:long,complete:boolean>>, truncated boolean, plan_truncated boolean"


def plan_segments(files: DataFrame, max_tokens: int, max_segments: int, fits_for: Callable[[dict], Fits] | None = None) -> DataFrame:
    """SEGMENTS of files(filename, patch[, more]). fits_for: from a file's row, a further condition on a segment."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cap = within(max_tokens)
        for p in it:
            out = []
            for row in p.to_dict("records"):
                more = fits_for(row) if fits_for else None
                fits = (lambda s, more=more: cap(s) and more(s)) if more else cap
                segs, truncated = plan(row["patch"] or "", max_segments, fits) if row["patch"] else ([], False)
                for k, s in enumerate(segs):
                    maps = [{"segment_line": m["segmentLine"], "kind": m["kind"], "old_line": m.get("oldLine"), "new_line": m.get("newLine"), "complete": m["complete"]} for m in s["mappings"]]
                    out.append((row["filename"], k, s["id"], s["text"], s["ranges"], maps, s["truncated"], truncated))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ("filename", "seg_no", "id", "text", "line_ranges", "line_mappings", "truncated", "plan_truncated")])

    return files.mapInPandas(run, SEGMENTS)


def take_bytes(text: str, most_bytes: int) -> str:
    """The longest prefix of whole characters within so many bytes."""
    return text.encode()[: max(0, most_bytes)].decode(errors="ignore")


def bounded(lines: list[str], first: int, max_tokens: int) -> list[tuple[str, int, int, bool, str | None]]:
    """(content, start line, end line, complete, omission) of lines packed greedily; a line over the budget alone is
    cut into incomplete pieces."""
    out: list[tuple[str, int, int, bool, str | None]] = []
    held: list[str] = []
    size = 0
    for no, line in enumerate(lines, first):
        n = len(line.encode())
        if held and size + 1 + n > max_tokens:
            out.append(("\n".join(held), no - len(held), no - 1, True, None))
            held, size = [], 0
        if n <= max_tokens:
            size += n + (1 if held else 0)
            held.append(line)
            continue
        while line:
            part = take_bytes(line, max_tokens)
            if not part:
                out.append(("", no, no, False, "one character is larger than a chunk may be"))
                break
            out.append((part, no, no, False, None))
            line = line[len(part) :]
    if held:
        end = first + len(lines) - 1
        out.append(("\n".join(held), end - len(held) + 1, end, True, None))
    return out


_DECLARES = re.compile(r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:(function)\s*\*?\s*([A-Za-z_$][\w$]*)|(?:class|interface|enum|const\s+enum)\s+([A-Za-z_$][\w$]*)|type\s+([A-Za-z_$][\w$]*)\s*[=<]|(?:const|let|var)\s+(?!enum\b)([A-Za-z_$][\w$]*))")
_IMPORTS = re.compile(r"""^\s*(?:import\s+(?:[^'";]*?\bfrom\s*)?|export\s+[^'";]*?\bfrom\s*)["']([^"']+)["']|^\s*import\s+[\w$]+\s*=\s*(require\(\s*["'][^"']+["']\s*\)|[\w$.]+)""", re.M)
_TOKEN = re.compile(r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<word>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<sign>.)""", re.S)
_PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S)
#: Words after which a slash begins a pattern, not a division.
_BEFORE_PATTERN = frozenset("return typeof case in of delete void throw new else do instanceof await yield".split())


def masked(source: str) -> str:
    """Source with comments, strings, patterns (regular expressions) and templates, with what is nested in them,
    blanked; line ends are kept. One pass over the tokens."""
    blank: list[tuple[int, int]] = []
    inner: list[int] = []  # for each open template, the braces open in its current ${ }
    at, value, outer = 0, False, 0  # value: a slash here would divide

    def template(i: int) -> int:
        """The end of the template's text from i: behind ${, which opens code, or behind its closing quote."""
        nonlocal value
        i = _TEMPLATE.match(source, i).end()
        if source.startswith("${", i):
            inner.append(0)
            value = False
            return i + 2
        if not inner:
            blank.append((outer, i + 1))
        value = True
        return i + 1

    while at < len(source):
        m = _TOKEN.match(source, at)
        kind, text, end = m.lastgroup, m[0], m.end()
        if kind == "sign" and text == "/" and not value and (p := _PATTERN.match(source, at)):
            kind, end = "string", p.end()
        if kind == "sign" and text == "`":
            outer = at if not inner else outer
            at = template(end)
            continue
        if kind == "sign" and text == "}" and inner and inner[-1] == 0:
            inner.pop()
            at = template(end)
            continue
        if kind in ("comment", "string") and not inner:
            blank.append((at, end))
        if kind == "sign" and inner and text in "{}":
            inner[-1] += 1 if text == "{" else -1
        if kind not in ("space", "comment"):
            value = kind in ("string", "number") or (kind == "word" and text not in _BEFORE_PATTERN) or text in ")]}"
        at = end
    if inner:
        blank.append((outer, len(source)))
    out, done = [], 0
    for a, b in blank:
        out += [source[done:a], re.sub(r"[^\n]", " ", source[a:b])]
        done = b
    return "".join([*out, source[done:]])


def imports_of(source: str, text: str) -> list[str]:
    """Module names of a script's import and export statements; text: the source masked, where no comment has any."""
    return [m[1] or m[2] for m in _IMPORTS.finditer(source) if not text[m.start() + len(m[0]) - len(m[0].lstrip())].isspace()]


def declarations(source: str) -> list[tuple[str, int, int]]:
    """(name, first line, line after the last) of top-level declarations, lines from 0: a scanner of brackets, not a
    parser. A declaration ends with the bracket that closes it, or a semicolon or line end outside brackets."""
    text = masked(source)
    out, depth, at, n = [], 0, 0, len(text)
    fresh = True
    ends = [m.start() for m in re.finditer("\n", text)]
    line_of = lambda i: bisect_left(ends, i)
    while at < n:
        c = text[at]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth = max(0, depth - 1)
            if not depth and c == "}":
                fresh = True
                at += 1
                continue
        if not depth and not c.isspace() and fresh and (m := _DECLARES.match(text, at)):
            name = next(x for x in (m[2], m[3], m[4], m[5]) if x)
            end, d, value = m.end(), 0, m[4] or m[5]
            while end < n:
                x = text[end]
                d += x in "([{"
                d -= x in ")]}"
                if d < 0 or (not d and (x == ";" or (x == "}" and not value) or (x == "\n" and value and not re.match(r"\s*(?:[=+\-*/?:|&.,<>]|$)", text[end + 1 : end + 40]) and not re.search(r"[=+\-*/?:|&,(<]\s*$", text[m.start() : end])))):
                    break
                end += 1
            names = [name]
            if m[5]:
                names += re.findall(r",\s*([A-Za-z_$][\w$]*)\s*(?::[^,=]+)?=", _flat(text[m.end() : end]))
            last = min(end, n - 1)
            stop = line_of(last) + (0 if text[last] == "\n" and end < n else 1)
            out.append((",".join(names), line_of(at), max(stop, line_of(at) + 1)))
            at, fresh = end + 1, True
            continue
        if not c.isspace():
            fresh = not depth and c in ";}"
        elif c == "\n" and not depth:
            fresh = True
        at += 1
    return out


def _flat(text: str) -> str:
    """text without what stands in brackets."""
    out, d = [], 0
    for c in text:
        d -= c in ")]}"
        if not d:
            out.append(c)
        d += c in "([{"
    return "".join(out)


def chunk_text(path: str, content: str, max_tokens: int) -> list[dict]:
    """Chunks of one file: top-level declarations of script files as symbols, what lies between as parts of the file."""
    text = content.replace("\r\n", "\n")
    lines = text.split("\n")
    ext = path.rsplit("/", 1)[-1].rpartition(".")[2].lower() if "." in path.rsplit("/", 1)[-1][1:] else ""
    lang = "typescript" if ext in ("ts", "tsx") else "javascript" if ext in ("js", "jsx", "mjs", "cjs") else "fallback"
    imports = imports_of(text, masked(text)) if lang != "fallback" else []
    out: list[dict] = []

    def add(a: int, b: int, kind: str, name: str | None = None) -> None:
        if b > a:
            sig = re.sub(r"\s+", " ", "\n".join(lines[a:b]).strip())[:300] if name else None
            for body, start, end, complete, why in bounded(lines[a:b], a + 1, max_tokens):
                out.append({"path": path, "language": lang, "kind": kind, "name": name, "signature": sig, "imports": imports, "start_line": start, "end_line": end, "content": body, "content_complete": complete, "omission_reason": why})

    done = 0
    for name, a, b in declarations(text) if lang != "fallback" else []:
        add(done, a, "file")
        add(a, b, "symbol", name)
        done = max(done, b)
    add(done, len(lines), "file")
    return out


CHUNKS = "path string, language string, kind string, name string, signature string, imports array<string>, start_line long, end_line long, content string, content_complete boolean, omission_reason string"


def chunk_sources(files: DataFrame, repository_id: str, revision: str, max_tokens: int) -> DataFrame:
    """Chunks, with ids and hashes, of files(path, content)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in CHUNKS.split(", ")]
        for p in it:
            yield pd.DataFrame([c for path, content in zip(p["path"], p["content"], strict=True) for c in chunk_text(path, content or "", max_tokens)], columns=cols)

    return identified(files.select("path", "content").mapInPandas(run, CHUNKS), repository_id, revision)


def identified(chunks: DataFrame, repository_id: str, revision: str) -> DataFrame:
    """chunks with repository_id, revision, content_hash and id: also rebinds them to another identity."""
    d = chunks.drop("repository_id", "revision", "content_hash", "id").withColumns({"repository_id": F.lit(repository_id), "revision": F.lit(revision), "content_hash": K.sha(F.col("content"))})
    return d.withColumn("id", K.chunk_id(F.col("repository_id"), F.col("revision"), F.col("path"), F.col("start_line"), F.col("end_line"), F.col("content_hash")))
