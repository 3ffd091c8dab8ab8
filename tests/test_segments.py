"""Diff segments, source chunks and line budgets."""

import dataclasses
import random

import pytest

from tidemark.operators import segments as S

PATCH = "diff --git a/x b/x\n@@ -1,3 +1,4 @@ fn\n a\n-b\n+c\n+d\n e\n@@ -10 +11,2 @@\n+f\n\\ No newline"


def test_coordinates():
    got = [(x.kind, x.old, x.new) for x in S.parsed(PATCH)]
    assert got == [(None, None, None), (None, None, None), ("context", 1, 1), ("deletion", 2, None), ("addition", None, 2), ("addition", None, 3), ("context", 3, 4), (None, None, None), ("addition", None, 11), (None, None, None)]


def test_segment():
    s = S.segment(S.parsed(PATCH))
    assert s["ranges"] == [{"start": 2, "end": 3}, {"start": 11, "end": 11}]
    assert s["mappings"][0] == {"segmentLine": 3, "kind": "context", "oldLine": 1, "newLine": 1, "complete": True}
    assert len(s["id"]) == 16 and not s["truncated"]


def test_plan_covers_and_fits():
    rng = random.Random(1)
    for _ in range(60):
        text = "@@ -1 +1 @@\n" + "\n".join(rng.choice("+- ") + "é" * rng.randint(0, 40) for _ in range(rng.randint(1, 30)))
        cap = rng.randint(30, 200)
        segs, truncated = S.plan(text, 100, S.within(cap))
        assert all(len(s["text"].encode()) + 1 <= cap for s in segs)
        if not truncated and not any(s["truncated"] for s in segs):
            assert "\n".join(s["text"] for s in segs) == text
        # greedy: the first line of a segment did not fit the one before
        for a, b in zip(segs, segs[1:], strict=False):
            if not a["truncated"] and not b["truncated"]:
                assert len((a["text"] + "\n" + b["text"].split("\n")[0]).encode()) + 1 > cap


def test_long_line_is_not_citable():
    segs, truncated = S.plan("@@ -1 +1 @@\n+" + "x" * 300, 10, S.within(80))
    assert not truncated and any(s["truncated"] for s in segs) and all(not s["ranges"] for s in segs)
    assert "".join(s["text"][1:].removesuffix(S.NOT_CITABLE) for s in segs if S.NOT_CITABLE in s["text"]) == "x" * 300
    segs, truncated = S.plan("+" + "y" * 50, 3, S.within(1))
    assert segs == [] and truncated


def test_segment_limit():
    segs, truncated = S.plan("\n".join(["+" + "z" * 20] * 9), 2, S.within(50))
    assert len(segs) == 2 and truncated and all(s["truncated"] for s in segs)


def test_bounded():
    lines = ["aa", "", "b" * 30, "cc", "日本語"]
    got = S.bounded(lines, 1, 10)
    assert got == [("aa\n", 1, 2, True, None), ("b" * 10, 3, 3, False, None), ("b" * 10, 3, 3, False, None), ("b" * 10, 3, 3, False, None), ("cc", 4, 4, True, None), ("日本語", 5, 5, True, None)]
    assert S.bounded(["日"], 1, 2) == [("", 1, 1, False, "one character is larger than a chunk may be")]
    assert S.bounded([""], 1, 5) == [("", 1, 1, True, None)]


SOURCE = """import a from "./a";
import { b } from './lib/b';
// function fake() {}
const text = "class Fake {}";
export async function load(x) {
  if (x) { return `}`; }
}
export default class Store {
  get() { return { a: 1 }; }
}
interface Shape { a: string; }
type Id = string | number;
export const one = 1, two = () => {
  return 2;
};
enum Kind { A }
run();
"""


def test_chunks():
    got = S.chunk_text("src/x.ts", SOURCE, 10_000)
    names = [(c["name"], c["start_line"], c["end_line"]) for c in got if c["kind"] == "symbol"]
    assert names == [("text", 4, 4), ("load", 5, 7), ("Store", 8, 10), ("Shape", 11, 11), ("Id", 12, 12), ("one,two", 13, 15), ("Kind", 16, 16)]
    assert got[0]["imports"] == ["./a", "./lib/b"]
    assert "\n".join(c["content"] for c in got) == SOURCE
    assert {c["kind"] for c in S.chunk_text("a.py", SOURCE, 100)} == {"file"}


def test_chunks_respect_budget():
    for c in S.chunk_text("src/x.ts", SOURCE * 3, 40):
        assert len(c["content"].encode()) <= 40


def test_search_is_a_plain_scan(spark):
    """Ranks, ties and bits of a search are those of a naive loop."""
    import numpy as np

    from tidemark.operators import semantic

    rng = np.random.default_rng(3)
    v = rng.standard_normal((400, 12))
    v[5] = 0
    v[7] = v[300] = v[9]
    q = np.vstack((v[:6], rng.standard_normal((4, 12)), np.zeros((1, 12))))
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "ordinal long, values array<double>").repartition(5)
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, values array<double>")

    def fold(a, b):
        t = 0.0
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            t += x * y
        return t

    want = []
    for i, a in enumerate(q):
        n = fold(a, a)
        s = []
        for j, b in enumerate(v):
            m = fold(a, b)
            x = m / float(np.sqrt(n * fold(b, b))) if n and b.any() else 0.0
            s.append((-max(0.0, x), j))
        want += [(i, r, j, -x) for r, (x, j) in enumerate(sorted(s)[:20], 1)]
    got = semantic.search(vectors, queries, 20).select("query_id", "rank", "ordinal", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)


#: Scripts and the (name, first line, last line) of their top-level declarations.
SYMBOLS = [
    ("const r = /[{(]/;\nfunction a() { return 1; }\nclass B {}\n", [("r", 1, 1), ("a", 2, 2), ("B", 3, 3)]),
    ("const q = /\"'`\\//g, z = a / b / c;\nfunction f() {}\n", [("q,z", 1, 1), ("f", 2, 2)]),
    ("function f() {\n  return /}/.test(x) ? `a${`b${ {k: '}'} }`}}` : 1;\n}\nenum E { A }\n", [("f", 1, 3), ("E", 4, 4)]),
    ("// function no() {\n/* class No { */\nexport default class Yes {\n  m() { return a[0] / 2; } // }\n}\n", [("Yes", 3, 5)]),
    ("export const a = () => {\n  const s = '{';\n};\nexport async function* g() {}\nexport type T = { a: string };\n", [("a", 1, 3), ("g", 4, 4), ("T", 5, 5)]),
    ("interface I {\n  a: RegExp;\n}\ndeclare abstract class D {}\nlet x = 1 / 2, y = `${x}`;\n", [("I", 1, 3), ("D", 4, 4), ("x,y", 5, 5)]),
    ("const open = `never closed ${ {\nfunction lost() {}\n", [("open", 1, 2)]),
]


@pytest.mark.parametrize(("source", "want"), SYMBOLS)
def test_declarations(source, want):
    assert [(n, a + 1, b) for n, a, b in S.declarations(source)] == want
    assert len(S.masked(source)) == len(source) and S.masked(source).count("\n") == source.count("\n")


def test_imports():
    source = "import a from './a';\n// import x from 'no'\nimport { b,\n c } from \"b\";\nexport * from 'c';\nconst t = `\nimport y from 'no'\n`;\nimport d = require('d');\nimport 'e';\n"
    assert S.imports_of(source, S.masked(source)) == ["./a", "b", "c", "require('d')", "e"]


def _naive_plan(patch, limit, cap):
    """Segments by trying one line, and one character, more at a time."""
    fits = lambda lines: len("\n".join(x.text for x in lines).encode()) + 1 <= cap
    todo, groups, cut = S.parsed(patch), [], False
    while todo:
        if len(groups) == limit:
            cut = True
            break
        n = 0
        while n < len(todo) and fits(todo[: n + 1]):
            n += 1
        if n:
            groups.append(todo[:n])
            todo = todo[n:]
            continue
        line = todo.pop(0)
        sign, body = (line.text[:1], line.text[1:]) if line.kind else ("", line.text)
        piece = lambda text, tail: dataclasses.replace(line, text=sign + text + tail, complete=False)  # noqa: B023, E731
        tail = S.NOT_CITABLE if fits([piece(body[:1], S.NOT_CITABLE)]) else ""
        pieces = []
        while body and len(pieces) < limit - len(groups):
            k = 0
            while k < len(body) and fits([piece(body[: k + 1], tail)]):
                k += 1
            if not k:
                break
            pieces.append(piece(body[:k], tail))
            body = body[k:]
        cut |= not pieces or bool(body)
        todo = pieces + todo
    return [S.segment(g, cut) for g in groups], cut


def test_plan_by_brute_force():
    rng = random.Random(12)
    for _ in range(300):
        body = [rng.choice("+- ") + "é日x"[rng.randrange(3)] * rng.choice([0, 1, 5, 20, 90]) for _ in range(rng.randrange(1, 9))]
        patch = "\n".join(["@@ -1,9 +1,9 @@", *body, *rng.choice([[], ["\\ No newline at end of file"]])])
        limit, cap = rng.randrange(1, 6), rng.choice([1, 3, 30, 60, 200])
        assert S.plan(patch, limit, S.within(cap)) == _naive_plan(patch, limit, cap)
