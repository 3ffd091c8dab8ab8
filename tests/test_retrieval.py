"""Ranking against naive versions, on random chunks with ties, imports, symbols and repeated content."""

import math
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.functions import keys as K
from tidemark.operators import admission, hybrid, lexical, metrics, reconcile, semantic
from tidemark.plans import ports, queries_retrieval

WORDS = ["alpha", "beta_1", "gamma$", "delta", "eps", "zeta", "ab", "Theta", "iota9", "kappa"]


def tokens(t):
    return set(re.findall(r"[a-z_$][\w$]{2,}", t.lower(), re.ASCII))


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    pick = lambda n: " ".join(rng.choice(WORDS, n))
    chunks = [(i, f"src/f{i % 6}.ts", WORDS[i % 10] if i % 3 else None, "sig" if i % 4 else None, [f"./f{i % 6}", "zzz"] if i % 5 else [], pick(rng.integers(0, 6))) for i in range(80)]
    queries = [(q, pick(rng.integers(0, 5)), f"src/f{q % 7}.ts") for q in range(12)]
    return chunks, queries


def fold(a, b):
    """A plain sum in order; sum() would compensate."""
    out = 0.0
    for x, y in zip(a, b, strict=True):
        out += x * y
    return out


def naive(chunks, query, changed, limit):
    want = tokens(query)
    rows = []
    for i, path, name, sig, imports, content in chunks:
        have = tokens(f"{path} {name or ''} {sig or ''} {' '.join(imports)} {content}")
        overlap = len(want & have)
        link = any(re.sub(r"^\./", "", x) in changed for x in imports)
        symbol, same = (name or "").lower() in want, path == changed
        score = min(1.0, (overlap / len(want) if want else 0.0) + (0.2 if link else 0.0) + (0.35 if symbol else 0.0) + (0.05 if same else 0.0))
        why = [f"keyword-overlap:{overlap}"] * bool(overlap) + ["import-link"] * link + ["symbol-match"] * symbol + ["same-file"] * same
        rows.append((-score, i, why))
    hit = sorted(r for r in rows if r[2])
    rest = sorted((r for r in rows if not r[2]), key=lambda r: r[1])
    return [(i, -s, why) for s, i, why in (hit + rest)[:limit]]


@pytest.fixture(scope="module")
def frames(spark, data):
    chunks = spark.createDataFrame(data[0], "ordinal long, path string, name string, signature string, imports array<string>, content string")
    queries = spark.createDataFrame(data[1], "query_id long, query string, changed_path string")
    return chunks.withColumn("content_hash", K.sha(F.col("content"))), queries


@pytest.mark.parametrize("limit", [1, 5, 79, 200])
def test_lexical(frames, data, limit):
    got = {}
    for r in lexical.rank_candidates(*frames, limit).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.ordinal, r.score, r.reasons))
    assert got == {q: naive(data[0], text, changed, limit) for q, text, changed in data[1]}


def test_hybrid(spark, frames, data):
    chunks, queries = frames
    e = ports.HashEmbedding()
    cv, qv = e.embed([c[5] for c in data[0]]), e.embed([q[1] for q in data[1]])
    vectors = spark.createDataFrame(list(enumerate(cv)), "ordinal long, values array<double>")
    query_vectors = spark.createDataFrame(list(enumerate(qv)), "query_id long, values array<double>")
    got = {}
    for r in hybrid.retrieve(chunks, queries, "hybrid", vectors, query_vectors, 10, 4, 0.05).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.ordinal, round(r.score, 12)))
    want = {}
    for q, text, changed in data[1]:
        lex = naive(data[0], text, changed, 10)
        sims = []
        for i, v in enumerate(cv):
            n, m = fold(qv[q], qv[q]), fold(v, v)
            sims.append((-max(0.0, fold(qv[q], v) / math.sqrt(n * m) if n and m else 0.0), i))
        sem = sorted(sims)[:10]
        union = {i: [s, 0.0] for i, s, _ in lex}
        for s, i in sem:
            union.setdefault(i, [0.0, 0.0])[1] = -s
        ranked = sorted(((-(a * 0.4 + b * 0.6), k, i) for k, (i, (a, b)) in enumerate(union.items())))
        seen, out = set(), []
        for s, _, i in ranked:
            if -s >= 0.05 and data[0][i][5] not in seen:
                seen.add(data[0][i][5])
                out.append((i, round(-s, 12)))
        if out:
            want[q] = out[:4]
    assert got == want


def test_hash_embedding_is_the_port(spark, data):
    df = spark.createDataFrame([(c[0], c[5]) for c in data[0]], "k long, t string")
    got = {r.k: r["values"] for r in semantic.hash_embed(df, "k", F.col("t")).collect()}
    want = ports.HashEmbedding().embed([c[5] for c in data[0]])
    assert all(np.allclose(got[i], w, atol=1e-12) for i, w in enumerate(want))


def test_running_limit_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(admission, "BLOCK", 7)
    kinds = ["a.ts", "b.md", "c.py", ".env", "d.json"]
    files = [(i, f"s{i}/{kinds[i % 5]}", None, None if i % 4 == 0 else "@@ -1 +1 @@\n+x") for i in range(60)]
    df = spark.createDataFrame(files, "ord long, filename string, previous_filename string, patch string")
    got = {r.ord: (r.decision, r.reason) for r in admission.admit(df, max_files=9).collect()}
    n, want = 0, {}
    for i, name, _, patch in files:
        if name.endswith(".env"):
            want[i] = ("skipped", "sensitive_path")
        elif name.endswith(".md"):
            want[i] = ("skipped", "unsupported_file_type")
        elif patch is None:
            want[i] = ("skipped", "missing_patch")
        elif n >= 9:
            want[i] = ("skipped", "work_limit")
        else:
            want[i], n = ("admitted", None), n + 1
    assert got == want
    b = reconcile.batches(spark.range(50).select(F.col("id").alias("ord")), 8)
    assert {r.ord: r.batch for r in b.collect()} == {i: i // 8 for i in range(50)}


def test_both_ways_to_candidates(spark, monkeypatch):
    """Scored where chunks are read, or joined with postings: the same ranks, scores and reasons; nulls and ties too."""
    chunks = [(i, f"src/m{i % 5}.ts", "Alpha" if i % 4 == 0 else None, ["./m1.ts", "../zz", "", "src/m2.ts"][: i % 5] if i % 3 else None, f"alpha beta{i % 7} gamma gamma_{i % 2}" if i % 6 else None) for i in range(60)]
    c = spark.createDataFrame(chunks, "ordinal long, path string, name string, imports array<string>, content string").repartition(3)
    q = spark.createDataFrame([(1, "alpha gamma", "src/m1.ts"), (2, "beta3 nothing", "lib/src/m2.ts"), (3, "", "src/m4.ts"), (4, "unknown", None), (5, None, "")], "query_id int, query string, changed_path string")
    show = lambda df: sorted(map(str, df.select("query_id", "rank", "ordinal", "score", "reasons").collect()))
    for fill in (True, False):
        here = show(lexical.rank_candidates(c, q, 8, fill))
        with monkeypatch.context() as m:
            m.setattr(lexical, "BROADCAST_ROWS", 0)
            assert lexical.best_hits(c, q, 8) is None
            assert show(lexical.rank_candidates(c, q, 8, fill)) == here
    got = {tuple(r) for r in lexical.import_links(c, q).collect()}
    needles = {x.removeprefix("./") for _, _, _, imports, _ in chunks for x in imports or ()}
    paths = {1: "src/m1.ts", 2: "lib/src/m2.ts", 3: "src/m4.ts", 5: ""}
    assert got == {(n, i) for n in needles for i, p in paths.items() if n in p}


def test_no_nested_loops(spark):
    """No plan of a retrieval compares all pairs; candidates are cut before they are shuffled."""
    from tidemark.plans import catalog

    for name in ("lexical_boosts", "hybrid_context", "context_packing"):
        text = catalog.QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in text and "Cartesian" not in text and "MapInArrow" in text, name
    chunks, q = queries_retrieval.rich_chunks(spark, f"{DATA}/sf0.001"), queries_retrieval.queries(spark, f"{DATA}/sf0.001")
    for df in (lexical.hits(chunks, q), lexical.import_links(chunks, q)):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in text and "Cartesian" not in text


def test_blocks_of_sparse_numbers(spark, monkeypatch):
    """Running counts over hashed, clustered and repeated numbers, in few blocks, against one sorted pass."""
    monkeypatch.setattr(admission, "BLOCK", 7)
    monkeypatch.setattr(admission, "BOUNDS", 4)
    rng = np.random.default_rng(2)
    for ords in (rng.permutation(200), np.unique(rng.integers(0, 1 << 40, 300)), np.concatenate((np.arange(150), (1 << 50) + np.arange(50)))):
        rows = [(int(o), int(rng.integers(0, 2))) for o in rng.permutation(ords)]
        d = spark.createDataFrame(rows, "ord long, __takes long")
        got = {r["ord"]: r["__before"] for r in admission._places_before(d).collect()}
        before = 0
        for o, t in sorted(rows):
            assert got[o] == before
            before += t
        blocks = d.groupBy(admission._block_of(d).alias("b")).count().collect()
        assert len(blocks) <= -(-len(rows) // 7) and max(r["count"] for r in blocks) <= 40


def test_upper_median(spark):
    rng = np.random.default_rng(5)
    rows = [("one", 4.0), ("two", 1.0), ("two", 2.0), ("none", None)] + [("many", float(x)) for x in rng.normal(size=5000)] + [("ties", float(x)) for x in rng.integers(0, 3, 4001)]
    got = {r.k: (r["median"], r["mean"]) for r in metrics.upper_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    for k in ("one", "two", "many", "ties"):
        v = sorted(x for a, x in rows if a == k)
        assert got[k] == (v[len(v) // 2], pytest.approx(sum(v) / len(v)))
    assert "none" not in got
