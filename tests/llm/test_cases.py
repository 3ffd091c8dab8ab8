"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import gzip
import hashlib
import io
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import common as C
from tidemark.llm import embdedup, linededup, lm, packing, quality, rules, simhash, spsample, urlrep, warc

LONG = " ".join(f"word{i % 997} the of {i}" for i in range(60_000))
GOOD = " ".join(f"the {w}{i} of {w}ly{i} and {i}th to in" for i, w in enumerate("alpha beta gamma delta epsilon zeta eta theta".split() * 2))
ODD = "did long, row_hash string, pos int, kept string, score string, n_lines string, host int, fp string, ids string, length string, rank string, salt string, n_words string, node string, component string, label string, mean string, count string"
TEXTS = [(0, GOOD), (1, GOOD), (1, GOOD), (2, None), (3, ""), (4, " \n\t\n "), (None, GOOD + " x"), (None, None), (5, LONG), (6, "a line that repeats\nA LINE THAT REPEATS \nshort"), (7, "a line that repeats\nother"), (7, "another text of seven"), (8, "x" * 3000), (9, "été ▁ <|endoftext|> don't \r\n ２ 日本 😀")]


@pytest.fixture(scope="module")
def docs(spark):
    extra = tuple(None for _ in ODD.split(","))
    return spark.createDataFrame([(i, t, "en", "s", None, *extra) for i, t in TEXTS], f"doc_id long, text string, lang string, source string, n_chars long, {ODD}")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(10)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def sf_dir(docs, labels, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_components(spark, tmp_path):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2100)]
    got = dict(map(tuple, C.connected_components(spark.createDataFrame(pairs, "src long, dst long"), f"file://{tmp_path}/c").collect()))
    up = {}
    for a, b in pairs:
        up.setdefault(a, a)
        up.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(up[a], up[b])
            changed |= up[a] != m or up[b] != m
            up[a] = up[b] = m
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {k: v for k, v in up.items() if k in linked}
    none = spark.createDataFrame([], "src long, dst long")
    assert C.connected_components(none, f"file://{tmp_path}/n").count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((60, 20))
    rows = [(i, [float(x) for x in base[i % 12] + 0.08 * rng.standard_normal(20) * (i >= 12)], i % 2) for i in range(60)]
    rows += [(60, rows[0][1], 0), (61, rows[0][1], 0), (62, rows[0][1], None), (63, None, 0), (64, [0.0] * 20, 0), (65, [float("nan")] * 20, 0), (66, [None, 1.0], 0), (67, [1.0, 2.0], 0), (68, [2.0, 4.0], 0), (None, rows[0][1], 0), (69, [], 0), (70, [float("inf"), 1.0], 0), (71, [3.0], 0), (72, [5.0], 0)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, rep int, component int")
    got = {r.vec_id: tuple(r)[1:] for r in embdedup.near_duplicates(df).collect()}
    ok = {i: (np.array(v), lab) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = {i: set() for i, _, _ in rows}
    for a, b in itertools.combinations(ok, 2):
        (x, p), (y, q) = ok[a], ok[b]
        if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
            links[a].add(b)
            links[b].add(a)
    comp = {}
    for i in sorted(i for i in links if i is not None):
        todo, seen = [i], {i}
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        comp[i] = min(seen)
    for i in links:
        assert got[i] == ((len(links[i]), comp[i], comp[i] == i) if i is not None else (0, None, False)), i
    for rows, grid in ((2, 0), (3, 1), (3, None), (1, 4)):  # small tiles, and grids over more coordinates
        assert {r.vec_id: tuple(r)[1:] for r in embdedup.near_duplicates(df, tile_rows=rows, grid=grid).collect()} == got, grid
    assert embdedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize(("grid", "cosine"), [(1, 0.93), (2, 0.93), (5, 0.9), (8, 0.97)])
def test_cells_bring_neighbours_together(grid, cosine):
    """Vectors within a block's budget meet once: at home in one cell, or one as the other's guest."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 16))
    x[150:] = x[:150] + 0.2 * rng.standard_normal((150, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    homes, guests = {}, {}
    for block, rows, cells, guest in embdedup._cells(x, cosine, grid):
        for r, c in zip(rows.tolist(), cells.tolist(), strict=True):
            (guests if guest else homes).setdefault((block, r), []).append(c)
    bounds, most = embdedup.blocks_of(16), embdedup.budgets(16, cosine)
    for block in range(2):
        near = ((x[:, None, bounds[block] : bounds[block + 1]] - x[None, :, bounds[block] : bounds[block + 1]]) ** 2).sum(axis=2) <= most[block]
        for a, b in zip(*np.nonzero(near), strict=True):
            if a < b:
                (h,), (k,) = homes[block, a], homes[block, b]
                assert (h == k) + (h in guests.get((block, b), [])) + (k in guests.get((block, a), [])) == 1
    assert 1 <= embdedup.finest_grid(16, cosine) <= 8


def test_best_grid():
    """The more vectors share a label the finer the grid; it follows the vectors' spread, and tiny labels have none."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = [embdedup.best_grid(x, [(10.0**k, 1)], 0.93) for k in range(2, 10)]
    assert got[:3] == [0, 0, 0] and got == sorted(got) and got[-1] > 2
    assert embdedup.best_grid(x[:0], [], 0.93) == 0
    assert embdedup.best_grid(x, [(100.0, 10**6)], 0.93) == 0


def test_warc(spark):
    rows = [(1, "http://a/x y\n", "<p>é</p>"), (2, None, None), (3, "http://b", ""), (3, "http://b", ""), (5, "http://c", "<p>é</p>"), (None, "http://d", "<p>é</p>"), (None, None, "alone"), (7, "u", "z" * 2_000_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, sha1 int")
    archives = warc.write_archives(df, C.workspace(spark, "t"))
    for r in archives.collect():  # the file is one gzip member per record, and nothing around them
        data = open(r.archive.removeprefix("file://"), "rb").read()
        assert len(data) == r.bytes
        for _ in range(r.records):
            z = zlib.decompressobj(31)
            assert z.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: re")
            data = z.unused_data
        assert not data
    got = warc.read_archives(archives).collect()
    key = lambda r: (r.page_id is None, r.page_id, r.payload_bytes)
    out = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in sorted(got, key=key)]
    assert out[:6] == [(1, 9, "response", None), (2, 0, "response", None), (3, 0, "revisit", 2), (3, 0, "revisit", 2), (5, 9, "revisit", 1), (7, 2_000_000, "response", None)]
    assert {(r.payload_bytes, r.record_type, r.refers_to) for r in got if r.page_id is None} == {(9, "revisit", 1), (5, "response", None)}
    for r in got:
        if r.payload is not None:
            assert warc.digest(bytes(r.payload)) == r.payload_digest
    assert all(r.record_type == "response" for r in warc.read_archives(warc.write_archives(df, C.workspace(spark, "t"), 10)).collect() if r.payload_bytes < 10)
    assert warc.read_archives(warc.write_archives(df.limit(0), C.workspace(spark, "t"))).count() == 0


def test_warc_broken():
    good = warc.record(1, "u", b"payload", warc.digest(b"payload"), None, None, False)
    assert [x[1:5] for x in warc.read_records(io.BytesIO(good * 3))] == [("urn:page:1", 1, "u", "response")] * 3
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(good[:-9])))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(warc.record(1, "u", b"payload", warc.digest(b"other"), None, None, False))))


def _member(fields, block, version="1.0"):
    head = f"WARC/{version}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n")


def test_warc_of_others(spark, tmp_path):
    """Records as crawlers write them: all types, foreign ids, other and missing digests, HTTP without a length."""
    body = b"<p>hi</p>" * 20_000
    page = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + body
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nabcd\r\n3;x=y\r\nefg\r\n0\r\n\r\n"
    http = {"Content-Type": "application/http; msgtype=response"}
    uuid = "<urn:uuid:92283950-ef2f-4d72-b224-f54c6ec90bb0>"
    records = [
        _member({"WARC-Type": "warcinfo", "WARC-Record-ID": uuid, "Content-Type": "application/warc-fields"}, b"software: x\r\n"),
        _member({"warc-type": "response", "WARC-Record-ID": uuid, "WARC-Target-URI": "<http://a/>", "WARC-Payload-Digest": f"sha1:{warc.digest(body)}", "WARC-Block-Digest": f"sha256:{hashlib.sha256(page).hexdigest()}", **http}, page, "1.1"),
        _member({"WARC-Type": "request", "WARC-Record-ID": uuid, "Content-Type": "application/http; msgtype=request"}, b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        _member({"WARC-Type": "response", "WARC-Record-ID": uuid, "WARC-Payload-Digest": f"md5:{hashlib.md5(b'abcdefg').hexdigest()}", **http}, chunked),
        _member({"WARC-Type": "metadata", "WARC-Record-ID": uuid, "WARC-Block-Digest": "blake9:whatever", "X-Long": "a\r\n b"}, b"k: v\r\n"),
        _member({"WARC-Type": "resource", "WARC-Record-ID": uuid, "WARC-Target-URI": "dns:a"}, b""),
        _member({"WARC-Type": "revisit", "WARC-Record-ID": uuid, "WARC-Refers-To": uuid, "WARC-Payload-Digest": f"sha1:{warc.digest(body)}", **http}, b"HTTP/1.1 304 Not Modified\r\n\r\n"),
        _member({"WARC-Type": "novel"}, b"?"),
    ]
    got = list(warc.read_records(io.BytesIO(b"".join(records))))
    assert [x[4] for x in got] == ["warcinfo", "response", "request", "response", "metadata", "resource", "revisit", "novel"]
    assert [x[5] for x in got] == [b"software: x\r\n", body, b"", b"abcdefg", b"k: v\r\n", b"", None, b"?"]
    assert [x[2] for x in got] == [None] * 8 and got[1][1] == uuid[1:-1] and got[1][3] == "http://a/" and got[6][9] == uuid[1:-1]
    assert [x[0] for x in got] == [0, *itertools.accumulate(map(len, records[:-1]))]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(records))
    rows = warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz",)], "archive string")).collect()
    assert [(r.record_type, r.payload_bytes) for r in sorted(rows, key=lambda r: r.byte_offset)] == [(x[4], x[6]) for x in got]
    for broken in (
        _member({"WARC-Type": "response", "WARC-Payload-Digest": f"md5:{hashlib.md5(b'no').hexdigest()}", **http}, page),
        _member({"WARC-Type": "resource", "WARC-Block-Digest": f"sha1:{warc.digest(b'no')}"}, b"yes"),
        _member({"WARC-Record-ID": uuid}, b"no type"),
        gzip.compress(b"HTTP/1.1 200 OK\r\n\r\n"),
        gzip.compress(b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 2\r\n\r\nabc\r\n\r\n"),
        b"plain text",
    ):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(records[0] + broken)))


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (5, 2), (9, 3)])
def test_lines(docs, batches, fanout):
    got = sorted((r.doc_id, r.n_dropped, r.kept_text) for r in linededup.dedup_lines(docs, n_batches=batches, fanout=fanout).collect() if r.doc_id in (0, 1, 2, 6, 7))
    assert [x for x in got if x[0] in (0, 2)] == [(0, 0, GOOD), (2, 0, "")]
    assert [x for x in got if x[0] == 1] == [(1, 1, "")] * 2
    assert [x for x in got if x[0] == 6] == [(6, 0, TEXTS[9][1])]
    assert [x for x in got if x[0] == 7] == [(7, 0, "another text of seven"), (7, 1, "other")]
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_runs_are_read_as_they_lie(spark, docs, monkeypatch):
    """A batch is exchanged and sorted once; no run is, however many there are. A run is one sorted file per bucket."""
    plans, orig = [], C.bucketed

    def spied(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return orig(df, *args)

    monkeypatch.setattr(C, "bucketed", spied)
    rows = spark.createDataFrame([(i, f"line number {i % 7}\nanother line {i}\nshared by all of them") for i in range(90)], "doc_id long, text string")
    out = {r.doc_id: r.kept_text for r in linededup.dedup_lines(rows, n_batches=5, fanout=4).collect()}
    assert out == {i: "\n".join([f"line number {i}"] * (i < 7) + [f"another line {i}"] + ["shared by all of them"] * (i == 0)) for i in range(90)}
    joins = [p for p in plans if "SortMergeJoin" in p]
    assert [p.count("SortMergeJoin [") for p in joins] == [1, 2, 3, 1]  # four runs of a level become one
    for p in joins:
        assert p.count("Exchange") == 1 and p.count("Sort [") == 1 and "Bucketed: true" in p
    assert len(linededup.batch_bounds(rows, 2, 10)) == 8


def test_classifier(docs, labels, spark):
    named = quality.quality_labels(labels)
    assert quality.classify(docs, named).count() == len(TEXTS)
    assert quality.classify(docs.limit(0), named).count() == 0
    flat = quality.classify(docs, named.limit(0)).select("score").distinct().collect()
    assert [r.score for r in flat] == [0.5]
    one = quality.classify(docs, named.where("label = 1")).agg({"score": "min"}).first()[0]
    assert one > 0.9


def test_rules(docs):
    got = {(r.doc_id, r.text): r for r in rules.apply_rules(docs).collect()}
    assert len(got) == len(set(TEXTS))
    assert got[(2, None)].n_words == 0 and got[(2, None)].base_failed and not got[(2, None)].kept
    assert got[(0, GOOD)].kept
    ws = LONG.split()
    seen = {}
    for i in range(len(ws) - 2):
        seen.setdefault(tuple(ws[i : i + 3]), []).append(i)
    again = {p for at in seen.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    assert got[(5, LONG)].n_repeat_words == len(again)
    assert rules.apply_rules(docs.limit(0)).count() == 0
    assert rules.apply_rules(docs).where("kept").count() == sum(r.kept for r in rules.apply_rules(docs).collect())


def test_classifier_sample(spark, monkeypatch):
    """The sample is that of one sort over all ids; a text that has too many features is left out, not cut."""
    ids = spark.createDataFrame([(i, i % 2) for i in range(3000)], "doc_id long, label int")
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    want = [tuple(r) for r in ids.orderBy(u, "doc_id").limit(50).collect()]
    assert [tuple(r) for r in quality._drawn(ids, 50).collect()] == want
    seen = []
    monkeypatch.setattr(quality, "train", lambda rows, labels: seen.append((len(rows), sum(len(r[0]) for r in rows))))
    docs = spark.createDataFrame([(i, "some words of a text" if i else LONG) for i in range(40)], "doc_id long, text string")
    labels = ids.where("doc_id < 40")
    quality.fit(docs, labels)
    quality.fit(docs, labels, max_features=3000)
    in_folds = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(40))
    assert seen[0][0] == in_folds and seen[1] == (in_folds - 1, seen[1][1]) and seen[1][1] <= 3000


def test_rules_of_other_scripts(spark):
    """A text in another script needs none of the stop words; one in Latin letters does."""
    russian = " ".join(f"слово{i} и ещё{i} в тексте{i}" for i in range(30))
    latin = " ".join(f"vocable{i} quux{i} blarg{i}" for i in range(30))
    df = spark.createDataFrame([(0, russian), (1, latin)], "doc_id long, text string")
    assert {r.doc_id: r.failed_rules for r in rules.apply_rules(df).collect()} == {0: [], 1: ["stop_words_per_word"]}


def test_lm(docs, spark):
    got = lm.score_documents(docs, F.lit(True)).collect()
    assert len(got) == len(TEXTS)
    assert all(r.n_tokens == len(lm.tokens(t)) + 1 for r, t in zip(sorted(got, key=lambda r: r.n_tokens), sorted((t for _, t in TEXTS), key=lambda t: len(lm.tokens(t))), strict=True))
    none = lm.score_documents(docs, F.lit(None).cast("boolean")).collect()
    assert {r.train_tokens for r in none} == {0} and all(math.isfinite(r.score) for r in none)
    assert lm.score_documents(docs.limit(0), F.lit(True)).count() == 0
    assert lm.score_documents(docs.where("doc_id is null"), F.lit(True)).count() == 2


SMALL_LM = lm.Sizes(head=12, tail=8, near=5, near_tail=4, dim=6)


def _lm_params(v):
    rng, d = np.random.default_rng(1), v.sizes.dim
    return lm.Params(*[rng.normal(0, 0.4, s).astype(np.float32) for s in ((v.n_context, d), (v.size, d), (v.size,), (d, d), (d, d))])


def test_lm_is_normalised():
    v = lm.Vocabulary([f"w{i}".encode() for i in range(16)], SMALL_LM)
    p = _lm_params(v)
    m = lm.Normalised(p)
    for far in range(v.n_context):
        for near in range(v.n_context):
            n = v.size
            assert (10 ** m.log10(np.full(n, far), np.full(n, near), np.arange(n))).sum() == pytest.approx(1, abs=1e-5)


def test_lm_gradients():
    """The gradients against differences of the noise-contrastive objective."""
    v = lm.Vocabulary([f"w{i}".encode() for i in range(16)], SMALL_LM)
    rng = np.random.default_rng(3)
    noise = rng.random(v.size)
    noise /= noise.sum()
    t = lm.Trainer(_lm_params(v), noise, [1])
    far, near = rng.integers(0, v.n_context, (2, 40))
    unit, xs = rng.integers(0, v.size, 40), rng.integers(0, v.size, lm.NOISE)

    def objective(p):
        s = lambda i, u: 1 / (1 + math.exp(-((p[0][far[i]] @ p[3] + p[0][near[i]] @ p[4]) @ p[1][u] + p[2][u] - math.log(lm.NOISE * noise[u]))))
        return sum(math.log(s(i, unit[i])) + sum(math.log(1 - s(i, x)) for x in xs) for i in range(40)) / 40

    p = [x.astype(np.float64) for x in t.p.arrays()]
    for name, at, g in t.gradients(far, near, unit, xs):
        k = ["r", "q", "b", "far", "near"].index(name)
        dense = np.zeros_like(p[k])
        dense[at] = g
        for _ in range(12):
            spot = tuple(rng.integers(0, n) for n in p[k].shape)
            old = p[k][spot]
            p[k][spot] = old + 1e-4
            up = objective(p)
            p[k][spot] = old - 1e-4
            assert dense[spot] == pytest.approx((up - objective(p)) / 2e-4, abs=2e-5)
            p[k][spot] = old


@pytest.mark.parametrize("parts", [1, 3])
def test_lm_scores_by_brute_force(spark, monkeypatch, parts):
    """score against a softmax over all units, token by token, with counts taken anew."""
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice(["the", "of", "Cat", "dog", "cat", "sat", "x" * 70, f"rare{rng.randrange(40)}"]) for _ in range(rng.randrange(30)))) for i in range(40)] + [(40, None), (41, ""), (42, "unseen words only")]
    learns = F.col("doc_id") < 30
    held = {}

    def trained(spark_, encoded, n_tokens, words, noise, name, sizes, rounds):
        held.update(words=words, noise=noise)
        assert encoded.count() == 30
        return _lm_params(lm.Vocabulary(words, SMALL_LM))

    monkeypatch.setattr(lm, "train", trained)
    got = {r.doc_id: r for r in lm.score_documents(spark.createDataFrame(texts, "doc_id long, text string").repartition(parts), learns, SMALL_LM, cached=18).collect()}
    c = Counter(w for i, t in texts if i < 30 for w in lm.tokens(t))
    order = sorted((w for w in c if len(w) <= 64), key=lambda w: (-c[w], w))
    assert held["words"] == order[: len(held["words"])] and len(held["words"]) <= 18
    v = lm.Vocabulary(held["words"], SMALL_LM)
    p = _lm_params(v)
    head = {w: 1 + k for k, w in enumerate(held["words"][: v.n_head])}
    unit = lambda w: head.get(w) or v.first_tail + zlib.crc32(w[-2:]) % 8
    near_of = lambda w: head[w] if head.get(w, 99) <= 5 else 1 + 5 + zlib.crc32(w[-2:]) % 8 % 4
    total, types = Counter(), Counter()
    for w, n in c.items():
        total[unit(w)] += n
        types[unit(w)] += 1
    n_units = np.array([30, *(total[u] for u in range(1, v.size))]) + 0.1
    assert held["noise"] == pytest.approx(n_units / n_units.sum())
    for i, t in texts:
        before, want = [0, 0], 0.0
        for w in [*lm.tokens(t), None]:
            z = (p.r[before[0]] @ p.far + p.r[before[1]] @ p.near) @ p.q.T + p.b
            u = 0 if w is None else unit(w)
            want += (z[u] - math.log(np.exp(z.astype(float)).sum())) / math.log(10)
            if u >= v.first_tail:
                want += math.log10((c[w] + 0.1) / (total[u] + 0.1 * (types[u] + 1)))
            before = [before[1], 0 if w is None else near_of(w)]
        assert got[i].score == pytest.approx(want, abs=1e-3), i


def test_lm_rounds_average_tasks(spark):
    """The tasks' parameters are averaged by tokens, whatever the tasks, and training raises the probability."""
    words = [f"w{i}".encode() for i in range(12)]
    v = lm.Vocabulary(words, SMALL_LM)
    noise = np.full(v.size, 1 / v.size)
    seqs = [np.array([1 + (k + j) % 3 for j in range(60)] + [0], "<u2").tobytes() for k in range(2400)]
    df = spark.createDataFrame(list(enumerate(seqs)), "uid long, units binary").repartition(4)
    at = np.array([1, 2, 3])
    chance = lambda p: lm.Normalised(p).log10(at, np.roll(at, -1), np.roll(at, -2)).mean()
    one = lm.train(spark, df, 61 * len(seqs), words, noise, "t1", SMALL_LM, rounds=1)
    assert chance(one) > chance(lm.Params.start(v, noise)) + 0.3
    again = lm.train(spark, df, 61 * len(seqs), words, noise, "t1", SMALL_LM, rounds=1)
    assert np.array_equal(one.flat(), again.flat())
    assert chance(lm.train(spark, df, 61 * len(seqs), words, noise, "t1", SMALL_LM, rounds=3)) > chance(one)
    cold = lm.train(spark, df, 1 << 60, words, noise, "t1", SMALL_LM, rounds=1)  # nothing drawn to start from
    assert chance(cold) > chance(lm.Params.start(v, noise))


def test_sliced_pairs():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    near = fps.copy()
    for k in range(len(near)):
        for b in rng.choice(64, rng.integers(0, 6), replace=False):
            near[k] ^= np.uint64(1 << int(b))
    both = np.concatenate((fps, near))
    both = both[np.argsort(both & np.uint64(0xFF))]
    bucket = both & np.uint64(0xFF)
    last = np.searchsorted(bucket, bucket, side="right") - 1
    for radius in (1, 2, 3, 4):
        got = {(int(a), int(b)) for i, j in simhash.sliced_pairs(both, last, radius) for a, b in zip(i, j, strict=True)}
        want = {(a, b) for a in range(len(both)) for b in range(a + 1, int(last[a]) + 1) if (int(both[a]) ^ int(both[b])).bit_count() <= radius}
        assert got == want


def test_simhash(docs, spark):
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert [c for i, c in got if i in (0, 1)] == [0, 0, 0] and [c for i, c in got if i in (2, 3, 4)] == [2, 2, 2]
    assert simhash.near_duplicates(docs, tile_rows=2).count() == len(TEXTS)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert ids.count(0) == 1 and 1 not in ids and ids.count(2) == 1 and 3 not in ids


def test_sampling(docs):
    out = spsample.decode_pieces(spsample.encode_documents(docs, spsample.model_path()), spsample.model_path()).collect()
    assert len(out) == len(TEXTS) and all(r.decoded == (r.text or "") for r in out)
    assert spsample.encode_documents(docs.limit(0), spsample.model_path()).count() == 0


def _ways(logp, t):
    """Every segmentation of t with its weight."""
    if not t:
        yield (), 0.0
    for k in range(1, len(t) + 1):
        if t[:k] in logp:
            for rest, w in _ways(logp, t[k:]):
                yield (t[:k], *rest), w + logp[t[:k]]


@pytest.mark.parametrize("text", ["then", "of it", "aaaa"])
@pytest.mark.parametrize("long_chunk", [48, 0])
def test_sampling_distribution(text, long_chunk, monkeypatch):
    """Draws against the enumerated distribution; cutting every chunk between characters changes nothing in it."""
    monkeypatch.setattr(spsample, "LONG_CHUNK", long_chunk)
    s = spsample.Sampler(spsample.model_path(), 0.3)
    logp = {s.bytes_of[i].decode(): w for _, ids, ws in s.tables for i, w in zip(ids.tolist(), ws.tolist(), strict=True)}
    all_ways = {p: math.exp(w) for p, w in _ways(logp, " " + text)}
    total = sum(all_ways.values())
    n = 20_000
    seen = {}
    for x in s.encode(list(range(n)), [text] * n):
        p = tuple(s.bytes_of[i].decode() for i in x.tolist())
        seen[p] = seen.get(p, 0) + 1
    assert set(seen) <= set(all_ways)
    for p, w in all_ways.items():
        q = w / total
        assert abs(seen.get(p, 0) / n - q) < 5 * math.sqrt(q / n) + 1e-3


def test_draws_stay_in_their_state(monkeypatch):
    """The greatest draw takes an edge that ends in the state, in every state of a lattice of over 2^21 states."""
    s = spsample.Sampler(spsample.model_path())
    keys, start, piece, final = s.lattice([f" the{i:07d}x" for i in range(200_000)])
    states = np.arange(final[-1] + 1)
    assert final[-1] > 1 << 21
    inner = np.setdiff1d(states, final - 12)  # the first place of a chunk has no edge into it
    top = (1 << spsample.DRAW_BITS) - 1
    for u in (0, 1, top // 2, top):
        e = np.searchsorted(keys, (inner << spsample.DRAW_BITS) | u, side="right")
        assert e.max() < len(piece)
        width = np.array([len(s.bytes_of[x].decode()) if x >= 0 else 1 for x in piece[e].tolist()])
        assert (start[e] + width == inner).all()
    monkeypatch.setattr(spsample, "_mixed", lambda x: np.full_like(x, (1 << 64) - 1))  # every draw is the greatest
    texts = ["the words of it", "", None, "x" * 300, "日本語テキスト" * 20, "▁ odd\n\tones"]
    assert [s.decode(x) if len(x) else "" for x in s.encode([1, 2, 3, None, 5, 6], texts)] == [t or "" for t in texts]


def test_sampling_of_long_texts(monkeypatch):
    """A text in several blocks, and one without spaces, gives what it gives alone; nothing is step by step."""
    s = spsample.Sampler(spsample.model_path())
    rng = random.Random(9)
    glued = "".join(rng.choice(["Q7", "zx", "then", "漢字", "_", "ß", "9.9"]) for _ in range(60_000))
    texts = [LONG, glued, "short one"]
    whole = s.encode([1, 2, 3], texts)
    assert max(map(len, s.parts(glued))) < 2000
    monkeypatch.setattr(spsample, "BLOCK_CHARS", 5000)
    for a, b in zip(whole, s.encode([1, 2, 3], texts), strict=True):
        assert np.array_equal(a, b)


def test_urls(spark):
    rows = [(1, "http://Sub.Example.COM/en/7x?q"), (2, "https://a.com/en/"), (3, "b.net/de/"), (4, None), (5, "http://x.example.net/de/8"), (None, "ftp://y.org/es/1#z"), (1, "http://notcom/en/"), (6, "http://spam.biz/"), (7, "http://fine.biz/")]
    pages = spark.createDataFrame([(*r, "h", 3.0) for r in rows], "page_id long, url string, host string, mean double")
    bad = spark.createDataFrame([(6, 1)] * 60 + [(7, 0)] * 60 + [(9, None), (None, 1)], "page_id long, bad int")
    got = sorted((str(r.url), r.host, r.path, r.rule, r.verdict) for r in urlrep.judge_urls(pages, bad).collect())
    want = [(None, "", "", None, "allow"), ("b.net/de/", "", "", None, "allow"), ("ftp://y.org/es/1#z", "y.org", "/es/1", "org/es/", "block"), ("http://Sub.Example.COM/en/7x?q", "sub.example.com", "/en/7x", "example.com/en/7", "allow"), ("http://fine.biz/", "fine.biz", "/", None, "allow"), ("http://notcom/en/", "notcom", "/en/", None, "allow"), ("http://spam.biz/", "spam.biz", "/", None, "block"), ("http://x.example.net/de/8", "x.example.net", "/de/8", "example.net/de/8", "block"), ("https://a.com/en/", "a.com", "/en/", "com/en/", "block")]
    assert got == sorted((str(a), *r) for a, *r in want)
    assert urlrep.judge_urls(pages.limit(0), bad).count() == 0
    assert {r.verdict for r in urlrep.judge_urls(pages.where("page_id > 5"), bad.limit(0)).collect()} == {"allow"}


def test_domains(spark):
    """Addresses, ports, users, closing dots and suffixes of several labels."""
    want = {"a.b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("uk", "co.uk"), "x.com:8080": ("com", "x.com"), "me:pw@y.x.com:": ("com", "x.com"), "x.com.": ("com", "x.com"), "192.168.7.9": ("192.168.7.9",) * 2, "10.0.7.9:81": ("10.0.7.9",) * 2, "[::1]:80": ("[::1]",) * 2, "x.github.io": ("github.io", "x.github.io"), "github.io": ("io", "github.io"), "q.s3.de.aws.net": ("s3.de.aws.net", "q.s3.de.aws.net"), "localhost": ("localhost", "localhost"), "": ("", "")}
    hosts = spark.createDataFrame([(h,) for h in want], "host string")
    table = spark.createDataFrame([(x,) for x in [*urlrep.SUFFIXES, "S3.de.aws.net", "aws.net", None, "co.uk"]], "suffix string")
    got = {r.host: (r.suffix, r.domain) for r in urlrep.with_domains(hosts, table).collect()}
    assert got == want


def test_reputation_decides(spark):
    """Pages whose hosts, domains or suffixes turned out badly are blocked without any rule, and clean ones are left alone;
    the posterior against the formula taken anew."""
    rng = random.Random(1)
    rate = {"bad.example": 0.97, "fine.example": 0.02, "x.worse.test": 0.98, "y.worse.test": 0.97, "good.shop": 0.0}
    rows = [(i, h, rng.random() < rate[h]) for i, h in enumerate(rng.choice(list(rate)) for _ in range(1500))]
    pages = [(i, f"http://{h}/p{i}") for i, h, _ in rows] + [(9000, "http://new.worse.test/"), (9001, "http://new.shop/")]
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = {r.page_id: r for r in urlrep.judge_urls(df, spark.createDataFrame([(i, int(b)) for i, _, b in rows], "page_id long, bad int"), rules=()).collect()}
    host = {i: h for i, h, _ in rows}
    assert all(got[i].verdict == ("block" if rate[h] > 0.5 else "allow") for i, h in host.items())
    assert got[9000].bad_rate > 0.5 > got[9001].bad_rate and got[9000].verdict in ("block", "allow")
    for h in rate:
        r = next(got[i] for i in host if host[i] == h)
        n, bad = sum(x == h for x in host.values()), sum(b for _, x, b in rows if x == h)
        assert abs(r.bad_rate - bad / n) < 0.05 and r.bad_rate_low < r.bad_rate


def test_packing_solver():
    rng = random.Random(5)
    for _ in range(150):
        cap = rng.choice([7, 10, 24, 64])
        counts = {rng.randint(1, cap): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}
        used = {}
        patterns = packing.solve(counts, cap)
        for pattern, m in patterns:
            assert m > 0 and sum(s * k for s, k in pattern) <= cap
            for s, k in pattern:
                used[s] = used.get(s, 0) + k * m
        assert used == counts


def _optimum(sizes, cap):
    best = [len(sizes)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] >= sizes[k] and bins[i] not in bins[:i]:
                place(k + 1, [*bins[:i], bins[i] - sizes[k], *bins[i + 1 :]])
        place(k + 1, [*bins, cap - sizes[k]])

    place(0, [])
    return best[0]


def test_reduction_keeps_an_optimum():
    rng = random.Random(6)
    for _ in range(200):
        sizes = sorted((rng.randint(1, 12) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = {s: sizes.count(s) for s in sizes}
        fixed, left = packing.reduce_dominated(counts, 12)
        rest = [s for s, n in left.items() for _ in range(n)]
        assert sum(m for _, m in fixed) + _optimum(sorted(rest, reverse=True), 12) == _optimum(sizes, 12)


def test_packing(docs):
    out = packing.pack_documents(docs, packing.tokenizer_path())
    rows = out.collect()
    assert sum(r.piece == 0 for r in rows) == len(TEXTS)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    long = sorted((r for r in rows if r.doc_id == 5), key=lambda r: r.piece)
    assert [i for r in long for i in r.ids] == [*t.encode(LONG, add_special_tokens=False).ids, 2]
    odd = next(r for r in rows if r.doc_id == 9)
    assert odd.ids == [*t.encode(TEXTS[-1][1], add_special_tokens=False).ids, 2]
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert packing.pack_documents(docs.limit(0), packing.tokenizer_path()).count() == 0


@pytest.mark.parametrize(("share", "salt_rows"), [(1.0, 100), (0.5, 100), (0.0, 7), (0.9, 1 << 17)])
def test_packing_of_a_hot_length(spark, share, salt_rows):
    """Full pieces go through no window or shuffle; other lengths are numbered in groups of about salt_rows."""
    rng = random.Random(8)
    rows = [(i, 0, 0, 32 if rng.random() < share else rng.choice([5, 5, 5, 9, 20]), i % 3) for i in range(2000)] + [(None, 0, 0, 32, 1), (7, 0, 0, 32, 1), (7, 0, 0, 32, 1)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(3)
    out = packing.pack(df, 32, salt_rows)
    got = out.collect()
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, rows))
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == [0, *itertools.accumulate(n for _, n in s)][:-1] and sum(n for _, n in s) <= 32
    counts = {}
    for r in rows:
        counts[r[3]] = counts.get(r[3], 0) + 1
    full = counts.pop(32, 0)
    assert len(seqs) == full + sum(m for _, m in packing.solve(counts, 32))
    if share == 1:
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Exchange hashpartitioning" not in plan


def test_pipeline_brute_force(spark, docs, sf_dir):
    """Each stage on the odd table: its columns, and what it keeps."""
    kept = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept = stage(spark, kept, sf_dir)
        if k < 4:
            assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {0, 1}  # 1 lost its only line to 0, and is empty
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


@pytest.mark.parametrize("k", range(4))
def test_pipeline_row_groups(spark, docs, sf_dir, tmp_path, k):
    """What a stage returns is written and read in small row groups and batches, whatever the size of a partition; a
    session's own number stays."""
    import pyarrow.parquet as pq

    for name, _, _ in C.LEAN:
        spark.conf.unset(name)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "300")
    corpus_pipeline.STAGES[k][1](spark, docs, sf_dir)
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "300"
    spark.conf.unset("spark.sql.parquet.columnarReaderBatchSize")
    C.lean(spark)
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "256"
    text = F.concat(*[F.sha2(F.concat_ws(" ", "id", F.lit(i)).cast("binary"), 512) for i in range(64)])  # 8 KB that don't compress
    C.materialize(spark.range(6000).coalesce(1).select("id", text.alias("text")), f"file://{tmp_path}/t")
    (part,) = (tmp_path / "t").glob("*.parquet")
    meta = pq.ParquetFile(part).metadata
    assert meta.num_rows == 6000 and max(meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)) < 24e6


def test_pipeline_on_tables(spark):
    """run() against plain versions of its stages: SQL for the rules, loops for lines and fingerprints, the tokenizer
    itself for the packing; the classifier's verdicts are held against the labels."""
    import duckdb
    import xxhash
    from tokenizers import Tokenizer

    d = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, d).toPandas()
    docs = spark.read.parquet(f"{d}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    good = {i for i, kept in con.execute(f"SELECT doc_id, kept FROM ({rules.SQL})").fetchall() if kept}
    passed = set(good)
    labels = spark.read.parquet(f"{d}/labels.parquet")
    good &= {r.doc_id for r in quality.classify(docs, quality.quality_labels(labels)).where("predicted = 1").select("doc_id").collect()}
    said = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in passed}
    assert all(i in good for i, q in said.items() if q == 1) and sum(i in good for i, q in said.items() if q == 0) <= 1
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    strip = " \t\n\x0b\x0c\r"
    first = {}
    for i in sorted(texts):
        for line in texts[i].split("\n"):
            first.setdefault(line.strip(strip).encode().lower(), i)
    texts = {i: "\n".join(x for x in t.split("\n") if len(x.strip(strip)) < 10 or first[x.strip(strip).encode().lower()] == i) for i, t in texts.items()}
    fps = {}
    for i, t in texts.items():
        ws = t.encode().lower().split()
        hs = [xxhash.xxh64_intdigest(b" ".join(ws[k : k + 3]), 42) for k in range(max(1, len(ws) - 2))] if ws else []
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    alone, seen = set(), set()
    for i in sorted(fps):
        if i in seen:
            continue
        todo = [i]
        alone.add(i)
        seen.add(i)
        while todo:
            x = todo.pop()
            for j in fps:
                if j not in seen and (fps[x] ^ fps[j]).bit_count() <= 3:
                    seen.add(j)
                    todo.append(j)
    assert set(out.doc_id) == alone
    t = Tokenizer.from_file(packing.tokenizer_path())
    lengths = Counter()
    for i, g in out.groupby("doc_id"):
        ids = np.array([*t.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        lengths.update(packing.cut(len(ids), 1024)[k][1] for k in range(-(-len(ids) // 1024)))
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(g.sort_values("piece").start, g.sort_values("piece").length, strict=True)] == g.sort_values("piece").ids_crc32.tolist()
    assert lengths == Counter(out.length)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 1024
    assert out.sequence_id.nunique() == lengths[1024] + sum(m for _, m in packing.solve({n: k for n, k in lengths.items() if n < 1024}, 1024))
