"""The ten queries on the smallest tables: against their SQL, or against brute force."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.conftest import DATA
from tidemark.llm import lm, packing, registry, spsample

DIR = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(name, same):
    same(registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def words(text):
    return (text or "").encode().lower().split()


def test_op4_held_out_accuracy(spark):
    got = registry.QUERIES["op4_quality_classifier"](spark, f"{DATA}/sf0.01").toPandas()
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet").toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    x = got.merge(labels, on="doc_id")
    x = x[x.held_out]
    good, bad = x[x.quality == 1].score.values, x[x.quality == 0].score.values
    assert (good[:, None] > bad[None]).mean() > 0.95
    assert (good >= 0.3).mean() > 0.98


def test_op6_base_scores_and_held_out_gain(spark, documents):
    got = registry.QUERIES["op6_lm_scoring"](spark, DIR).toPandas().set_index("doc_id")
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in documents}
    c = Counter()
    for i, t in documents.items():
        if not held[i]:
            c.update(words(t))
            c["end"] += 1
    n, v = sum(c.values()), len(c)
    for i, t in documents.items():
        ws = [*words(t), "end"]
        base = sum(math.log10((c.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        r = got.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(w in c for w in ws), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum() + 0.1 * out.n_tokens.sum()


def test_op6_held_out_perplexity(spark):
    """Below that of a bigram over the same units, smoothed with its unigram as suits the held-out texts best."""
    sf = f"{DATA}/sf0.1"
    got = registry.QUERIES["op6_lm_scoring"](spark, sf).toPandas().set_index("doc_id")
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 10 == 0}
    c = Counter(w for i in docs if i not in held for w in docs[i])
    v = lm.Vocabulary(sorted(c, key=lambda w: (-c[w], w)))
    units = {i: [0, *v.look(ws)[1].tolist(), 0] for i, ws in docs.items()}
    one, two = Counter(), Counter()
    for i, us in units.items():
        if i not in held:
            one.update(us[1:])
            two.update(zip(us, us[1:], strict=False))
    before = Counter()
    for (a, _), n in two.items():
        before[a] += n
    n_all, total, types = sum(one.values()), Counter(), Counter()
    for w, n in c.items():
        total[v.look([w])[1][0]] += n
        types[v.look([w])[1][0]] += 1
    bigram = {}
    for strength in (30, 300, 3000):
        bigram[strength] = 0.0
        for i in held:
            us = units[i]
            bigram[strength] += sum(math.log10((two[a, b] + strength * (one[b] + 0.1) / (n_all + 0.1 * v.size)) / (before[a] + strength)) for a, b in zip(us, us[1:], strict=False))
            bigram[strength] += sum(math.log10((c.get(w, 0) + 0.1) / (total[u] + 0.1 * (types[u] + 1))) for w, u in zip(docs[i], us[1:], strict=False) if u >= v.first_tail)
    out = got[got.held_out]
    assert out.score.sum() > max(bigram.values())


def test_op7_brute_force(spark, documents):
    import xxhash

    got = registry.QUERIES["op7_simhash"](spark, DIR).toPandas().set_index("doc_id")
    fps = {}
    for i, t in documents.items():
        ws = words(t)
        hs = [xxhash.xxh64_intdigest(b" ".join(ws[k : k + 3]), 42) for k in range(max(1, len(ws) - 2))] if ws else []
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0
    ids = sorted(fps)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    assert {i: f"{fps[i]:016x}" for i in ids} == got.fingerprint.to_dict()
    assert {i: root(i) for i in ids} == got.component_id.to_dict()


def test_op8_round_trip_and_repeat(spark, documents):
    got = registry.QUERIES["op8_sentencepiece"](spark, DIR).toPandas().set_index("doc_id")
    assert got.lossless.all() and len(got) == len(documents)
    s = spsample.Sampler(spsample.model_path())
    few = sorted(documents)[:20]
    for i, ids in zip(few, s.encode(few, [documents[i] for i in few]), strict=True):
        assert (len(ids), zlib.crc32(ids.astype("<u4").tobytes())) == (got.loc[i].n_pieces, got.loc[i].ids_crc32)


def test_op10_pieces_and_sequences(spark, documents):
    from tokenizers import Tokenizer

    got = registry.QUERIES["op10_packing"](spark, DIR).toPandas()
    t = Tokenizer.from_file(packing.tokenizer_path())
    by = defaultdict(list)
    for r in got.itertuples():
        by[r.doc_id].append(r)
    for i, text in documents.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        rs = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in rs] == list(range(len(rs)))
        assert len(rs) == -(-len(ids) // 1024) and all(r.length == 1024 for r in rs[1:])
        at = 0
        for r in rs:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    seqs = got.sort_values("offset").groupby("sequence_id")
    for _, g in seqs:
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 1024
    assert len(seqs) <= math.ceil(got.length.sum() / 1024) * 1.02 + 1
