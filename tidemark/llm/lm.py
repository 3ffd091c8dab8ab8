"""LM scoring: a log-bilinear neural model over words, trained by noise-contrastive estimation.

Units (their numbers: SIZES): the end of a text, the most frequent training words, and units that share all
other words by a hash of their last two bytes. Given the two words before it, a unit w has the score
(r[before last] C_far + r[last] C_near) . q[w] + b[w]; the context vectors r are those of the end, fewer of
the most frequent words and fewer hashed units. P(unit | context) is the softmax of that over all units,
and a word that shares its unit has its share (c + 0.1) of the unit's training tokens, so every text has a
normalised probability.

Training is over every token of the training texts, in numpy: each task takes minibatches of its own
tokens, NOISE units drawn anew from the unigram distribution for each minibatch, and ascends the
noise-contrastive objective by Adagrad; after a round the tasks' parameters are averaged, weighted by
tokens, and a next round starts from the mean. So that the tasks of the first round have a common direction, they
start from what one task learns from texts of about WARM_TOKENS tokens, drawn by hash. Parameters travel as blocks of numbers that are summed
in a shuffle, so the driver gets one model however many tasks there are. A model follows how the table is dealt
into tasks: the same files and settings give the same scores, others scores of the same quality.

The normaliser of a context is a sum over units of exp(a near part) * exp(a far part): for all pairs of
context units it is one product of two matrices, taken once, so that scoring a token costs three looked-up
vectors and one looked-up normaliser.

Counts of words are aggregated over all training texts and stay a table. At most MOST_CACHED words, the
most frequent, and none of over LONGEST_CACHED bytes, are broadcast: the least count to be cached is read
off a histogram of counts. Occurrences of other words are joined with the table. Texts are
tokenised once for all else, into a table of unit numbers.

Defined results. Null or empty text: one token, the end. Null doc_id: as the empty text in the fold;
scored. Repeated rows: each counts and is scored. Ties: words of equal count are ordered by their bytes, and
are cached all or none. Very long texts and words are scored whole. No training rows: N = 0, a flat
model. Empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C

FOLDS, ADD = 10, 0.1
MOST_CACHED, LONGEST_CACHED = 1 << 17, 64
#: Rounds over all training tokens, tokens that the first one starts from, noise units and tokens of a minibatch.
ROUNDS, WARM_TOKENS, NOISE, BATCH = 1, 1 << 20, 256, 512
#: Adagrad's rate and the squares that it begins with.
RATE, FIRST_SQUARE, SEED = 0.05, 1e-6, 11
#: Numbers of the parameters that travel as one row, and tokens that are shuffled together.
BLOCK, MIXED_TOKENS = 4096, 1 << 18
#: Distinct words that a counting task holds before it passes them on.
HELD_WORDS = 250_000
END = 0


def tokens(text: str | None) -> list[bytes]:
    """The words of a text; bytes split and lower-case by exactly the ASCII sets."""
    return (text or "").encode().lower().split()


@dataclass(frozen=True)
class Sizes:
    """Words with units of their own and hashed units; the same of context units (tail is a multiple of
    near_tail); dimensions."""

    head: int = 3071
    tail: int = 1024
    near: int = 1023
    near_tail: int = 512
    dim: int = 16

    def tail_of(self, word: bytes) -> int:
        return zlib.crc32(word[-2:]) % self.tail


SIZES = Sizes()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    C.worker_cache("lm-words")
    held: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])
        held.clear()
        return got

    for b in C.slices(batches):
        for text in b.column(0).to_pylist():
            held.update(tokens(text))
            if len(held) > HELD_WORDS:
                yield out()
    if held:
        yield out()


class Vocabulary:
    """Cached words by falling count, their units, and each unit's context unit."""

    def __init__(self, words: list[bytes], sizes: Sizes = SIZES) -> None:
        self.sizes, self.index = sizes, {w: i for i, w in enumerate(words)}
        self.n_head = min(sizes.head, len(words))
        self.first_tail = 1 + self.n_head
        self.size = self.first_tail + sizes.tail
        near = min(sizes.near, self.n_head)
        self.n_context = 1 + near + sizes.near_tail
        self.unit = np.array([1 + i if i < self.n_head else self.first_tail + sizes.tail_of(w) for i, w in enumerate(words)] + [0], np.int64)
        tails = [*map(sizes.tail_of, words[near : self.n_head]), *range(sizes.tail)]
        self.context = np.concatenate((np.arange(1 + near), 1 + near + np.array(tails, np.int64) % sizes.near_tail)).astype(np.int32)

    def look(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index or -1, unit, places of -1) of each word."""
        i = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        k = self.unit[i]
        rest = np.flatnonzero(i < 0)
        if len(rest):
            k[rest] = [self.first_tail + self.sizes.tail_of(words[p]) for p in rest.tolist()]
        return i, k, rest


def vocabulary_of(shared) -> Vocabulary:
    """The broadcast words as a lookup, built once per Python worker."""
    return C.worker_cache(("lm", shared.value[0]), lambda: Vocabulary(shared.value[1], shared.value[2]))


@dataclass
class Params:
    """r: context vectors; q, b: vectors and biases of units; far, near: the maps of the two context places."""

    r: np.ndarray
    q: np.ndarray
    b: np.ndarray
    far: np.ndarray
    near: np.ndarray

    @classmethod
    def start(cls, v: Vocabulary, noise: np.ndarray) -> Params:
        rng, dim = np.random.default_rng(SEED), v.sizes.dim
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        one = np.eye(dim, dtype=np.float32)
        return cls(small(v.n_context, dim), small(v.size, dim), np.log(noise).astype(np.float32), 0.5 * one, one.copy())

    def arrays(self) -> list[np.ndarray]:
        return [self.r, self.q, self.b, self.far, self.near]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.arrays()])

    def like(self, flat: np.ndarray) -> Params:
        """Parameters of this shape out of one array."""
        parts = np.split(flat, np.cumsum([x.size for x in self.arrays()])[:-1])
        return Params(*[p.reshape(x.shape).astype(np.float32) for p, x in zip(parts, self.arrays(), strict=True)])


def _sum_rows(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct indexes, sums of their rows)."""
    order = np.argsort(index.astype(np.uint16), kind="stable")  # units fit; short keys sort by radix
    index = index[order]
    first = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))
    pairs = np.take(rows, order, axis=0).view(np.complex64)  # two columns are summed at once
    return index[first], np.add.reduceat(pairs, first).view(np.float32)


class Trainer:
    """Noise-contrastive estimation by Adagrad, from given parameters.

    For a token w in context h and noise units x_1 .. x_k drawn from p, the objective is log s(w, h) + the sum
    of log (1 - s(x_j, h)), with s(u, h) the logistic of score(u, h) - log (k p(u))."""

    def __init__(self, params: Params, noise: np.ndarray, seed: list[int]) -> None:
        self.p = Params(*[x.copy() for x in params.arrays()])
        self.seen = Params(*[np.full_like(x, FIRST_SQUARE) for x in params.arrays()])
        self.shift = np.log(NOISE * noise).astype(np.float32)
        self.cumulative = np.cumsum(noise)
        self.rng = np.random.default_rng(seed)

    def gradients(self, far: np.ndarray, near: np.ndarray, unit: np.ndarray, xs: np.ndarray) -> list[tuple[str, object, np.ndarray]]:
        """(parameter, its rows, the mean objective's gradient there) for tokens `unit` and noise units xs."""
        p = self.p
        rf, rn, qw, qx = (np.take(x, at, axis=0) for x, at in ((p.r, far), (p.r, near), (p.q, unit), (p.q, xs)))
        h = rf @ p.far + rn @ p.near
        data = np.einsum("ij,ij->i", h, qw) + p.b[unit] - self.shift[unit]
        gd = 0.5 - 0.5 * np.tanh(0.5 * data)  # 1 - s
        gx = h @ qx.T
        gx += p.b[xs] - self.shift[xs]
        gx *= 0.5
        np.tanh(gx, out=gx)
        gx *= -0.5
        gx -= 0.5  # - s
        scale = np.float32(1 / len(unit))
        gd *= scale
        gx *= scale
        back = gd[:, None] * qw + gx @ qx
        both = np.concatenate((unit, xs))
        at, sums = _sum_rows(both, np.concatenate((gd[:, None] * h, gx.T @ h)))
        bias = np.bincount(both, weights=np.concatenate((gd, gx.sum(axis=0))), minlength=len(p.b))[at].astype(np.float32)
        rows, r_sums = _sum_rows(np.concatenate((far, near)), np.concatenate((back @ p.far.T, back @ p.near.T)))
        return [("q", at, sums), ("b", at, bias), ("r", rows, r_sums), ("far", slice(None), rf.T @ back), ("near", slice(None), rn.T @ back)]

    def step(self, far: np.ndarray, near: np.ndarray, unit: np.ndarray) -> None:
        drawn = self.rng.random(NOISE) * self.cumulative[-1]
        xs = np.searchsorted(self.cumulative, drawn, side="right").clip(max=len(self.cumulative) - 1)
        for name, at, g in self.gradients(far, near, unit, xs):
            x, seen = getattr(self.p, name), getattr(self.seen, name)
            s = seen[at] + g * g
            seen[at] = s
            x[at] += RATE * g / np.sqrt(s)

    def learn(self, far: np.ndarray, near: np.ndarray, unit: np.ndarray) -> None:
        """Minibatches of these tokens in random order."""
        order = self.rng.permutation(len(unit))
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            self.step(far[part], near[part], unit[part])


class Normalised:
    """Log-probabilities of units; the normalisers of all context pairs are one product of matrices."""

    def __init__(self, p: Params) -> None:
        self.far, self.near, self.q, self.b = p.r @ p.far, p.r @ p.near, p.q, p.b
        a, c = self.far @ p.q.T, self.near @ p.q.T + p.b
        top_a, top_c = a.max(axis=1, keepdims=True), c.max(axis=1, keepdims=True)
        z = np.exp(a - top_a) @ np.exp(c - top_c).T
        self.log_z = np.log(z, dtype=np.float32) + top_a + top_c.T

    def log10(self, far: np.ndarray, near: np.ndarray, unit: np.ndarray) -> np.ndarray:
        s = np.einsum("ij,ij->i", self.far[far] + self.near[near], self.q[unit]) + self.b[unit] - self.log_z[far, near]
        return s.astype(np.float64) / np.log(10)


def contexts(units: np.ndarray, starts: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The context units (far, near) of every unit of texts that begin at starts; before a text there are ends."""
    c = context[units]
    near, far = np.concatenate(([END], c[:-1])), np.concatenate(([END, END], c[:-2]))[: len(c)]
    near[starts] = END
    far[starts] = END
    second = starts + 1
    far[second[second < len(c)]] = END
    return far, near


def _encode(shared, n_end: int, n_all: int, n_distinct: int):
    """Texts to (uid, doc_id, n_tokens, n_known, base_score, own_score, units, learns, far words and their counts);
    own_score is the part of the model's score that says which word of a shared unit it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, _, counts, tail = shared.value
        v = vocabulary_of(shared)
        log_count = np.append(np.log10(counts + ADD), 0.0)
        log_all = np.log10(n_all + ADD * (n_distinct + 1))
        uid = TaskContext.get().partitionId() << 40
        for b in C.slices(batches):
            out: list[tuple] = []
            for doc, text, learns in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ws = tokens(text)
                i, k, rest = v.look(ws)
                far = Counter(ws[p] for p in rest.tolist())
                base = log_count[i].sum() + np.log10(n_end + ADD) - (len(ws) + 1) * log_all
                own = k >= v.first_tail
                own_score = log_count[i[own]].sum() - tail[k[own] - v.first_tail].sum()
                out.append((uid, doc, len(ws) + 1, int((i >= 0).sum()) + (n_end > 0), float(base), float(own_score), np.append(k, END).astype("<u2").tobytes(), learns, list(far), list(far.values())))
                uid += 1
            cols = zip(*out, strict=True) if out else [[]] * len(_ENCODED)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ENCODED.values(), strict=True)], list(_ENCODED))

    return run


_ENCODED = {"uid": pa.int64(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "own_score": pa.float64(), "units": pa.binary(), "learns": pa.bool_(), "far_words": pa.list_(pa.binary()), "far_counts": pa.list_(pa.int64())}
_ENCODED_DDL = "uid long, doc_id long, n_tokens long, n_known long, base_score double, own_score double, units binary, learns boolean, far_words array<binary>, far_counts array<long>"


def _runs_of(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(the batches' slices, units, starts) of about `most` units at a time, a text never cut."""
    for b in batches:
        col = b.column(column)
        n = np.diff(np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]) // 2
        a, held = 0, 0
        for k, x in enumerate(n.tolist(), 1):
            held += x
            if held >= most or k == len(n):
                part = b.slice(a, k - a)
                units = np.concatenate([np.frombuffer(x, "<u2") for x in part.column(column).to_pylist()]).astype(np.int64)
                yield part, units, np.cumsum(n[a:k]) - n[a:k]
                a, held = k, 0
    C.release()


def _learn(shared, flat: np.ndarray, round_no: int):
    """One task's share of a round: its parameters in blocks, with the number of its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary_of(shared)
        noise = shared.value[3]
        task = TaskContext.get().partitionId()
        t, n, held = None, 0, []

        def learn() -> None:
            far, near, unit = (np.concatenate(x) for x in zip(*held, strict=True))
            t.learn(far, near, unit)
            held.clear()

        waiting = 0
        for _, units, starts in _runs_of(batches, "units", MIXED_TOKENS):
            t = t or Trainer(Params.start(v, noise).like(flat), noise, [SEED, round_no, task])
            held.append((*contexts(units, starts, v.context), units))
            n, waiting = n + len(units), waiting + len(units)
            if waiting >= MIXED_TOKENS:
                learn()
                waiting = 0
        if held:
            learn()
        if t is not None:
            got = t.p.flat()
            cuts = [got[k : k + BLOCK].astype("<f4").tobytes() for k in range(0, len(got), BLOCK)]
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(cuts)), pa.int32()), "task": pa.array([task] * len(cuts), pa.int32()), "tokens": pa.array([n] * len(cuts), pa.int64()), "numbers": pa.array(cuts, pa.binary())})

    return run


def _mean_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, sorted by number, to their means weighted by tokens: one running sum is held."""
    now, total, n = None, None, 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"block": pa.array([now], pa.int32()), "numbers": pa.array([(total / n).astype("<f4").tobytes()], pa.binary())})

    for b in batches:
        for block, tokens_, numbers in zip(*(b.column(c).to_pylist() for c in ("block", "tokens", "numbers")), strict=True):
            if block != now:
                if now is not None:
                    yield out()
                now, total, n = block, 0.0, 0
            total = total + tokens_ * np.frombuffer(numbers, "<f4").astype(np.float64)
            n += tokens_
    if now is not None:
        yield out()


def train(spark: SparkSession, texts: DataFrame, n_tokens: int, words: list[bytes], noise: np.ndarray, name: str, sizes: Sizes = SIZES, rounds: int = ROUNDS) -> Params:
    """Parameters learned from all units of texts(uid, units binary); n_tokens: how many there are."""
    v = Vocabulary(words, sizes)
    params = Params.start(v, noise)
    shared = spark.sparkContext.broadcast((name, words, sizes, noise))
    n_blocks = -(-params.flat().size // BLOCK)
    few = texts.where(F.pmod(F.xxhash64("uid"), F.lit(1 << 20)) < (WARM_TOKENS << 20) // max(WARM_TOKENS, n_tokens))
    few = few.select("uid", "units").repartition(1).sortWithinPartitions("uid")
    for k, some in enumerate([few, *[texts] * rounds]):
        learned = some.select("units").mapInArrow(_learn(shared, params.flat(), k), "block int, task int, tokens long, numbers binary")
        dealt = learned.repartition(n_blocks, "block").sortWithinPartitions("block", "task")
        got = dealt.mapInArrow(_mean_blocks, "block int, numbers binary").toArrow()  # one model
        if not got.num_rows:  # no training texts, or none of a few very long ones was drawn to start from
            continue
        by = dict(zip(got.column("block").to_pylist(), got.column("numbers").to_pylist(), strict=True))
        params = params.like(np.frombuffer(b"".join(by[x] for x in sorted(by)), "<f4"))
    return params


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, context, model = shared.value
        for part, units, starts in _runs_of(batches, "units", 1 << 16):
            total = np.zeros(len(starts))
            far, near = contexts(units, starts, context)
            for a in range(0, len(units), 1 << 16):  # a very long text, a part at a time
                z = slice(a, a + (1 << 16))
                own = np.searchsorted(starts, np.arange(a, min(len(units), z.stop)), side="right") - 1
                total += np.bincount(own, weights=model.log10(far[z], near[z], units[z]), minlength=len(starts))
            out = part.drop_columns(["units", "own_score"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(total + part.column("own_score").to_numpy())], [*out.schema.names, "score"])

    return run


def cached_words(counts: DataFrame, most: int = MOST_CACHED) -> tuple[list[bytes], np.ndarray]:
    """Up to `most` of the words of counts(word, c), the most frequent, by falling count then bytes, and their
    counts. The least count that is cached comes from a histogram of fixed size, so nothing is sorted
    in one task; words of that level are taken all or none."""
    level = F.floor(F.log2(F.col("c")) * 256).cast("int")
    short = counts.where(F.length("word") <= LONGEST_CACHED)
    rows = short.groupBy(level.alias("level")).count().collect()  # 256 for each power of two
    left, least = most, None
    for lev, n in sorted(map(tuple, rows), reverse=True):
        if n > left:
            break
        left, least = left - n, lev
    if least is None:
        return [], np.zeros(0)
    got = short.where(level >= least).toArrow()
    found = sorted(zip((-c for c in got.column("c").to_pylist()), got.column("word").to_pylist(), strict=True))
    return [w for _, w in found], np.array([-c for c, _ in found], np.float64)


def score_documents(docs: DataFrame, learns: Column, sizes: Sizes = SIZES, rounds: int = ROUNDS, cached: int = MOST_CACHED) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of docs(doc_id, text), with counts and model
    learned from the rows where `learns`, a condition on docs, is true."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    path = C.workspace(spark, "lm")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(learns, F.lit(False)).alias("learns"))
    counts = C.materialize(rows.where("learns").select("text").mapInArrow(_count_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), f"{path}/counts")
    n_end = rows.where("learns").count()
    n_words, n_types = counts.agg(F.sum("c"), F.count("*")).first()
    n_all, n_distinct = (n_words or 0) + n_end, n_types + (n_end > 0)
    words, known = cached_words(counts, cached)
    v = Vocabulary(words, sizes)
    # tokens and types of each shared unit, over the whole table of counts
    last = F.when(F.length("word") > 2, F.substring("word", -2, 2)).otherwise(F.col("word"))
    kinds = counts.groupBy((F.crc32(last) % sizes.tail).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("types")).collect()
    total, types = np.zeros(sizes.tail), np.zeros(sizes.tail)
    for k, c, n in kinds:
        total[k], types[k] = c, n
    for w, c in zip(words[: v.n_head], known, strict=False):
        total[sizes.tail_of(w)] -= c
        types[sizes.tail_of(w)] -= 1
    noise = np.concatenate(([n_end], known[: v.n_head], total)) + ADD
    noise /= noise.sum()
    shared = sc.broadcast((path, words, sizes, known, np.log10(total + ADD * (types + 1))))
    encoded = C.materialize(rows.mapInArrow(_encode(shared, n_end, n_all, n_distinct), _ENCODED_DDL), f"{path}/encoded")
    params = train(spark, encoded.where("learns"), n_all, words, noise, path, sizes, rounds)
    model = sc.broadcast((path, v.context, Normalised(params)))
    slim = encoded.select("uid", "doc_id", "n_tokens", "n_known", "base_score", "own_score", "units")
    near = slim.mapInArrow(_score(model), "uid long, doc_id long, n_tokens long, n_known long, base_score double, score double")
    # words that are not cached: their counts, whatever their number
    far = encoded.select("uid", F.explode(F.arrays_zip("far_words", "far_counts")).alias("x")).select("uid", F.col("x.far_words").alias("word"), F.col("x.far_counts").alias("tf"))
    far = far.join(counts, "word", "left")
    far = far.groupBy("uid").agg(F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + ADD)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("more_known"))
    out = near.join(far, "uid", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = C.crc_mod(F.col("doc_id"), FOLDS) == 0
    scored = score_documents(docs, ~held_out)
    return scored.withColumn("held_out", held_out).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
