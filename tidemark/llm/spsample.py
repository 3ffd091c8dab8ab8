"""SentencePiece encoding by forward filtering and backward sampling, and decoding.

A text, spaces as word marks, is cut into chunks that no piece crosses (words, and long words again
between any two characters that stand side by side in no piece); over a chunk's lattice of
pieces the forward pass sums the weights of all segmentations up to each position, and segmentations
are drawn backwards from the end, each with its probability. Draws are a counter-based hash of
(seed, row key, chunk, step): the same row gives the same pieces wherever and with whatever it is
processed. A draw is a whole number below 1 << DRAW_BITS, and each state's cumulative weights are whole
numbers that end there, so a draw always falls on an edge of its own state. A piece's log-probability is Zipf's law over its merge rank, times `alpha` (0: every
segmentation alike; large: the likeliest). A character that is no piece is spelt in byte pieces, so
every text decodes to itself; rows are checked for that and a failure raises.

Lattices are built for all distinct chunks of a block at once: rolling hashes find the pieces of each
length, the forward pass goes position by position over all chunks, and a step of sampling is one
search in the sorted cumulative weights of all states.

Very long texts are processed whole, in blocks of BLOCK_CHARS characters. Steps over a block are as many as the characters of its longest chunk: text
without spaces is cut between characters as above, and only a run whose neighbours all occur in
pieces (one letter repeated, say) takes a step of some 20 microseconds for each of its characters.

Defined results. Null or empty text: no pieces, decoded to the empty text. Null row key: as the key
NULL_KEY. Repeated rows: the same pieces. Literal word marks in a text are spelt in bytes. Empty table: empty result.
Other columns pass through `encode_documents`; ids is replaced.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C

MODEL = "piece_bpe_32k.model"
ALPHA, SEED, NULL_KEY = 1.0, 2024, -1
MARK = "▁"
BLOCK_CHARS = 1 << 21
#: Bits of the table that tells which hashes can be pieces.
SIEVE_BITS = 21
#: Bits of a draw; states, which take the rest of a long, are at most 1 << STATE_BITS in a block.
DRAW_BITS, STATE_BITS = 36, 26
#: Chunks of more characters are looked through for places that no piece crosses.
LONG_CHUNK = 48
_BASE = np.uint64(0x100000001B3)
_U = np.uint64


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer (xor-shift and multiply rounds)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Sampler:
    def __init__(self, path: str, alpha: float = ALPHA, seed: int = SEED) -> None:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.seed = seed
        self.byte_ids = np.full(256, -1, np.int64)
        self.bytes_of: list[bytes] = []
        names, ids, ranks = [], [], []
        for i in range(n):
            name = m.id_to_piece(i)
            if m.is_byte(i):
                b = int(name[3:5], 16)
                self.byte_ids[b] = i
                self.bytes_of.append(bytes([b]))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(name.replace(MARK, " ").encode())
                names.append(name)
                ids.append(i)
                ranks.append(-m.get_score(i))
        rank = np.argsort(np.argsort(ranks, kind="stable"), kind="stable")
        harmonic = (1 / np.arange(1, len(names) + 1)).sum()
        logp = -alpha * (np.log(rank + 1.0) + np.log(harmonic))
        self.fallback = float(logp.min()) - 10.0
        # a mark opens a chunk and so does a character that no piece of two or more holds
        joined = {c for x in names if len(x) > 1 for c in x}
        split = "".join(re.escape(c) for c in "\n\t\r" if c not in joined)
        self.find = re.compile(f" +[^ {split}]*" + (f"|[{split}]" if split else "") + f"|[^ {split}]+").findall
        assert not any(MARK in x.lstrip(MARK) for x in names), "pieces cross words"
        pairs = {(ord(a) << 21) | ord(b) for x in names for a, b in itertools.pairwise(x.replace(MARK, " "))}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.sieve = np.zeros(1 << SIEVE_BITS, np.uint8)  # bit 0: can be a piece; bit 1: can begin a longer one
        for size in range(1, max(map(len, names)) + 1):
            at = [k for k, x in enumerate(names) if len(x) == size]
            h = np.zeros(len(at), _U)
            if at:
                cps = np.array([[ord(c) for c in names[k].replace(MARK, " ")] for k in at], _U)
                for c in range(size):
                    if c:
                        self.sieve[self._slot(h, c)] |= 2
                    h = h * _BASE + cps[:, c] + _U(1)
            order = np.argsort(h)
            assert len(np.unique(h)) == len(h), "piece hashes collide"
            self.tables.append((h[order], np.array(ids, np.int64)[np.array(at, np.int64)][order], logp[np.array(at, np.int64)][order]))
            self.sieve[self._slot(h, size)] |= 1

    @staticmethod
    def _slot(h: np.ndarray, size: int) -> np.ndarray:
        return ((h ^ _U(size)) * _U(0x9E3779B97F4A7C15)) >> _U(64 - SIEVE_BITS)

    def parts(self, chunk: str) -> list[str]:
        """A chunk cut wherever its two neighbouring characters are neighbours in no piece: segmentations of
        the parts are independent, so the chunk's distribution is their product."""
        c = np.frombuffer(chunk.encode("utf-32-le"), "<u4").astype(np.int64)
        pair = (c[:-1] << 21) | c[1:]
        k = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        cuts = [0, *(np.flatnonzero(self.pairs[k] != pair) + 1).tolist(), len(chunk)] if len(self.pairs) else range(len(chunk) + 1)
        return [chunk[a:b] for a, b in itertools.pairwise(cuts)]

    def lattice(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(keys, from_state, piece, end state of each chunk). States number the places between characters,
        chunk by chunk; keys are end state << DRAW_BITS + cumulative weight of its edges, ascending; the last
        of a state is the next state's zero."""
        c = np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4")
        if len(c) + len(chunks) > 1 << STATE_BITS:
            raise ValueError("a run of characters that is too long for a lattice")
        lens = np.fromiter(map(len, chunks), np.int64, len(chunks))
        ends = np.cumsum(lens)
        own = np.repeat(np.arange(len(chunks)), lens)
        left = ends[own] - np.arange(len(c))  # characters to the chunk's end, this one included
        start, end, piece, lp = [], [], [], []
        h = np.zeros(len(c), _U)
        at = np.arange(len(c))
        cu = c.astype(_U) + _U(1)
        for size, (hashes, ids, weights) in enumerate(self.tables, 1):
            fits = left[at] >= size
            at, h = at[fits], h[fits]
            if not len(at):
                break
            h = h * _BASE + cu[at + size - 1]
            can = self.sieve[self._slot(h, size)]
            hit = np.flatnonzero(can & 1) if len(hashes) else np.zeros(0, np.int64)
            k = np.searchsorted(hashes, h[hit])
            good = hashes[np.minimum(k, len(hashes) - 1)] == h[hit] if len(hashes) else np.zeros(0, bool)
            hit, k = hit[good], k[good]
            if size == 1:  # marks of the text itself are no pieces
                odd = c[at[hit]] == ord(MARK)
                hit, k = hit[~odd], k[~odd]
                miss = np.ones(len(c), bool)
                miss[at[hit]] = False
                miss = np.flatnonzero(miss)
                s = miss + own[miss]
                start.append(s)
                end.append(s + 1)
                piece.append(-1 - c[miss].astype(np.int64))
                lp.append(np.full(len(miss), self.fallback))
            s = at[hit] + own[at[hit]]
            start.append(s)
            end.append(s + size)
            piece.append(ids[k])
            lp.append(weights[k])
            longer = np.flatnonzero(can & 2)
            at, h = at[longer], h[longer]
        start, end, piece, lp = (np.concatenate(x) for x in (start, end, piece, lp))
        order = np.argsort(end, kind="stable")
        start, end, piece, lp = start[order], end[order], piece[order], lp[order]
        # edges in the order of their end's place in its chunk, then of the end
        first_state = np.concatenate(([0], ends[:-1])) + np.arange(len(chunks))
        state_chunk = np.repeat(np.arange(len(chunks)), lens + 1)
        place = end - first_state[state_chunk[end]]
        place = place.astype(np.uint16) if lens.max() < 1 << 16 else place  # short keys sort by radix
        by = np.argsort(place, kind="stable")
        alpha = np.zeros(len(c) + len(chunks))
        bounds = np.searchsorted(place[by], np.arange(1, lens.max() + 2))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            e = by[a:b]
            value = alpha[start[e]] + lp[e]
            to = end[e]
            seg = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
            top = np.maximum.reduceat(value, seg)
            size = np.diff(np.append(seg, len(e)))
            alpha[to[seg]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, size)), seg))
        last = np.concatenate((end[1:] != end[:-1], [True]))
        whole = 1 << DRAW_BITS
        weight = np.cumsum(np.rint(np.exp(np.minimum(alpha[start] + lp - alpha[end], 0.0)) * whole).astype(np.int64))
        base = np.concatenate(([0], weight[last][:-1]))
        keys = (end << DRAW_BITS) + np.minimum(weight - np.repeat(base, np.diff(np.concatenate(([0], np.flatnonzero(last) + 1)))), whole)
        keys[last] = (end[last] + 1) << DRAW_BITS
        return keys, start, piece, first_state + lens

    def chunks(self, text: str) -> list[str]:
        """What no piece crosses of a text, a space before it."""
        cs = self.find(" " + text)
        if max(map(len, cs)) > LONG_CHUNK:
            cs = [y for x in cs for y in (self.parts(x) if len(x) > LONG_CHUNK else (x,))]
        return cs

    def _block(self, keys_of: np.ndarray, first: np.ndarray, chunks: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids per row) of rows of chunks; first: the place of a row's first chunk in its text."""
        number: dict[str, int] = {}
        per, which = [], []
        for cs in chunks:
            per.append(len(cs))
            which += [number.setdefault(x, len(number)) for x in cs]
        which = np.array(which, np.int64)
        per = np.array(per, np.int64)
        row = np.repeat(np.arange(len(chunks)), per)
        place = np.arange(len(which)) - np.repeat(np.cumsum(per) - per - first, per)
        keys, start, piece, final = self.lattice(list(number))
        roots = final - np.fromiter(map(len, number), np.int64, len(number))
        with np.errstate(over="ignore"):
            noise = _mixed(_mixed(keys_of.astype(np.int64).view(_U) ^ _U(self.seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))[row] + place.astype(_U) * _U(0xD1B54A32D192ED03)
            live = np.argsort(which, kind="stable")  # equal chunks search close places
            state, root = final[which[live]], roots[which[live]]
            took, said, step = [], [], 0
            while len(live):
                u = (_mixed(noise[live] + _U(step) * _U(0x8CB92BA72F3D8DD7)) >> _U(64 - DRAW_BITS)).astype(np.int64)
                e = np.searchsorted(keys, (state << DRAW_BITS) | u, side="right")
                took.append(live)
                said.append(piece[e])
                state = start[e]
                stay = state > root
                live, state, root = live[stay], state[stay], root[stay]
                step += 1
        n = np.zeros(len(which), np.int64)
        for x in took:
            n[x] += 1
        at = np.cumsum(n)
        out = np.empty(at[-1], np.int64)
        for k, (x, p) in enumerate(zip(took, said, strict=True)):
            out[at[x] - 1 - k] = p
        n_row = np.add.reduceat(n, np.cumsum(per) - per)
        odd = np.flatnonzero(out < 0)
        if len(odd):
            spelt = [self.byte_ids[list(chr(-1 - x).encode())] for x in out[odd].tolist()]
            width = np.ones(len(out), np.int64)
            width[odd] = [len(x) for x in spelt]
            row_of = np.repeat(np.arange(len(chunks)), n_row)
            n_row = np.bincount(row_of, weights=width, minlength=len(chunks)).astype(np.int64)
            to = np.cumsum(width) - width
            wide = np.empty(width.sum(), np.int64)
            plain = out >= 0
            wide[to[plain]] = out[plain]
            wide[np.repeat(to[odd], width[odd]) + np.concatenate([np.arange(len(x)) for x in spelt])] = np.concatenate(spelt)
            out = wide
        return out, n_row

    def encode(self, keys: list[int | None], texts: list[str | None], verify: bool = True) -> list[np.ndarray]:
        """Sampled ids of each text."""
        found: dict[int, list[np.ndarray]] = {}
        held: list[tuple[int, int, list[str]]] = []  # text, place of its first chunk here, chunks

        def flush() -> None:
            if held:
                of = [NULL_KEY if keys[i] is None else keys[i] for i, _, _ in held]
                ids, n = self._block(np.array(of, np.int64), np.array([k for _, k, _ in held], np.int64), [cs for _, _, cs in held])
                for (i, _, _), x in zip(held, np.split(ids, np.cumsum(n)[:-1]), strict=True):
                    found.setdefault(i, []).append(x)
                held.clear()

        size = 0
        for i, t in enumerate(texts):
            if not t:
                continue
            cs, k = self.chunks(t), 0
            size += len(t) + 1
            if size >= BLOCK_CHARS:  # fill this block, and further ones with the rest of a very long text
                size -= len(t) + 1
                for j, x in enumerate(cs, 1):
                    size += len(x)
                    if size >= BLOCK_CHARS:
                        held.append((i, k, cs[k:j]))
                        flush()
                        k, size = j, 0
            if k < len(cs):
                held.append((i, k, cs[k:]))
        flush()
        out = [np.concatenate(found.pop(i)) if t else np.zeros(0, np.int64) for i, t in enumerate(texts)]
        for x, k, t in zip(out, keys, texts, strict=True) if verify else ():
            if self.decode(x) != (t or "") and t:
                raise ValueError(f"row key {k}: the pieces do not decode to the text")
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, without the space that stands before every text."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode()[1:]


def sampler(*args) -> Sampler:
    """One per Python worker."""
    return C.worker_cache(("spsample", *args), lambda: Sampler(*args))


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """docs with ids array<int>: a sampled segmentation of text, seeded by the row's key."""
    C.ship(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def encode(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        s = sampler(path, alpha, seed)
        for k, t in it:
            yield pd.Series([x.astype(np.int32) for x in s.encode([None if pd.isna(x) else int(x) for x in k], t.tolist())], dtype=object)

    return docs.withColumn("ids", encode(F.col(key).cast("long"), F.col("text").cast("string")))


def decode_pieces(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of its ids; null ids: the empty text."""
    C.ship(df.sparkSession)

    @F.pandas_udf("string")
    def decode(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = sampler(path)
        for x in it:
            yield pd.Series(["" if v is None else s.decode(np.asarray(v, np.int64)) for v in x])

    return df.withColumn(out, decode(F.col(ids)))


def _digests(path: str, alpha: float, seed: int):
    """Segment, decode and digest rows in one pass, so that ids need not travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler(path, alpha, seed)
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                texts = part.column(1).to_pylist()
                ids = s.encode(part.column(0).to_pylist(), texts, verify=False)
                same = [s.decode(x) == (t or "") if len(x) else not t for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array(same)], ["doc_id", "n_pieces", "ids_crc32", "lossless"])

    return run


def digest_documents(docs: DataFrame, path: str, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    C.ship(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(_digests(path, alpha, seed), "doc_id long, n_pieces long, ids_crc32 long, lossless boolean")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), lossless: whether they decode to the text."""
    return digest_documents(C.read(spark, sf_dir, "documents"), model_path())
