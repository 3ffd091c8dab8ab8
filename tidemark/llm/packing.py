"""Best-fit packing of token pieces into fixed-length sequences, after a dominance reduction.

1. `token_pieces`: each document's ids, an end id, cut into capacity-long pieces if longer, the first
   piece taking the remainder. Pretokens are looked up in a bounded cache of their ids, so that
   equal ones are encoded once.
2. The instance is its histogram of lengths: at most `capacity` counts, however many documents there
   are. `reduce_dominated` fixes, a length class at a time, sets that provably dominate every other
   set with their largest piece (Martello and Toth): a piece that nothing can join; a pair that fills the
   sequence; the largest partner, where no two or more remaining pieces together are longer than it.
   What is left is packed best-fit decreasing, again in whole classes of equal bins. Both give patterns
   with multiplicities, at most a few per length.
3. A piece of full length is a sequence by itself and is numbered where it is read, without a shuffle; most pieces
   of a corpus of long documents are such. Pieces of each other length are numbered by a window per (length, salt)
   plus the salts' offsets, with as many salts as the length's count asks for, so no window holds more than
   about SALT_ROWS rows. The number leads to pattern, sequence and offset.

Very long texts are encoded whole. Ties: pieces of equal length are interchangeable, and are taken in the order of
their ids.

Defined results. Null or empty text: the end id alone. Null doc_id: packed, its id stays null. Repeated
rows: packed each. Empty table: empty result. Other columns are not read. A text that holds the string
of a special token is encoded whole, as the tokenizer does by itself.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common as C

CAPACITY, END_ID = 1024, 2
TOKENIZER = "byte_bpe_50k.json"
#: Rows of a window group, on average, and cached pretokens per Python worker.
SALT_ROWS, CACHED = 1 << 17, 300_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The printable stand-ins of bytes in a byte-level vocabulary: printable Latin-1 bytes stand for
    themselves, the others, in order, for the characters from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Known(dict):
    """Ids of a pretoken, as little-endian unsigned 32-bit bytes; the tokenizer's model is asked once."""

    def __init__(self, model, most: int) -> None:
        super().__init__()
        self.tokenize, self.most, self.letters = model.tokenize, most, byte_letters()

    def __missing__(self, word: str) -> bytes:
        got = b"".join(x.id.to_bytes(4, "little") for x in self.tokenize(word.encode().decode("latin-1").translate(self.letters)))
        if len(self) >= self.most:  # the first ones are mostly the frequent ones
            first = list(islice(self.items(), self.most // 4))
            self.clear()
            self.update(first)
        self[word] = got
        return got


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    Texts are cut into pretokens, many at once, by the classes of their characters: runs of letters, of
    numbers or of other signs, each with one space before it, and white space but for its last character
    before such a run. Texts with an apostrophe (contractions) are cut by the tokenizer's own pattern."""

    def __init__(self, path: str, cached: int = CACHED) -> None:
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.findall = regex.compile(public_tokenizers.PATTERN).findall
        self.special = [x.content for x in self.t.get_added_tokens_decoder().values()]
        self.ids = Known(self.t.model, cached)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        self.kind = np.full(0x110000, 3, np.uint8)
        for k, pattern in enumerate((r"\s", r"\p{L}", r"\p{N}")):
            self.kind[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), "<u4")] = k

    def pretokens(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The pretokens of non-empty texts without apostrophes, and their number per text."""
        flat = "".join(texts)
        c = np.frombuffer(flat.encode("utf-32-le"), "<u4")
        kind = self.kind[c]
        space = kind == 0
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        start = np.empty(len(c), bool)
        # a sign after another kind of sign, or after white space that is not joined to it
        start[1:] = np.where(space[1:], ~space[:-1], np.where(space[:-1], c[:-1] != 32, kind[1:] != kind[:-1]))
        before_sign = np.zeros(len(c), bool)
        before_sign[:-1] = ~space[1:]
        before_sign[ends - 1] = False
        start |= space & before_sign
        start[np.concatenate(([0], ends[:-1]))] = True
        at = np.flatnonzero(start)
        cuts = at.tolist()
        return [flat[a:b] for a, b in zip(cuts, [*cuts[1:], len(flat)], strict=True)], np.diff(np.searchsorted(at, np.concatenate(([0], ends))))

    def encode(self, texts: list[str]) -> list[bytes]:
        out = [b""] * len(texts)
        get = self.ids.__getitem__
        plain = []
        for i, x in enumerate(texts):
            if any(s in x for s in self.special):
                out[i] = np.asarray(self.t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
            elif "'" in x:
                out[i] = b"".join(map(get, self.findall(x)))
            elif x:
                plain.append(i)
        if plain:
            words, n = self.pretokens([texts[i] for i in plain])
            ids = list(map(get, words))
            stop = np.cumsum(n).tolist()
            for i, a, b in zip(plain, [0, *stop], stop, strict=False):
                out[i] = b"".join(ids[a:b])
        return out


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first takes what capacity does not divide."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _piece_batches(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = C.worker_cache(("packing", path), lambda: Encoder(path))
        end = np.asarray([end_id], "<u4").tobytes()
        for part in C.slices(batches, 250):
            out = defaultdict(list)
            for doc, ids in zip(part.column(0).to_pylist(), enc.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                ids += end
                for p, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    piece = ids[4 * start : 4 * (start + n)]
                    for name, v in (("doc_id", doc), ("piece", p), ("start", start), ("length", n), ("ids_crc32", zlib.crc32(piece)), ("ids", piece)):
                        out[name].append(v)
            cols = {"doc_id": pa.array(out["doc_id"], pa.int64()), "piece": pa.array(out["piece"], pa.int32())} | {n: pa.array(out[n], pa.int64()) for n in ("start", "length", "ids_crc32")}
            if with_ids:
                flat = np.frombuffer(b"".join(out["ids"]), "<u4").astype(np.int32)
                cols["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(out["length"]))), pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_pydict(cols)

    return run


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids array<int>]) of docs(doc_id, text)."""
    C.ship(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(_piece_batches(path, capacity, end_id, with_ids), schema)


#: A pattern: ((length, pieces of it), ...) and the number of sequences filled so.
Pattern = tuple[tuple[tuple[int, int], ...], int]


def _two_or_more(sizes: list[int], capacity: int) -> int:
    """Bit set of the sums up to capacity of two or more pieces of these lengths, each as often as one likes."""
    keep = (1 << (capacity + 1)) - 1
    any_sum = 1
    for s in sizes:
        step = s
        while step <= capacity:
            any_sum |= any_sum << step & keep
            step *= 2
    out = 0
    for s in sizes:
        out |= (any_sum & ~1) << s & keep
    return out


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Patterns fixed by dominance, and the counts that remain."""
    left = {k: v for k, v in counts.items() if v}
    fixed: list[Pattern] = []

    def take(*sizes: int, n: int) -> None:
        fixed.append((tuple((s, sizes.count(s)) for s in dict.fromkeys(sizes)), n))
        for s in sizes:
            left[s] -= n
        for s in set(sizes):
            if not left[s]:
                del left[s]

    present, sums, changed = None, 0, True
    while changed:
        changed = False
        for size in sorted(left, reverse=True):
            while n := left.get(size, 0):
                room = capacity - size
                least = min((s for s in left if s != size or n > 1), default=None)
                if least is None or least > room:
                    take(size, n=n)
                    changed = True
                    break
                mate = room if left.get(room, 0) and (room != size or n > 1) else max(s for s in left if s <= room and (s != size or n > 1))
                if mate != room:
                    if present != left.keys():
                        present, sums = set(left), _two_or_more(sorted(left), capacity)
                    best = (sums & ((1 << (room + 1)) - 1)).bit_length() - 1
                    if best > mate:
                        break
                take(size, mate, n=n // 2 if mate == size else min(n, left[mate]))
                changed = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing, a class of equal pieces into a class of equal bins at a time."""
    bins: dict[int, list[list]] = defaultdict(list)  # room: [pattern, number of bins]
    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        n = counts[size]
        while n:
            room = min((r for r in bins if r >= size and bins[r]), default=None)
            pattern, m = bins[room].pop() if room is not None else ((), None)
            k = min((capacity if room is None else room) // size, n)
            full = n // k if m is None else min(m, n // k)
            if m is not None and m > full:
                bins[room].append([pattern, m - full])
            bins[(capacity if room is None else room) - k * size].append([(*pattern, (size, k)), full])
            n -= full * k
    return [(tuple(p), m) for groups in bins.values() for p, m in groups]


def solve(counts: dict[int, int], capacity: int) -> list[Pattern]:
    fixed, left = reduce_dominated(counts, capacity)
    return fixed + best_fit(left, capacity)


def slots(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """One row per (pattern, length), sorted by length and first rank: the ranks of that length that the
    pattern takes, how many each sequence takes, the first sequence id and the offset of the first."""
    rows, taken, seq = [], defaultdict(int), 0
    for pattern, m in patterns:
        at = 0
        for size, k in pattern:
            rows.append((size, taken[size], k, seq, at))
            taken[size] += k * m
            at += size * k
        seq += m
    cols = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "each", "seq", "at"), cols, strict=True))


def _placer(table: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = 48
        keys = (table["length"] << shift) | table["first"]
        for b in batches:
            size, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(keys, (size << shift) | rank, side="right") - 1
            q, j = np.divmod(rank - table["first"][i], table["each"][i])
            b = b.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(table["seq"][i] + q), pa.array(table["at"][i] + j * size)], [*b.schema.names, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, salt_rows: int = SALT_ROWS) -> DataFrame:
    """pieces with sequence_id and offset. pieces must be a table that reads the same each time."""
    n_of = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    n_full = n_of.pop(capacity, 0)
    patterns = solve(n_of, capacity)
    table, n_other = slots(patterns), sum(m for _, m in patterns)
    # full pieces: any numbers after the others', by partition and place in it
    full = pieces.where(F.col("length") == capacity)
    full = full.withColumns({"sequence_id": F.monotonically_increasing_id() + n_other, "offset": F.lit(0).cast("long")})
    if not n_of:
        return full
    w = ["length", "salt"]
    salts = np.ones(capacity, np.int64)
    for size, n in n_of.items():
        salts[size] = -(-n // salt_rows)
    p = pieces.where(F.col("length") < capacity)
    if salts.max() == 1:
        p, before = p.withColumn("salt", F.lit(0)), {}
    else:
        wide = F.element_at(F.lit(salts[1:].tolist()), F.col("length").cast("int"))
        p = p.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), wide).cast("int"))
        before, seen = {}, defaultdict(int)
        for size, salt, n in sorted(tuple(r) for r in p.groupBy(*w).count().collect()):  # a row per salt_rows pieces, or length
            before[size, salt] = seen[size]
            seen[size] += n
    order = Window.partitionBy(*w).orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = p.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    place = _placer(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def based() -> Iterator[pa.RecordBatch]:
            for b in batches:
                rank = b.column("rank").to_numpy()
                if before:
                    key = zip(b.column("length").to_pylist(), b.column("salt").to_pylist(), strict=True)
                    rank = rank + np.fromiter((before[k] for k in key), np.int64, b.num_rows)
                b = b.drop_columns(["rank", "salt"])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rank, pa.int64())], [*b.schema.names, "rank"])

        yield from place(based())

    schema = pieces.schema.simpleString()[len("struct<") : -1]
    placed = ranked.mapInArrow(run, f"{schema},sequence_id:bigint,offset:bigint")
    return placed.unionByName(full) if n_full else placed


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces of every document with sequence_id and offset (and their ids); written once, then placed."""
    where = C.workspace(docs.sparkSession, "packing")
    return pack(C.materialize(token_pieces(docs, path, capacity, end_id, with_ids), f"{where}/pieces"), capacity)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(C.read(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
