"""SimHash near-duplicates by bit-sliced comparison.

`fingerprints` gives every row the 64-bit SimHash of its 3-word shingles; `near_duplicates` links
fingerprints that differ in at most `radius` bits and gives every row its component.

Candidates meet by pigeonhole: the 64 bits are cut into radius + 2 blocks, and two fingerprints
within the radius agree on at least two of them, so each pair of blocks is a bucket key. Rows of a
task are sorted by bucket and stored as 64 vertical bit planes, packed over rows. The rows at
distance s in that order are compared all at once: plane XOR shifted plane, added into carry-save
counters; words of 64 comparisons in which each lane is over the radius, or in another bucket, are
abandoned. Equal fingerprints are one class before that, so copies are never compared.

Very long texts are hashed whole, in parts. Ties: a bit set in exactly half the shingles is 0.

Defined results. Null text: as empty. No words: fingerprint zero, linked like any other. Null
doc_id: ordered after every id; a component of such rows only has a null component_id. Repeated
rows: same fingerprint, same component. Empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C

SEED, WIDTH, RADIUS = 42, 3, 3
#: Distinct fingerprints of one bucket in one tile; larger buckets are met tile by tile.
TILE_ROWS = 16_384


def simhash(words: list[bytes], width: int = WIDTH) -> int:
    """A bit is 1 if set in over half of the shingles' XXH64."""
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(flat[a:b], SEED) for a, b in zip(starts, ends[len(words) - n :].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 65_536):  # a very long text needs no large matrix
        ones += np.unpackbits(h[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    C.worker_cache("simhash")
    for b in C.slices(batches):
        fp = np.array([simhash((t or "").encode().lower().split()) for t in b.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
        b = b.drop_columns(["text"])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp, pa.int64())], [*b.schema.names, "fp"])


def fingerprints(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried long columns, fp): the fingerprint's 64 bits as a signed long."""
    C.ship(docs.sparkSession)
    kept = [F.col(c).cast("long").alias(c) for c in ("doc_id", *carry)]
    schema = ", ".join(f"`{c}` long" for c in ("doc_id", *carry, "fp"))
    return docs.select(*kept, F.col("text").cast("string").alias("text")).mapInArrow(_hash_batches, schema)


def block_masks(radius: int) -> list[int]:
    """Masks of every pair of blocks; two values within the radius agree under one of them."""
    edges = [64 * k // (radius + 2) for k in range(radius + 3)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [a | b for a, b in combinations(blocks, 2)]


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(64, words) bit planes: bit i of plane p is bit p of fps[i]."""
    n = -(-len(fps) // 64) * 64
    bits = np.zeros((n, 64), np.uint8)
    bits[: len(fps)] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _later(words: np.ndarray, at: np.ndarray, s: int) -> np.ndarray:
    """The words `at` of a bit string shifted so that lane i holds lane i + s; zeros beyond the end."""
    q, r = divmod(s, 64)
    n = len(words)
    low = np.where(at + q < n, words[np.minimum(at + q, n - 1)], np.uint64(0))
    if not r:
        return low
    high = np.where(at + q + 1 < n, words[np.minimum(at + q + 1, n - 1)], np.uint64(0))
    return (low >> np.uint64(r)) | (high << np.uint64(64 - r))


def sliced_pairs(fps: np.ndarray, last: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j <= last[i], of fingerprints within the radius. last[i]: the final
    row of i's bucket. All pairs at one shift are counted together in carry-save counters, whose
    number is the radius's bit length and an overflow plane."""
    planes = planes_of(fps)
    idx = np.arange(len(fps))
    depth = int(radius).bit_length()
    for s in range(1, int((last - idx).max(initial=0)) + 1):
        lanes = np.zeros(planes.shape[1] * 64, np.uint8)
        lanes[: len(fps)] = idx + s <= last
        live = np.packbits(lanes, bitorder="little").view("<u8")
        at = np.flatnonzero(live)
        live = live[at]
        count = [np.zeros(len(at), np.uint64) for _ in range(depth)]
        over = np.zeros(len(at), np.uint64)
        for p in range(64):
            carry = planes[p][at] ^ _later(planes[p], at, s)
            for k in range(depth):
                count[k], carry = count[k] ^ carry, count[k] & carry
            over |= carry
            if p % 8 == 7:
                stay = (live & ~over) != 0
                if not stay.all():
                    at, live, over = at[stay], live[stay], over[stay]
                    count = [c[stay] for c in count]
                if not len(at):
                    break
        if not len(at):
            continue
        hit = live & ~over & ~_above(count, radius)
        bits = np.unpackbits(hit.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        w, lane = np.nonzero(bits)
        i = at[w] * 64 + lane
        yield i, i + s


def _above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is over the radius."""
    more, same = np.zeros_like(count[0]), ~np.zeros_like(count[0])
    for k in reversed(range(len(count))):
        if radius >> k & 1:
            same &= count[k]
        else:
            more |= same & count[k]
            same &= ~count[k]
    return more


def linker(radius: int):
    """Arrow batches of units sorted by (mask_no, bucket, ti, tj, fp) to spanning stars of the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["mask_no", "bucket", "ti", "tj"]
        for t in C.whole_groups(batches, keys):
            starts = C.group_starts(t, keys)
            fps = t.column("fp").to_numpy().view(np.uint64)
            size = np.diff(np.append(starts, len(fps)))
            shared = np.repeat(size > 1, size)
            fps, size = fps[shared], size[size > 1]
            if not len(fps):
                continue
            last = np.repeat(np.cumsum(size) - 1, size)
            forest = C.Forest(len(fps))
            for i, j in sliced_pairs(fps, last, radius):
                forest.link(i, j)
            i, j = forest.edges()
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(fps[x].view(np.int64)) for x in (i, j)], ["src", "dst"])

    return run


def link_classes(classes: DataFrame, path: str, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Spanning edges (src, dst) of the links between the distinct values of classes.fp."""
    if radius == 0:
        return classes.select(F.col("fp").alias("src"), F.col("fp").alias("dst")).limit(0)
    signed = [m - (1 << 64) if m >> 63 else m for m in block_masks(radius)]
    rows = classes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("mask_no", "bucket"))
    # a bucket of one value has no pair; most are such, and a count per bucket is cheaper than their tiles
    units = C.tiled(rows, ["mask_no", "bucket"], "fp", tile_rows, f"{path}/big")
    keys = ["mask_no", "bucket", "ti", "tj"]
    dealt = units.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys, "fp")
    return dealt.mapInArrow(linker(radius), "src long, dst long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried long columns, fp, component_id) per row of docs(doc_id, text)."""
    spark: SparkSession = docs.sparkSession
    path = C.workspace(spark, "simhash")
    rows = C.materialize(fingerprints(docs, carry), f"{path}/rows")
    classes = C.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), f"{path}/classes")
    comp = C.connected_components(link_classes(classes, path, radius, tile_rows), f"{path}/components")
    comp = C.materialize(comp, f"{path}/membership")
    merged = classes.join(comp, classes.fp == comp.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("comp"))
    low = merged.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = C.materialize(merged.select("fp", "comp").join(low, "comp").select("fp", "component_id"), f"{path}/named")
    return rows.join(named, "fp").select("doc_id", *carry, "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs that stand for their group: the one with the smallest doc_id (null: last), then the
    smallest hash of its text; of rows equal in both, one."""
    key = {"__did": F.coalesce(F.col("doc_id").cast("long"), F.lit(C.LAST_ID)), "__hash": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))}
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "doc_id", "text").withColumns(key)
    found = near_duplicates(rows.select("doc_id", "text", *key), radius, carry=("__did", "__hash"))
    # a component without any id is named by nothing: each of its fingerprints is grouped by itself
    group = F.coalesce(F.col("component_id"), F.lit(C.LAST_ID)), F.when(F.col("component_id").isNull(), F.col("fp"))
    best = found.groupBy(group[0].alias("g"), group[1].alias("f")).agg(F.min(F.struct("__did", "__hash")).alias("b")).select("b.*").distinct()
    return rows.join(best, list(key), "left_semi").groupBy(*key).agg(F.first("__row").alias("__row")).select("__row.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(C.read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
