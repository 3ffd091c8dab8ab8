"""Embedding near-dedup: a subspace pigeonhole join.

Unit vectors with cosine >= t are within squared distance 2 - 2t. A seeded rotation spreads that
distance over the coordinates, which are split into blocks of BLOCK_DIM; in one block at least, two
such vectors are within the block's share of the budget, (2 - 2t) * dims / D. So each block is a range
join: vectors are put into grid cells (of two radii) of the block's first `grid` coordinates
and into the later neighbour cells that their ball reaches. Within a cell candidates are the pairs whose block
distance is within the budget, a product of low-dimensional matrices. A pair is verified, by the exact
cosine of the vectors as given, in the first block that finds it, so the union counts it once.

A finer grid compares fewer pairs and sends a vector to more cells; without any, a label is one cell for
all its blocks and a vector is sent there once. `best_grid` takes the cheapest by one rule at every size, from the
number of vectors per label and the copies and collisions that each grid has on a bounded sample
(GRID_SAMPLE vectors); it decides only where pairs meet, never which.

Links are counted where they are found, and each unit gives a spanning forest, so nothing is as large
as the pairs of a group. Equal vectors of a label are one class before the join. Cells of many vectors
are dealt tile by tile.

Very long vectors: a block more for every BLOCK_DIM dimensions. Ties at the threshold: a cosine equal to it links.

Defined results. A null label, and a vector that is null, empty, zero or holds null or non-finite
components: no links, own component. Vectors of different lengths never link. Null vec_id: no links, null
component, not kept. Rows that repeat a vec_id count as vectors of their own and share its component.
Empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common as C

COSINE, BLOCK_DIM, SEED = 0.93, 8, 20240229
#: Vectors of a cell in one tile, rows of a distance matrix, and candidates verified at once.
TILE_ROWS, STRIP, VERIFY = 16384, 256, 1 << 14
SLACK = 1e-9
#: Vectors that the grid is chosen on, and compared pairs that cost as much as sending a vector once.
GRID_SAMPLE, SEND_COST = 20_000, 4000
#: The block of a cell that stands for all blocks.
EVERY = -1
KEYS = ["label", "dim", "block", "cell"]

_rotations: dict[int, np.ndarray] = {}


def rotation(dim: int) -> np.ndarray:
    if dim not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((dim, dim)))
        _rotations[dim] = np.ascontiguousarray(q * np.sign(np.diag(r)))
    return _rotations[dim]


def blocks_of(dim: int) -> np.ndarray:
    """The bounds of the blocks."""
    return np.append(np.arange(0, dim, BLOCK_DIM), dim)


def budgets(dim: int, cosine: float) -> np.ndarray:
    """Squared distance that each block may have."""
    return (2 - 2 * cosine) * np.diff(blocks_of(dim)) / dim * (1 + SLACK) + SLACK


def rotated(x: np.ndarray) -> np.ndarray:
    """Unit vectors in the rotated space. einsum sums in one order for every row, whatever else is in x, so a
    vector has the same coordinates in every unit."""
    unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.einsum("ij,kj->ik", unit, rotation(x.shape[1]))


def finest_grid(dim: int, cosine: float) -> int:
    """Coordinates of a block whose cells' numbers fit into a long together."""
    bits = int(np.ceil(np.log2(2 / (2 * np.sqrt(budgets(dim, cosine).min())) + 6)))
    return min(BLOCK_DIM, dim, 62 // bits)


def best_grid(sample: np.ndarray, labels: list[tuple[float, int]], cosine: float, tile_rows: int = TILE_ROWS) -> int:
    """The number of coordinates to cut at which sending and comparing cost least. sample: vectors in the rotated space;
    labels: (vectors, how many labels have about as many)."""
    if not len(sample):
        return 0
    blocks, best = len(budgets(sample.shape[1], cosine)), (np.inf, 0)
    for g in range(finest_grid(sample.shape[1], cosine) + 1):
        copies, share = 1.0, 1.0  # of a vector, and of its label's vectors in its cell
        if g:
            homes, guests = np.zeros(blocks), 0
            for k, rows, cells, guest in _cells(sample, cosine, g):
                if guest:
                    guests += len(rows)
                else:
                    homes[k] = (np.unique(cells, return_counts=True)[1].astype(float) ** 2).sum() / len(sample) ** 2
            copies, share = blocks + guests / len(sample), homes.mean()
        # a vector goes to each pair of its cell's tiles, and meets half the vectors at home there and the guests
        reach = 0.5 if g == 0 else copies / blocks - 0.5
        cost = sum(m * n * (SEND_COST * copies * max(1.0, n * share / tile_rows) + blocks * reach * n * share) for n, m in labels)
        best = min(best, (cost, g))
    return best[1]


def _cells(x: np.ndarray, cosine: float, grid: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(block, rows, cells, guest) of unit vectors in the rotated space; without a grid all are in one cell of EVERY block. Each at home in its cell, and a guest in every later
    cell (the first coordinate that differs is greater) within the block's radius. Offsets are grown a coordinate at a
    time and end where the distance to the cell is over the radius."""
    if grid == 0:
        yield EVERY, np.arange(len(x)), np.zeros(len(x), np.int64), False
        return
    bounds, most = blocks_of(x.shape[1]), budgets(x.shape[1], cosine)
    for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        g = min(grid, hi - lo)
        r, y = np.sqrt(most[k]), x[:, lo : lo + g]
        c = np.floor(y / (2 * r)).astype(np.int64)
        half = 1 << (62 // g - 1)
        rows, cell, gap, moved = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x)), np.zeros(len(x), bool)
        for d in range(g):
            at, v = c[rows, d], y[rows, d]
            grown = []
            for step in (-1, 0, 1):
                more = gap + (0 if step == 0 else (((at + 1) * 2 * r - v) if step > 0 else (v - at * 2 * r)) ** 2)
                ok = (more <= most[k] * (1 + SLACK)) & (moved | (step >= 0))
                grown.append((rows[ok], cell[ok] * (2 * half) + (at[ok] + step + half), more[ok], moved[ok] | (step != 0)))
            rows, cell, gap, moved = (np.concatenate(z) for z in zip(*grown, strict=True))
        for guest in (False, True):
            yield k, rows[moved == guest], cell[moved == guest], guest


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, offsets) of a list column."""
    off = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False), off


def _spread(cosine: float, grid: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, off = _matrix(b.column("embedding"))
            dims = np.diff(off)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = flat[off[at][:, None] + np.arange(d)].astype(np.float64)
                rot = rotated(x / np.abs(x).max(axis=1, keepdims=True))
                for block, at_rows, cell, guest in _cells(rot, cosine, min(grid, finest_grid(int(d), cosine))):
                    if len(at_rows):
                        part = b.take(pa.array(at[at_rows]))
                        n = len(at_rows)
                        yield pa.RecordBatch.from_pydict({"label": part.column("label"), "dim": pa.array(np.full(n, d, np.int32)), "block": pa.array(np.full(n, block, np.int32)), "cell": pa.array(cell), "guest": pa.array(np.full(n, guest)), "rep": part.column("rep"), "copies": part.column("copies"), "embedding": part.column("embedding")})

    return run


class Unit:
    """The vectors of one unit and the links found among them."""

    def __init__(self, x: np.ndarray, copies: np.ndarray, block: int, cosine: float) -> None:
        self.x = x / np.abs(x).max(axis=1, keepdims=True)
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.x, self.x))
        self.rot, self.copies, self.cosine = rotated(self.x), copies, cosine
        self.bounds, self.most = blocks_of(x.shape[1]), budgets(x.shape[1], cosine)
        self.blocks = range(len(self.most)) if block == EVERY else [block]
        self.links, self.forest = np.zeros(len(x), np.int64), C.Forest(len(x))

    def meet(self, a: np.ndarray, b: np.ndarray, same: bool = False) -> None:
        """Compare rows a with rows b; same: a is b, each pair once."""
        if not len(a) or not len(b):
            return
        for block in self.blocks:
            lo, hi = self.bounds[block : block + 2]
            left, right = self.rot[a, lo:hi], self.rot[b, lo:hi]
            sq = np.einsum("ij,ij->i", right, right)
            for k in range(0, len(a), STRIP):
                p = left[k : k + STRIP]
                first = k if same else 0
                dist = p @ right[first:].T
                dist *= -2
                dist += sq[first:]
                i, j = np.nonzero(dist <= (self.most[block] + SLACK - np.einsum("ij,ij->i", p, p))[:, None])
                if same:
                    i, j = i[j > i], j[j > i]
                for v in range(0, len(i), VERIFY):
                    self.verify(block, a[k + i[v : v + VERIFY]], b[first + j[v : v + VERIFY]])

    def verify(self, block: int, i: np.ndarray, j: np.ndarray) -> None:
        part = np.add.reduceat((self.rot[i] - self.rot[j]) ** 2, self.bounds[:-1], axis=1)
        within = part <= self.most
        mine = within[:, block] & ~within[:, :block].any(axis=1)
        i, j = i[mine], j[mine]
        cos = np.einsum("ij,ij->i", self.x[i], self.x[j]) / (self.norm[i] * self.norm[j])
        i, j = i[cos >= self.cosine], j[cos >= self.cosine]
        np.add.at(self.links, i, self.copies[j])
        np.add.at(self.links, j, self.copies[i])
        self.forest.link(i, j)


def _join(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = [*KEYS, "ti", "tj"]
        for t in C.whole_groups(batches, keys, 4096):
            b = t.to_batches()[0]
            flat, off = _matrix(b.column("embedding"))
            starts = C.group_starts(t, keys)
            guest, tile, rep, copies = (t.column(c).to_numpy(zero_copy_only=False) for c in ("guest", "tile", "rep", "copies"))
            got = []
            for s, e in zip(starts, np.append(starts[1:], t.num_rows), strict=True):
                if e - s < 2:
                    continue
                u = Unit(flat[off[s] : off[e]].reshape(e - s, -1).astype(np.float64), copies[s:e], b.column("block")[s].as_py(), cosine)
                home, i_tile = ~guest[s:e], tile[s:e] == b.column("ti")[s].as_py()
                if b.column("ti")[s] == b.column("tj")[s]:
                    h = np.flatnonzero(home)
                    u.meet(h, h, same=True)
                    u.meet(h, np.flatnonzero(~home))
                else:
                    for x, y in ((home & i_tile, home & ~i_tile), (home & i_tile, ~home & ~i_tile), (home & ~i_tile, ~home & i_tile)):
                        u.meet(np.flatnonzero(x), np.flatnonzero(y))
                linked = np.flatnonzero(u.links)
                got.append((rep[s:e][linked], u.links[linked], rep[s:e][u.forest.label[linked]]))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*got, strict=True)], ["rep", "links", "root"])

    return run


def chosen_grid(reps: DataFrame, cosine: float, tile_rows: int) -> int:
    """best_grid of reps(label, rep, embedding)."""
    level = F.floor(F.log2("count") * 4)
    labels = [(r["n"], r["m"]) for r in reps.groupBy("label").count().groupBy(level).agg(F.avg("count").alias("n"), F.count("*").alias("m")).collect()]  # 4 rows a power of two
    n = sum(x * m for x, m in labels)
    if not n:
        return 0
    space = 1 << 40
    few = reps.where(F.pmod(F.xxhash64("rep"), F.lit(space)) < int(space * min(1.0, GRID_SAMPLE / n)))
    dim = few.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dim is None:
        return 0
    got = few.where(F.size("embedding") == dim["d"]).limit(2 * GRID_SAMPLE).select("embedding").toArrow().column(0).combine_chunks()
    x = got.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(got), -1)
    return best_grid(rotated(x / np.abs(x).max(axis=1, keepdims=True)), labels, cosine, tile_rows)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, tile_rows: int = TILE_ROWS, grid: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of vectors(vec_id, embedding, label). grid: coordinates of a block that
    are cut, or as best_grid says."""
    spark = vectors.sparkSession
    path = C.workspace(spark, "embdedup")
    kind = vectors.schema["embedding"].dataType
    kind = kind if kind in (T.ArrayType(T.FloatType()), T.ArrayType(T.FloatType(), False)) else T.ArrayType(T.DoubleType())
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), F.col("label").cast("long").alias("label"))
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    v = v.withColumn("ok", F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fit, F.lit(False)))
    v = v.withColumns({"h1": F.when(F.col("ok"), F.xxhash64("embedding")), "h2": F.when(F.col("ok"), F.xxhash64(F.lit(1), "embedding"))})
    same = ["label", "h1", "h2"]
    reps = C.materialize(v.where("ok").groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")), f"{path}/reps")
    cells = reps.select("label", "rep", "copies", "embedding").mapInArrow(_spread(cosine, chosen_grid(reps, cosine, tile_rows) if grid is None else grid), f"label long, dim int, block int, cell long, guest boolean, rep long, copies long, embedding {kind.simpleString()}")
    units = C.tiled(cells, KEYS, "rep", tile_rows, f"{path}/big")
    keys = [*KEYS, "ti", "tj"]
    found = units.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_join(cosine), "rep long, links long, root long")
    found = C.materialize(found, f"{path}/found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = C.connected_components(found.select(F.col("root").alias("src"), F.col("rep").alias("dst")), f"{path}/components")
    comp = comp.select(F.col("node").alias("rep"), "component")
    named = reps.select(*same, "rep", "copies").join(links, "rep", "left").join(comp, "rep", "left")
    named = C.materialize(named.select(*same, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component")), f"{path}/named")
    out = v.select("vec_id", *same).join(named, same, "left")
    comp_id = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), comp_id.alias("component_id"), F.coalesce(F.col("vec_id") == comp_id, F.lit(False)).alias("kept"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.read(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
n AS (SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
k AS (SELECT a AS vec_id, count(*)::BIGINT AS n_links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN c USING (vec_id) LEFT JOIN k USING (vec_id)
"""
