"""Exact cosine search and deterministic embedders.

vectors: (ordinal, values array). queries: (query_id, values array). Scores are max(0, q . v / sqrt(|q|^2 |v|^2)),
0 for a zero norm; every sum runs in dimension order, so a score is the same bits wherever it is computed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries per block: each block is one pass over the vectors with one broadcast matrix.
QUERY_BLOCK, SLACK = 2048, 1e-6
#: Queries of one matrix product, and pairs scored at once.
STRIP, PAIRS = 128, 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def similarity(dot_: Column, q_norm: Column, v_norm: Column) -> Column:
    """Of a dot product and squared norms."""
    s = dot_ / F.sqrt(q_norm * v_norm)
    return F.when((q_norm == 0) | (v_norm == 0), 0.0).when((s > 0) & (s < float("inf")), s).otherwise(0.0)


def checked_vectors(vectors: DataFrame, dimensions: int) -> DataFrame:
    """vectors that may be searched, with sq_norm; a row of another length or with a non-finite value fails the job."""
    ok = (F.size("values") == dimensions) & F.forall("values", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    checked = F.when(F.assert_true(F.coalesce(ok, F.lit(False)), F.lit("vectors must be finite and of the declared dimension")).isNull(), F.col("values"))
    return vectors.withColumn("values", checked).withColumn("sq_norm", dot(F.col("values"), F.col("values")))


def in_order(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Dot products of paired rows, summed in dimension order."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * v[:, d]
    return out


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The rows of a list column as one matrix, without a copy where Arrow allows it."""
    flat = column.flatten()
    if len(flat) != len(column) * dims or column.null_count or flat.null_count:
        raise ValueError("vectors must be finite and of the queries' dimension")
    v = flat.to_numpy(zero_copy_only=False).reshape(-1, dims)
    if (column.value_lengths().to_numpy() != dims).any() or not np.isfinite(v).all():
        raise ValueError("vectors must be finite and of the queries' dimension")
    return v


def _top(qs: np.ndarray, ids: np.ndarray, limit: int):
    q_norm = in_order(qs, qs)
    unit = qs / np.sqrt(np.where(q_norm == 0, 1, q_norm))[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v, ordinal = _matrix(b.column("values"), qs.shape[1]), b.column("ordinal").to_numpy()
            v_norm = in_order(v, v)
            k = min(limit, len(v))
            for lo in range(0, len(qs), STRIP):
                # a product of matrices finds what can be among the best, sums in order score it
                rough = np.maximum(unit[lo : lo + STRIP] @ v.T / np.sqrt(np.where(v_norm == 0, 1, v_norm)), 0)
                edge = np.partition(rough, len(v) - k, axis=1)[:, len(v) - k]
                i, j = np.nonzero(rough >= edge[:, None] - SLACK)
                for s in range(0, len(i), PAIRS):
                    a, c = lo + i[s : s + PAIRS], j[s : s + PAIRS]
                    with np.errstate(all="ignore"):
                        score = in_order(qs[a], v[c]) / np.sqrt(q_norm[a] * v_norm[c])
                    score = np.where((score > 0) & np.isfinite(score), score, 0.0)
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(ids[a], pa.int64()), "ordinal": pa.array(ordinal[c], pa.int64()), "score": pa.array(score)})

    return run


def search(vectors: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, rank from 1, ordinal, score): the `limit` most similar vectors of each query, ties by ordinal. The
    queries are taken in blocks of QUERY_BLOCK, whose size is the bound of what is broadcast."""
    spark = vectors.sparkSession
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "ordinal")
    out = None
    block: list = []

    def one(block: list) -> DataFrame:
        qs, ids = np.array([r["values"] for r in block], dtype=np.float64), np.array([r["query_id"] for r in block])
        found = vectors.select(F.col("ordinal").cast("long").alias("ordinal"), F.col("values").cast("array<double>").alias("values")).mapInArrow(_top(qs, ids, limit), "query_id long, ordinal long, score double")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)

    for r in queries.select("query_id", "values").toLocalIterator():
        block.append(r)
        if len(block) == QUERY_BLOCK:
            out = one(block) if out is None else out.unionByName(one(block))
            block = []
    if block and limit > 0:
        out = one(block) if out is None else out.unionByName(one(block))
    return out if out is not None else spark.createDataFrame([], "query_id long, ordinal long, score double, rank int")


HASH_DIMS = 64


def hash_counts(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, bucket, n): tokens of a text by the first byte of their SHA-256. A key's tokens are read in one place, so
    they are counted before the shuffle."""
    t = df.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z_$][\w$]*"), F.lit(0))).alias("token"))
    bucket = (F.conv(F.substring(F.sha2(F.col("token").cast("binary"), 256), 1, 2), 16, 10).cast("int") % HASH_DIMS).alias("bucket")
    return t.select(key, bucket).groupBy(key, "bucket").agg(F.count("*").alias("n"))


def hash_embed(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, values): the counts of hash_counts as a unit vector, at most HASH_DIMS numbers gathered per key; all zero
    for a text without tokens."""
    n = hash_counts(df, key, text).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.col("n").cast("double")))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n").cast("double"))).alias("norm"))
    dims = F.array(*[F.coalesce(F.try_element_at("m", F.lit(k)) / F.col("norm"), F.lit(0.0)) for k in range(HASH_DIMS)])
    return df.select(key).join(n, key, "left").select(key, dims.alias("values"))


def feature_embed(text: Column) -> Column:
    """Five indicator features as a unit vector (fixed patterns)."""
    t = F.lower(text)
    patterns = ("(auth|permission|admin|security|allowed)", "(retry|attempt|maxretries)", "(profile|null|undefined)", "(amount|number|nan|limit)", "(input|assertion)")
    v = [F.when(F.rlike(t, F.lit(p)), 1.0).otherwise(0.0) for p in patterns]
    total = v[0]
    for x in v[1:]:
        total = total + x
    norm = F.when(total == 0, 1.0).otherwise(F.sqrt(total))
    return F.array(*[x / norm for x in v])
