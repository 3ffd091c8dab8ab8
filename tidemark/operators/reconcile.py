"""Incremental maintenance of a versioned index: what changed, which chunks and vectors are used again, and checks.

indexed: (path, content_hash, size, blob_id, mtime_ms, chunk_ids); scan: the same without chunk_ids, content_hash null
until read. vectors: (cache_key, input_hash, provider, model, version, dimension_identity, dimensions, values)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = ["provider", "model", "version", "dimension_identity"]
RACY_MS = 2000


def same_identity() -> Column:
    """Of p and c joined: provably the same bytes without reading them."""
    eq = lambda x: F.coalesce(F.col(f"p.{x}") == F.col(f"c.{x}"), F.lit(False))
    return eq("blob_id") | (eq("mtime_ms") & eq("size"))


def usable_mtime(mtime: Column, now_ms: Column) -> Column:
    """A time too recent to prove anything is not kept."""
    return F.when(mtime < now_ms - RACY_MS, mtime)


def reconcile(indexed: DataFrame, scan: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """(path, status, needs_read): unchanged, modified, added or deleted. A file is unchanged only if all its chunks are
    there (chunks: (id)). One full outer join on the path."""
    p = indexed
    if chunks is not None:
        ids = indexed.select("path", F.explode("chunk_ids").alias("id"))
        lost = ids.join(chunks.select("id"), "id", "left_anti").select("path").distinct().withColumn("lost", F.lit(True))
        p = p.join(lost, "path", "left")
    else:
        p = p.withColumn("lost", F.lit(None).cast("boolean"))
    j = p.alias("p").join(scan.dropDuplicates(["path"]).alias("c"), F.col("p.path") == F.col("c.path"), "full")
    whole = ~F.coalesce(F.col("p.lost"), F.lit(False))
    proved = same_identity() & whole
    equal = F.coalesce(F.col("p.content_hash") == F.col("c.content_hash"), F.lit(False)) & whole
    status = F.when(F.col("c.path").isNull(), "deleted").when(F.col("p.path").isNull(), "added").when(proved | equal, "unchanged").otherwise("modified")
    return j.select(F.coalesce("p.path", "c.path").alias("path"), status.alias("status"), (F.col("c.path").isNotNull() & ~F.coalesce(proved, F.lit(False))).alias("needs_read"))


def counts(reconciled: DataFrame) -> DataFrame:
    """One row of the update's counters."""
    n = lambda s: F.count_if(F.col("status") == s).alias(f"files_{s}")
    return reconciled.agg(*[n(s) for s in ("unchanged", "modified", "added", "deleted")], F.count_if("needs_read").alias("files_read"))


def first_vectors(vectors: DataFrame, order: str = "ord") -> DataFrame:
    """One vector per cache key, the first in order."""
    w = Window.partitionBy("cache_key").orderBy(order)
    return vectors.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def sound_vectors(vectors: DataFrame) -> DataFrame:
    ok = (F.col("dimensions") > 0) & (F.size("values") == F.col("dimensions")) & F.forall("values", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(ok, F.lit(False)))


def resolve(wanted: DataFrame, previous: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """(input_hash, origin): previous, checkpoint or embed, for each distinct wanted(input_hash); previous and checkpoint
    are of the active space."""
    w = wanted.select("input_hash").distinct()
    p, c = previous.select("input_hash").distinct(), checkpoint.select("input_hash").distinct()
    left = w.join(p, "input_hash", "left_anti")
    have = w.join(p, "input_hash", "left_semi").withColumn("origin", F.lit("previous"))
    saved = left.join(c, "input_hash", "left_semi").withColumn("origin", F.lit("checkpoint"))
    return have.unionByName(saved).unionByName(left.join(c, "input_hash", "left_anti").withColumn("origin", F.lit("embed")))


def pruned(previous: DataFrame, wanted: DataFrame) -> DataFrame:
    """Previous vectors that no chunk needs any more."""
    return previous.join(wanted.select("input_hash").distinct(), "input_hash", "left_anti")


def chunk_vectors(chunks: DataFrame, vectors: DataFrame, space: dict) -> DataFrame:
    """(ordinal, values) of the chunks that have a vector in one space: the first stored for their input."""
    v = vectors
    for k in SPACE:
        v = v.where(F.col(k) == space[k])
    w = Window.partitionBy("input_hash").orderBy("ord")
    v = v.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("input_hash", "values")
    return chunks.select("ordinal", "input_hash").join(v, "input_hash").select("ordinal", "values")


def batches(pending: DataFrame, size: int = 32, order: str = "ord") -> DataFrame:
    """pending with batch: slices of `size` in order. The order is numbered in blocks (see admission), not in one task."""
    from tidemark.operators.admission import _places_before

    d = _places_before(pending.withColumnRenamed(order, "ord").withColumn("__takes", F.lit(1).cast("long")))
    return d.withColumn("batch", F.floor(F.col("__before") / size)).drop("__takes", "__before").withColumnRenamed("ord", order)


def structure_issues(files: DataFrame, chunks: DataFrame, repository_id: str, revision: str) -> DataFrame:
    """(issue, subject): duplicate paths, references to missing or foreign chunks, chunks without an owner or with several,
    chunks of another identity. None for a sound index."""
    ids = files.select("path", F.explode("chunk_ids").alias("id"))
    issue = lambda df, name, what: df.select(F.lit(name).alias("issue"), F.col(what).cast("string").alias("subject"))
    dup = issue(files.groupBy("path").count().where("count > 1"), "path listed twice", "path")
    j = ids.join(chunks.select("id", F.col("path").alias("c_path")), "id", "left")
    lost = issue(j.where(F.coalesce(F.col("c_path") != F.col("path"), F.lit(True))), "chunk listed but not there, or under another path", "path")
    owners = chunks.select("id").join(ids.groupBy("id").count(), "id", "left")
    alone = issue(owners.where(F.coalesce("count", F.lit(0)) != 1), "chunk listed by no file, or by several", "id")
    other = issue(chunks.where((F.col("repository_id") != repository_id) | (F.col("revision") != revision)), "chunk of another repository or revision", "id")
    return dup.unionByName(lost).unionByName(alone).unionByName(other)


def incompatibility(meta: DataFrame, chunker: str, max_chunk_tokens: int, policy: str, repository_id: str) -> DataFrame:
    """meta with reason: why an index cannot be used again, else null; the first difference."""
    differs = lambda c, v, label: (F.col(c) != F.lit(v), F.concat(F.lit(label + " "), F.col(c).cast("string"), F.lit(f" != {v}")))
    out = None
    for test, text in (differs("chunker_version", chunker, "chunker version"), differs("max_chunk_tokens", max_chunk_tokens, "max chunk tokens"), differs("policy_version", policy, "privacy policy version"), (F.col("repository_id") != repository_id, F.lit("repository identity differs"))):
        out = (F if out is None else out).when(test, text)
    return meta.withColumn("reason", out)
