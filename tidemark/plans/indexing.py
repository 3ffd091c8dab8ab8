"""The index of a repository, kept up to date: what is unchanged is used again, the rest is cut and embedded anew.

Nothing is published before all of it is sound. Vectors that were paid for survive a failure: they are embedded slice by
slice, and each finished slice is a table under the index's checkpoint folder, which the next run reads."""

from __future__ import annotations

import uuid
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import keys as K
from tidemark.operators import reconcile, segments
from tidemark.plans import ports
from tidemark.sources import store
from tidemark.sources.workspace import work_dir

POLICY_VERSION = "1"
FILES = "path string, content_hash string, size long, blob_id string, mtime_ms long, chunk_ids array<string>"
CHUNKS = segments.CHUNKS + ", repository_id string, revision string, content_hash string, id string, input_hash string"
VECTORS = "ord long, cache_key string, input_hash string, provider string, model string, version string, dimension_identity string, dimensions int, values array<double>"
#: Texts of a batch and batches of the smallest slice; slices of a run, at most. A failure loses one slice's work.
SLICE_BATCHES, BATCH, MOST_SLICES = 8, 32, 32


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _cols(schema: str) -> list[str]:
    out, depth, word = [], 0, ""
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(word.split()[0])
            word = ""
        else:
            word += c
    return out


def refresh(spark: SparkSession, scanned: DataFrame, root: str, repository_id: str, revision: str, max_tokens: int, adapter=None, retry: ports.Retry | None = None) -> dict:
    """Publish the index of scanned(path, size, mtime_ms, content[, blob_id]) and return the counters of the update."""
    work = work_dir(spark, "refresh")
    meta = {"repository_id": repository_id, "chunker_version": K.CHUNKER_VERSION, "policy_version": POLICY_VERSION, "max_chunk_tokens": max_tokens}
    old = store.open_index(spark, root, {k: v for k, v in meta.items() if k != "repository_id"})
    named = old.meta.get("repository_id")
    foreign = old.status == "valid" and named != repository_id
    if foreign and not spark.range(1).select(K.is_source_scoped(F.lit(named))).first()[0]:
        old = store.Opened("incompatible", "repository_id differs", old.meta)
    usable = old.status == "valid"
    empty = lambda schema: spark.createDataFrame([], schema)
    files0, chunks0, vectors0 = (old.tables[n] if usable else empty(s) for n, s in (("files", FILES), ("chunks", CHUNKS), ("vectors", VECTORS)))
    if usable and foreign:  # this checkout's own index, from when indexes were named after their source
        files0, chunks0 = adopt(files0, chunks0, repository_id, old.meta["revision"])
    blob = F.col("blob_id") if "blob_id" in scanned.columns else F.lit(None).cast("string")
    now = scanned.select("path", "content", K.sha(F.col("content")).alias("content_hash"), "size", blob.alias("blob_id"), reconcile.usable_mtime(F.col("mtime_ms"), F.unix_millis(F.current_timestamp())).alias("mtime_ms"))
    state = _stored(reconcile.reconcile(files0, now.drop("content"), chunks0), f"{work}/state")
    counts = reconcile.counts(state).first().asDict()
    same, fresh = state.where("status = 'unchanged'").select("path"), state.where("status in ('added', 'modified')").select("path")
    reused = segments.identified(chunks0.join(same, "path", "left_semi"), repository_id, revision)
    new = segments.chunk_sources(now.join(fresh, "path", "left_semi").select("path", "content"), repository_id, revision, max_tokens)
    new = new.withColumn("input_hash", K.input_hash(F.col("path"), F.col("signature"), F.col("content")))
    chunks = _stored(reused.select(*_cols(CHUNKS)).unionByName(new.select(*_cols(CHUNKS))), f"{work}/chunks")
    owned = chunks.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "end_line", "id"))), lambda x: x["id"]).alias("chunk_ids"))
    files = now.drop("content").join(state.where("status <> 'deleted'").select("path"), "path", "left_semi").join(owned, "path", "left").withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<string>")))
    vectors, paid = _vectors(spark, chunks, vectors0, root, work, adapter, max_tokens, retry)
    tables = {"files": _stored(files.select(*_cols(FILES)), f"{work}/files"), "chunks": chunks, "vectors": vectors}
    issues = reconcile.structure_issues(tables["files"], chunks, repository_id, revision).limit(5).collect()
    if issues:
        raise ValueError(f"Refusing to use an invalid repository index ({issues})")
    store.publish(spark, root, tables, meta | {"revision": revision})
    store.Files(spark, root).delete("embedding-checkpoint")
    store.vacuum(spark, root)
    n_old = chunks.join(same, "path", "left_semi").count()
    return counts | paid | {"previous": "reused" if usable else "none" if old.status == "missing" else old.status, "chunks_reused": n_old, "chunks_created": chunks.count() - n_old}


def _vectors(spark: SparkSession, chunks: DataFrame, before: DataFrame, root: str, work: str, adapter, max_tokens: int, retry) -> tuple[DataFrame, dict]:
    wanted = chunks.select("input_hash").distinct()
    kept = before.join(wanted, "input_hash", "left_semi")
    none = {"vectors_reused": 0, "vectors_from_checkpoint": 0, "vectors_created": 0}
    if adapter is None:
        out = _stored(kept, f"{work}/vectors")
        return out, none | {"vectors_pruned": before.count() - out.count()}
    identity = K.PROVIDER_DEFAULT if adapter.dimensions is None else str(adapter.dimensions)
    space = {"provider": adapter.provider, "model": adapter.model, "version": adapter.version, "dimension_identity": identity}
    active = kept
    for k, v in space.items():
        active = active.where(F.col(k) == v)
    saved = saved_slices(spark, root)
    saved = reconcile.sound_vectors(saved) if saved is not None else spark.createDataFrame([], VECTORS)
    for k, v in space.items():
        saved = saved.where(F.col(k) == v)
    origin = _stored(reconcile.resolve(wanted, active, saved), f"{work}/origin")
    n = {r.origin: r["count"] for r in origin.groupBy("origin").count().collect()}
    body = chunks.select("input_hash", K.embedding_input(F.col("path"), F.col("signature"), F.col("content")).alias("text")).dropDuplicates(["input_hash"])
    pending = origin.where("origin = 'embed'").join(body, "input_hash").withColumn("ord", F.xxhash64("input_hash").bitwiseAND(F.lit((1 << 40) - 1)))
    size = max(BATCH * SLICE_BATCHES, -(-n.get("embed", 0) // MOST_SLICES))
    pending = _stored(reconcile.batches(pending, size), f"{work}/pending")
    made = []
    for k in range(-(-n.get("embed", 0) // size)):
        part = pending.where(F.col("batch") == k)
        got = ports.embed(part.select(F.xxhash64("input_hash").alias("key"), "text"), adapter, BATCH, retry)
        got = part.select("input_hash", F.xxhash64("input_hash").alias("key")).join(got, "key")
        made.append(f"{root}/embedding-checkpoint/{uuid.uuid4().hex}")
        _as_vectors(got, adapter, space, max_tokens).write.parquet(made[-1])
    take = saved.join(origin.where("origin = 'checkpoint'").select("input_hash"), "input_hash", "left_semi")
    every = kept.select(*_cols(VECTORS)).unionByName(take.select(*_cols(VECTORS)))
    every = every.unionByName(spark.read.schema(VECTORS).parquet(*made)) if made else every  # one scan of all slices
    out = _stored(reconcile.first_vectors(every), f"{work}/vectors")
    return out, {"vectors_reused": n.get("previous", 0), "vectors_from_checkpoint": n.get("checkpoint", 0), "vectors_created": n.get("embed", 0), "vectors_pruned": before.count() - kept.count()}


def _as_vectors(got: DataFrame, adapter, space: dict, max_tokens: int) -> DataFrame:
    key = K.cache_key(F.col("input_hash"), adapter.provider, adapter.model, adapter.version, adapter.dimensions, max_tokens)
    named = [F.lit(v).alias(k) for k, v in space.items()]
    return got.select(F.xxhash64("input_hash").alias("ord"), key.alias("cache_key"), "input_hash", *named, F.size("values").alias("dimensions"), "values")


def saved_slices(spark: SparkSession, root: str) -> DataFrame | None:
    """Vectors of the finished slices of a run that failed, if any."""
    folder = store.Files(spark, f"{root}/embedding-checkpoint")
    done = [n for n, _ in folder.names() if store.Files(spark, f"{root}/embedding-checkpoint/{n}").read("_SUCCESS") is not None]
    return spark.read.schema(VECTORS).parquet(*[f"{root}/embedding-checkpoint/{n}" for n in done]) if done else None


def adopt(files: DataFrame, chunks: DataFrame, repository_id: str, revision: str) -> tuple[DataFrame, DataFrame]:
    """(files, chunks) under another identity: only ids that derive from it change, vectors stay as they are."""
    named = segments.identified(chunks.withColumn("__old", F.col("id")), repository_id, revision)
    ids = named.select(F.col("__old").alias("old"), "id")
    rows = files.select("path", F.posexplode("chunk_ids").alias("pos", "old")).join(ids, "old", "left")
    again = rows.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("id", "old").alias("id")))), lambda x: x["id"]).alias("chunk_ids"))
    return files.drop("chunk_ids").join(again, "path", "left").withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<string>"))), named.drop("__old")


def context_chunks(opened: store.Opened) -> DataFrame:
    """The chunks of an open index with ordinals, as retrieval takes them."""
    from tidemark.plans.review import numbered

    return numbered(opened.tables["chunks"])
