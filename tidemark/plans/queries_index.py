"""Index maintenance: reconciling snapshots, resolving vectors, publishing generations, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import keys as K
from tidemark.operators import reconcile
from tidemark.plans.registry import query, table
from tidemark.sources import store


def _known(spark, d):
    """Documents with what other tables say of their ids: labelled ones were there before, those with a page are there
    now, toxic ones changed."""
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id")).distinct().withColumn("page", F.lit(True))
    return table(spark, d, "documents").join(labels, "doc_id", "left").join(pages, "doc_id", "left")


def _snapshots(spark, d):
    """The labelled documents as the index before, the documents with pages as the scan now."""
    t = _known(spark, d).withColumn("path", F.col("doc_id").cast("string"))
    h = K.sha(F.col("text"))
    before = t.where("toxic is not null").select("path", h.alias("content_hash"), F.octet_length("text").cast("long").alias("size"), F.substring(h, 1, 8).alias("blob_id"), F.lit(None).cast("long").alias("mtime_ms"), F.array(F.concat(F.lit("c"), "path")).alias("chunk_ids"))
    changed = F.when(F.col("toxic") == 1, F.concat(h, F.lit("x"))).otherwise(h)
    english = F.col("lang") == "en"
    after = t.where("page").select("path", F.when(~english, changed).alias("content_hash"), F.octet_length("text").cast("long").alias("size"), F.when(english, F.substring(h, 1, 8)).alias("blob_id"), F.lit(None).cast("long").alias("mtime_ms"))
    # chunks of documents of low quality are lost
    return before, after, t.where("toxic is not null and quality = 1").select(F.concat(F.lit("c"), "path").alias("id"))


_KNOWN = """lb AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
k AS (SELECT d.*, lb.toxic, lb.quality, d.doc_id IN (SELECT page_id FROM pages) AS page FROM documents d LEFT JOIN lb USING (doc_id))"""
_REC = f"""{_KNOWN}, r AS (SELECT doc_id, lang, CASE WHEN NOT page THEN 'deleted' WHEN toxic IS NULL THEN 'added' WHEN quality <> 1 THEN 'modified' WHEN lang <> 'en' AND toxic = 1 THEN 'modified' ELSE 'unchanged' END AS status FROM k WHERE toxic IS NOT NULL OR page)"""


@query("reconcile", f"WITH {_REC} SELECT doc_id::VARCHAR AS path, status, status <> 'deleted' AND NOT (status = 'unchanged' AND lang = 'en') AS needs_read FROM r")
def reconcile_query(spark, d):
    return reconcile.reconcile(*_snapshots(spark, d))


@query("update_counts", f"WITH {_REC} SELECT count(*) FILTER (status = 'unchanged') AS files_unchanged, count(*) FILTER (status = 'modified') AS files_modified, count(*) FILTER (status = 'added') AS files_added, count(*) FILTER (status = 'deleted') AS files_deleted, count(*) FILTER (status <> 'deleted' AND NOT (status = 'unchanged' AND lang = 'en')) AS files_read FROM r")
def update_counts(spark, d):
    return reconcile.counts(reconcile.reconcile(*_snapshots(spark, d)))


def _stored(spark, d):
    """A vector for every labelled document, two for toxic ones, those of low quality in another space."""
    t = _known(spark, d).where("toxic is not null").withColumn("copy", F.explode(F.when(F.col("toxic") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    h = K.sha(F.col("text"))
    return t.select((F.col("doc_id") * 2 + F.col("copy")).alias("ord"), K.cache_key(h, "det", "m", "v1", 4, 800).alias("cache_key"), h.alias("input_hash"), F.lit("det").alias("provider"), F.when(F.col("quality") == 0, "other").otherwise("m").alias("model"), F.lit("v1").alias("version"), F.lit("4").alias("dimension_identity"), F.lit(4).alias("dimensions"), F.array(*[(F.col("doc_id") + F.col("copy") + k).cast("double") for k in range(4)]).alias("values"))


_VEC = f"{_KNOWN}, v AS (SELECT sha256(text) AS h, doc_id * 2 + u.c AS ord, doc_id, quality FROM k, (SELECT unnest([0, 1]) AS c) u WHERE toxic IS NOT NULL AND (u.c = 0 OR toxic = 1))"


@query("first_vectors", f"WITH {_VEC} SELECT h AS input_hash, min(ord)::BIGINT AS ord FROM v GROUP BY h")
def first_vectors(spark, d):
    return reconcile.first_vectors(reconcile.sound_vectors(_stored(spark, d))).select("input_hash", "ord")


@query("vector_resolution", f"WITH {_VEC}, w AS (SELECT DISTINCT sha256(text) AS h FROM k), p AS (SELECT DISTINCT h FROM v WHERE quality <> 0), c AS (SELECT DISTINCT sha256(text) AS h FROM k WHERE page) SELECT h AS input_hash, CASE WHEN h IN (SELECT h FROM p) THEN 'previous' WHEN h IN (SELECT h FROM c) THEN 'checkpoint' ELSE 'embed' END AS origin FROM w")
def vector_resolution(spark, d):
    t = _known(spark, d)
    hashes = lambda x: x.select(K.sha(F.col("text")).alias("input_hash"))
    return reconcile.resolve(hashes(t), _stored(spark, d).where("model = 'm'"), hashes(t.where("page")))


@query("pruned_vectors", f"WITH {_VEC} SELECT ord::BIGINT AS ord FROM v WHERE h NOT IN (SELECT sha256(text) FROM k WHERE page)")
def pruned_vectors(spark, d):
    wanted = _known(spark, d).where("page").select(K.sha(F.col("text")).alias("input_hash"))
    return reconcile.pruned(_stored(spark, d), wanted).select("ord")


@query("chunk_vectors", f"WITH {_VEC}, f AS (SELECT h, min(doc_id) AS first FROM v WHERE quality <> 0 GROUP BY h) SELECT doc_id AS ordinal, first::DOUBLE AS head FROM documents JOIN f ON f.h = sha256(text)")
def chunk_vectors(spark, d):
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("ordinal"), K.sha(F.col("text")).alias("input_hash"))
    space = {"provider": "det", "model": "m", "version": "v1", "dimension_identity": "4"}
    return reconcile.chunk_vectors(chunks, _stored(spark, d), space).select("ordinal", F.get("values", F.lit(0)).alias("head"))


@query("embed_batches", "SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 32)::BIGINT AS batch FROM documents")
def embed_batches(spark, d):
    return reconcile.batches(table(spark, d, "documents").select("doc_id"), 32, "doc_id").select("doc_id", "batch")


@query("referential_checks", f"WITH {_KNOWN} SELECT 'chunk listed but not there, or under another path' AS issue, doc_id::VARCHAR AS subject FROM k WHERE toxic = 1 UNION ALL SELECT 'path listed twice', doc_id::VARCHAR FROM k WHERE quality = 0 UNION ALL SELECT 'chunk listed but not there, or under another path', doc_id::VARCHAR FROM k WHERE quality = 0 AND toxic = 1 UNION ALL SELECT 'chunk listed by no file, or by several', 'c' || doc_id::VARCHAR FROM k WHERE quality = 0 AND toxic <> 1 UNION ALL SELECT 'chunk of another repository or revision', 'c' || doc_id::VARCHAR FROM k WHERE page AND coalesce(toxic, 0) <> 1")
def referential_checks(spark, d):
    """Chunks of toxic documents are missing, files of low quality are listed twice, chunks of pages are of an old revision."""
    t = _known(spark, d)
    files = t.select(F.col("doc_id").cast("string").alias("path"), F.array(F.concat(F.lit("c"), F.col("doc_id").cast("string"))).alias("chunk_ids"), "quality")
    files = files.unionByName(files.where("quality = 0")).drop("quality")
    chunks = t.where("coalesce(toxic, 0) <> 1").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("id"), F.col("doc_id").cast("string").alias("path"), F.lit("repo").alias("repository_id"), F.when(F.col("page"), "old").otherwise("rev").alias("revision"))
    return reconcile.structure_issues(files, chunks, "repo", "rev")


@query("index_compatibility", "SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'chunker version old != v2' WHEN n_nationkey % 4 = 1 THEN 'max chunk tokens 5 != 800' WHEN n_nationkey % 4 = 2 THEN 'repository identity differs' END AS reason FROM nation")
def index_compatibility(spark, d):
    k = F.col("n_nationkey")
    meta = table(spark, d, "nation").select("n_nationkey", F.when(k % 4 == 0, "old").otherwise("v2").alias("chunker_version"), F.when(k % 4 == 1, 5).otherwise(800).alias("max_chunk_tokens"), F.lit("p1").alias("policy_version"), F.when(k % 4 == 2, "x/y").otherwise("repo").alias("repository_id"))
    return reconcile.incompatibility(meta, "v2", 800, "p1", "repo").select("n_nationkey", "reason")


@query("vector_offsets", "WITH v AS (SELECT label, vec_id, len(embedding) * 8 AS bytes FROM embeddings) SELECT vec_id, (sum(bytes) OVER (PARTITION BY label ORDER BY vec_id) - bytes)::BIGINT AS byte_offset FROM v")
def vector_offsets(spark, d):
    v = table(spark, d, "embeddings").select("label", "vec_id", (F.size("embedding") * 8).cast("long").alias("bytes"))
    return store.byte_offsets(v, ["label"], "vec_id", "bytes").select("vec_id", "byte_offset")


@query("index_publish", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def index_publish(spark, d):
    """A generation is published, found by its manifest and read again."""
    from tidemark.sources.workspace import work_dir

    root = work_dir(spark, "index")
    t = table(spark, d, "documents").select("doc_id", K.sha(F.col("text")).alias("content_hash"))
    store.publish(spark, root, {"chunks": t}, {"repository_id": "repo", "revision": "rev"})
    opened = store.open_index(spark, root)
    assert opened.status == "valid", opened.reason
    return opened.tables["chunks"]


@query("source_scoped_ids", r"SELECT page_id, regexp_matches(regexp_extract(url, '://(.*)', 1), '\A[a-z0-9_.-]+/[a-z0-9_.-]+\z') AS source_scoped FROM pages")
def source_scoped_ids(spark, d):
    """Of a page's address without its scheme: whether it has the shape of a hosted repository's id."""
    return table(spark, d, "pages").select("page_id", K.is_source_scoped(F.regexp_extract("url", "://(.*)", 1)).alias("source_scoped"))
