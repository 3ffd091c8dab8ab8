"""Lexical, semantic and hybrid retrieval over documents (chunks) for the benchmark's items (queries)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import keys as K
from tidemark.functions import text as T
from tidemark.operators import admission, hybrid, lexical, metrics, semantic
from tidemark.plans.registry import query, table

LIMIT = 20
_TOK = r"list_distinct(regexp_extract_all(lower({}), '[a-z_$][\w$]{{2,}}'))"
_Q = f"q AS (SELECT item_id AS query_id, unnest({_TOK.format('text')}) AS term, len({_TOK.format('text')}) AS n_terms FROM benchmark)"
_P = f"p AS (SELECT doc_id AS ordinal, unnest({_TOK.format('text')}) AS term FROM documents)"


def plain_chunks(spark, d):
    """Documents as chunks whose searched text is their own."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("ordinal"), F.lit("").alias("path"), F.col("text").alias("content"))


def rich_chunks(spark, d):
    """The source as path, the language as symbol and an import of the source's last characters."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("ordinal"), F.col("source").alias("path"), F.col("lang").alias("name"), F.array(F.concat(F.lit("./"), F.substring("source", 3, 10))).alias("imports"), F.col("text").alias("content"), K.sha(F.col("text")).alias("content_hash"))


def queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.concat(F.lit("src"), (F.col("item_id") % 7).cast("string")).alias("changed_path"))


@query("lexical_tokens", f"SELECT doc_id, len({_TOK.format('text')})::BIGINT AS n_terms, md5(array_to_string(list_sort({_TOK.format('text')}), ' ')) AS terms_md5 FROM documents")
def lexical_tokens(spark, d):
    t = table(spark, d, "documents").select("doc_id", T.lexical_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.md5(F.array_join(F.sort_array("t"), " ").cast("binary")).alias("terms_md5"))


@query("posting_lists", f"WITH {_P} SELECT term, count(*)::BIGINT AS df, min(ordinal) AS first_ordinal, sum(ordinal)::BIGINT AS ordinal_sum FROM p GROUP BY term")
def posting_lists(spark, d):
    return lexical.postings(plain_chunks(spark, d)).groupBy("term").agg(F.count("*").alias("df"), F.min("ordinal").alias("first_ordinal"), F.sum("ordinal").alias("ordinal_sum"))


@query("posting_arrays", f"WITH {_P} SELECT term, array_to_string(list_sort(list(ordinal)), ',') AS ordinals FROM p GROUP BY term")
def posting_arrays(spark, d):
    return lexical.posting_lists(plain_chunks(spark, d)).select("term", F.array_join("ordinals", ",").alias("ordinals"))


_RANKED = f"""WITH {_Q}, {_P},
h AS (SELECT query_id, ordinal, count(*) AS overlap, any_value(n_terms) AS n_terms FROM q JOIN p USING (term) GROUP BY query_id, ordinal),
s AS (SELECT query_id, ordinal, overlap::BIGINT AS overlap, least(1.0, overlap::DOUBLE / n_terms)::DOUBLE AS score FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal) AS rank FROM s)"""


@query("lexical_topk", f"{_RANKED} SELECT query_id, rank::BIGINT AS rank, ordinal, score FROM r WHERE rank <= {LIMIT}")
def lexical_topk(spark, d):
    q = queries(spark, d).withColumn("changed_path", F.lit(None).cast("string"))
    return lexical.rank_candidates(plain_chunks(spark, d), q, LIMIT, fill=False).select("query_id", F.col("rank").cast("long").alias("rank"), "ordinal", "score")


_RICH = r"""q0 AS (SELECT item_id AS query_id, 'src' || (item_id % 7)::VARCHAR AS changed_path, list_distinct(regexp_extract_all(lower(text), '[a-z_$][\w$]{2,}')) AS terms FROM benchmark),
qq AS (SELECT query_id, unnest(terms) AS term FROM q0),
c AS (SELECT doc_id AS ordinal, source AS path, lang AS name, substr(source, 3, 10) AS needle, list_distinct(regexp_extract_all(lower(source || ' ' || lang || '  ./' || substr(source, 3, 10) || ' ' || text), '[a-z_$][\w$]{2,}')) AS terms, sha256(text) AS content_hash FROM documents),
cp AS (SELECT ordinal, unnest(terms) AS term FROM c),
h AS (SELECT query_id, ordinal, 1 AS o, 0 AS i, 0 AS s, 0 AS f FROM qq JOIN cp USING (term)
  UNION ALL SELECT query_id, ordinal, 0, 0, 1, 0 FROM qq JOIN c ON lower(c.name) = qq.term
  UNION ALL SELECT query_id, ordinal, 0, 1, 0, 0 FROM q0 JOIN c ON contains(changed_path, needle)
  UNION ALL SELECT query_id, ordinal, 0, 0, 0, 1 FROM q0 JOIN c ON changed_path = path),
g AS (SELECT query_id, ordinal, sum(o) AS overlap, max(i) AS i, max(s) AS s, max(f) AS f FROM h GROUP BY query_id, ordinal),
sc AS (SELECT g.query_id, ordinal, 1 AS hit, overlap, i, s, f, least(1.0::DOUBLE, overlap::DOUBLE / len(terms) + CASE WHEN i = 1 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN s = 1 THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN f = 1 THEN 0.05::DOUBLE ELSE 0 END) AS score FROM g JOIN q0 USING (query_id)),
al AS (SELECT * FROM sc UNION ALL SELECT q0.query_id, c.ordinal, 0, 0, 0, 0, 0, 0.0 FROM q0, c WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.query_id = q0.query_id AND sc.ordinal = c.ordinal)),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hit DESC, score DESC, ordinal) AS rank FROM al QUALIFY rank <= 20)"""


@query("lexical_boosts", f"WITH {_RICH} SELECT query_id, rank::BIGINT AS rank, ordinal, score, (i = 1) AS import_linked, (f = 1) AS same_file FROM lex")
def lexical_boosts(spark, d):
    got = lexical.rank_candidates(rich_chunks(spark, d), queries(spark, d), LIMIT)
    has = lambda r: F.array_contains("reasons", r)
    return got.select("query_id", F.col("rank").cast("long").alias("rank"), "ordinal", "score", has("import-link").alias("import_linked"), has("same-file").alias("same_file"))


@query("lexical_zero_fill", r"""WITH q0 AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower('zq' || item_id::VARCHAR || 'x'), '[a-z_$][\w$]{2,}')) AS t FROM benchmark),
f AS (SELECT doc_id AS ordinal, row_number() OVER (ORDER BY doc_id) AS rank FROM documents QUALIFY rank <= 20)
SELECT query_id, rank::BIGINT AS rank, ordinal, 0.0::DOUBLE AS score FROM q0, f""")
def lexical_zero_fill(spark, d):
    """Queries whose terms no document has: filled from the first documents."""
    q = queries(spark, d).select("query_id", F.concat(F.lit("zq"), F.col("query_id").cast("string"), F.lit("x")).alias("query"), F.lit("nowhere").alias("changed_path"))
    return lexical.rank_candidates(plain_chunks(spark, d), q, LIMIT).select("query_id", F.col("rank").cast("long").alias("rank"), "ordinal", "score")


@query("lexical_work", f"WITH {_Q}, {_P} SELECT query_id, count(*)::BIGINT AS postings_examined, count(DISTINCT ordinal)::BIGINT AS documents_scored FROM q JOIN p USING (term) GROUP BY query_id")
def lexical_work(spark, d):
    h = lexical.hits(plain_chunks(spark, d), queries(spark, d).withColumn("changed_path", F.lit(None).cast("string")))
    return h.groupBy("query_id").agg(F.sum("overlap").alias("postings_examined"), F.count("*").alias("documents_scored"))


_SEM = """SELECT q.vec_id AS query_id, v.vec_id AS ordinal, greatest(0, list_reduce(list_transform(list_zip(list_transform(q.embedding, lambda x: x::DOUBLE), list_transform(v.embedding, lambda x: x::DOUBLE)), lambda z: z[1] * z[2]), lambda a, b: a + b)
  / sqrt(list_reduce(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE), lambda a, b: a + b) * list_reduce(list_transform(v.embedding, lambda x: x::DOUBLE * x::DOUBLE), lambda a, b: a + b)))::DOUBLE AS score
  FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0"""


@query("semantic_topk", f"WITH s AS ({_SEM}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal) AS rank FROM s) SELECT query_id, rank::BIGINT AS rank, ordinal, round(score, 9) AS score FROM r WHERE rank <= {LIMIT}")
def semantic_topk(spark, d):
    """Every row whose id is divisible by 20 is a query; all rows are searched."""
    e = table(spark, d, "embeddings")
    v = e.select(F.col("vec_id").alias("ordinal"), F.col("embedding").cast("array<double>").alias("values"))
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("values"))
    return semantic.search(v, q, LIMIT).select("query_id", F.col("rank").cast("long").alias("rank"), "ordinal", F.round("score", 9).alias("score"))


@query("vector_norms", "SELECT vec_id, len(embedding)::BIGINT AS dimensions, round(list_reduce(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE), lambda a, b: a + b), 9) AS sq_norm FROM embeddings")
def vector_norms(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("values"))
    return semantic.checked_vectors(v, 64).select("vec_id", F.size("values").cast("long").alias("dimensions"), F.round("sq_norm", 9).alias("sq_norm"))


_B = r"""b AS (SELECT {key} AS k, unnest(regexp_extract_all(lower(text), '[a-z_$][\w$]*')) AS t FROM {table}),
bk AS (SELECT k, (('0x' || substr(sha256(t), 1, 2))::INT % 64) AS bucket, count(*) AS n FROM b GROUP BY k, bucket)"""


@query("hash_embedding", "WITH " + _B.format(key="doc_id", table="documents") + " SELECT k AS doc_id, bucket::INT AS bucket, n::BIGINT AS n FROM bk")
def hash_embedding(spark, d):
    return semantic.hash_counts(table(spark, d, "documents"), "doc_id", F.col("text"))


@query("feature_embedding", """WITH v AS (SELECT doc_id, [CASE WHEN regexp_matches(lower(text), '(auth|permission|admin|security|allowed)') THEN 1 ELSE 0 END, CASE WHEN regexp_matches(lower(text), '(retry|attempt|maxretries)') THEN 1 ELSE 0 END, CASE WHEN regexp_matches(lower(text), '(profile|null|undefined)') THEN 1 ELSE 0 END, CASE WHEN regexp_matches(lower(text), '(amount|number|nan|limit)') THEN 1 ELSE 0 END, CASE WHEN regexp_matches(lower(text), '(input|assertion)') THEN 1 ELSE 0 END] AS f FROM documents)
SELECT doc_id, round(list_sum(f) / CASE WHEN list_sum(f) = 0 THEN 1 ELSE sqrt(list_sum(f)) END, 9)::DOUBLE AS total, f[4]::BIGINT AS fourth FROM v""")
def feature_embedding(spark, d):
    v = table(spark, d, "documents").select("doc_id", semantic.feature_embed(F.col("text")).alias("v"))
    return v.select("doc_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 9).alias("total"), (F.get("v", F.lit(3)) > 0).cast("long").alias("fourth"))


def _hybrid(spark, d):
    chunks = rich_chunks(spark, d)
    q = queries(spark, d)
    vectors = semantic.hash_embed(chunks, "ordinal", F.col("content"))
    qv = semantic.hash_embed(q, "query_id", F.col("query"))
    return hybrid.retrieve(chunks, q, "hybrid", vectors, qv)


_HYB = "WITH " + _RICH + r""", tk AS (SELECT 0 AS isq, doc_id AS k, unnest(regexp_extract_all(lower(text), '[a-z_$][\w$]*')) AS t FROM documents UNION ALL SELECT 1, item_id, unnest(regexp_extract_all(lower(text), '[a-z_$][\w$]*')) FROM benchmark),
bk AS (SELECT isq, k, (('0x' || substr(sha256(t), 1, 2))::INT % 64) AS bucket, count(*)::DOUBLE AS n FROM tk GROUP BY isq, k, bucket),
un AS (SELECT isq, k, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY isq, k)) AS x FROM bk),
dn AS (SELECT isq, k, list_transform(range(0, 64), lambda i: coalesce(map_extract(map_from_entries(list({'k': bucket, 'v': x})), i::INT)[1], 0.0)) AS v FROM un GROUP BY isq, k),
se AS (SELECT a.k AS query_id, b.k AS ordinal, greatest(0.0, list_reduce(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]), lambda x, y: x + y) / sqrt(list_reduce(list_transform(a.v, lambda z: z * z), lambda x, y: x + y) * list_reduce(list_transform(b.v, lambda z: z * z), lambda x, y: x + y)))::DOUBLE AS score FROM dn a, dn b WHERE a.isq = 1 AND b.isq = 0),
sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal) AS rank FROM se QUALIFY rank <= 20),
fu AS (SELECT coalesce(lex.query_id, sr.query_id) AS query_id, coalesce(lex.ordinal, sr.ordinal) AS ordinal, coalesce(lex.score, 0) * 0.4::DOUBLE + coalesce(sr.score, 0) * 0.6::DOUBLE AS score, coalesce(lex.rank, 1073741824 + sr.rank) AS place FROM lex FULL JOIN sr ON lex.query_id = sr.query_id AND lex.ordinal = sr.ordinal),
de AS (SELECT fu.*, content_hash FROM fu JOIN c USING (ordinal) WHERE score >= 0.05 QUALIFY row_number() OVER (PARTITION BY query_id, content_hash ORDER BY score DESC, place) = 1),
fi AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS rank FROM de QUALIFY rank <= 5)"""


@query("hybrid_context", _HYB + " SELECT query_id, rank::BIGINT AS rank, ordinal, round(score, 9) AS score FROM fi")
def hybrid_context(spark, d):
    return _hybrid(spark, d).select("query_id", F.col("rank").cast("long").alias("rank"), "ordinal", F.round("score", 9).alias("score"))


@query("context_packing", f"WITH {_RICH}, k AS (SELECT query_id, rank, ordinal, strlen(text) AS bytes FROM lex JOIN documents ON doc_id = ordinal WHERE score >= 0.05), u AS (SELECT *, sum(bytes) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM k) SELECT query_id, count(*)::BIGINT AS packed, max(used)::BIGINT AS used FROM u WHERE used <= 6000 GROUP BY query_id")
def context_packing(spark, d):
    chunks = rich_chunks(spark, d)
    got = lexical.rank_candidates(chunks, queries(spark, d), LIMIT).where(F.col("score") >= 0.05)
    got = got.join(chunks.select("ordinal", T.estimate_tokens(F.col("content")).alias("bytes")), "ordinal")
    return admission.pack_context(got, ["query_id"], 6000).groupBy("query_id").agg(F.count("*").alias("packed"), F.max("used").alias("used"))


@query("retrieval_metrics", f"WITH {_RICH}, b AS (SELECT q0.query_id, min(lex.rank) AS best FROM q0 LEFT JOIN (lex JOIN c USING (ordinal)) ON lex.query_id = q0.query_id AND c.path = q0.changed_path GROUP BY q0.query_id) SELECT count(*)::BIGINT AS queries, count(best)::DOUBLE / count(*) AS recall, round(coalesce(sum(1.0 / best), 0) / count(*), 9)::DOUBLE AS mrr FROM b")
def retrieval_metrics(spark, d):
    chunks, q = rich_chunks(spark, d), queries(spark, d)
    ranked = lexical.rank_candidates(chunks, q, LIMIT).join(chunks.select("ordinal", "path"), "ordinal")
    relevant = q.select("query_id", F.col("changed_path").alias("path"))
    return metrics.retrieval(ranked, relevant).select("queries", "recall", F.round("mrr", 9).alias("mrr"))
