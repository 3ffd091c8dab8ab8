"""Privacy, file types, admission and identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import keys as K
from tidemark.functions import policy as P
from tidemark.functions import text as T
from tidemark.operators import admission
from tidemark.plans.registry import query, table

_SECRET = r"""CASE WHEN regexp_matches({0}, '(?i)-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----') THEN 'private key' WHEN regexp_matches({0}, '\bAKIA[0-9A-Z]{{16}}\b') THEN 'AWS access key' WHEN regexp_matches({0}, '\bgh[pousr]_[A-Za-z0-9_]{{20,}}\b') THEN 'GitHub token' WHEN regexp_matches({0}, '(?i)\b(?:api[_-]?key|secret|password|token)\s*[:=]\s*["'']?[A-Za-z0-9_\-/.+=]{{16,}}') THEN 'generic credential assignment' END"""
_REDACT = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?i)-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----', '[REDACTED:private key]', 'g'), '\bAKIA[0-9A-Z]{{16}}\b', '[REDACTED:AWS access key]', 'g'), '\bgh[pousr]_[A-Za-z0-9_]{{20,}}\b', '[REDACTED:GitHub token]', 'g'), '(?i)\b(?:api[_-]?key|secret|password|token)\s*[:=]\s*["'']?[A-Za-z0-9_\-/.+=]{{16,}}', '[REDACTED:generic credential assignment]', 'g')"""


@query("secret_scan", f"SELECT 'documents' AS source, doc_id AS id, {_SECRET.format('text')} AS secret FROM documents WHERE secret IS NOT NULL UNION ALL SELECT 'pages', page_id, {_SECRET.format('html')} AS secret FROM pages WHERE secret IS NOT NULL UNION ALL SELECT 'conversations', conv_id, {_SECRET.format('text')} AS secret FROM conversations WHERE secret IS NOT NULL")
def secret_scan(spark, d):
    out = None
    for name, key, col in (("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("conversations", "conv_id", "text")):
        t = table(spark, d, name).select(F.lit(name).alias("source"), F.col(key).alias("id"), P.sensitive_content(F.col(col)).alias("secret")).where("secret is not null")
        out = t if out is None else out.unionByName(t)
    return out


@query("redact", f"SELECT doc_id, md5({_REDACT.format('text')}) AS redacted_md5 FROM documents")
def redact(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(P.redact(F.col("text")).cast("binary")).alias("redacted_md5"))


_KINDS = ["src/app.ts", "src/node_modules/a.js", "lib/x.min.js", "package-lock.json", "a/b.test.tsx", "docs/readme.md", "img/logo.PNG", ".env.local", "home/.ssh/id", "k/.aws/credentials", "conf/secrets.yml", "a\\b\\vendor\\c.go", "tools/Makefile", "server.key", "x/.kube/config", "src/dist.ts", "y/__tests__/z.py", "ui/snap.SNAP", "tsconfig.json", "Dockerfile"]


def _paths(spark, d):
    """Paths of many kinds, made from the pages' ids."""
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.col("page_id") % len(_KINDS)).cast("int"))
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit("/"), kind).alias("path"))


_SQL_KINDS = "[" + ", ".join(f"'{k}'" for k in _KINDS) + "]"


def _in(values):
    return ", ".join(f"'{v}'" for v in values)


def _any(test, values):
    return "(" + " OR ".join(test.format(v) for v in values) + ")"


_PATHS = f"""pa AS (SELECT page_id, 'p' || page_id::VARCHAR || '/' || ({_SQL_KINDS})[page_id % {len(_KINDS)} + 1] AS path FROM pages),
n AS (SELECT page_id, path, replace(path, chr(92), '/') AS p, string_split(replace(path, chr(92), '/'), '/')[-1] AS base FROM pa),
m AS (SELECT *, lower(p) AS lp, lower(base) AS lbase, list_filter(string_split(lower(p), '/'), lambda x: x <> '') AS parts, CASE WHEN contains(base, '.') THEN lower('.' || string_split(base, '.')[-1]) ELSE '' END AS ext FROM n),
f AS (SELECT *, (len(list_intersect(parts[:-2], [{_in(P.GENERATED_FOLDERS)}])) > 0 OR regexp_matches(lbase, '(?i)\\.min\\.[cm]?js$')) AS generated FROM m),
k AS (SELECT *, CASE WHEN {_any("ends_with(p, '{}')", P.LOCKFILES)} THEN 'lockfile' WHEN generated OR regexp_matches(base, '(?i)\\.snap$') THEN 'generated' WHEN {_any("contains(p, '{}')", P.TEST_MARKS)} THEN 'test' WHEN base IN ({_in(P.CONFIG_NAMES)}) OR ext IN ({_in(P.CONFIG_EXTENSIONS)}) THEN 'config' WHEN ext IN ({_in(P.DOC_EXTENSIONS)}) THEN 'docs' WHEN ext IN ({_in(P.BINARY_EXTENSIONS)}) THEN 'binary' WHEN ext IN ({_in(P.SOURCE_EXTENSIONS)}) THEN 'source' ELSE 'unknown' END AS file_type,
  (starts_with(lbase, '.env') OR lbase IN ({_in(P.SENSITIVE_NAMES)}) OR {_any("ends_with(lbase, '{}')", P.SENSITIVE_SUFFIXES)} OR len(list_intersect(parts, [{_in(P.SENSITIVE_FOLDERS)}])) > 0 OR contains('/' || array_to_string(parts, '/') || '/', '/.aws/credentials/') OR contains('/' || array_to_string(parts, '/') || '/', '/.kube/config/')) AS sensitive FROM f)"""


@query("classify_path", f"WITH {_PATHS} SELECT page_id, file_type, generated, file_type IN ('source', 'test', 'config') AS reviewable, regexp_matches(p, '(?i)\\.(?:[cm]?[jt]sx?|py|rb|go|rs|java|kt|swift|cs|cpp|cc|c|h|hpp|php)$') AS indexable FROM k")
def classify_path(spark, d):
    p = _paths(spark, d)
    t = p.select("page_id", P.classify(F.col("path")).alias("file_type"), P.is_generated(F.col("path")).alias("generated"), P.is_indexable(F.col("path")).alias("indexable"))
    return t.withColumn("reviewable", P.is_reviewable(F.col("file_type")))


@query("sensitive_path", f"WITH {_PATHS} SELECT page_id, sensitive FROM k")
def sensitive_path(spark, d):
    p = _paths(spark, d)
    return p.select("page_id", P.is_sensitive_path(F.col("path")).alias("sensitive"))


def _files(spark, d):
    p = _paths(spark, d)
    text = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "text")
    patch = F.when(F.col("page_id") % 11 != 0, F.col("text"))
    return p.join(text, "page_id", "left").select(F.col("page_id").alias("ord"), F.col("path").alias("filename"), F.when(F.col("page_id") % 13 == 0, F.lit("old/.ssh/k")).alias("previous_filename"), patch.alias("patch"))


_MAX = 40
_ADMIT = f"""WITH {_PATHS}, fi AS (SELECT page_id AS ord, file_type, sensitive, page_id % 13 = 0 AS origin, CASE WHEN page_id % 11 <> 0 THEN text END AS patch, page_id % 17 = 0 AS ignored FROM k LEFT JOIN documents ON doc_id = page_id),
e AS (SELECT *, CASE WHEN sensitive OR origin THEN 'sensitive_path' WHEN ({_SECRET.format('patch')}) IS NOT NULL THEN 'sensitive_content' WHEN ignored THEN 'ignored_by_user' WHEN file_type = 'generated' THEN 'generated_file' WHEN file_type NOT IN ('source', 'test', 'config') THEN 'unsupported_file_type' END AS early FROM fi),
b AS (SELECT *, coalesce(sum(CASE WHEN early IS NULL AND coalesce(patch, '') <> '' THEN 1 ELSE 0 END) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e),
a AS (SELECT ord, file_type, early IS NULL AS eligible, coalesce(early, CASE WHEN coalesce(patch, '') = '' THEN 'missing_patch' WHEN before >= {_MAX} THEN 'work_limit' END) AS reason FROM b)"""


def _admitted(spark, d):
    return admission.admit(_files(spark, d), ignored=F.col("ord") % 17 == 0, max_files=_MAX)


@query("admission", f"{_ADMIT} SELECT ord, file_type, eligible, reason, CASE WHEN reason IS NULL THEN 'admitted' ELSE 'skipped' END AS decision FROM a")
def admission_query(spark, d):
    return _admitted(spark, d).select("ord", "file_type", "eligible", "reason", "decision")


@query("coverage_status", f"{_ADMIT}, c AS (SELECT count(*) AS discovered, count(*) FILTER (eligible) AS eligible, count(*) FILTER (reason IN ('missing_patch', 'work_limit')) AS omitted, count(*) FILTER (reason IS NOT NULL AND reason NOT IN ('missing_patch', 'work_limit')) AS skipped, count(*) FILTER (reason IS NULL) AS attempted, count(*) FILTER (reason IS NULL AND ord % 5 <> 0) AS reviewed, count(*) FILTER (reason IS NULL AND ord % 5 = 0) AS failed FROM a) SELECT *, CASE WHEN eligible > 0 AND reviewed = 0 THEN 'failed' WHEN failed > 0 OR omitted > 0 THEN 'partial' ELSE 'complete' END AS status FROM c")
def coverage_status(spark, d):
    a = _admitted(spark, d)
    outcomes = a.where("decision = 'admitted'").select("filename", F.lit(True).alias("started"), (F.col("ord") % 5 == 0).alias("failed"))
    c = admission.coverage(a, outcomes)
    return c.withColumn("status", admission.status(F.lit(True), F.lit("lexical"), F.lit("used"))).drop("truncated")


@query("content_keys", """WITH c AS (SELECT doc_id, source, replace(source || '/' || lang, chr(92), '/') AS path, text, sha256(text) AS h FROM documents)
SELECT doc_id, h AS content_hash, substr(sha256('repo' || chr(0) || 'rev1' || chr(0) || path || chr(0) || '1' || chr(0) || (doc_id % 90 + 1)::VARCHAR || chr(0) || h || chr(0) || 'tidemark-scan-v2'), 1, 24) AS chunk_id,
sha256(path || chr(10) || '' || chr(10) || replace(text, chr(13) || chr(10), chr(10))) AS input_hash,
sha256('{"inputHash":"' || sha256(path || chr(10) || '' || chr(10) || replace(text, chr(13) || chr(10), chr(10))) || '","provider":"det","model":"m","version":"v1","dimensions":64,"chunkerVersion":"tidemark-scan-v2","maxChunkTokens":800}') AS cache_key FROM c""")
def content_keys(spark, d):
    t = table(spark, d, "documents").withColumn("path", F.concat("source", F.lit("/"), "lang"))
    h = K.sha(F.col("text"))
    i = K.input_hash(F.col("path"), F.lit(None).cast("string"), F.col("text"))
    return t.select("doc_id", h.alias("content_hash"), K.chunk_id(F.lit("repo"), F.lit("rev1"), F.col("path"), F.lit(1), F.col("doc_id") % 90 + 1, h).alias("chunk_id"), i.alias("input_hash"), K.cache_key(i, "det", "m", "v1", 64, 800).alias("cache_key"))


@query("text_measures", r"""SELECT doc_id, strlen(text)::BIGINT AS tokens, CASE WHEN text = '' THEN 0 ELSE len(string_split(CASE WHEN ends_with(replace(text, chr(13) || chr(10), chr(10)), chr(10)) THEN left(replace(text, chr(13) || chr(10), chr(10)), -1) ELSE replace(text, chr(13) || chr(10), chr(10)) END, chr(10))) END::BIGINT AS n_lines,
md5(CASE WHEN length(text) <= 15000 THEN text ELSE substr(text, 1, 14920) || chr(10) || '[TRUNCATED: patch exceeded review size limit]' END) AS truncated_md5 FROM documents""")
def text_measures(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.estimate_tokens(c).alias("tokens"), T.count_lines(c).alias("n_lines"), F.md5(T.truncate_patch(c).cast("binary")).alias("truncated_md5"))


@query("content_dedup", "SELECT sha256(text) AS content_hash, min(doc_id) AS first_doc, count(*)::BIGINT AS copies FROM documents GROUP BY 1")
def content_dedup(spark, d):
    return table(spark, d, "documents").groupBy(K.sha(F.col("text")).alias("content_hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


@query("binary_check", r"""WITH b AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN html || repeat(chr(1), length(html) // 5) WHEN page_id % 3 = 1 THEN html ELSE html || chr(7) END AS t FROM pages) SELECT page_id, strlen(t) > 0 AND (strlen(t) - strlen(regexp_replace(t, '[\x01-\x08\x0b\x0e-\x1f]', '', 'g'))) > strlen(t) * 0.1 AS is_binary FROM b""")
def binary_check(spark, d):
    p = table(spark, d, "pages")
    h = F.col("html")
    t = F.when(F.col("page_id") % 3 == 0, F.concat(h, F.repeat(F.lit("\x01"), F.floor(F.length(h) / 5).cast("int")))).when(F.col("page_id") % 3 == 1, h).otherwise(F.concat(h, F.lit("\x07")))
    return p.select("page_id", P.is_probably_binary(t.cast("binary")).alias("is_binary"))
