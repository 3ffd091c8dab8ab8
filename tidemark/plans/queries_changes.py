"""Diffs, segments, evidence and findings, over documents taken as new files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import evidence, patch, segments
from tidemark.plans.registry import query, table


def _added(spark, d):
    """All documents, whole, as added files."""
    t = table(spark, d, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".ts")).alias("filename"), "text")
    return t.withColumn("patch", T.synthetic_add_patch(F.col("filename"), F.col("text")))


_BODY = r"""b AS (SELECT doc_id, 'f' || doc_id::VARCHAR || '.ts' AS filename, replace(text, chr(13) || chr(10), chr(10)) AS t FROM documents),
c AS (SELECT *, CASE WHEN ends_with(t, chr(10)) THEN left(t, -1) ELSE t END AS bare FROM b),
n AS (SELECT *, CASE WHEN t = '' THEN 0 ELSE len(string_split(bare, chr(10))) END AS k FROM c),
p AS (SELECT doc_id, filename, k, bare, 'diff --git a/' || filename || ' b/' || filename || chr(10) || 'new file mode 100644' || chr(10) || '--- /dev/null' || chr(10) || '+++ b/' || filename || chr(10) || '@@ -0,0 +1,' || k::VARCHAR || ' @@' || CASE WHEN bare = '' THEN '' ELSE chr(10) || '+' || replace(bare, chr(10), chr(10) || '+') END AS patch FROM n)"""


@query("synthetic_patch", f"WITH {_BODY} SELECT doc_id, md5(patch) AS patch_md5 FROM p")
def synthetic_patch(spark, d):
    return _added(spark, d).select("doc_id", F.md5(F.col("patch").cast("binary")).alias("patch_md5"))


@query("patch_roundtrip", f"WITH {_BODY} SELECT filename, CASE WHEN bare = '' THEN 0 ELSE k END::BIGINT AS additions, 0::BIGINT AS deletions, (CASE WHEN bare = '' THEN 0 ELSE k * (k + 1) // 2 END)::BIGINT AS line_sum FROM p")
def patch_roundtrip(spark, d):
    """Line counts and coordinates of a parsed diff are those of the file that it adds."""
    f = _added(spark, d)
    sums = patch.changed_lines(patch.parse(f)).groupBy("filename").agg(F.sum("line").alias("line_sum"))
    return patch.stats(f).select("filename", "additions", "deletions").join(sums, "filename", "left").withColumn("line_sum", F.coalesce("line_sum", F.lit(0)))


_MIXED = r"""x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
y AS (SELECT doc_id, i, CASE i % 4 WHEN 0 THEN 'deletion' WHEN 1 THEN 'context' ELSE 'addition' END AS kind FROM x),
z AS (SELECT doc_id, i, kind, CASE WHEN kind <> 'addition' THEN 9 + count(*) FILTER (kind <> 'addition') OVER w END AS old_line, CASE WHEN kind <> 'deletion' THEN 19 + count(*) FILTER (kind <> 'deletion') OVER w END AS new_line FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""


def _mixed(spark, d):
    """Documents' lines with signs by their place, in one hunk from lines 10 and 20."""
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when((i + 1) % 4 == 0, "-").when((i + 1) % 4 == 1, " ").otherwise("+"), x))
    t = table(spark, d, "documents")
    return t.select(F.col("doc_id").cast("string").alias("filename"), F.concat(F.lit("@@ -10,5 +20,7 @@ here\n"), F.array_join(marked, "\n")).alias("patch"))


@query("patch_lines", f"WITH {_MIXED} SELECT doc_id::VARCHAR AS filename, (i + 1)::BIGINT AS line_no, kind, old_line::BIGINT AS old_line, new_line::BIGINT AS new_line FROM z")
def patch_lines(spark, d):
    return patch.parse(_mixed(spark, d)).where("kind is not null").select("filename", "line_no", "kind", "old_line", "new_line")


@query("line_ranges", f"WITH {_MIXED}, a AS (SELECT doc_id, new_line AS line FROM z WHERE kind = 'addition'), g AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS island FROM a) SELECT doc_id::VARCHAR AS filename, min(line)::BIGINT AS \"start\", max(line)::BIGINT AS \"end\" FROM g GROUP BY doc_id, island")
def line_ranges(spark, d):
    return patch.ranges(patch.changed_lines(patch.parse(_mixed(spark, d))), ["filename"])


@query("order_line_ranges", "WITH a AS (SELECT DISTINCT l_suppkey AS k, l_orderkey AS line FROM lineitem), g AS (SELECT *, line - row_number() OVER (PARTITION BY k ORDER BY line) AS island FROM a) SELECT k, min(line) AS \"start\", max(line) AS \"end\" FROM g GROUP BY k, island")
def order_line_ranges(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("line"))
    return patch.ranges(t, ["k"])


_MAX = 600  # over the longest word: each is made a line, as the cutting of a single line is for the tests, not for SQL


@query("byte_budget_split", rf"""WITH RECURSIVE l AS (SELECT doc_id, generate_subscripts(string_split(replace(text, ' ', chr(10)), chr(10)), 1) AS i, strlen(unnest(string_split(replace(text, ' ', chr(10)), chr(10)))) AS n FROM documents),
w AS (SELECT doc_id, i, n, 1 AS g, n AS size FROM l WHERE i = 1
  UNION ALL SELECT l.doc_id, l.i, l.n, CASE WHEN w.size + 1 + l.n > {_MAX} THEN w.g + 1 ELSE w.g END, CASE WHEN w.size + 1 + l.n > {_MAX} THEN l.n ELSE w.size + 1 + l.n END FROM w JOIN l ON l.doc_id = w.doc_id AND l.i = w.i + 1)
SELECT doc_id::VARCHAR || '.txt' AS path, min(i)::BIGINT AS start_line, max(i)::BIGINT AS end_line, max(size)::BIGINT AS bytes FROM w GROUP BY doc_id, g""")
def byte_budget_split(spark, d):
    files = table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.replace("text", F.lit(" "), F.lit("\n")).alias("content"))
    c = segments.chunk_sources(files, "r", "v", _MAX)
    return c.select("path", "start_line", "end_line", T.estimate_tokens(F.col("content")).alias("bytes"))


@query("chunk_source")
def chunk_source(spark, d):
    """Documents as script files: cut by declarations and budget."""
    files = table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".ts")).alias("path"), F.concat(F.lit("import a from './a';\nexport function f(x) {\n  return x;\n}\n"), "text").alias("content"))
    return segments.chunk_sources(files, "repo", "rev", 800).select("path", "kind", "name", "start_line", "end_line", "id", "content_complete")


@query("patch_segments")
def patch_segments(spark, d):
    return segments.plan_segments(_added(spark, d).select("filename", "patch"), 2000, 4).select("filename", "seg_no", "id", F.size("line_ranges").alias("n_ranges"), "truncated", "plan_truncated")




def _findings(spark, d):
    c = table(spark, d, "conversations")
    n = F.octet_length("text")
    ev = F.struct(F.col("conv_id").cast("string").alias("path"), (F.lit(20) + n % 7).cast("long").alias("start_line"), (F.lit(20) + n % 7 + n % 3).cast("long").alias("end_line"), F.lit(None).cast("string").alias("context_id"))
    return c.select(F.col("conv_id").cast("string").alias("filename"), F.lit(0).alias("seg_no"), F.col("turn").cast("int").alias("pos"), F.lit("low").alias("severity"), F.col("role").alias("category"), F.lit("high").alias("confidence"), F.col("text").alias("title"), F.lit("").alias("explanation"), F.lit(None).cast("string").alias("suggestion"), F.array(ev).alias("evidence"))


@query("evidence_validation", f"WITH {_MIXED}, a AS (SELECT doc_id, new_line AS line FROM z WHERE kind = 'addition'), c AS (SELECT conv_id, turn, 20 + strlen(text) % 7 AS s, 20 + strlen(text) % 7 + strlen(text) % 3 AS e FROM conversations) SELECT conv_id::VARCHAR AS filename, turn::INT AS pos FROM c WHERE (SELECT count(DISTINCT line) FROM a WHERE a.doc_id = conv_id AND line BETWEEN s AND e) = e - s + 1")
def evidence_validation(spark, d):
    r = patch.ranges(patch.changed_lines(patch.parse(_mixed(spark, d))), ["filename"]).withColumn("seg_no", F.lit(0))
    none = spark.createDataFrame([], "filename string, seg_no int, id string, path string, start_line long, end_line long, content_complete boolean")
    return evidence.valid_findings(_findings(spark, d), r, none).select("filename", "pos")


@query("context_evidence", """WITH c AS (SELECT conv_id, turn, 20 + strlen(text) % 7 AS s, 20 + strlen(text) % 7 + strlen(text) % 3 AS e FROM conversations)
SELECT conv_id::VARCHAR AS filename, turn::INT AS pos FROM c WHERE conv_id % 2 = 0 AND s >= 21 AND e <= 25""")
def context_evidence(spark, d):
    f = _findings(spark, d)
    ev = F.transform("evidence", lambda e: e.withField("context_id", F.lit("c1")))
    f = f.withColumn("evidence", ev)
    given = f.select("filename").distinct().select("filename", F.lit(0).alias("seg_no"), F.lit("c1").alias("id"), F.col("filename").alias("path"), F.lit(21).cast("long").alias("start_line"), F.lit(25).cast("long").alias("end_line"), (F.col("filename").cast("long") % 2 == 0).alias("content_complete"))
    runs = spark.createDataFrame([], "filename string, seg_no int, start long, end long")
    return evidence.valid_findings(f, runs, given).select("filename", "pos")


_KEYED = r"""k AS (SELECT conv_id, turn, role, trim(regexp_replace(lower(text), '\W+', ' ', 'g')) AS title, 20 + strlen(text) % 7 AS s, 20 + strlen(text) % 7 + strlen(text) % 3 AS e FROM conversations)"""


@query("finding_dedup", f"WITH {_KEYED} SELECT conv_id::VARCHAR AS filename, min(turn)::INT AS pos, 'acr-' || substr(sha256(conv_id::VARCHAR || chr(0) || role || chr(0) || title || chr(0) || conv_id::VARCHAR || ':' || s::VARCHAR || ':' || e::VARCHAR), 1, 16) AS id FROM k GROUP BY conv_id, role, title, s, e")
def finding_dedup(spark, d):
    f = evidence.identified(evidence.deduplicate(_findings(spark, d), ["filename", "seg_no", "pos"]))
    return f.select("filename", "pos", "id")


@query("excerpt_hashes", "SELECT conv_id::VARCHAR AS filename, turn::INT AS pos, substr(sha256(conv_id::VARCHAR || ':' || (20 + strlen(text) % 7)::VARCHAR || ':' || (20 + strlen(text) % 7 + strlen(text) % 3)::VARCHAR || ':seg'), 1, 16) AS excerpt_hash FROM conversations")
def excerpt_hashes(spark, d):
    f = evidence.identified(_findings(spark, d), F.lit("seg"))
    return f.select("filename", "pos", F.get("evidence", F.lit(0))["excerpt_hash"].alias("excerpt_hash"))


@query("report_order", f"WITH {_KEYED}, i AS (SELECT *, 'acr-' || substr(sha256(conv_id::VARCHAR || chr(0) || role || chr(0) || title || chr(0) || conv_id::VARCHAR || ':' || s::VARCHAR || ':' || e::VARCHAR), 1, 16) AS id FROM k) SELECT conv_id::VARCHAR AS filename, turn::INT AS pos, row_number() OVER (PARTITION BY conv_id ORDER BY s, e, id, turn)::BIGINT AS place FROM i")
def report_order(spark, d):
    from pyspark.sql import Window

    f = evidence.identified(_findings(spark, d))
    w = Window.partitionBy("filename").orderBy(*evidence.report_order()[1:], "pos")
    return f.select("filename", "pos", F.row_number().over(w).cast("long").alias("place"))
