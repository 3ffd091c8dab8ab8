"""Usage, status codes, retry timing, quality metrics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import status as S
from tidemark.operators import admission, metrics
from tidemark.plans import report
from tidemark.plans.registry import query, table


def _status(spark, d):
    k = F.col("l_linenumber")
    codes = [200, 401, 403, 404, 408, 409, 429, 500, 503, 400, 302]
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.get(F.array(*map(F.lit, codes)), ((F.col("l_orderkey") + k) % len(codes)).cast("int")).alias("status"))
    return t.withColumns({"remaining": F.when(F.col("l_orderkey") % 3 == 0, "0").otherwise("10"), "after": F.when(F.col("l_orderkey") % 5 == 0, "7").when(F.col("l_orderkey") % 5 == 1, "Wed, 21 Oct 2026 07:28:00 GMT").when(F.col("l_orderkey") % 5 == 2, "-4")})


_STATUS = """s AS (SELECT l_orderkey, l_linenumber, ([200, 401, 403, 404, 408, 409, 429, 500, 503, 400, 302])[((l_orderkey + l_linenumber) % 11 + 1)::INT] AS status, CASE WHEN l_orderkey % 3 = 0 THEN '0' ELSE '10' END AS remaining, CASE WHEN l_orderkey % 5 = 0 THEN 7000 WHEN l_orderkey % 5 = 1 THEN 1792567680000 - 1792567000000 END AS after_ms FROM lineitem)"""


@query("error_codes", f"WITH {_STATUS} SELECT l_orderkey, l_linenumber, CASE WHEN status IN (401, 403) THEN 'authentication' WHEN status = 404 THEN 'unsupported_model' WHEN status = 408 THEN 'timeout' WHEN status = 429 THEN 'rate_limit' WHEN status = 409 OR status >= 500 THEN 'provider_unavailable' WHEN status >= 400 THEN 'invalid_request' ELSE 'unknown' END AS kind, CASE WHEN status = 429 OR (status = 403 AND (remaining = '0' OR after_ms IS NOT NULL)) THEN 'rate_limit' WHEN status = 401 THEN 'authentication' WHEN status = 403 THEN 'authorization' WHEN status = 404 THEN 'not_found' WHEN status = 408 THEN 'timeout' WHEN status >= 500 THEN 'provider_unavailable' ELSE 'unknown' END AS source_kind FROM s")
def error_codes(spark, d):
    t = _status(spark, d)
    after = S.retry_after_ms(F.col("after"), F.lit(1792567000000))
    return t.select("l_orderkey", "l_linenumber", S.kind_of_status(F.col("status")).alias("kind"), S.kind_of_source_response(F.col("status"), F.col("remaining"), after, F.lit(None).cast("string")).alias("source_kind"))


_KINDS = ["aborted", "timeout", "network", "configuration", "authentication", "authorization", "not_found", "rate_limit", "provider_unavailable", "invalid_response", "revision_changed", "coverage_incomplete", "unknown"]


@query("source_error_codes", "WITH s AS (SELECT p_partkey, (" + str(_KINDS) + ")[(p_partkey % 13 + 1)::INT] AS kind, CASE WHEN p_partkey % 2 = 0 THEN 'git' ELSE 'github' END AS source, CASE WHEN p_partkey % 3 = 0 THEN 'not_a_repository' WHEN p_partkey % 3 = 1 THEN 'no_merge_base' END AS code FROM part) SELECT p_partkey, CASE WHEN kind = 'aborted' THEN 'REVIEW_ABORTED' WHEN kind = 'timeout' THEN 'SOURCE_TIMEOUT' WHEN kind = 'network' THEN 'SOURCE_NETWORK' WHEN source = 'git' AND code = 'not_a_repository' THEN 'GIT_NOT_A_REPOSITORY' WHEN source = 'git' AND code = 'no_merge_base' THEN 'GIT_INVALID_REF' WHEN kind = 'configuration' THEN 'SOURCE_CONFIGURATION' WHEN source = 'git' THEN 'GIT_COMMAND_FAILED' WHEN kind IN ('authentication', 'authorization') THEN 'GITHUB_' || upper(kind) || '_FAILED' WHEN kind = 'unknown' THEN 'SOURCE_FAILED' ELSE 'GITHUB_' || upper(kind) END AS source_code, 'MODEL_' || upper(kind) AS model_code FROM s")
def source_error_codes(spark, d):
    k = F.col("p_partkey")
    t = table(spark, d, "part").select("p_partkey", F.get(F.array(*map(F.lit, _KINDS)), (k % 13).cast("int")).alias("kind"), F.when(k % 2 == 0, "git").otherwise("github").alias("source"), F.when(k % 3 == 0, "not_a_repository").when(k % 3 == 1, "no_merge_base").alias("code"))
    return t.select("p_partkey", S.source_error_code(F.col("kind"), F.col("source"), F.col("code")).alias("source_code"), S.prefixed_code("MODEL", F.col("kind")).alias("model_code"))


@query("cost_and_allowance", "SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_suppkey % 3 <> 0 THEN round((l_partkey * 2.5 + l_suppkey * 10.0) / 1e6, 9)::DOUBLE END AS cost, greatest(0, least(1800, 6800 - l_partkey * 7))::BIGINT AS allowance, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE 2 * (1.0::DOUBLE / 3) END AS twice FROM lineitem")
def cost_and_allowance(spark, d):
    t = table(spark, d, "lineitem")
    p, k = F.col("l_partkey"), F.col("l_suppkey")
    return t.select("l_orderkey", "l_linenumber", "l_suppkey", F.round(S.cost(p, k, k % 3 == 0, 2.5, 10.0), 9).alias("cost"), S.context_allowance(p * 7, 6800, 1800).alias("allowance"), (2 * S.ratio(F.lit(1), F.when(k % 3 == 0, 0).otherwise(3))).alias("twice"))


@query("retry_after", f"WITH {_STATUS} SELECT l_orderkey, l_linenumber, after_ms::BIGINT AS after_ms, CASE WHEN status = 429 OR (status = 403 AND (remaining = '0' OR after_ms IS NOT NULL)) THEN coalesce(after_ms, CASE WHEN remaining = '0' THEN 1000 END, CASE WHEN status = 403 THEN 60000 END) END::BIGINT AS wait_ms FROM s")
def retry_after(spark, d):
    t, now = _status(spark, d), F.lit(1792567000000)
    t = t.withColumn("after_ms", S.retry_after_ms(F.col("after"), now))
    kind = S.kind_of_source_response(F.col("status"), F.col("remaining"), F.col("after_ms"), F.lit(None).cast("string"))
    return t.select("l_orderkey", "l_linenumber", "after_ms", S.source_wait_ms(kind, F.col("status"), F.col("after_ms"), F.col("remaining"), F.lit(1792567001), now).alias("wait_ms"))


@query("retry_delays", "SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 4 = 0 AND l_suppkey > 0 THEN least(l_suppkey * 40, 8000) ELSE floor(least(500 * 2.0 ** least(l_linenumber - 1, 30), 8000.0) / 2 + (l_suppkey % 100) / 100.0 * least(500 * 2.0 ** least(l_linenumber - 1, 30), 8000.0) / 2) END::BIGINT AS delay_ms, least(250 * 2.0 ** (l_linenumber - 1), 2000.0)::BIGINT AS backoff_ms FROM lineitem")
def retry_delays(spark, d):
    t = table(spark, d, "lineitem")
    n, k = F.col("l_linenumber"), F.col("l_suppkey")
    return t.select("l_orderkey", "l_linenumber", S.retry_delay_ms(n, 500, 8000, F.when(k % 4 == 0, k * 40), (k % 100) / 100.0).alias("delay_ms"), S.model_backoff_ms(n, F.lit(None).cast("long")).alias("backoff_ms"))


@query("usage_rollup", "SELECT event_type, count(*)::BIGINT AS requests, sum(event_id % 7)::BIGINT AS input_tokens, bool_or(event_id % 1000 = 3) AS estimated FROM events GROUP BY event_type")
def usage_rollup(spark, d):
    e = table(spark, d, "events").select("event_type", F.lit(1).alias("requests"), (F.col("event_id") % 7).alias("input_tokens"), (F.col("event_id") % 1000 == 3).alias("estimated"))
    return admission.add_usage(e, ["event_type"])


def _first_lines(spark, d):
    """One row per order and line number, which repeat in the table."""
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"))


@query("request_budget", "WITH e AS (SELECT l_orderkey AS run, l_linenumber AS ord, min(l_suppkey) % 2 = 0 AS emb FROM lineitem GROUP BY 1, 2), a AS (SELECT *, sum(emb::INT) OVER (PARTITION BY run ORDER BY ord) AS en FROM e), b AS (SELECT *, sum((NOT emb OR en <= 1)::INT) OVER (PARTITION BY run ORDER BY ord) AS n FROM a) SELECT run, ord, (NOT emb OR en <= 1) AND n <= 3 AS granted FROM b")
def request_budget(spark, d):
    t = _first_lines(spark, d).select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("ord"), F.when(F.col("l_suppkey") % 2 == 0, "embedding").otherwise("model").alias("kind"))
    return admission.within_budget(t, 3, 1).select("run", "ord", "granted")


@query("first_failed_cut", "WITH u AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2), s AS (SELECT l_orderkey, l_linenumber, coalesce(max((l_suppkey % 5 = 0)::INT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM u) SELECT l_orderkey::VARCHAR AS filename, l_linenumber AS seg_no FROM s WHERE f = 0")
def first_failed_cut(spark, d):
    t = _first_lines(spark, d).select(F.col("l_orderkey").cast("string").alias("filename"), F.col("l_linenumber").alias("seg_no"), (F.col("l_suppkey") % 5 == 0).alias("failed"))
    return admission.first_failed_cut(t).select("filename", "seg_no")


_CASES = """c AS (SELECT doc_id, quality = 1 AS clean, CASE WHEN doc_id % 19 = 0 THEN 'provider-failed' WHEN doc_id % 17 = 0 THEN 'truncated' WHEN doc_id % 13 = 0 THEN 'invalid-evidence' WHEN doc_id % 11 = 0 THEN 'invalid-output' ELSE 'scored' END AS outcome, doc_id % 8 = 0 AS abstained, doc_id % 3 AS n_expected, doc_id % 4 AS n_observed, least(doc_id % 3, doc_id % 4) AS n_matched, doc_id % 5 AS n_raw FROM labels)"""


@query("live_metrics", f"WITH {_CASES}, m AS (SELECT *, outcome NOT IN ('provider-failed', 'truncated') AS judged, CASE WHEN outcome = 'scored' THEN n_matched ELSE 0 END AS t, CASE WHEN outcome = 'scored' THEN n_observed - n_matched ELSE 0 END AS f FROM c), a AS (SELECT clean, count(*) AS cases, count(*) FILTER (judged) AS scored_cases, sum(t)::BIGINT AS tp, sum(f)::BIGINT AS fp, sum(CASE WHEN judged THEN n_expected - t ELSE 0 END)::BIGINT AS fn, count(*) FILTER (outcome = 'scored' AND NOT abstained AND n_observed = 0) AS clean_success, sum(CASE WHEN outcome = 'invalid-evidence' THEN n_raw ELSE 0 END)::DOUBLE / sum(CASE WHEN judged THEN n_raw ELSE 0 END) AS invalid_evidence_rate, count(*) FILTER (judged AND abstained)::DOUBLE / count(*) FILTER (judged) AS abstention_rate FROM m GROUP BY clean) SELECT *, round(tp::DOUBLE / (tp + fp), 9) AS precision, round(tp::DOUBLE / (tp + fn), 9) AS recall, round(2 * (tp::DOUBLE / (tp + fp)) * (tp::DOUBLE / (tp + fn)) / (tp::DOUBLE / (tp + fp) + tp::DOUBLE / (tp + fn)), 9) AS f1 FROM a")
def live_metrics(spark, d):
    k = F.col("doc_id")
    out = F.when(k % 19 == 0, True).otherwise(False), F.when(k % 17 == 0, True).otherwise(False), k % 13 == 0, k % 11 == 0
    t = table(spark, d, "labels").select((F.col("quality") == 1).alias("clean"), metrics.outcome(*out).alias("outcome"), (k % 8 == 0).alias("abstained"), (k % 3).alias("n_expected"), (k % 4).alias("n_observed"), F.least(k % 3, k % 4).alias("n_matched"), (k % 5).alias("n_raw"), F.lit(0).alias("input_tokens"), F.lit(0).alias("output_tokens"), F.lit(False).alias("estimated"), F.lit(1).alias("requests"), F.lit(2).alias("latency_ms"))
    got = metrics.live(t, ["clean"])
    nine = {c: F.round(c, 9) for c in ("precision", "recall", "f1")}
    return got.withColumns(nine).select("clean", "cases", "scored_cases", "tp", "fp", "fn", "clean_success", "invalid_evidence_rate", "abstention_rate", "precision", "recall", "f1")


@query("upper_median", "SELECT event_type, list_sort(list(event_id % 1009))[(count(*) // 2 + 1)::INT] AS median, round(avg(event_id % 1009), 9) AS mean FROM events GROUP BY event_type")
def upper_median(spark, d):
    e = table(spark, d, "events").select("event_type", (F.col("event_id") % 1009).alias("v"))
    return metrics.upper_median(e, ["event_type"], "v").withColumn("mean", F.round("mean", 9))


@query("label_counts", "WITH a AS (SELECT doc_id FROM labels WHERE toxic = 1), e AS (SELECT doc_id FROM labels WHERE quality = 0), j AS (SELECT a.doc_id AS a, e.doc_id AS e FROM a FULL JOIN e USING (doc_id)), c AS (SELECT count(*) FILTER (a IS NOT NULL AND e IS NOT NULL) AS tp, count(*) FILTER (e IS NULL) AS fp, count(*) FILTER (a IS NULL) AS fn FROM j) SELECT *, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / (tp + fn) AS recall FROM c")
def label_counts(spark, d):
    t = table(spark, d, "labels")
    return metrics.label_counts(t.where("toxic = 1"), t.where("quality = 0"), ["doc_id"])


_OV = """x AS (SELECT o_custkey AS case_id, o_orderkey AS e_no, (o_custkey % 3)::VARCHAR AS path, o_orderkey % 200 AS s, o_orderkey % 200 + 5 AS e FROM orders WHERE o_orderstatus = 'F'),
o AS (SELECT o_custkey AS case_id, o_orderkey AS o_no, (o_custkey % 3)::VARCHAR AS path, o_orderkey % 200 AS s, o_orderkey % 200 + 9 AS e FROM orders WHERE o_orderstatus <> 'F')"""


def _overlap(spark, d):
    t = table(spark, d, "orders")
    k, p = F.col("o_orderkey"), (F.col("o_custkey") % 3).cast("string").alias("path")
    x = t.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("case_id"), k.alias("e_no"), p, (k % 200).alias("start_line"), (k % 200 + 5).alias("end_line"), F.lit(None).cast("array<string>").alias("categories"))
    o = t.where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("case_id"), k.alias("o_no"), F.lit("c").alias("category"), p, (k % 200).alias("start_line"), (k % 200 + 9).alias("end_line"))
    return x, o


@query("interval_overlap", f"WITH {_OV} SELECT x.case_id, e_no, o_no FROM x JOIN o ON x.case_id = o.case_id AND x.path = o.path AND o.s <= x.e AND x.s <= o.e")
def interval_overlap(spark, d):
    return metrics.overlaps(*_overlap(spark, d))


@query("greedy_match", f"""WITH RECURSIVE {_OV},
m AS (SELECT x.case_id, e_no, list(o_no ORDER BY o_no) AS os, row_number() OVER (PARTITION BY x.case_id ORDER BY e_no) AS k FROM x JOIN o ON x.case_id = o.case_id AND x.path = o.path AND o.s <= x.e AND x.s <= o.e GROUP BY x.case_id, e_no),
g(case_id, k, e_no, o_no, taken) AS (SELECT case_id, k, e_no, os[1], [os[1]] FROM m WHERE k = 1
  UNION ALL SELECT m.case_id, m.k, m.e_no, list_filter(m.os, lambda v: NOT list_contains(g.taken, v))[1], list_append(g.taken, list_filter(m.os, lambda v: NOT list_contains(g.taken, v))[1]) FROM g JOIN m ON m.case_id = g.case_id AND m.k = g.k + 1)
SELECT case_id, e_no, o_no FROM g WHERE o_no IS NOT NULL""")
def greedy_match(spark, d):
    return metrics.match(*_overlap(spark, d))


@query("sarif", "SELECT conv_id::VARCHAR AS filename, turn::INT AS pos, CASE WHEN turn % 3 = 0 THEN 'error' WHEN turn % 3 = 1 THEN 'warning' ELSE 'note' END AS level, role AS rule_id, conv_id::VARCHAR AS uri FROM conversations")
def sarif(spark, d):
    c = table(spark, d, "conversations")
    ev = F.array(F.struct(F.col("conv_id").cast("string").alias("path"), F.lit(1).cast("long").alias("start_line"), F.lit(2).cast("long").alias("end_line")))
    f = c.select(F.col("conv_id").cast("string").alias("filename"), F.col("turn").cast("int").alias("pos"), F.when(F.col("turn") % 3 == 0, "high").when(F.col("turn") % 3 == 1, "medium").otherwise("low").alias("severity"), F.col("role").alias("category"), F.lit("high").alias("confidence"), F.lit("t").alias("title"), F.lit("e").alias("explanation"), F.lit("id").alias("id"), ev.alias("evidence"))
    r = report.sarif_results(f)
    return r.select("filename", "pos", "result.level", F.col("result.ruleId").alias("rule_id"), F.get("result.locations", F.lit(0))["physicalLocation"]["artifactLocation"]["uri"].alias("uri"))


@query("sarif_rules", "SELECT list_sort(list(DISTINCT role))::VARCHAR AS rules FROM conversations")
def sarif_rules(spark, d):
    r = table(spark, d, "conversations").agg(F.array_sort(F.collect_set("role")).alias("r"))
    return r.select(F.concat(F.lit("["), F.array_join("r", ", "), F.lit("]")).alias("rules"))


@query("severity_gate", "SELECT conv_id, CASE WHEN conv_id % 9 = 0 THEN 2 WHEN bool_or(turn % 3 <> 2) THEN 1 ELSE 0 END::INT AS exit_code FROM conversations GROUP BY conv_id")
def severity_gate(spark, d):
    c = table(spark, d, "conversations").withColumn("severity", F.when(F.col("turn") % 3 == 0, "high").when(F.col("turn") % 3 == 1, "medium").otherwise("low"))
    g = c.groupBy("conv_id").agg(F.bool_or(S.severity_rank(F.col("severity")) >= 2).alias("hit"))
    return g.select("conv_id", S.exit_code(F.when(F.col("conv_id") % 9 == 0, "partial").otherwise("complete"), F.col("hit")).alias("exit_code"))
