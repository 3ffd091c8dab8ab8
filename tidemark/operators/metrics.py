"""Retrieval and finding quality."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import status as S


def best_ranks(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, best): the best rank of a relevant path, null if none was ranked. ranked: (query_id, path, rank from
    1); relevant: (query_id, path)."""
    j = relevant.join(ranked, ["query_id", "path"], "left")
    return j.groupBy("query_id").agg(F.min("rank").alias("best"))


def retrieval(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """One row: queries, recall (any relevant path ranked), mrr."""
    b = best_ranks(ranked, relevant)
    return b.agg(F.count("*").alias("queries"), S.ratio(F.count("best"), F.count("*")).alias("recall"), S.ratio(F.coalesce(F.sum(1 / F.col("best")), F.lit(0.0)), F.count("*")).alias("mrr"))


def label_counts(actual: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """One row: tp, fp, fn, precision, recall of two sets of rows."""
    a, e = actual.select(*keys).distinct().withColumn("a", F.lit(1)), expected.select(*keys).distinct().withColumn("e", F.lit(1))
    j = a.join(e, keys, "full")
    has = lambda c: F.col(c).isNotNull()
    out = j.agg(F.count_if(has("a") & has("e")).alias("tp"), F.count_if(has("a") & ~has("e")).alias("fp"), F.count_if(~has("a") & has("e")).alias("fn"))
    return out.withColumns({"precision": S.ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": S.ratio(F.col("tp"), F.col("tp") + F.col("fn"))})


def clean_false_positive_rate(cases: DataFrame) -> DataFrame:
    """Of cases(clean, n_findings): the share of clean cases with a finding."""
    return cases.agg(S.ratio(F.count_if(F.col("clean") & (F.col("n_findings") > 0)), F.count_if("clean")).alias("clean_fp_rate"))


def overlaps(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(case_id, e_no, o_no): an evidence range of the observed finding overlaps the expected range on its path, and its
    category is one of the expected, if any. expected: (case_id, e_no, path, start_line, end_line, categories);
    observed: (case_id, o_no, category, path, start_line, end_line) per range. An equi-join on case and path."""
    e = expected.select("case_id", "path", "e_no", F.col("start_line").alias("e_start"), F.col("end_line").alias("e_end"), "categories")
    j = observed.join(e, ["case_id", "path"]).where((F.col("start_line") <= F.col("e_end")) & (F.col("e_start") <= F.col("end_line")))
    fits = F.coalesce(F.size("categories") <= 0, F.lit(True)) | F.array_contains("categories", F.col("category"))
    return j.where(F.coalesce(fits, F.lit(True))).select("case_id", "e_no", "o_no").distinct()


def match(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(case_id, e_no, o_no): one-to-one, each expected finding in order taking the first free observed one."""

    def greedy(p: pd.DataFrame) -> pd.DataFrame:
        taken: set = set()
        rows = []
        for e, g in p.sort_values(["e_no", "o_no"]).groupby("e_no", sort=True):
            o = next((x for x in g["o_no"] if x not in taken), None)
            if o is not None:
                taken.add(o)
                rows.append((p["case_id"].iloc[0], e, o))
        return pd.DataFrame(rows, columns=["case_id", "e_no", "o_no"])

    pairs = overlaps(expected, observed)
    return pairs.groupBy("case_id").applyInPandas(greedy, pairs.schema)


def error_flags(errors: DataFrame, keys: list[str]) -> DataFrame:
    """Of errors(keys, code): which kinds of failure a case had; an unknown code is the provider's."""
    code = F.coalesce("code", F.lit(""))
    known = {"invalid_evidence": "MODEL_INVALID_EVIDENCE", "invalid_output": "MODEL_MALFORMED_RESPONSE", "truncated": "MODEL_RESPONSE_TRUNCATED"}
    flags = [F.bool_or(code == v).alias(k) for k, v in known.items()]
    return errors.groupBy(*keys).agg(F.bool_or(~code.isin(*known.values())).alias("provider_failed"), *flags)


def outcome(provider_failed: Column, truncated: Column, invalid_evidence: Column, invalid_output: Column) -> Column:
    return F.when(provider_failed, "provider-failed").when(truncated, "truncated").when(invalid_evidence, "invalid-evidence").when(invalid_output, "invalid-output").otherwise("scored")


def live(cases: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics per group of scored cases(outcome, clean, abstained, n_expected, n_observed, n_matched, n_raw, input_tokens,
    output_tokens, estimated, requests, latency_ms). A case without a usable answer delivers nothing; one of the
    provider's failures is not judged."""
    judged = ~F.col("outcome").isin("provider-failed", "truncated")
    scored = F.col("outcome") == "scored"
    tp = F.when(scored, F.col("n_matched")).otherwise(0)
    fp = F.when(scored, F.col("n_observed") - F.col("n_matched")).otherwise(0)
    fn = F.when(judged, F.col("n_expected") - tp).otherwise(0)
    n = lambda c, name: F.count_if(c).alias(name)
    out = cases.groupBy(*keys).agg(
        F.count("*").alias("cases"), n(judged, "scored_cases"),
        *[n(F.col("outcome") == o, o.replace("-", "_")) for o in ("scored", "invalid-evidence", "invalid-output", "truncated", "provider-failed")],
        n(scored & F.col("abstained"), "abstained"), n(scored & ~F.col("abstained") & (F.col("n_observed") == 0), "clean_success"),
        F.sum(tp).alias("tp"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn"), F.sum(F.when(F.col("clean"), fp).otherwise(0)).alias("clean_fp"),
        S.ratio(F.sum(F.when(F.col("outcome") == "invalid-evidence", F.col("n_raw")).otherwise(0)), F.sum(F.when(judged, F.col("n_raw")).otherwise(0))).alias("invalid_evidence_rate"),
        S.ratio(F.count_if(judged & F.col("abstained")), F.count_if(judged)).alias("abstention_rate"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.bool_or("estimated").alias("tokens_estimated"), F.sum("requests").alias("requests"),
        F.sum("latency_ms").alias("latency_total"), S.ratio(F.sum("latency_ms"), F.count("*")).alias("latency_mean"),
    )
    out = out.withColumns({"precision": S.ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": S.ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", S.f1(F.col("precision"), F.col("recall")))


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median, mean): the element at floor(n / 2) of the sorted values, exactly. Two approximate quantiles close
    around the middle leave a thousandth or so of a group's values, which are counted and ranked; the others are only
    counted, so a group that holds most rows is no hot task."""
    from pyspark.sql import Window

    d = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    near = d.groupBy(*keys).agg(F.count("*").alias("__n"), F.avg("__v").alias("mean"), F.percentile_approx("__v", [0.499, 0.501], 10_000).alias("__q"))
    d = d.join(near, keys).where(F.col("__v") <= F.col("__q")[1])
    d = d.groupBy(*keys, F.when(F.col("__v") >= F.col("__q")[0], F.col("__v")).alias("__v")).agg(F.count("*").alias("__c"), F.first("__n").alias("__n"), F.first("mean").alias("mean"))
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("__v"))
    d = d.withColumn("__upto", F.sum("__c").over(w))
    half = F.floor(F.col("__n") / 2)
    return d.where(F.col("__v").isNotNull() & (F.col("__upto") > half) & (F.col("__upto") - F.col("__c") <= half)).select(*keys, F.col("__v").alias("median"), "mean")
