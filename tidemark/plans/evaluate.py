"""Evaluation: labelled examples run through the review, and their metrics.

An example is a small repository of its own, so each is one review; the metrics are one plan over all of them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import SparkSession

from tidemark.operators import metrics
from tidemark.plans import review
from tidemark.sources.changes import FILES

SHOWN = 3


def run_example(spark: SparkSession, example: dict, mode: str, model, embedding=None, config: review.Config | None = None) -> dict:
    """{"result", "paths"} of an example {id, changedPath, patch, documents [{path, content}], ...}; paths: of the context that
    was shown, in order."""
    config = config or review.Config(top_k=SHOWN)
    config = replace(config, max_patch_tokens=example.get("maxPatchTokens") or config.max_patch_tokens, max_segments_per_file=example.get("maxSegmentsPerFile") or config.max_segments_per_file)
    files = spark.createDataFrame([(0, example["changedPath"], None, "modified", 1, 0, 1, example["patch"])], FILES)
    docs = spark.createDataFrame([(d["path"], d["content"]) for d in example["documents"]], "path string, content string")
    chunks = None if mode == "diff" else review.index_chunks(docs, example["id"], "r", config.max_chunk_tokens)
    return review.review(spark, {"title": example["id"]}, files, model, chunks, mode, embedding, config)


def evaluate(spark: SparkSession, examples: list[dict], mode: str, model, embedding=None) -> dict:
    """Recall and reciprocal rank of context, precision and recall of findings (by title), clean cases with a finding, coverage
    and statuses."""
    done = [(e, run_example(spark, e, mode, model, embedding)) for e in examples]
    number = {e["id"]: k for k, e in enumerate(examples)}
    pair = "query_id long, path string"
    shown = [(number[e["id"]], p, k) for e, r in done for k, p in enumerate(r["context"].get("paths", []), 1)]
    relevant = spark.createDataFrame([(number[e["id"]], p) for e in examples for p in e.get("relevantPaths", [])], pair)
    found = metrics.retrieval(spark.createDataFrame(shown, pair + ", rank int"), relevant).first()
    label = "case_id string, label string"
    actual = spark.createDataFrame([(e["id"], f["title"]) for e, r in done for f in r["findings"]], label)
    expected = spark.createDataFrame([(e["id"], x) for e in examples for x in e.get("expectedFindings", [])], label)
    counts = metrics.label_counts(actual, expected, ["case_id", "label"]).first()
    cases = spark.createDataFrame([(bool(e.get("clean")), len(r["findings"])) for e, r in done], "clean boolean, n_findings int")
    eligible = sum(r["coverage"]["eligible"] for _, r in done)
    full = sum(max(0, r["coverage"]["reviewed"] - r["coverage"]["truncated"]) for _, r in done)
    statuses = {s: sum(r["status"] == s for _, r in done) for s in ("complete", "partial", "failed")}
    return {"retrieval_recall": found.recall, "mrr": found.mrr, "precision": counts.precision, "recall": counts.recall, "tp": counts.tp, "fp": counts.fp, "fn": counts.fn, "clean_false_positive_rate": metrics.clean_false_positive_rate(cases).first()[0], "coverage": full / eligible if eligible else 1.0, "statuses": statuses}
