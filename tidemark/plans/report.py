"""Reports: SARIF, JSON, text and the exit code."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SARIF_VERSION, SARIF_SCHEMA = "2.1.0", "https://json.schemastore.org/sarif-2.1.0.json"
RANKS = {"low": 1, "medium": 2, "high": 3}
EXIT_OK, EXIT_FINDINGS, EXIT_FAILED, EXIT_USAGE = 0, 1, 2, 64


def sarif_results(findings: DataFrame) -> DataFrame:
    """findings with result: a SARIF result each; only the first citation is its location."""
    e = F.get("evidence", F.lit(0))
    place = F.struct(F.struct(F.struct(e["path"].alias("uri")).alias("artifactLocation"), F.struct(e["start_line"].alias("startLine"), e["end_line"].alias("endLine")).alias("region")).alias("physicalLocation"))
    level = F.when(F.col("severity") == "high", "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    result = F.struct(
        F.col("category").alias("ruleId"), level.alias("level"), F.struct(F.concat("title", F.lit(": "), "explanation").alias("text")).alias("message"),
        F.struct(F.col("id").alias("stableId")).alias("partialFingerprints"), F.struct("confidence", "evidence").alias("properties"),
        F.when(F.size("evidence") > 0, F.array(place)).otherwise(F.array().cast("array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:bigint,endLine:bigint>>>>")).alias("locations"),
    )
    return findings.withColumn("result", result)


def sarif_document(findings: DataFrame, run: dict, name: str = "tidemark", version: str = "1.5.0") -> str:
    """The SARIF file of one review: its findings are bounded by the review's own limits."""
    rows = [json.loads(r[0]) for r in sarif_results(findings).select(F.to_json("result")).collect()]
    rules = list(dict.fromkeys(r["ruleId"] for r in rows))
    notes = [{"level": "error" if e.get("fatal") else "warning", "message": {"text": f"{e['stage']}: {e['message']}"}} | ({"descriptor": {"id": e["code"]}} if e.get("code") else {}) for e in run.get("errors", [])]
    notes += [{"level": "warning", "message": {"text": f"{x['stage']}: {x['message']}"}} for x in run.get("degradations", []) if not x.get("code")]
    props = {k: run.get(k) for k in ("status", "coverage", "usage", "run_id", "context", "abstentions")}
    driver = {"name": name, "version": version, "rules": [{"id": r, "name": r} for r in rules]}
    body = {"tool": {"driver": driver}, "invocations": [{"executionSuccessful": run.get("status") == "complete", "properties": props, "toolExecutionNotifications": notes}], "results": rows}
    return json.dumps({"version": SARIF_VERSION, "$schema": SARIF_SCHEMA, "runs": [body]}, indent=2)


def exit_code(status: str, severities: list[str], threshold: str) -> int:
    if status != "complete":
        return EXIT_FAILED
    return EXIT_FINDINGS if threshold != "none" and any(RANKS[s] >= RANKS[threshold] for s in severities) else EXIT_OK


def text_report(result: dict) -> str:
    c = result["coverage"]
    out = [f"SUMMARY\n{result['summary']}", f"Status: {result['status']}", "Coverage: " + ", ".join(f"{k}={c[k]}" for k in ("discovered", "eligible", "attempted", "reviewed", "failed", "skipped", "omitted", "truncated")), "\nFINDINGS"]
    if not result["findings"]:
        out.append("none; that speaks for the code only if the status is complete and files were reviewed")
    for i, f in enumerate(result["findings"], 1):
        first = f["evidence"][0]["start_line"] if f["evidence"] else "?"
        out += [f"{i}. [{f['severity'].upper()}] {f['filename']}:{first} {f['title']} ({f['category']}, confidence={f['confidence']}, id={f['id']})", f"   {f['explanation']}"]
        if f.get("suggestion"):
            out.append(f"   Suggestion: {f['suggestion']}")
    return "\n".join(out)
