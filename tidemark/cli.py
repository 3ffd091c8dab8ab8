"""Command line: review a checkout or a pull request's saved pages. Exit codes 0, 1, 2 and 64."""

from __future__ import annotations

import argparse
import json
import sys

from tidemark.plans import report


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tidemark", exit_on_error=False)
    p.add_argument("pull", nargs="*", metavar="owner repo number")
    p.add_argument("--local", action="store_true")
    p.add_argument("--base")
    p.add_argument("--repo", default=".")
    p.add_argument("--pages", help="folder of saved API answers, by path")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--index", action="store_true", help="build repository context and exit")
    p.add_argument("--context", choices=["diff", "lexical", "hybrid"], default="lexical")
    p.add_argument("--format", choices=["text", "json", "sarif"], default="text")
    p.add_argument("--severity-threshold", choices=["high", "medium", "low", "none"], default="high")
    p.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="a setting of the review, such as max_files=50; may be repeated")
    return p


def main(argv: list[str] | None = None, model=None, embedding=None) -> int:
    try:
        a = parser().parse_args(argv)
        if a.local == bool(a.pull) or (a.pull and (len(a.pull) != 3 or not a.pull[2].isdigit() or int(a.pull[2]) < 1)) or (a.base and not a.local):
            raise ValueError("give either --local, or owner, repo and a positive number; --base needs --local")
        from tidemark.plans import review

        config = review.Config.of({k.strip(): v for k, _, v in (x.partition("=") for x in a.set)})
    except (argparse.ArgumentError, ValueError) as e:
        print(e, file=sys.stderr)
        return report.EXIT_USAGE
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from tidemark.plans import ports
    from tidemark.sources import changes, ignore, repository

    spark = SparkSession.builder.getOrCreate()
    try:
        if a.local:
            snapshot, files = changes.local_source(spark, a.repo, a.base)
        else:
            from pathlib import Path

            snapshot, files = changes.pull_source(spark, a.pull[0], a.pull[1], int(a.pull[2]), lambda p: Path(a.pages, p.strip("/").replace("/", "_").replace("?", "_").replace("&", "_")).read_text())
    except changes.SourceError as e:
        print(e, file=sys.stderr)
        return report.EXIT_FAILED
    text = None
    try:
        with open(f"{a.repo}/.tidemark-ignore") as f:
            text = f.read()
    except FileNotFoundError:
        pass
    rules = ignore.parse(text or "")
    chunks = None
    if a.context != "diff" or a.index:
        scanned = repository.scan(spark, f"file://{__import__('os').path.realpath(a.repo)}", rules)
        chunks = review.index_chunks(scanned.select("path", "content"), snapshot["repository_id"], snapshot["snapshot_id"], config.max_chunk_tokens)
    if a.index:
        print(f"Indexed {chunks.count()} repository context chunks.")
        return report.EXIT_OK
    result = review.review(spark, snapshot, files, model or ports.RuleModel([]), chunks, a.context, embedding or ports.HashEmbedding(), config, rules, a.dry_run)
    if a.format == "json":
        print(json.dumps(result, indent=2, default=str))
    elif a.format == "sarif":
        schema = "id string, filename string, severity string, category string, confidence string, title string, explanation string, evidence array<struct<path:string,start_line:bigint,end_line:bigint>>"
        rows = [{k: f[k] for k in ("id", "filename", "severity", "category", "confidence", "title", "explanation")} | {"evidence": [{k: e[k] for k in ("path", "start_line", "end_line")} for e in f["evidence"]]} for f in result["findings"]]
        print(report.sarif_document(spark.createDataFrame(rows, schema).orderBy(F.lit(1)), result))
    else:
        print(report.text_report(result))
    return report.exit_code(result["status"], [f["severity"] for f in result["findings"]], a.severity_threshold)


if __name__ == "__main__":
    sys.exit(main())
