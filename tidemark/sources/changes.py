"""Changed files: from name-status output, from Git, and from pages of a pull request's files.

Everything ends as rows (ord, filename, previous_filename, status, additions, deletions, changes, patch)."""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import policy as P
from tidemark.functions import text as T
from tidemark.operators import patch as patches

FILES = "ord long, filename string, previous_filename string, status string, additions long, deletions long, changes long, patch string"
# Fixed words of a name-status letter.
STATUS = {"A": "added", "M": "modified", "D": "removed", "T": "changed", "C": "copied", "R": "renamed"}
PAGE_SIZE, MAX_FILES = 100, 3000
MAX_UNTRACKED_BYTES = 2 << 20


def status_word(letter: Column) -> Column:
    out = None
    for k, v in STATUS.items():
        if k != "R":
            out = (F if out is None else out).when(F.startswith(letter, F.lit(k)), v)
    return out.otherwise("modified")


def parse_lines(outputs: DataFrame) -> DataFrame:
    """(source, ord, status, previous_filename, filename) of outputs(source, output): one tab-separated entry a line."""
    d = outputs.select("source", F.posexplode(F.split("output", "\n")).alias("ord", "line")).where("line <> ''")
    p = F.split("line", "\t")
    renamed = F.startswith("line", F.lit("R"))
    name = F.when(renamed, F.get(p, F.lit(2))).otherwise(F.get(p, F.lit(1)))
    out = d.select("source", F.col("ord").cast("long").alias("ord"), F.when(renamed, "renamed").otherwise(status_word(F.get(p, F.lit(0)))).alias("status"), F.when(renamed, F.get(p, F.lit(1))).alias("previous_filename"), name.alias("filename"))
    return out.where(F.coalesce("filename", F.lit("")) != "")


def records(output: str) -> Iterator[tuple[str, str | None, str]]:
    """(status, previous name, name) of NUL-delimited entries; renames and copies take a field more."""
    fields = iter(output.removesuffix("\0").split("\0")) if output else iter(())
    for letter in fields:
        old = next(fields, "") if letter[:1] in ("R", "C") else None
        name = next(fields, "")
        if name:
            yield STATUS.get(letter[:1], "modified"), old, name


def parse_records(outputs: DataFrame) -> DataFrame:
    """parse_lines for NUL-delimited outputs."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            rows = [(s, k, *r) for s, o in zip(p["source"], p["output"], strict=True) for k, r in enumerate(records(o or ""))]
            yield pd.DataFrame(rows, columns=["source", "ord", "status", "previous_filename", "filename"])

    return outputs.select("source", "output").mapInPandas(run, "source string, ord long, status string, previous_filename string, filename string")


def tree_entries(listing: DataFrame) -> DataFrame:
    """(name, blob_id, size, symlink) of listing(output): NUL-delimited long tree entries."""
    e = listing.select(F.explode(F.split("output", "\u0000")).alias("e")).where("e <> ''")
    x = r"(?s)^(\d+) blob ([0-9a-f]+)\s+(\d+|-)\t(.*)$"
    g = lambda k: F.regexp_extract("e", x, k)
    return e.where(F.rlike("e", F.lit(x))).select(g(4).alias("name"), g(2).alias("blob_id"), g(3).try_cast("long").alias("size"), (g(1) == "120000").alias("symlink"))


def untracked(files: DataFrame) -> DataFrame:
    """FILES rows of new files(path, length, content binary): a refused, too large or binary one has no diff."""
    text = F.decode("content", "UTF-8")
    plain = (F.col("length") <= MAX_UNTRACKED_BYTES) & ~P.is_probably_binary(F.col("content")) & ~P.is_sensitive_path(F.col("path"))
    n = F.when(plain, T.count_lines(text)).otherwise(0)
    return files.select("path", F.lit(None).cast("string").alias("previous_filename"), F.lit("added").alias("status"), n.alias("additions"), F.lit(0).alias("deletions"), n.alias("changes"), F.when(plain, T.synthetic_add_patch(F.col("path"), text)).alias("patch")).withColumnRenamed("path", "filename")


class SourceError(Exception):
    def __init__(self, kind: str, message: str, source: str = "github", code: str | None = None) -> None:
        super().__init__(message)
        self.kind, self.source, self.code = kind, source, code


PULL_FILE = "filename string, previous_filename string, status string, additions long, deletions long, changes long, patch string"


def pull_files(spark: SparkSession, pages: list[str], expected: int) -> DataFrame:
    """FILES of a pull request from the JSON texts of its pages, in order. Each must be an array of file objects; a name
    twice means that the request moved, another count that it was not read whole."""
    if sum(1 for _ in pages) * PAGE_SIZE > MAX_FILES + PAGE_SIZE:
        raise SourceError("coverage_incomplete", f"more than {MAX_FILES} files")
    rows = spark.createDataFrame(list(enumerate(pages)), "page long, body string")
    d = rows.withColumn("f", F.from_json("body", f"array<struct<{', '.join(x.replace(' ', ':') for x in PULL_FILE.split(', '))}>>"))
    if d.where("f is null or exists(f, x -> x.filename is null or x.status is null)").limit(1).count():
        raise SourceError("invalid_response", "a page of files has another shape")
    d = d.select("page", F.posexplode("f").alias("pos", "x")).select((F.col("page") * PAGE_SIZE + F.col("pos")).alias("ord"), "x.*")
    if d.groupBy("filename").count().where("count > 1").limit(1).count():
        raise SourceError("revision_changed", "a file is listed twice")
    n = d.count()
    if n != expected:
        raise SourceError("coverage_incomplete", f"read {n} of {expected} files")
    return d


def pull_source(spark: SparkSession, owner: str, repo: str, number: int, request: Callable[[str], str]) -> tuple[dict, DataFrame]:
    """(snapshot, FILES) of a pull request. request: path to response text. Metadata is read again at the end; if the base,
    the head or the number of files moved, nothing is returned."""
    path = f"/repos/{owner}/{repo}/pulls/{number}"
    first = json.loads(request(path))
    n = first["changed_files"]
    pages = [request(f"{path}/files?per_page={PAGE_SIZE}&page={k + 1}") for k in range(-(-n // PAGE_SIZE))]
    files = pull_files(spark, pages, n)
    again = json.loads(request(path))
    state = lambda x: (x["base"]["sha"], x["head"]["sha"], x["changed_files"])
    if state(first) != state(again):
        raise SourceError("revision_changed", "the pull request moved while it was read")
    base, head, _ = state(first)
    snapshot = {"mode": "pr", "title": first.get("title") or "", "description": first.get("body") or "", "repository_id": f"{owner}/{repo}".lower(), "base_revision": base, "head_revision": head, "snapshot_id": hashlib.sha256(f"{base}:{head}".encode()).hexdigest(), "coverage_complete": True}
    return snapshot, files


def git(root: str, *args: str) -> str:
    env = {k: v for k, v in os.environ.items() if k not in ("GIT_EXTERNAL_DIFF", "GIT_DIFF_OPTS")}
    got = subprocess.run(["git", "--literal-pathspecs", *args], cwd=root, env=env, capture_output=True, text=True, check=False)
    if got.returncode:
        code = "not_a_repository" if "not a git repository" in got.stderr.lower() else "invalid_ref" if "unknown revision" in got.stderr else None
        raise SourceError("configuration" if code else "unknown", f"git {args[0]} failed", "git", code)
    return got.stdout


def local_source(spark: SparkSession, root: str, base: str | None = None) -> tuple[dict, DataFrame]:
    """(snapshot, FILES) of a checkout against HEAD or the merge base with a reference. A refused path's bytes are not read."""
    root = git(root, "rev-parse", "--show-toplevel").strip()
    head = git(root, "rev-parse", "HEAD").strip()
    start = git(root, "merge-base", "HEAD", base).strip() if base else head
    from tidemark.sources.guard import inspect_regular_file, is_sensitive

    rows = []
    for word, old, name in records(git(root, "diff", "--name-status", "-z", "-M", start)):
        refused = is_sensitive(name) or (old is not None and is_sensitive(old))
        text = None if refused else git(root, "diff", "--no-color", "--no-ext-diff", "-M", start, "--", *([old] if old else []), name) or None
        rows.append((len(rows), name, old, word, text))
    tracked = spark.createDataFrame(rows, "ord long, filename string, previous_filename string, status string, patch string")
    counts = patches.stats(tracked)
    tracked = tracked.join(counts, "filename", "left").select("ord", "filename", "previous_filename", "status", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("additions", "deletions", "changes")], "patch")
    new = []
    for name in filter(None, git(root, "ls-files", "-z", "--others", "--exclude-standard").split("\0")):
        try:
            size, _ = inspect_regular_file(root, name)
            data = b"" if is_sensitive(name) or size > MAX_UNTRACKED_BYTES else open(os.path.join(root, name), "rb").read()
        except (OSError, ValueError):
            size, data = MAX_UNTRACKED_BYTES + 1, b""
        new.append((len(rows) + len(new), name, size, data))
    added = spark.createDataFrame(new, "ord long, path string, length long, content binary")
    added = untracked(added.drop("ord")).join(added.select("ord", F.col("path").alias("filename")), "filename").select(*[c.split()[0] for c in FILES.split(", ")])
    files = tracked.unionByName(added)
    # a digest of every row's, in an order of their own: no patch leaves its task
    row = F.sha2(F.to_json(F.struct("filename", "status", F.sha2("patch", 256).alias("patch"))), 256)
    bits = [F.bit_xor(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("long")) for k in range(4)]
    names = json.dumps([files.count(), *files.agg(*bits).first()])
    snapshot = {"mode": "local", "title": "Local changes", "description": "", "repository_id": hashlib.sha256(os.path.realpath(root).lower().encode()).hexdigest(), "base_revision": start, "head_revision": head, "snapshot_id": hashlib.sha256((head + names).encode()).hexdigest(), "coverage_complete": True, "root": root}
    return snapshot, files
