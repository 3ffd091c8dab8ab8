"""Admission of changed files: the first rule that applies decides; then counts, coverage and status.

files: (ord, filename, previous_filename, patch)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import policy as P

MAX_FILES = 100


def admit(files: DataFrame, ignored: Column | None = None, ignored_origin: Column | None = None, plannable: Column | None = None, max_files: int = MAX_FILES, policy_path: str = ".tidemark-ignore") -> DataFrame:
    """files with file_type, decision (admitted or skipped), reason, details, eligible, omitted and blocked.

    ignored, ignored_origin: whether the ignore rules cover the file, or the one it was renamed from; plannable: whether
    its diff can be cut into requests. A file takes one of max_files places only if it is plannable."""
    no = F.lit(False)
    ignored, origin = (no if ignored is None else ignored), (no if ignored_origin is None else ignored_origin)
    plannable = F.lit(True) if plannable is None else plannable
    d = files.withColumn("file_type", P.classify(F.col("filename")))
    d = d.withColumn("__privacy", P.privacy(F.col("filename"), F.col("previous_filename"), F.col("patch")))
    why = lambda reason, details: F.struct(F.lit(reason).alias("reason"), (details if isinstance(details, Column) else F.lit(details)).alias("details"))
    early = (
        F.when(F.col("__privacy").isNotNull(), F.col("__privacy"))
        .when(origin, why("ignored_by_user", f"its former path is named in {policy_path}"))
        .when(ignored, why("ignored_by_user", f"named in {policy_path}"))
        .when(F.col("file_type") == "generated", why("generated_file", "made by a tool, not written"))
        .when(~P.is_reviewable(F.col("file_type")), why("unsupported_file_type", F.concat(F.lit("type: "), F.col("file_type"))))
    )
    d = d.withColumn("__early", early).withColumn("eligible", F.col("__early").isNull())
    has_patch = F.coalesce(F.col("patch"), F.lit("")) != ""
    takes = F.col("eligible") & has_patch & plannable
    d = _places_before(d.withColumn("__takes", takes.cast("long")))
    late = F.when(F.col("eligible") & ~has_patch, why("missing_patch", "the source gave no text of the diff")).when(F.col("eligible") & (F.col("__before") >= max_files), why("work_limit", f"{max_files} files are already taken")).when(F.col("eligible") & ~plannable, why("work_limit", "no part of the diff is small enough for a request"))
    d = d.withColumn("__late", late).withColumn("__why", F.coalesce("__early", "__late"))
    d = d.withColumns({"decision": F.when(F.col("__why").isNull(), "admitted").otherwise("skipped"), "reason": F.col("__why.reason"), "details": F.col("__why.details"), "omitted": F.col("__late").isNotNull(), "blocked": F.coalesce(F.col("__early.reason").isin("sensitive_path", "sensitive_content", "ignored_by_user"), F.lit(False))})
    return d.drop("__privacy", "__early", "__late", "__why", "__takes", "__before")


#: Rows of one block of a running count, about; blocks of a table, at most; bounds that a row is compared with at once.
BLOCK, MOST_BLOCKS, BOUNDS = 100_000, 4096, 64


def _block_of(d: DataFrame) -> Column:
    """A number for each stretch of ord, stretches of about BLOCK rows whatever the values: bounded by quantiles."""
    n = d.count()
    if n <= BLOCK:
        return F.lit(0)
    k = min(MOST_BLOCKS, -(-n // BLOCK))
    got = d.select(F.percentile_approx(F.col("ord").cast("long"), [i / k for i in range(1, k)], 20 * k)).first()[0]
    bounds = sorted(set(got or []))
    passed = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col("ord")))
    if len(bounds) <= BOUNDS:
        return passed(F.lit(bounds))
    far = passed(F.lit(bounds[::BOUNDS]))  # first among every BOUNDS-th bound, then among those up to the next such
    near = F.slice(F.lit(bounds), F.greatest(far - 1, F.lit(0)) * BOUNDS + 1, BOUNDS)
    return F.when(far == 0, 0).otherwise((far - 1) * BOUNDS + passed(near))


def _places_before(d: DataFrame) -> DataFrame:
    """__before: the sum of __takes over smaller ord. Blocks of ord are summed in parallel; only their totals are
    summed in one task, so no window holds every file."""
    d = d.withColumn("__block", _block_of(d))
    totals = d.groupBy("__block").agg(F.sum("__takes").alias("__total"))
    every = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__block", F.coalesce(F.sum("__total").over(every), F.lit(0)).alias("__base"))
    inner = Window.partitionBy("__block").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__in", F.coalesce(F.sum("__takes").over(inner), F.lit(0)))
    return d.join(totals, "__block").withColumn("__before", F.col("__base") + F.col("__in")).drop("__block", "__base", "__in")


def coverage(admission: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """One row: discovered, eligible, omitted, skipped, truncated, attempted, reviewed, failed."""
    a = admission
    trunc = F.count_if(F.col("truncated")) if "truncated" in a.columns else F.lit(0)
    out = a.agg(F.count("*").alias("discovered"), F.count_if("eligible").alias("eligible"), F.count_if("omitted").alias("omitted"), (F.count_if(F.col("decision") == "skipped") - F.count_if("omitted")).alias("skipped"), trunc.alias("truncated"))
    if outcomes is None:
        return out.select("*", *[F.lit(0).cast("long").alias(c) for c in ("attempted", "reviewed", "failed")])
    o = outcomes.agg(F.count_if("started").alias("attempted"), F.count_if(~F.col("failed")).alias("reviewed"), F.count_if("failed").alias("failed")).first()
    return out.select("*", *[F.lit(o[c]).cast("long").alias(c) for c in ("attempted", "reviewed", "failed")])


def status(source_complete: Column, mode: Column, context_state: Column) -> Column:
    """Of a coverage row: failed if nothing eligible was reviewed, partial if anything is missing, else complete."""
    missing = ~source_complete | (F.col("failed") > 0) | (F.col("omitted") > 0) | (F.col("truncated") > 0) | (context_state == "degraded") | ((mode != "diff") & (context_state == "unavailable"))
    return F.when((F.col("eligible") > 0) & (F.col("reviewed") == 0), "failed").when(missing, "partial").otherwise("complete")


def index_only_status(indexed: Column, mode: Column, context_state: Column) -> Column:
    return F.when(indexed & (context_state == "degraded"), "partial").when(indexed | (mode == "diff"), "complete").otherwise("failed")


def add_usage(outcomes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sums of the usage columns, and whether any was an estimate."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("requests", "attempts", "input_tokens", "output_tokens", "estimated_input_tokens", "cache_hits") if c in outcomes.columns]
    return outcomes.groupBy(*(keys or [])).agg(*sums, F.coalesce(F.bool_or("estimated"), F.lit(False)).alias("estimated"))


def within_budget(requests: DataFrame, limit: int, embedding_limit: int) -> DataFrame:
    """requests(run, ord, kind) with granted: while the run's cap lasts, and for embeddings their own share of it. Each
    run is small; runs are independent."""
    w = Window.partitionBy("run").orderBy("ord")
    e = F.col("kind") == "embedding"
    d = requests.withColumn("__e", F.sum(e.cast("int")).over(w))
    d = d.withColumn("__may", ~e | (F.col("__e") <= embedding_limit))
    d = d.withColumn("__n", F.sum(F.col("__may").cast("int")).over(w))
    return d.withColumn("granted", F.col("__may") & (F.col("__n") <= limit)).drop("__e", "__may", "__n")


def first_failed_cut(segments: DataFrame) -> DataFrame:
    """segments(filename, seg_no, failed) that are worked on: a file stops after its first failure."""
    w = Window.partitionBy("filename").orderBy("seg_no").rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("__f", F.coalesce(F.max(F.col("failed").cast("int")).over(w), F.lit(0))).where("__f = 0").drop("__f")


def complete_outcomes(files: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Every admitted file with its outcome; one that never came back has failed."""
    j = files.join(outcomes, "filename", "left")
    return j.withColumns({"started": F.coalesce("started", F.lit(False)), "failed": F.coalesce("failed", F.lit(True))})


def pack_context(candidates: DataFrame, keys: list[str], cap: int | Column, bytes_col: str = "bytes") -> DataFrame:
    """candidates(keys, rank, bytes) that fit: the prefix, in rank order, whose running sum is within the cap; the first
    that does not fit ends it."""
    w = Window.partitionBy(*keys).orderBy("rank")
    cap = cap if isinstance(cap, Column) else F.lit(cap)
    return candidates.withColumn("used", F.sum(bytes_col).over(w)).where(F.col("used") <= cap)
