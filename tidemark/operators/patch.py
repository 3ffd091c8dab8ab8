"""Unified diffs as rows: line coordinates by running counts, ranges by gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADER = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"


def lines(files: DataFrame, patch: str = "patch") -> DataFrame:
    """(filename, line_no from 1, text)"""
    return files.where(F.col(patch).isNotNull()).select("filename", F.posexplode(F.split(patch, "\n")).alias("pos", "text")).select("filename", (F.col("pos") + 1).cast("long").alias("line_no"), "text")


def parse(files: DataFrame, patch: str = "patch") -> DataFrame:
    """(filename, line_no, text, hunk, kind, old_line, new_line, complete): a header sets both counters, an added line
    moves the new one, a deleted one the old one, context both; other lines have no place."""
    d = lines(files, patch)
    d = d.withColumn("old0", F.regexp_extract("text", HEADER, 1)).withColumn("new0", F.regexp_extract("text", HEADER, 2))
    d = d.withColumn("head", F.col("old0") != "")
    by_file = Window.partitionBy("filename").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("hunk", F.sum(F.col("head").cast("int")).over(by_file))
    sign = F.substring("text", 1, 1)
    kind = F.when(F.col("head") | (F.col("hunk") == 0), None).when(sign == "+", "addition").when(sign == "-", "deletion").when(sign == " ", "context")
    d = d.withColumn("kind", kind)
    hunk = Window.partitionBy("filename", "hunk").orderBy("line_no")
    before = hunk.rowsBetween(Window.unboundedPreceding, -1)
    base = lambda c: F.max(F.when(F.col("head"), F.col(c).try_cast("long"))).over(Window.partitionBy("filename", "hunk"))
    moved = lambda *kinds: F.coalesce(F.sum(F.col("kind").isin(*kinds).cast("long")).over(before), F.lit(0))
    old = F.when(F.col("kind").isin("deletion", "context"), base("old0") + moved("deletion", "context"))
    new = F.when(F.col("kind").isin("addition", "context"), base("new0") + moved("addition", "context"))
    return d.select("filename", "line_no", "text", "hunk", "kind", old.alias("old_line"), new.alias("new_line"), F.lit(True).alias("complete"))


def stats(files: DataFrame, patch: str = "patch") -> DataFrame:
    """(filename, additions, deletions, changes) inside hunks; a diff header ends a hunk."""
    d = lines(files, patch)
    state = F.when(F.rlike("text", F.lit(HEADER)), 1).when(F.startswith("text", F.lit("diff --git ")), 0)
    inside = F.last(state, ignorenulls=True).over(Window.partitionBy("filename").orderBy("line_no"))
    d = d.withColumn("inside", F.coalesce(inside, F.lit(0)) == 1)
    n = lambda s: F.count_if(F.col("inside") & F.startswith("text", F.lit(s))).alias({"+": "additions", "-": "deletions"}[s])
    return d.groupBy("filename").agg(n("+"), n("-")).withColumn("changes", F.col("additions") + F.col("deletions"))


def sections(files: DataFrame, patch: str = "patch") -> DataFrame:
    """(filename, section, text): 0 the preamble, then each hunk."""
    d = lines(files, patch)
    by_file = Window.partitionBy("filename").orderBy("line_no")
    d = d.withColumn("section", F.sum(F.startswith("text", F.lit("@@")).cast("int")).over(by_file))
    return d.groupBy("filename", "section").agg(joined_lines().alias("text"))


def joined_lines() -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")


def changed_lines(parsed: DataFrame) -> DataFrame:
    """(filename, line): complete added lines with a place."""
    return parsed.where("kind = 'addition' and complete and new_line > 0").select("filename", F.col("new_line").alias("line")).distinct()


def ranges(numbers: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """(keys, start, end): runs of consecutive integers."""
    w = Window.partitionBy(*keys).orderBy(line)
    d = numbers.select(*keys, line).distinct().withColumn("island", F.col(line) - F.row_number().over(w))
    return d.groupBy(*keys, "island").agg(F.min(line).alias("start"), F.max(line).alias("end")).drop("island")
