"""The files of a repository as rows: names and sizes are filtered before any content is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import keys as K
from tidemark.functions import policy as P
from tidemark.sources import ignore


def scan(spark: SparkSession, root: str, rules: list[ignore.Rule] | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """(path, size, mtime_ms, content) of what may be indexed below root. The filters use only the file source's
    metadata columns, and content is dropped if it looks like a secret."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    name = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^\\Q{top}\\E/", "")
    d = d.select(name.alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"), "content")
    d = d.where(P.is_indexable(F.col("path")) & (F.col("size") <= P.MAX_FILE_BYTES) & ~P.is_sensitive_path(F.col("path")) & ~P.is_generated(F.col("path")) & ~ignore.ignored(F.col("path"), rules or []))
    if blocked is not None:
        d = d.join(blocked.select(F.col("filename").alias("path")), "path", "left_anti")
    d = d.withColumn("content", F.decode("content", "UTF-8"))
    return d.where(P.sensitive_content(F.col("content")).isNull())


def file_table(scanned: DataFrame) -> DataFrame:
    """The scan in the form that reconcile takes."""
    return scanned.select("path", K.sha(F.col("content")).alias("content_hash"), "size", F.lit(None).cast("string").alias("blob_id"), "mtime_ms")
