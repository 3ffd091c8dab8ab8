"""An extension: continuous refresh of an index. Each micro-batch of changed files is reconciled and published.

The library's collection is by snapshot; this wraps the same reconcile step in foreachBatch. A batch that is seen again
after a failure publishes the same files again, which changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import keys as K
from tidemark.sources import store


def merged(current: DataFrame, batch: DataFrame) -> DataFrame:
    """current files(path, content, content_hash) after batch(path, content, at): the newest row of a path wins; null
    content removes it."""
    w = Window.partitionBy("path").orderBy(F.desc("at"))
    new = batch.withColumn("n", F.row_number().over(w)).where("n = 1").select("path", "content")
    kept = current.join(new.select("path"), "path", "left_anti")
    return kept.unionByName(new.where("content is not null").withColumn("content_hash", K.sha(F.col("content"))))


def start(stream: DataFrame, root: str, checkpoint: str, once: bool = False):
    """Keep the index at root up to date with a stream of (path, content, at). The running query."""
    spark: SparkSession = stream.sparkSession
    empty = "path string, content string, content_hash string"

    def apply(batch: DataFrame, _: int) -> None:
        opened = store.open_index(spark, root)
        current = opened.tables["files"] if opened.status == "valid" else spark.createDataFrame([], empty)
        store.publish(spark, root, {"files": merged(current, batch)}, {})

    w = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
