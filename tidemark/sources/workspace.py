"""The folder that driver and executors share, for tables that cut a lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def work_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder under spark.checkpoint.dir; where that is unset, which only local mode may leave so, under a
    temporary folder that then becomes the checkpoint folder."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidemark-"))
        found = sc.getCheckpointDir()
    path = f"{found.rstrip('/')}/tidemark-{what}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


_made: list[tuple[SparkSession, str]] = []


def clean(spark: SparkSession) -> None:
    """Remove every work folder made so far; results that still read one end with that. The end of the driver does
    the same; a long session calls it between jobs."""
    while _made:
        _, name = _made.pop()
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _at_exit() -> None:
    try:
        if _made and _made[-1][0].sparkContext._jsc is not None:
            clean(_made[-1][0])
    except Exception:  # noqa: BLE001  the JVM may be gone already
        pass
