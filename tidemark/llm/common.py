"""Helpers that the training-data operators share: the shared work folder, materialised
tables, connected components and hot-group tiling."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import itertools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The whitespace set of every contract: [\x20\x09-\x0D].
WS = " \t\n\x0b\x0c\r"
WS_CLASS = "[\\x20\\x09-\\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands in for a null id where ids are ordered: after every real one.
LAST_ID = (1 << 63) - 1

BATCH_ROWS = 2000
#: Session settings by which a task holds little of a table of whole texts: name, Spark's default, and what lean() sets.
#: A row group is read as a whole, and written from memory; the readers' batches are counted in rows.
LEAN = (
    ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", str(BATCH_ROWS)),
    ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", str(4 << 20)),
    ("spark.sql.parquet.columnarReaderBatchSize", "4096", "256"),
    ("parquet.block.size", None, str(16 << 20)),
)

_held: dict = {}
_shipped: set[str] = set()
_made: list[tuple[SparkSession, str]] = []


def lean(spark: SparkSession) -> None:
    """Lower the session's batches and row groups from Spark's defaults to LEAN, as they hold for a whole session and rows
    here are whole texts; a session that has set another number keeps it."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for name, default, value in LEAN:
        if spark.conf.get(name, hadoop.get(name) or default) == default:
            spark.conf.set(name, value)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python once per application, and make the session lean."""
    lean(spark)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "tidemark_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode,
    where it may be unset, a temporary folder that then becomes the checkpoint folder."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    made = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    sc.setCheckpointDir(made)
    return sc.getCheckpointDir().rstrip("/")


def workspace(spark: SparkSession, what: str) -> str:
    """A fresh folder for one job's tables; clean(spark) or the end of the driver removes it."""
    ship(spark)
    path = f"{shared_dir(spark)}/tidemark-{what}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def clean(spark: SparkSession) -> None:
    """Remove every work table of this driver; results that still read them end with that."""
    jvm = spark.sparkContext._jvm
    while _tables:
        _, name = _tables.pop()
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    while _made:
        _, path = _made.pop()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _at_exit() -> None:
    try:
        if _made and _made[0][0].sparkContext._jsc is not None:
            clean(_made[0][0])
    except Exception:  # noqa: BLE001  the JVM may be gone already
        pass


def materialize(df: DataFrame, path: str, by: str | None = None) -> DataFrame:
    """Write df as a Parquet table, with a folder for each value of `by`, and read it again: cuts the lineage with a
    table that any executor can read after others are lost."""
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_tables: list[tuple[SparkSession, str]] = []


def shuffle_partitions(spark: SparkSession) -> int:
    """How many partitions the planner gives a shuffle."""
    return spark._jsparkSession.sessionState().conf().numShufflePartitions()


def bucketed(df: DataFrame, buckets: int, keys: list[str], path: str, dealt: bool = False) -> DataFrame:
    """df written and read again as a table at `path`, bucketed by keys and sorted by them, one file per bucket. dealt:
    df is hash-partitioned by keys into that many partitions already. The catalogue knows the table until
    clean(spark); its files are the work folder's."""
    spark = df.sparkSession
    name = f"tidemark_{uuid.uuid4().hex}"
    df = df if dealt else df.repartition(buckets, *keys)
    df.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    _tables.append((spark, name))
    return spark.table(name)


@contextlib.contextmanager
def sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """For plans made and run inside: a bucket of one file is read as sorted as it was written."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def opaque(c: Column) -> Column:
    """The same long, but of a partitioning unknown to the planner, so that a join on it is
    planned from two plain exchanges, which adaptive execution can split when one key is hot."""
    return c + F.lit(0)


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased; lower() does the same, faster, where all characters are ASCII."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def connected_components(edges: DataFrame, path: str) -> DataFrame:
    """(node, component) of every node of edges(src, dst: long), component the smallest node
    reached. Alternating large-star and small-star steps until nothing changes, which takes rounds in the
    order of the logarithm of the nodes, squared at worst; each round is written to `path`.

    Every step takes a neighbourhood's minimum with partial aggregation and joins it back by a
    join that adaptive execution may split, so a node with very many links is no hot task."""
    n = F.col
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct()
    e = materialize(e, f"{path}/round-0")
    before = None
    for k in itertools.count(1):
        both = e.unionByName(e.select(n("v").alias("u"), n("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).select(opaque(n("u")).alias("u"), "m")
        large = both.join(low, "u").where("v > u").select(n("v").alias("u"), n("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(opaque(n("u")).alias("u"), "m")
        small = large.join(low, "u").select(F.explode(F.array(F.struct(n("v").alias("u"), n("m").alias("v")), F.struct("u", n("m").alias("v")))).alias("p")).select("p.u", "p.v").where("u <> v").distinct()
        e = materialize(small, f"{path}/round-{k}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return e.select(n("u").alias("node"), n("v").alias("component")).unionByName(e.select(n("v").alias("node"), n("v").alias("component")).distinct())


def tiled(df: DataFrame, keys: list[str], uid: str, rows: int, path: str) -> DataFrame:
    """df with columns ti, tj: each row goes to every unit (ti, tj) of its group in which it has
    to meet others. A group of up to `rows` rows is the one unit (0, 0); a larger one is dealt by
    hash over t tiles, and each pair of tiles is a unit, so no task holds a whole hot group.
    `tile` is the row's own tile."""
    big = materialize(df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > rows), path)
    t = F.coalesce(F.ceil(F.col("n_rows") / rows), F.lit(1)).cast("int")
    out = df.join(big, keys, "left").withColumn("tiles", t).drop("n_rows")
    out = out.withColumn("tile", F.pmod(F.xxhash64(uid), F.col("tiles")).cast("int"))
    return out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("ti", F.least("tile", "other")).withColumn("tj", F.greatest("tile", "other")).drop("other", "tiles")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 20_000) -> Iterator[pa.Table]:
    """Tables of complete groups from batches that are sorted by keys, about `least` rows each."""
    held: list[pa.Table] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(pa.Table.from_batches([b]))
        n += b.num_rows
        if n < least:
            continue
        t = pa.concat_tables(held).combine_chunks()
        cut = group_starts(t, keys)[-1]
        if cut:
            yield t.slice(0, cut)
        held = [t.slice(cut)]
        n = t.num_rows - cut
    if n:
        yield pa.concat_tables(held).combine_chunks()


def worker_cache(key, build: Callable[[], object] = lambda: None):
    """What a Python worker keeps from task to task: the current operator's, and no other's. Workers are used by one
    stage after another, and what they hold counts against the executor all that time."""
    if key not in _held:
        _held.clear()
        release()
        _held[key] = build()
    return _held[key]


def release() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows a few at a time: what Python holds of them stays small."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
    release()


def group_starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        c = t.column(k).to_numpy(zero_copy_only=False)
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


class Forest:
    """Union-find over n nodes for arrays of links: label[i] is the smallest node of i's component."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := label[label], label):
                label = up
        self.label = label

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """A spanning star per component."""
        at = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.label[at], at


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


__all__ = ["WS", "WS_CLASS", "UPPER", "LOWER", "LAST_ID", "Forest", "bucketed", "clean", "connected_components", "crc_mod", "group_starts", "lean", "lower_ascii", "materialize", "opaque", "read", "release", "shared_dir", "ship", "shuffle_partitions", "slices", "sorted_buckets", "tiled", "whole_groups", "worker_cache", "workspace"]
