"""A versioned index on any file system that Spark knows: generations of Parquet tables named by a manifest.

A generation is written under a fresh name and becomes the index when the manifest is put in place, by one rename; readers
never see half of it. Old generations go when they are old enough. Also: embedding checkpoints, a keyed cache, the
layout of a vector file, and older one-file indexes."""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA_VERSION = 3
MANIFEST = "manifest.json"
ORPHAN_SECONDS, LOCK_SECONDS = 3600, 10
READ_TRIES = 3


class Files:
    """Small driver-side file operations through Spark's own file systems."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark.sparkContext._jvm, root
        self.fs = self.path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.path(name)):
            return None
        s = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(s, "UTF-8")
        finally:
            s.close()

    def replace(self, name: str, text: str) -> None:
        """Write beside the target, then move it into place."""
        tmp = f".{name.rsplit('/', 1)[-1]}.{uuid.uuid4().hex}.tmp"
        out = self.fs.create(self.path(tmp), True)
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs.exists(self.path(name)):
            self.fs.delete(self.path(name), False)
        if not self.fs.rename(self.path(tmp), self.path(name)):
            raise OSError(f"cannot put {name} in place")

    def create(self, name: str, text: str) -> bool:
        """Create a file unless it is there."""
        try:
            out = self.fs.create(self.path(name), False)
        except Exception:  # noqa: BLE001  another owner has it
            return False
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def names(self) -> list[tuple[str, float]]:
        if not self.fs.exists(self.path()):
            return []
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in self.fs.listStatus(self.path())]


@dataclass
class Opened:
    """status: missing, valid, corrupt, incompatible or stale."""

    status: str
    reason: str | None = None
    meta: dict = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)


class Lock:
    """One publisher at a time; a lock older than LOCK_SECONDS * 6 is taken from its dead owner. Of several that wait for
    a dead owner's lock, the one that creates the claim on that very lock removes it."""

    def __init__(self, files: Files) -> None:
        self.files, self.name = files, uuid.uuid4().hex

    def _owner(self) -> dict:
        try:
            return json.loads(self.files.read("publish.lock") or "{}")
        except ValueError:  # being written
            return {}

    def __enter__(self) -> Lock:
        until = time.time() + LOCK_SECONDS
        while not self.files.create("publish.lock", json.dumps({"at": time.time(), "owner": self.name})):
            old = self._owner()
            dead = "at" in old and time.time() - old["at"] > LOCK_SECONDS * 6
            if dead and self.files.create(f"claim-{old.get('owner', 'none')}.tmp", self.name):
                if self._owner() == old:
                    self.files.delete("publish.lock")
            elif time.time() > until:
                raise TimeoutError("another publication holds the index")
            else:
                time.sleep(0.2)
        return self

    def __exit__(self, *_) -> None:
        if self._owner().get("owner") == self.name:
            self.files.delete("publish.lock")


def table_digest(df: DataFrame) -> list:
    """[rows, digest] of a table, whatever the order of its rows: sums and exclusive ors of two hashes of each row."""
    cols = sorted(df.columns)
    one, two = F.xxhash64(*cols), F.xxhash64(F.lit(1), *cols)
    got = df.agg(F.count("*"), F.coalesce(F.sum(one.cast("decimal(38,0)")), F.lit(0)).cast("string"), F.coalesce(F.bit_xor(two), F.lit(0))).first()
    return [got[0], hashlib.sha256(f"{cols} {got[1]} {got[2]}".encode()).hexdigest()]


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], meta: dict) -> str:
    """Write the tables as a new generation and make it current; its name."""
    files = Files(spark, root)
    gen = f"gen-{uuid.uuid4().hex[:16]}"
    rows = {}
    for name, df in tables.items():
        df.write.parquet(f"{root}/{gen}/{name}")
        rows[name] = table_digest(spark.read.parquet(f"{root}/{gen}/{name}"))
    body = {"schema_version": SCHEMA_VERSION, "generation": gen, "tables": rows, "meta": meta}
    body["digest"] = hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()
    with Lock(files):
        files.replace(MANIFEST, json.dumps(body))
    return gen


def open_index(spark: SparkSession, root: str, required: dict | None = None) -> Opened:
    """The current generation; read again if it is replaced meanwhile."""
    files = Files(spark, root)
    last = Opened("missing")
    for _ in range(READ_TRIES):
        text = files.read(MANIFEST)
        if text is None:
            return Opened("missing")
        try:
            body = json.loads(text)
            digest = body.pop("digest")
        except (ValueError, KeyError, AttributeError):
            return Opened("corrupt", "the manifest is not valid")
        if digest != hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest():
            return Opened("corrupt", "the manifest's digest is another")
        if body["schema_version"] != SCHEMA_VERSION:
            return Opened("incompatible", f"schema version {body['schema_version']} != {SCHEMA_VERSION}")
        for k, v in (required or {}).items():
            if body["meta"].get(k) != v:
                return Opened("stale" if k == "revision" else "incompatible", f"{k} differs", body["meta"])
        try:
            tables = {n: spark.read.parquet(f"{root}/{body['generation']}/{n}") for n in body["tables"]}
            bad = [n for n, df in tables.items() if table_digest(df) != body["tables"][n]]
        except Exception as e:  # noqa: BLE001  a generation may go while it is read
            last = Opened("corrupt", f"a table cannot be read: {type(e).__name__}")
            continue
        return Opened("corrupt", f"rows or digests differ: {bad}") if bad else Opened("valid", None, body["meta"], tables)
    return last


def vacuum(spark: SparkSession, root: str, older_than: float = ORPHAN_SECONDS) -> list[str]:
    """Remove generations and temporary files that no manifest names and that are old enough."""
    files = Files(spark, root)
    current = json.loads(files.read(MANIFEST) or "{}").get("generation")
    gone = [n for n, at in files.names() if (n.startswith("gen-") or n.endswith(".tmp")) and n != current and time.time() - at > older_than]
    for n in gone:
        files.delete(n)
    return gone


def save_checkpoint(spark: SparkSession, root: str, vectors: DataFrame) -> None:
    """Vectors of an unfinished run, whole, replacing what was saved."""
    publish(spark, f"{root}/checkpoint", {"vectors": vectors}, {})
    vacuum(spark, f"{root}/checkpoint", 0)


def load_checkpoint(spark: SparkSession, root: str) -> Opened:
    return open_index(spark, f"{root}/checkpoint")


def clear_checkpoint(spark: SparkSession, root: str) -> None:
    Files(spark, root).delete("checkpoint")


def cache_get(cache: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(key) with value and hit: the last value put under a key."""
    w = Window.partitionBy("key").orderBy(F.desc("put_at"))
    last = cache.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("key", "value")
    return wanted.join(last, "key", "left").withColumn("hit", F.col("value").isNotNull())


def cache_put(entries: DataFrame, path: str) -> None:
    """Append (key, value); the time decides which of a key's values is the last."""
    entries.select("key", "value", F.unix_millis(F.current_timestamp()).alias("put_at")).write.mode("append").parquet(path)


def byte_offsets(rows: DataFrame, space: list[str], order: str, size: str) -> DataFrame:
    """rows with byte_offset: where each would begin in its space's file."""
    w = Window.partitionBy(*space).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("byte_offset", F.coalesce(F.sum(size).over(w), F.lit(0)))


# The header of a vector file (fixed layout, 64 bytes, little-endian): magic, version, byte length, count, SHA-256.
MAGIC, BLOB_VERSION, HEADER = b"ACRVECS\0", 1, struct.Struct("<8sIIQQ32s")


def encode_blob(values: bytes, count: int) -> bytes:
    return HEADER.pack(MAGIC, BLOB_VERSION, HEADER.size, len(values), count, hashlib.sha256(values).digest()) + values


def decode_blob(data: bytes) -> tuple[int, bytes]:
    """(count, values) of a vector file; raises ValueError if it is not whole."""
    if len(data) < HEADER.size:
        raise ValueError("the vector file is shorter than its header")
    magic, version, size, length, count, digest = HEADER.unpack_from(data)
    body = data[HEADER.size :]
    if magic != MAGIC or version != BLOB_VERSION or size != HEADER.size:
        raise ValueError("not a vector file of this version")
    if len(body) != length or hashlib.sha256(body).digest() != digest:
        raise ValueError("the vector file's length or digest is another")
    return count, body


LEGACY = "repositoryId string, revision string, chunkerVersion string, maxChunkTokens long, vectors map<string,struct<cacheKey:string,inputHash:string,provider:string,model:string,version:string,dimensionIdentity:string,dimensions:int,values:array<double>>>"


def legacy_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vectors of an older one-file JSON index whose key is their own and whose values are sound."""
    d = spark.read.schema(LEGACY).option("multiLine", True).json(path).select(F.explode("vectors").alias("key", "v"))
    d = d.where(F.col("key") == F.col("v.cacheKey"))
    v = d.select(F.col("v.cacheKey").alias("cache_key"), F.col("v.inputHash").alias("input_hash"), "v.provider", "v.model", "v.version", F.col("v.dimensionIdentity").alias("dimension_identity"), "v.dimensions", "v.values")
    from tidemark.operators.reconcile import sound_vectors

    return sound_vectors(v)
