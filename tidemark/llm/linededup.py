"""Line dedup over levelled sorted runs of line hashes, in DataFrame operations only.

A batch of documents is reduced to its distinct line keys with their smallest doc_id and merged against the
runs of all earlier batches; what is new is added as a level-0 run. Runs are tables bucketed and sorted by
hash, a file per bucket, so a merge join reads them as they are: the batch alone is exchanged and sorted,
once, however many runs there are. One pass of left joins gives both what a run holds already and what none
does, and is written once: the batch's run is the rows of it that no earlier run holds. When a level holds
`fanout` runs they are compacted into one run of the next level, so a batch meets at most fanout - 1
runs per level. Batches are taken in doc_id order, so a run's owner
of a key is the smallest doc_id that holds it: a key's lines in any other document are dropped. There are
N_BATCHES of them, and more where a batch would have over BATCH_ROWS documents.

Only keys found in a second document (noted when a batch hits a run, or itself) meet the lines
again. The keys' hash is two 64-bit words; the texts are split into lines once, and of a line only its
hash and place are written, in a folder per batch. Joins with lines are plain
equi-joins between two exchanges, which adaptive execution splits when one line is very frequent.

Defined results. Null text: one empty line. Null doc_id: one document, after every id; its rows stay.
Rows that repeat a doc_id count as one document and each is cleaned. A line repeated within its
owner stays repeated. Very long texts are split whole. Ties: a key's owner is its smallest doc_id. Empty
table: empty result. Other columns pass through `dedup_lines` unchanged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C

MIN_CODE_POINTS = 10
N_BATCHES, BATCH_ROWS, FANOUT = 6, 1 << 28, 3
KEY = ["h1", "h2"]


class Runs:
    """Levelled runs of (h1, h2, owner), each a table bucketed by hash and sorted in its buckets."""

    def __init__(self, spark: SparkSession, path: str, fanout: int) -> None:
        self.spark, self.path, self.fanout = spark, path, fanout
        # as many buckets as a shuffle has partitions: then a join deals the batch out as the runs are
        self.buckets = C.shuffle_partitions(spark)
        self.levels: list[list[DataFrame]] = []
        self.written = 0

    def _write(self, df: DataFrame, dealt: bool = False) -> DataFrame:
        """df as a table of one sorted file per bucket."""
        self.written += 1
        return C.bucketed(df, self.buckets, KEY, f"{self.path}/run-{self.written}", dealt)

    def absorb(self, keys: DataFrame) -> DataFrame:
        """Add the keys (h1, h2, owner, shared) that no run holds; the keys that are held already, or
        shared within the batch, with their owner."""
        met = keys.withColumn("held", F.lit(None).cast("long"))
        for run in (r for level in self.levels for r in level):
            met = met.join(run.withColumnRenamed("owner", "was").hint("merge"), KEY, "left")
            met = met.select(*KEY, "owner", "shared", F.coalesce("held", "was").alias("held"))
        with C.sorted_buckets(self.spark):
            met = self._write(met, dealt=True)
        self._add(0, met.where("held is null").select(*KEY, "owner"))
        return met.where("shared or held is not null").select(*KEY, F.coalesce("held", "owner").alias("owner"))

    def _add(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            # runs hold disjoint keys: a merge is a union brought back into hash order
            merged = reduce(DataFrame.unionByName, self.levels[level])
            self.levels[level] = []
            self._add(level + 1, self._write(merged))


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """(did, row_hash, pos, h1, h2) of every line long enough to be compared."""
    rows = docs.select("did", "row_hash", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    key = rows.select("did", "row_hash", "pos", F.btrim("line", F.lit(C.WS)).alias("bare")).where(F.length("bare") >= least)
    key = key.select("did", "row_hash", "pos", C.lower_ascii(F.col("bare")).alias("key"))
    return key.select("did", "row_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def batch_bounds(docs: DataFrame, n: int, most_rows: int = BATCH_ROWS) -> list[int]:
    """Doc_id bounds that cut the table into n batches of about equal rows, or more if each is to have at most most_rows."""
    n = max(n, -(-docs.count() // most_rows))
    got = docs.select(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10_000)).first()[0] if n > 1 else None
    return sorted(set(got or []))


def dedup_lines(docs: DataFrame, min_code_points: int = MIN_CODE_POINTS, n_batches: int = N_BATCHES, fanout: int = FANOUT, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """docs with columns kept_text, n_lines, n_dropped added (names of docs' own that clash are replaced)."""
    spark = docs.sparkSession
    path = C.workspace(spark, "linededup")
    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(C.LAST_ID)).alias("did"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    hashed = slim.withColumn("row_hash", F.xxhash64("body"))
    bounds = batch_bounds(docs.select(F.col("doc_id").cast("long").alias("doc_id")), n_batches, batch_rows)
    runs, shared = Runs(spark, path, fanout), []
    lines = _lines(hashed, min_code_points).withColumn("batch", F.size(F.filter(F.lit(bounds).cast("array<bigint>"), lambda x: x <= F.col("did"))))
    lines = C.materialize(lines, f"{path}/lines", "batch")
    for k in range(len(bounds) + 1):
        part = lines.where(F.col("batch") == k)
        keys = part.groupBy(*KEY).agg(F.min("did").alias("owner"), (F.min("did") != F.max("did")).alias("shared"))
        shared.append(runs.absorb(keys))
    known = C.materialize(reduce(DataFrame.unionByName, shared).groupBy(*KEY).agg(F.min("owner").alias("owner")), f"{path}/shared")
    drops = lines.join(known, KEY).where("did <> owner").groupBy(F.col("did").alias("__drop_did"), F.col("row_hash").alias("__drop_hash")).agg(F.collect_set("pos").alias("__drop"))
    out = docs.withColumns({"__did": F.coalesce(F.col("doc_id").cast("long"), F.lit(C.LAST_ID)), "__body": F.coalesce(F.col("text").cast("string"), F.lit(""))}).withColumn("__hash", F.xxhash64("__body"))
    out = out.join(drops, (F.col("__did") == F.col("__drop_did")) & (F.col("__hash") == F.col("__drop_hash")), "left")
    n_lines = F.length("__body") - F.length(F.replace("__body", F.lit("\n"), F.lit(""))) + 1
    out = out.withColumns({"n_lines": n_lines.cast("long"), "n_dropped": F.when(F.col("__drop").isNull(), F.lit(0)).otherwise(F.size("__drop")).cast("long")})
    return _kept(out).drop("__did", "__body", "__hash", "__drop_did", "__drop_hash", "__drop", "__lines")


def _kept(out: DataFrame) -> DataFrame:
    """kept_text: positions left after a hashed array difference pick the lines, in linear time."""
    out = out.withColumn("__lines", F.when(F.col("__drop").isNotNull(), F.split("__body", "\n")))
    left = F.array_except(F.sequence(F.lit(0), (F.col("n_lines") - 1).cast("int")), F.col("__drop"))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("__lines"), i)), "\n")
    return out.withColumn("kept_text", F.when(F.col("__drop").isNull(), F.col("__body")).otherwise(kept))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: A line set is one string of positions in DuckDB; ties and repeats as in dedup_lines.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS did, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, did, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(did) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(did) <> max(did)),
f AS (SELECT k.*, o.owner IS NOT NULL AND o.owner <> k.did AS dropped FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM f GROUP BY r, doc_id
"""
