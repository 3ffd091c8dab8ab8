"""The corpus pipeline: documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and returns a
DataFrame, which run() writes as Parquet and reads again as the next stage's docs. All stages but the
last return the columns of docs, whatever they are called: a stage sees a row's other columns only as one
struct. Names that begin with two underscores are the operators' own.

Defined results. Nulls, empty and very long texts, ties, repeated rows and empty tables: as stated by
each stage's operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm import linededup, packing, quality, rules, simhash


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id and text, and the whole row as a struct, whose names clash with nothing."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select("doc_id", "text", row.alias("__row"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    C.lean(spark)  # what this stage returns is written, and read by the next, in small row groups
    return rules.apply_rules(_carried(docs)).where("kept").select("__row.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows of the whole documents table: what the rules let through may hold no
    example of what to reject."""
    labels = quality.quality_labels(C.read(spark, sf_dir, "labels"))
    out = quality.classify(_carried(docs), labels, training=C.read(spark, sf_dir, "documents"))
    return out.where("predicted = 1").select("__row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """text without its dropped lines; n_chars follows it where docs has that column."""
    out = linededup.dedup_lines(_carried(docs))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(docs, packing.tokenizer_path(), with_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("packing", packed),
]
#: A trained classifier and a packing heuristic are not for SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = C.workspace(spark, "pipeline")
    docs = C.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.materialize(stage(spark, docs, sf_dir), f"{path}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
