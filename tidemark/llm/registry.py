"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import embdedup, linededup, lm, packing, quality, rules, simhash, spsample, urlrep, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": embdedup.op1_embedding_dedup,
    "op2_warc": warc.op2_warc,
    "op3_line_dedup": linededup.op3_line_dedup,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_quality_rules": rules.op5_quality_rules,
    "op6_lm_scoring": lm.op6_lm_scoring,
    "op7_simhash": simhash.op7_simhash,
    "op8_sentencepiece": spsample.op8_sentencepiece,
    "op9_url_filters": urlrep.op9_url_filters,
    "op10_packing": packing.op10_packing,
}
ORACLE_SQL: dict[str, str] = {
    "op1_embedding_dedup": embdedup.SQL,
    "op2_warc": warc.SQL,
    "op3_line_dedup": linededup.SQL,
    "op5_quality_rules": rules.SQL,
    "op9_url_filters": urlrep.SQL,
}
