"""Hybrid retrieval: lexical and semantic shortlists fused, deduplicated by content and cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import lexical, semantic

LEXICAL_WEIGHT, SEMANTIC_WEIGHT = 0.4, 0.6
#: Defaults of a retrieval.
CANDIDATES, TOP_K, THRESHOLD = 20, 5, 0.05


def fuse(lex: DataFrame, sem: DataFrame | None) -> DataFrame:
    """(query_id, ordinal, lexical, semantic, score, reasons, place): the union of two shortlists. place: lexical
    rank, then the semantic-only ones in semantic order, the tie-breaker of equal scores."""
    left = lex.select("query_id", "ordinal", F.col("score").alias("lexical"), F.col("rank").alias("l_rank"), "reasons")
    if sem is None:
        return left.select("query_id", "ordinal", "lexical", F.lit(0.0).alias("semantic"), F.col("lexical").alias("score"), "reasons", F.col("l_rank").alias("place"))
    right = sem.select("query_id", "ordinal", F.col("score").alias("semantic"), F.col("rank").alias("s_rank"))
    both = left.join(right, ["query_id", "ordinal"], "full")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    shown = F.when(F.col("semantic").isNotNull(), F.array(F.concat(F.lit("semantic:"), F.format_string("%.3f", "semantic")))).otherwise(F.array().cast("array<string>"))
    why = F.concat(F.coalesce("reasons", F.array().cast("array<string>")), shown)
    place = F.coalesce("l_rank", F.lit(1 << 30) + F.col("s_rank"))
    return both.select("query_id", "ordinal", zero("lexical").alias("lexical"), zero("semantic").alias("semantic"), (zero("lexical") * LEXICAL_WEIGHT + zero("semantic") * SEMANTIC_WEIGHT).alias("score"), why.alias("reasons"), place.alias("place"))


def cut(fused: DataFrame, hashes: DataFrame, top_k: int = TOP_K, threshold: float = THRESHOLD) -> DataFrame:
    """The top_k of each query over the threshold, the best of each content_hash. hashes: (ordinal, content_hash)."""
    order = [F.desc("score"), "place"]
    same = Window.partitionBy("query_id", "content_hash").orderBy(*order)
    best = Window.partitionBy("query_id").orderBy(*order)
    d = fused.where(F.col("score") >= threshold).join(hashes, "ordinal")
    d = d.withColumn("nth", F.row_number().over(same)).where("nth = 1").drop("nth")
    return d.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)


def retrieve(chunks: DataFrame, queries: DataFrame, mode: str = "lexical", vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, candidates: int = CANDIDATES, top_k: int = TOP_K, threshold: float = THRESHOLD) -> DataFrame:
    """Context of every query: (query_id, rank, ordinal, score, lexical, semantic, reasons, content_hash). chunks also
    hold content_hash. In hybrid mode, a missing query vector leaves that query's ranking lexical in weight."""
    lex = lexical.rank_candidates(chunks, queries, candidates)
    sem = semantic.search(vectors, query_vectors, candidates) if mode == "hybrid" and vectors is not None and query_vectors is not None else None
    fused = fuse(lex, sem)
    return cut(fused, chunks.select("ordinal", "content_hash"), top_k, threshold).drop("place")


def checked_snapshot(index_meta: DataFrame, repository_id: str, revision: str) -> None:
    """Raise unless the index is of this repository and revision."""
    got = index_meta.select("repository_id", "revision").first()
    if got is None or tuple(got) != (repository_id, revision):
        raise ValueError("the index was made for another repository or revision")
