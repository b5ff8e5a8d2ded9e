"""Chunk to page projection and weighted reciprocal rank fusion, for pages and for chunks alike."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slatework.operators.sparse import top_k
from slatework.runtime import ship


def to_pages(ranked: DataFrame, chunks: DataFrame, pages: DataFrame, k: int = 5, candidates: int = 50) -> DataFrame:
    """(query_id, document_id, page_number, score, rank) from ranked chunks: each page at its best chunk's rank."""
    spans = chunks.select("chunk_id", "document_id", F.explode(F.sequence("page_start", "page_end")).alias("page_number"))
    each = ranked.filter(F.col("rank") <= candidates).join(spans, "chunk_id").join(pages.select("document_id", "page_number").distinct(),
        ["document_id", "page_number"])
    best = each.groupBy("query_id", "document_id", "page_number").agg(F.min(F.struct("rank", F.col("score"))).alias("b"))
    best = best.select("query_id", "document_id", "page_number", F.col("b.rank").alias("r"), F.col("b.score").alias("score"))
    out = top_k(best, k, F.col("r"), F.desc("score"), F.col("document_id"), F.col("page_number"))
    return out.select("query_id", "document_id", "page_number", F.round("score", 8).alias("score"), "rank")


def fuse(sources: dict[str, DataFrame], keys: list[str], k: int = 5, weights: dict[str, float] | None = None, rrf_k: int = 60, candidates: int = 50,
        digits: int | None = None) -> DataFrame:
    """(query_id, keys, score, rank) by the sum of weight / (rrf_k + rank); a source of weight 0 is not even read.

    digits rounds the sum before ranking, for comparisons.
    """
    weights = weights or {}
    if not sources:
        raise ValueError("at least one source is needed")
    if rrf_k < 0 or candidates < 1:
        raise ValueError("rrf_k must be at least 0 and candidates at least 1")
    if unknown := set(weights) - set(sources):
        raise ValueError(f"weights for unknown sources: {', '.join(sorted(unknown))}")
    full = {name: weights.get(name, 1.0) for name in sources}
    if min(full.values()) < 0 or not any(full.values()):
        raise ValueError("weights must be at least 0, and one above it")
    parts = [s.filter(F.col("rank") <= candidates).select("query_id", *keys, "rank",
        (F.lit(float(full[n])) / (F.lit(float(rrf_k)) + F.col("rank"))).alias("part")) for n, s in sources.items() if full[n]]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    fused = both.groupBy("query_id", *keys).agg((F.sum("part") if digits is None else F.round(F.sum("part"), digits)).alias("full"),
        F.min("rank").alias("best"))
    out = top_k(fused, k, F.desc("full"), F.col("best"), *[F.col(c) for c in keys])
    return out.select("query_id", *keys, F.round("full", 8).alias("score"), "rank")


def reranked(candidates: DataFrame, score: str, k: int = 5) -> DataFrame:
    """Candidates in the order of another score; equal scores keep their order."""
    line = Window.partitionBy("query_id").orderBy(F.desc(score), F.col("_before"))
    out = candidates.withColumnRenamed("rank", "_before").withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= k)
    return out.drop("_before").withColumn("score", F.col(score))


def scored_pairs(candidates: DataFrame, reranker: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> DataFrame:
    """candidates (with query and text) with second, the score of an injected pair model that is loaded once a worker."""
    ship(candidates.sparkSession)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = reranker()
        for q, t in batches:
            yield pd.Series([float(x) for x in model(q.tolist(), t.tolist())])

    return candidates.withColumn("second", score("query", "text"))
