"""Intent routing, reciprocal rank fusion and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RRF_K = 60
#: The words that route a query.
GLOBAL_TERMS = "summarize summarise summary summaries theme themes overview overall general big-picture".split()
MULTI_HOP_TERMS = "relate relates related relation relations relationship relationships connect connects connected connection connections influence influences affects path paths between".split()


def intent(query: Column, use_global: bool = True, use_multi_hop: bool = True) -> Column:
    """global_theme, multi_hop or specific, by whole words; null queries are specific."""
    tokens = F.transform(F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(r"[A-Za-z][A-Za-z\-]*"), F.lit(0)), F.lower)
    lane = F.when(F.lit(use_global) & F.arrays_overlap(tokens, F.array(*map(F.lit, GLOBAL_TERMS))), "global_theme")
    return lane.when(F.lit(use_multi_hop) & F.arrays_overlap(tokens, F.array(*map(F.lit, MULTI_HOP_TERMS))), "multi_hop").otherwise("specific")


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, key: str, k: int = RRF_K) -> DataFrame:
    """(key, vector_score, keyword_score, rrf) of hits (key, rank, score) of both legs, each adding 1 / (k + rank).

    A hit that comes twice in a leg adds twice; a missing leg scores 0. Ties keep the vector leg's order, then the other's.
    """
    v = vector_hits.select(key, F.lit(0).alias("_leg"), "rank", "score")
    w = keyword_hits.select(key, F.lit(1).alias("_leg"), "rank", "score")
    both = v.unionByName(w).where(F.col(key).isNotNull())
    leg = lambda n: F.col("_leg") == n
    return both.groupBy(key).agg(
        F.coalesce(F.min_by(F.when(leg(0), F.col("score")), F.when(leg(0), F.col("rank"))), F.lit(0.0)).alias("vector_score"),
        F.coalesce(F.min_by(F.when(leg(1), F.col("score")), F.when(leg(1), F.col("rank"))), F.lit(0.0)).alias("keyword_score"),
        F.sum(1 / (F.lit(k) + F.col("rank"))).alias("rrf"), F.min(F.struct("_leg", "rank")).alias("_first"),
    )


def top(fused: DataFrame, n: int) -> DataFrame:
    return fused.orderBy(F.desc("rrf"), "_first").limit(n).drop("_first")


def hybrid_search(query: str, vector_hits: DataFrame, keyword_hits: DataFrame, key: str, n: int, summaries: DataFrame, context: DataFrame) -> dict:
    """What a lane retrieves: summaries alone for global themes, else fused hits, with graph context for multi-hop queries."""
    spark = vector_hits.sparkSession
    lane = spark.range(1).select(intent(F.lit(query)).alias("lane")).first()["lane"]
    if lane == "global_theme":
        return {"lane": lane, "chunks": None, "summaries": summaries, "context": None}
    return {"lane": lane, "chunks": top(fuse(vector_hits, keyword_hits, key), n), "summaries": None, "context": context if lane == "multi_hop" else None}
