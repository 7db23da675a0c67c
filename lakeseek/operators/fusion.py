"""Reciprocal-rank fusion, reranking and what hangs on ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeseek.functions.vector import tokens

RRF_K, FUSE_WINDOW, RERANK_TOP = 60, 40, 8


def fuse(rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """query_id, chunk_id, score, rank, component_scores from rows (query_id, source, chunk_id, score).

    Each list is ranked anew by score, then chunk_id; shares 1 / (k + rank) are summed per chunk.
    """
    each = Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "chunk_id")
    shares = rankings.withColumn("r", F.row_number().over(each)).groupBy("query_id", "chunk_id", "source").agg(F.sum(1.0 / (k + F.col("r"))).alias("share"), F.max("score").alias("score"))
    merged = shares.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum("share"), 12).alias("score2"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "score")))).alias("component_scores")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score2"), "chunk_id")
    return merged.select("query_id", "chunk_id", F.col("score2").alias("score"), F.row_number().over(order).alias("rank"), "component_scores")


def rerank(candidates: DataFrame, scored, top: int = RERANK_TOP) -> DataFrame:
    """The best ``top`` of each question's candidates (query_id, chunk_id, rank, ...) by the column ``scored``; ties keep their order."""
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    again = candidates.withColumn("rerank_score", scored).withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= top)
    return again.withColumn("rank", F.col("new_rank")).drop("new_rank")


def overlap_score(question: str = "question", text: str = "text"):
    """Words that question and text share; the offline default in a cross-encoder's place."""
    return F.size(F.array_intersect(tokens(F.col(question)), tokens(F.col(text)))).cast("double")


def normalised(candidates: DataFrame, scored: DataFrame, top: int) -> DataFrame:
    """A reranker's (query_id, index, score) joined to candidates (query_id, index, chunk_id); unknown indices drop out."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "index")
    return candidates.join(scored, ["query_id", "index"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def documents_of(ranked: DataFrame) -> DataFrame:
    """query_id, doc_id, rank: each document once, at its best chunk's place."""
    best = ranked.groupBy("query_id", "doc_id").agg(F.min("rank").alias("best"))
    return best.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("best", "doc_id")).alias("rank"))
