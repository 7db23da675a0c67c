"""Budgeted context packing, prompts and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeseek.functions.vector import words

BUDGET, MARGIN = 4000, 0.0


def rendered(marker: Column, title: Column, source: Column, text: Column) -> Column:
    head = F.concat(F.lit("["), marker.cast("string"), F.lit("]"), F.when(F.length(title) > 0, F.concat(F.lit(" "), title)).otherwise(""), F.when(F.length(source) > 0, F.concat(F.lit(" ("), source, F.lit(")"))).otherwise(""))
    return F.concat(head, F.lit("\n"), text)


def effective_budget(budget: int = BUDGET, margin: float = MARGIN) -> int:
    return int(budget * (1 - margin))


def pack(ranked: DataFrame, budget: int = BUDGET) -> DataFrame:
    """query_id, chunk_id, marker, passage, cost, total of the chunks (query_id, chunk_id, rank, title, source, text) that fit.

    A repeated chunk counts once; the first chunk always stays; the first that overflows ends the list.
    """
    once = ranked.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("rank"))).where("nth = 1").drop("nth")
    order = Window.partitionBy("query_id").orderBy("rank", "chunk_id")
    marked = once.withColumn("marker", F.row_number().over(order)).withColumn("passage", rendered(F.col("marker"), F.col("title"), F.col("source"), F.col("text"))).withColumn("cost", F.size(words(F.col("passage"))))
    total = marked.withColumn("total", F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return total.where((F.col("marker") == 1) | (F.col("total") <= budget))


def contexts(packed: DataFrame) -> DataFrame:
    """query_id, context, markers: the passages in order, a blank line between."""
    listed = packed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("marker", "chunk_id", "passage"))).alias("items"))
    return listed.select("query_id", F.array_join(F.transform("items", lambda x: x["passage"]), "\n\n").alias("context"), F.transform("items", lambda x: F.struct(x["marker"].alias("marker"), x["chunk_id"].alias("chunk_id"))).alias("items"))


def user_prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question)


def markers(answer: Column, claimed: Column) -> Column:
    """Markers written as [n] and those claimed, sorted."""
    scraped = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_sort(F.array_union(scraped, F.coalesce(claimed, F.array().cast("array<int>"))))


def citations(answers: DataFrame, packed: DataFrame) -> DataFrame:
    """query_id, marker, chunk_id of the markers of ``answers`` (query_id, markers) that a passage has; others drop out."""
    return answers.select("query_id", F.explode("markers").alias("marker")).join(packed.select("query_id", "marker", "chunk_id"), ["query_id", "marker"])
