"""Experiments: answers to a golden set, nine metrics per item, stored scores, and the gate over two runs."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek.functions import vector
from lakeseek.functions.vector import tokens
from lakeseek.operators import metrics
from lakeseek.plans import answer

VERDICTS = "array<struct<supported:boolean>>"
RELEVANT = "array<struct<relevant:boolean>>"
VOTE = "score double, rationale string"


def parsed_verdicts(reply: Column, kind: str = VERDICTS) -> Column:
    """Verdicts of a judge's JSON reply, bare or under ``verdicts``; a malformed reply counts as none."""
    bare, wrapped = F.from_json(reply, kind), F.from_json(reply, f"struct<verdicts:{kind}>")["verdicts"]
    return F.coalesce(F.when(F.ltrim(reply).startswith("["), bare), wrapped, F.array().cast(kind))


def _sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[.\n]"), lambda s: F.trim(s)), lambda s: s != "")


def _held(claims: Column, contexts: Column, field: str) -> Column:
    """The offline judge: a claim holds if at least half of its words stand in the contexts. As JSON."""
    known = tokens(F.array_join(contexts, " "))
    return F.to_json(F.transform(claims, lambda c: F.struct((F.size(F.array_intersect(tokens(c), known)) * 2 >= F.size(F.array_distinct(tokens(c)))).alias(field))))


def judged_claims(question: Column, text: Column, contexts: Column) -> Column:
    return _held(_sentences(text), contexts, "supported")


def judged_contexts(question: Column, text: Column, contexts: Column) -> Column:
    return F.to_json(F.transform(contexts, lambda c: F.struct((F.size(F.array_intersect(tokens(c), tokens(text))) * 2 >= F.size(F.array_distinct(tokens(text)))).alias("relevant"))))


def judged_whole(question: Column, text: Column, contexts: Column, seed: int) -> Column:
    share = F.size(F.array_intersect(tokens(text), tokens(question))) / F.greatest(F.lit(1), F.size(F.array_distinct(tokens(question))))
    return F.to_json(F.struct(F.round(share, 6).alias("score"), F.lit(f"vote {seed}").alias("rationale")))


def outputs(golden: DataFrame, chunks: DataFrame, **path) -> DataFrame:
    """item_id, question, expected, relevant, answer, contexts (texts), retrieved (document ids) of golden rows.

    golden: item_id, question, expected_output, relevant (array<string>) and the caller's columns.
    """
    queries = golden.withColumnRenamed("item_id", "query_id")
    done = answer.staged(answer.answers(queries.drop("expected_output", "relevant"), chunks, **path))
    texts = done.select("query_id", F.explode("context_ids").alias("chunk_id")).join(queries.select("query_id", "tenant_id"), "query_id").join(chunks.select("tenant_id", "chunk_id", "text"), ["tenant_id", "chunk_id"])
    contexts = texts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))).alias("c")).select("query_id", F.transform("c", lambda x: x["text"]).alias("contexts"))
    none = F.array().cast("array<string>")
    return queries.join(done.select("query_id", "answer", "doc_ids"), "query_id").join(contexts, "query_id", "left").select(
        F.col("query_id").alias("item_id"), "question", F.col("expected_output").alias("expected"), "relevant", "answer", F.coalesce("contexts", none).alias("contexts"), F.col("doc_ids").alias("retrieved"),
    )


def evaluated(rows: DataFrame, k: int = 5, votes: int = 1, seed: int = 0, claims=judged_claims, relevance=judged_contexts, whole=judged_whole) -> DataFrame:
    """item_id, metric, value: four retrieval metrics, four of the answer, and the judge's score.

    ``claims``, ``relevance`` and ``whole`` are column functions that give a judge's JSON; the defaults work offline.
    """
    q, a, c, r, g = (F.col(x) for x in ("question", "answer", "contexts", "retrieved", "relevant"))
    by_bucket = lambda text, name: answer.vectors_of(rows.select("item_id", F.explode(tokens(F.col(text))).alias("term"), F.lit(1).alias("tf")), ["item_id"], name)
    both = rows.join(by_bucket("question", "qv"), "item_id", "left").join(by_bucket("answer", "av"), "item_id", "left")
    flags = F.transform(parsed_verdicts(relevance(q, a, c), RELEVANT), lambda v: F.coalesce(v["relevant"], F.lit(False)))
    ballots = F.filter(F.array(*[F.from_json(whole(q, a, c, seed + i), VOTE) for i in range(votes)]), lambda v: v["score"].isNotNull())
    scores = F.array_sort(F.transform(ballots, lambda v: v["score"]))
    wide = both.select(
        "item_id", metrics.recall_at(r, g, k).alias(f"recall_at_{k}"), metrics.precision_at(r, g, k).alias(f"precision_at_{k}"), metrics.reciprocal_rank(r, g).alias("mrr"), metrics.ndcg_at(r, g, k).alias(f"ndcg_at_{k}"),
        metrics.supported_share(parsed_verdicts(claims(q, a, c))).alias("faithfulness"), F.coalesce(vector.cosine(F.col("qv"), F.col("av")), F.lit(0.0)).alias("answer_relevancy"),
        metrics.context_precision(flags).alias("context_precision"), metrics.supported_share(parsed_verdicts(claims(q, F.col("expected"), c))).alias("context_recall"),
        F.coalesce(F.try_element_at(scores, (F.floor(F.size(scores) / 2) + 1).cast("int")), F.lit(0.0)).alias("judge_score"),
    )
    return wide.unpivot("item_id", [x for x in wide.columns if x != "item_id"], "metric", "value")


def run(golden: DataFrame, chunks: DataFrame, name: str, limit: int | None = None, fast: bool = False, **judges) -> DataFrame:
    """run, item_id, metric, value of one experiment; ``limit`` keeps the first items by id, ``fast`` the fixed sample. No items is a fault."""
    items = golden.orderBy("item_id").limit(limit) if limit else golden
    items = metrics.fast_subset(items) if fast else items
    if not items.limit(1).count():
        raise ValueError("the golden set is empty")
    return evaluated(outputs(items, chunks), **judges).select(F.lit(name).alias("run"), "item_id", "metric", "value")


def store(scores: DataFrame, path: str) -> None:
    """Scores by run; a run of the same name is replaced."""
    scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def stored(spark: SparkSession, path: str, base: str, new: str) -> DataFrame:
    """The two runs as the gate takes them. Values that are no numbers drop out."""
    rows = spark.read.parquet(path).where("value is not null")
    sides = [rows.where(F.col("run") == name).select(F.lit(side).alias("run"), "item_id", "metric", "value") for side, name in (("base", base), ("new", new))]
    return sides[0].unionByName(sides[1])


def report(table: DataFrame, path: str) -> None:
    """Means and verdicts as one JSON row per metric."""
    table.write.mode("overwrite").json(path)


def main(arguments: list[str] | None = None) -> int:
    """The gate as a command: exit code 0 if every metric passes, else 1."""
    ask = argparse.ArgumentParser(description="Compare a stored run with a baseline run.")
    ask.add_argument("--scores", required=True, help="folder of stored scores")
    ask.add_argument("--new-run", required=True)
    ask.add_argument("--baseline-run", required=True)
    ask.add_argument("--mode", choices=["bootstrap", "threshold", "both"], default="bootstrap")
    ask.add_argument("--tolerance", type=float, default=metrics.TOLERANCE)
    ask.add_argument("--floor", action="append", default=[], help="metric=value")
    given = ask.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    floors = {k: float(v) for k, v in (f.split("=", 1) for f in given.floor)}
    try:
        table = metrics.gate(stored(spark, given.scores, given.baseline_run, given.new_run), given.mode, given.tolerance, floors or None).collect()  # a row per metric
    except ValueError as fault:
        print(f"gate: {fault}", file=sys.stderr)
        return 1
    for r in table:
        print(f"{r.metric}: {r.base:.4f} -> {r.new:.4f} [{r.lo:.4f}, {r.hi:.4f}] {'passed' if r.passed else 'FAILED'}")
    return 0 if table and all(r.passed for r in table) else 1


if __name__ == "__main__":
    sys.exit(main())
