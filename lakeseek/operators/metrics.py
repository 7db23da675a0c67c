"""Retrieval and answer metrics, judges, bootstrap intervals and the regression gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeseek.functions.ranks import running_total

RESAMPLES, ALPHA, TOLERANCE, SEED = 1000, 0.05, 0.03, 0
LCG_A, LCG_C, LCG_M = 1103515245, 12345, 1 << 31
DRAW_BLOCK = 16


def precision_at(retrieved: Column, relevant: Column, k: int) -> Column:
    if k <= 0:
        return F.lit(0.0)
    return F.size(F.filter(F.slice(retrieved, 1, k), lambda x: F.array_contains(relevant, x))) / F.lit(float(k))


def recall_at(retrieved: Column, relevant: Column, k: int) -> Column:
    top = F.slice(retrieved, 1, k) if k > 0 else F.array().cast("array<string>")
    return F.when(F.size(relevant) == 0, 1.0).otherwise(F.size(F.array_intersect(top, relevant)) / F.size(F.array_distinct(relevant)))


def reciprocal_rank(retrieved: Column, relevant: Column) -> Column:
    places = F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda i: i.isNotNull())
    return F.coalesce(1.0 / F.try_element_at(places, F.lit(1)), F.lit(0.0))


def ndcg_at(retrieved: Column, relevant: Column, k: int) -> Column:
    if k <= 0:
        return F.lit(0.0)
    gains = F.transform(F.slice(retrieved, 1, k), lambda x, i: F.when(F.array_contains(relevant, x), 1.0 / F.log2(i + 2.0)).otherwise(0.0))
    ideal = F.transform(F.sequence(F.lit(1), F.least(F.size(F.array_distinct(relevant)), F.lit(k))), lambda i: 1.0 / F.log2(i + 1.0))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(relevant) == 0, 0.0).otherwise(total(gains) / total(ideal))


def context_precision(flags: Column) -> Column:
    """Mean of the precisions at the relevant places; 0 without any."""
    hits = F.transform(flags, lambda f, i: F.when(f, F.size(F.filter(F.slice(flags, F.lit(1), i + 1), lambda x: x)) / (i + 1)))
    kept = F.filter(hits, lambda h: h.isNotNull())
    return F.when(F.size(kept) == 0, 0.0).otherwise(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept))


def supported_share(verdicts: Column, field: str = "supported") -> Column:
    """Share of verdicts that hold, over those that came back; 0 without any."""
    return F.when(F.coalesce(F.size(verdicts), F.lit(0)) <= 0, 0.0).otherwise(F.size(F.filter(verdicts, lambda v: v[field])) / F.size(verdicts))


def upper_median(votes: DataFrame, keys: list[str]) -> DataFrame:
    """The vote (score, rationale) in the upper middle of each item's votes; at least one is needed."""
    sorted_votes = votes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("score", "rationale"))).alias("v"))
    return sorted_votes.select(*keys, F.element_at("v", (F.floor(F.size("v") / 2) + 1).cast("int")).alias("m")).select(*keys, "m.score", "m.rationale")


def aligned(scores: DataFrame) -> DataFrame:
    """metric, item_id, base, new of run scores (run in base / new, item_id, metric, value) with ``matched`` false where a side lacks the pair."""
    base = scores.where("run = 'base'").select("metric", "item_id", F.col("value").alias("base"))
    new = scores.where("run = 'new'").select("metric", "item_id", F.col("value").alias("new"))
    both = base.withColumn("in_base", F.lit(True)).join(new.withColumn("in_new", F.lit(True)), ["metric", "item_id"], "full")
    return both.select("metric", "item_id", "base", "new", (F.coalesce("in_base", F.lit(False)) & F.coalesce("in_new", F.lit(False))).alias("matched"))


def scrambled(x: Column) -> Column:
    """One step of a linear congruential generator, its high bits folded in; the same integers in any SQL engine."""
    return (x * LCG_A + LCG_C) % LCG_M


def bootstrap(values: DataFrame, resamples: int = RESAMPLES, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """metric, mean, lo, hi of values (metric, value): percentile intervals of resampled means.

    Equal values are counted first and take consecutive places. A resample draws n places with replacement;
    the draws are made by place number, block by block, and meet the values' ranges of places by an equi-join on
    blocks of DRAW_BLOCK places. The work is resamples x n, as the method has it, dealt out by (metric, resample).
    """
    counted = values.groupBy("metric", "value").agg(F.count("*").alias("c"))
    placed = running_total(counted, ["metric"], ["value"], F.col("c"), "upto").withColumn("lo", F.col("upto") - F.col("c"))
    ranges = placed.select("metric", "value", "lo", "upto", F.explode(F.sequence(F.floor(F.col("lo") / DRAW_BLOCK), F.floor((F.col("upto") - 1) / DRAW_BLOCK))).alias("block"))
    sizes = values.groupBy("metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    resampled = sizes.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).repartition("metric", "resample")
    step = 4096
    spans = resampled.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))))
    draws = spans.withColumn("place", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + step, F.col("n")) - 1)))
    state = (F.col("resample") * 7919 + F.col("place") * 104729 + seed * 31 + 17) % LCG_M
    place = F.floor(scrambled(scrambled(scrambled(state))) / 65536) % F.col("n")
    drawn = draws.select("metric", "resample", "n", "mean", place.alias("place")).withColumn("block", F.floor(F.col("place") / DRAW_BLOCK))
    means = drawn.join(ranges, ["metric", "block"]).where("place >= lo and place < upto").groupBy("metric", "resample", "n", "mean").agg(F.sum("value").alias("total"))
    return means.groupBy("metric").agg(
        F.round(F.first("mean"), 9).alias("mean"), F.round(F.percentile(F.col("total") / F.col("n"), F.lit(alpha / 2)), 9).alias("lo"), F.round(F.percentile(F.col("total") / F.col("n"), F.lit(1 - alpha / 2)), 9).alias("hi"),
    )


def gate(scores: DataFrame, mode: str = "bootstrap", tolerance: float = TOLERANCE, floors: dict[str, float] | None = None, resamples: int = RESAMPLES, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """metric, base, new, delta, lo, hi, passed. Unmatched items, no metric at all, and NaN never pass."""
    if mode not in ("bootstrap", "threshold", "both"):
        raise ValueError(f"unknown mode: {mode}")
    if mode != "bootstrap" and not floors:
        raise ValueError("threshold modes need floors")
    pairs = aligned(scores)
    n, unmatched = pairs.agg(F.count("*"), F.count(F.when(~F.col("matched"), 1))).first()
    if not n or unmatched:
        raise ValueError(f"runs don't align: {n} pairs, {unmatched} on one side only")
    means = pairs.groupBy("metric").agg(F.avg("base").alias("base"), F.avg("new").alias("new"))
    if mode != "bootstrap" and not means.where(F.col("metric").isin(*floors)).limit(1).count():
        raise ValueError("no metric has a floor")
    ci = bootstrap(pairs.select("metric", (F.col("new") - F.col("base")).alias("value")), resamples, alpha, seed)
    table = means.join(ci.select("metric", F.col("mean").alias("delta"), "lo", "hi"), "metric")
    steady = ~F.isnan("hi") & (F.col("hi") >= -tolerance)
    floor = F.lit(None).cast("double")
    for m, least in (floors or {}).items():
        floor = F.when(F.col("metric") == m, F.lit(float(least))).otherwise(floor)
    above = floor.isNull() | (~F.isnan("new") & ~F.isnan(floor) & (F.col("new") >= floor))
    return table.withColumn("passed", {"bootstrap": steady, "threshold": above, "both": steady & above}[mode])


def fast_subset(items: DataFrame, n: int = 15, seed: int = SEED, key: str = "item_id") -> DataFrame:
    """A fixed sample of ``n`` items: those with the least hash of id and seed."""
    return items.withColumn("draw", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)).orderBy("draw").limit(n).drop("draw")


def evaluated(outputs: DataFrame, k: int = 5) -> DataFrame:
    """item_id, metric, value of outputs (item_id, retrieved, relevant)."""
    r, g = F.col("retrieved"), F.col("relevant")
    wide = outputs.select("item_id", precision_at(r, g, k).alias("precision"), recall_at(r, g, k).alias("recall"), reciprocal_rank(r, g).alias("mrr"), ndcg_at(r, g, k).alias("ndcg"))
    return wide.unpivot("item_id", ["precision", "recall", "mrr", "ndcg"], "metric", "value")
