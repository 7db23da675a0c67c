"""Cost and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeseek.functions.ranks import running_total
from lakeseek.operators import redaction

# Dollars per 1000 input and output tokens.
PRICES = [
    ("meta/llama-3.3-70b-instruct", 0.00, 0.00),
    ("meta/llama-3.1-8b-instruct", 0.00, 0.00),
    ("nvidia/nv-embedqa-e5-v5", 0.00, 0.00),
    ("baai/bge-m3", 0.00, 0.00),
    ("nvidia/llama-3.2-nv-rerankqa-1b-v2", 0.00, 0.00),
    ("BAAI/bge-reranker-v2-m3", 0.00, 0.00),
    ("claude-sonnet-4-6", 0.003, 0.015),
    ("claude-haiku-4-5-20251001", 0.00025, 0.00125),
]


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "model string, input_rate double, output_rate double")


def priced(usage: DataFrame, table: DataFrame) -> DataFrame:
    """Usage rows (model, prompt_tokens, completion_tokens) with cost_usd; an unknown model costs 0 and is flagged."""
    joined = usage.join(F.broadcast(table), "model", "left")
    cost = F.col("prompt_tokens") / 1000.0 * F.col("input_rate") + F.col("completion_tokens") / 1000.0 * F.col("output_rate")
    return joined.withColumn("cost_usd", F.coalesce(cost, F.lit(0.0))).withColumn("known_model", F.col("input_rate").isNotNull()).drop("input_rate", "output_rate")


def per_thousand(total: Column, n: Column) -> Column:
    return F.when(n == 0, 0.0).otherwise(total / n * 1000)


def summary(runs: DataFrame, keys: list[str] | None = None, value: str = "latency_ms", cost: str = "cost_usd") -> DataFrame:
    """n, mean, median, p95, min, max of latency and mean and total of cost; missing values are skipped, n counts all rows.

    p95 is the element at max(0, int(0.95 n) - 1) of the sorted values, the median the middle one or the mean of
    the middle two. They are found by counting equal values and summing up the counts range by range, so that
    neither a list of all values is built nor one task sees a whole group.
    """
    by = keys or ["_all"]
    rows = runs if keys else runs.withColumn("_all", F.lit(1))
    stats = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count(value).alias("n_latency"), F.round(F.avg(value), 6).alias("mean"),
        F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.avg(cost), 9).alias("cost_mean"), F.round(F.sum(cost), 6).alias("cost_total"),
    )
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    placed = running_total(counted, by, [value], F.col("c"), "upto").join(stats.select(*by, F.col("n_latency").alias("all")), by)

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("upto") > place, F.col(value)))

    last = F.col("all") - 1
    points = placed.groupBy(*by).agg(
        F.round((at(F.floor(last / 2)) + at(F.ceil(last / 2))) / 2, 6).alias("median"), at(F.greatest(F.lit(0), F.floor(0.95 * F.col("all")) - 1)).alias("p95"),
    )
    return stats.join(points, by, "left").select(*(keys or []), "n", "n_latency", "mean", "median", "min", "max", "cost_mean", "cost_total", "p95")


def metric_summary(runs: DataFrame) -> DataFrame:
    """metric, mean, min, max over the maps of runs (metrics: map<string,double>)."""
    each = runs.select(F.explode("metrics").alias("metric", "value"))
    return each.groupBy("metric").agg(F.round(F.avg("value"), 9).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))


def nan_mean(value: Column) -> Column:
    """Mean of the values that are numbers; NaN where there are none."""
    return F.coalesce(F.avg(F.when(~F.isnan(value), value)), F.lit(float("nan")))


def trace_rows(answers: DataFrame, hits: DataFrame, usage: DataFrame, table: DataFrame, at: Column) -> DataFrame:
    """One value-free row per question: its hits (chunk_id, score) in order, tokens, cost and time.

    answers: query_id, refused, blocked, cache; hits: query_id, chunk_id, rank, score (at most a ranking's
    length); usage: query_id, model, prompt_tokens, completion_tokens.
    """
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("hits"))
    spent = priced(usage, table).groupBy("query_id").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("cost_usd").alias("cost_usd"))
    rows = answers.join(listed, "query_id", "left").join(spent, "query_id", "left")
    none = F.array().cast("array<struct<rank:int,chunk_id:string,score:double>>")
    return rows.select(
        "query_id", "refused", "blocked", "cache", F.coalesce("hits", none).alias("hits"), F.coalesce(F.size("hits"), F.lit(0)).alias("n_hits"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("prompt_tokens", "completion_tokens")],
        (F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))).cast("long").alias("total_tokens"), F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"), at.alias("at"),
    )


def run_scores(traces: DataFrame, scores: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """trace_id, item_id, scores (map of name to number) of traces (trace_id, item_id), the last value of a name (by seq) kept.

    Values that are no numbers drop out; a trace without scores keeps an empty map; ``wanted`` (item_id) narrows the items.
    """
    kept = traces if wanted is None else traces.join(wanted.select("item_id").distinct(), "item_id", "left_semi")
    number = F.col("value").try_cast("double")
    last = scores.where(number.isNotNull()).groupBy("trace_id", "name").agg(F.max_by(number, F.col("seq")).alias("value"))
    maps = last.groupBy("trace_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("scores"))  # a number per metric
    empty = F.expr("cast(map() as map<string,double>)")
    return kept.join(maps, "trace_id", "left").select("trace_id", "item_id", F.coalesce("scores", empty).alias("scores"))


def masked(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``rows`` with every string in ``columns`` (all by default) free of personal data, also inside arrays, maps and structs.

    Map keys stay. Spans come from the detector of ingestion, one Arrow pass per string leaf; leaves of lists are
    taken out, cleaned and put back by position.
    """
    def clean(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return redaction.cleaned(value)
        if isinstance(kind, T.StructType):
            return F.when(value.isNotNull(), F.struct(*[clean(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            return redaction.cleaned_list(value)
        if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StringType):
            return F.when(value.isNotNull(), F.map_from_arrays(F.map_keys(value), redaction.cleaned_list(F.map_values(value))))
        if isinstance(kind, (T.ArrayType, T.MapType)):
            return F.from_json(redaction.cleaned_json(F.to_json(value)), kind)
        return value

    return rows.select(*[clean(F.col(f.name), f.dataType).alias(f.name) if columns is None or f.name in columns else F.col(f.name) for f in rows.schema.fields])
