"""Continuous ingestion: file stream, keyed upserts per micro-batch, replay-safe."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATUS_OF = {"view": "processing", "click": "ready", "purchase": "ready", "error": "failed"}


def file_stream(spark: SparkSession, folder: str, name: str, schema, per_trigger: int = 1000) -> DataFrame:
    """New files of ``folder`` that are called, or lie in a folder called, ``name``."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", per_trigger).parquet(f"{folder}/{name}*")


def status_of(event_type: str = "event_type"):
    out = F.lit("processing")
    for event, status in STATUS_OF.items():
        out = F.when(F.col(event_type) == event, status).otherwise(out)
    return out


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    nth = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return rows.withColumn("nth", F.row_number().over(nth)).where("nth = 1").drop("nth")


def upsert_into(folder: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes the keys whose latest row has changed, by batch; a replayed batch writes the same again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def run_upserts(stream: DataFrame, folder: str, keys: list[str], order: list[str]) -> DataFrame:
    """Process what there is, and return the latest row of every key.

    The state store keeps the latest row per key; a batch writes only the keys it has changed, so its cost follows the
    batch and not the table. ``compacted`` folds the batches into one from time to time.
    """
    spark, columns = stream.sparkSession, stream.columns
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{folder}/table/batch=-1")
    state = stream.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r")).select("r.*")
    query = state.writeStream.outputMode("update").foreachBatch(upsert_into(f"{folder}/table")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return table_of(spark, folder, stream.schema, keys, order)


def table_of(spark: SparkSession, folder: str, schema, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of every key of what ``run_upserts`` has written under ``folder``."""
    written = spark.read.schema(schema).parquet(f"{folder}/table/batch=*")
    return written.groupBy(*keys).agg(F.max_by(F.struct(*written.columns), F.struct(*order)).alias("r")).select("r.*")


def compacted(spark: SparkSession, folder: str, schema, keys: list[str], order: list[str], to: str) -> DataFrame:
    """The table written to ``to`` as one version, to start from with a new ``folder``."""
    table_of(spark, folder, schema, keys, order).write.mode("overwrite").parquet(to)
    return spark.read.schema(schema).parquet(to)


def live_counts(stream: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events per hour and type; a late event within ``delay`` still counts."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")
