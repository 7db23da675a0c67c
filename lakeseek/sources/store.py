"""Tables on shared storage: an index laid out by tenant, replaced by partition; versions with a pointer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek.operators.acl import tenant_key

LAYOUT = ["tenant_key", "collection_key"]


def checked(chunks: DataFrame, dimension: int) -> DataFrame:
    """Chunks whose embeddings are there and have ``dimension`` numbers; any other fails the job."""
    size = F.size("embedding")
    told = F.when(F.col("embedding").isNull(), F.raise_error(F.lit("a chunk has no embedding"))).when(size != dimension, F.raise_error(F.lit("an embedding has the wrong dimension"))).otherwise(F.col("embedding"))
    return chunks.withColumn("embedding", told)


def keyed(chunks: DataFrame) -> DataFrame:
    """Columns of the layout: digests, so that a hostile tenant name can't leave the table's folder."""
    return chunks.withColumn("tenant_key", tenant_key(F.col("tenant_id"))).withColumn("collection_key", F.sha2(F.coalesce("collection_id", F.lit("")), 256))


def replace_tenants(chunks: DataFrame, path: str) -> None:
    """Write an index; the partitions that ``chunks`` touch are replaced, others stay."""
    keyed(chunks).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*LAYOUT).parquet(path)


def read_index(spark: SparkSession, path: str, tenant: str | None = None) -> DataFrame:
    """The index, or one tenant's partitions: the filter prunes folders before anything is read."""
    table = spark.read.parquet(path)
    if tenant is not None:
        table = table.where(F.col("tenant_key") == spark.range(1).select(tenant_key(F.lit(tenant))).first()[0])
    return table.drop(*LAYOUT)


def payload(chunks: DataFrame) -> DataFrame:
    """chunk_id, vector and the other columns as one JSON payload with acl_open."""
    rest = [c for c in chunks.columns if c not in ("chunk_id", "embedding")]
    return chunks.select("chunk_id", F.col("embedding").alias("vector"), F.to_json(F.struct(*rest, (F.size("acl_tags") == 0).alias("acl_open"))).alias("payload"))


def from_payload(points: DataFrame, ddl: str) -> DataFrame:
    return points.select("chunk_id", F.col("vector").alias("embedding"), F.from_json("payload", ddl).alias("p")).select("chunk_id", "embedding", "p.*")


def count_visible(chunks: DataFrame, caller: DataFrame | None = None) -> int:
    """Exact count, within a caller's rights if one is given (a row: tenant_id, caller_tags, query_collection)."""
    from lakeseek.operators.acl import visible

    return chunks.count() if caller is None else visible(F.broadcast(caller.limit(1)), chunks).count()


def export_golden(items: DataFrame, path: str) -> None:
    """Golden rows with ids of their own, as JSON."""
    own = F.sha2(F.concat_ws("\x1f", "tenant_id", "question"), 256).substr(1, 16)
    items.withColumn("id", own).write.mode("overwrite").json(path)


def append_audit(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)
