"""Readers and derived dimensions of the supplied tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TAGS = "array<string>"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tenant_of(doc_id: Column) -> Column:
    """5 / 5 / 90 split by a bucket of the id."""
    return F.when(doc_id % 20 == 0, "tenant_a").when(doc_id % 20 == 1, "tenant_b").otherwise("public")


def tags_of(doc_id: Column) -> Column:
    return F.when(doc_id % 10 == 3, F.array(F.lit("board"))).otherwise(F.array().cast(TAGS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, tenant_id, acl_tags, collection_id, source, title of every document."""
    d = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), tenant_of(d).alias("tenant_id"), tags_of(d).alias("acl_tags"),
        F.col("lang").alias("collection_id"), "source", F.concat(F.lit("doc "), d.cast("string")).alias("title"),
    )


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one retrievable chunk; seq is its insertion order."""
    return documents(spark, sf_dir).withColumn("chunk_id", F.format_string("%s::%06d", F.col("doc_id").cast("string"), F.lit(0))).withColumn("seq", F.col("doc_id"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"), (F.col("label") % 3).cast("string").alias("tenant_id"),
        F.when(F.col("label") >= 7, F.array(F.lit("board"))).otherwise(F.array().cast(TAGS)).alias("acl_tags"), (F.col("label") % 2).cast("string").alias("collection_id"),
    )


def vector_queries(vecs: DataFrame) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 100, as a caller of its own tenant."""
    return vecs.where("vec_id % 100 = 0").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), "tenant_id",
        F.when(F.col("vec_id") % 200 == 0, F.array(F.lit("board"))).otherwise(F.array().cast(TAGS)).alias("caller_tags"), F.lit(None).cast("string").alias("query_collection"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items as questions of an untagged public caller."""
    return as_questions(read(spark, sf_dir, "benchmark"))


def as_questions(items: DataFrame) -> DataFrame:
    return items.where("text is not null").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.lit("public").alias("tenant_id"),
        F.array().cast(TAGS).alias("caller_tags"), F.lit(None).cast("string").alias("query_collection"),
    )


def callers(spark: SparkSession) -> DataFrame:
    rows = [(0, "public", []), (1, "tenant_a", []), (2, "tenant_a", ["board"]), (3, "tenant_b", ["board"]), (4, "public", ["board", "staff"])]
    return spark.createDataFrame(rows, "caller_id int, tenant_id string, caller_tags array<string>")
