"""Incremental ingestion: content hashes, the diff against a manifest, and the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeseek.operators.chunking import embed_text

MANIFEST = ["tenant_id", "doc_id", "chunk_id", "ordinal", "embed_hash", "meta_hash"]


def hashed(chunks: DataFrame) -> DataFrame:
    """Manifest rows of chunks; metadata covers title, tenant, tags, collection and source."""
    text = embed_text() if "contextual_prefix" in chunks.columns else F.col("text")
    meta = F.concat_ws(":", F.coalesce("title", F.lit("")), "tenant_id", F.array_join(F.array_sort("acl_tags"), ","), F.coalesce("collection_id", F.lit("")), F.coalesce("source", F.lit("")))
    return chunks.select("tenant_id", "doc_id", "chunk_id", "ordinal", F.sha2(text, 256).alias("embed_hash"), F.sha2(meta, 256).alias("meta_hash"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """tenant_id, doc_id, chunk_id, action: embed (new or changed text), meta, delete or noop."""
    key = ["tenant_id", "doc_id", "chunk_id"]
    o = old.select(*key, F.col("embed_hash").alias("old_embed"), F.col("meta_hash").alias("old_meta"))
    n = new.select(*key, F.col("embed_hash").alias("new_embed"), F.col("meta_hash").alias("new_meta"))
    action = (
        F.when(F.col("new_embed").isNull(), "delete").when(F.col("old_embed").isNull() | (F.col("old_embed") != F.col("new_embed")), "embed")
        .when(F.col("old_meta") != F.col("new_meta"), "meta").otherwise("noop")
    )
    return o.join(n, key, "full").select(*key, action.alias("action"))


def after(old: DataFrame, new: DataFrame, documents: DataFrame) -> DataFrame:
    """The manifest once the documents (tenant_id, doc_id) have been ingested as ``new``; others stay."""
    return old.join(documents.select("tenant_id", "doc_id").distinct(), ["tenant_id", "doc_id"], "left_anti").select(*MANIFEST).unionByName(new.select(*MANIFEST))


def without_documents(table: DataFrame, documents: DataFrame) -> DataFrame:
    return table.join(documents.select("tenant_id", "doc_id").distinct(), ["tenant_id", "doc_id"], "left_anti")


def patched(index: DataFrame, updates: DataFrame) -> DataFrame:
    """Titles and tags of an index replaced where ``updates`` (tenant_id, chunk_id, title, acl_tags) has the chunk."""
    u = updates.select("tenant_id", "chunk_id", F.col("title").alias("new_title"), F.col("acl_tags").alias("new_tags"))
    joined = index.join(u, ["tenant_id", "chunk_id"], "left")
    return joined.withColumn("title", F.coalesce("new_title", "title")).withColumn("acl_tags", F.coalesce("new_tags", "acl_tags")).withColumn("acl_open", F.size("acl_tags") == 0).drop("new_title", "new_tags")


def one_per_key(rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row of each key: the greatest by ``order``, then by its other columns."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    told = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate([*(order or []), *rest])])
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), told).alias("last"))
    return last.select(*keys, "last.*").select(*rows.columns)


def upserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with ``rows`` in place of those of the same keys; of repeated keys in ``rows`` one row counts."""
    rows = one_per_key(rows, keys)
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def inserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """On conflict do nothing; of repeated keys in ``rows`` one row counts."""
    rows = one_per_key(rows, keys)
    return table.select(*table.columns).unionByName(rows.join(table.select(*keys), keys, "left_anti").select(*table.columns))


def latest_status(events: DataFrame) -> DataFrame:
    """The registry's state: the last event (tenant_id, document_id, seq, status, ...) of each document."""
    order = Window.partitionBy("tenant_id", "document_id").orderBy(F.desc("seq"))
    return events.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def failed(rows: DataFrame, error: str = "error") -> DataFrame:
    """Registry updates of an ingestion run: failed rows carry the error's name, others how many chunks they have."""
    bad = F.col(error).isNotNull()
    return rows.withColumn("status", F.when(bad, "failed").otherwise("ready")).withColumn("chunk_count", F.when(bad, F.lit(None)).otherwise(F.col("chunk_count")))
