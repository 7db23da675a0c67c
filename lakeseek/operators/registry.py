"""The document registry, manifests and blobs as tables, and ingestion and deletion runs over many documents at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek.functions.ranks import numbered
from lakeseek.operators import cache, chunking, incremental, redaction
from lakeseek.operators.acl import allowed
from lakeseek.sources import files as uploads
from lakeseek.sources.staging import staged

SCHEMA = (
    "document_id string NOT NULL, tenant_id string NOT NULL, filename string NOT NULL, content_type string NOT NULL, size_bytes bigint NOT NULL, status string NOT NULL, "
    "blob_key string NOT NULL, collection_id string, error string, chunk_count int, created_at timestamp, updated_at timestamp"
)
KEY = ["document_id"]
PUBLIC = ["document_id", "filename", "content_type", "size_bytes", "status", "chunk_count", "collection_id", "error"]


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def created(registry: DataFrame, rows: DataFrame) -> DataFrame:
    """The registry with new documents; one that is there already stays as it is."""
    return incremental.inserted(registry, rows, KEY)


def of_tenant(registry: DataFrame, tenant: str) -> DataFrame:
    return registry.where(F.col("tenant_id") == tenant)


def listed(registry: DataFrame, callers: DataFrame) -> DataFrame:
    """caller_id, place and the public columns of the documents of callers (caller_id, tenant_id, wanted collection or null), newest first.

    Tenant and blob key stay inside. Documents are numbered range by range, so one tenant's long list is no single task.
    """
    mine = registry.join(callers.select("caller_id", "tenant_id", "wanted"), "tenant_id").where(F.col("wanted").isNull() | (F.col("collection_id") == F.col("wanted")))
    placed = numbered(mine, ["caller_id"], [F.desc("created_at"), F.col("document_id")], "place")
    return placed.select("caller_id", "place", *PUBLIC)


def found(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """The public columns of the documents asked for (document_id, tenant_id); another tenant's are not found."""
    return registry.join(wanted.select("document_id", "tenant_id").distinct(), ["document_id", "tenant_id"]).select(*PUBLIC)


def with_status(registry: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """Statuses (document_id, tenant_id, status, error, chunk_count) set; updates of rows that aren't there do nothing."""
    u = updates.select("document_id", "tenant_id", F.struct("status", F.coalesce("error", F.lit("")).alias("error"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count")).alias("new"))
    joined = registry.join(u, ["document_id", "tenant_id"], "left")
    changed = F.col("new").isNotNull()
    replaced = {c: F.when(changed, F.col(f"new.{c}")).otherwise(F.col(c)) for c in ("status", "error", "chunk_count")} | {"updated_at": F.when(changed, now).otherwise(F.col("updated_at"))}
    return joined.select(*[replaced.get(c, F.col(c)).alias(c) for c in registry.columns])


def deleted(registry: DataFrame, gone: DataFrame) -> DataFrame:
    """The registry without documents (document_id, tenant_id); those that aren't there are no fault."""
    return registry.join(gone.select("document_id", "tenant_id").distinct(), ["document_id", "tenant_id"], "left_anti").select(*registry.columns)


# ---- chunks by id, within a caller's rights ------------------------------------------------


def within_rights(index: DataFrame, asked: DataFrame) -> DataFrame:
    """tenant_id, chunk_id of the chunks asked for (tenant_id, chunk_id, caller_tags) that their callers may touch."""
    pairs = index.select("tenant_id", "chunk_id", "acl_tags").join(asked.select("tenant_id", "chunk_id", "caller_tags"), ["tenant_id", "chunk_id"])
    return pairs.where(allowed(F.col("acl_tags"), F.col("caller_tags"))).select("tenant_id", "chunk_id").distinct()


def without_chunks(index: DataFrame, asked: DataFrame) -> DataFrame:
    return index.join(within_rights(index, asked), ["tenant_id", "chunk_id"], "left_anti").select(*index.columns)


def patched_chunks(index: DataFrame, updates: DataFrame) -> DataFrame:
    """Titles and tags (tenant_id, chunk_id, caller_tags, title, acl_tags) replaced where the update's own caller may touch the chunk.

    Each update is held against the tags of its own caller. Of several permitted updates of one chunk the one of
    highest ``seq`` counts where there is such a column, then the greatest title and tags.
    """
    key = ["tenant_id", "chunk_id"]
    held = index.select(*key, F.col("acl_tags").alias("held_tags"))
    permitted = updates.join(held, key).where(allowed(F.col("held_tags"), F.col("caller_tags")))
    order = [c for c in ("seq",) if c in updates.columns]
    last = permitted.groupBy(*key).agg(F.max(F.struct(*order, "title", "acl_tags")).alias("u"))
    return incremental.patched(index, last.select(*key, "u.title", "u.acl_tags"))


# ---- manifests and blobs -------------------------------------------------------------------


def save_manifests(manifest: DataFrame, path: str) -> None:
    """Manifest rows laid out by document digest; the partitions of the documents in ``manifest`` are replaced."""
    bucket = F.pmod(F.xxhash64("tenant_id", "doc_id"), F.lit(256))
    manifest.withColumn("bucket", bucket).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def load_manifests(spark: SparkSession, path: str, documents: DataFrame) -> DataFrame:
    """Manifest rows of documents (tenant_id, doc_id). Rows whose identity or hashes are missing count as not there."""
    rows = spark.read.parquet(path).drop("bucket").where("chunk_id is not null and embed_hash is not null and meta_hash is not null")
    return rows.join(documents.select("tenant_id", "doc_id").distinct(), ["tenant_id", "doc_id"], "left_semi").select(*incremental.MANIFEST)


def blob_key(tenant: Column, document: Column, filename: Column) -> Column:
    """A key that no name can lead out of its folder: digests of tenant and document, then the file's bare name."""
    return F.concat_ws("/", F.sha2(tenant, 256), F.sha2(document.cast("string"), 256), F.regexp_replace(F.regexp_extract(filename, r"[^/\\]*$", 0), r"^\.+", ""))


def legal_key(key: Column) -> Column:
    return key.isNotNull() & (key != "") & ~key.startswith("/") & ~F.array_contains(F.split(key, r"[/\\]"), "..")


def put_blobs(blobs: DataFrame, path: str) -> None:
    """Blobs (blob_key, content) as rows of a table, appended; the last write of a key counts. An illegal key fails the job."""
    checked = F.when(legal_key(F.col("blob_key")), F.col("blob_key")).otherwise(F.raise_error(F.concat(F.lit("illegal blob key: "), F.coalesce("blob_key", F.lit("")))))
    blobs.select(checked.alias("blob_key"), "content", F.current_timestamp().alias("written_at")).write.mode("append").parquet(path)


def get_blobs(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """blob_key and content (null: not there) of the keys asked for."""
    last = spark.read.parquet(path).join(keys.select("blob_key").distinct(), "blob_key", "left_semi").groupBy("blob_key").agg(F.max_by("content", "written_at").alias("content"))
    return keys.select("blob_key").distinct().join(last, "blob_key", "left")


def delete_blobs(spark: SparkSession, path: str, keys: DataFrame) -> None:
    """Tombstones for the keys; deleting twice is no fault."""
    put_blobs(keys.select("blob_key", F.lit(None).cast("binary").alias("content")), path)


# ---- whole runs ------------------------------------------------------------------------------


def parsed(files: DataFrame) -> DataFrame:
    """Files (document_id, content_type, content) with text, or error: the name of what is wrong."""
    return uploads.parsed(files).drop("detail")


def ingest(registry: DataFrame, files: DataFrame, manifest: DataFrame, now: Column, mode: str = "redact", salt: str | None = None) -> dict[str, DataFrame]:
    """One run over many documents: parse, stamp the collection, redact, chunk, diff, mark READY or FAILED.

    files: document_id, content (of registered documents; others are ignored). A file that can't be parsed marks its
    document failed with the fault's name and leaves manifest and chunks as they were. Returns registry,
    manifest, chunks (with action embed or meta), deleted (chunk ids), changed (documents whose cached answers go) and
    audit (a row without the value for each finding: by document before it was redacted, by chunk where it is kept; with a
    digest of the value where there is a ``salt``).
    """
    known = registry.select("document_id", "tenant_id", "filename", "content_type", "collection_id").join(files.select("document_id", "content"), "document_id")
    docs = staged(parsed(known))
    good = docs.where("error is null").select(
        F.col("document_id").alias("doc_id"), "tenant_id", "collection_id", "text", F.col("filename").alias("title"), F.col("content_type").alias("source"), F.array().cast("array<string>").alias("acl_tags"),
    )
    found = staged(good.withColumn("pii_spans", redaction.spans(F.col("text"))))
    clean = redaction.treated(found, mode).drop("pii_spans", "pii_types")
    chunks = chunking.chunk(clean)
    if mode == "keep":
        chunks = chunks.withColumn("pii_spans", redaction.spans(F.col("text"))).withColumn("pii_types", redaction.types_of(F.col("pii_spans")))
    chunks = staged(chunks)
    seen = chunks if mode == "keep" else found.withColumn("chunk_id", F.lit("doc_redaction"))
    audit = redaction.audit(seen, now, salt, salt is not None)
    rows = incremental.hashed(chunks)
    mine = good.select("tenant_id", "doc_id")
    told = staged(incremental.diff(manifest.join(mine, ["tenant_id", "doc_id"], "left_semi"), rows))
    counts = mine.join(rows.groupBy("tenant_id", "doc_id").agg(F.count("*").cast("int").alias("chunk_count")), ["tenant_id", "doc_id"], "left")
    ready = counts.select(F.col("doc_id").alias("document_id"), "tenant_id", F.lit("ready").alias("status"), F.lit("").alias("error"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))
    bad = docs.where("error is not null").select("document_id", "tenant_id", F.lit("failed").alias("status"), "error", F.lit(0).alias("chunk_count"))
    return {
        "registry": with_status(registry, ready.unionByName(bad), now),
        "manifest": incremental.after(manifest, rows, mine),
        "audit": audit,
        "chunks": chunks.drop("pii_spans").join(told.where("action in ('embed', 'meta')"), ["tenant_id", "doc_id", "chunk_id"]),
        "deleted": told.where("action = 'delete'").select("tenant_id", "chunk_id"),
        "changed": good.select("tenant_id", "doc_id", "collection_id"),
    }


def forget(registry: DataFrame, index: DataFrame, manifest: DataFrame, entries: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """One run that deletes documents (document_id): chunks, manifest rows and cached answers go, the registry's rows last. Unknown ids are no fault."""
    known = registry.join(gone.select("document_id").distinct(), "document_id", "left_semi").select("document_id", "tenant_id", "collection_id", "blob_key")
    docs = known.select("tenant_id", F.col("document_id").alias("doc_id"), "collection_id")
    return {
        "index": incremental.without_documents(index, docs), "manifest": incremental.without_documents(manifest, docs), "entries": cache.invalidated(entries, docs),
        "blobs": known.select("blob_key"), "registry": deleted(registry, known),
    }


def start(spark: SparkSession, index_path: str, dimension: int) -> None:
    """Before a run: the index is there and its vectors have ``dimension`` numbers, else the run doesn't begin."""
    sizes = spark.read.parquet(index_path).select(F.size("embedding").alias("n")).where(F.col("n") != dimension).limit(1).count()
    if sizes:
        raise ValueError(f"the index holds vectors of other lengths than {dimension}")
