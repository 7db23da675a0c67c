"""Token-window chunking in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseek.functions.vector import paragraphs, words

MAX_TOKENS, OVERLAP = 256, 200


def chunk(docs: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """One row per window: chunk_id, ordinal, tokens, text and the document's attributes.

    With n tokens and step = max - overlap there are 0 windows for n = 0, else
    1 + ceil((n - max) / step), window i being tokens[i * step : i * step + max].
    """
    overlap = max(0, min(overlap, max_tokens - 1))
    step = max_tokens - overlap
    tokens = F.flatten(F.transform(paragraphs(F.col("text")), words))
    n = F.size("all_tokens")
    count = F.when(n == 0, 0).when(n <= max_tokens, 1).otherwise(1 + F.ceil((n - max_tokens) / step)).cast("int")
    counted = docs.withColumn("all_tokens", tokens).withColumn("n_windows", count)
    # outer, and filtered by its result: a filter on the count would be pushed below and split every text twice
    rows = counted.withColumn("ordinal", F.explode_outer(F.when(F.col("n_windows") > 0, F.sequence(F.lit(0), F.col("n_windows") - 1)))).where("ordinal is not null")
    cut = F.slice("all_tokens", F.col("ordinal") * step + 1, F.lit(max_tokens))
    kept = [c for c in docs.columns if c != "text"]
    return rows.select(
        *kept, "ordinal", F.format_string("%s::%06d", F.col("doc_id").cast("string"), F.col("ordinal")).alias("chunk_id"), cut.alias("tokens"),
    ).withColumn("text", F.array_join("tokens", " "))


def embed_text(prefix: str = "contextual_prefix", text: str = "text"):
    """The prefix, a blank line, and the text; without a prefix the text alone."""
    return F.when(F.length(prefix) > 0, F.concat_ws("\n\n", prefix, text)).otherwise(F.col(text))


def prefixed(chunks: DataFrame, docs: DataFrame, cache: DataFrame, generate, version: str = "1") -> DataFrame:
    """Chunks with contextual_prefix from the cache; ``generate`` (a column function of document and chunk text) runs on misses only."""
    key = F.sha2(F.concat_ws("\x1f", F.lit(version), F.col("doc_id").cast("string"), F.sha2("doc_text", 256), F.col("text")), 256)
    own = [c for c in ("tenant_id", "doc_id") if c in chunks.columns and c in docs.columns]
    joined = chunks.join(docs.select(*own, F.col("text").alias("doc_text")), own, "left").withColumn("doc_text", F.coalesce("doc_text", F.lit(""))).withColumn("prefix_key", key)
    found = joined.join(cache.select("prefix_key", F.col("prefix").alias("cached")), "prefix_key", "left")
    hits = found.where("cached is not null").withColumn("contextual_prefix", F.trim("cached"))
    misses = found.where("cached is null").withColumn("contextual_prefix", F.trim(generate(F.col("doc_text"), F.col("text"))))
    return hits.unionByName(misses).drop("cached", "doc_text")


def keys_of(docs: DataFrame, version: str = "1") -> DataFrame:
    """doc_id (and tenant_id), ordinal and prefix_key of every chunk of ``docs``, as ``prefixed`` names it; no text leaves its row."""
    own = [c for c in ("tenant_id", "doc_id") if c in docs.columns]
    chunks = chunk(docs.select(*own, "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("doc_sha")))
    return chunks.select(*own, "ordinal", F.sha2(F.concat_ws("\x1f", F.lit(version), F.col("doc_id").cast("string"), "doc_sha", "text"), 256).alias("prefix_key"))


def prefixed_of(docs: DataFrame, cache: DataFrame, generate, version: str = "1", keys: DataFrame | None = None) -> DataFrame:
    """``prefixed(chunk(docs), docs, ...)`` for documents of distinct ids, without a chunk's or a document's text beside each key.

    Only keys travel to the cache; what is found comes back as one list per document, so a document's text is shuffled once and not
    with each of its chunks. ``keys``: ``keys_of`` the same documents, where they are at hand.
    """
    own = [c for c in ("tenant_id", "doc_id") if c in docs.columns]
    known = cache.where("prefix is not null").groupBy("prefix_key").agg(F.max("prefix").alias("cached"))
    found = (keys_of(docs, version) if keys is None else keys).join(known, "prefix_key", "left")
    lists = found.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("ordinal", "prefix_key", "cached"))).alias("found"))  # an entry per chunk of the document
    carried = docs.withColumn("doc_text", F.coalesce("text", F.lit(""))).join(lists, own, "left")
    rows = chunk(carried).withColumn("f", F.get("found", F.col("ordinal"))).withColumn("prefix_key", F.col("f.prefix_key")).withColumn("cached", F.col("f.cached")).drop("f", "found")
    hits = rows.where("cached is not null").withColumn("contextual_prefix", F.trim("cached"))
    misses = rows.where("cached is null").withColumn("contextual_prefix", F.trim(generate(F.col("doc_text"), F.col("text"))))
    return hits.unionByName(misses).drop("cached", "doc_text")
