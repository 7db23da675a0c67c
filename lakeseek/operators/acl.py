"""Access rules. ``visible`` and its form inside a row, ``seen_by``, are the only makers of candidate sets: all searches build on them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def allowed(chunk_tags: Column, caller_tags: Column) -> Column:
    """Open chunks, and those that share a tag with the caller."""
    return (F.size(chunk_tags) == 0) | F.arrays_overlap(chunk_tags, caller_tags)


def in_scope(collection: Column, wanted: Column) -> Column:
    return wanted.isNull() | (collection == wanted)


def visible(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pairs of a query (tenant_id, caller_tags, query_collection) and a chunk that it may see.

    An equi-join on the tenant; the tag and collection rules run inside the join, below any ranking.
    """
    q, c = queries.alias("q"), chunks.alias("c")
    rule = (F.col("q.tenant_id") == F.col("c.tenant_id")) & allowed(F.col("c.acl_tags"), F.col("q.caller_tags")) & in_scope(F.col("c.collection_id"), F.col("q.query_collection"))
    mine = [F.col(f"q.{x}") for x in queries.columns if x != "tenant_id"]
    theirs = [F.col(f"c.{x}") for x in chunks.columns if x not in queries.columns or x == "tenant_id"]
    return q.join(c, rule).select(*mine, *theirs)


def seen_by(rights: list[dict]) -> Column:
    """The numbers of those ``rights`` (tenant_id, caller_tags, query_collection) under which a chunk may be seen: the rule of ``visible`` inside a row."""
    held = F.from_json(F.lit(json.dumps([{"n": i, **r} for i, r in enumerate(rights)])), "array<struct<n:int,tenant_id:string,caller_tags:array<string>,query_collection:string>>")
    rule = lambda r: (r["tenant_id"] == F.col("tenant_id")) & allowed(F.col("acl_tags"), r["caller_tags"]) & in_scope(F.col("collection_id"), r["query_collection"])
    return F.transform(F.filter(held, rule), lambda r: r["n"])


def narrowed(tags: Column, allowlist: Column) -> Column:
    """Tags on the tenant's list, in their order; no list at all is no restriction."""
    return F.when(allowlist.isNull(), tags).otherwise(F.array_intersect(tags, allowlist))


def valid_tenant(tenant: Column) -> Column:
    return F.length(F.trim(tenant)) > 0


def valid_collection(collection: Column) -> Column:
    return (F.length(collection) <= 128) & ~collection.rlike(r"[\x00-\x1F]")


def valid_question(question: Column, most: int = 8000) -> Column:
    return F.length(question).between(1, most)


def tenant_key(tenant: Column) -> Column:
    """Physical partition value; a hostile name can't leave its folder."""
    return F.sha2(tenant, 256)
