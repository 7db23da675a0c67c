"""A cache of answers by question vector, per tenant, collection and caller's tags."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lakeseek.functions import vector
from lakeseek.operators import dense, local
from lakeseek.sources.staging import staged

THRESHOLD, TTL_SECONDS, NO_COLLECTION = 0.9, 3600, "__none__"
#: Signed projections per bucket key, the share of pairs at the threshold that must meet, and the seed of the hyperplanes.
BITS, RECALL, PLANES_SEED, MOST_TABLES = 12, 0.995, 17, 64
#: Questions that a task compares with its entries at a time.
LOOKED_UP = 8192
PARTITION = ["tenant_id", "collection_id", "tags"]


def collection_key(collection: Column) -> Column:
    return F.coalesce(F.when(collection != "", collection), F.lit(NO_COLLECTION))


def tags_key(tags: Column) -> Column:
    """Callers with other tags see other chunks, so they must not share entries."""
    return F.to_json(F.array_sort(F.array_distinct(F.coalesce(tags, F.array().cast("array<string>")))))


def live(entries: DataFrame, now: Column) -> DataFrame:
    return entries.where(F.col("expires_at") > now)


def lookup(queries: DataFrame, entries: DataFrame, now: Column, threshold: float = THRESHOLD) -> DataFrame:
    """query_id, entry_id, similarity of the nearest live entry in the query's partition, where it is near enough; of equally near ones the least id.

    queries: query_id, tenant_id, collection_id, tags, query_vector; entries: entry_id, tenant_id,
    collection_id, tags, vector, expires_at. Exact: every question is compared with every entry of its partition, in matrix products
    where the entries lie. Blocks of LOOKED_UP questions travel with the tasks, and a task sends on at most one row per question.
    """
    own = lambda c: [F.col(c), "tenant_id", collection_key(F.col("collection_id")).alias("collection_id"), tags_key(F.col("tags")).alias("tags")]
    q = queries.select(*own("query_id"), F.col("query_vector").cast("array<double>").alias("query_vector"))
    e = live(entries, now).select(*own("entry_id"), F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
    local.bounded(entries.sparkSession)
    schema = T.StructType([q.schema["query_id"], e.schema["entry_id"], T.StructField("similarity", T.DoubleType())])
    best = reduce(DataFrame.unionByName, [e.mapInArrow(_nearest(block.collect(), threshold, schema), schema) for block in dense.blocks(q, LOOKED_UP)])
    first = best.groupBy("query_id").agg(F.max(F.struct("similarity", (-F.col("entry_id")).alias("order"))).alias("b"))
    return first.select("query_id", (-F.col("b.order")).alias("entry_id"), F.col("b.similarity").alias("similarity"))


def _nearest(asked: list, threshold: float, schema: T.StructType):
    """The search of one task for the questions ``asked``."""
    groups = {}
    for i, r in enumerate(asked):
        if r["query_vector"] is not None and None not in r["query_vector"] and None not in (r["tenant_id"], r["collection_id"], r["tags"]):
            groups.setdefault((r["tenant_id"], r["collection_id"], r["tags"], len(r["query_vector"])), []).append(i)
    held = {}
    for (*key, size), at in groups.items():
        held.setdefault(tuple(key), []).append((size, np.array(at), np.array([asked[i]["query_vector"] for i in at], float).reshape(len(at), size)))
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])
    names = pa.array([r["query_id"] for r in asked], arrow.field("query_id").type)
    last = np.iinfo(np.int64).max

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, ids = np.full(len(asked), -np.inf), np.full(len(asked), last)
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in PARTITION), strict=True))
            for key in set(keys) & held.keys():
                mine = batch.filter(pa.array([k == key for k in keys]))
                for size, at, vectors in held[key]:
                    for part in local.slices(mine, len(at), False):
                        rows, ok = dense.matrix(part.column("vector"), size)
                        number = part.column("entry_id").to_numpy(zero_copy_only=False).astype(np.int64)[ok]
                        if not len(number):
                            continue
                        near = dense.cosines(vectors, rows[ok])
                        most = near.max(axis=1)
                        some = np.flatnonzero((most >= threshold) & (most >= top[at]))
                        least = np.where(near[some] == most[some, None], number[None, :], last).min(axis=1)
                        better = (most[some] > top[at[some]]) | (least < ids[at[some]])
                        to = at[some[better]]
                        top[to], ids[to] = most[some[better]], least[better]
        found = np.flatnonzero(top >= threshold)
        if len(found):
            yield pa.RecordBatch.from_arrays([names.take(pa.array(found)), pa.array(ids[found]).cast(arrow.field("entry_id").type), pa.array(top[found])], schema=arrow)

    return search


def tables_for(threshold: float, recall: float = RECALL, bits: int = BITS) -> int:
    """How many tables let a pair of just this cosine meet with the probability ``recall``, keys with one flipped bit looked into as well."""
    same = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    meets = same**bits + bits * same ** (bits - 1) * (1 - same)
    n = 1 if meets >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - meets))
    if n > MOST_TABLES:
        raise ValueError(f"a threshold of {threshold} is too low for buckets ({n} tables): use lookup")
    return n


def hyperplane_keys(vectors: Column, tables: int, bits: int = BITS, seed: int = PLANES_SEED) -> Column:
    """One bucket key per table: the signs of ``bits`` random projections. The planes follow from seed and dimension, so nothing is sent; null for a vector of null."""

    @F.pandas_udf("array<int>")
    def keys(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        planes = {}
        for part in parts:
            out = [None] * len(part)
            sizes = part.map(lambda v: -1 if v is None else len(v)).to_numpy()
            for size in set(sizes.tolist()) - {-1}:
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, size]).standard_normal((size, tables * bits))
                places = np.flatnonzero(sizes == size)
                signs = (np.stack(part.iloc[places].to_list()).reshape(len(places), size) @ planes[size] >= 0).reshape(len(places), tables, bits)
                for place, row in zip(places, signs @ (1 << np.arange(bits)), strict=True):
                    out[place] = row.astype(np.int32)
            yield pd.Series(out)

    return keys(vectors)


def _told(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Partition key, vector and members: one row per distinct vector of a partition, so that no group of copies meets another."""
    keyed = rows.select(id_col, "tenant_id", collection_key(F.col("collection_id")).alias("collection_id"), tags_key(F.col("tags")).alias("tags"), F.col(vector_col).alias("v"))
    return keyed.where("v is not null and tenant_id is not null")


def candidates(queries: DataFrame, entries: DataFrame, tables: int, bits: int = BITS) -> DataFrame:
    """q, e: distinct pairs of query and entry rows (q / e, partition, v) that share a bucket of one of the tables, or differ there in one bit.

    Entries are stored under one key per table; the questions, the few, look into ``bits`` + 1 buckets each. An equi-join on
    partition, table and key; no side is broadcast by hint.
    """
    flips = F.array(*[F.lit(m) for m in (0, *[1 << b for b in range(bits)])])
    at = ["*", F.posexplode_outer(hyperplane_keys(F.col("v"), tables, bits)).alias("t", "key")]
    e = entries.select(*at).select("e", *PARTITION, "t", "key")
    q = queries.select(*at).select("q", *PARTITION, "t", "key").withColumn("key", F.explode_outer(F.transform(flips, lambda m: F.col("key").bitwiseXOR(m))))
    return q.join(e, [*PARTITION, "t", "key"]).select("q", "e").distinct()


def lookup_near(queries: DataFrame, entries: DataFrame, now: Column, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """What ``lookup`` gives but for misses at a rate of 1 - ``recall`` at most, for high thresholds, without comparing every question with every entry.

    Signed random projections are the keys of an equi-join; what meets is verified by the exact cosine, so no hit is
    wrong. A pair at the threshold is missed with a probability of at most 1 - ``recall``, a nearer one with less, and an equal vector never.
    Of entries with one vector the least id stands for all (it would win), of questions with one vector
    the work is done once and joined back.
    """
    tables = tables_for(threshold, recall)
    same = [*PARTITION, "v"]
    e = staged(_told(live(entries, now), "entry_id", "vector").groupBy(*same).agg(F.min("entry_id").alias("e")).withColumn("norm", vector.norm(F.col("v"))))
    members = staged(_told(queries, "query_id", "query_vector"))
    q = staged(members.groupBy(*same).agg(F.min("query_id").alias("q")).withColumn("query_norm", vector.norm(F.col("v"))))
    pairs = candidates(q, e, tables).join(q.select("q", F.col("v").alias("qv"), "query_norm"), "q").join(e.select("e", F.col("v").alias("ev"), "norm"), "e")
    scored = pairs.select("q", "e", F.round(vector.cosine(F.col("qv"), F.col("ev"), F.col("query_norm"), F.col("norm")), 9).alias("similarity")).where(F.col("similarity") >= threshold)
    best = scored.groupBy("q").agg(F.max(F.struct("similarity", (-F.col("e")).alias("order"))).alias("b"))
    every = members.join(q.select("q", *same), same).select("query_id", "q")
    return every.join(best, "q").select("query_id", (-F.col("b.order")).alias("entry_id"), F.col("b.similarity").alias("similarity"))


def asked(queries: DataFrame) -> DataFrame:
    """Questions (caller_tags, query_collection) in the columns of ``lookup``; those without a vector hit nothing."""
    return queries.where("query_vector is not null").select("query_id", "tenant_id", F.col("query_collection").alias("collection_id"), F.col("caller_tags").alias("tags"), "query_vector")


def entries(rows: DataFrame, now: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """Entries of rows (query_id, tenant_id, query_collection, caller_tags, query_vector, doc_ids, payload)."""
    return rows.select(
        F.xxhash64("query_id", "tenant_id", "payload").alias("entry_id"), "tenant_id", F.col("query_collection").alias("collection_id"), F.col("caller_tags").alias("tags"),
        F.col("query_vector").alias("vector"), "doc_ids", "payload", (now + F.make_interval(secs=F.lit(ttl))).alias("expires_at"),
    )


def stored(entries: DataFrame, rows: DataFrame, now: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    fresh = rows.withColumn("expires_at", now + F.make_interval(secs=F.lit(ttl)))
    return entries.unionByName(fresh.select(*entries.columns))


def invalidated(entries: DataFrame, changed: DataFrame) -> DataFrame:
    """Entries that cite none of the changed documents (tenant_id, collection_id, doc_id) of their own or no collection."""
    cited = entries.select("entry_id", "tenant_id", collection_key(F.col("collection_id")).alias("key"), F.explode("doc_ids").alias("doc_id"))
    c = changed.select("tenant_id", "doc_id", F.explode(F.array_distinct(F.array(collection_key(F.col("collection_id")), F.lit(NO_COLLECTION)))).alias("key"))
    gone = cited.join(c, ["tenant_id", "key", "doc_id"], "left_semi").select("entry_id").distinct()
    return entries.join(gone, "entry_id", "left_anti")
