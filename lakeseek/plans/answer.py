"""Hybrid retrieval and question answering over a batch of questions.

A question has one tenant, and every chunk is named by (tenant_id, chunk_id): rankings, fusion and citations
carry both, so that equal chunk ids of other tenants never meet.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeseek.functions.vector import tokens
from lakeseek.operators import bm25, cache, context, dense, fusion, guard, redaction, rewrite
from lakeseek.sources.staging import staged

DIMENSION = 64
CHUNK = ["tenant_id", "chunk_id"]
ANSWER = "struct<answer:string,cited:array<string>,context_ids:array<string>,doc_ids:array<string>>"
RANKED = "array<struct<chunk_id:string,rank:int,score:double,rerank_score:double>>"


def bucket_of(term: Column) -> Column:
    return F.conv(F.substring(F.md5(term), 1, 2), 16, 10).cast("int") % DIMENSION


def vectors_of(counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``keys`` and ``name``: counts (keys, term, tf) of words by a hash bucket, the offline embedder."""
    by_bucket = counts.groupBy(*keys, bucket_of(F.col("term")).alias("bucket")).agg(F.sum("tf").alias("n"))
    maps = by_bucket.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("m"))  # at most DIMENSION entries
    return maps.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(DIMENSION - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("double")).alias(name))


def question_vectors(queries: DataFrame, text: str = "question") -> DataFrame:
    return vectors_of(queries.select("query_id", F.explode(tokens(F.col(text))).alias("term"), F.lit(1).alias("tf")), ["query_id"], "query_vector")


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def hashed_counts(terms: pa.Array) -> pa.Array:
    """``vectors_of`` inside a row: the sums of tf by ``bucket_of`` of counted terms."""
    rows, flat = pc.list_parent_indices(terms).to_numpy(), pc.list_flatten(terms)
    words = flat.field(0).dictionary_encode()
    bucket = np.array([hashlib.md5(w.encode()).digest()[0] % DIMENSION for w in words.dictionary.to_pylist()] or [0], np.int64)
    counts = np.bincount(rows.astype(np.int64) * DIMENSION + bucket[words.indices.to_numpy()], flat.field(1).to_numpy(zero_copy_only=False), minlength=len(terms) * DIMENSION)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(terms) + 1, dtype=np.int32) * DIMENSION), pa.array(counts))


def dense_ranking(queries: DataFrame, index: bm25.Index, k: int = 20, embed=None, chunks: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank by hashed vectors of the index's term counts, or by those of ``embed``.

    embed(rows, keys, text, name) gives ``keys`` and a vector ``name`` of each row's ``text``. Chunks that have a column
    embedding keep it.
    """
    if embed is not None:
        held = chunks.select(*CHUNK, "embedding") if "embedding" in chunks.columns else embed(chunks, CHUNK, "text", "embedding")
        asked = queries.join(embed(queries, ["query_id"], "question", "query_vector"), "query_id").select("query_id", "tenant_id", "caller_tags", "query_collection", "query_vector")
        return dense.top_k(asked, index.listed.select(*bm25.ATTRIBUTES).join(held, CHUNK), k, "chunk_id")
    vecs = index.listed.where("dl > 0").select(*bm25.ATTRIBUTES, hashed_counts("terms").alias("embedding"))
    asked = queries.join(question_vectors(queries), "query_id").select("query_id", "tenant_id", "caller_tags", "query_collection", "query_vector")
    return dense.top_k(asked, vecs, k, "chunk_id")


def both_rankings(queries: DataFrame, index: bm25.Index, k: int = 20, embed=None, chunks: DataFrame | None = None) -> DataFrame:
    return dense_ranking(queries, index, k, embed, chunks).select("query_id", F.lit("dense").alias("source"), "chunk_id", "score").unionByName(
        bm25.top_k(queries, index, k).select("query_id", F.lit("sparse").alias("source"), "chunk_id", "score")
    )


def hybrid(queries: DataFrame, chunks: DataFrame, k: int = 20, window: int = fusion.FUSE_WINDOW, top: int = fusion.RERANK_TOP, index: bm25.Index | None = None, embed=None) -> DataFrame:
    """query_id, tenant_id, chunk_id, rank, score, rerank_score, component_scores and the chunk's attributes: dense and sparse, fused, reranked."""
    index = index or bm25.build(chunks)
    fused = fusion.fuse(both_rankings(queries, index, k, embed, chunks)).where(F.col("rank") <= window)
    # written, so that Spark knows how few they are and needn't shuffle the texts to meet them
    few = staged(fused.join(queries.select("query_id", "tenant_id", "question"), "query_id"))
    late = few.join(chunks.select(*CHUNK, "doc_id", "text", "title", "source"), CHUNK)
    return fusion.rerank(late, fusion.overlap_score(), top)


def extractive(passages: DataFrame) -> DataFrame:
    """query_id, answer, claimed: quotes the first passage; no passage, no answer. The offline generator."""
    first = passages.where("marker = 1").select("query_id", F.concat(F.regexp_extract("text", r"^[^.\n]*", 0), F.lit(" [1]")).alias("answer"))
    return first.withColumn("claimed", F.array(F.lit(1)))


def admitted(queries: DataFrame, fold=guard.folded) -> DataFrame:
    """``queries`` with blocked, and question as the input guards leave it."""
    form = queries.withColumn("form", guard.spaced(F.col("question"), fold)).withColumn("spans", redaction.spans(F.col("question")))
    checked = form.withColumn("results", guard.input_results(F.col("question"), F.col("form"), F.col("spans")))
    return checked.withColumn("blocked", guard.blocked(F.col("results"))).withColumn("question", guard.last_redaction(F.col("question"), F.col("results"))).drop("form", "spans", "results")


def suspected(ranked: DataFrame, fold=guard.folded) -> DataFrame:
    """query_id, suspected: the strong labels that any retrieved text bears, sorted. They are flagged, not blocked."""
    found = ranked.select("query_id", guard.labels(guard.spaced(F.col("text"), fold), guard.STRONG).alias("labels"))
    return found.select("query_id", F.explode("labels").alias("label")).groupBy("query_id").agg(F.array_sort(F.collect_set("label")).alias("suspected"))


def retrieved(queries: DataFrame, chunks: DataFrame, tier: DataFrame | None, now: Column | None, embed=None, lookup=cache.lookup, index: bm25.Index | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Reranked rows of the questions (question holds the text to search by), new entries of the retrieval tier, and the questions that it answered.

    queries: with query_vector where there is a tier. Questions that the tier answers skip retrieval; their
    chunks are joined again, under the rights of the caller that the tier's partition stands for.
    """
    if tier is None:
        return hybrid(queries.drop("query_vector"), chunks, index=index, embed=embed), None, None
    hits = staged(lookup(cache.asked(queries), tier, now).join(tier.select("entry_id", "payload"), "entry_id").select("query_id", F.from_json("payload", RANKED).alias("ranked")))
    held = staged(hits.select("query_id", F.explode("ranked").alias("r")).select("query_id", "r.*").join(queries.select("query_id", "tenant_id", "question"), "query_id"))
    known = held.join(chunks.select(*CHUNK, "doc_id", "text", "title", "source"), CHUNK)
    rest = queries.join(hits.select("query_id"), "query_id", "left_anti")
    fresh = staged(hybrid(rest.drop("query_vector"), chunks, index=index, embed=embed).drop("component_scores"))
    lists = fresh.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score", "rerank_score", "doc_id"))).alias("r"))
    payload = F.to_json(F.transform("r", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["rank"].alias("rank"), x["score"].alias("score"), x["rerank_score"].alias("rerank_score"))))
    made = cache.entries(rest.join(lists, "query_id").withColumn("payload", payload).withColumn("doc_ids", F.array_distinct(F.transform("r", lambda x: x["doc_id"].cast("string")))), now)
    return fresh.unionByName(known.select(*fresh.columns)), made, hits.select("query_id")


def answers(queries: DataFrame, chunks: DataFrame, **options) -> DataFrame:
    """The answers of ``answered``."""
    return answered(queries, chunks, **options)[0]


def answered(
    queries: DataFrame, chunks: DataFrame, budget: int = context.BUDGET, fold=guard.folded, generate=extractive, synonyms: DataFrame | None = None, expand=None,
    answer_tier: DataFrame | None = None, retrieval_tier: DataFrame | None = None, now: Column | None = None, embed=None, scan_output: bool = False, judge=None, schema: tuple[str, list[str]] | None = None,
    lookup=cache.lookup, index: bm25.Index | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """query_id, answer, refused, blocked, cited and context chunk_ids, doc_ids, suspected, cache of every question, and new entries of the retrieval tier.

    The rewritten text feeds retrieval and the cache key alone; generation keeps the question. A hit of the
    answer tier returns at once, one of the retrieval tier skips the search. ``cache_entries`` makes new entries of the answers.
    ``lookup`` may be ``cache.lookup_near`` where a tier is large. ``index``: of the chunks, where they are searched more than once.

    Output guards, in order: citations; the schema (DDL and required fields) of the generator's column candidate; personal data in
    the answer where ``scan_output`` is set, which is redacted; groundedness where there is a ``judge``, a column function of
    answer and context ids that gives a faithfulness, or null where it had no time. A blocked answer leaves nothing but the refusal.
    """
    judged = admitted(queries, fold)
    open_queries = judged.where("not blocked").drop("blocked")
    open_queries = staged(rewrite.rewritten(open_queries, synonyms, expand) if synonyms is not None else open_queries.withColumn("retrieval_question", F.col("question")))
    none, no_markers = F.array().cast("array<string>"), F.array().cast("array<int>")
    searched = open_queries.withColumn("question", F.col("retrieval_question")).drop("retrieval_question")
    if answer_tier is not None or retrieval_tier is not None:
        searched = searched.join(question_vectors(searched), "query_id", "left")
    cached = None
    if answer_tier is not None:
        found = lookup(cache.asked(searched), answer_tier, now).join(answer_tier.select("entry_id", "payload"), "entry_id")
        cached = staged(found.select("query_id", F.from_json("payload", ANSWER).alias("a")))
        searched = searched.join(cached.select("query_id"), "query_id", "left_anti")
    found_rows, entries, tier_hits = retrieved(searched, chunks, retrieval_tier, now, embed, lookup, index)
    ranked = staged(found_rows.drop("component_scores"))
    packed = context.pack(ranked.drop("question").join(open_queries.select("query_id", "question"), "query_id"), budget)
    written = generate(packed).withColumn("markers", context.markers(F.col("answer"), F.col("claimed")))
    cited = context.citations(written, packed).groupBy("query_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("cited"))
    given = packed.groupBy("query_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("context_ids"), F.array_sort(F.collect_set("marker")).alias("valid"))
    sources = fusion.documents_of(ranked).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("d")))).alias("r")).select("query_id", F.transform("r", lambda x: x["d"]).alias("doc_ids"))
    whole = searched.select("query_id")
    for part in (written, cited, given, sources, suspected(ranked, fold)):
        whole = whole.join(part, "query_id", "left")
    whole = whole.select(
        "query_id", "answer", *[F.coalesce(c, none).alias(c) for c in ("cited", "context_ids", "doc_ids", "suspected")],
        *[F.coalesce(c, no_markers).alias(c) for c in ("claimed", "valid")], F.col("answer").isNull().alias("refused"), *(["candidate"] if schema else []),
    )
    if scan_output:
        whole = whole.withColumn("spans", redaction.spans(F.coalesce("answer", F.lit(""))))
    results = guard.output_results(
        F.col("refused"), F.col("cited"), F.col("context_ids"), F.col("claimed"), F.col("valid"), F.col("context_ids"), judge(F.col("answer"), F.col("context_ids")) if judge else None,
        candidate=(F.col("candidate"), *schema) if schema else None, found=(F.col("answer"), F.col("spans")) if scan_output else None, judged=judge is not None,
    )
    whole = whole.withColumn("results", results)
    out = whole.withColumn("blocked", guard.blocked(F.col("results"))).withColumn("answer", guard.last_redaction(F.col("answer"), F.col("results")))

    def unless(c: str) -> Column:
        return F.when(F.col("blocked"), none).otherwise(F.col(c)).alias(c)

    miss = F.lit(None).cast("string").alias("cache")
    if tier_hits is None:
        out = out.withColumn("tier", miss)
    else:
        out = out.join(tier_hits.withColumn("tier", F.lit("retrieval_hit")), "query_id", "left")
    done = out.select("query_id", guard.scrubbed(F.coalesce("answer", F.lit(guard.REFUSAL)), F.col("blocked")).alias("answer"), (F.col("refused") | F.col("blocked")).alias("refused"), "blocked", unless("cited"), unless("context_ids"), unless("doc_ids"), "suspected", F.col("tier").alias("cache"))
    stopped = judged.where("blocked").select("query_id", F.lit(guard.REFUSAL).alias("answer"), F.lit(True).alias("refused"), F.lit(True).alias("blocked"), *[none.alias(c) for c in ("cited", "context_ids", "doc_ids", "suspected")], miss)
    done = done.unionByName(stopped)
    if cached is not None:
        no = F.lit(False)
        done = done.unionByName(cached.select("query_id", "a.answer", no.alias("refused"), no.alias("blocked"), "a.cited", "a.context_ids", "a.doc_ids", none.alias("suspected"), F.lit("answer_hit").alias("cache")))
    return done, entries


def cache_entries(done: DataFrame, queries: DataFrame, now: Column) -> DataFrame:
    """Answer-tier entries of fresh answers that were neither refused nor blocked; ``queries`` as they were searched by."""
    clean = done.where("not refused and not blocked and (cache is null or cache = 'retrieval_hit')")
    keyed = queries.join(question_vectors(queries), "query_id")
    return cache.entries(keyed.join(clean, "query_id").withColumn("payload", F.to_json(F.struct("answer", "cited", "context_ids", "doc_ids"))), now)


def blocks_of_ten(rows: DataFrame, keys: list[str], order: str, value: Column, name: str) -> DataFrame:
    """Lists of at most ten values in order, for metrics over short ranked lists."""
    listed = rows.withColumn("block", F.floor(F.col(order) / 10)).groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))).alias("items"))
    return listed.select(*keys, "block", F.transform("items", lambda x: x["v"]).alias(name))


def first_per(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    nth = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(nth)).where("nth = 1").drop("nth")
