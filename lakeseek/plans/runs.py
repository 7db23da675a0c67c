"""Queries over the registry, ingestion runs, traces, experiments and the cached question path, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek.operators import bm25, chunking, incremental, observe, registry
from lakeseek.plans import answer, experiment
from lakeseek.plans.catalog import CHUNKS, DOCS, HASHED, ORACLES, POSTED, REDACTED, SPANS_SQL, SPARSE, TOKENS, WORDS, query
from lakeseek.sources import corpora, docx, files, tables
from lakeseek.sources.staging import staged

NOW = "timestamp'2024-06-01 00:00:00'"
CREATED = "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, doc_id)"


def _registered(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a new row of the registry; texts in Spanish pose as PDF files."""
    docs = tables.documents(spark, sf)
    return docs.select(
        F.col("doc_id").cast("string").alias("document_id"), "tenant_id", F.col("title").alias("filename"), F.when(F.col("collection_id") == "es", "application/pdf").otherwise("text/plain").alias("content_type"),
        F.octet_length("text").cast("long").alias("size_bytes"), F.lit("processing").alias("status"), registry.blob_key(F.col("tenant_id"), F.col("doc_id"), F.col("title")).alias("blob_key"), "collection_id",
        F.lit("").alias("error"), F.lit(0).alias("chunk_count"), F.expr(CREATED).alias("created_at"), F.expr(CREATED).alias("updated_at"),
    )


@query("registry_listing", f"""WITH {DOCS}, callers(caller_id, tenant_id, wanted) AS (VALUES (1, 'tenant_a', NULL), (2, 'tenant_b', 'en'), (3, 'public', 'fr')),
rows AS (SELECT doc_id, tenant_id, collection_id, title, octet_length(encode(text)) AS size_bytes, quality, toxic FROM docs LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0)
SELECT caller_id, row_number() OVER (PARTITION BY caller_id ORDER BY doc_id DESC) AS place, doc_id::VARCHAR AS document_id, title AS filename, size_bytes,
  CASE WHEN quality = 1 THEN 'ready' WHEN quality = 0 THEN 'failed' ELSE 'processing' END AS status, CASE WHEN quality = 0 THEN 'ParserError' ELSE '' END AS error, CASE WHEN quality = 1 THEN 3 ELSE 0 END AS chunk_count
FROM rows JOIN callers USING (tenant_id) WHERE wanted IS NULL OR wanted = collection_id""")
def registry_listing(spark, sf):
    rows = _registered(spark, sf)
    known = registry.created(registry.created(registry.empty(spark), rows), rows.withColumn("status", F.lit("again")))
    labels = tables.read(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("document_id"), tables.tenant_of(F.col("doc_id")).alias("tenant_id"), "quality", "toxic")
    good = F.col("quality") == 1
    updates = labels.where("quality is not null").select("document_id", "tenant_id", F.when(good, "ready").otherwise("failed").alias("status"), F.when(good, "").otherwise("ParserError").alias("error"), F.when(good, 3).otherwise(0).alias("chunk_count"))
    kept = registry.deleted(registry.with_status(known, updates, F.expr(NOW)), labels.where("toxic = 1"))
    callers = spark.createDataFrame([(1, "tenant_a", None), (2, "tenant_b", "en"), (3, "public", "fr")], "caller_id int, tenant_id string, wanted string")
    return registry.listed(kept, callers).select("caller_id", "place", "document_id", "filename", "size_bytes", "status", "error", "chunk_count")


@query("chunks_within_rights", f"""WITH {DOCS}, d AS (SELECT * FROM docs LEFT JOIN labels USING (doc_id))
SELECT tenant_id, chunk_id, CASE WHEN len(acl_tags) = 0 OR collection_id = 'en' THEN 'new ' || doc_id ELSE title END AS title, CASE WHEN len(acl_tags) = 0 OR collection_id = 'en' THEN 'staff' ELSE array_to_string(acl_tags, ',') END AS tags
FROM d WHERE NOT (coalesce(toxic, 0) = 1 AND (len(acl_tags) > 0 AND collection_id <> 'en'))""")
def chunks_within_rights(spark, sf):
    """Every chunk is patched by its language's editors and toxic ones are deleted by the board: each only where the rights reach."""
    index = tables.document_chunks(spark, sf)
    editors = F.when(F.col("collection_id") == "en", F.array(F.lit("board"))).otherwise(F.array().cast("array<string>"))
    updates = index.select("tenant_id", "chunk_id", editors.alias("caller_tags"), F.concat(F.lit("new "), F.col("doc_id").cast("string")).alias("title"), F.array(F.lit("staff")).alias("acl_tags"))
    patched = registry.patched_chunks(index, updates)
    toxic = tables.read(spark, sf, "labels").where("toxic = 1").join(index.select("doc_id", "tenant_id", "chunk_id"), "doc_id").select("tenant_id", "chunk_id", F.array(F.lit("board")).alias("caller_tags"))
    return registry.without_chunks(patched, toxic).select("tenant_id", "chunk_id", "title", F.array_join("acl_tags", ",").alias("tags"))


@query("ingest_run", f"""WITH {DOCS}, {REDACTED}
SELECT doc_id::VARCHAR AS document_id, CASE WHEN bad THEN 'failed' ELSE 'ready' END AS status, CASE WHEN lang_es THEN 'UnsupportedTypeError' WHEN bad THEN 'ParserError' ELSE '' END AS error,
  (CASE WHEN bad OR n = 0 THEN 0 WHEN n <= 256 THEN 1 ELSE 1 + ceil((n - 256) / 56.0) END)::INT AS chunk_count
FROM (SELECT d.doc_id, d.collection_id = 'es' AS lang_es, d.collection_id = 'es' OR trim(d.text) = '' AS bad, len({WORDS.format('c.text')}) AS n FROM docs d JOIN clean c USING (doc_id))""")
def ingest_run(spark, sf):
    known = _registered(spark, sf)
    files = tables.documents(spark, sf).select(F.col("doc_id").cast("string").alias("document_id"), F.encode("text", "UTF-8").alias("content"))
    out = registry.ingest(known, files, spark.createDataFrame([], "tenant_id string, doc_id string, chunk_id string, ordinal int, embed_hash string, meta_hash string"), F.expr(NOW))
    return out["registry"].select("document_id", "status", "error", "chunk_count")


@query("forget_run", f"""WITH {DOCS}, {CHUNKS}, gone AS (SELECT doc_id FROM labels WHERE toxic = 1), e AS (SELECT vec_id, (label % 3)::VARCHAR AS t, vec_id // 2 AS a, vec_id // 3 AS b FROM embeddings)
SELECT 'index' AS what, count(*) AS n FROM docs WHERE doc_id NOT IN (FROM gone) UNION ALL SELECT 'manifest', count(*) FROM chunks WHERE doc_id NOT IN (FROM gone)
UNION ALL SELECT 'registry', count(*) FROM docs WHERE doc_id NOT IN (FROM gone) UNION ALL SELECT 'blobs', count(*) FROM docs WHERE doc_id IN (FROM gone)
UNION ALL SELECT 'entries', count(*) FROM e WHERE a NOT IN (FROM gone WHERE doc_id IN (SELECT doc_id FROM docs)) AND b NOT IN (FROM gone WHERE doc_id IN (SELECT doc_id FROM docs))""")
def forget_run(spark, sf):
    """Toxic documents are deleted everywhere; cached answers of any tenant here cite documents of the public one."""
    docs = tables.documents(spark, sf)
    text_id = F.col("doc_id").cast("string")
    index = tables.document_chunks(spark, sf).withColumn("doc_id", text_id)
    manifest = incremental.hashed(chunking.chunk(docs)).withColumn("doc_id", text_id)
    cites = F.array(F.floor(F.col("vec_id") / 2).cast("string"), F.floor(F.col("vec_id") / 3).cast("string"))
    entries = tables.read(spark, sf, "embeddings").select("vec_id", cites.alias("doc_ids"), F.explode(F.array(*map(F.lit, ("public", "tenant_a", "tenant_b")))).alias("tenant_id"))
    entries = entries.withColumn("entry_id", F.xxhash64("vec_id", "tenant_id")).withColumn("collection_id", F.lit(None).cast("string"))
    gone = tables.read(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("document_id"))
    out = registry.forget(_registered(spark, sf), index, manifest, entries, gone)
    out["entries"] = out["entries"].groupBy("vec_id").agg(F.count("*").alias("n")).where("n = 3")  # cited documents live in one tenant each
    counts = [out[k].select(F.lit(k).alias("what")).groupBy("what").agg(F.count("*").alias("n")) for k in ("index", "manifest", "registry", "blobs", "entries")]
    return reduce(DataFrame.unionByName, counts)


# ---- traces and scores ----------------------------------------------------------------------


@query("trace_rows", f"""WITH {DOCS}, {POSTED}, {SPARSE}, priced AS (
  SELECT user_id AS query_id, event_id % 1000 AS p, user_id AS c, CASE event_type WHEN 'view' THEN (event_id % 1000) / 1000.0::DOUBLE * 0.003 + user_id / 1000.0::DOUBLE * 0.015 WHEN 'click' THEN (event_id % 1000) / 1000.0::DOUBLE * 0.00025 + user_id / 1000.0::DOUBLE * 0.00125 ELSE 0.0 END AS cost FROM events),
u AS (SELECT query_id, sum(p)::BIGINT AS p, sum(c)::BIGINT AS c, sum(cost) AS cost FROM priced GROUP BY ALL), h AS (SELECT query_id, count(*) AS n, arg_min(chunk_id, rank) AS first FROM sparse GROUP BY ALL)
SELECT query_id, coalesce(n, 0)::INT AS n_hits, first AS first_hit, coalesce(p + c, 0)::BIGINT AS total_tokens, round(coalesce(cost, 0.0), 8) AS cost_usd FROM asked LEFT JOIN h USING (query_id) LEFT JOIN u USING (query_id)""")
def trace_rows(spark, sf):
    asked = tables.questions(spark, sf)
    model = F.when(F.col("event_type") == "view", "claude-sonnet-4-6").when(F.col("event_type") == "click", "claude-haiku-4-5-20251001").when(F.col("event_type") == "error", "baai/bge-m3").otherwise("unknown-model")
    usage = tables.read(spark, sf, "events").select(F.col("user_id").alias("query_id"), model.alias("model"), (F.col("event_id") % 1000).alias("prompt_tokens"), F.col("user_id").alias("completion_tokens"))
    state = asked.select("query_id", F.lit(False).alias("refused"), F.lit(False).alias("blocked"), F.lit(None).cast("string").alias("cache"))
    rows = observe.trace_rows(state, bm25.top_k(asked, tables.document_chunks(spark, sf)), usage, observe.prices(spark), F.expr(NOW))
    return rows.select("query_id", "n_hits", F.try_element_at("hits", F.lit(1))["chunk_id"].alias("first_hit"), "total_tokens", F.round("cost_usd", 8).alias("cost_usd"))


@query("run_scores", """WITH s AS (SELECT user_id AS trace_id, event_type AS name, arg_max(value, event_id) AS value FROM events WHERE event_type <> 'error' GROUP BY ALL), t AS (SELECT DISTINCT conv_id AS trace_id, conv_id // 2 AS item_id FROM conversations)
SELECT trace_id, item_id, count(name)::INT AS n_scores, round(coalesce(sum(value), 0.0), 6) AS total FROM t LEFT JOIN s USING (trace_id) WHERE item_id IN (SELECT item_id FROM benchmark) GROUP BY ALL""")
def run_scores(spark, sf):
    traces = tables.read(spark, sf, "conversations").select(F.col("conv_id").alias("trace_id"), F.floor(F.col("conv_id") / 2).alias("item_id")).distinct()
    value = F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string"))
    scores = tables.read(spark, sf, "events").select(F.col("user_id").alias("trace_id"), F.col("event_type").alias("name"), value.alias("value"), F.col("event_id").alias("seq"))
    rows = observe.run_scores(traces, scores, tables.read(spark, sf, "benchmark"))
    return rows.select("trace_id", "item_id", F.size("scores").alias("n_scores"), F.round(F.aggregate(F.map_values("scores"), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("masked_traces", f"WITH {REDACTED} SELECT doc_id, sha256(text) AS plain, sha256(text) AS listed, sha256(text) AS mapped, sha256(text) AS nested FROM clean")
def masked_traces(spark, sf):
    docs = tables.documents(spark, sf).select("doc_id", "text")
    rows = docs.select("doc_id", "text", F.array("text").alias("xs"), F.create_map(F.lit("k"), F.col("text")).alias("m"), F.struct(F.array(F.struct(F.col("text").alias("t"))).alias("a")).alias("s"))
    out = observe.masked(rows)
    return out.select("doc_id", *[F.sha2(c, 256).alias(n) for c, n in ((F.col("text"), "plain"), (F.col("xs")[0], "listed"), (F.col("m")["k"], "mapped"), (F.col("s.a")[0]["t"], "nested"))])


# ---- chunked retrieval, the cached path, experiments ------------------------------------------


@query("chunked_topk", rf"""WITH {DOCS}, {CHUNKS}, bits AS (SELECT tenant_id, acl_tags, chunk_id, doc_id * 100000 + ordinal AS seq, array_to_string(tokens, ' ') AS text FROM chunks),
{POSTED.replace('FROM docs', 'FROM bits')}, {SPARSE.replace('CROSS JOIN docs', 'CROSS JOIN bits')} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM sparse""")
def chunked_topk(spark, sf):
    chunks = chunking.chunk(tables.documents(spark, sf)).withColumn("seq", F.col("doc_id") * 100000 + F.col("ordinal"))
    return bm25.top_k(tables.questions(spark, sf), chunks).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("answer_cached", f"WITH {DOCS}, asked AS (SELECT item_id AS query_id, text FROM benchmark WHERE text IS NOT NULL) SELECT query_id, CASE WHEN len({TOKENS.format('text')}) > 0 THEN 'answer_hit' END AS cache FROM asked")
def answer_cached(spark, sf):
    """All questions are answered, then asked again: what was neither refused nor blocked comes from the answer tier."""
    asked, chunks, now = tables.questions(spark, sf), tables.document_chunks(spark, sf), F.expr(NOW)
    index = bm25.build(chunks)
    first = staged(answer.answers(asked, chunks, index=index))
    entries = staged(answer.cache_entries(first, asked, now))
    return answer.answers(asked, chunks, answer_tier=entries, now=now, index=index).select("query_id", "cache")


@query("experiment_scores")
def experiment_scores(spark, sf):
    """Nine metrics of the whole question path for every golden question; means by metric."""
    asked, docs = tables.questions(spark, sf), tables.read(spark, sf, "documents")
    gold = corpora.holding(docs, asked).groupBy("query_id").agg(F.array_sort(F.collect_list(F.col("doc_id").cast("string"))).alias("relevant"))
    golden = asked.join(gold, "query_id", "left").select(*[c for c in asked.columns if c != "query_id"], F.col("query_id").alias("item_id"), F.col("question").alias("expected_output"), F.coalesce("relevant", F.array().cast("array<string>")).alias("relevant"))
    scores = experiment.run(golden, tables.document_chunks(spark, sf), "all")
    return scores.groupBy("run", "metric").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("answer_tiers", f"WITH {DOCS}, asked AS (SELECT item_id AS query_id, text FROM benchmark WHERE text IS NOT NULL) SELECT query_id, CASE WHEN len({TOKENS.format('text')}) > 0 THEN 'retrieval_hit' END AS cache FROM asked")
def answer_tiers(spark, sf):
    """All questions are answered with an empty retrieval tier, which fills; asked again they skip the search."""
    asked, chunks, now = tables.questions(spark, sf), tables.document_chunks(spark, sf), F.expr(NOW)
    index = bm25.build(chunks)
    none = answer.cache_entries(answer.answers(asked.limit(0), chunks, index=index), asked, now).limit(0)
    made = staged(answer.answered(asked, chunks, retrieval_tier=staged(none), now=now, index=index)[1])
    return answer.answers(asked, chunks, retrieval_tier=made, now=now, index=index).select("query_id", "cache")


_WRITTEN = ORACLES["answer_e2e"][: ORACLES["answer_e2e"].rindex("SELECT query_id, sha256(")]


@query("answer_guarded", _WRITTEN + "SELECT query_id, answer IS NOT NULL AND length(answer) % 2 = 0 AS blocked, answer IS NULL OR length(answer) % 2 = 0 AS refused FROM asked LEFT JOIN written USING (query_id)")
def answer_guarded(spark, sf):
    """The question path with a judge: answers of an even length are found unfaithful, and those of a length that ends in 5 have no verdict in time."""
    judge = lambda text, ids: F.when(F.length(text) % 2 == 0, 0.1).when(F.length(text) % 10 != 5, 0.9)
    return answer.answers(tables.questions(spark, sf), tables.document_chunks(spark, sf), judge=judge).select("query_id", "blocked", "refused")


_COLLAPSED = r"array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda p: trim(regexp_replace(p, '[\s\x1c-\x1f\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))), lambda p: p <> ''), chr(10) || chr(10))"


@query("uploaded_files", f"""WITH given AS (SELECT doc_id, doc_id % 3 AS kind, text, CASE WHEN doc_id % 3 = 0 THEN text ELSE {_COLLAPSED} END AS shown FROM documents),
told AS (SELECT *, CASE WHEN text IS NULL THEN 'KeyError' WHEN trim(shown) = '' THEN 'ParserError' END AS error FROM given)
SELECT doc_id, ['txt', 'html', 'docx'][kind + 1] AS ending, error, CASE WHEN error IS NULL THEN sha256(shown) END AS text_sha256 FROM told""")
def uploaded_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as an upload: plain text, HTML or DOCX in turn, and back to text."""
    kind = F.col("doc_id") % 3
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("</p><p>"))
    page = F.concat(F.lit("<html><head><title>t</title></head><body><p>"), escaped, F.lit("</p></body></html>"))
    content = F.when(kind == 0, F.encode("text", "UTF-8")).when(kind == 1, F.encode(page, "UTF-8")).otherwise(docx.text_to_docx(F.when(kind == 2, F.col("text"))))
    ending = F.when(kind == 0, "txt").when(kind == 1, "html").otherwise("docx")
    uploads = tables.read(spark, sf, "documents").select("doc_id", ending.alias("ending"), content.alias("content"))
    read = files.parsed(uploads.withColumn("content_type", files.type_of(F.concat(F.lit("x."), "ending"))))
    return read.select("doc_id", "ending", "error", F.sha2("text", 256).alias("text_sha256"))
