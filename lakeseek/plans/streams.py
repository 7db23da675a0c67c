"""Queries over streams with state, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek.plans.catalog import ORACLES, query
from lakeseek.sources import snapshots, tables
from lakeseek.sources.staging import shared_folder
from lakeseek.streaming import ingest, lifecycle, questions

DELAY, LIMIT_HOURS = "1 hour", 12
WANTED = "CASE WHEN event_id % 7 = 0 THEN 'gone' WHEN event_type = 'click' THEN 'ready' WHEN event_type = 'purchase' THEN 'deleting' WHEN event_type = 'error' THEN 'failed' ELSE 'processing' END"
LEGAL_SQL = " OR ".join("(s = '{}' AND e.status IN ({}))".format(s, ", ".join(f"'{x}'" for x in after)) for s, after in lifecycle.LEGAL.items())


@query("stream_lifecycle", f"""WITH RECURSIVE mark AS (SELECT (epoch_us(max(ts)) // 1000) * 1000 - 3600000000 AS m FROM events),
waiting AS (SELECT user_id::VARCHAR AS d, event_id AS seq, epoch_us(ts) AS at_us, {WANTED} AS status FROM events, mark WHERE epoch_us(ts) < m),
e AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY at_us, seq NULLS LAST) AS n FROM (SELECT * FROM waiting UNION ALL SELECT DISTINCT d, NULL, m, NULL FROM waiting, mark)),
walk AS (
  SELECT DISTINCT d, 0::BIGINT AS n, '' AS status, 0::BIGINT AS since, NULL::BIGINT AS seq, 0::BIGINT AS at_us, '' AS before, false AS stuck, 0::BIGINT AS stuck_at, false AS legal FROM e
  UNION ALL
  SELECT d, n, CASE WHEN legal THEN wanted ELSE s END, CASE WHEN legal THEN at_us WHEN stuck THEN stuck_at ELSE since END, seq, at_us, s, stuck, stuck_at, legal FROM (
    SELECT x.*, e.seq, e.at_us, e.status AS wanted, e.n, coalesce({LEGAL_SQL}, false) AS legal FROM (
      SELECT w.d, w.n + 1 AS next, w.since, w.status = 'processing' AND f.at_us > w.since + {LIMIT_HOURS} * 3600000000 AS stuck, w.since + {LIMIT_HOURS} * 3600000000 AS stuck_at,
        CASE WHEN w.status = 'processing' AND f.at_us > w.since + {LIMIT_HOURS} * 3600000000 THEN 'failed' ELSE w.status END AS s
      FROM walk w JOIN e f ON f.d = w.d AND f.n = w.n + 1) x JOIN e ON e.d = x.d AND e.n = x.next)),
moves AS (
  SELECT d, seq, at_us, before, status, CASE WHEN legal THEN 'applied' ELSE 'illegal' END AS verdict FROM walk WHERE seq IS NOT NULL
  UNION ALL SELECT d, NULL, stuck_at, 'processing', 'failed', 'stuck' FROM walk WHERE stuck)
SELECT d AS document_id, seq, strftime(make_timestamp(at_us), '%Y-%m-%d %H:%M:%S.%f') AS at, before, status, verdict FROM moves""")
def stream_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """Every transition, refused event and timeout of the documents of an event stream, by the stateful machine."""
    schema = tables.read(spark, sf, "events").schema
    events = ingest.file_stream(spark, sf, "events.parquet", schema).select(
        F.col("user_id").alias("document_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.expr(WANTED).alias("status"),
    )
    moves = lifecycle.run(events, f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", DELAY, LIMIT_HOURS * 3600 * 1000)
    return moves.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("stream_questions", ORACLES["bm25_topk"])
def stream_questions(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark's questions as a stream over a stored index; a later version of the index changes nothing."""
    home = f"{shared_folder(spark)}/questions-{uuid.uuid4().hex}"
    log, chunks = snapshots.Log(spark, f"{home}/index"), tables.document_chunks(spark, sf)
    first = questions.stored(log, "all", chunks)
    questions.stored(log, "fewer", chunks.where("doc_id % 2 = 0"))
    asked = ingest.file_stream(spark, sf, "benchmark.parquet", tables.read(spark, sf, "benchmark").schema, per_trigger=4)
    told = questions.run(tables.as_questions(asked), log, f"{home}/out", first["version"])
    return told.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")
