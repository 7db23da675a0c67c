"""Queries whose judges are clients behind ``operators.calls``, with their SQL."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek.operators import calls, guard, metrics
from lakeseek.plans import experiment
from lakeseek.plans.catalog import TOKENS, query
from lakeseek.sources import tables
from lakeseek.sources.staging import shared_folder

_BLANK = re.compile(r"[ \t\n\x0b\f\r]+")


def offline_judge():
    """A judge that works without a network: a claim holds if at least half of its different words stand in the context."""

    def words(text: str) -> set[str]:
        return set(_BLANK.split(text.lower())) - {""}

    def ask(request: str, seconds: float) -> str:
        given = json.loads(request)
        known = words(given.get("context", ""))
        return json.dumps([{"supported": 2 * len(words(c) & known) >= len(words(c))} for c in given["claims"]])

    return ask


def judged_turns(talk: DataFrame, ledger: str, client: calls.Client = offline_judge, **bounds) -> DataFrame:
    """conv_id, turn, faithfulness, action, reason of every assistant turn, judged against the turn before it."""
    before = talk.groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.max("text").alias("context"))
    turns = talk.where("role = 'assistant'").select("conv_id", "turn", "text").join(before, ["conv_id", "turn"], "left")
    claims = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"[.\n]"), lambda s: F.trim(s)), lambda s: s != "")
    asked = turns.select("conv_id", "turn", "context", F.to_json(F.struct(claims.alias("claims"), "context")).alias("request"))
    told = calls.replies(asked, "request", client, ledger, "faithfulness-1", **bounds)
    score = calls.faithfulness(F.col("reply"), F.col("reply_error"), experiment.parsed_verdicts(F.col("reply")), metrics.supported_share)
    contexts = F.when(F.coalesce("context", F.lit("")) != "", F.array("context")).otherwise(F.array().cast("array<string>"))
    done = told.withColumn("faithfulness", score).withColumn("g", guard.grounded(contexts, F.lit(False), F.col("faithfulness")))
    return done.select("conv_id", "turn", "faithfulness", F.col("g.action").alias("action"), F.col("g.reason").alias("reason"))


@query("judged_turns", rf"""WITH before AS (SELECT conv_id, turn + 1 AS turn, max(text) AS context FROM conversations GROUP BY ALL),
asked AS (SELECT conv_id, c.turn, coalesce(context, '') AS context, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.\n]'), lambda s: trim(s)), lambda s: s <> '') AS claims
  FROM conversations c LEFT JOIN before b USING (conv_id, turn) WHERE role = 'assistant'),
known AS (SELECT conv_id, turn, context, claims, {TOKENS.format('context')} AS words FROM asked),
scored AS (SELECT conv_id, turn, context, CASE WHEN len(claims) = 0 THEN 0 ELSE
  len(list_filter(claims, lambda c: 2 * len(list_intersect({TOKENS.format('c').replace('lambda x', 'lambda y').replace('x <>', 'y <>')}, words)) >= len(list_distinct({TOKENS.format('c').replace('lambda x', 'lambda y').replace('x <>', 'y <>')})))) / len(claims) END AS s FROM known)
SELECT conv_id, turn, round(s, 6) AS faithfulness, CASE WHEN context = '' OR s < {guard.LEAST_FAITHFUL} THEN 'block' ELSE 'pass' END AS action,
  CASE WHEN context = '' THEN 'no context' WHEN s < {guard.LEAST_FAITHFUL} THEN 'not faithful' ELSE '' END AS reason FROM scored""")
def judged_turns_query(spark: SparkSession, sf: str) -> DataFrame:
    done = judged_turns(tables.read(spark, sf, "conversations"), f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")
    return done.withColumn("faithfulness", F.round("faithfulness", 6))
