"""Question rewriting by tenant synonyms, with an optional generator."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeseek.functions.vector import words
from lakeseek.sources.staging import staged

LEAST_WORDS = 5
WORD, EDGES = re.compile(r"\w+"), re.compile(r"\w(.*\w)?\Z", re.DOTALL)


@F.pandas_udf(T.StringType())
def substituted(questions: pd.Series, rules: pd.Series) -> pd.Series:
    """Rules in order, each on the result of those before: whole words, any case, the replacement literal."""

    def one(question, pairs):
        for r in pairs if pairs is not None else ():
            question = re.sub(rf"\b{re.escape(r['shortcut'])}\b", lambda _, full=r["full"]: full, question, flags=re.IGNORECASE)
        return question

    return pd.Series([one(q, p) for q, p in zip(questions, rules)])


def folded(word: str) -> str:
    """One form for all words that match each other in any case."""
    return word.replace("\u0130", "i").lower().upper().lower()


@F.pandas_udf(T.ArrayType(T.StringType()))
def word_keys(texts: pd.Series) -> pd.Series:
    """The distinct folded words of each text, and the empty one, under which rules without a word are kept."""
    return pd.Series([None if t is None else sorted({folded(w) for w in WORD.findall(t)} | {""}) for t in texts])


@F.pandas_udf(T.BooleanType())
def odd_ends(texts: pd.Series) -> pd.Series:
    """Whether a text begins or ends with something other than a word's character."""
    return pd.Series([not EDGES.match(t) for t in texts])


def rule_keys(synonyms: DataFrame) -> DataFrame:
    """tenant_id, rule (order, shortcut, full), anchor, odd, adds of every distinct rule.

    A match of a shortcut holds each of its words whole, since it begins and ends at word boundaries; so the longest one is an
    anchor to meet questions by. ``odd`` rules begin or end with another character: what they put in may grow together with its neighbours.
    """
    rules = synonyms.where("tenant_id is not null and shortcut <> '' and full is not null").select("tenant_id", "shortcut", "full").distinct()
    longest = lambda keys: F.array_max(F.transform(keys, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))["k"]
    return rules.select("tenant_id", F.struct((-F.length("shortcut")).alias("order"), "shortcut", "full").alias("rule"), longest(word_keys("shortcut")).alias("anchor"), odd_ends("shortcut").alias("odd"), word_keys("full").alias("adds"))


def applicable(questions: DataFrame, synonyms: DataFrame) -> DataFrame:
    """id, rules: for each question (id, tenant_id, question) the rules that may apply to it, in order; questions without any are left out.

    Rules meet questions by (tenant, anchor) in an equi-join, so a question carries the rules whose words it holds and not its
    tenant's dictionary. A rule can also apply to what an earlier one has put in: the words of found rules are looked up in
    turn until none is new. Where an odd rule is among them, words may grow together, and the question takes all rules of its tenant.
    """
    rules = staged(rule_keys(synonyms))
    by = rules.select("tenant_id", F.col("anchor").alias("key"), "rule", "odd", "adds")
    fresh = staged(questions.select("id", "tenant_id", F.explode(word_keys("question")).alias("key")).join(by, ["tenant_id", "key"]).select("id", "tenant_id", "rule", "odd", "adds"))
    parts, chained = [fresh], rules.join(rules.select("tenant_id", F.explode("adds").alias("anchor")).where("anchor <> ''").distinct(), ["tenant_id", "anchor"], "left_semi").limit(1).count()
    while chained:
        known = reduce(DataFrame.unionByName, parts).select("id", "rule")
        words_in = fresh.select("id", "tenant_id", F.explode("adds").alias("key")).where("key <> ''").distinct()
        fresh = staged(words_in.join(by, ["tenant_id", "key"]).select("id", "tenant_id", "rule", "odd", "adds").join(known, ["id", "rule"], "left_anti").dropDuplicates(["id", "rule"]))
        chained = fresh.limit(1).count()
        if chained:
            parts.append(fresh)
    found = reduce(DataFrame.unionByName, parts)
    if rules.where("odd").limit(1).count():
        wide = found.where("odd").select("id", "tenant_id").distinct()
        found = found.join(wide.select("id"), "id", "left_anti").select("id", "rule").unionByName(wide.join(rules.select("tenant_id", "rule"), "tenant_id").select("id", "rule"))
    return found.groupBy("id").agg(F.array_sort(F.collect_set("rule")).alias("rules"))


def rewritten(questions: DataFrame, synonyms: DataFrame, expand=None) -> DataFrame:
    """Questions with retrieval_question; ``expand`` (a column function) helps where nothing was replaced and there are five words.

    Equal questions of a tenant are rewritten once. Rules count once each; those without a shortcut or replacement and null questions change nothing.
    """
    named = questions.withColumn("_id", F.sha2(F.col("question"), 256))
    distinct = named.where("question is not null and tenant_id is not null").select(F.sha2(F.concat_ws("\x1f", "tenant_id", "_id"), 256).alias("id"), "tenant_id", "question").distinct()
    swapped = staged(distinct.join(applicable(distinct, synonyms), "id").select("tenant_id", F.sha2(F.col("question"), 256).alias("_id"), substituted(F.col("question"), F.col("rules")).alias("_swapped")))
    joined = named.join(swapped, ["tenant_id", "_id"], "left").withColumn("retrieval_question", F.coalesce("_swapped", "question")).select(*questions.columns, "retrieval_question")
    if expand is None:
        return joined
    wanted = F.coalesce((F.col("retrieval_question") == F.col("question")) & (F.size(words(F.col("question"))) >= LEAST_WORDS), F.lit(False))
    more = joined.where(wanted).withColumn("expanded", F.trim(expand(F.col("question"))))
    more = more.withColumn("retrieval_question", F.when(F.length("expanded") > 0, F.col("expanded")).otherwise(F.col("question"))).drop("expanded")
    return more.unionByName(joined.where(~wanted))
