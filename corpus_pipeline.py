"""A corpus pipeline: language ID, near-dedup, decontamination, redaction, tokenising.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. The stages are meant to be written and reread one by one; ``run`` chains them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek.llm import decontaminate, langid, pieces, pii, simhash
from lakeseek.llm.common import checkpointed, read_table

#: Least posterior of a language; texts below it, and texts without letters, go.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.train(langid.training_rows(docs)), LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data; n_chars follows the text where it is present and the text changed."""
    new = pii.redacted(docs)
    if "n_chars" not in docs.columns:
        return new
    return new.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("redaction", redaction),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs


#: The language model and the transducer have no SQL form; tests hold the rows against plain Python.
ORACLE_SQL = None
