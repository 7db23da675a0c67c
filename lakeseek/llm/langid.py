"""Language identification: multinomial naive Bayes over hashed character n-grams.

Features are the 2- and 3-grams of the lower-cased letters of a text (everything else counts as
a blank), hashed into ``BUCKETS``. Tasks add up counts per language and bucket over all training
rows, Spark sums them, and the log-probability matrix (languages x buckets, a size that does not
depend on the rows) is broadcast for scoring in numpy.

The score is the posterior of the predicted language after dividing the evidence by the square
root of the number of n-grams, since overlapping n-grams aren't independent.

Defined cases: a null text or one without a letter is ``und`` with score 0; without training rows
every text is ``und``; ties go to the language that sorts first; rows with a null doc_id are
neither held out nor learned from; a training table with more than ``MAX_LANGUAGES`` languages is
refused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeseek.llm.common import bounded_batches, read_table

BUCKETS = 1 << 16
MAX_LANGUAGES = 400
SMOOTHING = 0.1
PIECE_CHARS = 1 << 19
_LETTER: list = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def _pieces(texts: list):
    """(rows, strings) groups of bounded size; a long text comes as overlapping pieces."""
    rows, parts, held = [], [], 0
    for row, text in enumerate(texts):
        padded = f" {(text or '').lower()}  "
        for k in range(0, len(padded) - 2, PIECE_CHARS):
            part = padded[k : k + PIECE_CHARS + 2]
            if held and held + len(part) > PIECE_CHARS:
                yield rows, parts
                rows, parts, held = [], [], 0
            rows.append(row)
            parts.append(part)
            held += len(part)
    if parts:
        yield rows, parts


def ngrams(texts: list):
    """Arrays (row, bucket) of the n-grams of the texts, group by group."""
    letter = _letters()
    for rows, parts in _pieces(texts):
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), "<u4")
        codes = np.where(letter[codes], codes, np.uint32(32))
        lengths = np.array([len(p) for p in parts])
        row = np.repeat(np.array(rows), lengths)
        whole = np.ones(len(codes), bool)
        ends = np.cumsum(lengths)
        whole[ends - 1] = whole[ends - 2] = False
        c0, c1, c2 = codes[:-2], codes[1:-1], codes[2:]
        row, whole = row[:-2], whole[:-2]
        two = c0 * np.uint32(0x85EBCA6B) + c1 * np.uint32(0xC2B2AE35)
        three = two * np.uint32(0x27D4EB2F) + c2 * np.uint32(0x165667B1)
        keep2 = whole & ((c0 != 32) | (c1 != 32))
        keep3 = whole & (c1 != 32)
        mixed = np.concatenate([two[keep2], three[keep3] + np.uint32(0x9E3779B9)])
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        yield np.concatenate([row[keep2], row[keep3]]), (mixed >> np.uint32(16)).astype(np.int64)


def _count(batches):
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        names = sorted(set(langs))
        index = np.array([names.index(x) for x in langs], np.int64) if len(names) < 64 else np.unique(langs, return_inverse=True)[1]
        for row, bucket in ngrams(batch.column("text").to_pylist()):
            flat = np.bincount(index[row] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
            for name, counts in zip(names, flat):
                totals[name] = totals[name] + counts if name in totals else counts.copy()
    for name, counts in totals.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "bucket", "n"])


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Sorted language names and the matrix of log probabilities from the rows of text and non-null lang."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("text", "lang").where("lang is not null and text is not null")
    counts = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    names = sorted(r["lang"] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found = counts.toArrow()  # at most languages x buckets rows
    matrix = np.full((len(names), BUCKETS), SMOOTHING)
    index = {n: i for i, n in enumerate(names)}
    at = np.array([index[x] for x in found.column("lang").to_pylist()], np.int64)
    matrix[at, found.column("bucket").to_numpy()] += found.column("n").to_numpy()
    return names, np.log(matrix / matrix.sum(1, keepdims=True)).astype(np.float32) if names else matrix.astype(np.float32)


def score(texts: list, names: list[str], matrix: np.ndarray) -> tuple[list[str], np.ndarray]:
    n, k = len(texts), len(names)
    total, seen = np.zeros((k, n)), np.zeros(n)
    for row, bucket in ngrams(texts):
        seen += np.bincount(row, minlength=n)
        for i in range(k):
            total[i] += np.bincount(row, weights=matrix[i][bucket], minlength=n)
    if not k:
        return ["und"] * n, np.zeros(n)
    tempered = total / np.sqrt(np.maximum(seen, 1))
    share = np.exp(tempered - tempered.max(0))
    share /= share.sum(0)
    best = share.argmax(0)
    return [names[b] if s else "und" for b, s in zip(best, seen)], np.where(seen > 0, share[best, np.arange(n)], 0.0)


def _scorer(docs: DataFrame, model: tuple[list[str], np.ndarray]):
    bounded_batches(docs.sparkSession)
    names = model[0]
    shared = docs.sparkSession.sparkContext.broadcast(model[1])
    return lambda texts: score(texts, names, shared.value)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs``."""
    scorer = _scorer(docs, model)

    def work(batches):
        for batch in batches:
            found, sure = scorer(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string()), pa.array(sure, pa.float64())], ["doc_id", "lang_pred", "score"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select("doc_id", "text").mapInArrow(work, schema)


def keep_identified(docs: DataFrame, model: tuple[list[str], np.ndarray], least: float) -> DataFrame:
    """The rows of ``docs`` whose text has letters and whose score is ``least`` or more."""
    scorer = _scorer(docs, model)

    def work(batches):
        for batch in batches:
            found, sure = scorer(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield batch.filter(pa.array([f != "und" and s >= least for f, s in zip(found, sure)], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = predict(docs, train(training_rows(docs)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
