"""Dense top-k: cosine over visible vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeseek.operators import local

#: Query sets of up to this many rows travel with the tasks; a larger one is searched in blocks of this many.
QUERY_BLOCK = 2000


def blocks(queries: DataFrame, size: int = QUERY_BLOCK) -> list[DataFrame]:
    """``queries`` (query_id, ...) in hash blocks of about ``size`` rows, each small enough to travel."""
    n = -(-queries.count() // size)
    if n <= 1:
        return [queries]
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b) for b in range(n)]


def matrix(vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows, and whether each has ``size`` numbers, none of them null; others are rows of zeros."""
    ok = pc.fill_null(pc.equal(pc.list_value_length(vectors), size), False).to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), size))
    out[ok] = pc.list_flatten(vectors.filter(pa.array(ok))).to_numpy(zero_copy_only=False).reshape(-1, size)
    whole = ~np.isnan(out).any(axis=1)
    return np.where(whole[:, None], out, 0.0), ok & whole


def cosines(asked: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines by question and row, to 9 digits; 0 where either has no length."""
    norms = np.linalg.norm(asked, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None, :]
    return np.round(np.divide(asked @ rows.T, norms, out=np.zeros(norms.shape), where=norms > 0), 9)


def scorer(vectors: list, column: str):
    """Scores of batches by the questions' ``vectors``; -inf where one is missing or they differ in size."""
    sizes = {len(v) for v in vectors if v is not None}
    groups = []
    for size in sizes:
        at = np.array([i for i, v in enumerate(vectors) if v is not None and len(v) == size and None not in v], np.int64)
        if len(at):
            groups.append((size, at, np.array([vectors[i] for i in at], float).reshape(len(at), size)))

    def score(batch: pa.RecordBatch) -> np.ndarray:
        out = np.full((len(vectors), batch.num_rows), -np.inf)
        for size, at, asked in groups:
            rows, ok = matrix(batch.column(column), size)
            out[at] = np.where(ok[None, :], cosines(asked, rows), -np.inf)
        return out

    return score


def top_k(queries: DataFrame, vecs: DataFrame, k: int = 20, key: str = "vec_id") -> DataFrame:
    """query_id, ``key``, score, rank: the k nearest visible vectors of each query.

    The scan side is never shuffled while the block of queries travels with the tasks; a task keeps and sends on k rows per query.
    """
    parts = []
    wanted = queries.select("query_id", *local.RIGHTS, "query_vector")
    schema = T.StructType([wanted.schema["query_id"], T.StructField("score", T.DoubleType()), vecs.schema[key]])
    for block in blocks(wanted):
        asked = block.collect()
        met = vecs.withColumn("embedding", F.col("embedding").cast("array<double>"))
        found = local.best(met, asked, scorer([r["query_vector"] for r in asked], "embedding"), ["embedding"], [key], k, schema)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
        parts.append(found.select("query_id", key, "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
