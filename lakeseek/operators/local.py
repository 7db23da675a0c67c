"""The best k rows of each question, found where the rows lie: a task sends on at most k rows per question, whatever it has met.

Questions of a block (dense.QUERY_BLOCK at most) travel with the task; rows come as Arrow batches, are scored a slice at a time
against all questions of the block, and only what may still be among a question's best k is held.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lakeseek.operators.acl import seen_by

#: Scores of a slice, rows of the first slice, and bytes of a batch between Spark and Python.
SCORES, FIRST, BATCH_BYTES = 1 << 20, 256, 4 << 20
RIGHTS = ["tenant_id", "caller_tags", "query_collection"]


class Best:
    """The best ``k`` rows of each of ``n`` questions by (score down, ties up); the ties are Arrow columns, nulls first."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.floor, self.place = np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max)
        self.held: pa.Table | None = None
        self.waiting, self.rows = [], 0

    def add(self, scores: np.ndarray, may: np.ndarray, ties: list[pa.Array]) -> None:
        """``scores`` and ``may`` (whether it may be seen) by question and row."""
        ok = may & (scores >= self.floor[:, None])
        if pa.types.is_integer(ties[0].type):
            place = pc.fill_null(ties[0].cast(pa.int64()), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            ok &= (scores > self.floor[:, None]) | (place[None, :] <= self.place[:, None])
        q, r = np.nonzero(ok)
        if not len(q):
            return
        self.waiting.append(pa.table([pa.array(q.astype(np.int32)), pa.array(scores[q, r]), *[t.take(pa.array(r)) for t in ties]], names=["q", "score", *[f"t{i}" for i in range(len(ties))]]))
        self.rows += len(q)
        if self.held is None or self.rows > max(20_000, self.n * self.k // 2):
            self.cut()

    def cut(self) -> pa.Table | None:
        if self.waiting:
            whole = pa.concat_tables([*([self.held] if self.held is not None else []), *self.waiting])
            self.waiting, self.rows = [], 0
            keys = [("q", "ascending"), ("score", "descending"), *[(c, "ascending") for c in whole.column_names[2:]]]
            whole = whole.take(pc.sort_indices(whole, sort_keys=keys, null_placement="at_start"))
            q = whole["q"].to_numpy()
            nth = np.arange(len(q)) - np.searchsorted(q, q)
            whole = whole.filter(pa.array(nth < self.k)).combine_chunks()
            last = np.flatnonzero(nth[nth < self.k] == self.k - 1)
            at = whole["q"].to_numpy()[last]
            self.floor[at] = whole["score"].to_numpy()[last]
            if pa.types.is_integer(whole["t0"].type):
                self.place[at] = pc.fill_null(whole["t0"].take(pa.array(last)).cast(pa.int64()), np.iinfo(np.int64).min).to_numpy()
            self.held = whole
        return self.held


def bounded(spark: SparkSession) -> None:
    """Rows reach Python in batches of at most BATCH_BYTES; by default a batch has 10,000 rows however long they are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def rights_of(rows: list) -> tuple[list[dict], np.ndarray]:
    """The distinct rights of questions, and the number of each question's own."""
    told = {}
    mine = [told.setdefault(json.dumps([r["tenant_id"], r["caller_tags"], r["query_collection"]]), len(told)) for r in rows]
    return [dict(zip(RIGHTS, json.loads(t), strict=True)) for t in told], np.array(mine, np.int64)


def slices(batch: pa.RecordBatch, wide: int, first: bool) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` of SCORES // ``wide`` rows; the very first is short, so that a bound is known before the next."""
    most, at = max(64, SCORES // max(wide, 1)), 0
    while at < batch.num_rows:
        n = min(most, FIRST) if first and at == 0 else most
        yield batch.slice(at, n)
        at += n


def may_see(seen: pa.Array, mine: np.ndarray, rights: int) -> np.ndarray:
    """By question and row: whether the row's list ``seen`` has the question's right."""
    seen = seen.combine_chunks() if isinstance(seen, pa.ChunkedArray) else seen
    rows = pc.list_parent_indices(seen).to_numpy()
    by_right = np.zeros((rights, len(seen)), bool)
    by_right[pc.list_flatten(seen).to_numpy(zero_copy_only=False), rows] = True
    return by_right[mine]


def best(rows: DataFrame, asked: list, score: Callable, columns: list, ties: list[str], k: int, schema: T.StructType, wide: int = 0) -> DataFrame:
    """``schema``: the first fields of the questions ``asked`` (named as there), then score, then ``ties``; at most ``k`` rows per question and task.

    score(batch) gives the scores by question and row from ``columns`` of ``rows``; -inf stands for none and comes out as null, NaN for a
    row that isn't met.
    """
    spark = rows.sparkSession
    bounded(spark)
    rights, mine = rights_of(asked)
    own = [f for f in schema.fields if f.name != "score" and f.name not in ties]
    told = [pa.array([r[f.name] for r in asked], to_arrow_type(f.dataType)) for f in own]
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])
    n, m = len(asked), len(rights)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, first = Best(n, k), True
        for batch in batches:
            for part in slices(batch, max(n, wide), first):
                first = False
                top.add(score(part), may_see(part.column("_seen"), mine, m), [part.column(t) for t in ties])
        held = top.cut()
        if held is not None:
            for b in held.to_batches(max_chunksize=10_000):
                s = b.column("score").to_numpy()
                found = {"score": pa.array(s, mask=np.isneginf(s)), **{t: b.column(i + 2) for i, t in enumerate(ties)}, **{f.name: c.take(b.column("q")) for f, c in zip(own, told, strict=True)}}
                yield pa.RecordBatch.from_arrays([found[f.name].cast(f.type) for f in arrow], schema=arrow)

    met = rows.withColumn("_seen", seen_by(rights)).where(F.size("_seen") > 0).select("_seen", *ties, *columns)
    return met.mapInArrow(search, schema)
