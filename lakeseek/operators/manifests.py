"""Manifests as digest trees: rows, documents, buckets. A comparison goes down only where digests differ.

The digest of a document or bucket is the count of its rows and four sums of 60 bits of each row's SHA-256. Sums have no
order, so they are built with partial sums, and a document of any number of rows is never one task. The bucket level (at
most ``buckets`` entries, whatever the size of the table) lies in the version file of a ``snapshots.Log``; the levels below
it are Parquet under data/commit=.../level=.../bucket=.... A commit writes the buckets that differ and points to
the older commits' folders for all others.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeseek.operators import incremental
from lakeseek.sources.snapshots import Log
from lakeseek.sources.staging import staged

BUCKETS, LANES, LANE_DIGITS = 256, 4, 15
DOC = ["tenant_id", "doc_id"]
SUMS = ["n", *[f"lane{i}" for i in range(LANES)]]


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in DOC]), F.lit(buckets)).cast("int")


def _kept(manifest: DataFrame, buckets: int) -> DataFrame:
    """Rows with their bucket; those without identity or hashes count as not there."""
    whole = manifest.where(" and ".join(f"{c} is not null" for c in (*DOC, "chunk_id", "embed_hash", "meta_hash")))
    return whole.select(*incremental.MANIFEST).withColumn("bucket", bucket_of(buckets))


def documents_of(rows: DataFrame) -> DataFrame:
    """bucket, tenant_id, doc_id, n and lanes of manifest rows with their bucket."""
    told = F.sha2(F.concat_ws("\x1f", "chunk_id", F.coalesce(F.col("ordinal").cast("string"), F.lit("")), "embed_hash", "meta_hash"), 256)
    lanes = [F.conv(F.substring("told", 1 + i * LANE_DIGITS, LANE_DIGITS), 16, 10).cast("decimal(20,0)") for i in range(LANES)]
    return rows.withColumn("told", told).groupBy("bucket", *DOC).agg(F.count("*").alias("n"), *[F.sum(x).alias(f"lane{i}") for i, x in enumerate(lanes)])


def _digest() -> Column:
    return F.concat_ws(":", *[F.col(s).cast("decimal(38,0)").cast("string") for s in SUMS])


@dataclass
class Change:
    """A manifest held against the last version of a log."""

    log: Log
    base: dict
    buckets: int
    rows: DataFrame
    documents: DataFrame
    tops: dict[str, str]

    @property
    def differing(self) -> list[int]:
        held = {b: x["digest"] for b, x in self.base.get("buckets", {}).items()}
        return sorted(int(b) for b in {*held, *self.tops} if held.get(b) != self.tops.get(b))


def compared(log: Log, new: DataFrame, buckets: int = BUCKETS) -> Change:
    """``new``, a whole manifest, by its tree. Of the stored version only the version file is read. The first commit sets ``buckets``."""
    base = log.state()
    buckets = base.get("fan", buckets)
    rows = staged(_kept(new, buckets))
    documents = staged(documents_of(rows))
    tops = documents.groupBy("bucket").agg(*[F.sum(s).alias(s) for s in SUMS]).select("bucket", _digest().alias("digest"))
    return Change(log, base, buckets, rows, documents, {str(r.bucket): r.digest for r in tops.collect()})


def _stored(change: Change, level: str, schema) -> DataFrame:
    """A level of the stored version, the folders of differing buckets only."""
    log, held = change.log, change.base.get("buckets", {})
    folders = [f"{log.path}/{held[str(b)]['place']}/level={level}/bucket={b}" for b in change.differing if str(b) in held]
    if not folders:
        return log.spark.createDataFrame([], schema)
    return log.spark.read.schema(schema).option("basePath", f"{log.path}/data").parquet(*folders)


def moved_documents(change: Change) -> DataFrame:
    """tenant_id, doc_id of the documents whose rows differ from the stored version's."""
    old = _stored(change, "documents", change.documents.schema).select("bucket", *DOC, _digest().alias("old"))
    new = change.documents.where(F.col("bucket").isin(change.differing)).select("bucket", *DOC, _digest().alias("new"))
    return old.join(new, ["bucket", *DOC], "full").where(~F.col("old").eqNullSafe(F.col("new"))).select(*DOC)


def stored_rows(change: Change) -> DataFrame:
    """The stored rows of differing buckets."""
    return _stored(change, "rows", change.rows.schema)


def diff(change: Change, unchanged: bool = True) -> DataFrame:
    """The rows of ``incremental.diff``: rows are compared in documents that differ, all others are noop (left out unless ``unchanged``)."""
    moved = staged(moved_documents(change))
    told = incremental.diff(stored_rows(change).join(moved, DOC, "left_semi"), change.rows.where(F.col("bucket").isin(change.differing)).join(moved, DOC, "left_semi"))
    if not unchanged:
        return told.where("action <> 'noop'")
    return told.unionByName(change.rows.join(moved, DOC, "left_anti").select(*DOC, "chunk_id", F.lit("noop").alias("action")))


def commit(change: Change, run: str) -> dict:
    """The compared manifest as the log's next version; writes differing buckets only. A run that has committed does nothing more."""
    log = change.log
    done = log.run(run)
    if done is not None:
        return done
    place = f"data/commit={uuid.uuid4().hex}"
    held = {b: x for b, x in change.base.get("buckets", {}).items() if int(b) not in change.differing}
    fresh = {str(b): {"place": place, "digest": change.tops[str(b)]} for b in change.differing if str(b) in change.tops}
    if fresh:
        for level, table in (("rows", change.rows), ("documents", change.documents)):
            # even parts, also where one bucket holds most rows
            table.where(F.col("bucket").isin(change.differing)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{log.path}/{place}/level={level}")
    places = {x["place"] for x in (held | fresh).values()}
    return log.commit(change.base["version"], run, {"fan": change.buckets, "buckets": held | fresh, "tables": {p: {"place": p} for p in sorted(places)}})


def load(log: Log, like: DataFrame, version: int | None = None) -> DataFrame:
    """All manifest rows of a version, in the columns of ``like``."""
    held = log.state(version).get("buckets", {})
    folders = [f"{log.path}/{x['place']}/level=rows/bucket={b}" for b, x in held.items()]
    columns = like.select(*incremental.MANIFEST)
    if not folders:
        return columns.limit(0)
    return log.spark.read.schema(columns.schema).option("basePath", f"{log.path}/data").parquet(*folders).select(*incremental.MANIFEST)
