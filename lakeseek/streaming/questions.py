"""A stream of questions answered from one version of a stored index, micro-batch by micro-batch.

The first start notes in ``out`` which version it answers from, so every later batch, and every restart, reads the same
chunks and weights whatever has been committed to the index since. ``moved`` sets a stopped stream onto another
version. A batch's rows are written under its number; a batch that the engine replays after a failure is found whole and not
searched again, and one that was half written is written anew. So each question of the stream has its rows once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek.operators import bm25, inverted
from lakeseek.sources.snapshots import Log, load, save
from lakeseek.sources.staging import staged

RESULT = "query_id {0}, tenant_id string, chunk_id string, score double, rank int, version long"


def stored(log: Log, run: str, chunks: DataFrame) -> dict:
    """A BM25 index of the chunks as a new version: counted terms, weights and lengths together. The same run again does nothing."""

    def weights(written: dict[str, DataFrame]) -> DataFrame:
        return bm25.inverse_frequency(bm25.document_frequency(bm25.unfolded(written["listed"])), written["lengths"])

    lengths = lambda written: bm25.lengths_of(written["listed"])
    return save(log, run, {"listed": bm25.listed(chunks), "lengths": lengths, "weights": weights})


def opened(log: Log, version: int) -> bm25.Index:
    return bm25.Index(*(load(log, name, version) for name in ("listed", "weights", "lengths")))


def by_lists(log: Log, version: int, k: int = 20) -> Callable[[DataFrame], DataFrame]:
    """Search in an index of ``stored``."""
    index = opened(log, version)
    return lambda questions: bm25.top_k(questions, index, k)


def by_blocks(log: Log, version: int, k: int = 20) -> Callable[[DataFrame], DataFrame]:
    """Search in an index of ``operators.inverted``, whose folders lie under the log's path."""
    index = inverted.pinned(log.spark, log.path, version)
    return lambda questions: inverted.top_k(questions, index, k)


def _noted(log: Log, out: Log, version: int | None) -> int:
    """The version that the stream under ``out`` answers from; noted at the first start."""
    state = out.state()
    if state["version"]:
        if version not in (None, state["index_version"]):
            raise ValueError(f"the stream answers from version {state['index_version']}; use moved() to change that")
        return state["index_version"]
    chosen = version if version is not None else log.state()["version"]
    if not chosen:
        raise ValueError("the index has no version yet")
    return out.commit(0, "start", {"index_version": chosen})["index_version"]


def moved(out: Log, version: int, run: str) -> None:
    """Later batches of a stopped stream answer from another version. The same run again does nothing."""
    if out.run(run) is None:
        out.commit(out.state()["version"], run, {"index_version": version})


def answering(out: Log, version: int, search: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """The foreachBatch function."""

    def write(batch: DataFrame, number: int) -> None:
        name = f"answers/batch={number}"
        if "_SUCCESS" in out.names(name):
            return
        found = search(staged(batch))
        kinds = {"query_id": batch.schema["query_id"].dataType.simpleString()}
        rows = found.select(F.col("query_id").cast(kinds["query_id"]), "tenant_id", "chunk_id", F.col("score").cast("double").alias("score"), F.col("rank").cast("int").alias("rank"), F.lit(version).cast("long").alias("version"))
        rows.write.mode("overwrite").parquet(f"{out.path}/{name}")

    return write


def run(stream: DataFrame, log: Log, path: str, version: int | None = None, opener=by_lists, k: int = 20) -> DataFrame:
    """Answer what there is (query_id, question, tenant_id, caller_tags, query_collection) and return all answers so far."""
    spark = stream.sparkSession
    out = Log(spark, path)
    chosen = _noted(log, out, version)
    query = stream.writeStream.foreachBatch(answering(out, chosen, opener(log, chosen, k))).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return answers(spark, path, stream.schema["query_id"].dataType.simpleString())


def answers(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """query_id, tenant_id, chunk_id, score, rank, version of every batch that is whole."""
    out = Log(spark, path)
    whole = [f"{path}/answers/{n}" for n in out.names("answers") if "_SUCCESS" in out.names(f"answers/{n}")]
    schema = RESULT.format(id_type)
    return spark.read.schema(schema).parquet(*whole) if whole else spark.createDataFrame([], schema)
