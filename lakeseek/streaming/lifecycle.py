"""The life of documents as a stateful stream: status events in, applied, illegal and timed-out transitions out."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lakeseek.streaming.ingest import upsert_into

# The statuses that may follow each status; a document that isn't there has the status "".
LEGAL = {
    "": ("processing",),
    "processing": ("processing", "ready", "failed", "deleting"),
    "ready": ("processing", "ready", "failed", "deleting"),
    "failed": ("processing", "ready", "failed", "deleting"),
    "deleting": ("deleting", "gone", "failed"),
    "gone": ("processing",),
}
APPLIED, ILLEGAL, STUCK = "applied", "illegal", "stuck"
#: A document may be in processing for this long after its last event.
LIMIT_MS = 2 * 3600 * 1000
OUT = "document_id string, seq long, at_us long, before string, status string, verdict string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def steps(status: str, since: int, events: Iterable[tuple[int, int, str | None]], until: int, limit_us: int) -> Iterator[tuple]:
    """(seq, at, before, status, verdict) of a document in ``status`` since ``since``: its events (at, seq, status) in order, then what time does up to ``until``."""
    for at, seq, wanted in events:
        if status == "processing" and at > since + limit_us:
            yield None, since + limit_us, status, "failed", STUCK
            status = "failed"
        if wanted in LEGAL[status]:
            yield seq, at, status, wanted, APPLIED
            status, since = wanted, at
        else:
            yield seq, at, status, status, ILLEGAL
    if status == "processing" and until > since + limit_us:
        yield None, since + limit_us, status, "failed", STUCK


class Lifecycle(StatefulProcessor):
    """Holds the status of one document and the events that the watermark hasn't passed.

    Events wait until the watermark has passed them, so the outcome follows event time and not the order or the
    batches they came in. One timer stands for the next thing due: the first waiting event, or the end of the time a
    document may be in processing. Events of one (at, seq, status) count once. What a document holds is bounded by
    the events of one watermark delay.
    """

    def __init__(self, limit_us: int) -> None:
        self.limit_us = limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "status string, since long, timer long")
        self.waiting = handle.getListState("waiting", "at long, seq long, status string")

    def _state(self) -> tuple[str, int, int | None]:
        return tuple(self.held.get()) if self.held.exists() else ("", 0, None)

    def _wake(self, status: str, since: int, timer: int | None, due_us: int) -> None:
        """Remember the state and see that a timer goes off once the watermark is past ``due_us``."""
        ms = due_us // 1000 + 1
        if timer is None or ms < timer:
            self.handle.registerTimer(ms)
            timer = ms
        self.held.update((status, since, timer))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        status, since, timer = self._state()
        new = sorted({(r.at_us, r.seq, r.status) for r in rows}, key=_order)
        self.waiting.appendList(new)
        self._wake(status, since, timer, new[0][0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, since, timer = self._state()
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted({tuple(r) for r in self.waiting.get()}, key=_order)
        due = [w for w in waiting if w[0] < now]
        rest = waiting[len(due):]
        for seq, at, before, after, verdict in steps(status, since, due, now, self.limit_us):
            if verdict != ILLEGAL:
                status, since = after, at
            yield Row(document_id=key[0], seq=seq, at_us=at, before=before, status=after, verdict=verdict)
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
        nexts = [rest[0][0]] if rest else []
        if status == "processing":
            nexts.append(since + self.limit_us)
        if timer is not None and timer <= timerValues.getCurrentWatermarkInMs():
            timer = None
        if nexts:
            self._wake(status, since, timer, min(nexts))
        else:
            self.held.update((status, since, timer))

    def close(self) -> None:
        pass


def _order(event: tuple) -> tuple:
    return event[0], event[1], event[2] or ""


def transitions(events: DataFrame, delay: str = "1 hour", limit_ms: int = LIMIT_MS) -> DataFrame:
    """document_id, seq, at, before, status, verdict of a stream of events (document_id, seq, ts, status).

    verdict: ``applied``; ``illegal`` for a status that may not follow (the document keeps its own, as for null and
    unknown statuses); ``stuck`` (no seq) where a document is in processing for over ``limit_ms`` without an event, and
    so fails. Events without a document, a time or a seq are ignored, as are those later than ``delay``. A document's events
    pass one task in order, which is what a state machine needs; documents are spread over all. Needs the RocksDB state store.
    """
    told = events.where("document_id is not null and ts is not null and seq is not null").withWatermark("ts", delay).select(
        F.col("document_id").cast("string").alias("document_id"), "ts", F.unix_micros("ts").alias("at_us"), F.col("seq").cast("long").alias("seq"), "status",
    )
    moved = told.groupBy("document_id").transformWithState(Lifecycle(limit_ms * 1000), OUT, "Append", "EventTime")
    return moved.select("document_id", "seq", F.timestamp_micros("at_us").alias("at"), "before", "status", "verdict")


def run(events: DataFrame, folder: str, delay: str = "1 hour", limit_ms: int = LIMIT_MS) -> DataFrame:
    """Process what there is, on from where an earlier run with this ``folder`` stopped, and return all transitions so far."""
    spark = events.sparkSession
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        out = transitions(events, delay, limit_ms)
        query = out.writeStream.outputMode("append").foreachBatch(upsert_into(f"{folder}/transitions")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/transitions/batch=*")


def current(moves: DataFrame) -> DataFrame:
    """document_id, status, at of every document's last transition that changed it or was applied; documents that are gone are left out."""
    order: Column = F.struct("at", F.coalesce("seq", F.lit(-(1 << 62))))
    last = moves.where(F.col("verdict") != ILLEGAL).groupBy("document_id").agg(F.max_by(F.struct("status", "at"), order).alias("m"))
    return last.select("document_id", "m.status", "m.at").where("status <> 'gone'")
