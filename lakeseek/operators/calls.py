"""Calls to a model outside Spark: each different request is answered once, within bounds, and paid for once.

``replies`` tells requests apart by a digest of model name and text; equal ones meet by a partial aggregate, so a request that a third of
all rows make is one call. What the ledger holds from earlier runs is joined in and not asked again. The rest is dealt into
``buckets`` and ordered there by digest, so that a task's requests are the same ones in the same order however often it is
started. A task makes at most ``workers`` calls at a time and writes every BATCH replies to a ledger file that is named by the run and
the digests of these requests, under another name first. A task that starts again finds these files and pays only for its last, unwritten batch.
A run that starts anew after its driver was lost finds in the ledger what was answered. Two attempts at one time (speculation) may both
pay for a batch; both write the same file.

A client is a function without arguments that a task calls once; what it returns takes (request, seconds left) and gives the reply's text.
It should give up by itself after these seconds; a call that doesn't is left behind in a thread of its own and counts as ``timeout``.
A reply that ``valid`` refuses is ``malformed`` and asked again, as is a call that raises, at most ``tries`` times with growing pauses;
a timeout isn't asked again. Faults stay in the ledger as a record, but the next run asks them anew.

Defined cases: a null request has a null reply and no error, and costs nothing; repeated rows come out as often as they go in; an empty
table makes no call.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH, WORKERS, TRIES, TIMEOUT, PAUSE, BUCKETS = 64, 8, 3, 30.0, 0.5, 64
LEDGER = "key string, reply string, error string, tries int, asked_at timestamp"
_FIELDS = pa.schema([("key", pa.string()), ("reply", pa.string()), ("error", pa.string()), ("tries", pa.int32()), ("asked_at", pa.timestamp("us", "UTC"))])

Client = Callable[[], Callable[[str, float], str]]


def is_json(reply: str) -> bool:
    """Whether a reply is a JSON object or list."""
    try:
        return isinstance(json.loads(reply), (dict, list))
    except (TypeError, ValueError):
        return False


def _timed(ask: Callable[[str, float], str], request: str, seconds: float) -> tuple[str | None, str | None]:
    """Reply and error of one call; a thread of its own, so that a call that hangs holds up nothing but itself."""
    out: list = []

    def run():
        try:
            out.append((ask(request, seconds), None))
        except TimeoutError:
            out.append((None, "timeout"))
        except Exception as fault:  # whatever a client raises is the row's error, not the task's
            out.append((None, f"failed: {type(fault).__name__}"))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    return out[0] if out else (None, "timeout")


def answered(ask, request: str, valid=is_json, tries: int = TRIES, timeout: float = TIMEOUT, pause: float = PAUSE) -> tuple[str | None, str | None, int]:
    """Reply, error and the number of tries."""
    error = None
    for n in range(1, tries + 1):
        reply, error = _timed(ask, request, timeout)
        if error is None and not valid(reply):
            error = "malformed"
        if error is None or error == "timeout":
            return (reply if error is None else None), error, n
        if n < tries:
            time.sleep(pause * 2 ** (n - 1))
    return None, error, tries


def _opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a folder as Spark names it."""
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri else (pyarrow.fs.LocalFileSystem(), uri)


def _batches(rows: Iterator[pa.RecordBatch], size: int) -> Iterator[list[tuple[str, str]]]:
    """Runs of ``size`` requests of one bucket; the last of a bucket may be shorter."""
    held, of = [], None
    for batch in rows:
        for bucket, key, request in zip(*(batch.column(c).to_pylist() for c in ("bucket", "key", "request"))):
            if held and (bucket != of or len(held) == size):
                yield held
                held = []
            of = bucket
            held.append((key, request))
    if held:
        yield held


def replies(
    rows: DataFrame, request: str, client: Client, ledger: str, model: str, out: str = "reply", valid=is_json,
    tries: int = TRIES, timeout: float = TIMEOUT, workers: int = WORKERS, pause: float = PAUSE, batch: int = BATCH, buckets: int = BUCKETS,
) -> DataFrame:
    """``rows`` with ``out`` (the reply to the text in column ``request``) and ``out``_error; calls are made before this returns.

    ``ledger`` is a folder that all executors share. ``model`` names model and prompt: another name asks anew.
    """
    spark = rows.sparkSession
    key = F.sha2(F.concat(F.lit(model), F.lit("\n"), F.col(request)), 256)
    fs, path = _opened(ledger)
    fs.create_dir(path, recursive=True)
    before = spark.read.schema(LEDGER).parquet(ledger)
    settled = before.where("error is null").select("key").distinct()
    asked = rows.where(F.col(request).isNotNull()).select(key.alias("key"), F.col(request).alias("request")).groupBy("key").agg(F.min("request").alias("request"))
    pending = asked.join(settled, "key", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))

    this_run = uuid.uuid4().hex

    def work(given):
        fs, path = _opened(ledger)
        ask = None
        with ThreadPoolExecutor(workers) as pool:
            for run in _batches(given, batch):
                name = f"{this_run}-{hashlib.sha256(''.join(k for k, _ in run).encode()).hexdigest()}"
                file = f"{path}/{name}.parquet"
                if fs.get_file_info(file).type == pyarrow.fs.FileType.NotFound:
                    ask = ask or client()
                    told = list(pool.map(lambda r: answered(ask, r[1], valid, tries, timeout, pause), run))
                    now = datetime.now(timezone.utc)
                    table = pa.table([[k for k, _ in run], *(list(c) for c in zip(*told)), [now] * len(run)], schema=_FIELDS)
                    draft = f"{path}/_{name}-{uuid.uuid4().hex}"
                    pq.write_table(table, draft, filesystem=fs)
                    fs.move(draft, file)
                yield pa.RecordBatch.from_arrays([pa.array([len(run)], pa.int64())], ["n"])

    dealt = pending.repartition(buckets, "bucket").sortWithinPartitions("bucket", "key").mapInArrow(work, "n long")
    dealt.agg(F.sum("n")).collect()  # one number
    last = spark.read.schema(LEDGER).parquet(ledger).groupBy("key").agg(F.max(F.struct(F.col("error").isNull().alias("good"), "asked_at", "reply", "error")).alias("_last"))
    mark = "_key"
    while mark in rows.columns:
        mark += "_"
    # rows without a request match nothing: any key will do, and one for all would send them to one task
    spread = F.concat(F.lit("-"), F.pmod(F.monotonically_increasing_id(), F.lit(997)).cast("string"))
    met = rows.withColumn(mark, F.coalesce(key, spread)).join(last.withColumnRenamed("key", mark), mark, "left")
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], F.col("_last.reply").alias(out), F.col("_last.error").alias(f"{out}_error"))


def injection_verdict(reply: Column, field: str = "injection") -> Column:
    """What a judge says, for ``guard.injection``: null, which blocks, where it said nothing that can be read."""
    return F.from_json(reply, f"{field} boolean")[field]


def faithfulness(reply: Column, error: Column, verdicts: Column, share: Callable[[Column], Column]) -> Column:
    """Share of the verdicts that hold, for ``guard.grounded``: null after a timeout (passes unverified), 0 for any other fault (blocks)."""
    return F.when(error == "timeout", F.lit(None).cast("double")).when(error.isNotNull() | reply.isNull(), 0.0).otherwise(share(verdicts))
